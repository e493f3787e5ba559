"""The demonstration city's assets, dependency edges, decoy credentials and lookup tables.

All of it is data that results depend on, written out as is. ``inline_table`` turns such a list into a
Spark inline table, which Catalyst sees as a local relation of known size.
"""

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: curated assets (ip, name, type, criticality, purdue level, sector) ---
ASSETS = [
    ("10.0.1.10", "Traffic_Cam_1", "IoT Sensor", 0.2, 0, "transport"),
    ("10.0.1.11", "Traffic_Cam_2", "IoT Sensor", 0.2, 0, "transport"),
    ("10.0.1.12", "Traffic_Controller", "ICS Controller", 0.9, 1, "transport"),
    ("10.0.1.13", "Power_Substation", "Critical Infra", 1.0, 1, "energy"),
    ("10.0.1.14", "Emergency_Route_System", "Public Safety API", 0.95, 3, "public_safety"),
    ("10.0.1.15", "Citizen_Portal", "Public Web Service", 0.4, 4, "civic"),
    ("10.0.1.16", "SCADA_Historian", "Data Logging Server", 0.6, 2, "monitoring"),
    ("10.0.1.20", "City_Payment_Gateway", "Financial Transaction System", 0.95, 4, "finance"),
    ("10.0.1.21", "Bank_Partner_API", "External Financial Interface", 0.85, 5, "finance"),
    ("10.0.1.22", "Municipal_Bond_Platform", "Financial Market System", 0.75, 4, "finance"),
    ("10.0.1.23", "Social_Welfare_System", "Social Safety Net", 0.9, 4, "finance"),
    ("10.0.1.30", "City_Operations_Center", "Security Operations Center", 0.98, 3, "operations"),
    ("10.0.1.31", "Power_Substation_Beta", "Critical Infra", 0.75, 1, "energy"),
    ("10.0.1.32", "Solar_Array_West", "IoT Sensor", 0.25, 0, "energy"),
    ("10.0.1.33", "Battery_Storage_Facility", "Critical Infra", 0.6, 1, "energy"),
    ("10.0.1.34", "Grid_SCADA", "ICS Controller", 0.65, 2, "energy"),
    ("10.0.1.35", "Water_Treatment_Plant", "Critical Infra", 0.85, 1, "water"),
    ("10.0.1.36", "Water_Pump_Station", "ICS Controller", 0.55, 1, "water"),
    ("10.0.1.37", "Water_Quality_Sensors", "IoT Sensor", 0.2, 0, "water"),
    ("10.0.1.38", "Wastewater_Facility", "Critical Infra", 0.5, 1, "water"),
    ("10.0.1.39", "Metro_Signalling_System", "ICS Controller", 0.8, 1, "transport"),
    ("10.0.1.40", "Bridge_Sensors", "IoT Sensor", 0.3, 0, "transport"),
    ("10.0.1.41", "EV_Charging_Network", "IoT Network", 0.35, 2, "transport"),
    ("10.0.1.42", "Fire_Dispatch_System", "Public Safety API", 0.9, 3, "public_safety"),
    ("10.0.1.43", "Police_CAD_System", "Public Safety API", 0.88, 3, "public_safety"),
    ("10.0.1.44", "EMS_Dispatch", "Public Safety API", 0.85, 3, "public_safety"),
    ("10.0.1.45", "Siren_Network", "IoT Network", 0.4, 1, "public_safety"),
    ("10.0.1.46", "Hospital_Network", "Health System", 0.8, 4, "health"),
    ("10.0.1.47", "Ambulance_Telemetry", "IoT Sensor", 0.3, 2, "health"),
    ("10.0.1.48", "Health_Registry", "Data Logging Server", 0.55, 4, "health"),
    ("10.0.1.49", "Fiber_Backbone", "Network Infrastructure", 0.8, 2, "telecom"),
    ("10.0.1.50", "Municipal_DNS", "Network Infrastructure", 0.5, 2, "telecom"),
    ("10.0.1.51", "City_Data_Center", "Data Logging Server", 0.9, 4, "telecom"),
    ("10.0.1.52", "Identity_Provider", "Enterprise IT", 0.88, 4, "telecom"),
    ("10.0.1.53", "Backup_Vault", "Data Logging Server", 0.45, 4, "telecom"),
    ("10.0.1.54", "Tax_Collection_System", "Financial Transaction System", 0.65, 4, "finance"),
    ("10.0.1.55", "Payroll_System", "Financial Transaction System", 0.5, 4, "finance"),
    ("10.0.1.56", "Permits_System", "Public Web Service", 0.35, 4, "civic"),
    ("10.0.1.57", "Records_Archive", "Data Logging Server", 0.3, 4, "civic"),
    ("10.0.1.58", "Voting_Infrastructure", "Election System", 0.92, 4, "civic"),
    ("10.0.1.59", "Air_Quality_Sensors", "IoT Sensor", 0.15, 0, "environment"),
    ("10.0.1.60", "Flood_Sensors", "IoT Sensor", 0.2, 0, "environment"),
    ("10.0.1.61", "Waste_Management_System", "ICS Controller", 0.3, 2, "environment"),
    ("10.0.1.62", "Log_Aggregator", "Data Logging Server", 0.4, 2, "monitoring"),
    ("10.0.1.63", "Threat_Intel_Feed", "Data Logging Server", 0.3, 4, "monitoring"),
]

# --- fixed values: watch-listed external addresses ---
EXTERNAL_IPS = ("185.220.101.5", "45.227.254.12", "198.51.100.42")

# --- fixed values: asset types counted as financial ---
FINANCIAL_TYPES = (
    "Financial Transaction System",
    "External Financial Interface",
    "Financial Market System",
    "Social Safety Net",
)

# --- fixed values: dependency edges (src, tgt, edge type, probability, confidence in the edge) ---
EDGES = [
    ("Traffic_Cam_1", "Traffic_Controller", "communicates_with", 0.9, 0.95),
    ("Traffic_Cam_2", "Traffic_Controller", "communicates_with", 0.9, 0.95),
    ("Traffic_Controller", "Power_Substation", "depends_on", 0.95, 0.9),
    ("Traffic_Controller", "Emergency_Route_System", "controls", 0.5, 0.85),
    ("Power_Substation", "City_Grid", "depends_on", 0.95, 0.95),
    ("SCADA_Historian", "Traffic_Controller", "communicates_with", 0.2, 0.8),
    ("SCADA_Historian", "Traffic_Cam_1", "communicates_with", 0.2, 0.8),
    ("SCADA_Historian", "Traffic_Cam_2", "communicates_with", 0.2, 0.8),
    ("Citizen_Portal", "City_Payment_Gateway", "pays_through", 0.9, 0.95),
    ("City_Payment_Gateway", "Bank_Partner_API", "pays_through", 0.95, 0.95),
    ("City_Payment_Gateway", "Social_Welfare_System", "pays_through", 0.85, 0.9),
    ("Municipal_Bond_Platform", "Bank_Partner_API", "communicates_with", 0.7, 0.8),
    ("Traffic_Controller", "City_Payment_Gateway", "communicates_with", 0.5, 0.75),
    ("Power_Substation", "City_Payment_Gateway", "depends_on", 0.4, 0.7),
    ("City_Operations_Center", "Grid_SCADA", "controls", 0.6, 0.85),
    ("City_Operations_Center", "Water_Pump_Station", "controls", 0.55, 0.8),
    ("City_Operations_Center", "Metro_Signalling_System", "controls", 0.6, 0.8),
    ("City_Operations_Center", "Fire_Dispatch_System", "controls", 0.5, 0.75),
    ("City_Operations_Center", "Hospital_Network", "communicates_with", 0.4, 0.7),
    ("City_Operations_Center", "City_Data_Center", "controls", 0.65, 0.85),
    ("City_Operations_Center", "Identity_Provider", "controls", 0.7, 0.85),
    ("City_Operations_Center", "Log_Aggregator", "communicates_with", 0.5, 0.8),
    ("City_Operations_Center", "Waste_Management_System", "controls", 0.3, 0.7),
    ("City_Operations_Center", "Voting_Infrastructure", "controls", 0.3, 0.7),
    ("SCADA_Historian", "City_Operations_Center", "communicates_with", 0.15, 0.8),
    ("Grid_SCADA", "City_Operations_Center", "communicates_with", 0.2, 0.75),
    ("Metro_Signalling_System", "City_Operations_Center", "communicates_with", 0.15, 0.75),
    ("Log_Aggregator", "City_Operations_Center", "communicates_with", 0.2, 0.75),
    ("Solar_Array_West", "Power_Substation_Beta", "depends_on", 0.4, 0.7),
    ("Battery_Storage_Facility", "Power_Substation_Beta", "depends_on", 0.6, 0.8),
    ("Grid_SCADA", "Power_Substation_Beta", "controls", 0.7, 0.85),
    ("Power_Substation_Beta", "City_Grid", "depends_on", 0.9, 0.9),
    ("Water_Quality_Sensors", "Water_Treatment_Plant", "communicates_with", 0.5, 0.85),
    ("Water_Pump_Station", "Water_Treatment_Plant", "depends_on", 0.7, 0.85),
    ("Water_Treatment_Plant", "Wastewater_Facility", "communicates_with", 0.3, 0.7),
    ("Power_Substation", "Water_Treatment_Plant", "depends_on", 0.4, 0.7),
    ("Bridge_Sensors", "Metro_Signalling_System", "communicates_with", 0.3, 0.7),
    ("Traffic_Controller", "Metro_Signalling_System", "controls", 0.3, 0.7),
    ("EV_Charging_Network", "Power_Substation_Beta", "depends_on", 0.45, 0.7),
    ("Siren_Network", "Fire_Dispatch_System", "communicates_with", 0.4, 0.75),
    ("Fire_Dispatch_System", "EMS_Dispatch", "communicates_with", 0.5, 0.8),
    ("Police_CAD_System", "EMS_Dispatch", "communicates_with", 0.45, 0.8),
    ("Emergency_Route_System", "Police_CAD_System", "communicates_with", 0.3, 0.75),
    ("Ambulance_Telemetry", "Hospital_Network", "communicates_with", 0.4, 0.75),
    ("Hospital_Network", "Health_Registry", "communicates_with", 0.5, 0.8),
    ("EMS_Dispatch", "Hospital_Network", "communicates_with", 0.35, 0.75),
    ("Fiber_Backbone", "Municipal_DNS", "depends_on", 0.7, 0.85),
    ("Municipal_DNS", "City_Data_Center", "depends_on", 0.6, 0.8),
    ("City_Data_Center", "Backup_Vault", "depends_on", 0.5, 0.8),
    ("Identity_Provider", "City_Data_Center", "controls", 0.75, 0.85),
    ("Fiber_Backbone", "SCADA_Historian", "communicates_with", 0.2, 0.75),
    ("City_Payment_Gateway", "Tax_Collection_System", "pays_through", 0.5, 0.8),
    ("Bank_Partner_API", "Payroll_System", "pays_through", 0.4, 0.75),
    ("Tax_Collection_System", "Payroll_System", "communicates_with", 0.25, 0.7),
    ("Identity_Provider", "Tax_Collection_System", "controls", 0.5, 0.75),
    ("Citizen_Portal", "Permits_System", "pays_through", 0.5, 0.8),
    ("Permits_System", "Records_Archive", "communicates_with", 0.35, 0.75),
    ("Voting_Infrastructure", "Identity_Provider", "depends_on", 0.5, 0.75),
    ("City_Data_Center", "Voting_Infrastructure", "depends_on", 0.6, 0.8),
    ("Air_Quality_Sensors", "Waste_Management_System", "communicates_with", 0.2, 0.65),
    ("Flood_Sensors", "Waste_Management_System", "communicates_with", 0.25, 0.65),
    ("Log_Aggregator", "SCADA_Historian", "communicates_with", 0.2, 0.75),
    ("Threat_Intel_Feed", "Log_Aggregator", "communicates_with", 0.15, 0.6),
]

# --- fixed values: decoy credentials (zone, credential id, user name, emulated protocol); no secrets kept ---
DECOYS = [
    ("Gateway_L0", "HT-L0-SENSOR", "admin_field_maintenance_l0", "Modbus TCP"),
    ("Gateway_L1", "HT-L1-SCADA", "scada_admin_remote_v2", "OPC-DA"),
    ("Gateway_L2", "HT-L2-OPS", "operations_console_fallback", "OPC-UA"),
    ("Gateway_L3", "HT-L3-SITOPS", "site_shift_supervisor_backup", "HTTPS"),
    ("Gateway_L4", "HT-L4-BIZOPS", "business_operations_readonly_L4", "LDAP"),
    ("Gateway_L5", "HT-L5-EXTERNAL", "external_partner_api_key_reserved", "OAuth2"),
]

# --- fixed values: capture labels (label, evidence, alert level) ---
ATTACK_LABELS = [
    ("BENIGN", None, "INFO"),
    ("DDoS", "DDoS", "CRITICAL"),
    ("DoS slowloris", "DoS", "HIGH"),
    ("DoS Slowhttptest", "DoS", "HIGH"),
    ("DoS Hulk", "DoS", "CRITICAL"),
    ("DoS GoldenEye", "DoS", "HIGH"),
    ("Heartbleed", "Heartbleed", "CRITICAL"),
    ("PortScan", "Reconnaissance", "MEDIUM"),
    ("Infiltration", "Infiltration", "CRITICAL"),
    ("Bot", "Botnet_C2", "HIGH"),
    ("FTP-Patator", "BruteForce_FTP", "MEDIUM"),
    ("SSH-Patator", "BruteForce_SSH", "MEDIUM"),
    ("Web Attack ⰾ Brute Force", "WebAttack_BruteForce", "HIGH"),
    ("Web Attack ⰾ XSS", "WebAttack_XSS", "MEDIUM"),
    ("Web Attack ⰾ Sql Injection", "WebAttack_SQLi", "CRITICAL"),
]

# --- fixed values: service names, and the asset address that answers on a port ---
PORT_SERVICES = {80: "HTTP", 443: "HTTPS", 22: "SSH", 21: "FTP", 25: "SMTP", 53: "DNS", 3306: "MySQL", 3389: "RDP"}
PORT_ASSETS = {
    80: "10.0.1.15",
    443: "10.0.1.15",
    22: "10.0.1.16",
    21: "10.0.1.16",
    3306: "10.0.1.16",
    3389: "10.0.1.12",
    53: "10.0.1.14",
}
DEFAULT_PORT_ASSET = "10.0.1.15"
PORTAL_IP = "10.0.1.15"
ATTACKER_IP = "185.220.101.5"
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}

# --- fixed values: payment types (type, action, service, protocol) ---
PAYMENT_TYPES = [
    ("PAYMENT", "PAYMENT", "PaymentService", "FINANCIAL_PAYMENT"),
    ("TRANSFER", "TRANSFER", "TransferService", "FINANCIAL_TRANSFER"),
    ("CASH_OUT", "CASH_OUT", "CashOutService", "FINANCIAL_CASH_OUT"),
    ("DEBIT", "DEBIT", "DebitService", "FINANCIAL_DEBIT"),
    ("CASH_IN", "CASH_IN", "CashInService", "FINANCIAL_CASH_IN"),
]
HIGH_RISK_PAYMENTS = ("TRANSFER", "CASH_OUT")

# --- fixed values: port classes used by the signature rules ---
ADMIN_PORTS = (21, 23, 135, 139, 445, 3389)
DATABASE_PORTS = (1433, 1521, 3306, 5432, 5984, 6379, 9200, 11211, 27017)

# --- fixed values: IPv4 blocks that never count as external ---
RESERVED_PATTERN = (
    r"^((0|10|127)\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.(?!(9|10)$)|192\.0\.2\.|192\.168\."
    r"|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[45][0-9]\.)"
)

# --- fixed values: replay scenarios (name, label, whether the decoy flag is set) ---
SCENARIOS = {
    "bot_c2": ("Bot", False),
    "ddos": ("DDoS", False),
    "port_scan": ("PortScan", False),
    "honeytoken": ("Bot", True),
}

HUB_ASSET = "City_Operations_Center"
CORE_SECTOR = "core"


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value)


def values_sql(rows, columns) -> str:
    """A ``SELECT`` over an inline table; the text is valid in Spark and in ANSI engines."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def inline_table(spark: SparkSession, rows, columns) -> DataFrame:
    return spark.sql(values_sql(rows, columns))


ASSET_COLUMNS = ("ip", "name", "type", "criticality", "purdue_level", "sector")
REGISTRY_COLUMNS = ("identifier", "name", "criticality", "position")
EDGE_COLUMNS = ("position", "src", "tgt", "edge_type", "prob", "confidence")


def registry_rows():
    """Identifier registrations in registration order; the order breaks distance ties."""
    rows = [(ip, name, crit) for ip, name, _, crit, _, _ in ASSETS]
    rows += [(ip, f"External_{ip}", 0.0) for ip in EXTERNAL_IPS]
    rows += [("__customer__", "City_Payment_Gateway", 0.95), ("__merchant__", "Bank_Partner_API", 0.85)]
    return [(*row, i) for i, row in enumerate(rows)]


def assets(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ASSETS, ASSET_COLUMNS)


def registry(spark: SparkSession) -> DataFrame:
    return inline_table(spark, registry_rows(), REGISTRY_COLUMNS)


def edges(spark: SparkSession) -> DataFrame:
    return inline_table(spark, [(i, *e) for i, e in enumerate(EDGES)], EDGE_COLUMNS)


def decoys(spark: SparkSession) -> DataFrame:
    return inline_table(spark, DECOYS, ("gateway_zone", "credential_id", "username", "emulated_protocol"))
