"""Views over the driver tables that the registered queries start from.

``FLOW_COLUMNS`` is shared text: the same expressions build the Spark DataFrame and the SQL used for checking.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplewatch import inventory as inv

PORTS = (80, 443, 22, 21, 3389, 3306, 53, 8080, 6379, 49152)
LABELS = ("Bot", "DDoS", "PortScan", "DoS Hulk", "FTP-Patator", "web attack - sql injection", "Web Attack - XSS", "Odd")


def _pick(values, position: str, dialect: str) -> str:
    items = ", ".join(inv.sql_literal(v) for v in values)
    if dialect == "spark":
        return f"element_at(array({items}), CAST(1 + ({position}) AS INT))"
    return f"([{items}])[1 + ({position})]"


def flow_columns(dialect: str) -> list[str]:
    return [
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "k",
        "concat('10.0.1.', 10 + user_id % 60) AS source_ip",
        "CASE WHEN k < 2 THEN '185.220.101.5' WHEN k < 6 THEN concat('203.0.113.', k)"
        " WHEN k < 30 THEN concat('8.8.', k, '.', user_id % 7) ELSE concat('10.0.1.', 10 + k % 54) END"
        " AS destination_ip",
        "1024 + event_id % 60000 AS source_port",
        _pick(PORTS, "k % 10", dialect) + " AS destination_port",
        "CASE WHEN k % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol",
        "CAST(floor(value * 10) AS BIGINT) AS bytes",
        "1 + k AS packets",
        "value / 10 AS duration_sec",
        "value / (1 + k) AS bwd_packet_length_mean",
        "(event_id * 37) % 65536 AS init_win_bytes_forward",
        "(event_id * 61) % 65536 AS init_win_bytes_backward",
        "value * 10 / (1 + k) AS average_packet_size",
        "CASE WHEN event_type = 'error' THEN " + _pick(LABELS, "k % 8", dialect) + " ELSE 'BENIGN' END AS label",
        "event_type = 'error' AS is_attack",
        "event_type = 'error' AND k = 7 AS is_honeytoken_use",
        # Stand-ins for the two scored channels, so that roll-ups can be checked exactly.
        "value > 150 AS is_anomaly",
        "value / (value + 50) AS volumetric_score",
        "CASE WHEN event_type = 'error' THEN 0.5 + k / 200.0 ELSE k / 400.0 END AS supervised_score",
    ]


_K = {
    "spark": "CAST(get_json_object(props, '$.k') AS INT)",
    "duckdb": "CAST(json_extract(props, '$.k') AS INT)",
}


def flows_sql() -> str:
    columns = ", ".join(flow_columns("duckdb"))
    return f"SELECT {columns} FROM (SELECT *, {_K['duckdb']} AS k FROM events)"


@dataclass
class Tables:
    """Lazily opened driver tables and the views derived from them."""

    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def flows(self) -> DataFrame:
        with_k = self.events.withColumn("k", F.expr(_K["spark"]))
        flows = with_k.selectExpr(*flow_columns("spark"))
        # Spark reads 0.5 and 200.0 as decimals; the channel is a double.
        return flows.withColumn("supervised_score", F.col("supervised_score").cast("double"))

    @cached_property
    def assets(self) -> DataFrame:
        return inv.assets(self.spark)

    @cached_property
    def registry(self) -> DataFrame:
        return inv.registry(self.spark)

    @cached_property
    def resolved(self) -> DataFrame:
        from ripplewatch.operators.resolve import resolve_assets

        return resolve_assets(self.flows, self.registry)
