"""Address, port and identifier expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch.functions.lookup import map_lookup

_QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
# Four octets of 0..255 without leading zeros
_IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def is_external(ip: Column) -> Column:
    """True for a well-formed IPv4 address outside every private or reserved block."""
    return F.coalesce(ip.rlike(_IPV4) & ~ip.rlike(inv.RESERVED_PATTERN), F.lit(False))


def subnet24(ip: Column) -> Column:
    """``a.b.c.0/24`` of a dotted quad, null for anything else."""
    prefix = F.regexp_extract(ip, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", 1)
    return F.when(ip.rlike(_QUAD), F.concat(prefix, F.lit(".0/24")))


def port_service(port: Column) -> Column:
    return F.coalesce(map_lookup(inv.PORT_SERVICES, port.cast("int")), F.concat(F.lit("PORT_"), port.cast("string")))


def protocol_name(number: Column) -> Column:
    return F.coalesce(
        map_lookup(inv.IP_PROTOCOLS, number.cast("int")), F.concat(F.lit("PROTO_"), number.cast("string"))
    )


def port_asset_ip(port: Column) -> Column:
    return F.coalesce(map_lookup(inv.PORT_ASSETS, port.cast("int")), F.lit(inv.DEFAULT_PORT_ASSET))


def sanitise(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "[^A-Za-z0-9_]", "_")


def gateway_name(level: Column) -> Column:
    return F.concat(F.lit("Gateway_L"), F.coalesce(level.cast("string"), F.lit("unclassified")))


def is_gateway(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^Gateway_L(\d+|unclassified)$"), F.lit(False))


def gateway_level(name: Column) -> Column:
    return F.regexp_extract(name, r"^Gateway_L(\d+)$", 1).try_cast("int")


def display_identity(asset: Column, ip: Column) -> Column:
    return F.when(asset.startswith("Unresolved_"), ip).otherwise(asset)
