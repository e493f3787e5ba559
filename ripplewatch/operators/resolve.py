"""Identifier to asset resolution and the registry views."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch.functions import net
from ripplewatch.functions.lookup import ladder
from ripplewatch.functions.partitions import (
    BROADCAST_ROWS,
    MAX_ROWS_PER_TASK,
    broadcast_if_small,
    cut_by_key,
    cut_lineage,
    join_null_safe,
)

NEAREST = 5
_HOST = r"^10\.0\.1\.(\d+)$"


def _host(identifier: Column) -> Column:
    # The empty text of other identifiers is not cast: a failed cast throws inside, which costs more than all the rest.
    digits = F.regexp_extract(identifier, _HOST, 1)
    return F.when(digits != "", digits.try_cast("int"))


def nearest_hosts(registry: DataFrame, reach: int = NEAREST) -> DataFrame:
    """host number -> nearest registered asset within ``reach``, ties to the earliest registration.

    Written as an equality join table: every registered host is listed under the 2*reach+1 numbers it can
    answer for, and the best one per number is kept.
    """
    known = registry.withColumn("_own", _host(F.col("identifier"))).filter(F.col("_own").isNotNull())
    spread = known.select(
        "name", "criticality", "position", "_own", F.explode(F.sequence(F.col("_own") - reach, F.col("_own") + reach)).alias("host")
    ).withColumn("distance", F.abs(F.col("host") - F.col("_own")))
    best = spread.groupBy("host").agg(F.min(F.struct("distance", "position", "name", "criticality")).alias("b"))
    return best.select(
        "host",
        F.col("b.name").alias("near_name"),
        F.col("b.criticality").alias("near_criticality"),
        F.col("b.distance").alias("distance"),
    )


def _is_small(registry: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return registry.limit(max_rows + 1).count() <= max_rows


def _lookup(df: DataFrame, column: str, registry: DataFrame, prefix: str, small: bool) -> DataFrame:
    """Add ``<prefix>_asset, _criticality, _confidence, _is_known`` for the identifier in ``column``.

    Priority: exact registration, account prefix, nearest host, generated ``Unresolved_*`` name. ``small`` says
    the registry was counted and may be broadcast (the nearest-host table has at most 11 rows per registration).
    """
    hint = F.broadcast if small else (lambda table: table)
    if small:
        registry = registry.coalesce(1)  # aggregate the few rows below without a shuffle
    exact = registry.groupBy("identifier").agg(F.max_by(F.struct("name", "criticality"), "position").alias("r"))
    exact = exact.select(F.col("identifier").alias("_id"), F.col("r").alias("_exact"))
    # Two rows at most.
    accounts = exact.filter(F.col("_id").isin("__customer__", "__merchant__")).select(
        F.col("_id").alias("_account"), F.col("_exact").alias("_by_account")
    )
    near = nearest_hosts(registry).select(
        F.col("host").alias("_host"),
        F.struct(F.col("near_name").alias("name"), F.col("near_criticality").alias("criticality")).alias("_near"),
        F.col("distance").alias("_distance"),
    )
    text = F.trim(F.col(column))
    account = F.when(text.rlike(r"^C\d+$"), "__customer__").when(text.rlike(r"^M\d+$"), "__merchant__")
    rows = (
        df.withColumns({"_id": text, "_account": account, "_host": _host(text)})
        .join(hint(exact), "_id", "left")
        .join(F.broadcast(accounts), "_account", "left")
        .join(hint(near), "_host", "left")
    )
    found = F.coalesce("_exact", "_by_account", "_near")
    known = F.col("_exact").isNotNull() | F.col("_by_account").isNotNull()
    return rows.withColumns(
        {
            f"{prefix}_asset": F.coalesce(found["name"], F.concat(F.lit("Unresolved_"), net.sanitise(F.col("_id")))),
            f"{prefix}_criticality": F.coalesce(found["criticality"], F.lit(0.1)),
            f"{prefix}_confidence": ladder(
                (F.col("_exact").isNotNull(), F.lit(1.0)),
                (F.col("_by_account").isNotNull(), F.lit(0.85)),
                (F.col("_near").isNotNull(), F.greatest(F.lit(0.4), 1.0 - F.col("_distance") * 0.12)),
                default=F.lit(0.3),
            ),
            f"{prefix}_is_known": known,
        }
    ).drop("_id", "_account", "_host", "_exact", "_by_account", "_near", "_distance")


def resolve_identifiers(identifiers: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per identifier: asset, criticality, confidence, is_known. Needs a column ``identifier``."""
    out = _lookup(identifiers.select("identifier"), "identifier", registry, "_r", _is_small(registry))
    return out.select(
        "identifier",
        *[F.col(f"_r_{c}").alias(c) for c in ("asset", "criticality", "confidence", "is_known")],
    )


def resolve_assets(
    flows: DataFrame,
    registry: DataFrame,
    *,
    source: str = "source_ip",
    destination: str = "destination_ip",
    max_registry: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add source/destination asset and criticality, and the mean resolution confidence. Never drops rows.

    With a registry small enough to broadcast, the flows are resolved in place and are not shuffled. A larger
    one is resolved on the distinct identifiers, which are then joined back.
    """
    if _is_small(registry, max_registry):
        out = flows
        for column, prefix in ((source, "source"), (destination, "destination")):
            out = _lookup(out, column, registry, prefix, True)
    else:
        ids = flows.select(F.col(source).alias("identifier")).union(flows.select(F.col(destination))).distinct()
        table = cut_lineage(resolve_identifiers(ids, registry))
        out = flows
        for column, prefix in ((source, "source"), (destination, "destination")):
            side = table.select(
                F.col("identifier").alias(column),
                *[F.col(c).alias(f"{prefix}_{c}") for c in ("asset", "criticality", "confidence", "is_known")],
            )
            out = out.join(broadcast_if_small(side), column, "left")
    mean = (F.col("source_confidence") + F.col("destination_confidence")) / 2
    return out.withColumn("resolution_confidence", mean).drop(
        "source_confidence", "destination_confidence", "source_is_known", "destination_is_known"
    )


def display_names(df: DataFrame, assets: DataFrame, *, ip: str, name: str) -> DataFrame:
    """Left join of an address to its display name, the address itself when unknown."""
    names = broadcast_if_small(assets.select(F.col("ip").alias(ip), F.col("name").alias(name)).filter(F.col(ip).isNotNull()))
    return df.join(names, ip, "left").withColumn(name, F.coalesce(name, ip))


def criticality_map(registry: DataFrame, discovered: DataFrame) -> DataFrame:
    """Registered names plus discovered assets, registered values winning.

    ``discovered`` has ``asset, criticality, is_known`` as produced by ``resolve_identifiers``.
    """
    known = registry.groupBy("name").agg(F.max_by("criticality", "position").alias("criticality")).select(
        F.col("name").alias("asset"), "criticality", F.lit(True).alias("is_registered")
    )
    found = (
        discovered.filter(~F.col("is_known") & F.col("asset").startswith("Unresolved_"))
        .select("asset", "criticality")
        .distinct()
        .withColumn("is_registered", F.lit(False))
    )
    return known.unionByName(found)


def protected_assets(assets: DataFrame, *, threshold: float) -> DataFrame:
    """Assets at or above the protection threshold with the gateway that guards them."""
    return assets.filter(F.col("criticality") >= threshold).select(
        F.col("name").alias("asset"), "criticality", net.gateway_name(F.col("purdue_level")).alias("gateway")
    )


def first_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first in ``order``; a map-side combined aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def in_effect(
    left: DataFrame, snapshots: DataFrame, *, key: str, ts: str, tie: str, columns,
    max_age_sec: float | None = None, ordered_ties: bool = False, max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """As-of join: for each left row the last snapshot of its key with snapshot time <= row time.

    Union, order, and carry forward the last snapshot. Keys too hot for one task, and only those, are cut along
    time, with the last snapshot of each earlier slice carried into the next. ``max_age_sec`` drops older snapshots. With
    ``ordered_ties`` a snapshot at the row's own timestamp counts only if its tie value is not larger.
    """
    packed = F.struct(F.col(ts).alias("snapshot_ts"), *columns)
    left_cols = [c for c in left.columns if c != key]
    a = left.select(
        key, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.col(tie).cast("bigint").alias("_tie"), F.struct(*left_cols).alias("_row")
    )
    b = snapshots.select(
        key, F.col(ts).alias("_ts"), F.lit(0).alias("_side"),
        (F.col(tie).cast("bigint") if ordered_ties else F.lit(None).cast("bigint")).alias("_tie"), packed.alias("_snap"),
    )
    sequence = ["_ts", "_tie", "_side"] if ordered_ties else ["_ts", "_side", "_tie"]
    both = a.unionByName(b, allowMissingColumns=True)
    rest, cut = cut_by_key(both, [key], sequence, max_rows)
    order = Window.partitionBy(key, "_slice").orderBy(*sequence)

    def carried_forward(part: DataFrame) -> DataFrame:
        return part.withColumn("_found", F.last("_snap", ignorenulls=True).over(order)).filter(F.col("_side") == 1)

    out = carried_forward(rest)
    if cut is not None:
        place = F.when(F.col("_snap").isNotNull(), F.struct(*sequence))
        ends = cut.groupBy(key, "_slice").agg(F.max_by("_snap", place).alias("_end"))
        earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(key, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
        carried = carried.filter(F.col("_carry").isNotNull())
        heavy = join_null_safe(carried_forward(cut), carried, [key, "_slice"], "left")
        out = out.unionByName(heavy.withColumn("_found", F.coalesce("_found", "_carry")).drop("_carry"))
    if max_age_sec is not None:
        age = F.timestamp_diff("MICROSECOND", F.col("_found.snapshot_ts"), F.col("_ts")) / 1e6
        out = out.withColumn("_found", F.when(age < max_age_sec, F.col("_found")))
    return out.select(key, "_row.*", "_found.*")

