"""Declarative signature rules over flow metadata."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplewatch import inventory as inv
from ripplewatch import settings as S
from ripplewatch.functions import net
from ripplewatch.functions.lookup import any_of, computed


@dataclass(frozen=True)
class Rule:
    """One rule; ``predicate`` is any boolean Column, including a pandas UDF applied to flow columns."""

    rule_id: str
    title: str
    confidence: float
    predicate: Column

    def __post_init__(self):
        if not self.rule_id:
            raise ValueError("rule_id must not be empty")
        if not 0.0 <= self.confidence <= 1.0:
            raise ValueError(f"{self.rule_id}: confidence {self.confidence!r} is outside [0, 1]")


def default_rules(*, small_payload: int = S.SMALL_PAYLOAD_BYTES, watch_list=inv.EXTERNAL_IPS) -> list[Rule]:
    src, dst = F.col("source_ip"), F.col("destination_ip")
    high = S.WELL_KNOWN_PORT_LIMIT
    outbound_small = (
        (F.col("bytes") <= small_payload)
        & (F.col("destination_port") >= high)
        & (F.col("source_port") >= high)
        & net.is_external(dst)
    )
    return [
        Rule("SIG-001", "Listed hostile address", 0.90, src.isin(*watch_list) | dst.isin(*watch_list)),
        Rule("SIG-002", "Few bytes between high ports, outward", 0.50, outbound_small),
        Rule("SIG-004", "Port of a remote administration service", 0.40,
             F.col("destination_port").isin(*inv.ADMIN_PORTS)),
        Rule("SIG-005", "Database port reached from outside", 0.65,
             net.is_external(src) & F.col("destination_port").isin(*inv.DATABASE_PORTS)),
    ]


def signature_verdicts(flows: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add ``matched_rules``, ``signature_score`` (strongest match), ``signature_raw`` and ``signature_fired``."""
    rules = default_rules() if rules is None else rules
    # Every predicate is evaluated once; without higher-order functions all that follows stays inside generated code.
    names = [f"_hit_{i}" for i in range(len(rules))]
    hits = [F.col(name) for name in names]
    if rules:
        flows = computed(flows, **{name: F.coalesce(r.predicate, F.lit(False)) for name, r in zip(names, rules)})
    none = F.array().cast("array<struct<rule_id:string,title:string,confidence:double>>")
    matched = F.concat(none, *[
        F.when(h, F.array(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("title"),
                                   F.lit(r.confidence).alias("confidence")))).otherwise(none)
        for h, r in zip(hits, rules)
    ])
    scores = [F.when(h, r.confidence).otherwise(0.0) for h, r in zip(hits, rules)]
    count = reduce(lambda a, b: a + b, [h.cast("int") for h in hits], F.lit(0))
    return computed(
        flows,
        matched_rules=matched,
        signature_fired=any_of(hits) if hits else F.lit(False),
        signature_score=F.greatest(*scores, F.lit(0.0)) if scores else F.lit(0.0),
        signature_raw=count.cast("double"),
    ).drop(*names)
