"""Greedy acceptance per key: a row is accepted unless an earlier accepted row still covers it.

One rule serves debouncing, snapshot reuse and prevention state. Rows carry a level, and an accepted row of level
``l`` covers its key for ``ttl[l]`` seconds; a covered row is accepted only if its level is higher. Which rows are
accepted depends on all earlier ones, so this is not a window function. It is, however, a chain: from any accepted
row the next accepted one is known without looking back. That makes it possible to cut a hot key along time:

1. per (key, cell): as a function of the state at entry, find the state at exit. For an entry level that is a step
   function of the moment at which the entry's cover ends, and since chains run together, it has few steps;
2. such functions compose, and composing is associative: the functions of neighbouring cells become one, ``FAN_IN``
   at a time, until a key is left with one short list;
3. back down that tree, every list hands each of its members the state at its entry;
4. per (key, cell): with the state at entry known, list the accepted rows.

No task sees more than a cell or ``FAN_IN`` functions of a key. A function has no more steps than its first cell has
rows within the longest cover, an eighth of a cell or less. Only hot keys go this way; others are walked in one group.

Rows sharing key, timestamp and level collapse to the first of them beforehand, since the rest are always covered.
"""

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.functions.lookup import epoch_micros
from ripplewatch.functions.partitions import apart, cut_lineage, hot_keys, join_null_safe

MAX_GROUP = 1_000_000
FAN_IN = 64
_NEVER = np.iinfo(np.int64).min


def _next_accepted(us: np.ndarray, level: np.ndarray, ttl: Mapping[int, int]) -> np.ndarray:
    """Index of the row accepted after row i (len(us) when none); rows are in order."""
    n = len(us)
    cover = np.array([ttl[int(v)] for v in level], dtype=np.int64) if n else np.zeros(0, dtype=np.int64)
    by_time = np.searchsorted(us, us + cover, side="left")
    out = np.maximum(by_time, np.arange(n) + 1)
    for value in np.unique(level):
        mine = np.flatnonzero(level == value)
        higher = np.append(np.flatnonzero(level > value), n)
        out[mine] = np.minimum(out[mine], higher[np.searchsorted(higher, mine, side="right").clip(max=len(higher) - 1)])
    return out


def _first_accepted(us, level, state, ttl) -> int:
    """Index of the first row accepted given ``state`` = (us, level) of the last accepted row, or None."""
    if state is None:
        return 0
    last_us, last_level = state
    open_ = np.flatnonzero((us >= last_us + ttl[int(last_level)]) | (level > last_level))
    return int(open_[0]) if len(open_) else len(us)


def _walk(us, level, start: int, ttl) -> np.ndarray:
    step = _next_accepted(us, level, ttl)
    picked, at = [], start
    while at < len(us):
        picked.append(at)
        at = int(step[at])
    return np.array(picked, dtype=int)


def _last_reached(step: np.ndarray) -> np.ndarray:
    """For every row the last row its chain reaches, by pointer doubling."""
    n = len(step)
    last, jump = np.arange(n), step.copy()
    while True:
        moving = jump < n
        if not moving.any():
            return last
        last[moving] = last[jump[moving]]
        jump[moving] = jump[jump[moving]]


def accepted_rows(
    df: DataFrame,
    key: str,
    *,
    ttl_sec: Mapping[int, float],
    level: str | None = None,
    ts: str = "ts",
    tie: str = "event_id",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """(key, ts, tie, level) of the accepted rows. ``level`` holds small positive integers, 1 when omitted."""
    ttl = {int(k): int(v * 1_000_000) for k, v in ttl_sec.items()}
    rank = F.col(level).cast("int") if level else F.lit(1)
    rows = df.select(
        F.col(key), F.col(ts), epoch_micros(F.col(ts)).alias("_us"), F.col(tie).alias("_tie"), rank.alias("_level")
    )
    # Read at least twice below; a few narrow columns, so cheaper to store than to derive again.
    rows = cut_lineage(rows.groupBy(key, ts, "_us", "_level").agg(F.min("_tie").alias("_tie")))
    order = ["_us", "_tie"]

    def take(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        return g.iloc[_walk(g["_us"].to_numpy(), g["_level"].to_numpy(), 0, ttl)]

    hot = hot_keys(rows, [key], max_group)
    if hot is None:
        kept = rows.groupBy(key).applyInPandas(take, rows.schema)
    else:
        rest, heavy = apart(rows, [key], hot)
        largest = hot.agg(F.max("_rows")).first()[0]
        kept = rest.groupBy(key).applyInPandas(take, rows.schema).unionByName(
            _by_cells(heavy, key, ttl, largest, max_group, order)
        )
    return kept.select(key, ts, F.col("_tie").alias(tie), F.col("_level").alias("level"))


class Steps:
    """State at exit as a function of the state at entry, a step function for each entry level.

    A state is (level, us) of the last accepted row, level 0 before any. From entry level ``l`` and cover end ``e`` the
    last step whose ``_since`` is at most ``e`` decides; a step of level 0 leaves the state as it is.
    """

    def __init__(self, steps: Mapping[int, tuple[np.ndarray, np.ndarray, np.ndarray]], ttl: Mapping[int, int]):
        self.steps, self.ttl = steps, ttl

    @staticmethod
    def of_rows(us: np.ndarray, level: np.ndarray, upto: int, ttl: Mapping[int, int]) -> "Steps":
        """Of rows in order, for covers that end at or before ``upto``."""
        n, last = len(us), _last_reached(_next_accepted(us, level, ttl))
        # Cover ends after the i-th row's time open row i + 1; row n stands for none.
        near = int(np.searchsorted(us, upto, side="left"))
        since = np.append(_NEVER, us[:near] + 1)
        steps = {0: (since[:1], us[last[:1]], level[last[:1]])}
        for entry in ttl:
            higher = np.flatnonzero(level > entry)
            first = np.minimum(np.arange(near + 1), higher[0] if len(higher) else n)
            exit_ = last[np.minimum(first, n - 1)]
            steps[entry] = _merged(since, us[exit_], np.where(first < n, level[exit_], 0))
        return Steps(steps, ttl)

    @staticmethod
    def of_frame(part: pd.DataFrame, ttl: Mapping[int, int]) -> "Steps":
        steps = {
            int(entry): tuple(g[c].to_numpy() for c in ("_since", "_exit_us", "_exit_level"))
            for entry, g in part.sort_values("_since").groupby("_entry")
        }
        return Steps(steps, ttl)

    def frame(self) -> pd.DataFrame:
        return pd.concat(
            pd.DataFrame({"_entry": entry, "_since": a, "_exit_us": b, "_exit_level": c}) for entry, (a, b, c) in self.steps.items()
        )

    def exits(self, level: int, us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(us, level) at exit for entries of one level."""
        since, exit_us, exit_level = self.steps[level]
        at = np.searchsorted(since, us + self.ttl[level], side="right") - 1 if level else np.zeros(len(us), dtype=int)
        moved = exit_level[at] > 0
        return np.where(moved, exit_us[at], us), np.where(moved, exit_level[at], level)

    def then(self, other: "Steps") -> "Steps":
        """This function, then ``other``."""
        out = {}
        for entry, (since, us, level) in self.steps.items():
            ends = np.append(since[1:], np.iinfo(np.int64).max)
            pieces = []
            for middle in np.unique(level):
                mine = np.flatnonzero(level == middle)
                if middle:
                    pieces.append((since[mine], *other.exits(int(middle), us[mine])))
                    continue
                # Unmoved so far: the other's own steps, where they fall into this one.
                theirs, their_us, their_level = other.steps[entry]
                for i in mine:
                    low = int(np.searchsorted(theirs, since[i], side="right")) - 1
                    high = int(np.searchsorted(theirs, ends[i], side="left"))
                    starts = np.maximum(theirs[low:high], since[i])
                    pieces.append((starts, their_us[low:high], their_level[low:high]))
            a, b, c = (np.concatenate(x) for x in zip(*pieces))
            by = np.argsort(a, kind="stable")
            out[entry] = _merged(a[by], b[by], c[by])
        return Steps(out, self.ttl)


def _merged(since, us, level):
    """Steps without empty ones (the last of equal starts decides) and without repeats of the step before."""
    keep = np.append(since[1:] != since[:-1], True)
    since, us, level = since[keep], np.where(level > 0, us, 0)[keep], level[keep]
    new = np.append(True, (us[1:] != us[:-1]) | (level[1:] != level[:-1]))
    return since[new], us[new], level[new]


def _by_cells(rows: DataFrame, key: str, ttl, largest: int, max_group: int, order) -> DataFrame:
    reach = max(ttl.values())
    low, high = rows.agg(F.min("_us"), F.max("_us")).first()
    # Long enough that a function is small beside its cell, short enough that a cell of the hottest key fits a task.
    width = int(max(8 * reach, (high - low) // max(1, 4 * largest // max_group), 1))
    cells = rows.withColumn("_cell", F.floor((F.col("_us") - low) / width))
    key_type = rows.schema[key].dataType.simpleString()
    function = f"`{key}` {key_type}, _cell bigint, _entry int, _since bigint, _exit_us bigint, _exit_level int"

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        # Whatever is accepted before the cell stops covering within its first ``reach``.
        upto = low + int(g["_cell"].iloc[0]) * width + reach
        out = Steps.of_rows(g["_us"].to_numpy(), g["_level"].to_numpy(), upto, ttl).frame()
        return out.assign(**{key: g[key].iloc[0], "_cell": g["_cell"].iloc[0]})

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        members = [Steps.of_frame(part, ttl) for _, part in group.groupby("_cell", sort=True)]
        whole = members[0]
        for step in members[1:]:
            whole = whole.then(step)
        return whole.frame().assign(**{key: group[key].iloc[0], "_cell": group["_parent"].iloc[0]})

    def hand_down(group: pd.DataFrame) -> pd.DataFrame:
        us, level = group["_from_us"].to_numpy()[:1], int(group["_from_level"].iloc[0])
        out = []
        for cell, part in group.groupby("_cell", sort=True):
            out.append((group[key].iloc[0], cell, us[0], level))
            us, after = Steps.of_frame(part, ttl).exits(level, us)
            level = int(after[0])
        return pd.DataFrame(out, columns=[key, "_cell", "_from_us", "_from_level"])

    parent = F.floor(F.col("_cell") / FAN_IN)
    levels = [cut_lineage(cells.groupBy(key, "_cell").applyInPandas(summarise, function))]
    count = (high - low) // width + 1
    while count > FAN_IN:
        up = levels[-1].withColumn("_parent", parent).groupBy(key, "_parent").applyInPandas(compose, function)
        levels.append(cut_lineage(up))
        count = -(-count // FAN_IN)
    at_entry = None
    state = f"`{key}` {key_type}, _cell bigint, _from_us bigint, _from_level int"
    for members in reversed(levels):
        members = members.withColumn("_parent", parent)
        if at_entry is None:
            placed = members.withColumns({"_from_us": F.lit(0).cast("bigint"), "_from_level": F.lit(0)})
        else:
            placed = join_null_safe(members, at_entry.withColumnRenamed("_cell", "_parent"), [key, "_parent"])
        at_entry = placed.groupBy(key, "_parent").applyInPandas(hand_down, state)
    target = rows.schema

    def take(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        us, lvl = g["_us"].to_numpy(), g["_level"].to_numpy()
        level = int(g["_from_level"].iloc[0])
        entry = (int(g["_from_us"].iloc[0]), level) if level else None
        return g.iloc[_walk(us, lvl, _first_accepted(us, lvl, entry, ttl), ttl)][[f.name for f in target]]

    return join_null_safe(cells, at_entry, [key, "_cell"]).groupBy(key, "_cell").applyInPandas(take, target)


def debounce(
    df: DataFrame, key: str, *, gap_sec: float, ts: str = "ts", tie: str = "event_id", max_group: int = MAX_GROUP
) -> DataFrame:
    """Rows at least ``gap_sec`` after the key's last accepted row, with all their columns."""
    kept = accepted_rows(df, key, ttl_sec={1: gap_sec}, ts=ts, tie=tie, max_group=max_group)
    return df.join(kept.select(key, ts, tie), [key, ts, tie], "left_semi")
