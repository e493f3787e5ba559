"""Per-key streaming state: beacon history, alert debounce, prevention with expiry.

State for a key is a few numbers, so it stays small however many rows the key has. Rows of a key are handled in
(ts, event id) order within a micro-batch; rows later than the watermark are dropped.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ripplewatch import settings as S
from ripplewatch.functions.lookup import epoch_micros

WATERMARK = "10 minutes"
_LEVELS = {"alert": 1, "rate_limit": 2, "block": 3, "quarantine": 4}


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(["us", "event_id"], kind="stable").reset_index(drop=True)


def _wake(state: GroupState, us: int) -> None:
    """Set the key's timer: when the watermark is past ``us``."""
    state.setTimeoutTimestamp(max(us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def beacon_stream(
    flows: DataFrame,
    *,
    watermark: str = WATERMARK,
    min_samples: int = S.BEACON_MIN_SAMPLES,
    history: int = S.BEACON_HISTORY,
    max_cv: float = S.BEACON_MAX_CV,
    min_interval_sec: float = S.BEACON_MIN_INTERVAL,
    max_interval_sec: float = S.BEACON_MAX_INTERVAL,
    idle_sec: float | None = None,
) -> DataFrame:
    """Beaconing verdict per flow, from the pair's last ``history`` arrivals kept in state.

    With ``idle_sec`` a timer drops a pair that stays silent for that long in event time, and its history begins anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(frames)
        kept = list(state.get[0]) if state.exists else []
        arrivals = np.array(kept + rows["us"].tolist(), dtype=np.int64)
        gaps = np.abs(np.diff(arrivals)) / 1e6
        usable = np.where((gaps >= min_interval_sec) & (gaps <= max_interval_sec), gaps, np.nan)
        counts, variation = [], []
        for i in range(len(kept), len(arrivals)):
            frame = usable[max(0, i - history + 1) : i]
            frame = frame[~np.isnan(frame)]
            counts.append(len(frame))
            enough = len(frame) >= min_samples - 1 and frame.mean() > 0
            variation.append(float(frame.std(ddof=1) / frame.mean()) if enough else None)
        state.update((arrivals[-history:].tolist(),))
        if idle_sec is not None:
            _wake(state, int(arrivals.max()) + int(idle_sec * 1_000_000))
        cv = pd.Series(variation, dtype="float64")
        yield pd.DataFrame(
            {
                "event_id": rows["event_id"],
                "source_ip": key[0],
                "destination_ip": key[1],
                "usable_intervals": counts,
                "beacon_cv": cv,
                "beacon_fired": (cv <= max_cv).fillna(False),
                "beacon_score": (1.0 - cv / max_cv).clip(0.0, 1.0).fillna(0.0),
            }
        )

    keyed = flows.withWatermark("ts", watermark).select(
        "ts", "event_id", "source_ip", "destination_ip", epoch_micros(F.col("ts")).alias("us")
    )
    return keyed.groupBy("source_ip", "destination_ip").applyInPandasWithState(
        step,
        "event_id bigint, source_ip string, destination_ip string, usable_intervals bigint, beacon_cv double, "
        "beacon_fired boolean, beacon_score double",
        "arrivals array<bigint>",
        "append",
        GroupStateTimeout.NoTimeout if idle_sec is None else GroupStateTimeout.EventTimeTimeout,
    )


def debounce_stream(
    candidates: DataFrame, key: str, *, gap_sec: float, watermark: str = WATERMARK
) -> DataFrame:
    """Candidate rows that are at least ``gap_sec`` after the key's last accepted one.

    A key leaves the state once the watermark has passed the end of its gap: whatever comes then is accepted anyway.
    """
    gap = int(gap_sec * 1_000_000)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(frames)
        last = state.get[0] if state.exists else None
        times, picked, at = rows["us"].to_numpy(), [], 0
        while True:
            at = at if last is None else max(at, int(np.searchsorted(times, last + gap, side="left")))
            if at >= len(times):
                break
            picked.append(at)
            last = int(times[at])
            at += 1
        if last is not None:
            state.update((last,))
            _wake(state, last + gap)
        if picked:
            yield pd.DataFrame({key: group[0], "event_id": rows["event_id"].iloc[picked]})

    keyed = candidates.withWatermark("ts", watermark).select(
        "ts", key, "event_id", epoch_micros(F.col("ts")).alias("us")
    )
    return keyed.groupBy(key).applyInPandasWithState(
        step, f"`{key}` string, event_id bigint", "last_us bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def prevention_stream(
    decisions: DataFrame,
    *,
    asset: str = "source_asset",
    watermark: str = WATERMARK,
    ttl: tuple[int, int, int] = (S.TTL_RATE_LIMIT, S.TTL_BLOCK, S.TTL_QUARANTINE),
) -> DataFrame:
    """Prevention decisions against the asset's active action: written, suppressed, superseded or expired rows.

    An event-time timer expires an action even when its asset stays silent.
    """
    life = {2: ttl[0] * 1_000_000, 3: ttl[1] * 1_000_000, 4: ttl[2] * 1_000_000}

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, ends, action = state.get if state.exists else (0, 0, None)
        out = []
        if state.hasTimedOut:
            out.append((action, "expired", ends))
            state.remove()
        else:
            for row in _ordered(frames).itertuples():
                if level and ends <= row.us:
                    out.append((action, "expired", ends))
                    level = 0
                if level >= row.level:
                    out.append((row.event_id, "suppressed", row.us))
                    continue
                if level:
                    out.append((action, "superseded", row.us))
                out.append((row.event_id, "written", row.us))
                level = 0
                if row.level >= 2:
                    level, ends, action = int(row.level), int(row.us + life[int(row.level)]), int(row.event_id)
            if level:
                state.update((level, ends, action))
                state.setTimeoutTimestamp(max(ends // 1000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        frame = pd.DataFrame(out, columns=["event_id", "outcome", "us"])
        frame.insert(0, asset, group[0])
        yield frame

    level = F.element_at(F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv]), F.col("prevention"))
    keyed = decisions.filter(F.col("prevention") != "observe").withWatermark("ts", watermark).select(
        asset, "ts", "event_id", level.alias("level"), epoch_micros(F.col("ts")).alias("us")
    )
    return keyed.groupBy(asset).applyInPandasWithState(
        step,
        f"`{asset}` string, event_id bigint, outcome string, us bigint",
        "level int, ends bigint, action bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
