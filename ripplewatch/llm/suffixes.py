"""Exact removal of repeated byte strings with a family of sparse suffix arrays.

A suffix array over every byte of a corpus is neither small nor shippable, but whether a window of ``length`` bytes
starts anywhere else can be decided from few suffixes. In each window the ``KEY``-byte string of least hash is its
anchor (the leftmost of equals). Equal windows have equal anchors in equal places, so only suffixes at anchors, about
two in every 170 bytes, need to meet. The consecutive windows that share an anchor form its zone.

1. ``index``: every task scans its documents and sorts its anchors by (hash of the key, hash of the zone): the sparse
   suffix array of a new batch, cut into buckets by the key's hash.
2. Each bucket keeps a logarithmic family of such arrays. A new batch is merge-scanned against the existing levels
   for equal keys and equal zones; then levels of like size merge, so every entry moves a logarithmic number of times.
   A zone met twice is repeated as a whole. Where a key stands in several different zones, one zone of each kind is
   asked for: only these can overlap in part, at the ends of long matches.
3. ``partial_matches``: the bytes of the zones asked for are fetched, and the windows in them are put in suffix order
   eight bytes at a time, which refines only groups that are still equal. Neighbours equal over ``length`` bytes are
   repeated.
4. The marked runs of each document are removed.

A key can be hot: a line of ``KEY`` bytes or more that very many documents hold in different surroundings. Keys seen often
in a sample of the documents are dealt by zone from the start, and every key with more than ``HOT`` different zones is
settled by window instead of by zone: two 64-bit hashes of each of its windows are dealt by the first of them, and
windows that meet an equal one are repeated. What the sample shows decides the balance of the tasks, never a result.

Documents are tagged with a row key, so repeated ids stay apart. No step collects a group: copies within a task are
reduced to one entry before anything is shuffled, and a bucket holds one entry for each zone of a task. The numbers of
buckets follow from the numbers of zones and windows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.llm.bytetext import blocks, gather, mix, powers, running, slice_hashes
from ripplewatch.llm.common import documents, stored, unused

LENGTH = 200
KEY = 32
SAMPLED = 16  # one document in so many is counted for hot keys
SPLIT = 200_000  # zones of a key that are dealt by zone
HOT = 10_000  # different zones of a key that are settled by window
MOST_LISTED = 100_000
ZONES, ASKED, WINDOWS = 500_000, 20_000, 2_000_000  # in a bucket: of the scan, of the suffix order, of the windows
_LOW = np.uint64((1 << 20) - 1)
_NO_KEYS = np.zeros(0, np.uint64)
_ENTRY = np.dtype(
    [("key", "<u8"), ("zone", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("before", "<u1"), ("after", "<u1"), ("many", "?")]
)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: int = KEY):
    """Zones of a block: document, first and last window start, anchor place, key hash and zone hash.

    ``data`` must be shorter than 2**20 bytes unless it is one document; longer documents are cut by the caller.
    """
    n, span = len(data), length - key + 1
    sums = running(data)
    _, down = powers(n + 1)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    keys = mix((sums[key:] - sums[:-key]) * down[: n - key + 1])
    least = keys & ~_LOW | np.arange(len(keys), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    # One value for every window start; those that cross documents are left out.
    at = (least & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    fits = np.arange(len(at)) + length <= offsets[1:][doc]
    first = fits.copy()
    first[1:] &= ~fits[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    last = fits.copy()
    last[:-1] &= ~fits[1:] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    end = np.flatnonzero(last)
    place = at[start]
    zone = mix((sums[end + length] - sums[start]) * down[start] + (place - start).astype(np.uint64) * np.uint64(977) + (end - start).astype(np.uint64))
    return doc[start], start, end, place, keys[place], zone


def _pieces(batch: pa.RecordBatch, length: int):
    """(row of the batch, data, offsets, base): blocks of documents, and overlapping cuts of very long ones.

    Cuts overlap by two lengths, and a zone is taken from the cut in which it cannot be clipped.
    """
    limit = 1 << 19
    for row, data, offsets in blocks(batch, block_bytes=limit):
        if len(data) < 1 << 20:
            yield row, data, offsets, 0, 0, len(data)
            continue
        step, margin = limit, 2 * length
        for low in range(0, len(data), step):
            a, b = max(0, low - margin), min(len(data), low + step + margin)
            yield row, data[a:b], np.array([0, b - a]), a, low - a, min(len(data), low + step) - a


def _entries(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One entry of each zone of a batch, in order of key and zone, and the entries of further copies."""
    keys = batch.column(0).to_numpy()
    parts = []
    for row, data, offsets, base, low, high in _pieces(batch, length):
        doc, start, end, place, key, zone = anchors(data, offsets, length)
        made = np.zeros(len(start), _ENTRY)
        made["key"], made["zone"], made["doc"] = key, zone, keys[row + doc]
        made["start"] = start - offsets[doc] + base
        made["before"], made["after"] = place - start, end - place + (length - KEY)
        if base or high < len(data) or low:
            made = made[(place >= low) & (place < high)]
        parts.append(made)
    every = np.concatenate(parts) if parts else np.zeros(0, _ENTRY)
    every = every[np.lexsort((every["zone"], every["key"]))]
    same = np.zeros(len(every), bool)
    same[1:] = (every["key"][1:] == every["key"][:-1]) & (every["zone"][1:] == every["zone"][:-1])
    first = np.flatnonzero(~same)
    every["many"][first] = np.diff(np.r_[first, len(every)]) > 1
    return every[~same], every[same]


def hot_keys(docs: DataFrame, length: int, split: int = SPLIT) -> tuple[int, np.ndarray]:
    """About how many zones ``docs`` has, and the keys that a sample shows in ``split`` different ones or more."""

    def run(batches):
        for batch in batches:
            zones, _ = _entries(batch, length)
            key, n = np.unique(zones["key"], return_counts=True)
            key, n = [None, *key[n > 1].view(np.int64).tolist()], [len(zones), *n[n > 1].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    sample = docs.filter(F.pmod("_row", F.lit(SAMPLED)) == 0).select("_row", "text")
    counts = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = counts.filter((F.col("n") * SAMPLED >= split) | F.col("key").isNull())
    found = often.orderBy(F.col("key").isNull().desc(), F.desc("n")).limit(MOST_LISTED + 1).collect()
    total = sum(r["n"] for r in found if r["key"] is None) * SAMPLED
    return total, np.array([r["key"] for r in found if r["key"] is not None], np.int64).view(np.uint64)


def index(docs: DataFrame, length: int, buckets: int, listed: np.ndarray = _NO_KEYS) -> DataFrame:
    """(bucket, known, run): sorted runs of entries, one for each task's block and bucket.

    Zones that occur several times in one block are reduced to one entry marked ``many`` and the spans of the others,
    which are known to be repeated and need no further scan. Entries meet by key; those of ``listed`` keys by zone.
    """

    def run(batches):
        for batch in batches:
            zones, copies = _entries(batch, length)
            by = zones["key"].copy()
            split = np.isin(by, listed)
            by[split] = mix(by[split] ^ zones["zone"][split])
            yield from _runs(zones, (by % np.uint64(buckets)).astype(np.int32), 0)
            yield from _runs(copies, (copies["doc"].view(np.uint64) % np.uint64(buckets)).astype(np.int32), 1)

    return docs.select("_row", "text").mapInArrow(run, "bucket int, known int, run binary")


def _runs(entries: np.ndarray, to: np.ndarray, known: int):
    order = np.argsort(to, kind="stable")  # keeps the order of the array within a bucket
    entries, to = entries[order], to[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)]
    made = [entries[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if len(to):
        yield pa.RecordBatch.from_arrays(
            [pa.array(to[cuts[:-1]]), pa.array(np.full(len(made), known, np.int32)), pa.array(made, pa.binary())],
            names=["bucket", "known", "run"],
        )


class Family:
    """Sorted arrays of one bucket; sizes at least double from level to level."""

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.repeated: list[np.ndarray] = []  # entries whose zone stands elsewhere as well

    def add(self, batch: np.ndarray) -> None:
        """Merge-scan a sorted batch against the levels, then store it, merging levels of like size."""
        batch = batch.copy()
        for level in self.levels:
            at = _find(level, batch)
            hit = at >= 0
            batch["many"][hit] = True
            level["many"][at[hit]] = True
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            newer, older = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(older, newer))

    def _merged(self, older: np.ndarray, newer: np.ndarray) -> np.ndarray:
        both = np.concatenate([older, newer])
        both = both[np.lexsort((both["zone"], both["key"]))]
        same = np.zeros(len(both), bool)
        same[1:] = (both["key"][1:] == both["key"][:-1]) & (both["zone"][1:] == both["zone"][:-1])
        if same.any():
            self.repeated.append(both[same])
        return both[~same]

    def close(self, hot: int = HOT, listed: np.ndarray = _NO_KEYS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Repeated entries, and one entry of every zone whose key stands in several different zones.

        The latter in two parts: of ordinary keys, and of those that are ``listed`` or stand in more than ``hot`` zones.
        """
        every = np.zeros(0, _ENTRY)
        for level in self.levels:
            every = self._merged(every, level)
        self.levels = []
        key = every["key"]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(every)])
        zones = np.repeat(size, size)
        by_window = (zones > hot) | np.isin(key, listed)
        repeated = np.concatenate([*self.repeated, every[every["many"]]])
        return repeated, every[(zones > 1) & ~by_window], every[by_window]


def _find(level: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Where each entry of the batch stands in the level with equal key and zone; -1 if nowhere."""
    out = np.full(len(batch), -1, np.int64)
    low, high = (np.searchsorted(level["key"], batch["key"], side=side) for side in ("left", "right"))
    todo = np.flatnonzero(low < high)
    zones, wanted = level["zone"], batch["zone"][todo]
    low, end = low[todo], high[todo]
    high = end
    while (low < high).any():  # the zones of equal keys are in order, too
        middle = (low + high) // 2
        open_ = low < high
        less = open_ & (zones[np.minimum(middle, len(level) - 1)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    hit = low < end
    hit[hit] = zones[low[hit]] == wanted[hit]
    out[todo[hit]] = low[hit]
    return out


_SPANS = "doc long, kind int, spans binary"
_SPAN = np.dtype([("start", "<i4"), ("before", "<u1"), ("after", "<u1")])


def _per_document(entries: np.ndarray, kind: int):
    """Rows of ``_SPANS``: the zones of each document, packed."""
    entries = entries[np.argsort(entries["doc"], kind="stable")]
    packed = np.zeros(len(entries), _SPAN)
    for name in _SPAN.names:
        packed[name] = entries[name]
    cuts = np.r_[0, np.flatnonzero(np.diff(entries["doc"])) + 1, len(entries)]
    made = [packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(entries["doc"][cuts[:-1]]), pa.array(np.full(len(made), kind, np.int32)), pa.array(made, pa.binary())],
        names=["doc", "kind", "spans"],
    )


def scan(runs: DataFrame, hot: int = HOT, listed: np.ndarray = _NO_KEYS) -> DataFrame:
    """The families of all buckets: kind 0 are repeated zones, kinds 1 and 3 zones to look into, whole and by window."""

    def run(batches):
        family, bucket = None, None

        def closed():
            for kind, entries in zip((0, 1, 3), family.close(hot, listed), strict=True):
                for low in range(0, len(entries), 200_000):
                    yield _per_document(entries[low : low + 200_000], kind)

        for batch in batches:
            for own, known, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                entries = np.frombuffer(raw, _ENTRY)
                if known:
                    yield _per_document(entries, 0)
                    continue
                if own != bucket:
                    if family:
                        yield from closed()
                    family, bucket = Family(), own
                family.add(entries)
        if family:
            yield from closed()

    rows = runs.repartition("bucket").sortWithinPartitions("bucket", "known")
    return rows.mapInArrow(run, _SPANS)


def _spans(raw: list) -> np.ndarray:
    return np.frombuffer(b"".join(raw), _SPAN)


def _windows(doc: int, data: np.ndarray, sums: np.ndarray, zones: np.ndarray, length: int) -> np.ndarray:
    """Every window of the zones of a document, with two hashes."""
    count = zones["before"].astype(np.int64) + zones["after"] + (KEY - length + 1)
    at = np.repeat(zones["start"] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    up, _ = powers(len(data) + 1)
    other = np.r_[np.zeros(1, np.uint64), np.cumsum(_OTHER[data] * up[: len(data)], dtype=np.uint64)]
    out = np.zeros(len(at), _WINDOW)
    out["hash"], out["other"] = slice_hashes(sums, at, at + length), slice_hashes(other, at, at + length)
    out["doc"], out["start"] = doc, at
    return out


def _met(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of window, marked ``many`` if others are equal, and these others."""
    windows = windows[np.lexsort((windows["other"], windows["hash"]))]
    same = np.zeros(len(windows), bool)
    for name in ("hash", "other"):
        same[1:] = (windows[name][1:] == windows[name][:-1]) & (same[1:] | (name == "hash"))
    first = np.flatnonzero(~same)
    if len(first):
        windows["many"][first] = np.logical_or.reduceat(windows["many"], first) | (np.diff(np.r_[first, len(windows)]) > 1)
    return windows[~same], windows[same]


def _joined(windows: np.ndarray, length: int) -> np.ndarray:
    """Entries that span the windows; those in a row, up to a hundred, are one."""
    windows = windows[np.lexsort((windows["start"], windows["doc"]))]
    new = np.ones(len(windows), bool)
    new[1:] = (windows["doc"][1:] != windows["doc"][:-1]) | (windows["start"][1:] > windows["start"][:-1].astype(np.int64) + 1)
    new |= windows["start"] % 100 == 0
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(windows)][: len(first)] - 1
    made = np.zeros(len(first), _ENTRY)
    made["doc"], made["start"] = windows["doc"][first], windows["start"][first]
    made["before"], made["after"] = windows["start"][last] - windows["start"][first], length - KEY
    return made


def fetch(docs: DataFrame, spans: DataFrame, length: int, buckets: int, parts: int) -> DataFrame:
    """What the zones to look into hold, packed by bucket.

    Kind 1: the bytes of zones, by the hash of their key. Kind 3: windows of hot keys, by their own hash, in ``parts``
    further buckets. Kind 2: windows already known to be repeated.
    """
    whole, by_window = (F.collect_list(F.when(F.col("kind") == kind, F.col("spans"))) for kind in (1, 3))
    asked = spans.filter("kind in (1, 3)").groupBy("doc").agg(whole.alias("_spans"), by_window.alias("_hot"))
    asked = asked.withColumnRenamed("doc", "_doc")
    names = ["bucket", "kind", "heads", "bytes"]
    columns = [*docs.columns, "_spans", "_hot"]
    row_at, text_at = columns.index("_row"), columns.index("text")

    def packed(to, kind, heads, data=None):
        made = [pa.array(to, pa.int32()), pa.array([kind] * len(to), pa.int32())]
        made += [pa.array(heads, pa.binary()), pa.array(data or [b""] * len(to), pa.binary())]
        return pa.RecordBatch.from_arrays(made, names=names)

    def dealt(windows):
        windows, known = _met(np.concatenate(windows))
        to = (windows["hash"] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        windows, to = windows[order], to[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)]
        heads = [windows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield packed(to[cuts[:-1]] + buckets, 3, heads)
        if len(known):
            known = _joined(known, length)
            yield packed([int(known["doc"][0]) % buckets], 2, [known.tobytes()])

    def run(batches):
        for batch in batches:
            heads, parts_, keys, windows, held = [], [], [], [], 0
            read = (batch.column(k).to_pylist() for k in (row_at, text_at, len(columns) - 2, len(columns) - 1))
            for doc, text, raw, hot in zip(*read, strict=True):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                sums = running(data)
                if hot:
                    windows.append(_windows(doc, data, sums, _spans(hot), length))
                    held += len(windows[-1])
                    if held > WINDOWS:
                        yield from dealt(windows)
                        windows, held = [], 0
                if not raw:
                    continue
                zones = _spans(raw)
                place = zones["start"].astype(np.int64) + zones["before"]
                size = zones["before"].astype(np.int64) + zones["after"] + KEY
                _, down = powers(len(sums))
                keys.append(mix((sums[place + KEY] - sums[place]) * down[place]))
                head = np.zeros(len(zones), _HEAD)
                head["doc"], head["start"], head["size"] = doc, zones["start"], size
                heads.append(head)
                parts_.append(gather(data, zones["start"].astype(np.int64), size))
            if windows:
                yield from dealt(windows)
            if not heads:
                continue
            head, data = np.concatenate(heads), np.concatenate(parts_)
            to = (np.concatenate(keys) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            begin = (np.cumsum(head["size"]) - head["size"]).astype(np.int64)
            data = gather(data, begin[order], head["size"][order].astype(np.int64))
            head, to = head[order], to[order]
            upto = np.r_[0, np.cumsum(head["size"])].astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)]
            pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            bytes_ = [data[upto[a] : upto[b]].tobytes() for a, b in pairs]
            yield packed(to[cuts[:-1]], 1, [head[a:b].tobytes() for a, b in pairs], bytes_)

    # The same columns as in the last join, so that both read one exchange of the texts.
    joined = docs.join(asked, docs["_row"] == asked["_doc"]).select(*columns)
    return joined.mapInArrow(run, "bucket int, kind int, heads binary, bytes binary")


_WINDOW = np.dtype([("hash", "<u8"), ("other", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("many", "?")])
_OTHER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))  # a number for each byte
_HEAD = np.dtype([("doc", "<i8"), ("start", "<i4"), ("size", "<u2")])


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows at ``starts`` equal another one over ``length`` bytes: sorting by eight bytes at a time."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.zeros(len(starts), bool)
    index = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for done in range(0, length, 8):
        if not len(index):
            break
        at = np.minimum(starts[index] + done, len(data))
        if done + 8 > length:
            at = starts[index] + length - 8  # the last step may overlap the one before
        word = np.zeros(len(index), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | padded[at + k]
        # Words are sorted inside the groups that are equal so far; groups of one are out.
        order = np.lexsort((word, group))
        index, group, word = index[order], group[order], word[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])]
        cell = np.cumsum(new) - 1
        size = np.bincount(cell)
        keep = size[cell] > 1
        index, group = index[keep], cell[keep]
    out[index] = True
    return out


def partial_matches(zones: DataFrame, length: int) -> DataFrame:
    """Repeated windows of what was fetched, as rows of ``_SPANS`` of kind 2 (start, and windows in a row)."""

    def run(batches):
        bucket, held, of = None, [], None

        def closed():
            if of == 3:
                one, others = _met(np.concatenate([np.frombuffer(h, _WINDOW) for h, _ in held]))
                met = np.concatenate([one[one["many"]], others])
                if len(met):
                    yield _per_document(_joined(met, length), 2)
                return
            head = np.concatenate([np.frombuffer(h, _HEAD) for h, _ in held])
            data = np.frombuffer(b"".join(d for _, d in held), np.uint8)
            size = head["size"].astype(np.int64)
            begin = np.cumsum(size) - size
            count = size - length + 1
            owner = np.repeat(np.arange(len(head)), count)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            same = repeated_windows(data, begin[owner] + within, length)
            first = same.copy()
            first[1:] &= ~same[:-1] | (owner[1:] != owner[:-1])
            last = same.copy()
            last[:-1] &= ~same[1:] | (owner[1:] != owner[:-1])
            a, b = np.flatnonzero(first), np.flatnonzero(last)
            made = np.zeros(len(a), _ENTRY)
            made["doc"], made["start"] = head["doc"][owner[a]], head["start"][owner[a]] + within[a]
            made["before"], made["after"] = b - a, length - KEY  # a zone of length + (b - a) bytes
            if len(made):
                yield _per_document(made, 2)

        for batch in batches:
            for own, kind, head, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == 2:
                    yield _per_document(np.frombuffer(head, _ENTRY), 2)
                    continue
                if own != bucket:
                    if held:
                        yield from closed()
                    bucket, held, of = own, [], kind
                held.append((head, data))
        if held:
            yield from closed()

    return zones.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _SPANS)


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Bytes of a document that any of the spans covers."""
    marks = np.zeros(n + 1, np.int64)
    start = spans["start"].astype(np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + spans["before"] + spans["after"] + KEY, -1)
    return np.cumsum(marks)[:n] > 0


def repeats(rows: DataFrame, length: int = LENGTH, buckets: int | None = None, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """``_doc`` (a ``_row``) and ``_spans``: the packed spans that repeat, of every row of ``rows`` that has any."""
    zones, listed = hot_keys(rows, length, split)
    buckets = buckets or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-zones // ZONES))
    spans = stored(scan(index(rows, length, buckets, listed), hot, listed), "zones")
    size = F.sum(F.length("spans") / _SPAN.itemsize).cast("long").alias("n")
    n = {r["kind"]: r["n"] for r in spans.groupBy("kind").agg(size).collect()}
    windows = n.get(3, 0) * (length - KEY + 1)  # at most
    whole, parts = max(buckets, -(-n.get(1, 0) // ASKED)), max(buckets, -(-windows // WINDOWS))
    partial = partial_matches(fetch(rows, spans, length, whole, parts), length)
    found = spans.filter("kind = 0").unionByName(partial)
    return found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("spans").alias("_spans"))


def _marked(docs: DataFrame, length: int, buckets: int | None, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """``docs`` with ``_row`` (rows that share it are equal in id and text, and so in what repeats) and ``_spans``."""
    row, doc, spans = unused(docs, "_row", "_doc", "_spans")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    marked = repeats(rows.select("doc_id", "text", F.col(row).alias("_row")), length, buckets, hot, split)
    marked = marked.select(F.col("_doc").alias(doc), F.col("_spans").alias(spans))
    return rows.join(marked, rows[row] == marked[doc], "left").select(*rows.columns, spans)


def _cut(text: str | None, raw: list | None) -> tuple[bytes, int, int, bytes]:
    """The text's bytes, how many of them go, in how many runs, and the bytes left."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return data, 0, 0, data
    gone = _covered(_spans(raw), len(data))
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return data, int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, buckets: int | None = None, hot: int = HOT, split: int = SPLIT
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left) of every row.

    Each byte covered by a ``length``-byte string that also starts elsewhere, in this or another document, is removed;
    all copies go, those of repeated rows included. A null text is empty and keeps nothing; texts shorter than
    ``length`` stay whole; an empty table gives an empty result. Other columns are ignored. ``hot`` and ``split`` only
    say how keys in many different zones are dealt to tasks.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            keys, texts, _, spans = (c.to_pylist() for c in batch.columns)
            made = [_cut(text, raw) for text, raw in zip(texts, spans, strict=True)]
            columns = [keys, [len(m[0]) for m in made], *([m[k] for m in made] for k in (1, 2, 3))]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    marked = _marked(documents(docs), length, buckets, hot, split)
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, *, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """``docs``, all rows and columns, with texts that have lost their repeated bytes.

    Bytes of a character that is cut in two are left out as well; ``n_chars``, where there is such a column, is counted
    anew. A null text stays null. Inner columns take names that ``docs`` does not use.
    """
    at = docs.columns.index("text")
    names, width = docs.columns, len(docs.columns)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:width])
            texts, spans = columns[at].to_pylist(), batch.column(width + 1).to_pylist()
            kept = [t if not raw else _cut(t, raw)[3].decode("utf-8", "ignore") for t, raw in zip(texts, spans, strict=True)]
            columns[at] = pa.array(kept, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = _marked(docs, length, buckets).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind)).select(*names)
    return out
