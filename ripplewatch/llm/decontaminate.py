"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is ``width`` consecutive words of an item (a shorter item is one window). Seen as the set of its shingles of
up to three words, a window lies in a document only if all its shingles do, so the prefix that must be joined is one
shingle, and the rarest in the corpus makes the fewest candidates: the shingles of the benchmark are counted over all
documents first. A place where a document holds that shingle fixes where the window would have to start (positional
bound) and end (length bound: inside the document's words); what is left is verified byte by byte.

The benchmark is read in blocks of bounded size and each block is matched against all documents, so what travels to
the tasks never grows with either table.
"""

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.llm.bytetext import Words, blocks, gather, lower_table
from ripplewatch.llm.common import documents, stored

WIDTH = 10
SHINGLE = 3
BENCHMARK_BYTES = 16 << 20


def word_table() -> np.ndarray:
    """Bytes of words: digits, lower-case letters and every byte of a character outside ASCII."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


class Windows:
    """The distinct windows of a block of benchmark items."""

    def __init__(self, items: list[tuple], width: int):
        lower, inside = lower_table(), word_table()
        seen: dict[tuple, set] = {}
        for item, text in items:
            low = (text or "").encode("utf-8", "surrogatepass")
            words = Words(np.frombuffer(low, np.uint8), np.array([0, len(low)]), inside, lower)
            raw = words.data.tobytes()
            said = [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
            for at in range(max(1, len(said) - width + 1) if said else 0):
                seen.setdefault(tuple(said[at : at + width]), set()).add("" if item is None else str(item))
        self.windows = list(seen)
        self.items = [sorted(x) for x in seen.values()]
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        flat = [x for w in self.windows for x in w]
        self.first = np.r_[0, np.cumsum(self.sizes)]
        self.lengths = np.array([len(x) for x in flat], np.int64)
        self.data = np.frombuffer(b"".join(flat), np.uint8)
        self.places = np.r_[0, np.cumsum(self.lengths)]
        # Every window is read as a document of its own, so that hashes agree with those of the documents.
        spaced = b"".join(b" ".join(w) for w in self.windows)
        ends = np.cumsum([len(b" ".join(w)) for w in self.windows])
        words = Words(np.frombuffer(spaced, np.uint8), np.r_[0, ends].astype(np.int64), inside, lower)
        self.words = words.hashes
        self.shingles = {}  # of each width: window, place in it, hash
        for size in range(1, SHINGLE + 1):
            hashes, own = words.shingles(size)
            owner = np.repeat(np.arange(len(self.windows)), self.sizes)[: len(hashes)]
            own = own & (np.minimum(self.sizes[owner], SHINGLE) == size)
            at = np.flatnonzero(own)
            self.shingles[size] = owner[at], at - self.first[owner[at]], hashes[at]
        self.vocabulary = {size: np.unique(x[2]) for size, x in self.shingles.items() if len(x[2])}
        self.chosen: dict = {}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep of each window the shingle that fewest places of the corpus hold."""
        for size, (owner, place, hashes) in self.shingles.items():
            if not len(owner):
                continue
            seen = counts[size][np.searchsorted(self.vocabulary[size], hashes)]
            order = np.lexsort((place, seen, owner))
            keep = order[np.unique(owner[order], return_index=True)[1]]
            by_hash = keep[np.argsort(hashes[keep], kind="stable")]
            self.chosen[size] = Lookup(hashes[by_hash]), owner[by_hash], place[by_hash]
        self.shingles = {}


class Lookup:
    """Places of a sorted array of hashes, behind a bit table that turns most strangers away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(hashes & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def find(self, asked: np.ndarray, valid: np.ndarray):
        """(index into asked, low, high): the runs of equal hashes."""
        at = np.flatnonzero(self.bits[(asked & np.uint64(0x3FFFF)).astype(np.int64)] & valid)
        low = np.searchsorted(self.hashes, asked[at], side="left")
        high = np.searchsorted(self.hashes, asked[at], side="right")
        hit = high > low
        return at[hit], low[hit], high[hit]


def _counts(docs: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """How often the corpus holds each shingle of the block: one partial count from each task."""
    vocabulary = windows.vocabulary

    def count(batches):
        lower, inside = lower_table(), word_table()
        lookups = {size: Lookup(v) for size, v in vocabulary.items()}
        found = {size: np.zeros(len(v), np.int64) for size, v in vocabulary.items()}
        for batch in batches:
            for _, data, offsets in blocks(batch):
                words = Words(data, offsets, inside, lower)
                for size, lookup in lookups.items():
                    _, low, _ = lookup.find(*words.shingles(size))
                    found[size] += np.bincount(low, minlength=len(lookup.hashes))
        for size, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), size)), pa.array(at), pa.array(n[at])], names=["size", "at", "n"]
            )

    rows = docs.mapInArrow(count, "size long, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    out = {size: np.zeros(len(v), np.int64) for size, v in vocabulary.items()}
    for size, at, n in rows.collect():  # no more rows than the block has shingles
        out[size][at] = n
    return out


def hits(words: Words, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window inside a document of the block."""
    found = []
    for size, (lookup, owner, place) in windows.chosen.items():
        at, low, high = lookup.find(*words.shingles(size))
        many = high - low
        at = np.repeat(at, many)
        which = gather(np.arange(len(owner)), low, many)
        start, window = at - place[which], owner[which]
        doc = np.searchsorted(words.bounds, at, side="right") - 1
        fits = (start >= words.bounds[doc]) & (start + windows.sizes[window] <= words.bounds[doc + 1])
        found.append((start[fits], window[fits]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, window = (np.concatenate(x) for x in zip(*found, strict=True))
    m = windows.sizes[window]
    same = gather(words.hashes, start, m) == gather(windows.words, windows.first[window], m)
    good = np.logical_and.reduceat(same, np.r_[0, np.cumsum(m)[:-1]]) if len(m) else np.zeros(0, bool)
    start, window = start[good], window[good]
    return _verified(words, windows, start, window)


def _verified(words: Words, windows: Windows, start, window):
    """Only the occurrences whose bytes are those of the window."""
    if not len(start):
        return start, window
    m = windows.sizes[window]
    head = np.r_[0, np.cumsum(m)[:-1]]
    ours = gather(np.arange(len(words.starts)), start, m)
    theirs = gather(np.arange(len(windows.lengths)), windows.first[window], m)
    lengths = words.ends[ours] - words.starts[ours]
    good = np.logical_and.reduceat(lengths == windows.lengths[theirs], head)
    start, window, lengths = start[good], window[good], lengths[np.repeat(good, m)]
    if not len(start):
        return start, window
    ours, theirs, m = ours[np.repeat(good, m)], theirs[np.repeat(good, m)], m[good]
    same = gather(words.data, words.starts[ours], lengths) == gather(windows.data, windows.places[theirs], lengths)
    size = np.add.reduceat(lengths, np.r_[0, np.cumsum(m)[:-1]])
    good = np.logical_and.reduceat(same, np.r_[0, np.cumsum(size)[:-1]])
    return start[good], window[good]


def _match(docs: DataFrame, windows: Windows, keep_spans: bool) -> DataFrame:
    """doc_id, n_words, n_hit, items of every document, and ``spans`` (word ranges) where they are asked for."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(windows))  # a block of bounded size
    names = ["doc_id", "n_words", "n_hit", "items", "spans", "content"]

    def match(batches):
        own, lower, inside = pickle.loads(packed.value), lower_table(), word_table()
        for batch in batches:
            keys, content = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for row, data, offsets in blocks(batch):
                words = Words(data, offsets, inside, lower)
                start, window = hits(words, own)
                marks = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + own.sizes[window], -1)
                hit = np.r_[0, np.cumsum(np.cumsum(marks)[:-1] > 0)]
                n_hit = hit[words.bounds[1:]] - hit[words.bounds[:-1]]
                doc = np.searchsorted(words.bounds, start, side="right") - 1
                items: dict[int, set] = {}
                spans: dict[int, list] = {}
                for d, w, s in zip(doc.tolist(), window.tolist(), start.tolist(), strict=True):
                    items.setdefault(d, set()).update(own.items[w])
                    if keep_spans:
                        low = s - int(words.bounds[d])
                        spans.setdefault(d, []).append([low, low + int(own.sizes[w])])
                n_words = np.diff(words.bounds)
                rows += [
                    (keys[row + d], int(n_words[d]), int(n_hit[d]), sorted(items.get(d, ())), spans.get(d, []), content[row + d])
                    for d in range(len(n_words))
                ]
            yield rows

    def arrow(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.string()]
        for rows in match(batches):
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=names)

    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>, content string"
    content = F.md5("text") if keep_spans else F.lit(None).cast("string")
    return docs.withColumn("content", content).mapInArrow(arrow, schema)


def _blocks_of_windows(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int):
    """The windows of the benchmark, a block of bounded size at a time, with their shingles chosen by ``docs``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    for part in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else items
        windows = Windows([tuple(r) for r in block.collect()], width)  # at most about block_bytes
        windows.choose(_counts(docs, windows) if windows.windows else {})
        yield windows, parts


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_bytes: int = BENCHMARK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings) for every row of ``docs``.

    Null or empty texts have no words and no hits; an empty benchmark hits nothing; repeated documents and items are
    each judged alone (equal item ids count once, a null item id is the empty string). Other columns are ignored.
    """
    docs, found = documents(docs), []
    for windows, parts in _blocks_of_windows(docs, benchmark, width, block_bytes):
        if parts == 1:
            return _match(docs, windows, False).drop("spans", "content")
        found.append(stored(_match(docs, windows, True), "windows"))
    return _union_of_blocks(found)


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_bytes: int = BENCHMARK_BYTES
) -> DataFrame:
    """The rows of ``docs``, all their columns, in which no window of the benchmark occurs."""
    at, out = docs.columns.index("text"), docs
    for windows, _ in _blocks_of_windows(documents(docs), benchmark, width, block_bytes):
        packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(windows))  # a block of bounded size

        def run(batches, packed=packed):
            own, lower, inside = pickle.loads(packed.value), lower_table(), word_table()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, data, offsets in blocks(batch, at):
                    words = Words(data, offsets, inside, lower)
                    start, _ = hits(words, own)
                    clean[row + np.searchsorted(words.bounds, start, side="right") - 1] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def _union_of_blocks(found: list[DataFrame]) -> DataFrame:
    """Add up what several blocks of the benchmark found in the same documents.

    Rows of one doc_id are told apart by their text; equal rows have equal results and stay as many as they are.
    """
    parts = len(found)
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        words = int(frame["n_words"].iloc[0])
        hit = np.zeros(words, bool)
        for spans in frame["spans"]:
            for low, high in spans:
                hit[low:high] = True
        items = sorted({i for row in frame["items"] for i in row})
        row = (frame["doc_id"].iloc[0], words, int(hit.sum()), items)
        return pd.DataFrame([row] * (len(frame) // parts), columns=["doc_id", "n_words", "n_hit", "items"])

    return every.groupBy("doc_id", "content").applyInPandas(total, "doc_id long, n_words long, n_hit long, items array<string>")


def digest(rows: DataFrame) -> DataFrame:
    """The rows with n_items, items_sha256 (of the comma-joined ids) and contaminated in place of the list."""
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

