"""Fingerprints of documents from their Lempel-Ziv phrases, for a likeness that resembles common compressibility.

A text is parsed once from the left; every phrase is the longest one seen before plus one character. The phrases are
the text's own dictionary: texts that would compress each other share many. Their set is hashed and reduced to a
minimum-hash signature, so two texts are compared by the share of equal places in their signatures.

``compare_neighbours`` also prints an edited copy, whose end is that of another text. Both copies share a beginning, so
it is parsed once and the dictionary is rolled back to it. Documents are dealt into contiguous id ranges; the first row
of each range is also given to the range before, which is all that neighbours need across tasks.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch.llm.bytetext import mix, running, slice_hashes
from ripplewatch.llm.common import ROWS_PER_BUCKET, documents, ordered_buckets

PLACES = 64
_SLICE = 2048
_FACTORS = mix(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)


def parse(text: str, at: int, root: dict, node: dict, ends: list[int], added: list | None = None) -> dict:
    """Go on parsing ``text``, whose first character is number ``at``; returns the place in the dictionary.

    Ends of phrases go to ``ends``; new entries to ``added``, where that is given, so that they can be taken back.
    """
    end = ends.append
    for k, ch in enumerate(text, at + 1):
        following = node.get(ch)
        if following is None:
            node[ch] = {}
            if added is not None:
                added.append((node, ch))
            end(k)
            node = root
        else:
            node = following
    return node


def signature(text: str, ends: list[int]) -> np.ndarray:
    """Least of ``PLACES`` hashes of the phrases that end where ``ends`` says, 16 bits each."""
    out = np.full(PLACES, np.uint64(2**64 - 1))
    if ends:
        stops = np.array(ends, np.int64)
        starts = np.r_[0, stops[:-1]]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        hashes = slice_hashes(running(codes), starts, stops)
        for low in range(0, len(hashes), _SLICE):
            each = hashes[low : low + _SLICE, None] * _FACTORS
            np.minimum(out, (each ^ each >> np.uint64(29)).min(axis=0), out=out)
    return (mix(out) >> np.uint64(48)).astype("<u2")


def fingerprint(text: str) -> str:
    """The signature of a text as lower-case hex digits; that of an empty text stands for no phrases."""
    ends: list[int] = []
    root: dict = {}
    parse(text, 0, root, root, ends)
    return signature(text, ends).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal places of two fingerprints: an estimate of the overlap of the phrase sets."""
    x, y = (np.frombuffer(bytes.fromhex(s), "<u2") for s in (a, b))
    return float(np.mean(x == y))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many characters (or all) from the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def both_fingerprints(text: str, following: str) -> tuple[str, str]:
    """Fingerprints of a text and of its edited copy, parsing what they share once."""
    cut = len(text) - len(text) // 3
    ends: list[int] = []
    root: dict = {}
    node = parse(text[:cut], 0, root, root, ends)
    common, added = len(ends), []
    parse(text[cut:], cut, root, node, ends, added)
    own = signature(text, ends).tobytes().hex()
    for place, ch in reversed(added):
        del place[ch]
    tail = ends[:common]
    parse(following[: len(text) - cut], cut, root, node, tail)
    return own, signature(edited(text, following), tail).tobytes().hex()


def _neighbour_rows(docs: DataFrame, rows_per_bucket: int) -> DataFrame:
    """(_bucket, _copy, doc_id, text): ranges of ids, each with a copy of the row that follows its last."""
    rows = ordered_buckets(documents(docs), "doc_id", rows_per_bucket)
    # One row for each range: its first row in descending order goes to the range above; the very first to the lowest.
    heads = rows.groupBy("_bucket").agg(F.max("doc_id").alias("_head"))
    order = Window.orderBy("_bucket")
    lowest = F.min("_bucket").over(Window.partitionBy(F.lit(0)))
    heads = heads.select(F.col("_bucket").alias("_at"), "_head", F.coalesce(F.lead("_bucket").over(order), lowest).alias("_to"))
    same = (F.col("_bucket") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_head"))
    joined = rows.join(F.broadcast(heads), same, "left").select("doc_id", "text", F.col("_bucket").alias("_own"), "_to")
    places = F.array_compact(
        F.array(
            F.struct(F.col("_own").alias("_bucket"), F.lit(0).alias("_copy")),
            F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("_bucket"), F.lit(1).alias("_copy"))),
        )
    )
    return joined.select(F.inline(places), "doc_id", "text")


def compare_neighbours(docs: DataFrame, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fingerprints of every text and its edited copy, and their likeness to each other and to the next text's.

    Documents follow each other in descending doc_id, null ids last, equal ids by text; after the last comes the
    first. A null text is empty. A single document follows itself. Other columns are ignored; an empty table gives an
    empty result.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows = _neighbour_rows(docs, rows_per_bucket).repartition("_bucket")
    rows = rows.sortWithinPartitions("_bucket", "_copy", F.desc_nulls_last("doc_id"), "text")

    def run(batches):
        bucket, waiting, shown, ended = None, None, None, False  # waiting: for its next text; shown: for the next print
        made = []

        def step(key, text, following):
            nonlocal shown
            own, other = both_fingerprints(text, following)
            if shown:
                made.append((*shown, likeness(shown[3], own)))
            digest = hashlib.sha256(edited(text, following).encode("utf-8", "surrogatepass")).hexdigest()
            shown = (key, len(text), digest, own, other, likeness(own, other))

        for batch in batches:
            for where, copy, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if where != bucket:
                    bucket, waiting, shown, ended = where, None, None, False
                if ended:  # further rows of the id that heads the range below
                    continue
                if waiting:
                    step(*waiting, text)
                waiting = key, text
                if copy:
                    made.append((*shown, likeness(shown[3], fingerprint(text))))
                    waiting, shown, ended = None, None, True
            if made:
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
                made.clear()

    return rows.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
