"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how often ids meet.

Both tokenizers spell the same bytes, so the cumulative ends of their tokens can be compared. Each token sequence gives
a dictionary from end to index; the ends that both dictionaries hold, sorted, cut the two id lists into groups, and
inside a group every two tokens whose byte ranges overlap are linked.

Neither tokenizer joins characters across a space that follows a visible character, so a space opens a group, and a text
is aligned by its pieces between spaces. A task aligns each distinct piece once; a text in which white space meets white
space, or in which a piece does not spell its own bytes, is encoded whole. What is known is a cache, emptied when full.

Counts of id pairs are corpus-wide. A task codes the pairs of a block of documents by a dictionary of that block and
writes them once; the dictionaries, not the links, are summed by pair, and each gets the sums of its own pairs back. A
frequent pair thus costs one row for each block, however many documents hold it.
"""

import hashlib
import os
from collections.abc import Iterable
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.llm.bytetext import gather
from ripplewatch.llm.common import documents, slices, stored, texts_of

BLOCK_CHARS = 4 << 20
KNOWN_PIECES = 300_000
KNOWN_CHARS = 32 << 20
_SPACE = "▁"
_aligners: dict = {}


def cuts(sizes_a: Iterable[int], sizes_b: Iterable[int]) -> list[tuple[int, int]]:
    """How many tokens of each side end at or before each common end, given the tokens' lengths in bytes."""
    ends_a = {end: k for k, end in enumerate(accumulate(sizes_a), 1)}
    ends_b = {end: k for k, end in enumerate(accumulate(sizes_b), 1)}
    return [(ends_a[end], ends_b[end]) for end in sorted(ends_a.keys() & ends_b.keys())]


def links(sizes_a: list[int], sizes_b: list[int], groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers of the tokens that overlap, group by group: within one, the token that ends first is passed first."""
    out, i, j = [], 0, 0
    for stop_a, stop_b in groups:
        if stop_a == i + 1:
            out += [(i, k) for k in range(j, stop_b)]
        elif stop_b == j + 1:
            out += [(k, j) for k in range(i, stop_a)]
        else:
            left_a, left_b = sizes_a[i], sizes_b[j]
            while True:
                out.append((i, j))
                step = min(left_a, left_b)
                left_a, left_b = left_a - step, left_b - step
                if not left_a:
                    i += 1
                if not left_b:
                    j += 1
                if i == stop_a:
                    break
                left_a = left_a or sizes_a[i]
                left_b = left_b or sizes_b[j]
        i, j = stop_a, stop_b
    return out


def shown(a: list[int], b: list[int], groups: list[tuple[int, int]]) -> str:
    """The groups as text: ``a1,a2|b1;a3|b2,b3``."""
    own, other = list(map(str, a)), list(map(str, b))
    out, i, j = [], 0, 0
    for stop_a, stop_b in groups:
        left = own[i] if stop_a == i + 1 else ",".join(own[i:stop_a])
        right = other[j] if stop_b == j + 1 else ",".join(other[j:stop_b])
        out.append(left + "|" + right)
        i, j = stop_a, stop_b
    return ";".join(out)


class Aligner:
    """A byte-level tokenizer of the tokenizers library (A) beside a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        letters = _byte_letters()
        for token, at in vocab.items():
            self.bytes_a[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode("utf-8")
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode("utf-8")
            for k, p in enumerate(pieces)
        ]
        self.sizes_a, self.sizes_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        # Splitting at spaces is safe for B only while no piece holds a space behind another character.
        self.by_pieces = all(_SPACE not in p.lstrip(_SPACE) for p in pieces)
        self._forget()

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides, or None where they do not both spell a space and the text."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return self._spelled(text, a, self.b.encode(text))

    def _spelled(self, text: str, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        wanted = b" " + text.encode("utf-8")
        same = all(b"".join(map(t.__getitem__, x)) == wanted for t, x in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if same else None

    def groups(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Cuts and links of two id lists that spell the same bytes."""
        sizes_a, sizes_b = [self.sizes_a[k] for k in a], [self.sizes_b[k] for k in b]
        found = cuts(sizes_a, sizes_b)
        return found, links(sizes_a, sizes_b, found)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.shown = 0, []
        self.flat, self.offsets, self.counts = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, 4), np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Align new pieces, a thousand of them as one sequence of tokens; pieces that need their text's context are noted."""
        plain = [not _meets_blank(p) for p in pieces]
        codes, counts = [self.flat], [self.counts]
        for low in range(0, len(pieces), 1000):
            some, fits = pieces[low : low + 1000], plain[low : low + 1000]
            strings, found, sizes = self._together([p for p, fit in zip(some, fits, strict=True) if fit])
            every = np.zeros((len(some), 4), np.int64)
            every[np.flatnonzero(fits)] = sizes
            rest = iter(strings)
            self.shown += [next(rest) if fit else None for fit in fits]
            codes.append(found)
            counts.append(every)
        self.flat, self.counts = np.concatenate(codes), np.concatenate(counts)
        self.offsets = np.r_[0, np.cumsum(self.counts[:, 3])]

    def _together(self, pieces: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(groups as text, codes of all links, sizes) of pieces aligned as one sequence: their ends are common ends.

        If the sequence is not spelled byte for byte, its halves are tried, down to the pieces that are not.
        """
        if not pieces:
            return [], np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        wanted = [b" " + p.encode("utf-8") for p in pieces]
        a = self.a.encode_batch_fast(["".join(" " + p for p in pieces)], add_special_tokens=False)[0].ids
        b = list(chain.from_iterable(self.b.encode(pieces, num_threads=1)))
        whole = b"".join(wanted)
        if any(b"".join(map(t.__getitem__, x)) != whole for t, x in ((self.bytes_a, a), (self.bytes_b, b))):
            if len(pieces) == 1:
                return [None], np.zeros(0, np.int64), np.zeros((1, 4), np.int64)
            half = len(pieces) // 2
            first, second = self._together(pieces[:half]), self._together(pieces[half:])
            return first[0] + second[0], np.r_[first[1], second[1]], np.concatenate([first[2], second[2]])
        sizes_a, sizes_b = [self.sizes_a[k] for k in a], [self.sizes_b[k] for k in b]
        found = cuts(sizes_a, sizes_b)
        stops = np.array(found, np.int64)
        starts = np.r_[np.zeros((1, 2), np.int64), stops[:-1]]
        length = stops - starts
        linked = length.sum(axis=1) - 1  # no inner end is common, so each token after the first of either side adds a link
        upto = np.cumsum(linked)
        step = np.arange(upto[-1]) - np.repeat(upto - linked, linked)
        pair = np.repeat(starts, linked, axis=0) + np.where(np.repeat(length, linked, axis=0) > 1, step[:, None], 0)
        for k in np.flatnonzero(length.min(axis=1) > 1).tolist():
            (i, j), (stop_a, stop_b) = starts[k].tolist(), stops[k].tolist()
            own = links(sizes_a[i:stop_a], sizes_b[j:stop_b], [(stop_a - i, stop_b - j)])
            pair[upto[k] - linked[k] : upto[k]] = np.array(own, np.int64) + starts[k]
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        codes = ids_b[pair[:, 1]] << 32 | ids_a[pair[:, 0]]
        # The last group of a piece is the one that ends where the piece does.
        last = np.searchsorted(np.cumsum(sizes_a)[stops[:, 0] - 1], np.cumsum([len(w) for w in wanted])) + 1
        table = np.c_[stops, np.arange(1, len(stops) + 1), upto][last - 1]
        groups, low, strings = shown(a, b, found).split(";"), 0, []
        for high in last.tolist():
            strings.append(";".join(groups[low:high]))
            low = high
        return strings, codes, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int64))

    def aligned(self, texts: list[str]) -> list[tuple]:
        """(tokens of A, tokens of B, groups, links, groups as text, codes of the links) of each text.

        A link's code is B's id in the upper and A's id in the lower 32 bits. An empty text has no tokens.
        """
        if len(self.known) > KNOWN_PIECES or self.held > KNOWN_CHARS:
            self._forget()
        rows, fresh = [], []
        for text in texts:
            pieces = text.split(" ") if text and self.by_pieces else []
            row = list(map(self.known.get, pieces))
            if None in row:
                for k, piece in enumerate(pieces):
                    if row[k] is None:
                        at = self.known.get(piece)
                        if at is None:
                            at = self.known[piece] = len(self.known)
                            fresh.append(piece)
                            self.held += len(piece)
                        row[k] = at
            rows.append(row)
        if fresh:
            self._learn(fresh)
        out = []
        for text, row in zip(texts, rows, strict=True):
            parts = [self.shown[k] for k in row]
            if not text:
                out.append((0, 0, 0, 0, "", np.zeros(0, np.int64)))
            elif not parts or None in parts:
                out.append(self._whole(text))
            else:
                at = np.array(row, np.int64)
                low = self.offsets[at]
                codes = gather(self.flat, low, self.offsets[at + 1] - low)
                out.append((*self.counts[at].sum(axis=0).tolist(), ";".join(parts), codes))
        return out

    def _whole(self, text: str) -> tuple:
        spelled = self.ids(text)
        if spelled is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64)
        a, b = spelled
        found, linked = self.groups(a, b)
        codes = np.array([b[j] << 32 | a[i] for i, j in linked], np.int64)
        return len(a), len(b), len(found), len(linked), shown(a, b, found), codes


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _meets_blank(piece: str) -> bool:
    """Whether the piece brings white space next to the space before or after it."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def aligner(path_a: str, path_b: str) -> Aligner:
    """The pair of tokenizers, loaded once in each Python worker."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_ids, b_ids, groups and links of every document.

    ``groups`` holds, for each group, how many tokens of A and of B it and those before it take; ``links`` the numbers,
    from 0, of an A and a B token whose bytes overlap. Both sides encode a space and the text; special tokens' strings
    are plain text. A null or empty text, or one that a side does not spell byte for byte, has empty lists. Repeated
    rows stay repeated, null ids are kept, further columns are ignored, an empty table gives an empty result. Both
    paths must be readable on every executor.
    """
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("groups", pair), ("links", pair)]
    )

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in slices(batches, 64):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                a, b = (own.ids(text) if text else None) or ([], [])
                found, linked = own.groups(a, b)
                as_rows = [[{"a": i, "b": j} for i, j in x] for x in (found, linked)]
                rows.append((key, a, b, *as_rows))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    both = "array<struct<a: int, b: int>>"
    return documents(docs).mapInArrow(run, f"doc_id long, a_ids array<int>, b_ids array<int>, groups {both}, links {both}")


_BLOCKS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("block", pa.int64()),
        ("at", pa.list_(pa.int32())),
        ("often", pa.list_(pa.int32())),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
    ]
)
_BLOCK_SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, at array<int>, "
    "often array<int>, pairs array<long>, times array<long>"
)


def _block_rows(block: int, rows: list[tuple]) -> Iterable[pa.RecordBatch]:
    """A block's documents with their pairs as numbers in its dictionary, which the last row carries."""
    codes = np.concatenate([r[6] for r in rows])
    pairs, number, times = np.unique(codes, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(rows)), [len(r[6]) for r in rows])
    held, often = np.unique(doc * max(len(pairs), 1) + number, return_counts=True)
    doc, number = np.divmod(held, max(len(pairs), 1))
    bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
    for low in range(0, len(rows), 256):
        high = min(low + 256, len(rows))
        some, span = rows[low:high], slice(bounds[low], bounds[high])
        upto = pa.array(bounds[low : high + 1] - bounds[low], pa.int32())
        plain = [pa.array(c, f.type) for c, f in zip(list(zip(*some, strict=True))[:6], _BLOCKS, strict=False)]
        coded = [pa.ListArray.from_arrays(upto, pa.array(x[span], pa.int32())) for x in (number, often)]
        last = high == len(rows)
        words = [pa.array([None] * (high - low - last) + [x] * last, pa.list_(pa.int64())) for x in (pairs, times)]
        blocks = pa.array(np.full(high - low, block, np.int64))
        yield pa.RecordBatch.from_arrays([*plain, blocks, *coded, *words], schema=_BLOCKS)


def coded_blocks(docs: DataFrame, path_a: str, path_b: str, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every document aligned, its id pairs coded by a dictionary of its block; written once to the shared folder."""

    def run(batches):
        own, task, made, rows, held = aligner(path_a, path_b), TaskContext.get().partitionId(), 0, [], 0
        for batch in slices(batches, 64):
            keys, texts = batch.column(0).to_pylist(), texts_of(batch)
            for key, (*counts, text, codes) in zip(keys, own.aligned(texts), strict=True):
                digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
                rows.append((key, *counts, digest, codes))
            held += sum(map(len, texts))
            if held >= block_chars:
                yield from _block_rows(task << 32 | made, rows)
                made, rows, held = made + 1, [], 0
        if rows:
            yield from _block_rows(task << 32 | made, rows)

    return stored(documents(docs).mapInArrow(run, _BLOCK_SCHEMA), "aligned")


def _with_sums(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of a block with what the sums of its pairs say of their links."""
    total, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, bool)
    at = sums.column("pos").to_numpy()
    total[at], best[at] = sums.column("total").to_numpy(), sums.column("best").to_numpy()
    lists = docs.column("at").combine_chunks(), docs.column("often").combine_chunks()
    number, often = (x.flatten().to_numpy() for x in lists)
    doc = np.repeat(np.arange(docs.num_rows), np.asarray(lists[0].value_lengths()))
    n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    np.add.at(n_best, doc, often.astype(np.int64) * best[number])
    np.add.at(count_sum, doc, often.astype(np.int64) * total[number])
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
    return kept.append_column("groups_sha256", docs.column("groups_sha256"))


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in the corpus, and whether none of its B id's pairs has more."""
    pairs = blocks.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    totals = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total"))
    # One row for each id of B's vocabulary, so its size is bounded by the tokenizer, whatever the corpus.
    most = totals.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("total").alias("most"))
    joined = totals.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("b"))
    return joined.select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``n_best`` counts the links whose id pair no other A id beats for its B id in the whole corpus, ties included;
    ``count_sum`` adds up the corpus counts of the document's links. The digest is of the groups as ``a1,a2|b1;a3|b2``.
    The cases are those of ``align``; a document without tokens has zeros and an empty digest.
    """
    blocks = coded_blocks(docs, path_a, path_b, block_chars=block_chars)
    own = blocks.filter("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("pos", "pair"))
    sums = own.join(link_counts(blocks), "pair").select("of", "pos", "total", "best")
    rows = blocks.drop("pairs", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(sums.groupBy("of")).applyInArrow(_with_sums, schema)
