"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Splitting a text into words is independent of the merges, and every occurrence of a word merges alike. Each task
therefore collects the distinct words of its block of documents into one array of byte tokens and replays the
merges over that array: an inverted index maps the rank of a token pair to the positions where the pair stands; the
lowest rank is taken, all its positions are merged at once, and only the pairs touching a merged place are looked up
again. Documents are then put together from their words' ids. Nothing is shuffled.

A merge can, for odd vocabularies, create a pair that ranks below the one being applied. Applying one rank
everywhere would then differ from merging word by word; such words are noticed and merged again one by one.
"""

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ripplewatch.llm.common import documents, slices, texts_of

NONE = np.int32(2**31 - 1)
BLOCK_CHARS = 8 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict = {}


class Vocabulary:
    """Ranks of byte strings and the table of pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self._fill(keys, np.array(made, np.int32))

    def _fill(self, keys, made) -> None:
        """An open-addressing table, filled and read by whole arrays."""
        bits = max(8, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.made = np.full(1 << bits, NONE)
        slots = (keys * _MULTIPLIER >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[todo], return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            at = todo[wins]
            self.keys[slots[at]], self.made[slots[at]] = keys[at], made[at]
            todo = todo[~wins]
            slots[todo] = np.where(self.keys[slots[todo]] != keys[todo], (slots[todo] + 1) & self.mask, slots[todo])

    def merged(self, a, b):
        """Rank of the token that each pair makes, NONE where it makes none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slots = (keys * _MULTIPLIER >> self.shift).astype(np.int64)
        out = np.full(len(keys), NONE)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.keys[slots[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.made[slots[todo[hit]]]
            todo = todo[~hit & (seen != np.uint64(2**64 - 1))]
            slots[todo] = (slots[todo] + 1) & self.mask
        return out

    def one_by_one(self, word: bytes) -> list[int]:
        """The plain definition: merge the lowest-ranking pair, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], int(NONE)), i) for i in range(len(parts) - 1)
            )
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def load_ranks(path: str) -> Vocabulary:
    """The vocabulary of a file of base64 pieces and ranks; read once in each Python worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = Vocabulary(ranks)
    return _loaded[path]


def _groups(ranks, positions):
    """(rank, its positions) for every distinct rank."""
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.flatnonzero(np.diff(ranks)) + 1
    return zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True)


def replay(words: list[bytes], vocabulary: Vocabulary):
    """Token ids of all words, concatenated, and the offset of each word's first id (one more at the end)."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(words) else 0
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    token = vocabulary.bytes[np.frombuffer(b"".join(words), np.uint8)]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    full = lengths > 0
    after[ends[full] - 1] = -1
    before[(ends - lengths)[full]] = -1
    rank = np.full(n, NONE)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = vocabulary.merged(token[inner], token[inner + 1])
    live = np.flatnonzero(rank != NONE)
    index: dict[int, list] = {}
    if len(live):
        for r, at in _groups(rank[live], live):
            index[r] = [at]
    heap = sorted(index)
    odd = []
    while heap:
        now = heapq.heappop(heap)
        found = index.pop(now)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[rank[at] == now]
        if not len(at):
            continue
        if len(at) > 1:
            # Of pairs that overlap, the leftmost merges and takes the token it shares with the next.
            shared = np.r_[False, after[at[:-1]] == at[1:]]
            if shared.any():
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(shared, 0, place))
                at = at[(place - head) % 2 == 0]
        gone = after[at]
        following = after[gone]
        token[at], token[gone], rank[gone] = now, -1, NONE
        after[at] = following
        linked = following >= 0
        before[following[linked]] = at[linked]
        previous = before[at]
        touched = np.concatenate([at, previous[previous >= 0]])
        if len(touched) > 1:
            touched = np.unique(touched)
        nexts = after[touched]
        made = np.full(len(touched), NONE)
        paired = nexts >= 0
        made[paired] = vocabulary.merged(token[touched[paired]], token[nexts[paired]])
        rank[touched] = made
        keep = made != NONE
        if not keep.any():
            continue
        below = keep & (made < now)
        if below.any():
            odd.append(touched[below])
        for r, where in _groups(made[keep], touched[keep]):
            if r in index:
                index[r].append(where)
            else:
                index[r] = [where]
                heapq.heappush(heap, r)
    kept = token >= 0
    counts = np.r_[0, np.cumsum(kept)]
    offsets = np.r_[0, counts[ends]]
    ids = token[kept]
    if odd:
        which = np.unique(np.searchsorted(ends, np.concatenate(odd), side="right"))
        pieces = np.split(ids, offsets[1:-1])
        for w in which.tolist():
            pieces[w] = np.array(vocabulary.one_by_one(words[w]), np.int32)
        ids = np.concatenate(pieces)
        offsets = np.r_[0, np.cumsum([len(p) for p in pieces])]
    return ids, offsets


def _gather(flat, offsets, picks):
    """The concatenated slices of ``flat`` that ``picks`` names."""
    lengths = (offsets[1:] - offsets[:-1])[picks]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(offsets[:-1][picks] - (ends - lengths), lengths)], ends


def encode_blocks(batches, vocabulary_of, pattern: str, block_chars: int):
    """(doc_ids, ids, ends) for each block of documents in a task."""
    words_of = regex.compile(pattern).findall

    def finish(keys, rows, known):
        flat, offsets = replay([w.encode("utf-8", "surrogatepass") for w in known], vocabulary_of())
        picks = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        ids, word_ends = _gather(flat, offsets, picks)
        upto = np.cumsum([len(r) for r in rows])
        ends = np.r_[0, word_ends][upto] if len(rows) else np.zeros(0, np.int64)
        return keys, ids, ends

    keys, rows, known, held = [], [], {}, 0
    for batch in slices(batches):
        for key, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            rows.append(np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int32))
            keys.append(key)
            held += len(text)
            if held >= block_chars:
                yield finish(keys, rows, known)
                keys, rows, known, held = [], [], {}, 0
    if keys:
        yield finish(keys, rows, known)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id and its token ids.

    A null text is empty and has no ids; equal texts have equal ids; repeated rows stay repeated; a null doc_id is
    kept. Further columns of ``docs`` are ignored. An empty table gives an empty result. ``ranks_path`` must be
    readable on every executor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for keys, ids, ends in encode_blocks(batches, lambda: load_ranks(ranks_path), pattern, block_chars):
            for start in range(0, len(keys), 256):
                stop = min(len(keys), start + 256)
                low = int(ends[start - 1]) if start else 0
                cuts = np.r_[low, ends[start:stop]] - low
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids[low : low + cuts[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[start:stop], pa.int64()), lists], schema=schema)

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes that each row's ids stand for; null or empty ids give empty bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        for batch in batches:
            vocabulary = load_ranks(ranks_path)
            made = [vocabulary.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, *, block_chars: int = BLOCK_CHARS, with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): ``encode`` and ``decode`` in one pass, with digests.

    The same cases as for ``encode``: an empty or null text has no tokens and the digest of no bytes.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    shown = len(names) - (not with_ids)

    def run(batches):
        vocabulary = load_ranks(ranks_path)
        for keys, ids, ends in encode_blocks(batches, lambda: vocabulary, pattern, block_chars):
            rows, low = [], 0
            for key, high in zip(keys, ends.tolist(), strict=True):
                own = ids[low:high]
                coded = hashlib.sha256(own.astype("<u4").tobytes()).hexdigest()
                decoded = hashlib.sha256(vocabulary.decode(own.tolist())).hexdigest()
                rows.append((key, high - low, coded, decoded, own))
                low = high
            for start in range(0, len(rows), 256):
                columns = list(zip(*rows[start : start + 256], strict=True))[:shown]
                made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(made, names=names[:shown])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents(docs).mapInArrow(run, schema + ", ids array<int>" * with_ids)
