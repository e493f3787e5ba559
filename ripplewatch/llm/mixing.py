"""Mixing sources to target weights: fixed-length blocks of words, drawn source by source into output shards.

The words of a source form one stream, in an order that depends on the rows alone, and the stream is cut into blocks of a
fixed number of words; the last may be shorter. Places in the stream are prefix sums: rows are dealt by hash into cells of
a few thousand, cells are summed, and only the sums of cells are added up along a source. A source that holds a third of
all rows is thus many cells.

Every shard draws how many of its slots go to each source from a multinomial distribution with a seed of its own. Running
sums of the draws number the slots of each source, and slot ``q`` of a source with ``n`` blocks takes block
``p(q mod n)`` of a pseudorandom permutation, one for each round ``q div n``. So a source is read whole before any block
comes again. Draws alone would miss the targets by their standard deviation: slots beyond a source's total are left out,
what it still lacks fills shards of its own at the end, and its last slot takes only as many words as the total wants.
A source hence gives its target to the word, and no document more often than the rounds, of which there are three at most.

Slots and blocks then meet in a join on source and block number.
"""

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplewatch.llm.bytetext import mix as spread
from ripplewatch.llm.common import documents, slices, stored

#: What a word is, the weights dealt to sources in order, and how often a source may be repeated.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3

BLOCK_WORDS = 256
SHARD_SLOTS = 16_384
CELL_ROWS = 4096
MOST_SOURCES = 1_000_000
_ROUNDS = 4


@dataclass
class Share:
    """A source's part of the mix: its rank, words, blocks, and the words and slots that the mix takes from it."""

    source: str | None
    number: int
    size: int
    target: Fraction
    block_words: int
    seed: int

    def __post_init__(self):
        self.blocks = -(-self.size // self.block_words)
        self.words = round(self.target)
        rounds, rest = divmod(self.words, self.size) if self.size else (0, 0)
        self.slots, self.last = rounds * self.blocks, self.block_words
        if rest:
            # The short block of the stream may be among those that the last round begins with.
            short = self.blocks * self.block_words - self.size
            at = int(permuted([self.blocks - 1], [self.blocks], [self.number], [rounds], self.seed, inverse=True)[0])
            used = -(-rest // self.block_words)
            if at < used:
                used = -(-(rest + short) // self.block_words)
            held = used * self.block_words - (short if at < used else 0)
            ends_short = at == used - 1
            self.slots += used
            self.last = (self.block_words - short if ends_short else self.block_words) - (held - rest)


def shares(
    sizes: dict[str | None, int],
    *,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
) -> list[Share]:
    """Targets of all sources, in order of code points with null last, to which the weights are dealt in turn.

    Targets share the sum of all sizes by weight; one above ``repeats`` times its source's size stops there, and what it
    leaves is shared again by weight until none is above: all others stand at one level for each unit of weight.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_weight, level = Fraction(sum(sizes.values())), sum(weight.values()), Fraction(0)
    capped = set()
    for s in sorted(names, key=lambda s: Fraction(repeats * sizes[s], weight[s])):
        level = left / open_weight
        if repeats * sizes[s] > level * weight[s]:
            break
        capped.add(s)
        left, open_weight = left - repeats * sizes[s], open_weight - weight[s]
    targets = {s: Fraction(repeats * sizes[s]) if s in capped else level * weight[s] for s in names}
    return [Share(s, k, sizes[s], targets[s], block_words, seed) for k, s in enumerate(names)]


def permuted(place, n, source, turn, seed: int, *, inverse: bool = False) -> np.ndarray:
    """Where each ``place`` of ``range(n)`` goes under the permutation of its source and turn.

    A balanced Feistel network over the next even number of bits, walked until it comes back below ``n``.
    """
    at, n, source, turn = (np.asarray(x, np.uint64) for x in (place, n, source, turn))
    bits = np.maximum(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2), 1).astype(np.uint64)
    bits += (np.uint64(1) << (2 * bits)) < n
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = spread(spread(spread(np.full(len(at), seed, np.uint64) + np.uint64(1)) + source) + turn)
    out, todo = at.copy(), np.arange(len(at))
    rounds = range(_ROUNDS - 1, -1, -1) if inverse else range(_ROUNDS)
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for step in rounds:
            if inverse:
                left, right = right ^ spread(left + k + np.uint64(step)) & m, left
            else:
                left, right = right, left ^ spread(right + k + np.uint64(step)) & m
        out[todo] = left << b | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def word_counts(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, source, size, a hash that orders equal ids, and columns to carry: one pass over the texts, stored."""
    text, source = documents(docs, F.col("source").cast("string").alias("source")), ["doc_id", "source"]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return stored(text.select(*source, size, F.xxhash64("text").alias("order"), *carried), "sizes")


def source_shares(sized: DataFrame, *, block_words: int = BLOCK_WORDS, seed: int = 0, most_sources: int = MOST_SOURCES):
    """The sources' shares, from a sum for each. More than ``most_sources`` of them are refused, since every shard draws
    from the whole list of weights and thus needs it."""
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    n = sums.count()
    if n > most_sources:
        raise ValueError(f"{n} sources; a mix takes {most_sources} at most")
    return shares({r.source: r.size for r in sums.collect()}, block_words=block_words, seed=seed)


def _share_table(sized: DataFrame, found: list[Share]) -> DataFrame:
    rows = [(s.source, s.number, s.size, float(s.target), s.blocks, s.slots, s.last) for s in found]
    kinds = "source string, number long, source_size long, target double, blocks long, slots long, last long"
    return sized.sparkSession.createDataFrame(rows, kinds)


def placed(sized: DataFrame, table: DataFrame, *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``sized`` with the source's number, sums and the place ``start`` of each row's first word in its source's stream."""
    cells = max(1, -(-sized.count() // cell_rows))
    rows = sized.withColumn("cell", F.pmod(F.xxhash64("doc_id", "order"), F.lit(cells)))
    # One row for each source, at most ``most_sources``.
    rows = rows.join(F.broadcast(table), rows.source.eqNullSafe(table.source)).drop(table.source)
    before = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("number", "cell").agg(F.sum("size").alias("held"))
    base = sums.select("number", "cell", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", "cell").orderBy("doc_id", "order").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.join(base, ["number", "cell"]).withColumn("start", F.col("base") + running).drop("base", "cell", "order")


def shard_draws(found: list[Share], table: DataFrame, *, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, number, first, count): slots of each shard that go to each source, and the number of the first of them.

    Every shard draws its counts by itself; the shards at the end hold what the draws left of the sources' totals.
    """
    spark, slots = table.sparkSession, np.array([s.slots for s in found], np.int64)
    total = int(slots.sum())
    kinds = "shard long, number long, first long, count long"
    if not total:
        return spark.createDataFrame([], kinds)
    shards, chances = -(-total // shard_slots), slots / total

    def draw(frames):
        for frame in frames:
            for shard in frame["id"].tolist():
                rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
                got = rng.multinomial(min(shard_slots, total - shard * shard_slots), chances)
                at = np.flatnonzero(got)
                yield pd.DataFrame({"shard": shard, "number": at, "drawn": got[at]})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, number long, drawn long")
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    totals = {r.number: r.n for r in drawn.groupBy("number").agg(F.sum("drawn").alias("n")).collect()}  # by source
    rest, shard, room = [], shards, shard_slots
    for s in found:
        first = totals.get(s.number, 0)
        while first < s.slots:
            count = min(room, s.slots - first)
            rest.append((shard, s.number, first, count))
            first, room = first + count, room - count
            if not room:
                shard, room = shard + 1, shard_slots
    # One row for each source, at most ``most_sources``.
    drawn = drawn.join(F.broadcast(table.select("number", "slots")), "number")
    kept = drawn.select("shard", "number", "first", F.least(F.col("drawn"), F.col("slots") - F.col("first")).alias("count"))
    return kept.filter("count > 0").unionByName(spark.createDataFrame(rest, kinds))


def mixed_slots(draws: DataFrame, table: DataFrame, *, seed: int = 0) -> DataFrame:
    """(shard, number, slot, block, used): the block that every slot of a source takes, and how many of its words."""

    @F.pandas_udf("long")
    def block(q: pd.Series, n: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(permuted(q % n, n, number, q // n, seed))

    of = table.select("number", "blocks", "slots", "last")
    # One row for each source, at most ``most_sources``.
    slots = draws.join(F.broadcast(of), "number").withColumn("slot", F.explode(F.sequence("first", F.expr("first + count - 1"))))
    used = F.when(F.col("slot") == F.col("slots") - 1, F.col("last"))
    return slots.select("shard", "number", "slot", block("slot", "blocks", "number").alias("block"), used.alias("used"))


def taken_words(
    docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, cell_rows: int = CELL_ROWS, seed: int = 0
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words that the mix takes of every row, with repeats.

    A null text has no words, a null source is a source of its own, after the others; rows without words take none.
    Repeated rows stay repeated and have places of their own in the stream. Reruns agree, whatever the partitioning.
    An empty table gives an empty result; further columns are ignored.
    """
    sized = word_counts(docs)
    found = source_shares(sized, block_words=block_words, seed=seed)
    table = _share_table(sized, found)
    rows = placed(sized, table, cell_rows=cell_rows)
    slots = mixed_slots(shard_draws(found, table, shard_slots=shard_slots, seed=seed), table, seed=seed)
    uses = slots.groupBy("number", "block").agg(
        F.count(F.when(F.col("used").isNull(), 1)).alias("full"), F.max("used").alias("cut")
    )
    end, width = F.col("start") + F.col("size"), F.lit(block_words)
    first, last = F.floor(F.col("start") / width), F.floor((end - 1) / width)
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * width)
    pieces = pieces.withColumn("length", F.least(end, (F.col("block") + 1) * width) - low)
    pieces = pieces.withColumn("offset", low - F.col("block") * width).join(uses, ["number", "block"], "left")
    part = F.greatest(F.lit(0), F.least(F.col("length"), F.col("cut") - F.col("offset")))
    words = F.coalesce(F.col("full") * F.col("length"), F.lit(0)) + F.when(F.col("cut").isNull(), 0).otherwise(part)
    shown = ["doc_id", "source", "size", "source_size", "target"]
    full = pieces.groupBy("number", "start", *shown).agg(F.sum(words).alias("taken")).select(*shown, "taken")
    return full.unionByName(rows.filter("size = 0").select(*shown, F.lit(0).cast("long").alias("taken")))


def mix(
    docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, cell_rows: int = CELL_ROWS, seed: int = 0
) -> DataFrame:
    """The mix itself: (shard, source, slot, n_words, text), a row for each slot with its words joined by spaces.

    The cases are those of ``taken_words``, which counts what this writes.
    """
    sized = word_counts(docs, "text")
    found = source_shares(sized, block_words=block_words, seed=seed)
    table = _share_table(sized, found)
    rows = placed(sized, table, cell_rows=cell_rows).filter("size > 0").select("number", "source", "start", "text")
    slots = mixed_slots(shard_draws(found, table, shard_slots=shard_slots, seed=seed), table, seed=seed)
    kinds = "number long, source string, block long, offset long, words array<string>"
    schema = pa.schema(
        [("number", pa.int64()), ("source", pa.string()), ("block", pa.int64()), ("offset", pa.int64()), ("words", pa.list_(pa.string()))]
    )

    def cut(batches):
        import re

        words_of = re.compile(WORD).findall
        for batch in slices(batches, 64):
            pieces = []
            for number, source, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, at = words_of(text), 0
                while at < len(words):
                    block, offset = divmod(start + at, block_words)
                    pieces.append((number, source, block, offset, words[at : at + block_words - offset]))
                    at += block_words - offset
            for low in range(0, len(pieces), 1024):
                columns = zip(*pieces[low : low + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # A group is one block, hence at most ``block_words`` pieces.
    blocks = rows.mapInArrow(cut, kinds).groupBy("number", "source", "block")
    whole = blocks.agg(F.flatten(F.sort_array(F.collect_list(F.struct("offset", "words")))["words"]).alias("words"))
    joined = slots.join(whole, ["number", "block"])
    kept = F.when(F.col("used").isNull(), F.col("words")).otherwise(F.slice("words", F.lit(1), F.col("used").cast("int")))
    return joined.select("shard", "source", "slot", kept.alias("kept")).select(
        "shard", "source", "slot", F.size("kept").cast("long").alias("n_words"), F.concat_ws(" ", "kept").alias("text")
    )
