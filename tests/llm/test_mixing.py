"""Mixing: targets against the plain rule, permutations, and the counted words against the mix that is written."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplewatch.llm import mixing


def plain_targets(sizes):
    """The rule as it is told: share by weight, stop at three times the size, share the excess again."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, excess = dict.fromkeys(names, Fraction(0)), Fraction(sum(sizes.values()))
    while excess:
        free = [s for s in names if target[s] < 3 * sizes[s]]
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / total
        excess = Fraction(0)
        for s in names:
            over = max(Fraction(0), target[s] - 3 * sizes[s])
            target[s], excess = target[s] - over, excess + over
    return target


names = st.one_of(st.none(), st.text(max_size=3))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(names, st.integers(0, 500), max_size=12), st.integers(1, 60))
def test_targets_and_slots(sizes, block):
    found = mixing.shares(sizes, block_words=block)
    want = plain_targets(sizes)
    assert {s.source: s.target for s in found} == want
    for s in found:
        lengths = [min(block, s.size - k * block) for k in range(s.blocks)]
        taken = Counter()
        for q in range(s.slots):
            turn, place = divmod(q, s.blocks)
            at = int(mixing.permuted([place], [s.blocks], [s.number], [turn], 0)[0])
            taken[at] += s.last if q == s.slots - 1 and s.words % s.size else lengths[at]
            assert 0 < s.last <= block
        assert sum(taken.values()) == s.words and abs(s.words - s.target) <= Fraction(1, 2)
        assert all(taken[k] <= 3 * lengths[k] for k in taken)


def test_permutations():
    for n in (1, 2, 3, 4, 5, 16, 17, 100, 1023, 4097):
        whole = np.arange(n)
        args = np.full(n, n), np.full(n, 3), np.full(n, 1), 9
        there = mixing.permuted(whole, *args)
        assert sorted(there) == list(range(n))
        assert (mixing.permuted(there, *args, inverse=True) == whole).all()


def source_table(spark, rows):
    text = [(k, t, s, "en", 1, 2, 3) for k, t, s in rows]
    return spark.createDataFrame(text, "doc_id long, text string, source string, size string, start int, block int, number int")


def test_mix(spark, rows):
    sources = ["b", "a", None, "A", "é", "hot", "hot", "hot", "hot"]
    some = [(k, t, sources[n % 9]) for n, (k, t) in enumerate(rows)]
    some += [(900, "tiny one", "t"), (901, None, "none"), (902, " ", "none")]
    some += [(None, "w%d w w" % k, "hot") for k in range(20)] + [(903, "again x", "hot")] * 5
    options = {"block_words": 16, "shard_slots": 40, "cell_rows": 7}
    first = mixing.taken_words(source_table(spark, some).repartition(5), **options).collect()
    again = mixing.taken_words(source_table(spark, some[::-1]).repartition(2), **options).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in first) == Counter((k, s, size(t)) for k, t, s in some)
    sums, taken = Counter(), Counter()
    for k, t, s in some:
        sums[s] += size(t)
    target = plain_targets(sums)
    for r in first:
        assert r.source_size == sums[r.source] and r.target == float(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == round(target[s]) for s in sums)
    made = mixing.mix(source_table(spark, some).repartition(3), **options).collect()
    written = Counter()
    for r in made:
        assert r.n_words == size(r.text) <= 16
        written.update((r.source, w) for w in r.text.split(" "))
    whole = Counter()
    for r in made:
        whole[r.shard] += 1
    assert max(whole.values()) <= 40
    # Words that stand in one document only tell how often the mix takes that document.
    where = Counter((s, w) for _, t, s in some for w in set(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    for r in first:
        if r.doc_id is not None and r.doc_id < 40:
            text = next(t for k, t, _ in some if k == r.doc_id)
            own = re.findall(r"[^\x20\x09-\x0D]+", text)
            if own and all(where[r.source, w] == 1 for w in own):
                assert sum(written[r.source, w] for w in set(own)) == r.taken
    assert sum(written.values()) == sum(taken.values())


def test_nothing_to_mix(spark):
    assert mixing.taken_words(source_table(spark, [])).collect() == []
    assert mixing.mix(source_table(spark, [])).collect() == []
    got = mixing.taken_words(source_table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r.doc_id, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_too_many_sources_are_refused(spark):
    import pytest

    sized = mixing.word_counts(source_table(spark, [(1, "a", "x"), (2, "b", "y")]))
    with pytest.raises(ValueError, match="2 sources"):
        mixing.source_shares(sized, most_sources=1)
