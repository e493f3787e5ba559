"""Operators over whole corpora against brute force: repeats, containment, similarity, components, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplewatch.llm import decontaminate, ngramjoin, suffixes
from ripplewatch.llm.components import components


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- repeated byte strings


def repeats_by_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(int)) == 1))
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_repeated_strings_by_brute_force(docs, rows):
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixes.remove_repeats(docs, buckets=3).collect()]
    want = [(key, *found) for (key, _), found in zip(rows, repeats_by_force([t for _, t in rows], 200), strict=True)]
    assert by_repr(got) == by_repr(want)
    assert any(w[2] for w in want)


def test_repeated_strings_in_overlapping_and_periodic_texts(spark):
    r = random.Random(3)
    base = "".join(r.choice("ab") for _ in range(900))
    texts = [base, base[100:500] + "x" + base[300:700], "ab" * 400, "ab" * 101, "q" * 199, "q" * 200, "q" * 201, base[:199], base[5:205]]
    texts += [base[k * 40 : k * 40 + 260] + str(k) for k in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffixes.remove_repeats(frame, buckets=2).collect()}
    assert [got[k] for k in range(len(texts))] == repeats_by_force(texts, 200)


def test_a_document_longer_than_a_block(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghij ") for _ in range(1_300_000))
    copy = "".join(r.choice("abcdefghij ") for _ in range(3000)) + long[524_000:524_700] + "!"
    frame = spark.createDataFrame([(1, long), (2, copy)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(frame).collect()}
    assert got == {1: (700, 1), 2: (700, 1)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=8))
def test_suffix_order_finds_equal_windows(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    length, starts, at = 9, [], 0
    for t in texts:
        starts += range(at, at + len(t) - length + 1)
        at += len(t)
    raw = data.tobytes()
    seen = Counter(raw[s : s + length] for s in starts)
    got = suffixes.repeated_windows(data, np.array(starts, np.int64), length)
    assert got.tolist() == [seen[raw[s : s + length]] > 1 for s in starts]


def test_family_levels_grow_geometrically():
    family, r = suffixes.Family(), np.random.default_rng(1)
    for _ in range(40):
        batch = np.zeros(16, suffixes._ENTRY)
        batch["key"], batch["zone"], batch["doc"] = r.integers(0, 90, 16), r.integers(0, 4, 16), r.integers(0, 99, 16)
        batch = batch[np.lexsort((batch["zone"], batch["key"]))]
        _, first = np.unique(batch[["key", "zone"]], return_index=True)
        family.add(batch[first])
        sizes = [len(level) for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))


def _one_line_in_many_places():
    """A line in different surroundings: most share less than a window with any other, some share one or more."""
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    pool, left, right = text(20_000), text(150), text(150)
    at = int(suffixes.anchors(np.frombuffer(pool.encode(), np.uint8), np.array([0, 20_000]), 20_000)[3][0])
    line = pool[at - 14 : at + 46]  # its middle is an anchor wherever it stands
    texts = [text(170) + line + text(170) for _ in range(60)]
    texts += [text(90) + left[-80:] + line + right[:80] + text(90) for _ in range(5)]
    texts += [text(50) + left + line + text(150) for _ in range(3)] + [text(150) + line + right + text(50) for _ in range(3)]
    return texts + [texts[0], texts[0][40:], text(500)]


@pytest.mark.parametrize("split", [10**9, 1])
def test_hot_keys_are_settled_by_window(spark, monkeypatch, split):
    monkeypatch.setattr(suffixes, "SAMPLED", 1)
    texts = _one_line_in_many_places()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = suffixes.remove_repeats(frame, buckets=3, hot=4, split=split)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in out.collect()}
    want = repeats_by_force(texts, 200)
    assert [got[k] for k in range(len(texts))] == want
    assert 8 <= sum(w[1] > 0 for w in want) < 20


def test_no_task_holds_all_zones_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLED", 1)
    frame = spark.createDataFrame(list(enumerate(_one_line_in_many_places())), "doc_id long, text string")
    rows = frame.withColumn("_row", F.xxhash64("doc_id", "text")).repartition(4)
    zones, listed = suffixes.hot_keys(rows, 200, 40)
    assert len(listed) and zones > len(listed)

    def held(dealt):
        """The largest share of one bucket in the entries of the listed keys."""
        found = Counter()
        for r in dealt.filter("known = 0").collect():
            entries = np.frombuffer(r["run"], suffixes._ENTRY)
            found[r["bucket"]] += int(np.isin(entries["key"], listed[:1]).sum())
        return max(found.values()) / sum(found.values())

    assert held(suffixes.index(rows, 200, 8)) == 1.0
    assert held(suffixes.index(rows, 200, 8, listed)) < 0.5
    spans = suffixes.scan(suffixes.index(rows, 200, 8, listed), 4, listed)
    parts = suffixes.fetch(rows, spans, 200, 8, 8).filter("kind = 3").collect()
    size = Counter()
    for r in parts:
        size[r["bucket"]] += len(r["heads"])
    assert len(size) == 8 and max(size.values()) < 2 * sum(size.values()) / 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40))), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40))))
def test_entries_are_found_by_key_and_zone(one, two):
    def entries(pairs):
        made = np.zeros(len(set(pairs)), suffixes._ENTRY)
        for k, (key, zone) in enumerate(sorted(set(pairs))):
            made[k]["key"], made[k]["zone"] = key, zone
        return made

    known = sorted(set(one))
    want = [known.index(p) if p in known else -1 for p in sorted(set(two))]
    assert suffixes._find(entries(one), entries(two)).tolist() == want


def test_stage_form_keeps_rows_and_columns(docs, rows):
    out = suffixes.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == len(rows)
    assert out.filter("text is not null and n_chars != char_length(text)").count() == 0


# --- benchmark windows


def contamination_by_force(texts, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        said = word.findall(lower(text))
        for k in range(max(1, len(said) - width + 1) if said else 0):
            windows.setdefault(tuple(said[k : k + width]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        said = word.findall(lower(text))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(said) - size + 1):
                if tuple(said[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(said[k : k + size])]
        out.append((len(said), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contamination_by_brute_force(spark, docs, rows, block_bytes):
    texts = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(k, " ".join(t.split()[5 : 5 + 9 + 3 * k])) for k, t in enumerate(texts[:8])]
    items += [(2, "one"), (None, "two words"), (77, None), (78, ""), (79, " ... "), (3, texts[0]), (3, texts[0]), (80, "A a, A!")]
    items += [(81, texts[9].split()[0] + " " + texts[9].split()[1] + " " + texts[9].split()[2])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string")
    got = decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()
    want = [(k, *found) for (k, _), found in zip(rows, contamination_by_force([t for _, t in rows], items, 10), strict=True)]
    assert by_repr(got) == by_repr(want)
    clean = decontaminate.uncontaminated(docs, bench, block_bytes=block_bytes)
    assert clean.schema == docs.schema
    assert by_repr(r["doc_id"] for r in clean.select(F.struct("doc_id").alias("doc_id")).collect()) == by_repr(
        [(w[0],) for w in want if not w[2]]
    )
    digest = decontaminate.digest(decontaminate.contamination(docs, bench.limit(0))).collect()
    assert {r["n_hit"] for r in digest} == {0} and digest[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()


# --- similar documents


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def components_by_force(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    return [(key, len(sets[k]), least.get(find(k)) if sets[k] else key) for k, (key, _) in enumerate(rows)]


def chain_rows():
    """Texts that drift a few words at a time, so that ends of a chain are linked only by way of others."""
    r = random.Random(8)
    now, out = [f"w{k}" for k in range(60)], []
    for k in range(30):
        out.append((1000 + k, " ".join(now)))
        now = [*now[r.randint(0, 3) :], *(f"n{k}_{j}" for j in range(r.randint(0, 3)))]
    for k in range(25):
        out.append((2000 + k, " ".join(f"s{j}" for j in range(k, k + 30 + k % 7))))
    return out


@pytest.mark.parametrize(("part_tokens", "group"), [(4_000_000, 32), (120, 32), (4_000_000, 3)])
def test_similar_documents_by_brute_force(spark, docs, rows, part_tokens, group):
    more = [*rows, *chain_rows()]
    extra = spark.createDataFrame(chain_rows(), "doc_id long, text string")
    frame = docs.unionByName(extra, allowMissingColumns=True)
    got = ngramjoin.similar_documents(frame, part_tokens=part_tokens, group=group, buckets=3).collect()
    assert by_repr(got) == by_repr(components_by_force(more))


def test_one_row_of_each_component_stays(spark, docs, rows):
    out = ngramjoin.representatives(docs)
    assert out.schema == docs.schema
    want = components_by_force(rows)
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    named = {w[2] for w in want if w[1] and w[2] is not None}
    assert {k for (k, t), _ in kept.items() if sets_of(t) and k is not None} <= named
    assert sum(n for (k, t), n in kept.items() if not sets_of(t)) == sum(not w[1] for w in want)
    assert max(n for (k, t), n in kept.items() if sets_of(t)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 25), max_size=18), max_size=14), st.sampled_from([50, 80, 95]))
def test_trie_links_all_similar_sets(sets, percent):
    sets = sorted({s for s in sets if s}, key=sorted)
    trie = ngramjoin.Trie([np.array(sorted(s), np.int32) for s in sets], percent)
    got = trie.join() if sets else []
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = lambda marks: {frozenset(k for k, x in enumerate(marks) if x == m) for m in marks}
    assert groups(got) == groups(label)


def test_prefixes_hold_enough_common_shingles():
    for n in range(1, 400):
        assert 1 <= ngramjoin.prefix_size(n, 80) <= n
        assert ngramjoin.least_shared(n) <= ngramjoin.prefix_size(n, 80)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(500, 501 + k) for k in range(40)] + [(700, 700), (None, 3)]
    frame = spark.createDataFrame([*path, *star, *star], "u long, v long")
    got = {r["u"]: r["v"] for r in components(frame).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{501 + k: 500 for k in range(40)}}


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.remove_repeats(no_docs).count() == 0
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert ngramjoin.similar_documents(no_docs).count() == 0
    assert ngramjoin.representatives(no_docs).count() == 0


# --- the pipeline


def test_pipeline_stages_by_brute_force(spark, tmp_path, docs, rows):
    import corpus_pipeline as pipeline

    base = f"file://{tmp_path}"
    docs.write.parquet(f"{base}/documents.parquet")
    texts = [t for _, t in rows if t and len(t.split()) > 50]
    bench = spark.createDataFrame([(1, " ".join(texts[3].split()[8:30]))], "item_id long, text string")
    bench.write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    now = spark.read.parquet(f"{base}/documents.parquet")
    outs = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        now = stage(spark, now, base)
        if k < len(pipeline.STAGES) - 1:
            assert now.columns == docs.columns
        now.write.parquet(f"{base}/{name}")
        now = spark.read.parquet(f"{base}/{name}")
        outs[name] = [(r["doc_id"], r["text"] if "text" in now.columns else r["n_tokens"]) for r in now.collect()]
    assert by_repr(outs["toxicity"]) == by_repr(rows)  # without labels nothing is toxic
    by_force = zip(components_by_force(rows), rows, strict=True)
    heads = {(w[0], t) for w, (_, t) in by_force if w[0] == w[2] and w[0] is not None}
    assert {x for x in outs["ngram_join"] if x[0] is not None} == heads
    before = outs["ngram_join"]
    cut = [found[3].decode("utf-8", "ignore") for found in repeats_by_force([t for _, t in before], 200)]
    want = [(k, None if t is None else c) for (k, t), c in zip(before, cut, strict=True)]
    assert by_repr(outs["suffix_dedup"]) == by_repr(want)
    items = [(r[0], r[1]) for r in bench.collect()]
    hit = contamination_by_force([t for _, t in want], items, 10)
    assert by_repr(outs["decontamination"]) == by_repr(w for w, h in zip(want, hit, strict=True) if not h[1])
    assert Counter(k for k, _ in outs["bpe"]) == Counter(k for k, _ in outs["decontamination"])


def test_long_words_of_two_letters_are_told_apart(spark):
    """Words in Thue-Morse order and their complements, which polynomial hashes modulo 2**64 confuse."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [(1, f"one two three {word} five"), (2, f"one two three {other} five"), (3, f"one two three {word} five")]
    got = ngramjoin.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_texts_outside_clusters_are_not_shuffled(spark, docs, monkeypatch):
    """Neither to fetch the sets of clusters nor to keep one row of each component, however Spark guesses sizes."""
    fetch, plans = ngramjoin._fetch, []
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ngramjoin, "_fetch", lambda *a: plans.append(fetch(*a)) or plans[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = docs.filter("doc_id is null or doc_id != 410")
        kept = ngramjoin.representatives(once)
        assert "Exchange hashpartitioning" not in text(kept) and "SortMergeJoin" not in text(kept)
        assert "Exchange hashpartitioning" not in text(plans[0]) and "SortMergeJoin" not in text(plans[0])
        few = sorted((tuple(r) for r in kept.collect()), key=repr)
        monkeypatch.setattr(ngramjoin, "MOST_SENT", 0)
        assert sorted((tuple(r) for r in ngramjoin.representatives(once).collect()), key=repr) == few != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
