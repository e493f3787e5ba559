"""Page extraction and archives."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from ripplewatch.llm import dom, htmltext, warc
from ripplewatch.llm.common import shared_folder


@pytest.fixture(scope="module")
def field():
    return htmltext.default_field()


def test_held_out_pages(field):
    """Accuracy on composed pages that training never saw."""
    right = total = 0
    composer = htmltext._Composer(4242)
    for _ in range(150):
        blocks = dom.leaf_blocks(composer.page())
        labels = [int(b.text.rpartition("\x01")[2].strip()[:1] or 0) for b in blocks]
        for b in blocks:
            b.text = "".join(x[1:] if k else x for k, x in enumerate(b.text.split("\x01"))).strip() or "."
        right += sum(x == y for x, y in zip(field.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_labelling(field):
    import itertools

    page = "<nav><a href=x>Home</a></nav><div class=content><p>Some words here.</p><div class=ad>Buy</div><p>More.</p></div>"
    blocks = dom.leaf_blocks(page)
    scores = field.scores(htmltext.features(blocks))

    def worth(labels):
        pairs = sum(field.pairs[a, b] for a, b in zip(labels[:-1], labels[1:], strict=True))
        return sum(s for s, x in zip(scores, labels, strict=True) if x) + pairs

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=worth)
    assert abs(worth(tuple(field.decode(blocks))) - worth(best)) < 1e-9


def test_blocks_of_malformed_pages():
    page = "<p>a &amp; b<p>c<br>d<ul><li>e<li>f</ul></div><script>var x='</p>'</script><!-- no --><p>g &lt;b&gt;\n h<b>i"
    assert [b.text for b in dom.leaf_blocks(page)] == ["a & b", "c d", "e", "f", "g <b> hi"]
    assert dom.leaf_blocks(None) == dom.leaf_blocks("") == dom.leaf_blocks("<p> </p>") == []
    assert [b.text for b in dom.leaf_blocks("a < b <3 <style>x")] == ["a < b <3"]


def test_extraction(spark, field):
    page = (
        "<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>"
        "<article><h1>Title</h1><p>First words of it.</p><p>Second &eacute; part, longer than the first one was.</p></article>"
        "<aside>More to read</aside><footer>&copy; someone</footer>"
    )
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<nav>x</nav>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in htmltext.extract(frame, field).collect()), key=repr)
    want = "Title\nFirst words of it.\nSecond é part, longer than the first one was."
    assert [r[2] for r in got if r[0] == 1] == [want, want] and {r[3] for r in got if r[0] == 1} == {len(want)}
    assert [r for r in got if r[0] != 1] == [(2, None, "", 0), (3, "u", "", 0), (None, "u", "", 0)]
    assert htmltext.extract(frame.limit(0), field).count() == 0


PAGES = [
    (5, "http://a/1", "x" * 100),
    (3, "http://a/2?q=%0A\r\n", "x" * 100),
    (9, None, "x" * 100),
    (4, "http://a/3", "y" * 99),
    (6, "http://a/4", "y" * 99),
    (7, "http://a/5", None),
    (8, "http://a/6", ""),
    (10, "http://a/7", "é" * 50 + "\r\n\r\nWARC/1.1\r\n"),
    (11, "http://a/8", "é" * 50 + "\r\n\r\nWARC/1.1\r\n"),
    (None, "http://a/9", "z" * 300),
    (12, "http://a/9", "z" * 300),
]


def test_archives_round_trip(spark):
    frame = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, type string, digest string")
    files = warc.write_archives(frame.repartition(3), shared_folder(spark, "archives"), file_bytes=500)
    assert files.count() > 3
    records = warc.read_records(files, payloads=True)
    assert records.count() == 3 * len(PAGES)
    got = {}
    for r in warc.captures(records).collect():
        a = r["response"]
        assert r["request"]["url"] == r["response"]["url"]
        payload = None if a["payload"] is None else bytes(a["payload"]).decode()
        got[r["metadata"]["page_id"]] = (a["url"], a["type"], a["payload_bytes"], a["payload_digest"], r["refers_to"], payload)
    first = {5: 3, 9: 3, 11: 10, None: 12}
    for key, url, html in PAGES:
        data = (html or "").encode()
        kind = "revisit" if key in first else "response"
        kept = None if key in first else html or ""
        assert got[key] == (url, kind, len(data), hashlib.sha256(data).hexdigest(), first.get(key), kept)


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "u", "x" * 200)] * 2, "page_id long, url string, html string")
    got = warc.archived(frame).select(F.col("metadata.page_id"), "response.type", "refers_to").collect()
    assert [tuple(r) for r in got] == [(1, "response", None)] * 2
    assert warc.archived(frame.limit(0)).count() == 0


def test_broken_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))


def test_unclosed_quotes_and_deep_nesting_take_linear_time():
    import time

    for page, texts in [
        ('<a "' * 60_001, None),
        ("<a '\"" * 60_001, None),
        ("<script " * 60_000, None),
        ("<div>" * 30_000 + "x", ["x"]),
        ("<ul><li>" * 3000 + "x" + "</li></ul>" * 3000 + "<p>y", ["x", "y"]),
    ]:
        start = time.process_time()
        blocks = dom.leaf_blocks(page)
        assert time.process_time() - start < 20
        assert texts is None or [b.text for b in blocks] == texts
        assert all(len(b.tags) <= dom.DEPTH for b in blocks)
    assert [b.text for b in dom.leaf_blocks('<p class="a>one</p><p>two</p>')] == ["one", "two"]
    assert [b.text for b in dom.leaf_blocks('<p title=">">one<p title=\'"\'>two')] == ["one", "two"]


def test_captures_that_refer_to_nothing_do_not_meet(spark):
    rows = [(k, "u", f"<p>{k}</p>" * 30 if k % 5 else "<p>same</p>" * 30) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = warc.archived(pages).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count("refers_to").alias("r"))
        got = got.collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in got) == 400 and sum(r.r for r in got) == 79
    assert max(r.n - r.r for r in got) < 80
