"""The registered queries of the training-data operators, each over its whole table, and the SQL that checks them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplewatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@register("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.bpe import round_trip

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@register("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.common import shared_folder
    from ripplewatch.llm.tokenfiles import read_tokens, write_tokens

    tokenizer, folder = public_tokenizers.path("byte_bpe_50k.json"), shared_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, folder, tokenizer, 2), digests=True)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op9_decontamination",
    rf"""
    WITH item_words AS (
      SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS s
      FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)),
    words AS (
      SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    places AS (
      SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS s
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM words, (SELECT DISTINCT m FROM windows) sizes)),
    found AS (SELECT p.doc_id, p.k, p.m, w.item_id FROM places p JOIN windows w ON w.m = p.m AND w.s = p.s),
    hit AS (
      SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM found) GROUP BY doc_id),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.decontaminate import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.toxicity import THRESHOLD, held_out, learn, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


@register("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.suffixes import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register(
    "op10_ngram_join",
    rf"""
    WITH RECURSIVE words AS (
      SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
      SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT doc_id, doc_id AS r FROM words UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.ngramjoin import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


@register(
    "op7_warc",
    """
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
      CASE WHEN page_id > least_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id > least_id THEN least_id END AS refers_to
    FROM (SELECT *, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS least_id FROM pages)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.warc import archived

    return archived(table(spark, sf_dir, "pages")).select(
        F.col("metadata.page_id").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        "refers_to",
    )


@register(
    "op4_chat",
    r"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    shown AS (
      SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
        len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>'))
          + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) AS escapes FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256,
      CAST(sum(9 + 8 + 8 + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars
    FROM shown GROUP BY conv_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.chat import digests, format_chat, records_of_turns

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chat(records_of_turns(rows)))


@register("op3_lz_fingerprint")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.lzprint import compare_neighbours

    return compare_neighbours(table(spark, sf_dir, "documents"))


@register("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


@register("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.alignment import alignment_report

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment_report(table(spark, sf_dir, "documents"), *paths)


@register("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.whitening import fit, whiten

    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))


@register("op12_source_mix")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplewatch.llm.mixing import taken_words

    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
