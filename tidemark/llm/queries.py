"""The thin queries over the operators of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, html_boilerplate, langid, minhash_join, packing, quality, substring_dedup, suffix_dedup, topk_cover_tree, warc
from tidemark.llm._spark import new_path, table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk_cover_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = new_path(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    records = warc.read_archives(spark.read.parquet(path), payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages that a smaller document has."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", substring_dedup.n_removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 ids."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules on every document."""
    judged = quality.judge(quality.measure(table(spark, sf_dir, "documents", "doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    made = html_boilerplate.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on two-word shingles."""
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that never saw the held-out ones."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("NOT held_out"), tokenizer_file("piece_bpe_32k.model"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that a smaller document has."""
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select(
        "doc_id", "n_bytes", substring_dedup.n_removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids, and back as bytes."""
    import public_tokenizers

    how = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), *how)
    both = bpe.decode(ids, *how)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_extraction": op6_html_extraction,
    "op7_minhash_join": op7_minhash_join,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOP_WORDS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        p AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five
              FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM p WHERE five IS NOT NULL),
        c AS (SELECT doc_id, count(DISTINCT k) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM n WHERE n > 1) GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
                   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
                   len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP_WORDS}))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter
            FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1 AND n_dup_lines / greatest(n_lines, 1) <= 0.4
               AND (n_words < 50 OR n_stop / n_words >= 0.02) AND n_letter / n_words >= 0.6 AS kept FROM b""",
    "op7_minhash_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g FROM d),
        n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
        p AS (SELECT doc_id, unnest(g) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT doc_id, n AS n_shingles, min(r.b) AS component_id, doc_id = min(r.b) AS kept FROM n JOIN r ON doc_id = r.a GROUP BY doc_id, n""",
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op3_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 49], ' ')) AS first_id FROM p),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM f WHERE first_id < doc_id),
        r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op2_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
}
