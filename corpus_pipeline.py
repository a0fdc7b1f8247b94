"""The corpus pipeline: quality rules, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the packed pieces. An empty table gives an empty one in every stage. A null or empty text fails
the quality rules; stages that are given one all the same treat it as a text without words.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, minhash_join, packing, quality, substring_dedup
from tidemark.llm._spark import new_path
from tidemark.llm.queries import tokenizer_file

#: A text whose language is less likely than this, by the models' posterior, is rejected.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Rows are judged one by one: repeated rows and null ids stay or go alike."""
    return quality.judge(quality.measure(docs)).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without labels to learn from, all that have a letter. Null ids and labels
    are no hindrance; a text without a letter goes."""
    learnable = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.train(learnable, tokenizer_file("piece_bpe_32k.model"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = langid.predict(docs, model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest id. Five-word shingles, similarity 0.8.

    Rows without an id stay, and so do all rows that repeat a kept id. A text without a word is like no other.
    """
    found = minhash_join.near_duplicates(docs, width=5, percent=80)
    kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages of earlier ones; a text that loses words is its other words, joined by
    spaces, one that loses none stays as it is, and one that loses all is dropped."""
    made = substring_dedup.remove_repeats(docs, with_text=True)
    whole = F.size("spans") == 0
    columns = {c: F.col(f"rest.`{c}`") for c in docs.columns if c not in ("doc_id", "text")}
    columns["doc_id"] = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    columns["text"] = F.when(whole, F.col("text")).otherwise(F.col("kept"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return made.where(whole | (F.col("kept") != "")).select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; a null id passes through, a repeated row is packed again."""
    pieces = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", pack),
]

#: The stages use trained models, components and a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
