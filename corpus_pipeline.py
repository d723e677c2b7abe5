"""A corpus from raw documents to packed sequences. Each stage takes what its predecessor kept and calls one operator.

Every stage but the last returns the columns of ``documents``. A column of documents that a table lacks is null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import jaccard, langid, packing, pii, suffix
from jobtide.llm.common import discard, made, scratch, table, written

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: Near copies: distinct five-word shingles, a Jaccard similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
#: A text of fewer characters has too few trigrams to say that it resembles no language; it stays.
SHORT_CHARS = 100


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _changed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of SHORT_CHARS characters or more that no language's prototype resembles; fills a missing language.

    Null and empty texts go. Rows with a null id, repeated rows and texts of any length are judged like all others; an empty table stays empty. Other columns are left out.
    """
    docs = _columns(docs)
    held = langid.held_out(F.col("doc_id"))
    model, damped = langid.fitted(docs.where(~held))
    # all labelled texts' likenesses make the bound; these texts are judged twice, as a table of all texts would stay on disk while later stages run
    learnt = docs.where(~held & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    bound = langid.like_bound(langid.predict(learnt, model, damped=damped).where(F.col("lang_pred") != langid.UND))
    told = langid.predict(docs, model, "lang", "source", "n_chars", with_text=True, damped=damped)
    kept = told.where((F.col("lang_pred") != langid.UND) & ((F.col("likeness") >= bound) | (F.length("text") < SHORT_CHARS)))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents, and one of rows that repeat an id and a text.

    Rows of one id but different texts are judged each by its own text. Rows with a null id, and null or empty texts but for repeated rows, all stay; an empty
    table stays empty. Which of the documents are odd is joined to all of them by a shuffle, at every size.
    """
    docs = _columns(docs)
    groups = jaccard.jaccard_components(docs, PERCENT, WORDS, keyed=True)
    # rows of one id may hold different texts: each text goes or stays by its own component
    counted = groups.where("doc_id is not null").groupBy("doc_id", "row_key").agg(F.count("*").alias("rows"), F.max(F.col("component_id") != F.col("doc_id")).alias("copy"))
    odd = written(counted.where("copy or rows > 1").select("doc_id", "row_key", "copy"))
    marked = docs.withColumn("row_key", jaccard.row_key(docs)).join(odd.hint("shuffle_hash"), ["doc_id", "row_key"], "left")
    kept = marked.where(F.col("copy").isNull()).select(*COLUMNS)
    again = odd.where("not copy")
    if again.limit(1).count():
        kept = kept.unionByName(marked.where(~F.col("copy")).dropDuplicates(["doc_id", "text"]).select(*COLUMNS))
    return kept


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of strings of 200 bytes that occur more than once, from every document that holds them.

    One row for each row, with a null id or repeated as well; a null text becomes empty; texts are read whole, however long; an empty table stays empty.
    """
    return _changed(suffix.cleaned(_columns(docs), "lang", "source", keep_text=True), "kept")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data with tags.

    One row for each row, with a null id or repeated as well; a null text becomes empty; texts are read whole, however long; an empty table stays empty.
    """
    return _changed(pii.find_pii(_columns(docs), "lang", "source", redacted=True), "redacted")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces with their token ids.

    Null and empty texts have the end token only; null ids stay null; repeated rows are packed as often as they occur; an empty table gives no pieces.
    """
    return packing.pack_documents(_columns(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("ngram_jaccard", near_copies), ("suffix_dedup", repeats), ("pii", personal_data), ("packing", packed)]

#: SQL can express none of the stages' models, checksums or tokenizers; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage wrote on its way, and its input once read, is deleted; the last stage's table stays in the shared folder."""
    docs, read = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        path = scratch(spark)
        before = made()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, *read, *[p for p in made() if p not in before])
        read = [path]
    return docs
