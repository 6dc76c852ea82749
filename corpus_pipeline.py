"""From raw documents to packed sequences: STAGES of (name, function), each calling one operator of keyloom.llm.

A function takes (spark, docs, sf_dir) and returns a DataFrame, the next one's docs. All but the last return the columns
of documents. Each works on all that its predecessor kept.

Defined cases: the operators' own; rows that share an id are documents of their own unless their texts are near copies; an empty table runs through empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.llm.common import columns_of, fresh, table, text_bytes
from keyloom.llm.decontaminate import without_contaminated
from keyloom.llm.pii_feistel import pseudonymise
from keyloom.llm.quality_rules import score_quality
from keyloom.llm.queries import PII_KEY
from keyloom.llm.simhash_lsh import similar_texts
from keyloom.llm.stock_packing import pack_documents


def quality(spark, docs, sf_dir):
    """Documents that the rule ensemble predicts to be of label 1."""
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(columns_of(docs))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of copies and near copies: the one with the smallest id (null ids last, then by text).
    Documents of other groups stay, whatever ids they share."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))).alias("first")
    stay = similar_texts(docs).groupBy("root").agg(first).select("first.doc_id", "first.digest").alias("stay")
    mark = fresh(docs, "_digest")
    marked = docs.withColumn(mark, F.md5(text_bytes("text"))).alias("docs")
    same = F.col("docs.doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col(f"docs.{mark}") == F.col("stay.digest"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", mark]).select(columns_of(docs))


def decontamination(spark, docs, sf_dir):
    """Documents without a benchmark passage, verbatim or re-parameterised."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark, docs, sf_dir):
    """All documents, with pseudonyms in place of personal data; n_chars, where there is one, counts the new text."""
    new = pseudonymise(docs, PII_KEY, count_col=fresh(docs, "n_replaced"))
    return (new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new).select(columns_of(docs))


def packing(spark, docs, sf_dir):
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs, length=1024, end_id=0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Tokens, fingerprints and keyed permutations have no SQL: tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
