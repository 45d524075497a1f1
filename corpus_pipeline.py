"""From raw documents to packed training sequences.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read back as the next one's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import mixing, omh, queries
from lotline.llm.common import new_path, removed, unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject.

    A row is looked up by its id and text, null ids and texts included: rows equal in both share their
    fate, null and empty texts are scored as empty ones. Without labels nothing is rejected but by
    chance of a tie at one half, which is kept. Other columns are kept, whatever their names.
    """
    marked = queries.scored(docs, queries.table(spark, sf_dir, "labels"))
    hash_, id_, same = unused(docs, "_hash", "_id", "_same")
    rejected = marked.where("predicted = 0").select(F.col("doc_id").alias(id_), F.col("_text").alias(same)).distinct()
    rows = docs.withColumn(hash_, F.xxhash64("text"))
    return rows.join(rejected, rows["doc_id"].eqNullSafe(rejected[id_]) & (F.col(hash_) == F.col(same)), "left_anti").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; one that is left without any text goes.

    Null and empty texts stay as they are; rows equal in id and text are treated alike, and rows without
    an id count as one document. Other columns are kept; ones named n_lines, n_dropped or kept are
    not read.
    """
    extra = [c for c in docs.columns if c in ("n_lines", "n_dropped", "kept")]
    aside = dict(zip(extra, unused(docs, *[f"_{c}" for c in extra])))
    out = queries.without_common_lines(docs.withColumnsRenamed(aside)).where("n_dropped = 0 or trim(kept) <> ''")
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id.

    Null and empty texts are one class. Rows with equal ids stay or go together, rows without an id
    stay. Other columns are kept, whatever their names.
    """
    return omh.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words, so the mix takes none of them. A null source is a source. Rows
    equal in id, source and text share out the copies that they get together. Other columns are kept,
    whatever their names.
    """
    return mixing.repeat_rows(docs, written(mixing.mix(docs, **queries.MIX), "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the packed sequences.

    Null and empty texts are one id; repeated rows and null ids are packed a row each. An empty table
    gives no piece, here as in all stages. Only doc_id and text are read.
    """
    return queries.packed(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mix sources", mix_sources), ("pack", pack)]

#: Fitted models, hashed sketches and random ranks are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage has read
            removed(spark, before)
        before = path
    return docs
