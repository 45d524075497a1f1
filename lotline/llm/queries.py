"""The operators as queries over the test tables, each with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import cws, licenses, linededup, mixing, omh, packing, periodic, quality, secrets, simhash, tiff, trie, warc
from lotline.llm.common import written

#: Weights of sources, by code point, repeating; words to take as a share of all; limit of repeats.
MIX = {"weights": [5.0, 2.0, 1.0], "share": 1.5, "most": 2.0}
CAPACITY = 2048
#: Lines of so many code points, in so many documents, are repeats; ranges of doc_id added in turn.
LINE_CHARS, LINE_DOCS, LINE_BATCHES = 40, 5, 3
THRESHOLD = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark)
    # an earlier version of the corpus, then all of it: what the first scan has seen is not scanned again
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    ledger.scan(docs.where(F.col("doc_id") <= half))
    ledger.scan(docs)
    out = ledger.join_back(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_private_key", "blob")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with held_out, score and predicted; fitted on those of their rows that have
    a label and aren't held out.

    Null and empty texts are scored as empty ones, texts of any length whole. Rows with equal texts have
    equal scores, repeated rows and null ids a row each; a null id is not held out and has no label. Of
    several labels of an id the larger counts. A score of exactly THRESHOLD is predicted as 1. Without
    labels all scores are a half; an empty table gives an empty result. Other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    stats = docs.withColumn("_text", F.xxhash64("text")).select("doc_id", "_text", held.alias("held_out"), *[c.alias(k) for k, c in quality.statistics(F.col("text")).items()])
    stats = written(stats, "statistics")
    marks = labels.select("doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = quality.fit(stats.where("not held_out").join(marks, "doc_id"), "quality")
    score = model.score()
    return stats.select("doc_id", "_text", "held_out", score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_text")


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenized(docs, tokenizer_path(), CAPACITY)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.packed(pieces, CAPACITY)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_edited(table(spark, sf_dir, "documents"))


def op7_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.summaries(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def without_common_lines(docs: DataFrame) -> DataFrame:
    runs = linededup.LineRuns(docs.sparkSession, least_chars=LINE_CHARS)
    linededup.add_in_batches(runs, docs.select("doc_id", "text"), LINE_BATCHES)
    out = linededup.drop_lines(docs, runs, LINE_DOCS)
    runs.drop()
    return out


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), c - c % 5, F.crc32(c.cast("string")) % 9, 8)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the end of a tenth of the texts, chosen by a checksum of the id, made
    periodic: the word i >= a of n becomes the original word a + (i - a) % p, where g = checksum // 10,
    a = g % n and p = 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("_words")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, words))
    chosen = chosen.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.when(n > 0, 1 + F.floor((n - F.col("_a")) / (3 + g % 8))))
    moved = F.transform("_words", lambda w, i: F.when(i >= F.col("_a"), F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))).otherwise(w))
    return chosen.withColumn("text", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text"))).drop("_words", "_a", "_p")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    top = periodic.top_run(F.col("runs"))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")])), "\n")
    return periodic.find_runs(docs, "doc_id").withColumn("_top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period", F.floor(1000 * F.col("_top.length") / F.col("_top.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_near_duplicates, op4_quality, op5_pack, op6_fingerprints, op7_legacy_archives, op8_tiff, op9_licenses, op10_line_dedup, op11_conversation_trie, op12_periodic_runs, op13_simhash, pipeline)
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op7_legacy_archives": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS best FROM p WHERE n >= {warc.REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN best IS DISTINCT FROM page_id AND g.d IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best IS DISTINCT FROM page_id THEN best END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= {warc.REVISIT_BYTES}""",
    "op9_licenses": licenses.scan_sql(),
    "op10_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LINE_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LINE_DOCS}),
f AS (SELECT k.*, coalesce(last <> doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op11_conversation_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS x FROM t),
c AS (SELECT conv_id, (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x) + 1), lambda i: CAST(ascii(x[i]) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h FROM ids),
r AS (SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND k <= h UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, sha256(strlen(role) || ':' || role || text) AS key, strlen(text) AS size FROM r),
paths AS (SELECT conv_id, depth, size, string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM n GROUP BY path, depth),
up AS (SELECT v.*, u.path AS parent, u.conv_id AS parent_conv_id FROM nodes v LEFT JOIN nodes u ON u.depth = v.depth - 1 AND u.path = CASE WHEN v.depth = 1 THEN '' ELSE left(v.path, greatest(length(v.path) - 65, 0)) END),
kids AS (SELECT parent AS path, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY parent),
below AS (SELECT a.path, a.depth, count(*) FILTER (k.path IS NULL) AS n_leaves, CAST(sum((d.n_convs - 1) * d.size) AS BIGINT) AS saved_tokens
  FROM nodes a JOIN (SELECT DISTINCT x.path, x.depth, y.path AS above, y.depth AS at FROM n x JOIN n y ON x.conv_id = y.conv_id AND y.depth <= x.depth) e ON e.above = a.path AND e.at = a.depth
  JOIN nodes d ON d.path = e.path AND d.depth = e.depth LEFT JOIN kids k ON k.path = d.path GROUP BY a.path, a.depth)
SELECT u.conv_id, u.depth, parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, u.ends_sha256
FROM up u JOIN below USING (path, depth) LEFT JOIN kids ON kids.path = u.path""",
}
