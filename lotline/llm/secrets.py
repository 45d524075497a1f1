"""Secret scans over an incremental ledger of blobs.

A blob is a text, addressed by its SHA-256. The ledger holds one row per blob and rule version that
has been scanned, with the spans found. A scan hashes all versions of all paths, scans only pairs of
blob and rule version that the ledger lacks, appends them, and joins the spans back to every path.

Only built-in column functions are used. Copies of a text are reduced before the shuffle, so a blob
is scanned once however many paths carry it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm.common import join_small, new_path, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` is the part that must have ``least`` characters; ``hints`` are
    lower-case strings of which every match contains one, compared with the lower-cased text."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the contract, in its order, then one more.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----begin ",), base=False),
)

#: Pieces of a text whose places are summed at a time.
BLOCK = 256
SPAN = "struct<start: bigint, end: bigint>"
LEDGER = f"blob string, kind string, rule string, spans array<{SPAN}>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches in code points, end exclusive, as an array of structs.

    The text is cut at the matches; the lengths of pieces and matches, summed, give the places. Pieces
    are summed in blocks of BLOCK: appending to one array would copy it as often as there are matches.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    parts = F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m"), kept.alias("g")), lambda x: F.struct(F.length(x["p"]).cast("long").alias("p"), F.length(x["m"]).cast("long").alias("m"), F.length(x["g"]).alias("g")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, BLOCK))
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["p"]
        end = begin + F.coalesce(x["m"], zero)
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["g"], F.lit(-1)) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        here = F.aggregate(xs, F.struct(acc["here"]["at"].alias("at"), none.alias("out")), step)
        return F.struct(here.alias("here"), F.concat(acc["done"], F.array(acc["here"]["out"])).alias("done"))

    start = F.struct(F.struct(zero.alias("at"), none.alias("out")).alias("here"), F.array().cast(f"array<array<{SPAN}>>").alias("done"))
    return F.aggregate(blocks, start, block, lambda acc: F.concat(F.flatten(acc["done"]), acc["here"]["out"]))


class BlobLedger:
    """A ledger in ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path or new_path(spark, "blob-ledger"), rules
        self.spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, versions: DataFrame) -> int:
        """Scan what is new in ``versions`` (text); returns how many pairs were appended.

        A null text is an empty one; a text of any length is one blob; equal texts are one blob, however
        many rows have them; spans of one kind never overlap, so there are no ties. An empty table appends
        nothing. Other columns are not read. A scan that is lost before its append is repeated by the next.
        """
        wanted = F.array(*[F.lit(r.key) for r in self.rules])
        before = self.table().count()
        # every pair of the current rules that the ledger has
        seen = self.table().where(F.col("rule").isin([r.key for r in self.rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        text = F.coalesce(F.col("text"), F.lit(""))
        blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
        if before:
            blobs = blobs.dropDuplicates(["blob"]).join(seen.where(F.size("seen") == len(self.rules)), "blob", "left_anti").join(seen, "blob", "left")  # copies go before the shuffle
            todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        else:
            blobs, todo = blobs.dropDuplicates(["blob"]), wanted
        none = F.array().cast(f"array<{SPAN}>")
        low = F.lower(F.col("text"))
        rows = []
        for r in self.rules:
            may = F.lit(True)
            if r.hints:
                may = F.lit(False)
                for h in r.hints:
                    may = may | F.contains("_low", F.lit(h))
            else:
                may = F.col("text").rlike(r.pattern)
            rows.append(F.when(F.array_contains("_todo", r.key), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.key).alias("rule"), F.when(may, spans(F.col("text"), r)).otherwise(none).alias("spans"))))
        new = blobs.select("blob", "text", todo.alias("_todo"), low.alias("_low")).select("blob", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r")).select("blob", "r.*")
        new.write.mode("append").parquet(self.path)
        return self.table().count() - before

    def findings(self) -> DataFrame:
        """Per blob with any span of the current rules: counts and the joined spans."""
        order = {r.key: i for i, r in enumerate(self.rules)}
        hit = self.table().where((F.size("spans") > 0) & F.col("rule").isin(list(order)))
        rank = F.coalesce(*[F.when(F.col("rule") == k, F.lit(i)) for k, i in order.items()])
        each = hit.select("blob", "kind", rank.alias("rank"), F.explode("spans").alias("s"))
        item = F.struct(F.col("s.start").alias("start"), F.col("rank").alias("rank"), F.col("s.end").alias("end"), F.col("kind").alias("kind"))
        text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
        base = [r.kind for r in self.rules if r.base]
        per = each.groupBy("blob").agg(F.array_sort(F.collect_list(item)).alias("all"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in dict.fromkeys(r.kind for r in self.rules)])
        return per.select("blob", *[c for c in per.columns if c.startswith("n_")], text(F.filter("all", lambda x: x["kind"].isin(base))).alias("base_spans"), text(F.col("all")).alias("spans"))

    def join_back(self, versions: DataFrame) -> DataFrame:
        """The columns of ``versions`` but its text, with the findings of each row's blob; one row a
        row, zero counts and empty spans where nothing was found. Clashing columns are replaced."""
        found = written(self.findings(), "findings")
        mine = [c for c in found.columns if c != "blob"]
        paths = versions.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).drop("text", *mine)
        out = join_small(paths, found, ["blob"], F.monotonically_increasing_id())
        return out.fillna(0, [c for c in mine if c.startswith("n_")]).fillna("", ["base_spans", "spans"])
