"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies. The whole part is certain; for the rest, documents
are ranked by random odds over inclusion odds (Rosen, 1997) and each source takes from the front of
its ranking until its words are used up: a sample of fixed size with unequal probabilities.

Only built-in column functions are used. A source may hold any share of the rows: nothing sorts or
gathers a source in one task. The ranking is cut into ``BINS`` bins of the ranking variable, summed
per bin, and the one bin in which a source's words run out into as many again; only that smaller bin
is ranked row by row. A document that is longer than all that its source has left over has no place in
the ranking; where the others do not fill what is left, the ranking goes on for a second lap, of
documents that may have another copy, by odds over those of their expected copies. Up to CLOSING
documents, each the nearest in size to what is then left, close the gap at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import Scratch, join_small, unit, unused, written

#: Bins of a lap of the ranking, and of the bin that is cut again: about 1/BINS**2 of a source's rows are
#: ranked row by row.
BINS = 1 << 10
#: Documents that close what the ranking leaves of a source's target, at most.
CLOSING = 3
Written = Callable[[DataFrame, str], DataFrame]
#: What separates words.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _level(classes: DataFrame, by: list[str], amount: Column, written: Written = written) -> DataFrame:
    """Per group ``by``, the rate x at which sum(least(cap, x * weight)) is ``amount``.

    ``classes``: by, weight, cap, total: how many units each class stands for are in ``n``. Newton's
    method on a concave, piecewise linear function: it rises to the root and ends in a few steps.
    """
    rates = written(classes.groupBy(by).agg(amount.alias("amount"), F.lit(0.0).alias("rate")), "rates")
    while True:
        j = join_small(classes, rates, by, F.xxhash64(*classes.columns))
        full = F.col("rate") * F.col("weight") >= F.col("cap")
        step = j.groupBy(by).agg(
            F.first("amount").alias("amount"),
            F.first("rate").alias("old"),
            F.sum(F.when(full, F.col("n") * F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(~full, F.col("n") * F.col("weight")).otherwise(0.0)).alias("open"),
        )
        better = F.when(F.col("open") > 0, (F.col("amount") - F.col("held")) / F.col("open")).otherwise(F.col("old"))
        step = written(step.select(*by, "amount", F.greatest("old", better).alias("rate"), (better > F.col("old") * (1 + 1e-12)).alias("moved")), "rates")
        rates = step.drop("moved")
        if step.where("moved").isEmpty():
            return rates.select(*by, "rate")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float, written: Written = written) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with each source's ``target``.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of all
    words; no target exceeds ``most`` times its source's size, the excess is shared by weight
    among the rest.
    """
    # one row per source, so this ranking is over sources, not documents: they are sorted in ranges, whatever
    # their names begin with, and a source's rank is its place in its range after all ranges before
    by = F.col("source").asc_nulls_last()
    placed = sizes.repartitionByRange(by).sortWithinPartitions(by).withColumn("_id", F.monotonically_increasing_id())
    parts = written(placed.select("source", "source_size", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "sources")
    before = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a partition
    ranked = parts.join(F.broadcast(before), "_range").select("source", "source_size", (F.col("_place") + F.col("_before")).alias("_rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "weighted")
    classes = ranked.select(F.lit(0).alias("all"), "weight", "cap", F.lit(1.0).alias("n"))
    rate = _level(classes, ["all"], F.sum("cap") * (share / most), written).first()
    x = rate["rate"] if rate else 0.0
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.lit(x) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, ``size``, ``source_size``,
    ``target``, ``copies``, ``taken`` (words) and ``text_hash``; repeat_rows() applies it.

    Within a source, a document's expected copies
    grow with ln(e + size), up to ``most``: longer contexts are taken somewhat more often. The ranked
    sample stops before the target; then up to CLOSING times the document whose size is nearest to what
    is left has one more copy if that brings the sum nearer.

    Null texts have size 0; documents of size 0 get no copies. A null source is a source of its own,
    ordered last. Rows that are equal in id, source and text are ranked one after another. An empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    with Scratch(docs.sparkSession, "mixed") as at:
        return at.result(_mix(docs, weights, share, most, seed, at.written))


def _mix(docs: DataFrame, weights: list[float], share: float, most: float, seed: int, written: Written) -> DataFrame:
    lean = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("_t"), F.monotonically_increasing_id().alias("_row")), "sizes")
    per_source = written(lean.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    goals = written(targets(per_source, weights, share, most, written), "targets")
    spread = F.xxhash64("doc_id", "_t")

    # expected copies: classes of documents of one source and size share them
    classes = lean.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("double").alias("docs"))
    classes = join_small(classes, goals.select("source", F.col("target").alias("goal")), ["source"], F.col("size"))
    classes = written(
        classes.select("source", "goal", "size", (F.col("docs") * F.col("size")).alias("n"), F.log(F.col("size") + 2.718281828459045).alias("weight"), F.lit(float(most)).alias("cap")),
        "classes",
    )
    rates = written(_level(classes, ["source"], F.first("goal"), written), "copies")

    def expected(weight: Column) -> Column:
        return F.least(F.lit(float(most)), F.coalesce(F.col("rate"), F.lit(0.0)) * weight)

    def sure(x: Column) -> Column:
        return F.floor(x + 1e-9)

    # what each source's certain copies leave
    certain = join_small(classes, rates, ["source"], F.col("size")).groupBy("source").agg(F.sum(F.col("n") * sure(expected(F.col("weight")))).alias("_certain"))
    ruled = join_small(join_small(goals, rates, ["source"], F.col("source")), written(certain, "certain"), ["source"], F.col("source"))
    ruled = written(ruled.select("source", "source_size", "target", "rate", (F.col("target") - F.coalesce("_certain", F.lit(0.0))).alias("_left")), "ruled")

    # places in the ranking: a document's fraction on the first lap, one more copy on the second
    ranked = join_small(lean, ruled, ["source"], spread)
    want = F.when(F.col("size") > 0, expected(F.log(F.col("size") + 2.718281828459045))).otherwise(0.0)
    ranked = ranked.withColumn("_want", want).withColumn("_sure", sure(F.col("_want"))).withColumn("_p", F.greatest(F.col("_want") - F.col("_sure"), F.lit(0.0)))
    odds = lambda p: p / (1 - p)
    q = odds(unit("doc_id", "_t", seed=seed)) / odds(F.col("_p"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("_left"))
    parted = F.col("_p") > 1e-9
    first = F.when(fits & parted, q / (1 + q))
    q2 = odds(unit("doc_id", "_t", seed=seed + 1)) / odds(F.least(F.col("_want") / (1.01 * most), F.lit(0.99)))
    second = F.when(fits & (F.col("_sure") + F.when(parted, 2).otherwise(1) <= most), 1 + q2 / (1 + q2))
    ranked = written(ranked.withColumn("_first", first).withColumn("_second", second).drop("_want", "_p", "rate"), "ranked")

    # words by source and bin, then the bin where each source's words run out
    bin_of = lambda place: F.floor(place * BINS)
    places = F.explode(F.filter(F.array("_first", "_second"), lambda x: x.isNotNull()))
    bins = ranked.select("source", "size", places.alias("_place")).groupBy("source", bin_of(F.col("_place")).alias("_bin")).agg(F.sum("size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("upto", upto)  # 2 * BINS rows a source at most
    left = ruled.select("source", "_left")
    cut = join_small(bins, left, ["source"], F.col("_bin")).where(F.col("upto") > F.col("_left"))
    cut = cut.groupBy("source").agg(F.min(F.struct("_bin", (F.col("upto") - F.col("w")).alias("base"))).alias("_cut"))
    whole = written(bins.groupBy("source").agg(F.max("upto").alias("_whole")), "whole")
    cut = join_small(join_small(left, written(cut, "cut"), ["source"], F.col("source")), whole, ["source"], F.col("source"))
    cut = written(cut.select("source", "_left", F.col("_cut._bin").alias("_cut_bin"), F.coalesce("_cut.base", "_whole", F.lit(0)).alias("_base")), "cuts")

    # that bin cut again
    fine = lambda place: F.floor(place * (BINS * BINS))
    all_places = ranked.select("source", "size", "doc_id", "_t", places.alias("_place"))
    inside = join_small(all_places, cut, ["source"], spread).where(bin_of(F.col("_place")) == F.col("_cut_bin"))
    parts = inside.groupBy("source", "_left", "_base", fine(F.col("_place")).alias("_bin")).agg(F.sum("size").alias("w"))
    upto = F.col("_base") + F.sum("w").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("upto", upto).where(F.col("upto") > F.col("_left"))  # BINS rows a source at most
    parts = written(parts.groupBy("source").agg(F.min(F.struct("_bin", (F.col("upto") - F.col("w")).alias("base"))).alias("_fine")), "fine")
    cut = join_small(cut, parts, ["source"], F.col("source"))
    cut = written(cut.select("source", "_left", F.col("_fine._bin").alias("_cut_bin"), F.coalesce("_fine.base", "_base").alias("_base")), "fine-cuts")

    # inside that, row by row
    edge = join_small(all_places, cut, ["source"], spread).where(fine(F.col("_place")) == F.col("_cut_bin"))
    order = Window.partitionBy("source").orderBy("_place", "doc_id", "_t")  # equal rows are peers: all or none is taken
    edge = edge.withColumn("_sum", F.col("_base") + F.sum("size").over(order)).where(F.col("_sum") <= F.col("_left"))
    last = edge.groupBy("source").agg(F.max(F.struct("_place", "doc_id", "_t")).alias("_last"), F.max("_sum").alias("_used"))
    plan = join_small(cut, written(last, "last"), ["source"], F.col("source"))
    plan = written(plan.select("source", "_cut_bin", "_last", (F.col("_left") - F.coalesce("_used", "_base")).alias("_gap")), "plan")

    def taken(place: str) -> Column:
        at = fine(F.col(place))
        before = F.coalesce(F.struct(F.col(place).alias("_place"), "doc_id", "_t") <= F.col("_last"), F.lit(False))
        yes = F.col(place).isNotNull() & (F.col("_cut_bin").isNull() | (at < F.col("_cut_bin")) | ((at == F.col("_cut_bin")) & before))
        return F.when(yes, 1).otherwise(0)

    cols = ["source", "doc_id", "_t", "_row", "size", "source_size", "target"]
    out = join_small(ranked, plan, ["source"], spread)
    out = written(out.select(*cols, (F.col("_sure") + taken("_first") + taken("_second")).alias("copies"), "_gap"), "drawn")
    # rows equal in id, source and text differ in _row alone, so it does not matter which of them closes
    order = F.struct(unit("doc_id", "_t", seed=seed + 2).alias("u"), "doc_id", "_t", "_row")
    for _ in range(CLOSING):
        closer = (F.col("copies") + 1 <= most) & (F.col("_gap") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("_gap"))
        closing = out.where(closer).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("d"), order.alias("o"), "size")).alias("_close"))
        out = join_small(out, written(closing, "closing"), ["source"], spread)
        closes = F.coalesce(closer & (order == F.col("_close.o")), F.lit(False))
        out = written(out.select(*cols, (F.col("copies") + F.when(closes, 1).otherwise(0)).alias("copies"), (F.col("_gap") - F.coalesce("_close.size", F.lit(0))).alias("_gap")), "closed")
    done = out.drop("_gap", "_row").withColumn("copies", F.col("copies").cast("long"))
    return done.withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("_t", "text_hash")


def _row_key(doc_id: Column, source: Column, text_hash: Column, k1: str, k2: str) -> list[Column]:
    return [F.xxhash64(doc_id, F.isnull(source), source, text_hash).alias(k1), F.xxhash64(text_hash, doc_id, F.lit(7)).alias(k2)]


def repeat_rows(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``drawn`` (a result of mix) says; rows equal in id, source
    and text share out the copies that they got together."""
    k1, k2, total, rows_, times_, copy = unused(docs, "_k1", "_k2", "_sum", "_n", "_times", "_k")
    rows = docs.select("*", *_row_key(docs["doc_id"], docs["source"], F.xxhash64("text"), k1, k2))
    got = drawn.select("copies", *_row_key(F.col("doc_id"), F.col("source"), F.col("text_hash"), k1, k2)).groupBy(k1, k2).agg(F.sum("copies").alias(total), F.count("*").alias(rows_))
    joined = rows.join(got.where(F.col(total) > 0), [k1, k2])
    i = F.row_number().over(Window.partitionBy(k1, k2).orderBy("doc_id"))
    times = F.floor(F.col(total) / F.col(rows_)) + F.when(i <= F.col(total) % F.col(rows_), 1).otherwise(0)
    return joined.withColumn(times_, times).where(F.col(times_) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times_)))).select(docs.columns)
