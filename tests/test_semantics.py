"""Edge cases of the operators, on literal rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotline.functions import identity, nbt, nested, packed, timekey
from lotline.operators import bloom, compare, export, filters, merge, players, prices, scan
from lotline.plans.memo import PriceMemo
from lotline.session import configure
from lotline.sources import archive, months, tables
from lotline.schema import BIDDER, SELLER
from lotline.streaming import completion, ingest, metrics, sinks

AUCTION = "auction_uid long, uuid string, tag string, seller long, end_ts timestamp_ntz, start_ts timestamp_ntz, highest_bid long, is_sold boolean"
T = datetime(2024, 6, 15, 12)


def sold(spark, prices_, tag="x"):
    return spark.createDataFrame([(i, f"{i:032x}", tag, 1, T + timedelta(hours=i), T, p, True) for i, p in enumerate(prices_)], AUCTION)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


def leaves(node):
    """The leaves of an executed plan, adaptive ones included."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return leaves(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return leaves(node.plan())
    kids = node.children()
    return [x for i in range(kids.size()) for x in leaves(kids.apply(i))] if kids.size() else [node]


def partitions_read(df):
    """Folders that the file scans of the collected ``df`` read, one number a scan."""
    df.collect()
    out = []
    for leaf in leaves(df._jdf.queryExecution().executedPlan()):
        if leaf.getClass().getSimpleName() == "FileSourceScanExec" and leaf.metrics().contains("numPartitions"):
            out.append(leaf.metrics().apply("numPartitions").value())
    return out


def test_upper_median_and_mode(spark):
    r = prices.summary(sold(spark, [1, 2, 3, 4]), ["tag"]).first()
    assert (r["min"], r["max"], r["mean"], r["med"], r["volume"]) == (1, 4, 2.5, 3, 4.0)
    assert r["mode"] == 4  # all equally frequent: the last seen
    assert prices.summary(sold(spark, [5, 9, 5, 9, 9, 1]), ["tag"]).first()["mode"] == 9
    assert prices.summary(sold(spark, [7]), ["tag"]).first()["med"] == 7


def test_days_without_sales_are_zero(spark):
    rows = prices.history(sold(spark, [5, 7]), "2024-06-15", "2024-06-17").orderBy("day").collect()
    assert [(r["volume"], r["max"]) for r in rows] == [(0.0, 0), (2.0, 7), (0.0, 0)]


def test_midnight_belongs_to_the_day_before(spark):
    df = spark.createDataFrame([(datetime(2024, 6, 15),), (datetime(2024, 6, 15, 0, 0, 1),)], "end_ts timestamp_ntz").select(prices.closing_day(F.col("end_ts")).alias("d"))
    assert [r["d"] for r in df.collect()] == [datetime(2024, 6, 15), datetime(2024, 6, 16)]


def test_memo_adds_missing_days_once(spark, tmp_path):
    memo = PriceMemo(spark, str(tmp_path / "memo"))
    rows = sold(spark, [5, 7, 9])
    assert memo.history(rows, "2024-06-15", "2024-06-16").count() == 2
    assert memo.missing(rows, "2024-06-15", "2024-06-18").count() == 2
    out = memo.history(rows, "2024-06-15", "2024-06-18")
    assert out.count() == 4 and memo.stored().count() == 4
    assert sorted(tuple(r) for r in out.select("day", "volume", "med").collect()) == sorted(tuple(r) for r in prices.history(rows, "2024-06-15", "2024-06-18").select("day", "volume", "med").collect())


@pytest.mark.parametrize(("text", "days"), [("9", 2), ("-1", 0), ("x", 2), (None, 2), ("1.5", 1.5)])
def test_days_clamp(spark, text, days):
    assert identity.summary_days(text) == days
    assert one(spark, identity.summary_days_column(F.lit(text).cast("string"))) == days


@pytest.mark.parametrize(("tag", "at", "key"), [("x", "2019-01-08", 1), ("ENCHANTED_BOOK", "2019-01-08", 14), (None, "2019-01-08", 14), ("x", "2018-12-31", 0), ("x", "2018-12-20", -1), ("unknown", "2000-01-01", None)])
def test_time_key(spark, tag, at, key):
    assert one(spark, timekey.time_key(F.lit(tag).cast("string"), F.lit(at).cast("timestamp_ntz"))) == key


def test_time_key_date_is_no_later(spark):
    df = sold(spark, range(200)).withColumn("end_ts", F.col("end_ts") + F.make_dt_interval(F.col("auction_uid").cast("int")))
    key = timekey.time_key(F.col("tag"), F.col("end_ts"))
    assert df.where(timekey.time_key_date(F.col("tag"), key) > F.col("end_ts")).isEmpty()


def test_range_bounds(spark):
    rows = sold(spark, [1, 1, 1])
    assert [r["auction_uid"] for r in scan.in_range(rows, "2024-06-15 12:00:00", "2024-06-15 14:00:00").collect()] == [1, 2]


def test_archive_merge_rules(spark):
    schema = "uuid string, highest_bid long, v string"
    a, b = "a" * 32, "b" * 32
    old = spark.createDataFrame([(a, 10, "old"), (b, 10, "old"), ("c" * 32, 1, "old")], schema)
    new = spark.createDataFrame([(a.upper(), 10, "new"), (b, 9, "new"), ("unknown", 99, "new"), ("", 99, "new"), ("xyz", 99, "new"), (None, 1, "new")], schema)
    out = {r["uuid"]: r["v"] for r in merge.archive(old, new).collect()}
    assert out == {a: "new", b: "old", "c" * 32: "old"}
    again = merge.archive(merge.archive(old, new), new)
    assert {r["uuid"]: r["v"] for r in again.collect()} == out


def test_fold_of_versions(spark):
    schema = "uuid string, version int, seller long, tag string, start_ts timestamp_ntz, starting_bid long, category string, profile long, highest_bid long, bids array<struct<amount:bigint>>"
    bid = lambda *x: [(v,) for v in x]
    rows = [("u", 0, 1, "t", None, 0, "UNKNOWN", 1, 5, bid(10, 20)), ("u", 1, 1, "t", T, 3, "WEAPON", 8, 6, bid(20, 30)), ("one", 0, 1, "t", None, 0, "UNKNOWN", 1, 5, bid(9, 9))]
    out = {r["uuid"]: r for r in merge.combine_versions(spark.createDataFrame(rows, schema)).collect()}
    u = out["u"]
    assert (u["n_bids"], u["highest_bid"], u["start_ts"], u["starting_bid"], u["category"], u["profile"]) == (3, 30, T, 3, "WEAPON", 8)
    assert (out["one"]["n_bids"], out["one"]["highest_bid"]) == (2, 5)


def test_retrofit_window_is_open(spark):
    s = "uuid string, tag string, end_ts timestamp_ntz, start_ts timestamp_ntz, starting_bid long, bin boolean"
    def got(days):
        old = spark.createDataFrame([("u", "t", T + timedelta(days=days), T, 1, True)], s)
        return merge.retrofit(spark.createDataFrame([("u", "t", T, None, None, None)], s), old).first()["start_ts"]
    assert got(13.9) == T and got(14) is None and got(-14) is None and got(-13.9) == T


def test_retrofit_gives_a_row_a_row(spark):
    s = "uuid string, tag string, end_ts timestamp_ntz, start_ts timestamp_ntz, starting_bid long, profile string, count int"
    day = lambda n: T + timedelta(days=n)
    sold = spark.createDataFrame([("u", "t", T, None, None, "own", None), ("u", "t", T, None, None, "own", None), ("u", "t", T, day(-3), 4, "own", 2), (None, "t", T, None, 5, None, None), ("v", "t", T, None, 6, None, None)], s)
    old = spark.createDataFrame([("u", "t", day(1), day(-1), 1, "p1", 1), ("u", "t", day(2), day(-2), 2, None, 3), ("u", "t", day(20), day(-9), 9, "p9", 9), ("u", "x", day(3), day(-9), 9, "p9", 9)], s)
    got = sorted((tuple(r)[3:] for r in merge.retrofit(sold, old).collect()), key=repr)
    assert got == sorted([(day(-2), 2, None, 3)] * 2 + [(day(-3), 4, "own", 2), (None, 5, None, None), (None, 6, None, None)], key=repr)
    assert merge.retrofit(sold.limit(0), old).count() == 0 and merge.retrofit(sold, old.limit(0)).count() == 5


def test_retrofit_reads_the_months_of_its_batch(spark, tmp_path):
    rows = sold(spark, range(300)).withColumn("end_ts", F.col("end_ts") + F.make_dt_interval(F.col("auction_uid").cast("int")))
    archive.write(rows, str(tmp_path / "a"))
    batch = rows.where("auction_uid between 100 and 104").withColumn("start_ts", F.lit(None).cast("timestamp_ntz"))
    out = merge.retrofit(batch, archive.read(spark, str(tmp_path / "a")))
    assert out.where("start_ts is not null").count() == 5
    assert 2 in partitions_read(out) and max(partitions_read(out)) <= 2  # of eleven
    assert archive.read(spark, str(tmp_path / "a")).select("month").distinct().count() == 11


def test_identity(spark):
    assert one(spark, identity.item_guid(F.lit(None).cast("string"), F.lit("abc123"))) == "0" * 26 + "abc123"
    assert one(spark, identity.bid_profile(F.lit("unknown"), F.lit("b"))) == "0" * 31 + "1"
    assert one(spark, identity.bid_profile(F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert one(spark, identity.normal_tier(F.lit("SUPREME"))) == "DIVINE"
    assert one(spark, identity.csv_field(F.lit("a,b"))) == '"a,b"' and one(spark, identity.csv_field(F.lit('q"q'))) == '"q""q"'
    assert identity.bloom_bits(800_000_000, 0.01) == 7_668_046_702
    tag, month = identity.archive_key_parts(F.lit("auctions/A:B/2024-13.json.gz"))
    assert one(spark, tag) is None


def test_enchantments_that_clash(spark):
    e = F.expr("array(struct('a' AS type, 1 AS level), struct('a' AS type, 2 AS level))")
    assert one(spark, nested.enchantment_map(e)) == {"a": 1, "a#1": 2}


def test_junk_and_users(spark):
    df = spark.createDataFrame([(None, None, 0), (1, None, 0), (None, "t", 0), (None, None, 5)], "seller long, tag string, highest_bid long")
    assert df.where(filters.junk()).count() == 1
    with pytest.raises(ValueError, match="unknown filter"):
        filters.compiled({"Nope": "1"})


def test_export(spark, tmp_path):
    rows = sold(spark, [5]).withColumn("bin", F.lit(True)).withColumn("tier", F.lit('q"q,')).withColumn("bid_count", F.lit(1))
    with pytest.raises(ValueError, match="invalid_column: Price"):
        export.selected(rows, ["Price"])
    assert export.selected(rows, ["Price"], aliases=True).first()[0] == "5"
    assert export.selected(rows, ["END"]).first()[0] == "2024-06-15T12:00:00.0000000Z"
    job = export.checked(export.Job(" A@B ", "x", T - timedelta(days=1), T, ("Uuid", "Tier")), T)
    assert job.email == "a@b"
    assert export.run(job, rows, str(tmp_path / "csv"), files=1).status == "Done"
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text == f'Uuid,Tier\n{0:032x},"q""q,"\n'
    assert export.run(job, rows.drop("tier"), str(tmp_path / "bad")).status == "Failed"
    with pytest.raises(ValueError, match="invalid_range"):
        export.checked(export.Job("a", "x", T, T), T)


def test_coverage_counts_repeats(spark):
    want = spark.createDataFrame([("a", "t"), ("b", "t")], "k string, tag string")
    have = spark.createDataFrame([("a", "t"), ("a", "t"), ("z", "t")], "k string, tag string")
    r = compare.coverage(want, have, "k", ["tag"]).first()
    assert (r["expected"], r["archived"], r["missing"], r["extra"]) == (2, 3, 1, 2)


def test_participations_are_distinct(spark):
    bids = spark.createDataFrame([(0, 9), (0, 9), (0, None)], "auction_uid long, bidder long")
    assert players.participations(sold(spark, [5]), bids).count() == 2


def test_archive_round_trip_prunes(spark, tmp_path):
    rows = sold(spark, [5, 6], "007")
    archive.write(rows, str(tmp_path / "p"))
    back = archive.read(spark, str(tmp_path / "p")).where("tag = '007' and month = '2024-06'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(tag" in back._jdf.queryExecution().toString()
    (tmp_path / "2024-06.json").write_text('[{"uuid":"a"},{"uuid":"b"}]')
    assert [tuple(r) for r in archive.read_arrays(spark, str(tmp_path / "2024-06.json"), "uuid string").collect()] == [("a", "2024-06"), ("b", "2024-06")]


def test_stream_is_idempotent(spark, tmp_path):
    base = [("u%d" % i, i) for i in range(20)]
    ev = lambda shift: spark.createDataFrame([(n, u, "t", 1, T, T, 10 + shift, T + timedelta(hours=shift), None) for u, n in base], ingest.EVENTS.replace("auction_uid", "auction_uid"))
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    ev(2).coalesce(1).write.mode("append").parquet(src)
    ingest.start(ingest.file_source(spark, src), out, cp).awaitTermination()
    ev(1).coalesce(1).write.mode("append").parquet(src)  # late
    ingest.start(ingest.file_source(spark, src), out, cp).awaitTermination()
    rows = ingest.current(spark, out).collect()
    assert len(rows) == 20 and {r["highest_bid"] for r in rows} == {12}


def test_round_trip_of_a_stream(spark, tmp_path):
    """Two batches of one auction each: both are archived, and seller and bidders are indexed."""
    path = f"{tmp_path}/in"
    rows = [
        [(1, "0" * 31 + "1", "A", 7, "2025-01-02 00:00:00", 10, [(8, 10), (8, 10), (9, 5)])],
        [(2, "0" * 31 + "2", "A", 7, "2025-01-03 00:00:00", 3, [(9, 3)]), (3, None, "A", 7, "2025-01-03 00:00:00", 3, [])],
    ]
    schema = "auction_uid long, uuid string, tag string, seller long, e string, highest_bid long, b array<struct<bidder: bigint, amount: bigint>>"
    for batch in rows:
        df = spark.createDataFrame(batch, schema)
        end = F.col("e").cast("timestamp_ntz")
        bids = F.transform("b", lambda x: F.struct(x["bidder"].alias("bidder"), x["amount"].alias("amount"), end.alias("ts")))
        df.select("auction_uid", "uuid", "tag", "seller", end.alias("end_ts"), end.alias("start_ts"), "highest_bid", end.alias("write_ts"), bids.alias("bids")).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):  # the second run finds nothing new
        ingest.start(ingest.file_source(spark, path), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    out = f"{tmp_path}/out"
    assert sorted((r["auction_uid"], r["month"]) for r in ingest.archived(spark, out).collect()) == [(1, "2025-01"), (2, "2025-01")]
    got = sorted((r["player"], r["auction_uid"], r["type"]) for r in ingest.participations(spark, out).collect())
    assert got == [(7, 1, SELLER), (7, 2, SELLER), (8, 1, BIDDER), (9, 1, BIDDER), (9, 2, BIDDER)]
    assert spark.read.parquet(f"{out}/bids").count() == 3


def test_stream_retrofit(spark, tmp_path):
    """Each sold event comes out once: at once if it has a start, completed by what is there or comes later,
    or as it is when its time is over; over restarts from the checkpoint too."""
    schema = "uuid string, tag string, is_sold boolean, e string, s string, starting_bid long, seller long"
    big = 2**53 + 1
    steps = [
        [("a", "T", False, "2025-01-10 00:00:00", "2025-01-01 00:00:00", 1, None), ("a", "T", False, "2025-01-12 00:00:00", "2025-01-02 00:00:00", big, None), ("far", "T", False, "2025-01-04 00:00:00", "2025-01-01 00:00:00", 9, 1)],
        [("a", "T", True, "2025-01-11 00:00:00", None, None, big), ("b", "T", True, "2025-01-11 00:00:00", None, None, 2), ("whole", "T", True, "2025-01-11 00:00:00", "2025-01-05 00:00:00", 7, None), ("far", "T", True, "2025-01-18 00:00:00", None, None, 3), ("b", "U", True, "2025-01-11 00:00:00", None, None, 4)],
        [("b", "T", False, "2025-01-13 00:00:00", "2025-01-03 00:00:00", 5, None), ("a", "T", False, "2025-01-14 00:00:00", "2025-01-03 00:00:00", 6, None), (None, "T", True, "2025-01-13 00:00:00", None, 1, 1)],
    ]

    def frame(rows):
        df = spark.createDataFrame(rows, schema)
        return df.select("uuid", "tag", "is_sold", F.col("e").cast("timestamp").alias("end_ts"), F.col("s").cast("timestamp_ntz").alias("start_ts"), "starting_bid", "seller")

    def run():
        read = spark.readStream.schema(frame(steps[0]).schema).parquet(f"{tmp_path}/in")
        q = completion.completed(read).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").selectExpr("uuid", "tag", "cast(start_ts AS string) AS s", "starting_bid", "seller").collect()
        return sorted((tuple(r) for r in rows), key=repr)

    seen = []
    for rows in steps:
        frame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen.append(run())
    at_once = [("a", "T", "2025-01-02 00:00:00", big, big), ("whole", "T", "2025-01-05 00:00:00", 7, None)]
    assert seen[0] == [] and seen[1] == at_once
    assert seen[2] == sorted([*at_once, ("b", "T", "2025-01-03 00:00:00", 5, 2)], key=repr)
    completion.last_event(spark.read.parquet(f"{tmp_path}/in")).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == sorted([*seen[2], ("b", "U", None, None, 4), ("far", "T", None, None, 3)], key=repr)
    assert run() == sorted([*seen[2], ("b", "U", None, None, 4), ("far", "T", None, None, 3)], key=repr)


def test_stream_retrofit_of_many_auctions_in_a_bucket(spark, tmp_path):
    """Auctions that share a bucket of the state are completed from their own unsold events only, and the
    last timer of a bucket lets none of them stay."""
    at = lambda k, day: F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(f"2025-01-{day + k:02} 00:00:00").cast("timestamp"))
    ids = spark.range(200).select("id", F.col("id").cast("string").alias("uuid"), F.when(F.col("id") % 2 == 0, "T").otherwise("U").alias("tag"))
    row = lambda df, sold, end, start: df.select("uuid", "tag", F.lit(sold).alias("is_sold"), end.alias("end_ts"), start.alias("start_ts"), F.col("id").alias("starting_bid"))
    none = F.lit(None).cast("timestamp_ntz")
    begun = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    steps = [row(ids.where("id % 4 = 0"), False, at(0, 10), begun), row(ids, True, at(1, 10), none).withColumn("starting_bid", F.lit(None).cast("long")), row(ids.where("id % 4 = 1"), False, at(2, 10), begun)]
    for k, rows in enumerate(steps):
        rows.write.parquet(f"{tmp_path}/in/{k}")
        if k == 2:
            completion.last_event(spark.read.parquet(f"{tmp_path}/in/*")).write.parquet(f"{tmp_path}/in/last")
        read = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
        q = completion.completed(read, buckets=2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    got = {r["uuid"]: (r["starting_bid"], r["start_ts"] is not None) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {str(i): (i, True) if i % 4 < 2 else (None, False) for i in range(200)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200


def test_more_auctions_are_ingested_from_more_files(spark, sf, monkeypatch):
    """A file, which one task writes, has so many auctions whatever the table has; batches stay two."""
    import glob

    from lotline import queries

    monkeypatch.setattr(queries, "PER_FILE", 100)
    out = queries.ingested(spark, sf).removeprefix("file://")
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert len(glob.glob(f"{out}/../in/*.parquet")) == 2 * -(-n // 200) and len(glob.glob(f"{out}/auctions/batch=*")) == 2


def test_a_cut_reads_its_range_only(spark, tmp_path):
    """To find one bad row of many, a failing sink gets ranges of a sorted copy and not of the whole batch."""
    plans = []

    def strict(x, path):
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        x.select(F.when(F.col("id") == 4321, F.raise_error(F.lit("bad")).cast("long")).otherwise(F.col("id")).alias("id")).write.parquet(path)

    out = sinks.Sinks(spark, str(tmp_path), {"strict": strict})
    got = out.write(spark.range(5000), 1)[0]
    assert (got.status, got.written, got.dead) == ("done", 4999, 1)
    assert len(plans) > 3 and all("GreaterThanOrEqual(_slot" in p and "Parquet" in p for p in plans[1:])
    assert sorted(r["id"] for r in out.written("strict").collect()) == [i for i in range(5000) if i != 4321]
    assert not (tmp_path / "cut" / "strict").exists()


def test_an_archived_batch_is_worked_out_for_its_write_only(spark, tmp_path):
    """The folders that a batch touches, for its manifest, are found without working out its rows again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    bid = F.udf(counted, "long")(F.col("id"))
    rows = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("uuid"), F.lit("T").alias("tag"), F.lit("2025-01-02 00:00:00").cast("timestamp_ntz").alias("end_ts"), bid.alias("highest_bid"))
    assert months.MonthArchive(spark, str(tmp_path / "x")).merge(rows, "s", 1)
    assert seen.value == 100


def test_job_states_follow_their_actions(spark, tmp_path):
    from lotline.operators import jobs

    acts = [("j1", 1, "request"), ("j1", 2, "start"), ("j1", 2, "start"), ("j1", 3, "abort"), ("j1", 4, "finish"), ("j2", 1, "request"), ("j2", 2, "delete"), ("j3", 1, "request"), ("j3", 2, "start"), ("j3", 3, "fail")]
    log = spark.createDataFrame([(" A@B.c ", int(j[1]), j, at, act) for j, at, act in acts], "email string, requested_at long, job_id string, at long, action string")
    for part in (log.where("at > 1"), log.where("at = 1")):  # written in any order
        jobs.save(part, f"{tmp_path}/log")
    got = jobs.states(spark.read.parquet(f"{tmp_path}/log"))
    assert {r.job_id: (r.status, r.changed_at) for r in got.collect()} == {"j1": ("Aborted", 3), "j2": ("Pending", 1), "j3": ("Failed", 3)}
    assert [r.job_id for r in jobs.listed(got, "a@b.C ").collect()] == ["j3", "j2", "j1"]
    assert [r.job_id for r in jobs.listed(got, "a@b.c", jobs.SCHEDULED).collect()] == ["j2"]
    assert jobs.states(log.limit(0)).count() == 0


def plain_positions(uuid, bits):
    """The bits of a UUID, by hand."""
    import hashlib
    import uuid as u

    digest = hashlib.sha256(u.UUID(uuid).bytes_le).digest()
    mask = (1 << 63) - 1
    a, b = int.from_bytes(digest[:8], "little") & mask, (int.from_bytes(digest[8:16], "little") & mask) or 1
    return [((a + k * b) & mask) % bits for k in range(7)]


def test_bloom_filter(spark, tmp_path):
    """Bits as worked out by hand, no false negative, few false positives, and a file that survives."""
    import random
    import struct

    rng, n, rate = random.Random(1), 3000, 0.01
    bits = identity.bloom_bits(n, rate)
    have, other = ([f"{rng.getrandbits(128):032x}" for _ in range(n)] for _ in range(2))
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "uuid string")
    words = bloom.built(ids([*have, have[0], None, "unknown", have[1].upper()]), "uuid", bits).cache()
    plain = {}
    for u in have:
        for p in plain_positions(u, bits):
            plain[p // 32] = plain.get(p // 32, 0) | 1 << p % 32
    signed = lambda x: x - (1 << 32) if x >> 31 else x
    assert {r["word"]: r["bits"] for r in words.collect()} == {w: signed(b) for w, b in plain.items()}
    probe = bloom.probed(ids([*have, *other, None, "xyz"]), "uuid", words, bits).groupBy("uuid", "may_exist").count().collect()
    got = {r["uuid"]: r["may_exist"] for r in probe}
    assert all(got[u] for u in have) and not got[None] and not got["xyz"]
    assert sum(got[u] for u in other) <= 1.5 * rate * n
    path = f"{tmp_path}/filter.bin"
    bloom.save(words.limit(0), path, bits)
    assert bloom.load(spark, path)[0].count() == 0
    bloom.save(words, path, bits)
    data = open(path, "rb").read()
    assert data[:12] == b"BLM1" + struct.pack("<q", bits) and len(data) == 12 + 4 * -(-bits // 32)
    back, size = bloom.load(spark, path)
    assert size == bits and sorted(map(tuple, back.collect())) == sorted(map(tuple, words.collect()))
    (tmp_path / "old.bin").write_bytes(data[12:-4])  # without a header, and a word short
    back, size = bloom.load(spark, f"{tmp_path}/old.bin", bits)
    assert sorted(map(tuple, back.collect())) == sorted((w, signed(b)) for w, b in plain.items() if w < len(data) // 4 - 4)
    with pytest.raises(ValueError, match="no header"):
        bloom.load(spark, f"{tmp_path}/old.bin")
    one, two = (bloom.built(ids(x), "uuid", bits) for x in (have[: n // 2], have[n // 2 :]))
    assert sorted(map(tuple, bloom.merged(one, two).collect())) == sorted(map(tuple, words.collect()))


def test_bloom_filter_of_the_default_size(spark):
    """Positions stay whole numbers far beyond 2^31 bits, whatever the halves of the digest are."""
    bits = identity.bloom_bits(800_000_000, 0.01)
    ids = [f"{k * 0x9E3779B97F4A7C15F39CC0605CEDC834 % (1 << 128):032x}" for k in range(1, 400)]
    got = {r["uuid"]: r["p"] for r in spark.createDataFrame([(i,) for i in ids], "uuid string").select("uuid", bloom.positions(F.col("uuid"), bits).alias("p")).collect()}
    assert all(got[i] == plain_positions(i, bits) for i in ids) and max(max(p) for p in got.values()) > 1 << 32


def test_long_values_are_made_after_the_shuffle(spark, sf):
    """Bids are grouped by their numbers; names are made of them afterwards, and Python gets them by bytes."""
    from lotline import queries

    plan = queries.QUERIES["bids_msgpack"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(" not in plan[plan.index("collect_list(") :] and "repeat(" in plan
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_bloom_hashes_once(spark):
    """A UUID is hashed once for all its bits, when a filter is built and when it is probed."""
    ids = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("uuid"))
    words = bloom.built(ids, "uuid", 1 << 17)
    hashes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("sha2(")
    assert hashes(words) == 1 and hashes(bloom.probed(ids, "uuid", words, 1 << 17)) == 2


def test_bloom_filter_shuffles_words_only(spark):
    """No UUID is shuffled to build a filter, and one that comes again changes nothing."""
    ids = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("uuid"))
    words = bloom.built(ids.union(ids), "uuid", 1 << 17)
    shuffles = [line for line in words._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert len(shuffles) == 1 and "word" in shuffles[0]
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, bloom.built(ids, "uuid", 1 << 17).collect()))


def test_shuffle_files_go_when_a_query_ends(spark):
    """What a query shuffles is deleted when it ends, not when the driver collects its garbage."""
    import time

    configure(spark)
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle")}
    before, df = files(), spark.range(1000).repartition(4, "id")
    df.write.format("noop").mode("overwrite").save()
    for _ in range(5):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and df.count() == 1000


def test_events_are_made_in_one_pass(spark, sf):
    """The stream's input: orders and bids are read once for all events of an auction, shuffled once each and
    once together; four events of ten auctions are as the rules say."""
    from lotline import queries

    df = queries.auction_events(spark, sf, 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") <= 4
    rows = df.where("auction_uid between 10 and 19").groupBy("auction_uid").agg(F.count("*").alias("n"), F.count("uuid").alias("uuids"), F.count("tag").alias("tags"), F.count("seller").alias("sellers"), F.sum(F.expr("int(highest_bid > 0)")).alias("priced")).collect()
    high = {r["auction_uid"]: int(r["is_sold"]) for r in tables.auctions(spark, sf).where("auction_uid between 10 and 19").collect()}
    assert len(rows) == 10
    for r in rows:
        k = r["auction_uid"] % 10
        assert tuple(r)[1:] == {1: (3, 3, 2, 2, high[r["auction_uid"]]), 2: (3, 2, 3, 3, 2 * high[r["auction_uid"]])}.get(k, (2, 2, 2, 2, high[r["auction_uid"]]))


def test_merge_shuffles_its_rows_once(spark, tmp_path, monkeypatch):
    """Stored and new rows of a merge are shuffled once to be compared, not the new ones once more."""
    import re

    plans, best = [], merge.best_per_key

    def noted(*a):
        plans.append(best(*a))
        return plans[-1]

    monkeypatch.setattr(months.merge, "best_per_key", noted)
    a = months.MonthArchive(spark, str(tmp_path))
    for batch in (0, 1):
        rows = spark.createDataFrame([(f"{i:032x}", "t", T, i + batch, "v") for i in range(20)], AUCTIONS)
        assert a.merge(rows, "s", batch)
    text = plans[-1]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(tag#\d+, month#\d+, uuid#\d+", text)) == 1
    assert sorted(r["highest_bid"] for r in a.read().collect()) == list(range(1, 21))


AUCTIONS = "uuid string, tag string, end_ts timestamp_ntz, highest_bid long, v string"


def test_archive_is_merged_when_written(spark, tmp_path):
    """One and one are two; a batch that comes again changes nothing; other folders stay as they are."""
    june, july, a, b, c = T, datetime(2024, 7, 1), "a" * 32, "b" * 32, "c" * 32
    kept = months.MonthArchive(spark, str(tmp_path / "x"))
    put = lambda rows, n, source="s": kept.merge(spark.createDataFrame(rows, AUCTIONS), source, n)
    got = lambda: sorted((r["uuid"][0], r["tag"], r["month"], r["highest_bid"], r["v"]) for r in kept.read().collect())
    with pytest.raises(ValueError, match="nothing is archived"):
        kept.read()
    assert put([(a, "A:B/ü 1", june, 5, "one"), (c, "007", july, 1, "one")], 1)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "x/data").rglob("*.parquet") if "007" in str(p)}
    assert put([(b, "A:B/ü 1", june, 7, "two"), ("unknown", "A:B/ü 1", june, 7, "two"), (None, "007", july, 9, "two"), (a.upper(), "A:B/ü 1", june, 4, "two")], 2)
    merged = [("a", "A:B/ü 1", "2024-06", 5, "one"), ("b", "A:B/ü 1", "2024-06", 7, "two"), ("c", "007", "2024-07", 1, "one")]
    assert got() == merged
    assert not put([(a, "A:B/ü 1", june, 99, "again")], 2) and not put([(a, "A:B/ü 1", june, 99, "again")], 1) and got() == merged
    assert put([(a, "A:B/ü 1", june, 5, "three"), (a, "A:B/ü 1", july, 5, "three"), (b, None, june, 1, "three")], 1, "other")
    assert got() == sorted([("a", "A:B/ü 1", "2024-06", 5, "three"), ("a", "A:B/ü 1", "2024-07", 5, "three"), ("b", "unknown", "2024-06", 1, "three"), *merged[1:]])
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "x/data").rglob("*.parquet") if "007" in str(p)} == files
    one = kept.read().where("tag = 'A:B/ü 1' and month = '2024-06'")
    assert partitions_read(one)[0] <= 3  # the versions of one folder
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan or "PartitionFilters: [isnotnull(month" in plan
    before = got()
    assert kept.tidy(keep=1) == 2 and got() == before and partitions_read(one) and kept.versions() == [3]
    put([], 2, "other")
    assert got() == before


def test_a_lost_batch_leaves_the_archive_as_it_was(spark, tmp_path):
    kept = months.MonthArchive(spark, str(tmp_path / "x"))
    kept.merge(spark.createDataFrame([("a" * 32, "t", T, 5, "one")], AUCTIONS), "s", 1)
    broken = spark.createDataFrame([("b" * 32, "t", T, 6, "two"), ("c" * 32, "u", T, 6, "two")], AUCTIONS)
    failing = broken.withColumn("v", F.when(F.col("uuid") == "c" * 32, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        kept.merge(failing, "s", 2)
    assert kept.read().count() == 1
    # files of a version that was never named are not read, and are replaced
    broken.withColumn("month", F.lit("2024-06")).withColumn("version", F.lit(2)).where("tag = 'u'").write.mode("append").partitionBy("tag", "month", "version").parquet(str(tmp_path / "x/data"))
    assert kept.read().count() == 1
    assert kept.merge(broken, "s", 2) and kept.read().count() == 3


def test_budget_stops_at_the_newest_partitions(spark, tmp_path):
    """The budget is met by the first months, and older partitions are never looked at."""
    rows = sold(spark, range(1200)).withColumn("end_ts", F.col("end_ts") - F.make_dt_interval(F.col("auction_uid").cast("int"))).withColumn("time_key", timekey.time_key(F.col("tag"), F.col("end_ts")).cast("int"))
    rows.write.partitionBy("tag", "time_key").parquet(str(tmp_path / "hot"))
    archive.write(rows.where("end_ts < '2024-05-01'").drop("time_key"), str(tmp_path / "cold"))
    hot = spark.read.parquet(str(tmp_path / "hot")).withColumn("time_key", F.col("time_key").cast("int"))
    cold = archive.read(spark, str(tmp_path / "cold"))
    args = (hot, cold, "x", "2020-01-01 00:00:00", "2024-06-15 12:00:00")
    spent = scan.spend(*args, 20, F.lit(True))
    assert spent.archived == [] and len(spent.keys) in (3, 4) and spent.looked_at < 12
    out = scan.budgeted(*args, 20)
    assert [r["auction_uid"] for r in out.collect()] == list(range(20))
    assert all(n <= 4 for n in partitions_read(out))
    wide = scan.spend(*args, 100, F.col("auction_uid") % 2 == 0)
    assert 3 <= len(wide.archived) <= 7 and wide.looked_at < 40
    got = [r["auction_uid"] for r in scan.budgeted(*args, 100, F.col("auction_uid") % 2 == 0).collect()]
    assert len(got) == 100 and set(got) == set(range(0, 200, 2))
    assert scan.budgeted(*args, 10**9).count() == 1200
    assert scan.budgeted(hot, None, "x", *args[3:], 7).count() == 7 and scan.budgeted(hot, cold, "none", *args[3:], 7).count() == 0


def test_clocks(spark):
    got = lambda f, ts, zone: one(spark, f(F.lit(ts).cast("timestamp_ntz"), zone))
    utc = lambda ts: got(timekey.local_to_utc, ts, "Europe/Berlin")
    assert utc("2024-01-15 12:00:00") == datetime(2024, 1, 15, 11) and utc("2024-07-15 12:00:00.5") == datetime(2024, 7, 15, 10, 0, 0, 500_000)
    assert utc("2024-10-27 02:30:00") == datetime(2024, 10, 27, 1, 30)  # comes twice
    assert utc("2024-03-31 02:30:00") == datetime(2024, 3, 31, 1, 30)  # is left out
    assert got(timekey.local_hours, "2024-01-15 12:00:00", "Asia/Kolkata") == datetime(2024, 1, 15, 7)
    assert got(timekey.local_hours, "2024-01-15 12:00:00", "America/St_Johns") == datetime(2024, 1, 15, 15)


def test_bad_rows_do_not_stop_the_rest(spark, tmp_path):
    """Two bad rows of a hundred and copies of one are dead, the others are written; a batch that was lost
    half way is written once."""
    rows = spark.createDataFrame([(i, "x" if i in (17, 60) else str(i)) for i in range(100)] + [(17, "x")], "id long, price string")
    calls = []

    def strict(x, path):
        calls.append(path)
        if len(calls) == crash_at:
            raise KeyboardInterrupt
        x.select("id", F.when(F.col("price") == "x", F.raise_error(F.lit("bad price")).cast("long")).otherwise(F.col("price").cast("long")).alias("price")).write.parquet(path)

    crash_at = 4
    out = sinks.Sinks(spark, str(tmp_path), {"strict": strict})
    with pytest.raises(KeyboardInterrupt):
        out.write(rows, 7)
    assert out.outcomes().count() == 0
    crash_at = -1
    done = out.write(rows, 7)
    assert [(o.sink, o.status, o.written, o.dead) for o in done] == [("strict", "done", 98, 3)]
    assert out.write(rows, 7) == []
    assert sorted(r["id"] for r in out.written("strict").collect()) == sorted(set(range(100)) - {17, 60})
    dead = sorted((r["row"], "bad price" in r["error"]) for r in out.dead().collect())
    assert dead == [('{"id":17,"price":"x"}', True)] * 2 + [('{"id":60,"price":"x"}', True)]


def test_a_sink_that_is_down_gets_its_batches_later(spark, tmp_path):
    rows = lambda k: spark.createDataFrame([(k * 10 + i,) for i in range(10)], "id long")
    down = True

    def fails(x, path):
        if down:
            raise OSError("no route")
        x.write.parquet(path)

    out = sinks.Sinks(spark, str(tmp_path), {"good": lambda x, path: x.write.parquet(path), "bad": fails})
    status = lambda: {(r["sink"], r["batch"]): (r["status"], r["tries"], r["due"]) for r in out.outcomes().collect()}
    out.write(rows(1), 1)
    assert status() == {("good", 1): ("done", 1, -1), ("bad", 1): ("down", 1, 2)}
    out.write(rows(2), 2)  # due, and down again: the next try is two batches later
    assert status()[("bad", 1)] == ("down", 2, 4) and status()[("bad", 2)] == ("down", 1, 3)
    down = False
    out.write(rows(3), 3)
    assert status()[("bad", 1)][0] == "down" and status()[("bad", 2)] == ("done", 2, -1)
    out.write(rows(4), 4)
    assert all(x[0] == "done" for x in status().values())
    for name in ("good", "bad"):
        assert sorted(r["id"] for r in out.written(name).collect()) == list(range(10, 50))
    assert out.dead().count() == 0


def test_metrics_of_two_batches(spark, tmp_path):
    event = lambda uid, seller=1, tag="t", bid=5: (1, uid, tag, seller, T, T, bid, T, [(8, 5, T), (8, 5, T)])
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in ([event("a"), event("a"), event("b"), event(None), event("c", None, None, 0)], [event("a")]):
        spark.createDataFrame(rows, ingest.EVENTS).coalesce(1).write.mode("append").parquet(src)
        ingest.start(ingest.file_source(spark, src), out, cp, mirror=False).awaitTermination()
        metrics.settled(spark)
    got = {(r["batch"], r["name"]): r["value"] for r in metrics.metrics(spark, f"{out}/metrics").where("name <> 'batch_ms'").collect()}
    assert got == {(0, "rows_in"): 5, (0, "junk"): 1, (0, "without_uuid"): 1, (0, "kept"): 2, (0, "bids"): 1, (1, "rows_in"): 1, (1, "junk"): 0, (1, "without_uuid"): 0, (1, "kept"): 1, (1, "bids"): 1}


def test_messagepack_widths():
    """Every width of every type, by the bytes that the format gives it, there and back."""
    heads = {0: "00", 127: "7f", 128: "cc80", 255: "ccff", 256: "cd0100", 65535: "cdffff", 65536: "ce00010000", 2**32: "cf0000000100000000", 2**64 - 1: "cfffffffffffffffff", -1: "ff", -32: "e0", -33: "d0df", -128: "d080", -129: "d1ff7f", -32768: "d18000", -32769: "d2ffff7fff", -(2**31) - 1: "d3ffffffff7fffffff", -(2**63): "d38000000000000000"}
    for value, text in heads.items():
        assert packed.packed(value).hex() == text and packed.unpacked(bytes.fromhex(text)) == value
    for value, head in [("", "a0"), ("é" * 15, "be"), ("x" * 32, "d920"), ("x" * 256, "da0100"), ("x" * 65536, "db00010000"), (b"", "c400"), (b"x" * 256, "c50100"), (b"x" * 65536, "c600010000"), ([], "90"), ([1] * 15, "9f"), ([1] * 16, "dc0010"), ([1] * 65536, "dd00010000"), ({}, "80"), ({i: i for i in range(15)}, "8f"), ({i: i for i in range(16)}, "de0010"), ({i: 1 for i in range(65536)}, "df00010000"), (None, "c0"), (False, "c2"), (True, "c3"), (1.5, "cb3ff8000000000000")]:
        assert packed.packed(value).hex().startswith(head) and packed.unpacked(packed.packed(value)) == value
    times = {packed.EPOCH: "d6ff00000000", packed.EPOCH + timedelta(microseconds=1): "d7ff", packed.EPOCH - timedelta(microseconds=1): "c70cff", packed.EPOCH + timedelta(days=80_000): "d7ff"}
    for value, head in times.items():
        assert packed.packed(value).hex().startswith(head) and packed.unpacked(packed.packed(value)) == value
    assert packed.unpacked(bytes.fromhex("ca3fc00000")) == 1.5
    assert [packed.unpacked(bytes.fromhex(x)) for x in ("d40501", "d5050102", "d6" + "05" + "01" * 4, "d8" + "05" + "01" * 16, "c70105" + "07", "c8000105" + "07", "c90000000105" + "07")] == [(5, b"\1"), (5, b"\1\2"), (5, b"\1" * 4), (5, b"\1" * 16)] + [(5, b"\7")] * 3
    for bad, why in [("c1", "type byte"), ("cd01", "cut off"), ("9201", "cut off"), ("", "cut off"), ("0101", "follow")]:
        with pytest.raises(ValueError, match=why):
            packed.unpacked(bytes.fromhex(bad))


def test_packed_bids(spark):
    rows = [(0, [("a" * 32, "b" * 32, 2**62, datetime(2024, 6, 15, 12, 0, 0, 123456), None, "c" * 32), (None, None, None, None, "né", None)]), (1, []), (2, None)]
    df = spark.createDataFrame(rows, f"k int, bids array<struct<{packed.BID.replace(', ', ',').replace(' ', ':')}>>")
    out = df.select("k", "bids", packed.bids_packed(F.col("bids")).alias("x")).select("k", packed.bids_unpacked(F.col("x")).eqNullSafe(F.col("bids")).alias("same"), F.hex("x").alias("x"))
    got = {r["k"]: (r["same"], r["x"]) for r in out.collect()}
    assert got[0][0] and got[0][1].startswith("9296D924" + b"aaaaaaaa-aaaa-".hex().upper()) and got[1] == (True, "90") and got[2] == (True, None)
    assert df.select(packed.bids_unpacked(F.lit(b"")).alias("x")).first()["x"] is None


def test_packed_bids_in_columns(spark):
    """Batches of bids get the bytes that the plain writer makes and are read in columns, every form of the fields'
    types; other forms are read one by one, and raise as before."""
    import pyarrow as pa

    epoch, ids = packed.EPOCH, ["", "unknown", "a" * 32, "é" * 32, "0" * 31, None]
    amounts = [0, 127, 128, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**63 - 1, -1, -32, -33, -128, -129, -32768, -32769, -(2**31), -(2**31) - 1, -(2**63), None]
    times = [epoch, epoch + timedelta(microseconds=1), epoch - timedelta(microseconds=1), epoch + timedelta(seconds=2**32 - 1), epoch + timedelta(seconds=2**32), epoch + timedelta(seconds=2**34), epoch + timedelta(days=-700_000, microseconds=5), epoch + timedelta(days=20_000, microseconds=999_999), None]
    names = [None, "", "é" * 15, "b" * 31, "b" * 32, "b" * 255, "b" * 256, "é" * 32767 + "b", "b" * 65536]
    bids = [dict(zip(packed.FIELDS, (ids[i % 6], ids[(i + 1) % 6], amounts[i % 21], times[i % 9], names[i % 9], ids[(i + 2) % 6]))) for i in range(70)]
    dashed = lambda x: f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}" if x and len(x) == 32 else x
    for rows in ([bids[:n] for n in (0, 1, 15, 16, 60)] + [None, bids], [], [None], [[]], [bids[:1] * 65536], [bids[i : i + 3] for i in range(60)]):
        want = [None if r is None else packed.packed([[dashed(v) if k in packed.IDS else v for k, v in b.items()] for b in r]) for r in rows]
        given = pa.array([[{"amount": 1}], *rows], packed.ROWS)[1:]
        values = packed._pack(given)
        assert values.to_pylist() == want
        undashed = [None if r is None else [{k: v.replace("-", "") if k in packed.IDS and v else v for k, v in b.items()} for b in r] for r in rows]
        assert packed._unpack(values).to_pylist() == packed._one_by_one(values).to_pylist() == undashed
    assert packed._columns(packed._pack(pa.array([bids[i : i + 3] for i in range(60)], packed.ROWS))).to_pylist() == [bids[i : i + 3] for i in range(60)]
    plain = packed.packed([["a", "b", 5, epoch, None, "c"]]).hex()
    forms = [plain, "dc0001" + plain[2:], "dd00000001" + plain[2:], plain.replace("a161", "d90161"), plain.replace("a161", "db0000000161"), plain.replace("a16205", "a162d3fffffffffffffffe"), plain.replace("a16205", "a162d101ff"), plain.replace("d6ff00000000", "d7ff" + "00" * 8), plain.replace("d6ff00000000", "c70cff" + "00" * 12), "", "c0", "90"]
    values = pa.array([bytes.fromhex(x) for x in forms])
    assert packed._columns(values).to_pylist() == packed._one_by_one(values).to_pylist()
    short = pa.array([bytes.fromhex("dc0001dc0006" + plain[4:]), bytes.fromhex(packed.packed([["x", "y"]]).hex())])
    assert packed._unpack(short).to_pylist()[0][0]["bidder"] == "b" and packed._unpack(short).to_pylist()[1][0]["amount"] is None
    for bad in (plain[:-2], plain + "c0", "91", "c1", "9201", "dd7fffffff", plain.replace("a161", "c1"), plain.replace("a16205", "a162cfffffffffffffffff"), plain.replace("a161", "a1ff")):
        with pytest.raises(Exception, match="."):
            packed._unpack(pa.array([bytes.fromhex(bad)]))


def test_item_trees(spark):
    import gzip
    import struct

    text = lambda x: struct.pack(">H", len(x.encode())) + x.encode()
    every = b"\x0a" + text("root") + b"\x01" + text("b") + b"\xff" + b"\x02" + text("s") + b"\x01\x00" + b"\x03" + text("i") + struct.pack(">i", -5) + b"\x04" + text("l") + struct.pack(">q", 2**40)
    every += b"\x05" + text("f") + struct.pack(">f", 0.5) + b"\x06" + text("d") + struct.pack(">d", 0.1) + b"\x07" + text("bytes") + struct.pack(">i3b", 3, 1, 2, -3) + b"\x08" + text("né") + text("té")
    every += b"\x09" + text("list") + b"\x0a" + struct.pack(">i", 2) + b"\x08" + text("x") + text("1") + b"\0" + b"\x09" + text("y") + b"\x02" + struct.pack(">i2h", 2, 7, 8) + b"\0"
    every += b"\x0a" + text("c") + b"\x0b" + text("ints") + struct.pack(">i2i", 2, 1, -1) + b"\x0c" + text("longs") + struct.pack(">iq", 1, 2**50) + b"\0" + b"\x09" + text("none") + b"\x00" + struct.pack(">i", 0) + b"\0"
    want = {"b": "-1", "s": "256", "i": "-5", "l": str(2**40), "f": "0.5", "d": "0.1", "bytes": "1,2,-3", "né": "té", "list.0.x": "1", "list.1.y.0": "7", "list.1.y.1": "8", "c.ints": "1,-1", "c.longs": str(2**50)}
    assert nbt.flattened(every) == want == nbt.flattened(gzip.compress(every))
    assert nbt.flattened(nbt.tree({"a": {"b": [1, 2], "c": 1.5, "d": b"\1\2"}, "e": 2**40, "f": [{"g": "h"}]})) == {"a.b.0": "1", "a.b.1": "2", "a.c": "1.5", "a.d": "1,2", "e": str(2**40), "f.0.g": "h"}
    deep_bytes = b"\x0a" + text("") + (b"\x0a" + text("x")) * 3000 + b"\0" * 3001
    assert nbt.flattened(deep_bytes) == {}
    for bad in (every[:40], every[:-1], b"", b"\x03" + text("") + b"\0" * 4):
        with pytest.raises(ValueError):
            nbt.flattened(bad)
    df = spark.createDataFrame([(0, bytearray(every)), (1, None), (2, bytearray())], "k int, item binary")
    got = {r["k"]: r["m"] for r in df.select("k", nbt.attributes(F.col("item")).alias("m")).collect()}
    assert got == {0: want, 1: None, 2: None}


def test_jobs_run_by_their_log(spark, tmp_path):
    from lotline.operators import jobs

    rows, log, at = sold(spark, [5]).withColumn("bin", F.lit(True)), f"{tmp_path}/log", datetime(2024, 6, 16)
    job = export.checked(export.Job("A@b", "x", T - timedelta(days=1), T, ("Uuid", "Tag")), T)
    bad = export.checked(export.Job("a@b", "x", T - timedelta(days=1), T, ("Uuid", "Tier")), T)
    step = lambda k: at + timedelta(seconds=k)
    jobs.save(spark.createDataFrame([("a@b", at, j, step(0), "request") for j in ("good", "bad", "gone")] + [("a@b", at, "gone", step(1), "abort")], jobs.ACTION), log)
    run = lambda j, name, k: jobs.run(j, name, at, rows, f"{tmp_path}/{name}", log, step(k)).status
    assert (run(job, "good", 2), run(bad, "bad", 3), run(job, "gone", 4), run(job, "good", 5), run(job, "unknown", 6)) == ("Done", "Failed", "Pending", "Pending", "Pending")
    got = {r["job_id"]: (r["status"], r["changed_at"]) for r in jobs.states(spark.read.parquet(log)).collect()}
    assert got == {"good": ("Done", step(2.000001)), "bad": ("Failed", step(3.000001)), "gone": ("Aborted", step(1))}
    assert not (tmp_path / "gone").exists() and list((tmp_path / "good").glob("*.csv"))


def test_ranks_in_parts(spark):
    rows = [(i, "hot" if i % 5 else None, T + timedelta(minutes=37 * (i * 7 % 50))) for i in range(200)] + [(7, "hot", T), (7, "hot", T)]
    df = spark.createDataFrame(rows, "auction_uid long, tag string, end_ts timestamp_ntz").repartition(4)
    got = {}
    for r in scan.chunks(df, ["tag"], 10, ids=16).collect():
        got.setdefault((r["tag"], r["chunk"]), []).append(r["auction_uid"])
    for tag in ("hot", None):
        ids = sorted(r[0] for r in rows if r[1] == tag)
        assert [sorted(got[tag, k]) for k in range(-(-len(ids) // 10))] == [ids[k : k + 10] for k in range(0, len(ids), 10)]
    nth = sorted((r["tag"] or "", r["auction_uid"], r["end_ts"]) for r in scan.every_nth(df, ["tag"], 9).collect())
    want = []
    for tag in ("hot", None):
        mine = sorted((r[2], r[0]) for r in rows if r[1] == tag)
        want += [(tag or "", uid, end) for end, uid in mine[8::9]]
    assert nth == sorted(want)
    assert scan.chunks(df.limit(0), ["tag"], 10).count() == 0


def test_one_auction_again(spark):
    schema = "auction_uid long, seller long, highest_bid long"
    stored = spark.createDataFrame([(1, 5, 10), (2, 5, 10)], schema)
    source = spark.createDataFrame([(1, 5, 10), (2, 5, 11), (3, 5, 1)], schema)
    again = lambda k: [r["action"] for r in merge.reimport(stored, source, k, ["auction_uid"], ["seller", "highest_bid"]).collect()]
    assert again(1) == [] and again(2) == ["update"] and again(3) == ["insert"] and again(4) == []


def test_uid_is_that_of_the_hash(spark):
    import xxhash

    made = xxhash.xxh64_intdigest(b"a" * 32, 42)
    assert one(spark, identity.auction_uid(F.lit(None).cast("long"), F.lit("a" * 32))) == (made - (1 << 64) if made >> 63 else made)
    assert one(spark, identity.auction_uid(F.lit(9).cast("long"), F.lit("a" * 32))) == 9


def test_messages(spark):
    texts = ['{"auction_uid":5,"uuid":"a","tag":"t","end_ts":"2024-06-15T12:00:00","highest_bid":9,"bids":[{"bidder":8,"amount":9,"ts":"2024-06-15T11:00:00.5"}],"more":1}', "no json", "[1]", "", '{"uuid":"b"}']
    rows = ingest.decoded(spark.createDataFrame([(bytearray(t.encode()),) for t in texts] + [(None,)], "value binary")).collect()
    assert len(rows) == 6 and [r["uuid"] for r in rows] == ["a", None, None, None, "b", None]
    assert rows[0]["end_ts"] == T and [tuple(b) for b in rows[0]["bids"]] == [(8, 9, datetime(2024, 6, 15, 11, 0, 0, 500_000))]


def test_dates_as_people_write_them(spark):
    at = lambda x: one(spark, timekey.parsed(F.lit(x).cast("string")))
    noon = datetime(2024, 6, 5, 12, 30)
    for text in ("2024-06-05T12:30:00Z", "2024-06-05T14:30:00+02:00", "2024-06-05T12:30:00.000", "2024-06-05 12:30", " 05.06.2024 12:30:00 ", "06/05/2024 12:30", "5 Jun 2024 12:30", "1717590600"):
        assert at(text) == noon, text
    assert [at(x) for x in ("2024-13-01", "31.02.2024", "tomorrow", "", None, "12")] == [None] * 6
    assert at("2024-06-05") == datetime(2024, 6, 5)


def test_listing_of_files(spark, tmp_path):
    archive.write(sold(spark, [5], "A B+c%"), str(tmp_path / "x y+z"))
    rows = archive.listed(spark, str(tmp_path / "x y+z")).where("key like 'tag=%'").collect()
    assert len(rows) == 1 and rows[0]["key"].startswith("tag=A B+c%25/month=2024-06/part-") and rows[0]["length"] > 0 and rows[0]["modified"] is not None


def test_tasks_are_not_put_together_beyond_16_mb(spark):
    """Some 24 MB of shuffled rows, which were one task before."""
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = configure(spark).range(3_000_000).select(F.xxhash64("id").alias("x")).groupBy("x").count()
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set(name, was)
