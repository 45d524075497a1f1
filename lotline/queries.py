"""The engine's queries over the test tables, by name, with their SQL for DuckDB.

"Now" is a fixed instant. Stores that the queries compare are whole views with rows left out by rule,
because the test tables hold one store only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.functions import identity, nbt, nested, packed, timekey
from lotline.operators import bloom, compare, export, filters, jobs, merge, players, prices, scan
from lotline.plans import memo
from lotline.session import configure
from lotline.sources import archive, months, tables
from lotline.streaming import completion, ingest, metrics, sinks

AS_OF, CUTOFF = "2025-08-01 00:00:00", "2025-05-01 00:00:00"
RECENT = "2024-06-27 00:00:00"  # 400 days before
FIRST_DAY, LAST_DAY = "2025-07-01 00:00:00", "2025-08-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = """WITH bids AS (
  SELECT l_orderkey AS auction_uid, l_suppkey AS bidder, CAST(round(l_extendedprice) AS BIGINT) AS amount, l_linenumber AS seq, l_shipdate + INTERVAL '24' YEAR AS ts FROM lineitem),
top AS (SELECT auction_uid, max(amount) AS high, count(*) AS n FROM bids GROUP BY auction_uid),
auctions AS (
  SELECT o_orderkey AS auction_uid, md5(CAST(o_orderkey AS VARCHAR)) AS uuid,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'ENCHANTED_BOOK' WHEN '5-LOW' THEN 'unknown' ELSE o_orderpriority END AS tag, o_custkey AS seller,
    (o_orderdate + INTERVAL '24' YEAR) + to_seconds((o_orderkey * 7919) % 86400) AS end_ts, (o_orderdate + INTERVAL '24' YEAR) - to_days(CAST(o_orderkey % 14 + 1 AS INT)) AS start_ts,
    o_orderkey % 2 = 0 AS bin, o_orderstatus AS tier, coalesce(high, 0) AS highest_bid, coalesce(n, 0) AS bid_count, coalesce(high, 0) > 0 AS is_sold
  FROM orders LEFT JOIN top ON top.auction_uid = o_orderkey),
keyed AS (SELECT *, CAST((epoch_us(end_ts) - 1546300800000000) // (CASE WHEN tag IN ('ENCHANTED_BOOK', 'unknown') THEN 43200000000 ELSE 604800000000 END) AS SMALLINT) AS time_key FROM auctions),
hot AS (SELECT * FROM keyed WHERE auction_uid % 13 <> 0),
cold AS (SELECT * FROM keyed WHERE auction_uid % 17 <> 0),
took_part AS (SELECT seller AS player, auction_uid, end_ts, tag, 0 AS type FROM auctions UNION ALL
  SELECT DISTINCT b.bidder, a.auction_uid, a.end_ts, a.tag, 1 FROM bids b JOIN auctions a USING (auction_uid))
"""


def query(sql: str | None = None):
    """Register a function of (auctions, bids) or of (spark, sf_dir) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = BASE + sql
        return f

    return add


def A(spark, d):
    return tables.keyed(tables.auctions(spark, d))


def B(spark, d):
    return tables.bids(spark, d)


def hot(spark, d):
    return A(spark, d).where("auction_uid % 13 <> 0")


def cold(spark, d):
    return A(spark, d).where("auction_uid % 17 <> 0")


def both_stores(spark, d):
    """hot() as version 0 and cold() as version 1, from one pass over the tables."""
    k = F.col("auction_uid")
    held = F.array_compact(F.array(F.when(k % 13 != 0, 0), F.when(k % 17 != 0, 1)))
    return A(spark, d).withColumn("version", F.explode(held))


def parts(spark, d):
    return players.participations(tables.auctions(spark, d), B(spark, d))


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares, or a temporary one of a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lotline-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


# --- scans and lookups


@query("SELECT auction_uid, end_ts, highest_bid FROM keyed WHERE tag = '3-MEDIUM' AND time_key = 300 AND is_sold")
def scan_hot_partition(spark, d):
    return A(spark, d).where("tag = '3-MEDIUM' and time_key = 300 and is_sold").select("auction_uid", "end_ts", "highest_bid")


@query("SELECT auction_uid, uuid, tag, seller, end_ts, highest_bid FROM auctions WHERE auction_uid = 7")
def auction_by_uid(spark, d):
    return A(spark, d).where("auction_uid = 7").select("auction_uid", "uuid", "tag", "seller", "end_ts", "highest_bid")


@query(f"SELECT auction_uid, tag, end_ts, highest_bid FROM auctions WHERE seller = 7 AND end_ts <= TIMESTAMP '{AS_OF}' ORDER BY end_ts DESC, auction_uid DESC LIMIT 10")
def player_recent(spark, d):
    top = scan.newest(tables.unpriced(spark, d).where((F.col("seller") == 7) & (F.col("end_ts") <= scan.ntz(AS_OF))), 10)
    return tables.few_priced(top, B(spark, d)).select("auction_uid", "tag", "end_ts", "highest_bid")


@query("SELECT auction_uid, (auction_uid * 31) % 1000 AS item_uid, tag FROM auctions WHERE (auction_uid * 31) % 1000 = 42")
def by_item_uid(spark, d):
    uid = identity.item_uid(F.hex((F.col("auction_uid") * 31) % 1000))
    return A(spark, d).select("auction_uid", uid.alias("item_uid"), "tag").where("item_uid = 42")


@query("SELECT DISTINCT tag, time_key FROM keyed")
def list_partitions(spark, d):
    return tables.keyed(tables.auctions(spark, d)).select("tag", "time_key").distinct()


@query("SELECT bidder, auction_uid, amount, seq, ts FROM bids WHERE bidder = 7")
def bids_by_bidder(spark, d):
    return B(spark, d).where("bidder = 7").select("bidder", "auction_uid", "amount", "seq", "ts")


@query("""SELECT a.auction_uid, count(b.amount) AS n_bids, coalesce(string_agg(b.amount || ':' || b.bidder || ':' || b.seq, ',' ORDER BY b.amount, b.bidder, b.seq), '') AS bid_list
FROM auctions a LEFT JOIN bids b USING (auction_uid) GROUP BY a.auction_uid""")
def auction_with_children(spark, d):
    rows = tables.with_bids(tables.auctions(spark, d).select("auction_uid"), B(spark, d))
    text = F.array_join(F.transform("bids", lambda b: F.concat_ws(":", b["amount"].cast("string"), b["bidder"].cast("string"), b["seq"].cast("string"))), ",")
    return rows.select("auction_uid", F.size("bids").cast("long").alias("n_bids"), text.alias("bid_list"))


@query("SELECT auction_uid, tag FROM auctions WHERE auction_uid > 100 ORDER BY auction_uid LIMIT 2000")
def keyset_page(spark, d):
    return scan.page(A(spark, d), 100, 2000).select("auction_uid", "tag")


@query("SELECT auction_uid, tag FROM auctions WHERE auction_uid >= 500 AND auction_uid < 3000")
def id_window(spark, d):
    return A(spark, d).where("auction_uid >= 500 and auction_uid < 3000").select("auction_uid", "tag")


@query("SELECT min(auction_uid) AS first_id FROM auctions WHERE end_ts >= TIMESTAMP '2024-01-01'")
def first_id_after(spark, d):
    return A(spark, d).where(F.col("end_ts") >= scan.ntz("2024-01-01")).agg(F.min("auction_uid").alias("first_id"))


@query(f"SELECT auction_uid, uuid, tag, strftime(end_ts, '%Y-%m') AS month, end_ts, highest_bid FROM cold WHERE end_ts < TIMESTAMP '{CUTOFF}' AND tag = '2-HIGH'")
def archive_read(spark, d):
    path = folder(spark)
    archive.write(cold(spark, d).where(F.col("end_ts") < scan.ntz(CUTOFF)).select("auction_uid", "uuid", "tag", "end_ts", "highest_bid"), path, as_json=True)
    rows = archive.read(spark, path, "auction_uid long, uuid string, end_ts timestamp_ntz, highest_bid long, tag string, month string", as_json=True)
    return rows.where("tag = '2-HIGH'").select("auction_uid", "uuid", "tag", "month", "end_ts", "highest_bid")


@query("SELECT DISTINCT tag, strftime(end_ts, '%Y-%m') AS month, true AS has_data FROM cold")
def blob_list(spark, d):
    """What the files of an archive are named after; other files, such as markers, have no tag and month."""
    path = folder(spark)
    archive.write(cold(spark, d).select("auction_uid", "uuid", "tag", "end_ts", "highest_bid"), path)
    keys = archive.listed(spark, path)
    tag, month = (F.nullif(F.regexp_extract("key", p, 1), F.lit("")) for p in (r"^tag=([^/]+)/", r"/month=(\d{4}-\d{2})/"))
    return keys.select(tag.alias("tag"), month.alias("month"), "length").where("tag is not null").groupBy("tag", "month").agg((F.sum("length") > 0).alias("has_data"))


@query("SELECT DISTINCT 'auctions/' || tag || '/' || strftime(end_ts, '%Y-%m') || '.json.gz' AS key, tag, strftime(end_ts, '%Y-%m') AS month FROM auctions")
def blob_key_parse(spark, d):
    keys = A(spark, d).select(identity.archive_key(F.col("tag"), timekey.month(F.col("end_ts"))).alias("key")).distinct()
    tag, month = identity.archive_key_parts(F.col("key"))
    return keys.select("key", tag.alias("tag"), month.alias("month"))


@query("SELECT DISTINCT strftime(end_ts, '%Y-%m') AS month FROM auctions WHERE tag = '2-HIGH' ORDER BY month")
def available_months(spark, d):
    return A(spark, d).where("tag = '2-HIGH'").select(timekey.month(F.col("end_ts")).alias("month")).distinct().orderBy("month")


@query("SELECT auction_uid, end_ts, tag, type FROM took_part WHERE player = 7 AND year(end_ts) = 2024")
def participation_year(spark, d):
    return parts(spark, d).where((F.col("player") == 7) & (F.year("end_ts") == 2024)).select("auction_uid", "end_ts", "tag", "type")


@query("SELECT auction_uid, tag, end_ts FROM auctions WHERE tag = 'unknown' AND end_ts > TIMESTAMP '2024-01-01' AND end_ts <= TIMESTAMP '2024-03-01'")
def time_range_scan(spark, d):
    return scan.in_range(A(spark, d), "2024-01-01 00:00:00", "2024-03-01 00:00:00", "unknown").select("auction_uid", "tag", "end_ts")


@query(f"""SELECT auction_uid, tag, end_ts, origin FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY CAST((origin = 'hot') = (end_ts > TIMESTAMP '{CUTOFF}') AS INT) DESC, origin) AS r
FROM (SELECT *, 'hot' AS origin FROM hot UNION ALL SELECT *, 'cold' FROM cold)) WHERE r = 1""")
def tiered_scan(spark, d):
    return scan.tiers(hot(spark, d), cold(spark, d), CUTOFF).select("auction_uid", "tag", "end_ts", "origin")


# --- sinks and merges


@query("""SELECT auction_uid, seller, highest_bid + CASE WHEN auction_uid % 3 = 0 THEN 1 ELSE 0 END AS highest_bid, CASE WHEN auction_uid % 13 = 0 THEN 'insert' ELSE 'update' END AS action
FROM keyed WHERE auction_uid % 13 = 0 OR auction_uid % 3 = 0""")
def upsert_changed_only(spark, d):
    new = A(spark, d).withColumn("highest_bid", F.col("highest_bid") + F.when(F.col("auction_uid") % 3 == 0, 1).otherwise(0)).where(~filters.junk())
    key = ["tag", "time_key", "is_sold", "end_ts", "auction_uid"]
    sold = F.coalesce((F.col("highest_bid") > 0) & (F.col("auction_uid") % 3 != 0), F.lit(False)) | ((F.col("auction_uid") % 3 == 0) & (F.col("highest_bid") > 1))
    return merge.upsert_changed(hot(spark, d), new.withColumn("is_sold", sold), key, ["seller", "highest_bid"]).select("auction_uid", "seller", "highest_bid", "action")


@query("""SELECT auction_uid, highest_bid, write_ts FROM (SELECT *, row_number() OVER (PARTITION BY auction_uid ORDER BY write_ts DESC, highest_bid DESC) AS r FROM (
  SELECT auction_uid, 0 AS highest_bid, start_ts AS write_ts FROM auctions UNION ALL SELECT a.auction_uid, a.highest_bid, w.ts FROM auctions a JOIN (SELECT auction_uid, max(ts) AS ts FROM bids GROUP BY 1) w USING (auction_uid))) WHERE r = 1""")
def upsert_lww(spark, d):
    rows = tables.auctions(spark, d).select("auction_uid", "highest_bid", "start_ts")
    first = rows.select("auction_uid", F.lit(0).cast("long").alias("highest_bid"), F.col("start_ts").alias("write_ts"))
    last = rows.join(B(spark, d).groupBy("auction_uid").agg(F.max("ts").alias("write_ts")), "auction_uid").select("auction_uid", "highest_bid", "write_ts")
    return merge.last_write(first.unionByName(last), ["auction_uid"])


@query("SELECT bidder, ts, amount, auction_uid, seq FROM (SELECT *, row_number() OVER (PARTITION BY bidder, ts ORDER BY amount DESC, auction_uid DESC, seq DESC) AS r FROM bids) WHERE r = 1")
def bids_dedup(spark, d):
    return players.last_bids(B(spark, d)).select("bidder", "ts", "amount", "auction_uid", "seq")


@query("""SELECT uuid, tag, strftime(end_ts, '%Y-%m') AS month, highest_bid, v FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY highest_bid DESC, v DESC) AS r FROM (
  SELECT uuid, tag, end_ts, highest_bid, 0 AS v FROM hot UNION ALL SELECT uuid, tag, end_ts, highest_bid - CASE WHEN auction_uid % 5 = 0 THEN 1 ELSE 0 END, 1 FROM cold WHERE end_ts > TIMESTAMP '2025-01-01')) WHERE r = 1 AND tag = '2-HIGH'""")
def archive_on_write(spark, d):
    """Two batches merged into stored folders, the second touching the last months only and sent twice."""
    kept = months.MonthArchive(spark, folder(spark))
    names = ["uuid", "tag", "end_ts", "highest_bid", "v"]
    kept.merge(hot(spark, d).withColumn("v", F.lit(0)).select(*names), "hot", 1)
    late = cold(spark, d).where(F.col("end_ts") > scan.ntz("2025-01-01 00:00:00")).withColumn("v", F.lit(1))
    late = late.withColumn("highest_bid", F.col("highest_bid") - F.when(F.col("auction_uid") % 5 == 0, 1).otherwise(0)).withColumn("uuid", F.upper("uuid"))
    for _ in range(2):
        kept.merge(late.select(*names), "cold", 1)
    return kept.read().where("tag = '2-HIGH'").select("uuid", "tag", "month", "highest_bid", "v")


@query("""SELECT uuid, tag, highest_bid, v FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY highest_bid DESC, v DESC) AS r FROM (
  SELECT uuid, tag, highest_bid, 0 AS v FROM hot UNION ALL SELECT uuid, tag, CASE WHEN auction_uid % 5 = 0 THEN highest_bid - 1 ELSE highest_bid END, 1 FROM cold)) WHERE r = 1""")
def archive_merge(spark, d):
    old = hot(spark, d).select("uuid", "tag", "highest_bid", F.lit(0).alias("v"))
    new = cold(spark, d).select(F.upper("uuid").alias("uuid"), "tag", F.when(F.col("auction_uid") % 5 == 0, F.col("highest_bid") - 1).otherwise(F.col("highest_bid")).alias("highest_bid"), F.lit(1).alias("v"))
    return merge.archive(old, new)


@query("SELECT player, auction_uid, type, max(end_ts) AS end_ts FROM took_part GROUP BY player, auction_uid, type")
def participation_merge(spark, d):
    all_ = parts(spark, d)
    return merge.participations(all_.where("auction_uid % 13 <> 0"), all_.where("auction_uid % 17 <> 0")).unionByName(all_.where("auction_uid % 13 = 0 and auction_uid % 17 = 0")).select("player", "auction_uid", "type", "end_ts")


@query("""SELECT uuid AS "Uuid", tag AS "Tag", strftime(end_ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS "End", CAST(highest_bid AS VARCHAR) AS "HighestBidAmount", CASE WHEN bin THEN 'True' ELSE 'False' END AS "Bin"
FROM auctions WHERE tag = '4-NOT SPECIFIED' AND end_ts > TIMESTAMP '2024-01-01' AND end_ts <= TIMESTAMP '2025-01-01'""")
def export_rows(spark, d):
    rows = scan.in_range(tables.auctions(spark, d), "2024-01-01 00:00:00", "2025-01-01 00:00:00", "4-NOT SPECIFIED")
    return export.selected(rows, ["Uuid", "Tag", "End", "HighestBidAmount", "Bin"])


@query("""SELECT c_custkey, CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS field
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ',x' WHEN 1 THEN 'q"' || c_name WHEN 2 THEN c_name || chr(10) ELSE c_name END AS t FROM customer)""")
def csv_escape(spark, d):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    text = F.when(k == 0, F.concat(n, F.lit(",x"))).when(k == 1, F.concat(F.lit('q"'), n)).when(k == 2, F.concat(n, F.lit("\n"))).otherwise(n)
    return tables.table(spark, d, "customer").select("c_custkey", identity.csv_field(text).alias("field"))


@query("""SELECT a.uuid, count(*) AS n_versions, max(a.highest_bid) AS highest_bid FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold) a WHERE seller = 7 GROUP BY uuid""")
def restore_player(spark, d):
    both = both_stores(spark, d).where("seller = 7")
    folded = merge.combine_versions(versions(both, B(spark, d)))
    return folded.select("uuid", "n_versions", "highest_bid")


def versions(rows: DataFrame, bids: DataFrame) -> DataFrame:
    """Versions as the fold reads them; the first lacks a start, a starting bid and every other bid."""
    first = F.col("version") == 0
    out = tables.with_bids(rows, bids)
    return out.select(
        "uuid", "auction_uid", "seller", "tag", "version", F.when(~(first & (F.col("auction_uid") % 2 == 0)), F.col("start_ts")).alias("start_ts"), F.when(first, 0).otherwise(F.col("auction_uid") % 100).cast("long").alias("starting_bid"),
        F.when(first, "UNKNOWN").otherwise(F.concat(F.lit("C"), (F.col("auction_uid") % 5).cast("string"))).alias("category"), F.when(first, F.col("seller")).otherwise(F.col("seller") + 1).alias("profile"), "highest_bid", "bids",
    )


@query("""SELECT auction_uid, tag, time_key FROM keyed WHERE NOT (tag = '3-MEDIUM' AND time_key = 300 AND is_sold AND end_ts > TIMESTAMP '2024-10-01' AND end_ts <= TIMESTAMP '2024-10-04')""")
def range_delete_keep(spark, d):
    return merge.without_range(A(spark, d), "3-MEDIUM", 300, True, "2024-10-01 00:00:00", "2024-10-04 00:00:00").select("auction_uid", "tag", "time_key")


@query("SELECT uuid AS key, '{\"uuid\":\"' || uuid || '\",\"highest_bid\":' || highest_bid || ',\"id\":' || auction_uid || '}' AS value FROM hot JOIN (SELECT uuid FROM cold) c USING (uuid)")
def delete_events(spark, d):
    rows = compare.verified(hot(spark, d), cold(spark, d), "uuid", ["seller", "highest_bid"]).where("same")
    return rows.select(F.col("uuid").alias("key"), F.to_json(F.struct("uuid", "highest_bid", F.col("auction_uid").alias("id"))).alias("value"))


@query("SELECT DISTINCT tag, time_key FROM keyed WHERE time_key % 2 <> 0 ORDER BY time_key, tag")
def backfill_remaining(spark, d):
    all_ = A(spark, d).select("tag", "time_key").distinct()
    return all_.join(all_.where("time_key % 2 = 0"), ["tag", "time_key"], "left_anti").orderBy("time_key", "tag")


# --- projections


@query(f"""SELECT auction_uid, uuid, coalesce(tag, 'unknown') AS tag, time_key, highest_bid > 0 AND end_ts <= TIMESTAMP '{AS_OF}' AS is_sold, b.bidder AS highest_bidder, lower(lpad(hex(auction_uid), 12, '0')) AS item_hex
FROM keyed LEFT JOIN (SELECT auction_uid, bidder FROM (SELECT *, row_number() OVER (PARTITION BY auction_uid ORDER BY amount DESC, seq, bidder) AS r FROM bids) WHERE r = 1) b USING (auction_uid)""")
def normalize_auction(spark, d):
    rows = A(spark, d).join(players.top_bidders(B(spark, d)).withColumnRenamed("bidder", "highest_bidder"), "auction_uid", "left")
    sold = (F.col("highest_bid") > 0) & (F.col("end_ts") <= scan.ntz(AS_OF))
    short = F.right(identity.item_guid(F.lit(None).cast("string"), F.hex("auction_uid")), F.lit(12))
    return rows.select("auction_uid", identity.normal_uuid(F.concat(F.lit(" "), F.upper("uuid"))).alias("uuid"), F.coalesce("tag", F.lit("unknown")).alias("tag"), "time_key", sold.alias("is_sold"), "highest_bidder", short.alias("item_hex"))


def attributes() -> dict:
    """Attributes and enchantments made up from the id."""
    k = F.col("auction_uid")
    nbt = F.when(k % 5 == 0, F.create_map(F.lit("modifier"), F.lit("own"))).otherwise(F.create_map(F.lit("upgrade_level"), (k % 6).cast("string")))
    return {"nbt": nbt, "anvil_uses": (k % 4).cast("smallint"), "reforge": F.when(k % 3 == 0, "None").otherwise("Sharp")}


@query("""SELECT auction_uid, concat_ws(';', CASE WHEN auction_uid % 4 > 0 THEN 'anvil_uses=' || auction_uid % 4 END,
  CASE WHEN auction_uid % 5 = 0 THEN 'modifier=own' WHEN auction_uid % 3 <> 0 THEN 'modifier=sharp' END, CASE WHEN auction_uid % 5 <> 0 THEN 'upgrade_level=' || auction_uid % 6 END) AS nbt FROM auctions""")
def nbt_enrich(spark, d):
    a = attributes()
    return tables.auctions(spark, d).select("auction_uid", nested.map_text(nested.enrich_nbt(a["nbt"], a["anvil_uses"], a["reforge"])).alias("nbt"))


@query(f"SELECT tag, highest_bid > 0 AND end_ts <= TIMESTAMP '{AS_OF}' AS is_sold, count(*) AS n FROM auctions GROUP BY ALL")
def is_sold(spark, d):
    return tables.auctions(spark, d).groupBy("tag", ((F.col("highest_bid") > 0) & (F.col("end_ts") <= scan.ntz(AS_OF))).alias("is_sold")).agg(F.count("*").alias("n"))


@query("SELECT auction_uid, amount, bidder FROM (SELECT *, row_number() OVER (PARTITION BY auction_uid ORDER BY amount DESC, seq, bidder) AS r FROM bids) WHERE r = 1")
def highest_bidder(spark, d):
    return players.top_bidders(B(spark, d))


@query("SELECT auction_uid, auction_uid AS item_uid, CASE WHEN auction_uid % 2 = 0 THEN uuid ELSE lpad('', 20, '0') || lower(lpad(hex(auction_uid), 12, '0')) END AS item_id FROM auctions")
def item_identity(spark, d):
    h = F.hex("auction_uid")
    own = F.when(F.col("auction_uid") % 2 == 0, F.concat_ws("-", F.substring("uuid", 1, 8), F.substring("uuid", 9, 24)))
    return tables.auctions(spark, d).select("auction_uid", identity.item_uid(h).alias("item_uid"), identity.item_guid(own, h).alias("item_id"))


@query("SELECT auction_uid, CASE WHEN auction_uid % 2 = 0 THEN 'sharpness=' || auction_uid % 7 || ';unknown=1;unknown#2=' || auction_uid % 3 ELSE 'sharpness=' || auction_uid % 7 || ';unknown=1' END AS enchantments FROM auctions")
def enchant_map(spark, d):
    k = F.col("auction_uid")
    e = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("int").alias("level"))
    both = F.array(e("sharpness", k % 7), e("unknown", F.lit(1)))
    list_ = F.when(k % 2 == 0, F.concat(both, F.array(e("unknown", k % 3)))).otherwise(both)
    return tables.auctions(spark, d).select("auction_uid", nested.map_text(nested.enchantment_map(list_)).alias("enchantments"))


@query("""SELECT auction_uid, CASE auction_uid % 3 WHEN 0 THEN 'DIVINE' WHEN 1 THEN 'EPIC' ELSE 'UNKNOWN' END AS tier, CASE WHEN auction_uid % 5 = 0 THEN 'own' WHEN auction_uid % 3 <> 0 THEN 'sharp' END AS reforge, CAST(auction_uid % 4 AS INT) AS anvil_uses FROM auctions""")
def denormalize_auction(spark, d):
    a, k = attributes(), F.col("auction_uid")
    nbt = nested.enrich_nbt(a["nbt"], a["anvil_uses"], a["reforge"])
    tier = F.when(k % 3 == 0, "SUPREME").when(k % 3 == 1, "epic").otherwise("???")
    return tables.auctions(spark, d).select("auction_uid", identity.normal_tier(tier).alias("tier"), F.element_at(nbt, "modifier").alias("reforge"), F.coalesce(F.element_at(nbt, "anvil_uses").cast("int"), F.lit(0)).alias("anvil_uses"))


@query("""SELECT auction_uid, bidder, seq, amount, CASE WHEN seq % 3 = 0 THEN lpad('1', 32, '0') WHEN seq % 3 = 1 THEN CAST(bidder AS VARCHAR) ELSE 'p' || bidder END AS profile FROM bids""")
def bid_normalize(spark, d):
    profile = F.when(F.col("seq") % 3 == 0, "unknown").when(F.col("seq") % 3 == 2, F.concat(F.lit("p"), F.col("bidder").cast("string")))
    return B(spark, d).select("auction_uid", "bidder", "seq", "amount", identity.bid_profile(profile, F.col("bidder").cast("string")).alias("profile"))


@query("SELECT auction_uid, tag, time_key FROM keyed")
def rekey(spark, d):
    return tables.keyed(tables.auctions(spark, d).withColumn("time_key", F.lit(0))).select("auction_uid", "tag", "time_key")


@query("SELECT type, tag, count(*) AS n, count(DISTINCT player) AS n_players FROM took_part GROUP BY type, tag")
def participation_build(spark, d):
    return parts(spark, d).groupBy("type", "tag").agg(F.count("*").alias("n"), F.countDistinct("player").alias("n_players"))


# --- filters


@query("SELECT auction_uid, tag, highest_bid FROM auctions WHERE bin AND tier = 'F' AND highest_bid >= 50000 AND end_ts > TIMESTAMP '2023-01-01'")
def filter_expr(spark, d):
    return tables.auctions(spark, d).where(filters.compiled({"Bin": "true", "Tier": "F", "MinPrice": "50000", "EndAfter": "1672531200"})).select("auction_uid", "tag", "highest_bid")


@query("SELECT auction_uid FROM auctions WHERE bin")
def filter_bin(spark, d):
    return tables.auctions(spark, d).where(filters.compiled({"Bin": "true"})).select("auction_uid")


@query("SELECT auction_uid FROM auctions WHERE seller = 11")
def filter_seller(spark, d):
    return tables.auctions(spark, d).where(filters.compiled({"Seller": "11"})).select("auction_uid")


def with_attributes(spark, d):
    a, k = attributes(), F.col("auction_uid")
    nbt = nested.enrich_nbt(a["nbt"], a["anvil_uses"], a["reforge"])
    enchantments = F.when(k % 2 == 0, F.create_map(F.lit("sharpness"), (k % 7).cast("int")))
    return tables.auctions(spark, d).select("*", nbt.alias("nbt"), enchantments.alias("enchantments"))


@query("SELECT auction_uid FROM auctions WHERE auction_uid % 5 <> 0 AND auction_uid % 3 <> 0")
def filter_reforge(spark, d):
    return with_attributes(spark, d).where(filters.compiled({"Reforge": "Sharp"})).select("auction_uid")


@query("SELECT auction_uid FROM auctions WHERE auction_uid % 5 <> 0 AND auction_uid % 6 = 5")
def filter_stars(spark, d):
    return with_attributes(spark, d).where(filters.compiled({"Stars": "5"})).select("auction_uid")


@query("SELECT auction_uid FROM auctions WHERE auction_uid % 2 = 0")
def filter_enchantment(spark, d):
    return with_attributes(spark, d).where(filters.compiled({"Enchantment": "Sharpness"})).select("auction_uid")


@query("SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1.5 END AS DOUBLE) AS days FROM part")
def summary_days(spark, d):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "9").when(k == 1, "-1").when(k == 2, "x").when(k == 4, "1.5")
    return tables.table(spark, d, "part").select("p_partkey", identity.summary_days_column(text).alias("days"))


@query("SELECT auction_uid, seller FROM auctions a WHERE seller IN (7, 12) OR EXISTS (SELECT 1 FROM bids b WHERE b.auction_uid = a.auction_uid AND b.bidder IN (7, 12))")
def export_user_filter(spark, d):
    return tables.with_bids(tables.auctions(spark, d), B(spark, d)).where(filters.of_users([" 7", "12 "])).select("auction_uid", "seller")


@query("SELECT player, auction_uid FROM took_part WHERE type = 1 AND tag = '2-HIGH'")
def participation_filter(spark, d):
    return parts(spark, d).where("type = 1 and tag = '2-HIGH'").select("player", "auction_uid")


@query("SELECT auction_uid, seller = 7 AS sells, EXISTS (SELECT 1 FROM bids b WHERE b.auction_uid = a.auction_uid AND b.bidder = 7) AS bids FROM auctions a WHERE seller = 7 OR EXISTS (SELECT 1 FROM bids b WHERE b.auction_uid = a.auction_uid AND b.bidder = 7)")
def player_side(spark, d):
    mine = parts(spark, d).where("player = 7").groupBy("auction_uid")
    return mine.agg(F.max(F.col("type") == 0).alias("sells"), F.max(F.col("type") == 1).alias("bids"))


@query("SELECT auction_uid FROM auctions WHERE auction_uid % 100 = 0 AND highest_bid = 0")
def junk_rows(spark, d):
    lost = F.col("auction_uid") % 100 == 0
    rows = tables.auctions(spark, d).withColumn("seller", F.when(~lost, F.col("seller"))).withColumn("tag", F.when(~lost, F.col("tag")))
    return rows.where(filters.junk()).select("auction_uid")


@query("SELECT auction_uid, tag FROM auctions WHERE auction_uid IN (SELECT DISTINCT auction_uid FROM bids WHERE amount > 90000)")
def fetch_by_ids(spark, d):
    ids = B(spark, d).where("amount > 90000").select("auction_uid").distinct()
    return tables.auctions(spark, d).join(ids, "auction_uid", "left_semi").select("auction_uid", "tag")


@query("SELECT h.uuid, c.uuid IS NOT NULL AS may_exist FROM hot h LEFT JOIN cold c USING (uuid)")
def may_exist(spark, d):
    have = cold(spark, d).select("uuid", F.lit(True).alias("_in"))
    return hot(spark, d).select("uuid").join(have, "uuid", "left").select("uuid", F.col("_in").isNotNull().alias("may_exist"))


BLOOM_BITS = 1 << 17  # for some 10,000 entries; the tables at larger factors fill it, which only makes it less sharp

# positions of a UUID: double hashing of the SHA-256 of its bytes, the first three groups of which are turned round
_POSITIONS = """, ids AS (SELECT uuid, sha256(unhex(uuid[7:8] || uuid[5:6] || uuid[3:4] || uuid[1:2] || uuid[11:12] || uuid[9:10] || uuid[15:16] || uuid[13:14] || uuid[17:32])) AS s, origin FROM
  (SELECT uuid, 'cold' AS origin FROM cold UNION ALL SELECT uuid, 'hot' FROM hot)),
halves AS (SELECT uuid, origin, CAST('0x' || s[15:16] || s[13:14] || s[11:12] || s[9:10] || s[7:8] || s[5:6] || s[3:4] || s[1:2] AS HUGEINT) % 9223372036854775808 AS h1,
  greatest(CAST('0x' || s[31:32] || s[29:30] || s[27:28] || s[25:26] || s[23:24] || s[21:22] || s[19:20] || s[17:18] AS HUGEINT) % 9223372036854775808, 1) AS h2 FROM ids),
set_bits AS (SELECT uuid, origin, CAST(((h1 + k * h2) % 9223372036854775808) % {bits} AS BIGINT) AS p FROM halves, range(7) r(k)),
words AS (SELECT p // 32 AS word, CAST(CASE WHEN bit_or(1::BIGINT << (p % 32)) > 2147483647 THEN bit_or(1::BIGINT << (p % 32)) - 4294967296 ELSE bit_or(1::BIGINT << (p % 32)) END AS INT) AS bits, bit_or(1::BIGINT << (p % 32)) AS u FROM set_bits WHERE origin = 'cold' GROUP BY 1)
""".format(bits=BLOOM_BITS)


@query(_POSITIONS + "SELECT word, bits FROM words")
def bloom_filter(spark, d):
    """Built in two parts, merged, written as a file and read back."""
    rows, path = cold(spark, d), folder(spark)
    halves = [bloom.built(rows.where(f"auction_uid % 2 = {k}"), "uuid", BLOOM_BITS) for k in (0, 1)]
    bloom.save(bloom.merged(*halves), path, BLOOM_BITS)
    return bloom.load(spark, path)[0]


@query(_POSITIONS + "SELECT a.uuid, min(CAST(coalesce((u >> (p % 32)) & 1, 0) AS INT)) = 1 AS may_exist FROM set_bits a LEFT JOIN words ON word = p // 32 WHERE origin = 'hot' GROUP BY a.uuid")
def bloom_probe(spark, d):
    return bloom.probed(hot(spark, d).select("uuid"), "uuid", bloom.built(cold(spark, d), "uuid", BLOOM_BITS), BLOOM_BITS)


# --- joins and comparisons


def stored_unsold(rows: DataFrame) -> DataFrame:
    """Unsold records of ``rows``, up to 19 days later, of a third of them a second one with other values."""
    k = F.col("auction_uid")
    one = rows.withColumn("end_ts", F.timestamp_add("DAY", (k % 20).cast("int"), F.col("end_ts"))).withColumn("starting_bid", k % 100)
    two = rows.where("auction_uid % 3 = 0").withColumn("end_ts", F.timestamp_add("DAY", (k % 7).cast("int"), F.col("end_ts"))).withColumn("starting_bid", k % 100 + 1000)
    return one.unionByName(two).withColumn("item_name", F.concat(F.lit("item "), F.col("starting_bid").cast("string"))).withColumn("count", (k % 5).cast("int"))


def lacking(rows: DataFrame) -> DataFrame:
    """``rows`` as sold events that lack what only the unsold record has."""
    none = {"start_ts": "timestamp_ntz", "bin": "boolean", "starting_bid": "long", "item_name": "string", "count": "int"}
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


# windows of the stored records: the one that ended last, of those less than 14 days away
_UNSOLD = """, unsold AS (SELECT *, end_ts + to_days(CAST(auction_uid % 20 AS INT)) AS e, auction_uid % 100 AS starting_bid FROM {rows} UNION ALL
  SELECT *, end_ts + to_days(CAST(auction_uid % 7 AS INT)), auction_uid % 100 + 1000 FROM {rows} WHERE auction_uid % 3 = 0),
best AS (SELECT h.auction_uid, c.start_ts, c.bin, c.starting_bid, row_number() OVER (PARTITION BY h.auction_uid ORDER BY c.e DESC, c.start_ts DESC, CAST(c.auction_uid % 5 AS INT) DESC, 'item ' || c.starting_bid DESC) AS r
  FROM {sold} h JOIN unsold c ON c.uuid = h.uuid AND c.tag = h.tag AND c.e < h.end_ts + INTERVAL '14' DAY AND c.e > h.end_ts - INTERVAL '14' DAY)"""


@query(_UNSOLD.format(rows="(SELECT * FROM cold WHERE auction_uid % 4 <> 0)", sold="(SELECT * FROM hot WHERE is_sold)") + """
SELECT h.auction_uid, b.start_ts, b.bin, b.starting_bid, 'item ' || b.starting_bid AS item_name, CASE WHEN b.auction_uid IS NOT NULL THEN CAST(h.auction_uid % 5 AS INT) END AS count
FROM (SELECT * FROM hot WHERE is_sold) h LEFT JOIN best b ON b.auction_uid = h.auction_uid AND r = 1""")
def retrofit_join(spark, d):
    rows = merge.retrofit(lacking(hot(spark, d).where("is_sold")), stored_unsold(cold(spark, d).where("auction_uid % 4 <> 0")))
    return rows.select("auction_uid", "start_ts", "bin", "starting_bid", "item_name", "count")


@query(_UNSOLD.format(rows="cold", sold="(SELECT * FROM hot WHERE is_sold AND end_ts > TIMESTAMP '2025-06-01' AND end_ts <= TIMESTAMP '2025-06-15')") + """
SELECT h.auction_uid, b.start_ts, b.starting_bid FROM (SELECT * FROM hot WHERE is_sold AND end_ts > TIMESTAMP '2025-06-01' AND end_ts <= TIMESTAMP '2025-06-15') h LEFT JOIN best b ON b.auction_uid = h.auction_uid AND r = 1""")
def retrofit_batch(spark, d):
    """A batch of two weeks against the store by month, of which it reads its own months only."""
    path = folder(spark)
    archive.write(stored_unsold(cold(spark, d)), path)
    batch = scan.in_range(hot(spark, d).where("is_sold"), "2025-06-01 00:00:00", "2025-06-15 00:00:00")
    return merge.retrofit(lacking(batch), archive.read(spark, path)).select("auction_uid", "start_ts", "starting_bid")


@query("SELECT auction_uid, (auction_uid % 5 <> 0) AS same FROM hot JOIN (SELECT uuid FROM cold) c USING (uuid)")
def verify_match(spark, d):
    kept = cold(spark, d).withColumn("highest_bid", F.col("highest_bid") + F.when(F.col("auction_uid") % 5 == 0, 1).otherwise(0))
    return compare.verified(hot(spark, d), kept, "uuid", ["seller", "highest_bid", "bid_count", "end_ts"]).select("auction_uid", "same")


@query("SELECT auction_uid FROM hot WHERE uuid NOT IN (SELECT uuid FROM cold)")
def verify_miss(spark, d):
    return compare.missing(hot(spark, d), cold(spark, d), "uuid").select("auction_uid")


@query("""SELECT tag, count(*) FILTER (h IS NOT NULL AND c IS NOT NULL) AS matches, count(*) FILTER (c IS NULL) AS left_only, count(*) FILTER (h IS NULL) AS right_only
FROM (SELECT uuid, tag, 1 AS h FROM hot) FULL JOIN (SELECT uuid, tag, 1 AS c FROM cold) USING (uuid, tag) GROUP BY tag""")
def shadow_compare(spark, d):
    return compare.shadow(hot(spark, d), cold(spark, d), "uuid", ["tag"])


@query("""SELECT auction_uid, tag, end_ts FROM auctions WHERE auction_uid IN (SELECT auction_uid FROM (SELECT * FROM took_part WHERE player = 7 AND year(end_ts) = 2024 ORDER BY end_ts DESC, auction_uid, type LIMIT 50))""")
def player_auctions(spark, d):
    return players.auctions_of(parts(spark, d), tables.auctions(spark, d), 7, 2024, 50).select("auction_uid", "tag", "end_ts")


@query(f"""SELECT e.end_ts, e.highest_bid AS price, coalesce(c_name, CAST(e.seller AS VARCHAR)) AS player, e.auction_uid FROM (
  SELECT * FROM (SELECT *, end_ts > TIMESTAMP '{AS_OF}' - INTERVAL '1' HOUR AS h FROM auctions WHERE end_ts <= TIMESTAMP '{AS_OF}' AND end_ts > TIMESTAMP '{AS_OF}' - INTERVAL '13' DAY - INTERVAL '1' HOUR ORDER BY end_ts DESC, auction_uid DESC LIMIT 12)
  QUALIFY h OR count(*) FILTER (h) OVER () < 12) e LEFT JOIN customer ON c_custkey = e.seller""")
def recent_overview(spark, d):
    top = scan.overview(tables.auctions(spark, d), AS_OF)
    names = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("seller"), "c_name")
    return names.join(F.broadcast(top), "seller", "right").select("end_ts", F.col("highest_bid").alias("price"), F.coalesce("c_name", F.col("seller").cast("string")).alias("player"), "auction_uid")


@query(f"""SELECT t.tag, g.day FROM (SELECT DISTINCT tag FROM auctions) t, (SELECT unnest(generate_series(TIMESTAMP '{FIRST_DAY}', TIMESTAMP '{LAST_DAY}', INTERVAL 1 DAY)) AS day) g
WHERE (t.tag, g.day) NOT IN (SELECT tag, date_trunc('day', end_ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY FROM auctions WHERE is_sold)""")
def missing_days(spark, d):
    rows = tables.auctions(spark, d)
    stored = rows.where("is_sold").select("tag", prices.closing_day(F.col("end_ts")).alias("day")).distinct()
    return prices.days(rows, FIRST_DAY, LAST_DAY).join(stored, ["tag", "day"], "left_anti")


@query("""SELECT tag, count(w) AS expected, CAST(sum(coalesce(n, 0)) AS BIGINT) AS archived, count(*) FILTER (n IS NULL) AS missing, CAST(sum(CASE WHEN w IS NULL THEN n ELSE greatest(coalesce(n, 0) - 1, 0) END) AS BIGINT) AS extra
FROM (SELECT uuid, tag, 1 AS w FROM hot) FULL JOIN (SELECT uuid, tag, count(*) AS n FROM (SELECT * FROM cold UNION ALL SELECT * FROM cold WHERE auction_uid % 11 = 0) GROUP BY ALL) USING (uuid, tag) GROUP BY tag""")
def archive_coverage(spark, d):
    kept = cold(spark, d)
    return compare.coverage(hot(spark, d), kept.unionByName(kept.where("auction_uid % 11 = 0")), "uuid", ["tag"])


@query("SELECT tag, time_key, count(*) AS missing FROM hot WHERE uuid NOT IN (SELECT uuid FROM cold) GROUP BY ALL")
def gap_by_partition(spark, d):
    return compare.gaps(hot(spark, d), cold(spark, d), "uuid", ["tag", "time_key"])


@query("SELECT strftime(end_ts, '%Y-%m') AS month, count(*) AS missing FROM hot WHERE uuid NOT IN (SELECT uuid FROM cold) GROUP BY ALL ORDER BY missing DESC, month LIMIT 6")
def gap_by_month(spark, d):
    rows = hot(spark, d).withColumn("month", timekey.month(F.col("end_ts")))
    return compare.gaps(rows, cold(spark, d), "uuid", ["month"]).orderBy(F.col("missing").desc(), "month").limit(6)


@query("SELECT auction_uid, auction_uid % 5 = 0 AS differs FROM (SELECT auction_uid FROM auctions)")
def canonical_diff(spark, d):
    rows = tables.with_bids(tables.auctions(spark, d), B(spark, d))
    other = rows.select("uuid", F.reverse("bids").alias("_bids"), (F.col("highest_bid") + F.when(F.col("auction_uid") % 5 == 0, 1).otherwise(0)).alias("_high"))
    canonical = lambda b, h: F.sha2(F.to_json(F.struct(F.array_sort(b).alias("bids"), h.alias("high"))), 256)
    return rows.join(other, "uuid").select("auction_uid", (canonical(F.col("bids"), F.col("highest_bid")) != canonical(F.col("_bids"), F.col("_high"))).alias("differs"))


# --- aggregation

_SUMMARY = """r AS (SELECT {by}, highest_bid p, row_number() OVER (PARTITION BY {by} ORDER BY highest_bid, auction_uid) rn, count(*) OVER (PARTITION BY {by}) n FROM w),
m AS (SELECT {by}, highest_bid p, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, max(end_ts) DESC, highest_bid) mr FROM w GROUP BY {by}, highest_bid),
s AS (SELECT {by}, max(r.p) AS max, min(r.p) AS min, round(avg(r.p), 4) AS mean, max(CASE WHEN r.rn = (r.n // 2) + 1 THEN r.p END) AS med, max(CASE WHEN m.mr = 1 THEN r.p END) AS mode, CAST(count(*) AS DOUBLE) AS volume FROM r JOIN m USING ({by}, p) GROUP BY {by})"""


@query(f", w AS (SELECT * FROM auctions WHERE is_sold AND end_ts > TIMESTAMP '{RECENT}' AND end_ts < TIMESTAMP '{AS_OF}'), " + _SUMMARY.format(by="tag") + " SELECT * FROM s")
def price_summary(spark, d):
    return prices.summary(prices.in_window(tables.auctions(spark, d), RECENT, AS_OF), ["tag"]).withColumn("mean", F.round("mean", 4))


_HISTORY = f""", w AS (SELECT *, date_trunc('day', end_ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AS day FROM auctions WHERE is_sold AND end_ts > TIMESTAMP '{FIRST_DAY}' - INTERVAL 1 DAY AND end_ts <= TIMESTAMP '{LAST_DAY}'), """ + _SUMMARY.format(by="tag, day") + f"""
SELECT tag, day, coalesce(max, 0) AS max, coalesce(min, 0) AS min, coalesce(mean, 0) AS mean, coalesce(med, 0) AS med, coalesce(mode, 0) AS mode, coalesce(volume, 0) AS volume
FROM (SELECT DISTINCT tag FROM auctions WHERE is_sold) t CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '{FIRST_DAY}', TIMESTAMP '{LAST_DAY}', INTERVAL 1 DAY)) AS day) g LEFT JOIN s USING (tag, day)"""


@query(_HISTORY)
def price_history(spark, d):
    return prices.history(tables.auctions(spark, d).where("is_sold"), FIRST_DAY, LAST_DAY).withColumn("mean", F.round("mean", 4))


@query(_HISTORY)
def price_history_memo(spark, d):
    kept = memo.PriceMemo(spark, folder(spark))
    sold = tables.auctions(spark, d).where("is_sold")
    kept.history(sold, "2025-07-10 00:00:00", LAST_DAY)
    return kept.history(sold, FIRST_DAY, LAST_DAY).withColumn("mean", F.round("mean", 4))


@query(f"SELECT tag, CAST(hour(end_ts) AS INT) AS hour, round(avg(highest_bid), 4) AS mean, min(highest_bid) AS min, max(highest_bid) AS max, count(*) AS volume, min(end_ts) AS first_end FROM auctions WHERE end_ts > TIMESTAMP '{RECENT}' AND end_ts < TIMESTAMP '{AS_OF}' GROUP BY ALL")
def hourly_prices(spark, d):
    rows = tables.auctions(spark, d).where((F.col("end_ts") > scan.ntz(RECENT)) & (F.col("end_ts") < scan.ntz(AS_OF)))
    return prices.hourly(rows).withColumn("mean", F.round("mean", 4))


@query("""SELECT uuid, count(*) AS n_versions, min(seller) AS seller,
  CASE WHEN count(*) FILTER (v = 0) = 0 OR max(auction_uid) % 2 <> 0 OR count(*) FILTER (v = 1) > 0 THEN max(start_ts) END AS start_ts,
  CASE WHEN count(*) FILTER (v = 1) > 0 THEN max(auction_uid) % 100 ELSE 0 END AS starting_bid, CASE WHEN count(*) FILTER (v = 1) > 0 THEN 'C' || max(auction_uid) % 5 ELSE 'UNKNOWN' END AS category,
  CASE WHEN count(*) FILTER (v = 1) > 0 THEN max(seller) + 1 ELSE max(seller) END AS profile, max(highest_bid) AS highest_bid,
  CASE WHEN count(*) > 1 THEN coalesce(max(d), 0) ELSE max(bid_count) END AS n_bids
FROM (SELECT *, 0 AS v FROM hot UNION ALL SELECT *, 1 FROM cold) LEFT JOIN (SELECT auction_uid, count(DISTINCT amount) AS d FROM bids GROUP BY 1) USING (auction_uid) GROUP BY uuid""")
def combine_versions(spark, d):
    both = both_stores(spark, d)
    out = merge.combine_versions(versions(both, B(spark, d)))
    return out.select("uuid", "n_versions", "seller", "start_ts", "starting_bid", "category", "profile", "highest_bid", F.col("n_bids").cast("long").alias("n_bids"))


@query("SELECT tag, date_trunc('month', end_ts) AS month, count(*) AS n FROM auctions GROUP BY ALL")
def tag_month_counts(spark, d):
    return tables.auctions(spark, d).groupBy(F.coalesce("tag", F.lit("unknown")).alias("tag"), F.date_trunc("month", "end_ts").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT bidder, count(*) AS n_bids, max(amount) AS top FROM bids GROUP BY bidder")
def bids_per_bidder(spark, d):
    return B(spark, d).groupBy("bidder").agg(F.count("*").alias("n_bids"), F.max("amount").alias("top"))


@query("SELECT uuid, count(*) AS n FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold) GROUP BY uuid HAVING count(*) > 1")
def duplicate_auctions(spark, d):
    return hot(spark, d).unionByName(cold(spark, d)).groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT bidder, auction_uid, ts FROM (SELECT *, row_number() OVER (PARTITION BY bidder ORDER BY ts, auction_uid, seq, amount) AS r FROM bids) WHERE r = 1")
def first_per_key(spark, d):
    first = B(spark, d).groupBy("bidder").agg(F.min(F.struct("ts", "auction_uid", "seq", "amount")).alias("f"))
    return first.select("bidder", "f.auction_uid", "f.ts")


@query("SELECT DISTINCT CAST(year(end_ts) AS INT) AS year FROM auctions")
def distinct_years(spark, d):
    return tables.auctions(spark, d).select(F.year("end_ts").alias("year")).distinct()


# --- order and limits


@query("SELECT auction_uid, end_ts, highest_bid FROM auctions WHERE tag = '1-URGENT' OR tag = 'ENCHANTED_BOOK' ORDER BY end_ts DESC, auction_uid DESC LIMIT 100")
def recent_topk(spark, d):
    top = scan.newest(tables.unpriced(spark, d).where("tag = 'ENCHANTED_BOOK'"), 100)
    return tables.few_priced(top, B(spark, d)).select("auction_uid", "end_ts", "highest_bid")


_BUDGET = f"""SELECT auction_uid, end_ts, highest_bid, origin FROM (
  SELECT *, 'archive' AS origin FROM cold WHERE end_ts <= TIMESTAMP '{CUTOFF}' UNION ALL
  SELECT *, 'hot' FROM hot WHERE strftime(end_ts, '%Y-%m') NOT IN (SELECT strftime(end_ts, '%Y-%m') FROM cold WHERE end_ts <= TIMESTAMP '{CUTOFF}' AND end_ts > TIMESTAMP '2024-01-15' AND tag = '3-MEDIUM' AND is_sold))
WHERE tag = '3-MEDIUM' AND is_sold AND bin AND end_ts > TIMESTAMP '2024-01-15' AND end_ts <= TIMESTAMP '{AS_OF}' ORDER BY end_ts DESC, auction_uid DESC LIMIT """


def tier_stores(spark, d):
    """Recent auctions by tag and time key, archived ones (up to the cutoff) by tag and month."""
    path, names = folder(spark), ["auction_uid", "tag", "end_ts", "is_sold", "highest_bid", "bin"]
    hot(spark, d).select(*names, "time_key").repartition("tag", "time_key").write.partitionBy("tag", "time_key").parquet(f"{path}/hot")
    archive.write(cold(spark, d).where(F.col("end_ts") <= scan.ntz(CUTOFF)).select(*names), f"{path}/cold")
    read = spark.read.parquet(f"{path}/hot")
    return read.withColumn("time_key", F.col("time_key").cast("int")), archive.read(spark, f"{path}/cold")


@query(_BUDGET + "40")
def budget_scan(spark, d):
    recent, archived = tier_stores(spark, d)
    return scan.budgeted(recent, archived, "3-MEDIUM", "2024-01-15 00:00:00", AS_OF, 40, filters.compiled({"Bin": "true"})).select("auction_uid", "end_ts", "highest_bid", "origin")


@query(_BUDGET + "400000000")
def budget_scan_all(spark, d):
    """A budget that is never met: all rows of the range, over both tiers."""
    recent, archived = tier_stores(spark, d)
    return scan.budgeted(recent, archived, "3-MEDIUM", "2024-01-15 00:00:00", AS_OF, 400_000_000, filters.compiled({"Bin": "true"})).select("auction_uid", "end_ts", "highest_bid", "origin")


@query(f"SELECT auction_uid, end_ts FROM auctions WHERE tag = '2-HIGH' AND is_sold AND end_ts > TIMESTAMP '{AS_OF}' - INTERVAL '2' DAY AND end_ts <= TIMESTAMP '{AS_OF}' ORDER BY end_ts DESC, auction_uid DESC LIMIT 1000")
def recent_batch(spark, d):
    rows = scan.in_range(tables.auctions(spark, d).where("is_sold"), "2025-07-30 00:00:00", AS_OF, "2-HIGH")
    return scan.newest(rows, 1000).select("auction_uid", "end_ts")


@query("SELECT month, CAST(abs((year(m) - 2023) * 12 + month(m) - 6) AS INT) AS apart FROM (SELECT DISTINCT strftime(end_ts, '%Y-%m') AS month, date_trunc('month', end_ts) AS m FROM auctions) ORDER BY apart, month")
def nearest_months(spark, d):
    months = tables.auctions(spark, d).select(timekey.month(F.col("end_ts")).alias("month")).distinct()
    return months.withColumn("apart", timekey.months_apart(F.to_date("month", "yyyy-MM"), F.lit("2023-06-01").cast("date"))).orderBy("apart", "month")


@query("SELECT auction_uid, strftime(end_ts, '%Y-%m') AS month FROM auctions WHERE tag = '3-MEDIUM' AND strftime(end_ts, '%Y-%m') IN ('2023-04', '2023-05', '2023-06', '2023-07', '2023-08')")
def month_probe(spark, d):
    return tables.auctions(spark, d).select("auction_uid", "tag", timekey.month(F.col("end_ts")).alias("month")).where((F.col("tag") == "3-MEDIUM") & F.col("month").isin(*PROBED)).select("auction_uid", "month")


PROBED = ["2023-06", "2023-05", "2023-07", "2023-04", "2023-08"]


@query("SELECT month, count(*) AS rows FROM (SELECT strftime(end_ts, '%Y-%m') AS month FROM auctions WHERE tag = '3-MEDIUM') WHERE month NOT IN ('2023-04', '2023-05', '2023-06', '2023-07', '2023-08') GROUP BY month")
def remaining_months(spark, d):
    return scan.remaining(tables.auctions(spark, d).where("tag = '3-MEDIUM'"), PROBED)


@query(f"""SELECT auction_uid, type, end_ts, end_ts <= TIMESTAMP '{CUTOFF}' AS archived FROM took_part WHERE player = 7 AND ((end_ts > TIMESTAMP '{CUTOFF}' AND auction_uid % 13 <> 0) OR (end_ts <= TIMESTAMP '{CUTOFF}' AND auction_uid % 17 <> 0)) ORDER BY end_ts DESC, auction_uid, type LIMIT 500""")
def player_history(spark, d):
    all_ = parts(spark, d)
    return players.history(all_.where("auction_uid % 13 <> 0"), all_.where("auction_uid % 17 <> 0"), 7, CUTOFF, 500).select("auction_uid", "type", "end_ts", "archived")


@query("SELECT auction_uid, tag, time_key, CAST((row_number() OVER (PARTITION BY tag, time_key ORDER BY auction_uid) - 1) // 10 AS INT) AS chunk FROM keyed")
def chunk_rows(spark, d):
    return scan.chunks(A(spark, d), ["tag", "time_key"], 10).select("auction_uid", "tag", "time_key", "chunk")


@query("SELECT auction_uid, tag FROM (SELECT *, row_number() OVER (PARTITION BY tag, strftime(end_ts, '%Y-%m') ORDER BY end_ts, auction_uid) AS r FROM auctions) WHERE r % 10 = 0")
def sample_every_n(spark, d):
    rows = tables.auctions(spark, d).withColumn("month", timekey.month(F.col("end_ts")))
    return scan.every_nth(rows, ["tag", "month"], 10).select("auction_uid", "tag")


# --- sets


@query("SELECT auction_uid, is_sold FROM hot WHERE is_sold UNION ALL SELECT auction_uid, is_sold FROM hot WHERE NOT is_sold")
def union_sold_unsold(spark, d):
    rows = hot(spark, d)
    return rows.where("is_sold").unionByName(rows.where("not is_sold")).select("auction_uid", "is_sold")


@query("(SELECT uuid FROM hot EXCEPT SELECT uuid FROM cold)")
def ids_except(spark, d):
    return hot(spark, d).select("uuid").subtract(cold(spark, d).select("uuid"))


@query("(SELECT uuid FROM hot INTERSECT SELECT uuid FROM cold)")
def ids_intersect(spark, d):
    return hot(spark, d).select("uuid").intersect(cold(spark, d).select("uuid"))


@query("(SELECT uuid FROM hot UNION SELECT uuid FROM cold)")
def ids_union(spark, d):
    return hot(spark, d).select("uuid").union(cold(spark, d).select("uuid")).distinct()


# --- functions


@query("SELECT tag, time_key, count(*) AS n FROM keyed GROUP BY ALL")
def time_key(spark, d):
    return A(spark, d).groupBy("tag", "time_key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT tag, time_key, make_timestamp(1546300800000000 + CAST(time_key AS BIGINT) * (CASE WHEN tag IN ('ENCHANTED_BOOK', 'unknown') THEN 43200000000 ELSE 604800000000 END)) AS begins FROM keyed")
def time_key_date(spark, d):
    return A(spark, d).select("tag", "time_key").distinct().withColumn("begins", timekey.time_key_date(F.col("tag"), F.col("time_key")))


@query("SELECT auction_uid, make_timestamp((1700000000 + auction_uid) * 1000000) AS at FROM auctions")
def unix_to_ts(spark, d):
    return tables.auctions(spark, d).select("auction_uid", F.timestamp_seconds(F.lit(1700000000) + F.col("auction_uid")).cast("timestamp_ntz").alias("at"))


@query("SELECT auction_uid, CASE WHEN auction_uid % 6 = 5 THEN NULL WHEN auction_uid % 6 IN (2, 4) THEN date_trunc('day', end_ts) ELSE end_ts END AS at FROM auctions")
def parse_dates(spark, d):
    k, e = F.col("auction_uid") % 6, F.col("end_ts")
    forms = [F.date_format(e, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(e, "  dd.MM.yyyy HH:mm:ss"), F.date_format(e, "MM/dd/yyyy"), F.unix_seconds(e.cast("timestamp")).cast("string"), F.date_format(e, "d MMM yyyy")]
    text = F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)], F.lit("soon"))
    return tables.auctions(spark, d).select("auction_uid", timekey.parsed(text).alias("at"))


@query("SELECT auction_uid, seq, bidder, ts, CAST(timezone('Europe/Berlin', ts + to_hours(CAST(l AS BIGINT) % 24)) AS TIMESTAMP) AS utc FROM (SELECT *, auction_uid + seq AS l FROM bids)")
def bids_utc(spark, d):
    local = F.timestamp_add("HOUR", ((F.col("auction_uid") + F.col("seq")) % 24).cast("int"), F.col("ts"))
    return B(spark, d).select("auction_uid", "seq", "bidder", "ts", timekey.local_to_utc(local, "Europe/Berlin").alias("utc"))


@query("SELECT auction_uid, CAST(TIMESTAMP '2019-06-01' + to_years(CAST((auction_uid * 40000) // 30000000 AS INT)) AS DATE) AS guess FROM auctions")
def estimate_date(spark, d):
    return tables.auctions(spark, d).select("auction_uid", timekey.estimated_date(F.col("auction_uid") * 40000).alias("guess"))


@query("SELECT auction_uid, CASE WHEN auction_uid % 4 < 2 THEN uuid END AS uuid FROM auctions")
def uuid_normalize(spark, d):
    k, u = F.col("auction_uid") % 4, F.col("uuid")
    dashed = F.upper(F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4), F.substring(u, 17, 4), F.substring(u, 21, 12)))
    text = F.when(k == 0, u).when(k == 1, F.concat(F.lit("  "), dashed, F.lit(" "))).when(k == 2, "unknown").otherwise(F.substring(u, 1, 31))
    return tables.auctions(spark, d).select("auction_uid", identity.normal_uuid(text).alias("uuid"))


@query()
def auction_uid(spark, d):
    own = F.when(F.col("auction_uid") % 2 == 0, F.col("auction_uid"))
    return tables.auctions(spark, d).select("uuid", identity.auction_uid(own, F.col("uuid")).alias("auction_uid"))


@query("SELECT c_custkey, 'Bin=true;Seller=' || c_custkey || ';Tier=F' AS key FROM customer")
def filter_key(spark, d):
    m = F.create_map(F.lit("Tier"), F.lit("F"), F.lit("EndAfter"), F.lit("1"), F.lit("Seller"), F.col("c_custkey").cast("string"), F.lit("Bin"), F.lit("true"), F.lit("EndBefore"), F.lit("2"))
    return tables.table(spark, d, "customer").select("c_custkey", identity.filter_key(m).alias("key"))


@query("SELECT DISTINCT 'players/' || substr(md5(CAST(seller AS VARCHAR)), 1, 2) || '/' || md5(CAST(seller AS VARCHAR)) || '/' || year(end_ts) || '.json.gz' AS key FROM auctions")
def player_key(spark, d):
    return tables.auctions(spark, d).select(identity.player_key(F.md5(F.col("seller").cast("string")), F.year("end_ts")).alias("key")).distinct()


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'DIVINE' WHEN 1 THEN 'RARE' WHEN 2 THEN 'UNKNOWN' ELSE 'UNKNOWN' END AS tier FROM part")
def tier_normalize(spark, d):
    k = F.col("p_partkey") % 4
    return tables.table(spark, d, "part").select("p_partkey", identity.normal_tier(F.when(k == 0, "SUPREME").when(k == 1, "rare").when(k == 2, "none")).alias("tier"))


@query("SELECT n_nationkey, CAST(ceil(-(1000 * (n_nationkey + 1)) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM nation")
def bloom_size(spark, d):
    n = F.lit(1000) * (F.col("n_nationkey") + 1)
    return tables.table(spark, d, "nation").select("n_nationkey", F.ceil(-n * F.log(F.lit(0.01)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).alias("bits"))


@query("SELECT a.auction_uid, coalesce(max(b.ts), any_value(a.start_ts)) AS write_ts FROM auctions a LEFT JOIN bids b USING (auction_uid) GROUP BY a.auction_uid")
def write_timestamp(spark, d):
    return tables.with_bids(tables.auctions(spark, d), B(spark, d)).select("auction_uid", nested.write_time(F.col("bids"), F.col("start_ts")).alias("write_ts"))


@query("SELECT auction_uid, bid_count, (SELECT count(*) FROM bids b WHERE b.auction_uid = a.auction_uid AND b.bidder = 7) > 0 AS by_7 FROM auctions a")
def bid_count(spark, d):
    rows = tables.with_bids(tables.auctions(spark, d).select("auction_uid"), B(spark, d))
    return rows.select("auction_uid", F.size("bids").cast("long").alias("bid_count"), F.exists("bids", lambda b: b["bidder"] == 7).alias("by_7"))


@query("SELECT auction_uid, CASE WHEN auction_uid % 5 = 0 THEN '0' ELSE CAST(auction_uid % 6 AS VARCHAR) END AS stars FROM auctions")
def nbt_lookup(spark, d):
    return tables.auctions(spark, d).select("auction_uid", F.coalesce(F.element_at(attributes()["nbt"], "upgrade_level"), F.lit("0")).alias("stars"))


@query("SELECT auction_uid, md5(CAST(auction_uid AS VARCHAR)) AS auction_uuid, md5(CAST(bidder AS VARCHAR)) AS bidder, amount, ts, CASE WHEN bidder % 3 > 0 THEN repeat('b', CAST(bidder AS INT)) || '\u00e9' END AS bidder_name, md5(CAST(seq AS VARCHAR)) AS profile_id FROM bids")
def bids_msgpack(spark, d):
    """Bids of an auction as one packed value, read back. What follows from a bid's numbers, names that may be
    long among it, is made after the bids are grouped, so that it is not shuffled."""
    hashed = lambda c: F.md5(c.cast("string"))
    named = lambda n: F.when(n % 3 > 0, F.concat(F.repeat(F.lit("b"), n.cast("int")), F.lit("\u00e9")))

    def bid(b):
        fields = {"auction_uuid": hashed(F.col("auction_uid")), "bidder": hashed(b["bidder"]), "amount": b["amount"], "ts": b["ts"].cast("timestamp"), "bidder_name": named(b["bidder"]), "profile_id": hashed(b["seq"])}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    lists = B(spark, d).groupBy("auction_uid").agg(F.collect_list(F.struct("bidder", "amount", "ts", "seq")).alias("bids"))
    kept = lists.select("auction_uid", packed.bids_packed(F.transform("bids", bid)).alias("value"))
    back = kept.select("auction_uid", F.explode(packed.bids_unpacked(F.col("value"))).alias("b")).select("auction_uid", "b.*")
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT auction_uid, 'ExtraAttributes.enchantments.sharpness=' || auction_uid % 7 || ';ExtraAttributes.gems.0=' || tag || ';ExtraAttributes.gems.1=' || tier || ';ExtraAttributes.id=' || tag || ';ExtraAttributes.timestamp=' || auction_uid * 10000000000
  || ';i.Count=' || bid_count AS nbt FROM auctions""")
def nbt_flatten(spark, d):
    """An item tree of each auction, gzipped for every second one, as a flat map."""

    def trees(batches):
        import gzip

        import pandas as pd

        for rows in batches:
            made = []
            for uid, tag, tier, n in zip(rows["auction_uid"], rows["tag"], rows["tier"], rows["bid_count"]):
                tree = nbt.tree({"i": {"Count": int(n)}, "ExtraAttributes": {"id": tag, "enchantments": {"sharpness": int(uid) % 7}, "gems": [tag, tier], "timestamp": int(uid) * 10_000_000_000, "none": []}})
                made.append(gzip.compress(tree, 1) if uid % 2 else tree)
            yield pd.DataFrame({"auction_uid": rows["auction_uid"], "item": made})

    items = tables.auctions(spark, d).select("auction_uid", "tag", "tier", "bid_count").mapInPandas(trees, "auction_uid long, item binary")
    return items.select("auction_uid", nested.map_text(nbt.attributes(F.col("item"))).alias("nbt"))


@query("SELECT auction_uid, tag, end_ts, highest_bid FROM auctions")
def json_roundtrip(spark, d):
    cols = ["auction_uid", "tag", "end_ts", "highest_bid"]
    text = tables.auctions(spark, d).select(F.to_json(F.struct(*cols)).alias("j"))
    return text.select(F.from_json("j", "auction_uid long, tag string, end_ts timestamp_ntz, highest_bid long").alias("r")).select("r.*")


PER_FILE = 50_000


def auction_events(spark, d, files):
    """Events of all auctions with their bids, dealt by auction to ``files`` partitions; each auction comes twice
    in a partition, first without a price. Some events are junk or lack a uuid. Auctions are worked out and
    shuffled once for all their events."""
    rows = tables.with_bids(tables.unpriced(spark, d), B(spark, d))
    high = F.coalesce(F.array_max(F.transform("bids", lambda b: b["amount"])), F.lit(0).cast("long"))
    bids = F.transform("bids", lambda b: F.struct(b["bidder"].alias("bidder"), b["amount"].alias("amount"), b["ts"].alias("ts")))
    rows = rows.select("auction_uid", "uuid", "tag", "seller", "end_ts", "start_ts", high.alias("highest_bid"), bids.alias("bids")).repartition(files, "auction_uid")

    def event(uuid=F.col("uuid"), tag=F.col("tag"), seller=F.col("seller"), highest_bid=F.col("highest_bid"), write_ts=F.col("end_ts")):  # noqa: B008
        return F.struct(uuid.alias("uuid"), tag.alias("tag"), seller.alias("seller"), highest_bid.alias("highest_bid"), write_ts.alias("write_ts"))

    early = {"highest_bid": F.lit(0).cast("long"), "write_ts": F.col("start_ts")}
    junk = F.when(F.col("auction_uid") % 10 == 1, event(tag=F.lit(None).cast("string"), seller=F.lit(None).cast("long"), **early))
    nameless = F.when(F.col("auction_uid") % 10 == 2, event(uuid=F.lit(None).cast("string")))
    return rows.select("auction_uid", "end_ts", "start_ts", "bids", F.explode(F.array_compact(F.array(event(), event(**early), junk, nameless))).alias("e")).select("auction_uid", "end_ts", "start_ts", "bids", "e.*")


def ingested(spark, d, mirror=False):
    """The folder that a stream of auction_events() leaves, in two batches of files of some PER_FILE auctions."""
    top, half = folder(spark), max(2, -(-tables.table(spark, d, "orders").count() // (2 * PER_FILE)))
    auction_events(spark, d, 2 * half).write.option("compression", "zstd").parquet(f"{top}/in")
    ingest.start(ingest.file_source(spark, f"{top}/in", half), f"{top}/out", f"{top}/checkpoint", mirror).awaitTermination()
    return f"{top}/out"


@query("SELECT uuid, max(highest_bid) AS highest_bid FROM auctions GROUP BY uuid")
def stream_ingest(spark, d):
    return ingest.current(spark, ingested(spark, d)).select("uuid", "highest_bid")


@query("SELECT DISTINCT player, auction_uid, type FROM took_part")
def stream_participations(spark, d):
    return ingest.participations(spark, ingested(spark, d)).select("player", "auction_uid", "type")


@query("""SELECT 'rows_in' AS name, 2 * count(*) + count(*) FILTER (auction_uid % 10 IN (1, 2)) AS value FROM auctions UNION ALL SELECT 'junk', count(*) FROM auctions WHERE auction_uid % 10 = 1
UNION ALL SELECT 'without_uuid', count(*) FROM auctions WHERE auction_uid % 10 = 2 UNION ALL SELECT 'kept', count(*) FROM auctions UNION ALL SELECT 'repeats', count(*) FROM auctions
UNION ALL SELECT 'bids', count(*) FROM (SELECT DISTINCT auction_uid, bidder, amount, ts FROM bids)""")
def stream_metrics(spark, d):
    """What passed and what was left out; both events of an auction are in one batch, so half are repeats."""
    out = ingested(spark, d)
    metrics.settled(spark)
    sums = metrics.metrics(spark, f"{out}/metrics").where("name <> 'batch_ms'").groupBy("name").agg(F.sum("value").alias("value"))
    wide = sums.groupBy().pivot("name", ["rows_in", "junk", "without_uuid", "kept"]).agg(F.first("value"))
    return sums.unionByName(wide.select(F.lit("repeats").alias("name"), F.expr("rows_in - junk - without_uuid - kept").alias("value")))


@query("""SELECT sink, uuid, status FROM (SELECT 'prices' AS sink, uuid, CASE WHEN auction_uid IN ((SELECT min(auction_uid) FROM auctions), (SELECT max(auction_uid) FROM auctions)) THEN 'dead' ELSE 'written' END AS status FROM auctions
UNION ALL SELECT 'all', uuid, 'written' FROM auctions)""")
def stream_quarantine(spark, d):
    """Two rows have a price that is no number: one sink can't take them, the other takes all. The batch is
    sent again, and a third sink, which is down at first, gets it later."""
    rows = tables.auctions(spark, d)
    first, last = rows.agg(F.min("auction_uid"), F.max("auction_uid")).first()
    events = rows.select("auction_uid", "uuid", F.when(F.col("auction_uid").isin(first, last), F.concat(F.col("highest_bid").cast("string"), F.lit(" coins"))).otherwise(F.col("highest_bid").cast("string")).alias("price")).persist()
    down = {"now": True}

    def priced(x: DataFrame, path: str) -> None:
        number = F.col("price").try_cast("long")
        x.select("uuid", F.when(number.isNull(), F.raise_error(F.concat(F.lit("no price: "), "price")).cast("long")).otherwise(number).alias("price")).write.parquet(path)

    def late(x: DataFrame, path: str) -> None:
        if down["now"]:
            raise OSError("the sink is down")
        x.select("uuid").write.parquet(path)

    out = sinks.Sinks(spark, folder(spark), {"prices": priced, "all": lambda x, path: x.select("uuid").write.parquet(path), "late": late})
    out.write(events, 1)
    out.write(events, 1)
    down["now"] = False
    out.write(events.limit(0), 2)
    assert out.written("late").count() == out.written("all").count()
    dead = out.dead().select("sink", F.get_json_object("row", "$.uuid").alias("uuid"), F.lit("dead").alias("status"))
    good = [out.written(name).select(F.lit(name).alias("sink"), "uuid", F.lit("written").alias("status")) for name in ("prices", "all")]
    return dead.unionByName(good[0]).unionByName(good[1])


@query("SELECT auction_uid, tag, strftime(end_ts, '%Y-%m') AS month, highest_bid FROM auctions")
def stream_archive(spark, d):
    return ingest.archived(spark, ingested(spark, d, mirror=True)).select("auction_uid", "tag", "month", "highest_bid")


@query(_UNSOLD.format(rows="auctions", sold="auctions") + """, early AS (SELECT h.auction_uid, c.start_ts, c.starting_bid, CAST(c.e >= h.end_ts + INTERVAL '3' DAY AS INT) AS late, c.e
  FROM auctions h JOIN unsold c ON c.uuid = h.uuid AND c.e < h.end_ts + INTERVAL '14' DAY AND c.e > h.end_ts - INTERVAL '14' DAY),
first AS (SELECT *, row_number() OVER (PARTITION BY auction_uid ORDER BY late, e DESC, CAST(starting_bid AS VARCHAR) DESC) AS r FROM early)
SELECT a.uuid, a.seller, f.start_ts, f.starting_bid FROM auctions a LEFT JOIN first f ON f.auction_uid = a.auction_uid AND r = 1""")
def stream_retrofit(spark, d):
    """Sold events arrive after the unsold ones that ended up to three days later and before the others,
    which end up to 19 days later; some find none."""
    top, a = folder(spark), tables.auctions(spark, d).select("uuid", "tag", "seller", "end_ts", "start_ts", "bin", "auction_uid", "is_sold")
    unsold = stored_unsold(a).withColumn("is_sold", F.lit(False)).withColumn("_days", F.when(F.col("starting_bid") >= 1000, F.col("auction_uid") % 7).otherwise(F.col("auction_uid") % 20))
    sold = lacking(a.withColumn("is_sold", F.lit(True)))
    events = [unsold.where("_days < 3"), sold, unsold.where("_days >= 3")]
    instants = [rows.select(*sold.columns).withColumn("end_ts", F.col("end_ts").cast("timestamp")) for rows in events]  # watermarks need them, not local times
    for at, rows in enumerate(instants):  # a run takes a step as one batch, of as many files as it has
        rows.write.parquet(f"{top}/in/{at}")
        if at == len(events) - 1:
            completion.last_event(spark.read.parquet(f"{top}/in/*"), 10_000).write.parquet(f"{top}/in/last")
        read = spark.readStream.schema(instants[0].schema).parquet(f"{top}/in/*")
        # the test tables' events come in order of id, not of time: all of them may be late
        out = completion.completed(read, delay="5000 days").writeStream.format("parquet").option("checkpointLocation", f"{top}/checkpoint")
        out.trigger(availableNow=True).start(f"{top}/out").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("uuid", "seller", "start_ts", "starting_bid")


@query("SELECT o_orderkey AS job_id, 'user' || o_custkey AS email, CASE o_orderkey % 4 WHEN 2 THEN 'Done' ELSE 'Deleted' END AS status, CAST(o_orderkey % 4 AS BIGINT) AS changed_at FROM orders WHERE o_orderkey % 4 >= 2")
def export_jobs(spark, d):
    k = F.col("o_orderkey") % 4
    done = F.array(F.lit("request"), F.when(k >= 1, "start"), F.when(k >= 2, "finish"), F.when(k >= 3, "delete"), F.when(k >= 3, "abort"))
    log = tables.table(spark, d, "orders").select(F.concat(F.lit(" User"), "o_custkey").alias("email"), F.col("o_orderdate").alias("requested_at"), F.col("o_orderkey").alias("job_id"), F.posexplode(done).alias("at", "action"))
    path = folder(spark)
    jobs.save(log.where("action is not null").withColumn("at", F.col("at").cast("long")), path)
    ended = jobs.states(spark.read.parquet(path)).where(F.col("status").isin(*jobs.ENDED))
    return ended.select("job_id", "email", "status", "changed_at")
