"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, compare, membership
from ..functions.compare import Op
from ..operators.compaction import Policy
from ..operators.container import Ordered, Sequence
from ..operators.resolve import newest
from ..sources.cursor import LiveCursor, keyset_page
from ..sources.store import ObjectNotFound, ObjectStore, scratch
from ..sources.table import LedgerTable, frame_cache
from ..spec import TableSpec
from ..streaming.ingest import ingest
from .logs import RECENCY, event_log, event_scan, levelled, order_scan, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Common table expressions of the SQL.
LOG = "l AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id, ts, event_type, event_type = 'error' AS deleted FROM events)"
TOP = f"{LOG}, top AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1)"
LIVE = f"{TOP}, live AS (SELECT k, event_id, ts, event_type FROM top WHERE NOT deleted)"
ORDERS = "o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderkey, o_orderstatus, o_orderpriority FROM orders)"
LEVELS = f"{LOG}, v AS (SELECT *, CAST(ntile(4) OVER (ORDER BY ts DESC, event_id DESC) - 1 AS BIGINT) AS lvl FROM l)"
PER_LEVEL = f"{LEVELS}, u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lvl, k ORDER BY ts DESC, event_id DESC) = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_scan(spark, sf_dir).find("GE", "1").limit(20).df()


def _ranked_sql(source: str, condition: str, direction: str = "", columns: str = "k, event_id, ts, event_type") -> str:
    return f"SELECT {columns}, CAST(row_number() OVER (ORDER BY k {direction}) AS BIGINT) AS rank FROM {source} WHERE {condition}"


# -- resolution and lookups


@query(f"WITH {TOP} SELECT * FROM top")
def resolve_latest(spark, sf_dir):
    return newest(event_log(spark, sf_dir), ["k"], RECENCY)


@query(f"WITH {TOP} SELECT * FROM top")
def resolve_latest_aggregate(spark, sf_dir):
    return newest(event_log(spark, sf_dir), ["k"], RECENCY, "aggregate")


@query(f"WITH {LIVE} SELECT * FROM live")
def live_rows(spark, sf_dir):
    return event_scan(spark, sf_dir).rows()


@query(f"WITH {LIVE} {_ranked_sql('live', 'true')}")
def items_in_order(spark, sf_dir):
    return event_scan(spark, sf_dir).ranked()


@query(f"WITH {LIVE} SELECT * FROM live WHERE k = (SELECT min(k) FROM live)")
def search_hit(spark, sf_dir):
    scan = event_scan(spark, sf_dir)
    key = scan.rows().agg(F.min("k")).first()[0]
    return scan.find(Op.EQ, key or "").df()


@query(f"WITH {LIVE} SELECT * FROM live WHERE k = 'no such key'")
def search_miss(spark, sf_dir):
    return event_scan(spark, sf_dir).find(Op.EQ, "no such key").df()


@query(f"WITH {LIVE} SELECT * FROM live WHERE k = (SELECT min(k) FROM top WHERE deleted)")
def search_tombstone(spark, sf_dir):
    scan = event_scan(spark, sf_dir)
    key = scan.with_tombstones().rows().where("deleted").agg(F.min("k")).first()[0]
    return scan.find(Op.EQ, key or "").df()


_WANTED = "SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT 'absent ' || c_custkey FROM customer"


def _wanted(spark, sf_dir) -> DataFrame:
    """All customer numbers as keys, and as many keys that are surely absent."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return keys.union(keys.select(F.concat(F.lit("absent "), "k"))).distinct()


@query(f"WITH {LIVE} SELECT * FROM live WHERE k IN ({_WANTED})")
def bulk_search(spark, sf_dir):
    keys = _wanted(spark, sf_dir)
    log = event_log(spark, sf_dir).join(keys, "k", "left_semi")
    return newest(log, ["k"], RECENCY).where("not deleted").drop("deleted")


# -- ordered scans


@query(f"WITH {LIVE} {_ranked_sql('live', "k >= '3'")}")
def find_ge(spark, sf_dir):
    return event_scan(spark, sf_dir).find("GE", "3").ranked()


@query(f"WITH {LIVE} {_ranked_sql('live', "k > '3'")}")
def find_gt(spark, sf_dir):
    return event_scan(spark, sf_dir).find("GT", "3").ranked()


@query(f"WITH {LIVE} {_ranked_sql('live', "k <= '5'", 'DESC')}")
def find_le(spark, sf_dir):
    return event_scan(spark, sf_dir).find("LE", "5").ranked()


@query(f"WITH {LIVE} {_ranked_sql('live', "k < '5'", 'DESC')}")
def find_lt(spark, sf_dir):
    return event_scan(spark, sf_dir).find("LT", "5").ranked()


_O = "k, o_orderkey, o_orderstatus, o_orderpriority"
_RANGES = {
    "range_ge_asc": ("GE", "111", "333", "k >= '111' AND k <= '333'", ""),
    "range_gt_asc": ("GT", "111", "333", "k > '111' AND k <= '333'", ""),
    "range_le_desc": ("LE", "333", "111", "k <= '333' AND k >= '111'", "DESC"),
    "range_lt_desc": ("LT", "333", "111", "k < '333' AND k >= '111'", "DESC"),
    "range_single_key": ("GE", "123", "123", "k = '123'", ""),
    "range_reversed_empty": ("GE", "999", "888", "false", ""),
    "range_open_end": ("GE", "97", None, "k >= '97'", ""),
    "range_beyond_max": ("GE", "9", "99999999999", "k >= '9' AND k <= '99999999999'", ""),
}


def _range(op: str, start: str, end: str | None) -> Query:
    return lambda spark, sf_dir: order_scan(spark, sf_dir).range(op, start, end).ranked()


for _name, (_op, _start, _end, _where, _direction) in _RANGES.items():
    _QUERIES[_name] = _range(_op, _start, _end)
    _SQL[_name] = f"WITH {ORDERS} {_ranked_sql('o', _where, _direction, _O)}"


@query(f"WITH {LIVE} SELECT * FROM live WHERE event_type <> 'click' AND event_id % 2 = 0")
def filter_chain(spark, sf_dir):
    return event_scan(spark, sf_dir).filter(F.col("event_type") != "click").filter(F.col("event_id") % 2 == 0).rows()


@query(f"WITH {LIVE} SELECT * FROM live WHERE event_id % 2 = 0")
def filter_function(spark, sf_dir):
    return event_scan(spark, sf_dir).filter(lambda batch: batch["event_id"] % 2 == 0).rows()


@query(f"WITH {ORDERS} SELECT {_O} FROM o WHERE k < '9' ORDER BY k DESC LIMIT 13")
def scan_limit(spark, sf_dir):
    return order_scan(spark, sf_dir).find("LT", "9").limit(13).df()


@query(f"WITH {LIVE} SELECT * FROM live WHERE event_id % 2 = 0 ORDER BY k LIMIT 10")
def filter_then_limit(spark, sf_dir):
    return event_scan(spark, sf_dir).filter(F.col("event_id") % 2 == 0).limit(10).df()


@query(f"WITH {ORDERS} SELECT {_O} FROM o WHERE k > '4999' ORDER BY k LIMIT 100")
def keyset_paging(spark, sf_dir):
    return keyset_page(order_scan(spark, sf_dir).rows(), ["k"], ("4999",), 100)


# -- levels, merges and counts


@query(f"WITH {LEVELS} SELECT * EXCLUDE (lvl) FROM v WHERE lvl BETWEEN 1 AND 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1")
def level_scan(spark, sf_dir):
    return newest(levelled(event_log(spark, sf_dir)).where("lvl between 1 and 2"), ["k"], RECENCY).drop("lvl")


_MERGED = f"{LEVELS}, m AS (SELECT *, CASE WHEN lvl <= 1 THEN 1 ELSE lvl END AS to_lvl FROM v), w AS (SELECT k, event_id, ts, event_type, deleted, CAST(to_lvl AS BIGINT) AS lvl FROM m QUALIFY row_number() OVER (PARTITION BY to_lvl, k ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"WITH {_MERGED} SELECT * FROM w")
def merge_levels_keep_tombstones(spark, sf_dir):
    log = levelled(event_log(spark, sf_dir)).withColumn("lvl", F.greatest("lvl", F.lit(1).cast("long")))
    return newest(log, ["lvl", "k"], RECENCY)


@query(f"WITH {LIVE} SELECT * FROM live")
def merge_to_last_gc(spark, sf_dir):
    merged = newest(levelled(event_log(spark, sf_dir)), ["k"], RECENCY)
    return merged.where("not deleted").drop("deleted", "lvl")


def _per_level(spark, sf_dir):
    return newest(levelled(event_log(spark, sf_dir)), ["lvl", "k"], RECENCY)


@query(f"WITH {PER_LEVEL} SELECT lvl, count(*) AS entries, CAST(sum(CASE WHEN deleted THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, CAST(sum(strlen(k) + 16) AS BIGINT) AS bytes FROM u GROUP BY lvl")
def stats_by_level(spark, sf_dir):
    size = compare.entry_size("k", overhead=16)
    return _per_level(spark, sf_dir).groupBy("lvl").agg(F.count("*").alias("entries"), F.sum(F.col("deleted").cast("long")).alias("tombstones"), F.sum(size).alias("bytes"))


@query(f"WITH {PER_LEVEL} SELECT count(*) AS n FROM u")
def count_physical(spark, sf_dir):
    return _per_level(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"WITH {PER_LEVEL} SELECT count(*) AS n FROM u WHERE deleted")
def count_deleted(spark, sf_dir):
    return _per_level(spark, sf_dir).where("deleted").agg(F.count("*").alias("n"))


@query(f"WITH {LIVE} SELECT count(*) AS n FROM live")
def count_live(spark, sf_dir):
    return event_scan(spark, sf_dir).rows().agg(F.count("*").alias("n"))


# -- ordered containers


def _parts(spark, sf_dir) -> Ordered:
    return Ordered(table(spark, sf_dir, "part").select(F.col("p_name").alias("k"), "p_partkey"), ("k",))


@query("SELECT min(p_name) AS first, max(p_name) AS last FROM part")
def first_last(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    first, last = parts.first(), parts.last()
    return spark.createDataFrame([(first and first.k, last and last.k)], "first string, last string")


@query("""
    WITH p AS (SELECT DISTINCT c_mktsegment AS probe FROM customer UNION SELECT n_name FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT p_name FROM part),
    t AS (SELECT DISTINCT p_name AS k FROM part)
    SELECT probe, max(k) FILTER (k < probe) AS lower, max(k) FILTER (k <= probe) AS floor, min(k) FILTER (k >= probe) AS ceiling, min(k) FILTER (k > probe) AS higher
    FROM p, t GROUP BY probe
""")
def floor_ceiling_lower_higher(spark, sf_dir):
    names = table(spark, sf_dir, "nation")
    probes = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("probe")).union(names.select("n_name")).union(names.select(F.lower("n_name"))).union(table(spark, sf_dir, "part").select("p_name"))
    return _parts(spark, sf_dir).nearest(probes.distinct(), "probe")


@query(f"WITH {LIVE} SELECT *, lag(k) OVER (ORDER BY k) AS prev, lead(k) OVER (ORDER BY k) AS next FROM live")
def neighbours(spark, sf_dir):
    return Ordered(event_scan(spark, sf_dir).rows(), ("k",)).neighbours()


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM (SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL")
def multiset_insert(spark, sf_dir):
    items = Ordered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"))
    both = items.insert(items.df.where("l_linenumber = 1"))
    return both.df.groupBy(*both.keys).agg(F.count("*").alias("copies"))


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, count(*) - CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE copies > 0")
def remove_one(spark, sf_dir):
    items = Ordered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"))
    left = items.remove(items.df.where("l_orderkey % 2 = 0").distinct())
    return left.df.groupBy(*left.keys).agg(F.count("*").alias("copies"))


@query("SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def insert_or_replace(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return Ordered(base, ("k",)).insert_or_replace(new).df


@query("SELECT n_nationkey, r_regionkey, CASE WHEN n_name < r_name THEN -1 WHEN n_name > r_name THEN 1 ELSE 0 END AS by_text, CASE WHEN n_nationkey < r_regionkey THEN -1 WHEN n_nationkey > r_regionkey THEN 1 ELSE 0 END AS by_number FROM nation JOIN region ON n_regionkey = r_regionkey")
def compare_keys(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", "r_regionkey", compare.compare_strings(F.col("n_name"), F.col("r_name")).alias("by_text"), compare.compare_ints(F.col("n_nationkey"), F.col("r_regionkey")).alias("by_number"))


@query("SELECT p_partkey, CAST(strlen(p_name) + 16 AS BIGINT) AS size, '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}' AS text FROM part")
def entry_size_and_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", compare.entry_size("p_name", overhead=16).alias("size"), compare.entry_text("p_partkey", "p_name").alias("text"))


@query("SELECT o_orderkey, upper(printf('%016x', o_orderkey)) AS fixed64, -o_orderkey AS negative, o_orderpriority AS text, o_orderkey AS back FROM orders")
def codec_roundtrip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    negative = codec.from_zigzag(codec.from_varint(codec.varint(codec.zigzag(-F.col("o_orderkey")))))
    text = codec.from_sized(codec.sized(F.col("o_orderpriority"))).cast("string")
    return o.select("o_orderkey", F.hex(codec.fixed(F.col("o_orderkey"), 8)).alias("fixed64"), negative.alias("negative"), text.alias("text"), codec.from_fixed(codec.fixed(F.col("o_orderkey"), 8)).alias("back"))


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_regionkey = 1 DESC, n_regionkey = 2, n_nationkey) AS BIGINT) AS at FROM nation WHERE n_regionkey <> 3")
def sequence_moves(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("position", F.col("n_nationkey").cast("long"))
    moved = Sequence(n).move(F.col("n_regionkey") == 1).move_tail(F.col("n_regionkey") == 2).remove(F.col("n_regionkey") == 3)
    return Ordered(moved.df, ("position",)).ranked().select("n_name", F.col("rank").alias("at"))


# -- stored tables


EVENTS = TableSpec("events", T.StructType([T.StructField("k", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())]), ("k",))
_STORED = f"WITH {LIVE} SELECT k, event_id, event_type FROM live"


def _stored(spark, sf_dir, name: str, batches: int = 4, policy: Policy | None = None) -> LedgerTable:
    """The event log in so many batches, oldest first."""
    log = levelled(event_log(spark, sf_dir), batches)
    made = LedgerTable.create(spark, scratch(spark, name), EVENTS, policy or Policy(auto=False))
    for n in reversed(range(batches)):
        made.apply(log.where(F.col("lvl") == n), "deleted", list(RECENCY))
    return made


@query(_STORED)
def table_batches(spark, sf_dir):
    return _stored(spark, sf_dir, "batches").scan().rows()


@query(_STORED)
def table_reopened(spark, sf_dir):
    made = _stored(spark, sf_dir, "reopened")
    return LedgerTable.open(spark, made.store.base).scan().rows()


@query(_STORED)
def compact_equivalence(spark, sf_dir):
    made = _stored(spark, sf_dir, "compacted")
    made.compact(0, 1)
    made.compact_all()
    made.vacuum()
    return made.scan().rows()


@query(f"WITH {LIVE} SELECT CAST(1 AS INTEGER) AS level, CAST(1 AS INTEGER) AS runs, count(*) AS entries, CAST(0 AS BIGINT) AS tombstones FROM live")
def table_stats(spark, sf_dir):
    made = _stored(spark, sf_dir, "stats")
    made.compact_all()
    return made.stats().drop("bytes")


@query("SELECT CAST(NULL AS VARCHAR) AS fault WHERE false")
def table_verify(spark, sf_dir):
    return _stored(spark, sf_dir, "verified").verify().select("fault")


@query(f"{_STORED} WHERE k >= '2' AND k <= '7'")
def table_range(spark, sf_dir):
    return _stored(spark, sf_dir, "ranged").find_range("GE", "2", "7").rows()


@query(_STORED)
def stream_ingest(spark, sf_dir):
    made = LedgerTable.create(spark, scratch(spark, "streamed"), EVENTS, Policy(auto=False))
    source = scratch(spark, "stream-source")
    event_log(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("long")).write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest(spark.readStream.schema(schema).parquet(source), made, "deleted", list(RECENCY), scratch(spark, "stream-state")).awaitTermination()
    return made.refresh().scan().rows()


@query(f"WITH {LIVE} SELECT * FROM live WHERE k IN ({_WANTED})")
def bloom_membership(spark, sf_dir):
    keys = _wanted(spark, sf_dir)
    log = event_log(spark, sf_dir)
    maybe = log.where(membership.may_contain(log, membership.build(keys, "k"), "k"))
    return newest(maybe.join(keys, "k", "left_semi"), ["k"], RECENCY).where("not deleted").drop("deleted")


@query("SELECT c_custkey FROM customer")
def bloom_round_trip(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    built = membership.build(keys, "c_custkey")
    again = built and membership.BloomFilter.decode(built.encode())
    return keys.where(membership.may_contain(keys, again, "c_custkey"))


# -- cursors, searches and upkeep of stored tables


@query(f"{_STORED} WHERE k IN ('1', '10', '57', '99', 'no such key') OR k = (SELECT min(k) FROM top WHERE deleted)")
def table_search(spark, sf_dir):
    made = _stored(spark, sf_dir, "searched")
    gone = made.scan().with_tombstones().rows().where("_deleted").agg(F.min("k")).first()[0]
    found = [made.search(k) for k in ("1", "10", "57", "99", "no such key", gone or "")]
    return spark.createDataFrame([(r.k, r.event_id, r.event_type) for r in found if r is not None], EVENTS.schema)


ORDER_TABLE = TableSpec("orders", T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())]), ("o_orderkey",))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'back' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000")
def table_upsert_delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(*ORDER_TABLE.schema.fieldNames())
    made = LedgerTable.create(spark, scratch(spark, "upserts"), ORDER_TABLE, Policy(auto=False))
    made.upsert(o)
    made.delete(o.where("o_orderstatus = 'F'").select("o_orderkey"))
    made.upsert(o.where("o_orderstatus = 'F' and o_totalprice > 100000").withColumn("o_orderstatus", F.lit("back")))
    return made.scan().rows()


@query(f"WITH {LIVE} SELECT k, event_id, event_type, true AS few FROM live")
def auto_compaction(spark, sf_dir):
    made = _stored(spark, sf_dir, "automatic", 8, Policy(most_batches=3))
    return made.scan().rows().withColumn("few", F.lit(len(made.manifest.level(0)) <= 3))


@query("SELECT CAST(3 AS INTEGER) AS held, CAST(0 AS INTEGER) AS released")
def compaction_held(spark, sf_dir):
    log = levelled(event_log(spark, sf_dir), 4)
    made = LedgerTable.create(spark, scratch(spark, "held"), EVENTS, Policy(most_batches=0))
    with made.compaction_held():
        for n in (3, 2, 1):
            made.apply(log.where(F.col("lvl") == n), "deleted", list(RECENCY))
        held = len(made.manifest.level(0))
    made.apply(log.where("lvl = 0"), "deleted", list(RECENCY))
    return spark.createDataFrame([(held, len(made.manifest.level(0)))], "held int, released int")


@query(f"{_STORED}")
def table_flush(spark, sf_dir):
    made = _stored(spark, sf_dir, "flushed")
    made.flush()
    return made.scan(1).rows().where(F.lit(not made.manifest.level(0)))


@query(f"WITH {PER_LEVEL} SELECT count(*) AS entries, CAST(sum(CASE WHEN deleted THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, true AS same_files, CAST(1 AS INTEGER) AS down, CAST(1 AS INTEGER) AS up FROM u WHERE lvl = 0")
def move_and_pop_up(spark, sf_dir):
    """A batch far above older rows moves down as it is; pushed below, it is small for that level and goes back up."""
    log = levelled(event_log(spark, sf_dir))
    made = LedgerTable.create(spark, scratch(spark, "moved"), EVENTS, Policy(auto=False, base_bytes=1))
    made.apply(log.where("lvl > 0"), "deleted", list(RECENCY))
    made.compact(0, 4)
    made.apply(log.where("lvl = 0"), "deleted", list(RECENCY))
    files = [p.path for p in made.manifest.level(0)[0].parts]
    made.compact(0, 1)
    down = next(n for n, run in made.manifest.runs())
    made.policy = Policy(auto=False, base_bytes=1 << 40)
    made.compact(1, 2)
    up, run = made.manifest.runs()[0]
    return spark.createDataFrame([(run.rows, run.deleted, [p.path for p in run.parts] == files, down, up)], "entries long, tombstones long, same_files boolean, down int, up int")


@query(f"WITH {ORDERS}, f AS (SELECT k FROM o WHERE k < '5' ORDER BY k LIMIT 100) SELECT k FROM f UNION SELECT k FROM o WHERE k > (SELECT max(k) FROM f)")
def live_cursor(spark, sf_dir):
    """Keys that a cursor returns, pages read before and after the other half of the table is written."""
    spec = TableSpec("keys", T.StructType([T.StructField("k", T.StringType())]), ("k",))
    keys = order_scan(spark, sf_dir).rows().select("k")
    made = LedgerTable.create(spark, scratch(spark, "cursor"), spec, Policy(auto=False))
    made.upsert(keys.where("k < '5'"))
    cursor = LiveCursor(made, "GE", page=100)
    first = cursor.next_df()
    LedgerTable.open(spark, made.store.base, policy=Policy(auto=False)).upsert(keys.where("k >= '5' or k <= '2'"))
    cursor.page = 0
    pages = [] if first is None else [first, *cursor.pages()]  # a cursor that found nothing has no key to go on from
    return reduce(DataFrame.unionByName, pages, spark.createDataFrame([], "k string"))


@query("SELECT true AS before, true AS after, CAST(0.5 AS DOUBLE) AS hit_ratio")
def memory_and_cache(spark, sf_dir):
    made = _stored(spark, sf_dir, "cached", 2)
    cached = LedgerTable.open(spark, made.store.base, policy=Policy(auto=False), cache=frame_cache(1 << 30))
    same = cached.scan().count() == cached.scan().count()
    before = cached.memory_usage() > 0 and same
    cached.flush()
    ratio, cached.cache.capacity = cached.cache.hit_ratio, 0
    return spark.createDataFrame([(before, cached.memory_usage() == 0, ratio)], "before boolean, after boolean, hit_ratio double")


@query("SELECT * FROM (VALUES ('all', 'abcdefgh'), ('inner', 'cde'), ('tail', 'gh'), ('beyond', ''), ('missing', 'not found')) t(what, found)")
def ranged_read(spark, sf_dir):
    store = ObjectStore(spark, scratch(spark, "objects"))
    store.write("a/b", b"abcdefgh")
    found = {"all": store.read("a/b"), "inner": store.read("a/b", 2, 3), "tail": store.read("a/b", 6, 100), "beyond": store.read("a/b", 50, 4)}
    try:
        found["missing"] = store.read("a/none", 0, 1)
    except ObjectNotFound:
        found["missing"] = b"not found"
    return spark.createDataFrame([(k, v.decode()) for k, v in found.items()], "what string, found string")


@query(f"WITH {LIVE} SELECT count(*) AS items, count(*) = 0 AS empty, (SELECT count(*) FROM live WHERE k >= '2') AS beyond, true AS none FROM live")
def scan_items(spark, sf_dir):
    scan = event_scan(spark, sf_dir)
    visited: list = []
    scan.find("GE", "2").for_each(lambda r: visited.append(r.k))
    rows = [(len(scan.items()), scan.is_empty(), len(visited), scan.range("GE", "9", "1").is_empty())]
    return spark.createDataFrame(rows, "items long, empty boolean, beyond long, none boolean")


# -- containers and lists through their own methods


@query("""
    WITH probes(probe) AS (VALUES ('a'), ('blue anvil'), ('large'), ('red widget'), ('zz')), t AS (SELECT DISTINCT p_name AS k FROM part)
    SELECT probe, max(k) FILTER (k = probe) AS eq, min(k) FILTER (k > probe) AS gt, min(k) FILTER (k >= probe) AS ge, max(k) FILTER (k < probe) AS lt, max(k) FILTER (k <= probe) AS le
    FROM probes CROSS JOIN t GROUP BY probe
""")
def container_find(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    rows = []
    for probe in ("a", "blue anvil", "large", "red widget", "zz"):
        found = [parts.find(op, probe) for op in ("EQ", "GT", "GE", "LT", "LE")]
        rows.append((probe, *(r and r.k for r in found)))
    return spark.createDataFrame(rows, "probe string, eq string, gt string, ge string, lt string, le string")


@query("SELECT count(*) AS n, false AS empty, CAST(0 AS BIGINT) AS cleared, min(p_name) AS hit, CAST(NULL AS VARCHAR) AS miss, CAST(3 AS BIGINT) AS visited FROM part")
def container_count_search_visit(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    first, seen = parts.first(), []
    hit, miss = parts.search(first.k if first else ""), parts.search("no such part")
    parts.for_each(lambda r: seen.append(r.k) or len(seen) < 3)
    rows = [(parts.count(), parts.is_empty(), parts.clear().count(), hit and hit.k, miss and miss.k, len(seen))]
    return spark.createDataFrame(rows, "n long, empty boolean, cleared long, hit string, miss string, visited long")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) - CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey) WHERE copies > 0")
def remove_items(spark, sf_dir):
    items = Ordered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ("l_orderkey", "l_linenumber"))
    left = items.remove_items(items.df.where("l_linenumber = 1").distinct())
    return left.df.groupBy(*left.df.columns).agg(F.count("*").alias("copies"))


@query("WITH d AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM region) SELECT (SELECT count(*) FROM d) - 1 AS left_over, (SELECT r_name FROM d WHERE n = 2) AS at")
def remove_at_cursor(spark, sf_dir):
    names = Ordered(table(spark, sf_dir, "region").select("r_name"), ("r_name",))
    rest, at = names.remove_at(names.first())
    return spark.createDataFrame([(rest.count(), at.r_name)], "left_over long, at string")


@query("SELECT p_name AS k, CAST(row_number() OVER (ORDER BY strlen(p_name) DESC, p_name) AS BIGINT) AS rank FROM (SELECT DISTINCT p_name FROM part)")
def order_by_derived_key(spark, sf_dir):
    """An order of the caller's own, longest names first, as a sort-key column."""
    names = _parts(spark, sf_dir).df.select("k").distinct().withColumn("sort_key", -F.octet_length("k"))
    return Ordered(names, ("sort_key", "k")).ranked().select("k", "rank")


def _list(spark, sf_dir) -> Sequence:
    return Sequence(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("position")))


@query("""
    WITH r AS (SELECT r_name AS name, r_regionkey AS i FROM region), n AS (SELECT n_name AS name, n_nationkey AS i FROM nation),
    x AS (SELECT name, 0 AS part, i FROM r UNION ALL SELECT name, 1, i FROM n UNION ALL SELECT name || '!', 2, i FROM r)
    SELECT name, CAST(row_number() OVER (ORDER BY part, i) AS BIGINT) AS at FROM x
""")
def sequence_add_and_splice(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("position"))
    both = _list(spark, sf_dir).add(regions).splice_tail(regions.withColumn("name", F.concat("name", F.lit("!"))))
    return Ordered(both.df, ("position",)).ranked().select("name", F.col("rank").alias("at"))


@query("SELECT (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) AS first, (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1) AS last, false AS empty, true AS has, false AS has_not, (SELECT count(*) FROM nation) AS items, CAST(2 AS BIGINT) AS visited")
def sequence_ends(spark, sf_dir):
    s, seen = _list(spark, sf_dir), []
    s.for_each(lambda r: seen.append(r) or len(seen) < 2)
    rows = [(s.first().name, s.last().name, s.is_empty(), s.contains(F.col("position") == 3), s.contains(F.col("name") == "none"), len(s.items()), len(seen))]
    return spark.createDataFrame(rows, "first string, last string, empty boolean, has boolean, has_not boolean, items long, visited long")


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS position, lag(n_name) OVER (ORDER BY n_nationkey) AS prev, lead(n_name) OVER (ORDER BY n_nationkey) AS next FROM nation")
def sequence_neighbours(spark, sf_dir):
    return _list(spark, sf_dir).neighbours("name")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '01' ELSE '00' END AS flag, p_size > 25 AS back, p_name AS raw, p_name[3:5] AS inner_bytes, CAST(NULL AS VARCHAR) AS torn, CASE WHEN p_size > 25 THEN CAST(NULL AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS in_range FROM part")
def codec_primitives(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    flag, raw = codec.boolean(F.col("p_size") > 25), F.col("p_name").cast("binary")
    bound = codec.checked_uint32(F.when(F.col("p_size") > 25, F.lit(1 << 32)).otherwise(F.col("p_size").cast("long")))
    return p.select("p_partkey", F.hex(flag).alias("flag"), codec.from_boolean(flag).alias("back"), codec.section(raw, 0, F.octet_length(raw)).cast("string").alias("raw"), codec.section(raw, 2, 3).cast("string").alias("inner_bytes"), codec.section(raw, F.octet_length(raw), 1).cast("string").alias("torn"), bound.alias("in_range"))
