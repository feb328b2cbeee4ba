"""The engine's queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import codecs, sketches
from larkspur.functions.aggregates import Agg
from larkspur.functions.predicates import all_of, any_of, compare, negate
from larkspur.functions.types import DeclaredType as D
from larkspur.functions.types import field
from larkspur.operators.ordering import read_granules, zone_map
from larkspur.operators.relational import aggregate, group, keep, project
from larkspur.plans.sql import Engine
from larkspur.sources.schema import TableDef
from larkspur.sources.table import Table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events")
    return group(keep(e, compare(e, "value", ">", 50)), ["event_type"], [Agg("count", "*", "n"), Agg("sum", "value", "total"), Agg("avg", "value", "mean"), Agg("min", "value", "low"), Agg("max", "value", "high")])


# Projection and scan.
_query("scan_all", "SELECT * FROM region")(lambda s, d: project(_read(s, d, "region")))
_query("scan_projection", "SELECT event_id, user_id, value FROM events")(lambda s, d: project(_read(s, d, "events"), ["event_id", "user_id", "value"]))


# Filters.
def _filtered(name: str, table: str, columns: list[str], sql: str, condition: Callable[[DataFrame], object]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _read(spark, sf, table)
        return project(keep(df, condition(df)), columns)

    _query(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}")(run)


_E, _L = ["event_id", "event_type", "value"], ["l_orderkey", "l_linenumber", "l_quantity"]
_filtered("filter_eq_str", "events", _E, "event_type = 'click'", lambda df: compare(df, "event_type", "=", "click"))
_filtered("filter_ne_str", "events", _E, "event_type <> 'click'", lambda df: compare(df, "event_type", "!=", "click"))
_filtered("filter_lt", "lineitem", _L, "l_quantity < 10", lambda df: compare(df, "l_quantity", "<", 10))
_filtered("filter_le", "lineitem", _L, "l_quantity <= 10", lambda df: compare(df, "l_quantity", "<=", 10))
_filtered("filter_gt", "lineitem", _L, "l_quantity > 40", lambda df: compare(df, "l_quantity", ">", 40))
_filtered("filter_ge", "lineitem", _L, "l_quantity >= 40", lambda df: compare(df, "l_quantity", ">=", 40))
_filtered("filter_and", "lineitem", _L, "l_quantity >= 40 AND l_returnflag = 'R'", lambda df: all_of(compare(df, "l_quantity", ">=", 40), compare(df, "l_returnflag", "=", "R")))
_filtered("filter_or", "lineitem", _L, "l_quantity < 3 OR l_returnflag = 'R'", lambda df: any_of(compare(df, "l_quantity", "<", 3), compare(df, "l_returnflag", "=", "R")))
_filtered("filter_not", "lineitem", _L, "NOT (l_returnflag = 'N')", lambda df: negate(compare(df, "l_returnflag", "=", "N")))
_filtered(
    "filter_nested", "lineitem", _L, "(l_quantity < 5 AND NOT (l_returnflag = 'N')) OR (l_discount >= 0.09 AND l_linestatus = 'O')",
    lambda df: any_of(all_of(compare(df, "l_quantity", "<", 5), negate(compare(df, "l_returnflag", "=", "N"))), all_of(compare(df, "l_discount", ">=", 0.09), compare(df, "l_linestatus", "=", "O"))),
)
_filtered("filter_str_order", "orders", ["o_orderkey", "o_orderpriority"], "o_orderpriority < '3'", lambda df: compare(df, "o_orderpriority", "<", "3"))
_filtered("filter_no_match", "events", _E, "value < -1000000000", lambda df: compare(df, "value", "<", -1000000000))
_filtered("filter_negative_literal", "customer", ["c_custkey", "c_acctbal"], "c_acctbal < -500", lambda df: compare(df, "c_acctbal", "<", -500))
for _n, _share in (("filter_sel_1", 100), ("filter_sel_10", 1000), ("filter_sel_50", 5000)):
    _filtered(_n, "events", ["event_id", "value"], f"event_id < {_share}", lambda df, _v=_share: compare(df, "event_id", "<", _v))


_filtered("filter_int_with_float", "lineitem", _L, "l_linenumber > 2.5 AND l_linenumber <= 6.0", lambda df: all_of(compare(df, "l_linenumber", ">", 2.5), compare(df, "l_linenumber", "<=", 6.0)))
_filtered("filter_beyond_int64", "orders", ["o_orderkey"], "o_orderkey < 18446744073709551615 AND o_orderkey >= -9223372036854775809", lambda df: all_of(compare(df, "o_orderkey", "<", 18446744073709551615), compare(df, "o_orderkey", ">=", -9223372036854775809)))


@_query("filter_nan", """SELECT l_orderkey, l_linenumber, 'above' AS side FROM lineitem WHERE l_linenumber <> 1 AND l_quantity >= 25
    UNION ALL SELECT l_orderkey, l_linenumber, 'below' FROM lineitem WHERE l_linenumber <> 1 AND l_quantity < 25
    UNION ALL SELECT l_orderkey, l_linenumber, 'other' FROM lineitem WHERE l_linenumber = 1 OR l_quantity <> 25""")
def _filter_nan(s, d):
    """A NaN is neither above nor below a number, but other than it."""
    df = _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"))
    sides = [("above", ">="), ("below", "<"), ("other", "!=")]
    above, below, other = (keep(df, compare(df, "x", op, 25)).select("l_orderkey", "l_linenumber", F.lit(n).alias("side")) for n, op in sides)
    return above.unionByName(below).unionByName(other)


@_query("filter_bool", "SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS cheap FROM lineitem WHERE l_discount > 0.05")
def _filter_bool(s, d):
    df = _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).alias("cheap"))
    return keep(df, compare(df, "cheap", "=", True))


# Aggregates.
_query("agg_sum_int", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")(lambda s, d: aggregate(_read(s, d, "lineitem"), [Agg("sum", "l_linenumber", "total")]))
_query("agg_sum_double", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")(lambda s, d: aggregate(_read(s, d, "lineitem"), [Agg("sum", "l_extendedprice", "total")]).select(F.round("total", 2).alias("total")))
_query("agg_avg_int", "SELECT round(avg(l_linenumber), 6) AS mean FROM lineitem")(lambda s, d: aggregate(_read(s, d, "lineitem"), [Agg("avg", "l_linenumber", "mean")]).select(F.round("mean", 6).alias("mean")))
_query("agg_avg_double", "SELECT round(avg(l_quantity), 6) AS mean FROM lineitem")(lambda s, d: aggregate(_read(s, d, "lineitem"), [Agg("avg", "l_quantity", "mean")]).select(F.round("mean", 6).alias("mean")))
_query("agg_min_max_int", "SELECT min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem")(lambda s, d: aggregate(_read(s, d, "lineitem"), [Agg("min", "l_linenumber", "low"), Agg("max", "l_linenumber", "high")]))
_query("agg_min_max_double", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")(lambda s, d: aggregate(_read(s, d, "orders"), [Agg("min", "o_totalprice", "low"), Agg("max", "o_totalprice", "high")]))
_query("agg_count_col", "SELECT count(value) AS n FROM events")(lambda s, d: aggregate(_read(s, d, "events"), [Agg("count", "value", "n")]))
_query("agg_count_star", "SELECT count(*) AS n FROM events")(lambda s, d: aggregate(_read(s, d, "events"), [Agg("count", "*", "n")]))
_query("agg_multi", "SELECT round(sum(value), 4) AS total, count(value) AS n, round(avg(value), 6) AS mean FROM events")(lambda s, d: aggregate(_read(s, d, "events"), [Agg("sum", "value", "total"), Agg("count", "value", "n"), Agg("avg", "value", "mean")]).select(F.round("total", 4).alias("total"), "n", F.round("mean", 6).alias("mean")))


@_query("agg_filtered", "SELECT count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE event_type = 'click'")
def _agg_filtered(s, d):
    df = _read(s, d, "events")
    return aggregate(keep(df, compare(df, "event_type", "=", "click")), [Agg("count", "*", "n"), Agg("min", "value", "low"), Agg("max", "value", "high")])


@_query("agg_empty_defaults", "SELECT coalesce(sum(value), 0) AS total, coalesce(avg(value), 0) AS mean, coalesce(min(value), 0) AS low, coalesce(max(value), 0) AS high, count(value) AS n FROM events WHERE false")
def _agg_empty(s, d):
    return aggregate(keep(_read(s, d, "events"), F.lit(False)), [Agg("sum", "value", "total"), Agg("avg", "value", "mean"), Agg("min", "value", "low"), Agg("max", "value", "high"), Agg("count", "value", "n")])


@_query("agg_max_skips_nan", "SELECT max(l_quantity) AS high, min(l_quantity) AS low FROM lineitem WHERE l_linenumber <> 1")
def _agg_nan(s, d):
    df = _read(s, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"))
    return aggregate(df, [Agg("max", "x", "high"), Agg("min", "x", "low")])


# Grouped aggregates.
_query("group_str_low", "SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY event_type")(lambda s, d: group(_read(s, d, "events"), ["event_type"], [Agg("sum", "value", "total")]).select("event_type", F.round("total", 4).alias("total")))
_query("group_int_high", "SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey")(lambda s, d: group(_read(s, d, "lineitem"), ["l_orderkey"], [Agg("sum", "l_quantity", "total")]))
_query("group_multi_key", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")(lambda s, d: group(_read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [Agg("sum", "l_quantity", "total"), Agg("count", "*", "n")]))
_query("group_float_key", "SELECT l_discount, count(*) AS n FROM lineitem GROUP BY l_discount")(lambda s, d: group(_read(s, d, "lineitem"), ["l_discount"], [Agg("count", "*", "n")]))
_query("group_bool_key", "SELECT l_discount > 0.05 AS cheap, count(*) AS n FROM lineitem GROUP BY 1")(lambda s, d: group(_read(s, d, "lineitem").select((F.col("l_discount") > 0.05).alias("cheap")), ["cheap"], [Agg("count", "*", "n")]))
_query("group_count_star", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: group(_read(s, d, "events"), ["event_type"], [Agg("count", "*", "n")]))
_query(
    "group_all_aggs", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(l_tax) AS n FROM lineitem GROUP BY l_returnflag"
)(lambda s, d: group(_read(s, d, "lineitem"), ["l_returnflag"], [Agg("sum", "l_linenumber", "total"), Agg("avg", "l_quantity", "mean"), Agg("min", "l_extendedprice", "low"), Agg("max", "l_extendedprice", "high"), Agg("count", "l_tax", "n")]).withColumn("mean", F.round("mean", 6)))


@_query("group_filtered", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE value > 50 GROUP BY event_type")
def _group_filtered(s, d):
    df = _read(s, d, "events")
    return group(keep(df, compare(df, "value", ">", 50)), ["event_type"], [Agg("count", "*", "n"), Agg("min", "value", "low"), Agg("max", "value", "high")])


_query("group_keys_only", "SELECT DISTINCT event_type FROM events")(lambda s, d: group(_read(s, d, "events"), ["event_type"]))


# Declared types.
@_query("typed_unsigned", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS SMALLINT) AS u8, CAST(l_quantity AS INTEGER) AS u16, CAST(l_partkey AS BIGINT) AS u32, CAST(l_orderkey AS DECIMAL(20,0)) AS u64 FROM lineitem")
def _typed(s, d):
    df = _read(s, d, "lineitem")
    kinds = [("l_linenumber", "u8", D.U8), ("l_quantity", "u16", D.U16), ("l_partkey", "u32", D.U32), ("l_orderkey", "u64", D.U64)]
    return df.select("l_orderkey", "l_linenumber", *(F.col(c).cast(t.spark).alias(n, metadata=field(n, t).metadata) for c, n, t in kinds))


@_query("sum_wrap_i8", "SELECT l_returnflag, CAST((((sum(l_linenumber) + 128) % 256 + 256) % 256) - 128 AS TINYINT) AS total FROM lineitem GROUP BY l_returnflag")
def _wrap8(s, d):
    df = _read(s, d, "lineitem").select("l_returnflag", F.col("l_linenumber").cast(D.I8.spark).alias("x", metadata=field("x", D.I8).metadata))
    return group(df, ["l_returnflag"], [Agg("sum", "x", "total", exact_width=True)])


@_query("sum_wrap_i32", "SELECT l_returnflag, CAST((((sum(CAST(l_partkey % 2000 AS HUGEINT) * 1000003) + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS INTEGER) AS total FROM lineitem GROUP BY l_returnflag")
def _wrap32(s, d):
    df = _read(s, d, "lineitem").select("l_returnflag", (F.col("l_partkey") % 2000 * 1000003).cast(D.I32.spark).alias("x", metadata=field("x", D.I32).metadata))
    return group(df, ["l_returnflag"], [Agg("sum", "x", "total", exact_width=True)])


# Sketches.
_query("topk_exact", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")(lambda s, d: sketches.top_k(_read(s, d, "events"), "user_id", 10))
_query("topk_approx", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")(lambda s, d: sketches.approx_top_k(_read(s, d, "events"), "event_type", 5))


@_query("cms_estimate", "SELECT user_id, count(*) AS n, true AS at_least, true AS near FROM events GROUP BY user_id")
def _cms(s, d):
    """Estimates are never under the count, and over it by 20 in 2,048 of all rows at most (the usual bound is e in 2,048, but for 1 in 148)."""
    df = _read(s, d, "events")
    true = df.groupBy("user_id").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("rows"))
    found = sketches.estimate(true, "user_id", sketches.count_min(df, "user_id")).crossJoin(F.broadcast(total))
    return found.select("user_id", "n", (F.col("estimate") >= F.col("n")).alias("at_least"), (F.col("estimate") <= F.col("n") + F.col("rows") * 20 / 2048 + 1).alias("near"))


# Logical codecs, in blocks of 1,024 event ids.
def _blocks(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "events").select(F.floor(F.col("event_id") / 1024).alias("block"), "event_id", "user_id", "event_type")


_BLOCKS = "(SELECT event_id // 1024 AS block, event_id, user_id, event_type FROM events)"


@_query("codec_delta", f"SELECT event_id, user_id - coalesce(lag(user_id) OVER (PARTITION BY block ORDER BY event_id), 0) AS delta, user_id AS value FROM {_BLOCKS}")
def _delta(s, d):
    coded = codecs.delta_encode(_blocks(s, d), "block", "event_id", "user_id")
    return codecs.delta_decode(coded, "block", "event_id").select("event_id", "delta", "value")


@_query("codec_rle", f"""SELECT block, row_number() OVER (PARTITION BY block ORDER BY island) - 1 AS run, any_value(event_type) AS value, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY block ORDER BY event_id) AS island FROM (
        SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY block ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM {_BLOCKS})) GROUP BY block, island""")
def _rle(s, d):
    return codecs.run_lengths(_blocks(s, d), "block", "event_id", "event_type")


@_query("codec_dict", f"""SELECT event_id, code FROM {_BLOCKS} JOIN (
    SELECT block, event_type, row_number() OVER (PARTITION BY block ORDER BY min(event_id)) - 1 AS code FROM {_BLOCKS} GROUP BY block, event_type) USING (block, event_type)""")
def _dict(s, d):
    return codecs.dictionary_encode(_blocks(s, d), "block", "event_id", "event_type")[0].select("event_id", "code")


@_query("codec_delta_decode", f"SELECT event_id, user_id AS value FROM {_BLOCKS}")
def _undelta(s, d):
    deltas = _blocks(s, d).select("block", "event_id", F.expr("user_id - coalesce(lag(user_id) OVER (PARTITION BY block ORDER BY event_id), 0)").alias("delta"))
    return codecs.delta_decode(deltas, "block", "event_id").select("event_id", "value")


@_query("codec_rle_decode", f"SELECT block, event_type AS value, count(*) AS n FROM {_BLOCKS} GROUP BY block, event_type")
def _unrle(s, d):
    back = codecs.run_lengths_decode(codecs.run_lengths(_blocks(s, d), "block", "event_id", "event_type"))
    return back.groupBy("block", "value").agg(F.count("*").alias("n"))


@_query("codec_dict_decode", "SELECT event_id, event_type AS value FROM events")
def _undict(s, d):
    coded, words = codecs.dictionary_encode(_blocks(s, d), "block", "event_id", "event_type")
    return codecs.dictionary_decode(coded.select("block", "event_id", "code"), words, "block").select("event_id", "value")


@_query("granule_zonemap", "SELECT CAST((rn - 1) // 512 AS BIGINT) AS granule, count(*) AS n_rows, min(event_id) AS min_event_id, max(event_id) AS max_event_id, min(value) AS min_value, max(value) AS max_value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def _zones(s, d):
    return zone_map(_read(s, d, "events"), "event_id", ["event_id", "value"])


@_query("granule_read", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) WHERE place // 512 IN (0, 3, 4)")
def _granules(s, d):
    df = _read(s, d, "events").select("event_id", "value")
    return read_granules(df, "event_id", zone_map(df, "event_id", ["event_id"]), [0, 3, 4])


# Inserts.
def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its nodes see")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


_EVENTS = TableDef("t", (("event_id", D.I64), ("user_id", D.U32), ("event_type", D.STR), ("value", D.F64)), (0,))


@_query("insert_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def _roundtrip(s, d):
    t = Table.create(s, _folder(s), _EVENTS)
    t.insert_frame(_read(s, d, "events").select("event_id", "user_id", "event_type", "value"))
    return Table.open(s, t.folder).scan()


@_query("insert_sorted_multipart", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def _multipart(s, d):
    t = Table.create(s, _folder(s), TableDef("t", (("k", D.I32), ("name", D.STR)), (0,)))
    t.insert_frame(_read(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    t.insert_frame(_read(s, d, "nation").select((F.col("n_nationkey") + 100).alias("k"), F.col("n_name").alias("name")))
    return t.scan()


@_query("insert_order_in_part", "SELECT row_number() OVER (ORDER BY n_regionkey, n_name) - 1 AS place, n_regionkey AS r, n_name AS name FROM nation")
def _order_in_part(s, d):
    """Where each row lies in its part: by the sort key, of two columns."""
    t = Table.create(s, _folder(s), TableDef("t", (("r", D.I32), ("name", D.STR)), (0, 1)))
    t.insert_frame(_read(s, d, "nation").select(F.col("n_regionkey").cast("int").alias("r"), F.col("n_name").alias("name")), parts=1)
    return s.read.schema(t.definition.spark).parquet(t.data).select(F.col("_metadata.row_index").alias("place"), "r", "name")


@_query("insert_parts", "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM region UNION ALL SELECT CAST(count(*) AS BIGINT) FROM nation")
def _parts(s, d):
    """The parts of a table, each with its rows."""
    t = Table.create(s, _folder(s), TableDef("t", (("k", D.I32), ("name", D.STR)), (0,)))
    for name, prefix in (("region", "r_region"), ("nation", "n_nation")):
        t.insert_frame(_read(s, d, name).select(F.col(f"{prefix}key").cast("int").alias("k"), F.col(f"{prefix[:2]}name").alias("name")), parts=1)
    return t.parts().select("n_rows")


# Statements.
def _engine(spark: SparkSession, sf: str, *tables: str) -> Engine:
    engine = Engine(spark)
    for t in tables:
        engine.register(t, _read(engine.spark, sf, t))
    return engine


def _statement(name: str, text: str, *tables: str, oracle: str | None = None) -> None:
    _query(name, oracle or text)(lambda s, d: _engine(s, d, *tables).sql(text))


_statement("sql_star", "SELECT * FROM nation", "nation")
_statement("sql_columns", "SELECT value, event_id AS id, value AS again FROM events", "events")
_statement("sql_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 AND NOT l_returnflag = 'N') OR 0.09 <= l_discount AND l_linestatus <> 'F'", "lineitem")
_statement("sql_aggregates", "SELECT COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high, COUNT(value) AS m FROM events WHERE event_type != 'click'", "events")
_statement("sql_default_names", "SELECT event_type, COUNT(*), MAX(value) FROM events GROUP BY event_type", "events", oracle='SELECT event_type, count(*) AS "count(*)", max(value) AS "max(value)" FROM events GROUP BY event_type')
_statement("sql_empty_defaults", "SELECT SUM(value) AS total, AVG(value) AS mean, MIN(user_id) AS low, MAX(value) AS high, COUNT(*) AS n FROM events WHERE event_id < -1", "events", oracle="SELECT 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean, 0::BIGINT AS low, 0.0::DOUBLE AS high, 0::BIGINT AS n")
_statement("sql_group_by", "SELECT SUM(l_linenumber) AS total, l_returnflag FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag, l_linestatus", "lineitem", oracle="SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, l_returnflag FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag, l_linestatus")
_statement("sql_order_offset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, 1 LIMIT 15 OFFSET 7", "orders")
_statement("sql_join", "SELECT n.n_name AS nation, count(*) AS customers FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "customer", "nation")
_statement("sql_left_join", "SELECT r.r_name AS region, c.c_custkey AS customer FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000", "region", "nation", "customer")
_statement("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
_statement("sql_cube", "SELECT l_returnflag, l_linestatus, max(l_quantity) AS most FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_statement("sql_having", "SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200", "lineitem")
_statement("sql_with", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey", "orders", "customer")
_statement("sql_over", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events", "events", oracle="SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS nth, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
_statement("sql_filter_clause", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) AS n FROM events GROUP BY event_type", "events")
_statement("sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")
_statement("sql_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region", "nation", "region")


@_query("sql_insert_values", "SELECT * FROM (VALUES (0, 1, 10, false, 'a'), (1, 2, 20, true, 'it''s'), (2, 3, 30, false, ''), (3, 3, 40, true, 'z'), (4, 5, 50, true, 'é')) AS t(place, ts, uid, ok, tag)")
def _insert_values(s, d):
    """Three inserts, rows out of order; equal keys keep their order within a part."""
    engine = Engine(s)
    t = Table.create(engine.spark, _folder(s), TableDef("t", (("ts", D.I64), ("uid", D.U32), ("ok", D.BOOL), ("tag", D.STR)), (0,)))
    engine.attach(t.folder)
    engine.sql("INSERT INTO t VALUES (3, 30, false, ''), (3, 40, true, 'z'), (1, 10, false, 'a')")
    engine.sql("INSERT INTO t (uid, ts, tag, ok) VALUES (20, 2, 'it''s', TRUE)")
    engine.sql("INSERT INTO t VALUES (5, 50, true, 'é');")
    rows = engine.spark.read.schema(t.definition.spark).parquet(t.data).select("ts", "uid", "ok", "tag", F.col("_metadata.row_index").alias("at"))
    first = F.when(F.col("ts").isin(1, 3), F.when(F.col("at") == 0, 0).otherwise(F.col("at") + 1)).when(F.col("ts") == 2, 1).otherwise(4)
    return rows.select(first.cast("int").alias("place"), F.col("ts").cast("int").alias("ts"), F.col("uid").cast("int").alias("uid"), "ok", "tag")


def _refused(engine: Engine, texts: dict[str, str]) -> DataFrame:
    """(case, refused) of some statements: whether they raise before anything runs."""
    out = []
    for case, text in texts.items():
        try:
            engine.sql(text)
            out.append((case, False))
        except ValueError:
            out.append((case, True))
    return engine.spark.createDataFrame(out, "case string, refused boolean")


_BAD_INSERTS = {
    "arity": "INSERT INTO t VALUES (1, 'a', 2)", "null": "INSERT INTO t VALUES (NULL, 'a')", "type": "INSERT INTO t VALUES ('x', 'a')", "range": "INSERT INTO t VALUES (300, 'a')",
    "column": "INSERT INTO t (k, other) VALUES (1, 'a')", "table": "INSERT INTO nowhere VALUES (1, 'a')", "one_bad_row": "INSERT INTO t VALUES (1, 'a'), (-1, 'b')",
}
_BAD_SELECTS = {
    "sum_of_string": "SELECT sum(n_name) FROM nation", "mixed": "SELECT n_name, count(*) FROM nation", "not_grouped": "SELECT n_name, count(*) FROM nation GROUP BY n_regionkey",
    "column": "SELECT other FROM nation", "table": "SELECT a FROM nowhere", "literal": "SELECT n_name FROM nation WHERE n_nationkey = 'x'", "two": "SELECT n_name FROM nation; SELECT n_name FROM nation", "open_quote": "SELECT 'a FROM nation",
}


def _all_refused(cases: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"case\", true AS refused" for c in cases)


@_query("insert_refusals", _all_refused(_BAD_INSERTS) + " UNION ALL SELECT 'rows_left', true")
def _insert_refusals(s, d):
    """Bad inserts are refused whole: no row is left of them."""
    engine = Engine(s)
    t = Table.create(engine.spark, _folder(s), TableDef("t", (("k", D.U8), ("name", D.STR)), (0,)))
    engine.attach(t.folder)
    refused = _refused(engine, _BAD_INSERTS)
    return refused.unionByName(t.scan().agg(F.lit("rows_left").alias("case"), (F.count("*") == 0).alias("refused")))


@_query("sql_refusals", _all_refused(_BAD_SELECTS))
def _select_refusals(s, d):
    return _refused(_engine(s, d, "nation"), _BAD_SELECTS)


# Clauses beyond the model: plain Spark semantics.
_query("having", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 100")(lambda s, d: group(_read(s, d, "events"), ["event_type"], [Agg("count", "*", "n")]).filter("n > 100"))
_query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda s, d: _read(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct())
_query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: _read(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20))
_query("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")(lambda s, d: _read(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users")))
_query("in_between_like", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority LIKE '%URGENT'")(lambda s, d: _read(s, d, "orders").filter("o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority LIKE '%URGENT'").select("o_orderkey"))
