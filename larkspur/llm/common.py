"""Scratch tables, blocks of documents and connected components, shared by the operators."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes see: spark.checkpoint.dir, or one of this machine where it is unset and the master is local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_larkspur_shared", None)
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its nodes see")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        sc._larkspur_shared = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `cleanup` knows it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made(spark).add(path)
    return path


def _made(spark: SparkSession) -> set[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_larkspur_scratch"):
        sc._larkspur_scratch = set()
    return sc._larkspur_scratch


def cleanup(spark: SparkSession) -> int:
    """Delete all scratch folders of this session that still lie there, once no result is read any more; returns how many."""
    paths = list(_made(spark))
    drop(spark, *paths)
    return len(paths)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system for a folder that Spark names, and the path in it. Hadoop's s3a and s3n are pyarrow's s3."""
    scheme, mark, rest = path.partition("://")
    return pa.fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def put(path: str, data: bytes) -> None:
    """Write a file whole or not at all: a task that runs twice leaves one file."""
    fs, at = file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


def get(path: str) -> bytes:
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        return f.read()


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _made(spark).discard(path)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def hash_of(col: Column | str) -> Column:
    """64-bit hash in which a null differs from every value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.xxhash64(F.coalesce(c.cast("string"), F.lit("\x00null")))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def block_count(total_bytes: int, block_bytes: int, least: int = 48) -> int:
    """Blocks of about block_bytes each: the number grows with the data, the memory of a task does not."""
    return max(least, -(-total_bytes // block_bytes))


def blocked(docs: DataFrame, n_blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, text), dealt by a hash of the id. Equal ids share a block; a null text is empty."""
    return docs.select(
        F.pmod(hash_of(doc_id), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


#: Ids that may be broadcast: some 50 MB in a task's hash table.
IDS = 2_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, doc_id: str = "doc_id") -> DataFrame:
    """docs with ("left_semi") or without ("left_anti") the ids of a table of one long column, distinct and not null.

    Up to IDS of them, which are counted first, go to all tasks, and no text is shuffled; more of
    them meet the documents by a shuffle.
    """
    (name,) = ids.columns
    few = ids.limit(IDS + 1).count() <= IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[doc_id] == F.col(name), how)


def release() -> None:
    """Give freed memory back to the system, so that a worker process that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_TRIM = _trim()


def lean(f):
    """A function of a group (key, table) or of two cogrouped ones that releases what it used."""

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        try:
            return f(key, t)
        finally:
            release()

    def two(key: tuple[pa.Scalar, ...], t: pa.Table, u: pa.Table) -> pa.Table:
        try:
            return f(key, t, u)
        finally:
            release()

    return one if len(inspect.signature(f).parameters) == 2 else two


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star steps, each written to the shared folder. A node's
    neighbours are only ever reduced to their minimum, never gathered. Nulls are ignored; an
    edge from a node to itself makes a component of one.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null").distinct()
    e, _ = materialize(e, "cc")
    alone = e.filter("u = v").select(F.col("u").alias("node"))
    trash, mark = [], None
    cur = e.filter("u <> v")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt, path = materialize(small.select("x.*").filter("u <> v").distinct(), "cc")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, *trash)
        trash, cur = [path], nxt
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    done = stars.unionByName(roots)
    return done.unionByName(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
