"""Embedding near-dedup: collision-counting projections.

Many one-dimensional random projections place the vectors on as many lines. Two vectors collide on
a line if the window centred on the one holds the other. Pairs that collide on at least `need` of
LINES lines pass; `need` is the largest count that a pair at the threshold reaches with the wanted
probability. Windows alone don't thin out pairs: a line's window holds a third of all vectors, so
counting over whole lines is quadratic. Each table therefore first cuts the vectors into cells by
the signs of `signs` further projections, about CELL vectors a cell, and windows are counted in
cells; there are as many tables as give a pair at the threshold a common cell with the wanted
probability. Both probabilities together make the recall.

1. Ids only: a task of vectors deals (id, all signs, places on the lines as one byte each) to the
   tables, packed. Each cell finds the vectors that have a passing pair there, in the first table
   that the pair shares.
2. The vectors of those, and only those, are dealt to their cells; a cell verifies its pairs in
   double precision, by one product of matrices. It gives each vector's number of links, and links
   that connect what is connected: no list of pairs is made.

Equal vectors are one vector. A cell with more than FULL vectors, and over one in SHARE of all, skips
the first step: there are fewer than SHARE such cells a table, and all their vectors are verified. A
cell with more than `chunk` vectors to verify is cut into shares of about that size, and each pair of
shares is a group of its own: a task holds two shares, however full the cell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import connected_components, drop, lean, materialize, release

LINES, FIRST = 32, 12
#: Half a window in standard deviations of the difference of a pair at the threshold.
WIDTH = 2.0
#: Steps of a line's unit; a place is one byte.
STEPS = 24
CELL = 128
#: Rows of a group of packed cells.
GROUP_ROWS = 8192
FULL, SHARE = 16_384, 10_000


def _at_least(n: int, p: float, need: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(need, n + 1))


def _need(n: int, p: float, sure: float) -> int:
    """The largest count that n trials reach with the wanted probability."""
    return max(k for k in range(n + 1) if _at_least(n, p, k) >= sure)


@dataclass(frozen=True)
class Plan:
    """Tables of cells and windows for vectors of one length."""

    signs: int
    tables: int
    window: int
    first: int
    need: int

    @staticmethod
    def of(rows: int, cosine: float, recall: float, cell: int = CELL) -> Plan:
        """A tenth of what may be missed is left to each of the two window counts, the rest to the tables."""
        signs = min(31, max(2, math.ceil(math.log2(max(rows, 1) / cell))))
        miss, hit = 1 - recall, math.erf(WIDTH / math.sqrt(2))
        same = (1 - math.acos(cosine) / math.pi) ** signs
        tables = max(1, math.ceil(math.log(0.8 * miss) / math.log(1 - same)))
        window = math.ceil(WIDTH * math.sqrt(2 - 2 * cosine) * STEPS) + 1  # and one step for rounding
        return Plan(signs, tables, window, _need(FIRST, hit, 1 - 0.1 * miss), _need(LINES, hit, 1 - 0.1 * miss))


@lru_cache(maxsize=4)
def _directions(size: int, signs: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([size, signs, tables])
    return rng.standard_normal((signs * tables, size)), rng.standard_normal((LINES, size))


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """The vectors of one length as rows of length 1, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _signs(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """Each vector's cell in each table."""
    planes, _ = _directions(unit.shape[1], plan.signs, plan.tables)
    bits = (unit @ planes.T >= 0).reshape(len(unit), plan.tables, plan.signs)
    return (bits @ (1 << np.arange(plan.signs, dtype=np.int64))).astype("<u4")


def _places(unit: np.ndarray, plan: Plan) -> np.ndarray:
    _, lines = _directions(unit.shape[1], plan.signs, plan.tables)
    return np.clip(np.rint(unit @ lines.T * STEPS), -127, 127).astype(np.int8)


def _passing(places: np.ndarray, plan: Plan, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, that collide on enough lines."""
    wide = places.astype(np.int16)
    few = np.ascontiguousarray(wide[:, :FIRST].T)
    for lo in range(0, len(wide), step):
        count = np.zeros((min(step, len(wide) - lo), len(wide) - lo), np.int8)
        for line in few:
            count += np.abs(line[lo : lo + step, None] - line[None, lo:]) <= plan.window
        i, j = np.nonzero(count >= plan.first)
        i, j = i[i < j] + lo, j[i < j] + lo
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = (np.abs(wide[a] - wide[b]) <= plan.window).sum(axis=1) >= plan.need
            yield a[ok], b[ok]


def _first(cells: np.ndarray, table: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs share no cell of an earlier table."""
    return ~(cells[i, :table] == cells[j, :table]).any(axis=1) if table else np.ones(len(i), bool)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, vec_id: str = "vec_id", embedding: str = "embedding", chunk: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors of equal length are linked if they are found and their cosine in double precision
    is at least `cosine`. Vectors that are null, empty, zero or hold null or non-finite components
    are linked with nothing. Rows with a null id are returned unlinked, with a null component, not
    kept. Repeated rows count as vectors of their own, with links to each other; one id given to
    several vectors is one node. An empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    element = vectors.schema[embedding].dataType
    kind = "<f4" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))

    def pack(batches):
        for b in batches:
            body = []
            for x in b.column("e").to_pylist():
                a = np.array(x, dtype=kind) + 0 if x and None not in x else None  # -0.0 is 0.0
                body.append(a.tobytes() if a is not None and np.isfinite(a).all() and a.any() else None)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "raw": pa.array(body, pa.binary())})
        release()

    packed, at_packed = materialize(rows.mapInArrow(pack, "vec_id long, raw binary").withColumn("name", F.when(F.col("raw").isNotNull() & F.col("vec_id").isNotNull(), F.unhex(F.md5("raw")))), "vectors")
    # Vectors with equal names are equal: MD5 of their bytes.
    good = packed.filter("name is not null").groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    distinct, at_distinct = materialize(good, "vectors")
    n = distinct.count()
    plan, item = Plan.of(n, cosine, recall), np.dtype(kind).itemsize
    buckets = max(1, -(-n // GROUP_ROWS))

    def by_size(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes, keys, vectors) of each length in a batch."""
        raw, keys = b.column("raw").to_pylist(), b.column("key").to_numpy(zero_copy_only=False)
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            yield int(size), keys[mine], _units([raw[i] for i in mine], kind)

    def fill(batches):
        for b in batches:
            for size, _, unit in by_size(b):
                cells = _signs(unit, plan)
                for t in range(plan.tables):
                    cell, n = np.unique(cells[:, t], return_counts=True)
                    yield pa.record_batch([pa.array([size] * len(n), pa.int32()), pa.array([t] * len(n), pa.int32()), pa.array(cell.astype(np.int64)), pa.array(n)], ["size", "table", "cell", "n"])
        release()

    keyed = distinct.select(F.xxhash64("name").alias("key"), "raw")
    filled = keyed.mapInArrow(fill, "size int, table int, cell long, n long").groupBy("size", "table", "cell").agg(F.sum("n").alias("n"))
    full: dict[tuple[int, int], np.ndarray] = {}
    for r in filled.filter(F.col("n") > max(FULL, n // SHARE)).collect():
        full[r["size"], r.table] = np.append(full.get((r["size"], r.table), np.zeros(0, np.uint32)), np.uint32(r.cell))

    def members(batches):
        for b in batches:
            for size, keys, unit in by_size(b):
                cells = _signs(unit, plan)
                for t in range(plan.tables):
                    at = np.flatnonzero(np.isin(cells[:, t], full.get((size, t), [])))
                    yield pa.record_batch([pa.array([size] * len(at), pa.int32()), pa.array([t] * len(at), pa.int32()), pa.array(cells[at, t].astype(np.int64)), pa.array(keys[at])], ["size", "table", "cell", "want"])
        release()

    def deal(batches):
        for b in batches:
            for size, keys, unit in by_size(b):
                cells, places = _signs(unit, plan), _places(unit, plan)
                out = []
                for t in range(plan.tables):
                    mine = np.flatnonzero(~np.isin(cells[:, t], full.get((size, t), [])))
                    bucket = (cells[mine, t] * np.uint32(2654435761)) % buckets
                    order = mine[np.argsort(bucket, kind="stable")]
                    bucket = np.sort(bucket)
                    for k, part in zip(*(((bucket[turn := np.append(0, np.flatnonzero(np.diff(bucket)) + 1)], np.split(order, turn[1:])) if len(order) else ((), ()))), strict=True):
                        out.append((size, t, int(k), keys[part].astype("<i8").tobytes(), cells[part].tobytes(), places[part].tobytes()))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["size", "table", "bucket", "keys", "cells", "places"])
        release()

    def find(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        table = key[1].as_py()
        whole = lambda name, k, width: np.frombuffer(b"".join(x.as_py() for x in t.column(name)), k).reshape(-1, width)
        keys, cells, places = whole("keys", "<i8", 1).ravel(), whole("cells", "<u4", plan.tables), whole("places", np.int8, LINES)
        order = np.lexsort((keys, cells[:, table]))
        keys, cells, places = keys[order], cells[order], places[order]
        wanted = np.zeros(len(keys), bool)
        edge = np.append(np.flatnonzero(np.append(True, cells[1:, table] != cells[:-1, table])), len(keys))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            for i, j in _passing(places[lo:hi], plan) if hi - lo > 1 else ():
                new = _first(cells[lo:hi], table, i, j)
                wanted[lo + i[new]] = True
                wanted[lo + j[new]] = True
        at = np.flatnonzero(wanted)
        return pa.table({"size": pa.array([key[0].as_py()] * len(at), pa.int32()), "table": pa.array([table] * len(at), pa.int32()), "cell": pa.array(cells[at, table].astype(np.int64)), "want": pa.array(keys[at])})

    dealt = keyed.mapInArrow(deal, "size int, table int, bucket int, keys binary, cells binary, places binary")
    schema = "size int, table int, cell long, want long"
    passing = dealt.groupBy("size", "table", "bucket").applyInArrow(lean(find), schema)
    wanted, at_wanted = materialize(passing.unionByName(keyed.mapInArrow(members, schema)) if full else passing, "wanted")
    where = ["size", "table", "cell"]
    counts = wanted.groupBy(*where).agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    parts = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    shares = wanted.join(counts, where, "left").withColumn("share", F.pmod(F.xxhash64("want"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    shares = shares.select(*where, F.least("share", "other").alias("low"), F.greatest("share", "other").alias("high"), "share", "want")
    # Vectors go to the cells that want them; two with one key, if ever, are told apart by their cells.
    sent = shares.join(distinct.select(F.xxhash64("name").alias("key"), "rep", "copies", "raw"), (F.col("want") == F.col("key")) & (F.octet_length("raw") == F.col("size"))).drop("want", "key")

    def verify(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        table, cell, low, high = (k.as_py() for k in key[1:])
        raw, rep, copies, share = t.column("raw").to_pylist(), t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("share").to_numpy()
        unit = _units(raw, kind)
        cells = _signs(unit, plan)
        keep = np.flatnonzero(cells[:, table] == cell)
        keep = keep[np.lexsort(([raw[i] for i in keep], rep[keep]))] if len(keep) else keep
        unit, cells, rep, copies, share = unit[keep], cells[keep], rep[keep], copies[keep], share[keep]
        links, edges, label = np.zeros(len(rep), np.int64), [], np.arange(len(rep))
        for lo in range(0, len(rep), 256):
            a = slice(lo, lo + 256)
            x, y = np.nonzero(unit[a] @ unit[lo:].T >= cosine - 1e-9)
            x, y = x[x < y] + lo, y[x < y] + lo
            ok = (np.minimum(share[x], share[y]) == low) & (np.maximum(share[x], share[y]) == high)
            x, y = x[ok], y[ok]
            for k in range(0, len(x), 1 << 15):  # few at a time: a cell may be one class
                i, j = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                ok = _first(cells, table, i, j)
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                i, j = i[ok], j[ok]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                apart = np.flatnonzero(label[i] != label[j])
                while len(apart):  # one link joins two labels; the others between them say nothing new
                    a1, b1 = i[apart[0]], j[apart[0]]
                    edges.append((int(rep[a1]), int(rep[b1])))
                    new, old = sorted((label[a1], label[b1]))
                    label[label == old] = new
                    apart = apart[label[i[apart]] != label[j[apart]]]
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array([e[0] for e in edges] + [None] * len(some), pa.int64()), "b": pa.array([e[1] for e in edges] + [None] * len(some), pa.int64()), "name": pa.array([None] * len(edges) + [hashlib.md5(raw[keep[i]]).digest() for i in some], pa.binary()), "links": pa.array([None] * len(edges) + links[some].tolist(), pa.int64())})

    found, at_found = materialize(sent.groupBy(*where, "low", "high").applyInArrow(lean(verify), "a long, b long, name binary, links long"), "links")
    degree = found.filter("name is not null").groupBy(F.col("name").alias("linked")).agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("name is null").select("a", "b"))
    full = distinct.select("name", "rep", "copies").join(degree, F.col("name") == F.col("linked"), "left").join(component, F.col("rep") == F.col("node"), "left")
    full = full.select(F.col("name").alias("known"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out, _ = materialize(packed.select("vec_id", "name").join(full, F.col("name") == F.col("known"), "left"), "near")
    drop(spark, at_packed, at_distinct, at_wanted, at_found)
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def op9(vectors: DataFrame) -> DataFrame:
    """`near_vectors` at cosine 0.95; odd rows are as there."""
    return near_vectors(vectors)


#: All pairs of embeddings, for a small table; the query may miss one in 200 of the links at the threshold.
OP9_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
    SELECT row_number() OVER () AS row, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
    WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.row <> b.row AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= 0.95 * a.norm * b.norm
), reached AS (
    SELECT DISTINCT a AS vec_id, a AS other FROM links
    UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), degree AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id, coalesce(coalesce(l.component_id, e.vec_id) = e.vec_id, false) AS kept
FROM embeddings e LEFT JOIN least l ON l.vec_id = e.vec_id LEFT JOIN degree d ON d.vec_id = e.vec_id
"""
