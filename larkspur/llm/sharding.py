"""Sharding: a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


PER_RACK, RACKS = 5, 2
#: Rows of a bucket of slots, about.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 64


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its region and rack, and its weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Region, rack and shard levels; a node weighs as much as its shards."""

    shards: tuple[Shard, ...]

    def children(self, region: int | None = None, rack: int | None = None) -> dict[int, float]:
        """Weights of the regions, of a region's racks, or of a rack's shards."""
        out: dict[int, float] = {}
        for s in self.shards:
            if region is not None and s.region != region or rack is not None and s.rack != rack:
                continue
            k = s.region if region is None else s.rack if rack is None else s.shard
            out[k] = out.get(k, 0.0) + s.weight
        return {k: w for k, w in out.items() if w > 0}

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(Shard(s.region, s.rack, s.shard, weight) if s.shard == shard else s for s in self.shards))

    def grown(self, per_rack: int = PER_RACK, racks: int = RACKS) -> Tree:
        """One more shard at the next place of `layout`: layout(n).grown() is layout(n + 1)."""
        return Tree((*self.shards, _at(max((s.shard for s in self.shards), default=-1) + 1, per_rack, racks)))


def _at(shard: int, per_rack: int, racks: int) -> Shard:
    return Shard(shard // (per_rack * racks), shard // per_rack, shard)


def layout(shards: int, per_rack: int = PER_RACK, racks: int = RACKS) -> Tree:
    """Equal shards in racks of per_rack, and regions of so many racks; a function of the number alone."""
    return Tree(tuple(_at(s, per_rack, racks) for s in range(shards)))


def _number(text: Column) -> Column:
    """52 bits of a text's MD5: a hash that other SQL engines have too."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("long")


def _draw(key: Column, shard: Shard) -> Column:
    """A shard's weighted draw: exponential with its weight as rate. The least of a node's children's draws is the node's."""
    return -F.log((_number(F.concat_ws(":", key, F.lit(str(shard.shard)))) + 0.5) / float(1 << 52)) / shard.weight


def _least(draws: list[tuple[Column, Column]]) -> Column:
    """(draw, child) with the least draw; ties go to the smaller child."""
    return F.array_min(F.array(*(F.struct(d.alias("draw"), c.alias("child")) for d, c in draws)))


def key_of(key: Column | str) -> Column:
    """The key as text; a null is a key of its own."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(c.cast("string"), F.lit("null"))


def assign(df: DataFrame, key: Column | str, **trees: Tree) -> DataFrame:
    """df with the shard of each row in one column a tree, by weighted draws that descend region, rack and shard.

    A rack draws the least of its shards' draws, a region the least of its racks', and the descent
    takes the child with the least draw at each level. A node's draw is exponential with its weight
    as rate, so regions, racks and shards get rows by their weights. A row's shard depends on its key
    and the tree only: a shard that is new or gets heavier only takes rows and one that gets lighter
    only gives them, to or from any other; no row moves between two shards whose weights stay. Shards
    that trees share are drawn once. Null keys count as one key. An empty table gives an empty one;
    repeated rows go together.
    """
    shards = sorted({(s.shard, s.weight): s for t in trees.values() for s in t.shards if s.weight > 0}.items())
    for to, tree in trees.items():
        if not tree.children():
            raise ValueError(f"no shard of {to} has weight")
    cols, draws = df.columns, "__draws"
    drawn = df.withColumn(draws, F.array(*(_draw(key_of(key), s) for _, s in shards)))
    place = {k: i for i, (k, _) in enumerate(shards)}

    def descent(tree: Tree) -> Column:
        regions = []
        for region in tree.children():
            racks = []
            for rack in tree.children(region):
                own = [s for s in tree.shards if s.region == region and s.rack == rack and s.weight > 0]
                least = _least([(F.get(draws, F.lit(place[s.shard, s.weight])), F.lit(s.shard)) for s in own])
                racks.append((least["draw"], least["child"]))
            # Each level hands up its least draw with the shard below it.
            least = _least(racks)
            regions.append((least["draw"], least["child"]))
        return _least(regions)["child"].cast("int")

    return drawn.select(*cols, *(descent(t).alias(to) for to, t in trees.items()))


def slots(df: DataFrame, shard: str, key: str, *more: str, buckets: int | None = None) -> DataFrame:
    """df with slot, the gapless place of each row in its shard, from 0.

    A shard is numbered in buckets of about BUCKET_ROWS rows, by a hash of the key and `more`, so
    that no task holds a whole shard, nor all rows of a key that differ in `more`. Counts of the
    buckets give each bucket its first slot. Order in a bucket: the key, nulls first, then `more`.
    """
    n_shards = df.select(shard).distinct().count() if buckets is None else 1
    buckets = buckets or max(LEAST_BUCKETS, -(-df.count() // (BUCKET_ROWS * max(1, n_shards))))
    keyed = df.withColumn("__bucket", F.pmod(_number(F.concat_ws(":", key_of(key), *(key_of(c) for c in more))), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = W.partitionBy(shard).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("__shard"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    numbered = keyed.withColumn("__row", F.row_number().over(W.partitionBy(shard, "__bucket").orderBy(F.col(key).asc_nulls_first(), *more)))
    joined = numbered.join(first, (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__b")))
    return joined.select(*df.columns, (F.col("__first") + F.col("__row") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) of every document.

    size is the UTF-8 bytes of the text plus 16. A null text counts as empty, with CRC 0; a null
    id is a key of its own. Other columns are ignored, whatever their names.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    rows = assign(rows, "doc_id", shard=tree, grown_shard=tree.grown())
    return slots(rows, "shard", "doc_id", "text_crc32", "size", buckets=max(LEAST_BUCKETS, -(-docs.count() // (BUCKET_ROWS * len(tree.shards)))))


def op1(docs: DataFrame, shards: int = 40) -> DataFrame:
    """`shard_documents` over `layout(shards)`, under the law `key`: grown_shard is the shard among one more.

    Odd rows are as there: null texts are empty, null ids one key, repeated rows each returned.
    """
    out = shard_documents(docs, layout(shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same over documents for 40 shards and fewer than LEAST_BUCKETS * BUCKET_ROWS rows a shard. The CRC is of a byte at a time.
OP1_SQL = """
WITH RECURSIVE step AS (
    SELECT range AS i, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY i) AS crcs FROM step WHERE k = 8
), rows AS (
    SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS body FROM documents
), made AS (
    SELECT doc_id, key, octet_length(body) + 16 AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(body)), lambda j: ('0x' || substr(hex(body), 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS text_crc32
    FROM rows, crc
), drawn AS (
    SELECT *, list_transform(range(41), lambda s: ('0x' || substr(md5(key || ':' || s), 1, 13))::BIGINT) AS draws,
        ('0x' || substr(md5(key || ':' || text_crc32 || ':' || size), 1, 13))::BIGINT % 64 AS bucket
    FROM made
), dealt AS (
    SELECT *, CAST(list_position(draws, list_max(draws[1:40])) - 1 AS INTEGER) AS shard, CAST(list_position(draws, list_max(draws)) - 1 AS INTEGER) AS grown_shard FROM drawn
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM dealt
"""
