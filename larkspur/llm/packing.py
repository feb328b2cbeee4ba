"""Best-fit packing under conflicts.

Documents are packed into bins of `capacity` bytes. Of two documents of one duplicate cluster only
one may be in a bin, and at most `per_source` of one source. In a group of documents, the longest
first, each goes to the bin with the least room that holds it and is compatible: bins are ordered by
room, and the search goes on from the tightest to its successors until one is compatible; else a
bin is opened. A bin carries two bitmaps, of the sources that are used up in it and of its clusters.

Groups are dealt by a hash of id, size, source and cluster and hold about `group_rows` documents, so
a frequent source or cluster is spread over all groups, and so are null and repeated ids unless all
of that is the same; only ids, sizes and marks are shuffled. At most one bin a group
is lost to the cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hash_of, lean

CAPACITY = 8192
PER_SOURCE = 2
GROUP_ROWS = 4096


@dataclass
class Bin:
    used_up: int = 0
    clusters: int = 0
    sources: dict | None = None


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """The bin of each (size, source, cluster), in the order given; source and cluster are numbered from 0, -1: none."""
    bins: list[Bin] = []
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    out = []
    for size, source, cluster in items:
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(room, (size, -1))
        while at < len(room) and (bins[room[at][1]].used_up & source_bit or bins[room[at][1]].clusters & cluster_bit):
            at += 1
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append(Bin(sources={}))
        b = bins[k]
        b.clusters |= cluster_bit
        if source >= 0:
            b.sources[source] = b.sources.get(source, 0) + 1
            if b.sources[source] >= per_source:
                b.used_up |= source_bit
        if left > size:
            insort(room, (left - size, k))
        out.append(k)
    return out


def text_cluster(text: Column) -> Column:
    """Texts that are equal but for case and white space are one cluster; an empty one is in none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, piece_start, piece_bytes, bin_id, bin_start): where each document's bytes go.

    Sizes are UTF-8 bytes. A text over the capacity fills bins of its own with pieces from its
    start, and its rest is packed like a document; every byte is in one piece. A null or empty text
    is a piece of no bytes. A null source or cluster conflicts with nothing; null ids are packed as
    one id. Repeated rows are packed each; they are one cluster. An empty table gives an empty one.
    Other columns are ignored. Bins of different groups have different ids.
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be 1 at least")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("size"), F.col(source).cast("string").alias("source"), (text_cluster(body) if cluster is None else cluster).alias("cluster"))
    groups = max(1, -(-docs.count() // group_rows))
    rows = rows.withColumn("group", F.pmod(F.xxhash64(*(hash_of(c) for c in ("doc_id", "size", "source", "cluster"))), F.lit(groups)).cast("int"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        group = key[0].as_py()
        got = sorted(zip(*(t.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster")), strict=True), key=lambda r: (-(r[1] % capacity or min(r[1], capacity)), r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or 0))
        shared: dict[int, int] = {}
        for r in got:
            shared[r[3]] = shared.get(r[3], 0) + 1
        number: dict[int, int] = {}
        for c, n in shared.items():
            if c is not None and n > 1:
                number[c] = len(number)
        sources: dict[str, int] = {}
        items = []
        for _, size, s, c in got:
            last = size % capacity or min(size, capacity)
            items.append((last, sources.setdefault(s, len(sources)) if s is not None else -1, number.get(c, -1)))
        place = best_fit(items, capacity, per_source)
        used, more = {}, max(place, default=-1) + 1
        out = []
        for (d, size, _, _), (last, _, _), k in zip(got, items, place, strict=True):
            full = (size - last) // capacity
            for i in range(full):
                out.append((d, i, i * capacity, capacity, (group << 32) + more, 0))
                more += 1
            out.append((d, full, size - last, last, (group << 32) + k, used.get(k, 0)))
            used[k] = used.get(k, 0) + last
        names = ["doc_id", "piece", "piece_start", "piece_bytes", "bin_id", "bin_start"]
        return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(names)})

    schema = "doc_id long, piece long, piece_start long, piece_bytes long, bin_id long, bin_start long"
    return rows.repartition(groups, "group").groupBy("group").applyInArrow(lean(run), schema)


def op8(docs: DataFrame) -> DataFrame:
    """`pack` into bins of CAPACITY bytes; odd rows are as there."""
    return pack(docs)
