"""N-gram Jaccard join: an exact metric-space join of documents' shingle sets.

Pivots are documents. Random pivots don't separate texts: nearly all pairs are at distance 1, and
every window would hold every document. So which documents can lie near a pivot comes from shingles:
two sets within the threshold share one of their first n - ceil(t n) + 1 shingles in one order for
all, the rarest first. Of the documents that share such a shingle the one with the smallest id is a
pivot for the others; sets without a shared one have no partner and leave. This makes few regions:

1. Every document of a region is measured against the pivot, where the document is: a pivot's set is
   sent to the blocks that hold such documents, once a block. Those within the threshold are linked.
2. What lies beyond it stays in the region, and by the triangle inequality only those linked
   documents that are at most the threshold nearer to the pivot are replicated there, as boundary.
   Regions whose documents are connected already vanish. The sets of the others are joined in the
   region: each set in turn is a pivot for those in its size window.
3. A region of over `local` sets is split again: a few documents of it are pivots for all of it, in
   chunks. What a pivot has linked leaves but for the boundary of what it has not, and the rest is
   joined recursively; after ROUNDS of that, by chunks.

Equal sets of a block of documents are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import exchange as X
from larkspur.llm import hashing as H
from larkspur.llm.common import block_count, blocked, by_ids, connected_components, drop, hash_of, lean, materialize, scratch, text_bytes, union_all

U = np.uint64
PIVOTS = 8
ROUNDS = 8
#: Blocks that one task sends a pivot to.
ASKERS = 4096


def shingle_sets(raw: list[bytes], n: int, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text, as 64-bit hashes; A-Z count as a-z."""
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) < chunk:
            size += len(raw[hi]) + 1
            hi += 1
        yield from _sets(raw[lo:hi], n)
        lo = hi


def _sets(raw: list[bytes], n: int) -> Iterator[np.ndarray]:
    buf = H.LOWER[np.frombuffer(b"\n".join(raw), dtype=np.uint8)]
    starts, ends = H.word_spans(buf)
    words = H.word_hashes(buf, starts, ends)
    edges = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(edges, starts, side="right")
    per = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(per) - per
    out = H.shingle_hashes(words, n) if len(words) >= n else np.zeros(0, U)
    for a, k in zip(first.tolist(), per.tolist(), strict=True):
        if k < n:
            yield H.shingle_hashes(words[a : a + k], n) if k else words[:0]
            continue
        mine = np.sort(out[a : a + k - n + 1])  # runs of n words that begin and end in the text
        new = np.ones(len(mine), bool)
        np.not_equal(mine[1:], mine[:-1], out=new[1:])
        yield mine[new]


class _Block:
    """Documents of a block, and their distinct non-empty sets, each with its smallest document."""

    def __init__(self, t: pa.Table, n: int):
        ids, texts = t.column("doc_id").to_pylist(), [x.encode() for x in t.column("text").to_pylist()]
        self.docs: list[tuple[int | None, int, int]] = []  # id, size, index of the set
        index: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        reps: list[int] = []
        for i, s in zip(ids, shingle_sets(texts, n), strict=True):
            k = -1
            if len(s) and i is not None:
                k = index.setdefault(s.tobytes(), len(self.sets))
                if k == len(self.sets):
                    self.sets.append(s)
                    reps.append(i)
                reps[k] = min(reps[k], i)
            self.docs.append((i, len(s), k))
        del index
        self.reps = np.array(reps, np.int64)
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.flat = np.concatenate(self.sets) if self.sets else np.zeros(0, U)
        self.keys, self.back, self.counts = np.unique(self.flat, return_inverse=True, return_counts=True)

    def prefix(self, replies: pa.Table, bits: int, num: int, den: int) -> None:
        """held: the keys that are shared and among the first of a set; key, owner: each of them in each such set."""
        rarity = np.zeros(len(self.keys), np.uint8)
        got = {k: data for kind, k, data in X.rows(replies, "kind", "bucket", "data") if kind == "rarity"}
        for k, lo, hi in X.split(self.keys, bits):
            rarity[lo:hi] = np.frombuffer(got[k], np.uint8)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        shared = np.flatnonzero(rarity[self.back] > 0)  # what is one document's only comes first and is not needed
        order = shared[np.lexsort((self.flat[shared], rarity[self.back[shared]], owner[shared]))]
        per = np.bincount(owner[shared], minlength=len(self.size))
        place = np.arange(len(order)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.size - per, per)
        first = self.size - -(-self.size * num // den) + 1
        pick = order[place < first[owner[order]]]
        self.held, self.key = np.unique(self.back[pick], return_inverse=True)
        self.owner = owner[pick]

    def pivots(self, replies: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(set, pivot) of each set and the other documents that are pivots for it, by pivot."""
        lead = np.zeros(len(self.held), np.int64)
        got = {k: data for kind, k, data in X.rows(replies, "kind", "bucket", "data") if kind == "leader"}
        for k, lo, hi in X.split(self.keys[self.held], bits):
            lead[lo:hi] = np.frombuffer(got[k], np.int64)
        both = np.unique(np.stack([lead[self.key], self.owner]), axis=1)
        both = both[:, both[0] != self.reps[both[1]]] if both.size else both
        return both[1], both[0]


def _shared(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set shares with the pivot's."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.bincount(owner[pivot[at] == flat], minlength=len(sets))


class _Labels:
    """Connected sets of a few nodes."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == max(x, y)] = min(x, y)
        return True


def _joined(sets: list[np.ndarray], num: int, den: int, labels: _Labels) -> Iterator[tuple[int, int]]:
    """Links between sets, as many as connect what is connected; labels: what already is."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), size[order])
    ids, back = np.unique(flat, return_inverse=True)
    by = np.argsort(back, kind="stable")
    posting, edge = owner[by], np.append(0, np.cumsum(np.bincount(back, minlength=len(ids))))
    first = np.append(0, np.cumsum(size[order]))
    size = size[order]
    ends = np.searchsorted(size * num, size * den, side="right")
    for x in range(len(order)):
        window = slice(x + 1, ends[x])
        if x + 1 >= ends[x] or (labels.of[order[window]] == labels.of[order[x]]).all():
            continue
        mine = back[first[x] : first[x + 1]]
        lo, n = edge[mine], edge[mine + 1] - edge[mine]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(order))[window]
        for y in np.flatnonzero(den * both >= num * (size[x] + size[window] - both)) + x + 1:
            if labels.join(order[x], order[y]):
                yield int(order[x]), int(order[y])


def _edge_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _unpacked(t: pa.Table, name: str = "shingles") -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=U) for x in t.column(name)]


def _local_links(num: int, den: int):
    def link(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        reps, main = t.column("rep").to_pylist(), t.column("main").to_pylist()
        labels, seen = _Labels(len(reps)), {}
        for i, m in enumerate(main):
            if m is not None and labels.of[i] != (j := seen.setdefault(m, i)):
                labels.join(i, j)
        return _edge_table([(reps[a], reps[b]) for a, b in _joined(_unpacked(t), num, den, labels)])

    return link


def _large(rows: DataFrame, num: int, den: int, local: int, done: list[DataFrame], trash: list[str]) -> DataFrame:
    """Links to pivots of clusters over `local`, added to done; returns what is small enough for a local join."""
    ready: list[DataFrame] = []
    cur, limit = rows.withColumn("main", F.lit(None).cast("long")), 1 - num / den
    for step in range(ROUNDS + 1):
        sizes = cur.groupBy("cluster").agg(F.count("*").alias("members"))
        cur = cur.join(sizes, "cluster")
        ready.append(cur.filter(F.col("members") <= local).select("cluster", "rep", "shingles", "main"))
        big, path = materialize(cur.filter(F.col("members") > local), "cluster")
        trash.append(path)
        if not big.take(1):
            break
        parts = F.ceil(F.col("members") / local).cast("int")
        draw = F.xxhash64("rep", F.lit(step))
        chunk = big.withColumn("part", F.pmod(F.xxhash64("rep", F.lit("part")), parts).cast("int"))
        if step == ROUNDS:  # clusters that pivots don't thin out: all pairs of chunks, without emitting pairs
            two = chunk.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(F.xxhash64("cluster", F.least("part", "other"), F.greatest("part", "other")).alias("cluster"), "rep", "shingles", "main")
            ready.append(two)
            break
        free = big.filter("main is null").groupBy("cluster", F.pmod(draw, F.lit(PIVOTS)).alias("j")).agg(F.min(F.struct(draw.alias("d"), "rep", "shingles")).alias("p"), F.max("members").alias("members"))
        pivots = free.select("cluster", "j", F.col("p.rep").alias("rep"), F.col("p.shingles").alias("shingles"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

        def measure(key: tuple[pa.Scalar, ...], t: pa.Table, p: pa.Table) -> pa.Table:
            reps = t.column("rep").to_pylist()
            sets, marks = _unpacked(t), p.column("rep").to_pylist()
            size = np.array([len(s) for s in sets], dtype=np.int64)
            flat, owner = np.concatenate(sets) if sets else np.zeros(0, U), np.repeat(np.arange(len(sets)), size)
            far = np.full((len(reps), PIVOTS), 2.0)
            mask, rest = np.zeros(len(reps), np.int64), np.zeros(len(reps), bool)
            out: list[tuple[int, int]] = []
            for mark, j, s in zip(marks, p.column("j").to_pylist(), _unpacked(p), strict=True):
                at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
                both = np.bincount(owner[s[at] == flat], minlength=len(reps))
                union = size + len(s) - both
                far[:, j] = 1 - both / union
                link = den * both >= num * union
                mask |= link.astype(np.int64) << j
                rest |= np.array([r == mark for r in reps])
                out += [(reps[i], mark) for i in np.flatnonzero(link)]
            cols = {"kind": pa.array(["m"] * len(reps) + ["e"] * len(out)), "cluster": pa.array(t.column("cluster").to_pylist() + [None] * len(out), pa.int64()), "rep": pa.array(reps + [a for a, _ in out], pa.int64()), "b": pa.array([None] * len(reps) + [b for _, b in out], pa.int64()), "mask": pa.array([*mask.tolist(), *[None] * len(out)], pa.int64()), "used": pa.array([*rest.tolist(), *[None] * len(out)], pa.bool_()), "far": pa.array(far.tolist() + [None] * len(out), pa.list_(pa.float64()))}
            cols |= {"shingles": pa.array(t.column("shingles").to_pylist() + [None] * len(out), pa.binary()), "main": pa.array(t.column("main").to_pylist() + [None] * len(out), pa.int64())}
            return pa.table(cols)

        told = chunk.select("cluster", "part", "rep", "shingles", "main").groupBy("cluster", "part").cogroup(pivots.groupBy("cluster", "part")).applyInArrow(lean(measure), "kind string, cluster long, rep long, b long, mask long, used boolean, far array<double>, shingles binary, main long")
        told, path = materialize(told, "pivots")
        trash.append(path)
        done.append(told.filter("kind = 'e'").select(F.col("rep").alias("a"), "b"))
        member = told.filter("kind = 'm'")
        masks = member.groupBy("cluster", F.col("main").isNotNull().alias("old"), "mask").agg(F.count("*").alias("n"))

        def largest(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            labels, weight = _Labels(PIVOTS + 1), np.zeros(PIVOTS + 1, np.int64)
            held = [([j for j in range(PIVOTS) if m >> j & 1] + [PIVOTS] * o, n) for o, m, n in zip(t.column("old").to_pylist(), t.column("mask").to_pylist(), t.column("n").to_pylist(), strict=True)]
            for js, _ in held:
                for j in js[1:]:
                    labels.join(js[0], j)
            for js, n in held:
                if js:
                    weight[labels.of[js[0]]] += n
            best = labels.of[PIVOTS] if any(t.column("old").to_pylist()) else int(np.argmax(weight))
            bits = [j for j in range(PIVOTS) if labels.of[j] == best and weight[best]]
            return pa.table({"cluster": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([sum(1 << j for j in bits)], pa.int64())})

        # The main set of a cluster is linked throughout: what its largest pivots hold, and from then on what they reach.
        main = masks.groupBy("cluster").applyInArrow(largest, "cluster long, bits long")
        member = member.join(main, "cluster").withColumn("in", (F.col("mask").bitwiseAND(F.col("bits")) != 0) | F.col("main").isNotNull())
        left = member.filter("not used")
        box = left.filter("not in").groupBy("cluster").agg(*(f(F.col("far")[j]).alias(f"{n}{j}") for j in range(PIVOTS) for n, f in (("lo", F.min), ("hi", F.max))))
        near = F.lit(True)
        for j in range(PIVOTS):
            near = near & F.col("far")[j].between(F.col(f"lo{j}") - limit - 1e-9, F.col(f"hi{j}") + limit + 1e-9)
        cur = left.join(box, "cluster").filter(~F.col("in") | near)
        cur = cur.select("cluster", "rep", "shingles", F.when(F.col("in"), F.col("cluster")).otherwise(F.col("main")).alias("main"))
        cur, path = materialize(cur, "cluster")
        trash.append(path)
    return union_all(ready)


SALTS = 16


def _by_pivot(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (pivot, rep, ...) with the one row of facts (p, ...) of their pivot; a frequent pivot's rows are dealt to SALTS tasks."""
    many = facts.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    return dealt.join(many, (F.col("pivot") == F.col("p")) & (F.col("__salt") == F.col("__s"))).drop("p", "__s", "__salt")


REPLY = "block int, kind string, bucket int, who long, data binary"


def _replies(block: list[int], kind: str, bucket: list[int], data: list[bytes]) -> pa.Table:
    n = len(block)
    return pa.table({"block": pa.array(block, pa.int32()), "kind": pa.array([kind] * n, pa.string()), "bucket": pa.array(bucket, pa.int32()), "who": pa.nulls(n, pa.int64()), "data": pa.array(data, pa.binary())})


def _count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Of a bucket's shingles, how rare each is: 0 for one document's only, else by powers of two."""
    got = X.ordered(t, "block", "keys", "more")
    _, back = np.unique(np.frombuffer(b"".join(g[1] for g in got), np.uint32), return_inverse=True)
    total = np.bincount(back, weights=np.frombuffer(b"".join(g[2] for g in got), np.uint8))
    rarity = (np.floor(np.log2(total)) + (total > 1)).astype(np.uint8)[back]
    edge = np.cumsum([0] + [len(g[2]) for g in got])
    return _replies([g[0] for g in got], "rarity", [key[0].as_py()] * len(got), [rarity[a:z].tobytes() for a, z in pairwise(edge)])


def _lead(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Of a bucket's shingles, the smallest document that has each among its first, and the blocks that need others' sets."""
    got = X.ordered(t, "block", "keys", "more")
    _, back = np.unique(np.frombuffer(b"".join(g[1] for g in got), np.uint32), return_inverse=True)
    mine = np.frombuffer(b"".join(g[2] for g in got), np.int64)
    least = np.full(back.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, back, mine)
    edge = np.cumsum([0] + [len(g[2]) // 8 for g in got])
    replies = _replies([g[0] for g in got], "leader", [key[0].as_py()] * len(got), [least[back[a:z]].tobytes() for a, z in pairwise(edge)])
    foreign = [np.unique(least[back[a:z]][least[back[a:z]] != mine[a:z]]) for a, z in pairwise(edge)]
    asker = np.repeat([g[0] for g in got], [len(f) for f in foreign])
    wants = pa.table({"block": pa.array(asker, pa.int32()), "kind": pa.array(["want"] * len(asker), pa.string()), "bucket": pa.nulls(len(asker), pa.int32()), "who": pa.array(np.concatenate(foreign), pa.int64()), "data": pa.nulls(len(asker), pa.binary())})
    return pa.concat_tables([replies, wants])


def _asks(block: int, b: _Block, keys: np.ndarray, more: np.ndarray, bits: int) -> pa.Table:
    out = [(k, X.short(keys[lo:hi], bits), more[lo:hi].tobytes()) for k, lo, hi in X.split(keys, bits)]
    return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "block": pa.array([block] * len(out), pa.int32()), "keys": pa.array([o[1] for o in out], pa.binary()), "more": pa.array([o[2] for o in out], pa.binary())})


ASK = "bucket int, block int, keys binary, more binary"


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 5 << 20, local: int = 400) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; exact for a Jaccard similarity of num / den or more.

    Words are runs without ASCII white space of the whole text, A-Z lowered. A text with fewer
    words than n has its whole sequence as one shingle; one without words, or null, has none and
    is linked with nothing. component_id is the smallest id reachable by links, the id itself
    without any. Rows with a null id are linked with nothing and have a null component. Repeated
    rows are each returned; rows with one id are one node. An empty table gives an empty one; other
    columns are ignored. Shingles are compared by 64 bits of hash.
    """
    spark = docs.sparkSession
    n_blocks = block_count(text_bytes(docs, text), block_bytes)
    bits = X.bucket_bits(n_blocks)
    texts = blocked(docs, n_blocks, doc_id, text).repartition(n_blocks, "block")
    home = F.pmod(hash_of("who"), F.lit(n_blocks)).cast("int").alias("block")

    def ask(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = _Block(t, n)
        return _asks(key[0].as_py(), b, b.keys, np.minimum(b.counts, 255).astype(np.uint8), bits)

    def ask_leaders(key: tuple[pa.Scalar, ...], t: pa.Table, told: pa.Table) -> pa.Table:
        b = _Block(t, n)
        b.prefix(told, bits, num, den)
        least = np.full(len(b.held), np.iinfo(np.int64).max)
        np.minimum.at(least, b.key, b.reps[b.owner])
        return _asks(key[0].as_py(), b, b.keys[b.held], least, bits)

    def serve(key: tuple[pa.Scalar, ...], t: pa.Table, asked: pa.Table) -> pa.Table:
        """The sets of the documents that are asked for, once for each part."""
        t = t.filter(pa.compute.is_in(t.column("doc_id"), asked.column("who").combine_chunks()))
        found: dict[int, set[bytes]] = {}
        for i, s in zip(t.column("doc_id").to_pylist(), shingle_sets([x.encode() for x in t.column("text").to_pylist()], n), strict=True):
            if len(s):
                found.setdefault(i, set()).add(s.tobytes())
        out = [(w, p, s) for w, p in X.rows(asked, "who", "part") for s in found.get(w, ())]
        return pa.table({"who": pa.array([o[0] for o in out], pa.int64()), "part": pa.array([o[1] for o in out], pa.int32()), "data": pa.array([o[2] for o in out], pa.binary())})

    def served(asked: DataFrame, again: DataFrame = texts) -> DataFrame:
        wanted = asked.select("who", "part", home).repartition(n_blocks, "block")
        return again.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(lean(serve), "who long, part int, data binary")

    def measure(key: tuple[pa.Scalar, ...], t: pa.Table, told: pa.Table) -> pa.Table:
        b = _Block(t, n)
        b.prefix(told, bits, num, den)
        member, pivot = b.pivots(told, bits)
        known: dict[int, list[np.ndarray]] = {}
        for kind, who, data in X.rows(told, "kind", "who", "data"):
            if kind == "pivot":
                known.setdefault(who, []).append(np.frombuffer(data, U))
        needed = set(pivot.tolist())
        for i, s in zip(b.reps.tolist(), b.sets, strict=True):
            if i in needed:
                known.setdefault(i, []).append(s)
        out: list[tuple] = []
        edge = np.append(np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])), len(pivot)) if len(pivot) else np.zeros(1, np.int64)
        for lo, hi in pairwise(edge.tolist()):
            mine, sets = member[lo:hi], known[int(pivot[lo])]
            link, far = np.zeros(hi - lo, bool), np.full(hi - lo, 2.0)
            for p in sets:
                both = _shared(p, [b.sets[k] for k in mine])
                union = b.size[mine] + len(p) - both
                link |= den * both >= num * union
                far = np.minimum(far, 1 - both / union)
            if len(sets) > 1:  # an id with several sets: no distance to leave a linked one out by
                far[link] = 2.0
            out += zip(b.reps[mine].tolist(), pivot[lo:hi].tolist(), far.tolist(), link.tolist(), strict=True)
        d, m = len(b.docs), len(out)
        return pa.table({
            "kind": pa.array(["d"] * d + ["m"] * m, pa.string()),
            "doc_id": pa.array([x[0] for x in b.docs] + [None] * m, pa.int64()),
            "n_shingles": pa.array([x[1] for x in b.docs] + [None] * m, pa.int64()),
            "rep": pa.array([int(b.reps[x[2]]) if x[2] >= 0 else None for x in b.docs] + [x[0] for x in out], pa.int64()),
            "pivot": pa.array([None] * d + [x[1] for x in out], pa.int64()),
            "far": pa.array([None] * d + [x[2] for x in out], pa.float64()),
            "linked": pa.array([None] * d + [x[3] for x in out], pa.bool_()),
        })

    def judged(asked: DataFrame, judge) -> DataFrame:
        return asked.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(lean(judge), REPLY)

    def with_replies(told: DataFrame):
        return texts.groupBy("block").cogroup(told.groupBy("block"))

    # All in one plan, so that texts are dealt to blocks once; what is read twice lies behind an exchange that is reused.
    rarity = judged(texts.groupBy("block").applyInArrow(lean(ask), ASK), _count).repartition(n_blocks, "block")
    lead = judged(with_replies(rarity).applyInArrow(lean(ask_leaders), ASK), _lead)
    leaders = lead.filter("kind = 'leader'").repartition(n_blocks, "block")
    # A block doesn't ask for the sets it has. A pivot that very many blocks ask for is sent by a task for ASKERS of them.
    wants = lead.filter("kind = 'want'").select("who", F.col("block").alias("asker")).distinct().filter(F.pmod(hash_of("who"), F.lit(n_blocks)) != F.col("asker")).withColumn("part", F.floor(F.col("asker") / ASKERS).cast("int"))
    pivots = served(wants.select("who", "part").distinct())
    sent = wants.join(pivots, ["who", "part"]).select(F.col("asker").alias("block"), F.lit("pivot").alias("kind"), F.lit(None).cast("int").alias("bucket"), "who", "data").repartition(n_blocks, "block")
    dealt = with_replies(rarity.unionByName(leaders).unionByName(sent)).applyInArrow(lean(measure), "kind string, doc_id long, n_shingles long, rep long, pivot long, far double, linked boolean")
    path = scratch(spark, "measured")
    dealt.write.partitionBy("kind").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)

    member = dealt.filter("kind = 'm'").select("rep", "pivot", "far", "linked")
    near, _ = materialize(connected_components(member.filter("linked").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))), "classes")
    # What is left of the regions: what isn't linked to the pivot, and the boundary, by ids alone.
    low = member.filter("not linked").groupBy(F.col("pivot").alias("p")).agg(F.min("far").alias("low"))
    left = _by_pivot(member, low).filter(~F.col("linked") | (F.col("far") >= F.col("low") - (1 - num / den) - 1e-9)).select("pivot", "rep").distinct()
    left = left.join(near, F.col("rep") == F.col("node"), "left").select("pivot", "rep", F.coalesce("component", "rep").alias("main"))
    live = left.groupBy("pivot").agg(F.count("*").alias("members"), F.min("main").alias("least"), F.max("main").alias("most")).filter("least < most").select(F.col("pivot").alias("p"), "members")
    left, at_left = materialize(_by_pivot(left, live).select(F.col("pivot").alias("cluster"), F.col("rep").alias("who"), "main", "members"), "regions")
    trash = [at_left]
    rows = dealt.filter("kind = 'd'").select("doc_id", "n_shingles", "rep").join(near, F.col("rep") == F.col("node"), "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("class"))
    if left.take(1):
        # Only the texts of these documents are dealt again.
        wanted = left.select("who").distinct().withColumn("part", F.lit(0))
        few = blocked(by_ids(docs, wanted.select(F.col("who").alias("__who")), "left_semi", doc_id), n_blocks, doc_id, text).repartition(n_blocks, "block")
        sets = left.join(served(wanted, few), "who").select("cluster", F.col("who").alias("rep"), F.col("data").alias("shingles"), "main", "members")
        small, links = sets.filter(F.col("members") <= local).drop("members"), []
        if left.filter(F.col("members") > local).take(1):
            small = small.unionByName(_large(sets.filter(F.col("members") > local).drop("members", "main"), num, den, local, links, trash))
        links.append(small.groupBy("cluster").applyInArrow(lean(_local_links(num, den)), "a long, b long"))
        found, at_found = materialize(union_all(links), "links")
        trash.append(at_found)
        # Classes, not documents, are connected further.
        a = found.join(near, F.col("a") == F.col("node"), "left").select(F.coalesce("component", "a").alias("x"), "b")
        more = connected_components(a.join(near, F.col("b") == F.col("node"), "left").select(F.col("x").alias("a"), F.coalesce("component", "b").alias("b")))
        more = more.withColumnRenamed("component", "whole")
        rows = rows.join(more, F.col("class") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("whole", "class").alias("class"))
    rows, _ = materialize(rows.withColumnRenamed("class", "component_id"), "jaccard")
    drop(spark, path, *trash)
    return rows


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each class: a row with the smallest id.

    Of several rows with that id, which are of one class by their id alone, the one with the least
    text stays (a null one last). Rows with a null id, and all columns, stay. An empty table gives an empty one.
    """
    found = jaccard_classes(docs, doc_id=doc_id, **how)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = by_ids(docs, gone, "left_anti", doc_id)
    again, _ = materialize(docs.groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.count("*").alias("__n")).filter("__n > 1 and __id is not null").select("__id"), "repeated")
    if not again.take(1):
        return kept
    text = how.get("text", "text")
    place = W.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last(), *(F.col(f"`{c}`").cast("string") for c in docs.columns))
    # Only rows whose id is repeated meet by it.
    repeated = by_ids(kept, again, "left_semi", doc_id).withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")
    return by_ids(kept, again, "left_anti", doc_id).unionByName(repeated)


def op3(docs: DataFrame) -> DataFrame:
    """`jaccard_classes` of 4 words at 0.85; odd rows are as there."""
    return jaccard_classes(docs, n=4, num=85, den=100)


#: The same over documents.
OP3_SQL = r"""
WITH RECURSIVE words AS (
    SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
    SELECT doc_id, w, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM words
), sets AS (
    SELECT row_number() OVER () AS id, doc_id, len(s) AS n, s FROM listed
), held AS (
    SELECT id, unnest(list_transform(s, lambda x: md5(array_to_string(x, ' ')))) AS shingle FROM sets
), both_sides AS (
    SELECT a.id AS a, b.id AS b, count(*) AS shared FROM held a JOIN held b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM both_sides l JOIN sets x ON x.id = l.a JOIN sets y ON y.id = l.b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared) AND x.doc_id <> y.doc_id
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
    SELECT DISTINCT a AS doc_id, a AS other FROM edges
    UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
), counted AS (
    SELECT doc_id, w, CAST(len(s) AS BIGINT) AS n_shingles FROM listed
)
SELECT d.doc_id, c.n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d
JOIN counted c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.w = regexp_extract_all(translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')
LEFT JOIN least l ON l.doc_id = d.doc_id
"""
