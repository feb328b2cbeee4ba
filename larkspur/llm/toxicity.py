"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A text's distinct words, in the order in which they first occur, are cut into segments of SEGMENT
words. A segment's bag holds its words and their character 3- to 5-grams, word ends included,
hashed to BUCKETS rows of an embedding table; the average of the rows goes into a softmax over two
classes. A bag of fewer than LEAST features is averaged as if it were filled up with zeros. A document is as toxic as its worst segment: training
takes a toxic document's most toxic segment as its example and every segment of the others. A
misspelling that was never seen still shares most of its n-grams.

The model is fitted on the driver on at most SAMPLE labelled documents, those with the least hash
of their id. Its size doesn't depend on the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import hashing as H
from larkspur.llm.common import release

U = np.uint64
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
SEGMENT = 16
DIM = 8
SAMPLE = 5000
EPOCHS = 4
LEAST = 128
THRESHOLD = 0.7
PAD = 8
BATCH = 512


@dataclass
class Bags:
    """Features of the segments of some texts: bucket of each feature, its segment, and each segment's text."""

    bucket: np.ndarray
    segment: np.ndarray
    owner: np.ndarray


def _words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one buffer, A-Z lowered and white space as spaces; starts, ends, texts and hashes of the words."""
    buf = H.LOWER[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n" * PAD, dtype=np.uint8)]
    buf = np.where(H.SPACE[buf], np.uint8(32), buf)
    starts, ends = H.word_spans(buf)
    edges = np.cumsum([len(r) + 1 for r in raw]) + 1
    return buf, starts, ends, np.searchsorted(edges, starts, side="right"), H.word_hashes(buf, starts, ends)


def _cut(doc: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which words are a text's first of the kind, the segment of each or -1, each segment's text)."""
    order = np.argsort(words + doc.astype(U) * H.ODD[40], kind="stable")
    same = (words[order][1:] == words[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    kept = np.ones(len(doc), dtype=bool)
    kept[order[1:][same]] = False
    per = np.bincount(doc[kept], minlength=n)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    new = place % SEGMENT == 0
    seg = np.full(len(doc), -1)
    seg[kept] = np.cumsum(new) - 1
    return kept, seg, doc[kept][new]


def bags(raw: list[bytes]) -> Bags:
    buf, starts, ends, doc, words = _words(raw)
    space = buf == 32
    kept, seg, owner = _cut(doc, words, len(raw))
    word_at = (np.cumsum(np.bincount(starts, minlength=len(buf))) - 1).astype(np.int32)  # the last word that starts at or before a byte
    buckets = [(words[kept] >> U(47)).astype(np.int32)]
    segments = [seg[kept].astype(np.int32)]
    gaps = np.append(0, np.cumsum(space)).astype(np.int32)
    for n in GRAMS:
        rank = H.string_ranks(buf, n)
        at = np.flatnonzero(gaps[n - 1 : n - 1 + len(rank)] == gaps[1 : 1 + len(rank)])  # no gap inside, ends allowed
        at = at[~(space[at] & space[np.minimum(at + 1, len(buf) - 1)])]
        of = word_at[at + 1] if len(starts) else at[:0]
        mine = (of >= 0) & (seg[of] >= 0) if len(starts) else np.zeros(0, bool)
        at, of = at[: len(of)][mine], of[mine]
        buckets.append((H.mix(rank[at] + U(n)) >> U(47)).astype(np.int32))
        segments.append(seg[of].astype(np.int32))
    return Bags(np.concatenate(buckets), np.concatenate(segments), owner)


def _features(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets by segment, how many each has, where each one's start)."""
    b = bags(segments)
    n = np.bincount(b.segment, minlength=len(segments))
    return b.bucket[np.argsort(b.segment, kind="stable")], n, np.cumsum(n) - n


def _chunks(texts: list[str], size: int = 1 << 19):
    lo = 0
    while lo < len(texts):
        hi, total = lo + 1, len(texts[lo])
        while hi < len(texts) and total + len(texts[hi]) < size:
            total += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


@dataclass(frozen=True)
class Model:
    """value: each bucket's share of the softmax's log-odds; a text's log-odds are scaled to a probability."""

    value: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log-odds of each text's worst segment; those of an empty bag without words."""
        out = np.full(len(texts), self.bias)
        for lo, hi in _chunks(texts):
            b = bags([x.encode() for x in texts[lo:hi]])
            if len(b.owner):
                n = np.maximum(np.bincount(b.segment, minlength=len(b.owner)), LEAST)
                total = np.bincount(b.segment, weights=self.value[b.bucket], minlength=len(b.owner)) / n + self.bias
                worst = np.full(hi - lo, -np.inf)
                np.maximum.at(worst, b.owner, total)
                out[lo:hi] = np.where(np.isfinite(worst), worst, self.bias)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.odds(texts) + self.shift, -500, 500)))


def _calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make 0.7 the cut with the fewest errors, toxic ones counting twice."""
    order = np.argsort(odds)
    x, t = odds[order], y[order]
    missed = np.append(0, np.cumsum(t))
    wrong = np.append(np.cumsum((1 - t)[::-1])[::-1], 0)
    cost = 2 * missed + wrong
    best = np.flatnonzero(cost == cost.min())
    lo, hi = best[0], best[-1]
    left = x[max(lo - 1, 0)]
    right = x[min(hi, len(x) - 1)]
    cut = (left + right) / 2
    slope = 4.0 / max(float(np.std(x)), 1e-6)
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def _segments(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Each segment's words as bytes, and its text's number. A segment takes up no more than its part of the text."""
    out, owners = [], []
    for lo, hi in _chunks(texts):
        raw = [x.encode() for x in texts[lo:hi]]
        buf, starts, ends, doc, words = _words(raw)
        kept, seg, owner = _cut(doc, words, len(raw))
        # The first occurrences in order, each with the byte after it, which is white space.
        turn = np.zeros(len(buf) + 1, np.int8)
        turn[starts[kept]] += 1
        turn[ends[kept] + 1] -= 1
        body = buf[np.cumsum(turn[:-1]) > 0].tobytes()
        size = np.bincount(seg[kept], weights=ends[kept] - starts[kept] + 1, minlength=len(owner)).astype(np.int64)
        edge = np.append(0, np.cumsum(size)).tolist()
        out += [body[a:z] for a, z in pairwise(edge)]
        owners.append(owner + lo)
    return out, np.concatenate(owners) if owners else np.zeros(0, np.int64)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Fit on the texts; a fifth of them sets the scale of the score.

    Held in memory are the texts, their segments (as long as the texts at most) and the features of
    one minibatch; those of all segments never are.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), bool)
    own = np.flatnonzero(~held)
    segments, owner = _segments([texts[i] for i in own])
    label = y[own][owner].astype(int)
    emb = (rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM).astype(np.float32)
    weight = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - y[own].mean(), y[own].mean()])).astype(np.float32)
    square = np.full(BUCKETS, 1e-8, np.float32)
    good, toxic = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    rng.random(len(owner))  # the draw that the first epoch has always begun with: the same sequence of batches
    for epoch in range(epochs):
        worst = toxic
        if epoch and len(toxic):  # a toxic text's example is its worst segment so far
            value = emb @ (weight[:, 1] - weight[:, 0])
            odds = np.zeros(len(toxic))
            for lo in range(0, len(toxic), BATCH):
                ids, n, edge = _features([segments[i] for i in toxic[lo : lo + BATCH]])
                odds[lo : lo + BATCH] = np.add.reduceat(value[ids], edge) / np.maximum(n, LEAST)
            order = np.lexsort((-odds, owner[toxic]))
            who = owner[toxic][order]
            worst = toxic[order[np.append(True, who[1:] != who[:-1])]]
        bad = np.tile(worst, max(1, len(good) // (3 * max(1, len(worst)))))
        take = rng.permutation(np.concatenate([good, bad]))
        for lo in range(0, len(take), BATCH):
            s = take[lo : lo + BATCH]
            ids, n, edge = _features([segments[i] for i in s])
            size = np.maximum(n, LEAST).astype(np.float32)[:, None]
            hidden = np.add.reduceat(emb[ids], edge, axis=0) / size
            z = hidden @ weight + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            g = p.copy()
            g[np.arange(len(s)), label[s]] -= 1
            g /= len(s)
            back = (g @ weight.T) / size
            weight -= np.float32(2.0) * (hidden.T @ g)
            bias -= np.float32(0.5) * g.sum(axis=0)
            order = np.argsort(ids)
            heads = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
            used = ids[order[heads]]
            step = np.add.reduceat(back[np.repeat(np.arange(len(s)), n)[order]], heads, axis=0)
            square[used] += (step**2).mean(axis=1)
            emb[used] -= np.float32(0.1) * step / np.sqrt(square[used])[:, None]
    model = Model((emb @ (weight[:, 1] - weight[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
    scale = held if held.any() else ~held
    slope, shift = _calibrated(model.odds([t for t, h in zip(texts, scale, strict=True) if h]), y[scale])
    return Model(model.value, model.bias, slope, shift)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled rows that are not held out, `sample` of them at most."""
    marks = labels.filter(~held_out(F.col(doc_id)) & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    # The sample's ids first, so that no other row's text is carried to the join.
    marks = marks.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).groupBy("__id").agg(F.max("__label").alias("__label"))
    marks = marks.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.join(F.broadcast(marks), docs[doc_id] == F.col("__id"))
    rows = rows.groupBy("__id", "__label").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("__text")).collect()
    rows.sort(key=lambda r: r["__id"])
    found = train([r["__text"] for r in rows], [int(r["__label"] == 1) for r in rows])
    del rows
    release()
    return found


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores as an empty one, null ids are kept, an empty table gives an empty one."""

    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(model.score(b.column("text").to_pylist()), pa.float64())})
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that score THRESHOLD or more; all columns are kept."""
    fields = docs.schema
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            s = model.score([x or "" for x in b.column(place).to_pylist()])
            yield b.filter(pa.array(s < THRESHOLD))
        release()

    return docs.mapInArrow(run, fields)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
