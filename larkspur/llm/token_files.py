"""Token-id output: ids of a tokenizer in files of canonical, length-limited Huffman codes.

One plan tokenizes, deals the ids to parts by ranges of doc_id, counts all ids, builds one code
from the counts and writes a file a part. A file stands by itself:

    b"LKT1" | u32 header bytes | header (zlib of JSON) | arrays (zlib each) | payload

The header names the sizes; the arrays are the code length of each id (u8), the documents' ids
(i64), which of them are null (u8), their token counts (u32) and the bit at which each block of
BLOCK ids starts (u64). Blocks decode independently, by tables of all strings of the longest code.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.llm.common import block_count, get, hash_of, lean, materialize, put, release, scratch, text_bytes

MAGIC = b"LKT1"
BLOCK = 4096
GROUP = 64
DECODED = 1024
LIMIT = 16
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\t-\r \x85\xa0"
#: The byte-level pieces of texts in Latin letters; other texts go to the tokenizer whole.
PIECES = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
BEYOND = re.compile("[^\x00-ɏ]")
CUT = "\x01"
CACHE = 1_000_000
STEP = 256
STRETCH = 4096


class _Known(dict):
    """Ids of pieces; a piece that isn't known counts as missing and as nothing for now."""

    def __init__(self) -> None:
        self.missing: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        self.missing.append(piece)
        return b""


class Encoder:
    """Ids of texts by a tokenizer file; pieces that come again are looked up."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.cut = Tokenizer.from_file(path)  # the same, for pieces that are cut already
        self.cut.pre_tokenizer = Sequence([CharDelimiterSplit(CUT), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known = _Known()

    def _learn(self, pieces: set[str]) -> None:
        whole = [p for p in pieces if CUT not in p]
        parts = [whole[lo : lo + 500] for lo in range(0, len(whole), 500)]
        unit = np.dtype(self.kind).itemsize
        for part, e in zip(parts, self.cut.encode_batch([CUT.join(p) for p in parts], add_special_tokens=False), strict=True):
            body = np.array(e.ids, dtype=self.kind).tobytes()
            edge = (np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1)) * unit).tolist()
            self.known.update(zip(part, [body[a:z] for a, z in pairwise(edge)], strict=True))
        for p in pieces.difference(whole):
            self.known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian numbers of this encoder's kind."""
        for lo in range(0, len(texts), STEP):
            if len(self.known) > CACHE:
                self.known.clear()
            yield from self._step(texts[lo : lo + STEP])

    def _step(self, texts: list[str]) -> list[bytes]:
        get, missing, out, again = self.known.__getitem__, self.known.missing, [], []
        for i, t in enumerate(texts):
            if not self.by_piece or BEYOND.search(t) or any(s in t for s in self.special):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=self.kind).tobytes())
                continue
            pieces, n = PIECES.findall(t), len(missing)
            out.append(b"".join(map(get, pieces)))
            if len(missing) > n:
                again.append((i, pieces))
        if again:
            self._learn(set(missing))
            missing.clear()
            for i, pieces in again:
                out[i] = b"".join(map(get, pieces))
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: tasks that follow find the file read and the pieces known."""
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (u8) of an optimal prefix code with no code over limit bits, by package-merge; 0 for what doesn't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    merged, is_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        o = np.argsort(both, kind="stable")
        merged = both[o]
        is_leaf.append(o < len(leaf))
    take, length = 2 * (len(leaf) - 1), np.zeros(len(leaf), np.int64)
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the ids, ids in the order of their codes)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    top = int(lengths.max(initial=1))
    step = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
    at = np.cumsum(step) - step
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[order] = at >> (top - lengths[order]).astype(np.uint64)
    return codes, order


def _pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    total = int(end[-1])
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    at = start >> 6
    shift = 64 - (start & 63) - n  # below 0: the code goes on in the next word
    code = codes[ids]
    head = code << np.maximum(shift, 0).view(np.uint64)
    over = np.flatnonzero(shift < 0)
    head[over] = code[over] >> (-shift[over]).view(np.uint64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    words[at[new]] |= np.bitwise_or.reduceat(head, new)
    words[at[over] + 1] |= code[over] << (64 + shift[over]).view(np.uint64)
    return start[::BLOCK].astype(np.uint64), words.astype(">u8").tobytes()[: (total + 7) // 8]


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(first bit of each block, the codes as bytes); every GROUP blocks start at a byte."""
    codes, _ = canonical(lengths)
    offsets, out, size = [np.zeros(0, np.uint64)], [], 0
    for lo in range(0, len(ids), GROUP * BLOCK):
        first, body = _pack(ids[lo : lo + GROUP * BLOCK], lengths, codes)
        offsets.append(first + np.uint64(8 * size))
        out.append(body)
        size += len(body)
    return np.concatenate(offsets), b"".join(out)


class Decoder:
    """Tables for one code: of every string of its longest length, the id it starts with and that id's length."""

    def __init__(self, lengths: np.ndarray):
        self.top = int(lengths.max(initial=1))
        _, order = canonical(lengths)
        symbol = np.repeat(order, 1 << (self.top - lengths[order]).astype(np.int64))
        self.symbol = np.concatenate([symbol, np.full((1 << self.top) - len(symbol), order[0] if len(order) else 0)]).astype(np.uint32)
        self.width = lengths[self.symbol].astype(np.int64) if len(lengths) else np.zeros(len(self.symbol), np.int64)

    def blocks(self, payload: bytes, offsets: np.ndarray, n: int, which: Iterable[int]) -> np.ndarray:
        """The ids of some blocks in ascending order, all a step at a time; n: ids in all."""
        which = np.array(list(which), dtype=np.int64)
        if not len(which):
            return np.zeros(0, np.uint32)
        size = np.minimum(BLOCK, n - which * BLOCK)
        bit = offsets[which].astype(np.int64)
        lo = int(bit[0]) >> 3
        hi = int(offsets[which[-1] + 1] + np.uint64(7)) >> 3 if which[-1] + 1 < len(offsets) else len(payload)
        raw = np.frombuffer(payload[lo:hi] + bytes(8), dtype=np.uint8).astype(np.uint32)
        wide = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        bit -= 8 * lo
        out = np.zeros((BLOCK, len(which)), dtype=np.uint32)
        mask = np.uint32((1 << self.top) - 1)
        for i in range(int(size.max())):
            code = (wide[bit >> 3] >> (32 - self.top - (bit & 7)).astype(np.uint32)) & mask
            out[i] = self.symbol[code]
            bit += self.width[code]
            if i + 1 >= size[-1]:  # the last block may be short
                bit[-1] = 0
        flat = out.T.ravel()
        return flat[: (len(which) - 1) * BLOCK + size[-1]] if (size[:-1] == BLOCK).all() else np.concatenate([out[:z, k] for k, z in enumerate(size)])


def unpack(payload: bytes, lengths: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """All ids, DECODED blocks at a time."""
    d = Decoder(lengths)
    for lo in range(0, len(offsets), DECODED):
        yield d.blocks(payload, offsets, n, range(lo, min(len(offsets), lo + DECODED)))


def to_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    offsets, payload = pack(ids, lengths)
    null = np.array([i is None for i in doc_ids], dtype=np.uint8)
    arrays = [zlib.compress(a.tobytes(), 1) for a in (lengths, np.array([i or 0 for i in doc_ids], "<i8"), null, counts.astype("<u4"), offsets.astype("<u8"))]
    head = zlib.compress(json.dumps({"ids": len(ids), "documents": len(doc_ids), "block": BLOCK, "arrays": [len(a) for a in arrays]}).encode())
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *arrays, payload])


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(documents, their token counts, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack("<I", data[4:8])
    head, at, arrays = json.loads(zlib.decompress(data[8 : 8 + size])), 8 + size, []
    if head["block"] != BLOCK:
        raise ValueError("unknown block size")
    for n in head["arrays"]:
        arrays.append(zlib.decompress(data[at : at + n]))
        at += n
    lengths, docs, null, counts, offsets = (np.frombuffer(a, k) for a, k in zip(arrays, ("u1", "<i8", "u1", "<u4", "<u8"), strict=True))
    ids = np.concatenate([np.zeros(0, np.uint32), *unpack(data[at:], lengths, offsets, head["ids"])])
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], counts, ids


EXACT = 1 << 53


def part_of(rows: DataFrame, n_parts: int, key: str, *more: str) -> DataFrame:
    """rows with `part`: about n_parts ranges of an integer key, ascending, nulls first.

    Bounds are quantiles, looked up by a binary search. A key that fills several ranges by itself
    (a frequent one, or null) has them all, its rows dealt to them by a hash of `more`; but not keys
    beyond 2**53, which doubles don't tell apart.
    """
    total, nulls = rows.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    blank = -(-n_parts * nulls // total) if total else 0
    n = max(1, n_parts - blank)
    bounds = rows.filter(F.col(key).isNotNull()).approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n) if n > 1 and nulls < total else []
    values, times = np.unique(np.array(bounds, dtype=np.float64), return_counts=True)
    deal = F.xxhash64(*(hash_of(c) for c in more))
    if not len(values):
        return rows.withColumn("part", F.when(F.col(key).isNull(), F.pmod(deal, F.lit(max(1, blank)))).otherwise(blank).cast("int"))
    before = np.append(0, np.cumsum(times)) + blank  # parts of smaller keys
    cut = Bucketizer(splits=[float("-inf"), *values.tolist(), float("inf")], inputCol="__key", outputCol="__at", handleInvalid="keep").transform(rows.withColumn("__key", F.col(key).cast("double")))
    at, array = F.col("__at").cast("int"), lambda x, kind: F.lit(x).cast(f"array<{kind}>")
    same = F.get(array(values.tolist(), "double"), at - 1) == F.col("__key")  # the key is the bound that ends the range before
    first = F.get(array(before.tolist(), "int"), F.when(same, at - 1).otherwise(at))
    wide = F.when(same & (F.abs(F.col("__key")) < EXACT), F.get(array(times.tolist(), "int"), at - 1)).otherwise(1)
    part = F.when(F.col(key).isNull(), F.pmod(deal, F.lit(max(1, blank)))).otherwise(first + F.pmod(deal, wide))
    return cut.withColumn("part", part.cast("int")).drop("__key", "__at")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 12 << 20) -> DataFrame:
    """Write the files to the folder, and return (part, path, n_docs, n_ids) of each.

    Documents are in ascending doc_id order within and across parts, null ids first, and repeated
    rows are all written; each ends with end_id. A null text is empty. The parts are those of
    `part_of`. An empty table gives no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_parts = block_count(text_bytes(docs, text), part_bytes)
    rows = part_of(rows, n_parts, "doc_id", "text")
    n_parts = n_parts + 1  # nulls have a part of their own

    def tokenize(batches):
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        total, wide = np.zeros(1, dtype=np.int64), encoder.kind is np.uint32
        names = ["part", "doc_id", "ids", "wide", "counts"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))]
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                b = whole.slice(lo, STEP)
                body = [x + end for x in encoder.encode(b.column("text").to_pylist())]
                c = np.bincount(np.frombuffer(b"".join(body), encoder.kind))
                if len(c) > len(total):
                    total = np.append(total, np.zeros(len(c) - len(total), np.int64))
                total[: len(c)] += c
                cols = [b.column("part"), b.column("doc_id"), pa.array(body, pa.binary()), pa.array([wide] * len(body)), pa.nulls(len(body), kinds[4])]
                yield pa.record_batch(cols, names)
        used = np.flatnonzero(total)
        if len(used):  # what this task has counted, in one row without ids
            found = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pa.StructArray.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"]))
            yield pa.record_batch([pa.array([int(total.sum()) % n_parts], kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]), pa.array([wide]), found.cast(kinds[4])], names)

    tokens = rows.mapInArrow(tokenize, "part int, doc_id long, ids binary, wide boolean, counts array<struct<id:long,n:long>>").repartition(n_parts, "part")

    def flat(t) -> np.ndarray:
        kind = np.uint32 if t.num_rows and t.column("wide")[0].as_py() else np.uint16
        return np.frombuffer(b"".join(x.as_py() for x in t.column("ids")), dtype=kind)

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        counts = np.zeros(ids.max() + 1, dtype=np.int64)
        counts[ids] = t.column("n").to_numpy()
        return pa.table({"lengths": pa.array([code_lengths(counts).tobytes()], pa.binary())})

    def counted(batches):
        for b in batches:
            for c in b.column("counts").drop_null():
                yield pa.RecordBatch.from_struct_array(c.values)

    # All columns are read, so that Spark reuses the exchange and tokenizes once.
    counts = tokens.mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    code = counts.groupBy(F.lit(0).alias("all")).applyInArrow(build, "lengths binary")
    code = code.select("lengths", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))

    def write(key: tuple[pa.Scalar, ...], t: pa.Table, code: pa.Table) -> pa.Table:
        names = ["part", "path", "n_docs", "n_ids"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        t = t.select(["doc_id", "ids", "wide"]).filter(pa.compute.is_valid(t.column("ids")))
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        t = t.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        docs = t.column("doc_id").to_pylist()
        first = sum(d is None for d in docs)
        t = pa.concat_tables([t.slice(len(docs) - first), t.slice(0, len(docs) - first)])
        docs, ids = t.column("doc_id").to_pylist(), flat(t)
        unit = 4 if t.column("wide")[0].as_py() else 2
        counts = np.array([len(x.as_buffer()) // unit for x in t.column("ids")], dtype=np.uint32)
        data = to_file(docs, counts, ids, np.frombuffer(code.column("lengths")[0].as_py(), np.uint8))
        path = f"{folder}/part-{key[0].as_py():06d}.lkt"
        put(path, data)
        return pa.table({n: pa.array([v], k) for n, k, v in zip(names, kinds, (key[0].as_py(), path, len(docs), len(ids)), strict=True)})

    written = tokens.groupBy("part").cogroup(code.groupBy("part")).applyInArrow(lean(write), "part int, path string, n_docs long, n_ids long")
    return materialize(written, "manifest")[0]


def read_tokens(manifest: DataFrame, with_ids: bool = True, spread: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the files' documents.

    start counts the ids of all documents before; the CRC is of the ids as little-endian 32-bit
    numbers. Without ids, these stay in the task that decodes them. No files give an empty table.
    Starts are summed by stretches of STRETCH parts, then within each.
    """
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = manifest.withColumn("stretch", F.floor(F.col("part") / STRETCH))
    sums = cut.groupBy("stretch").agg(F.sum("n_ids").alias("n_ids"))
    sums = sums.select(F.col("stretch").alias("s"), upto(W.orderBy("stretch")).alias("base"))
    files = cut.withColumn("within", upto(W.partitionBy("stretch").orderBy("part"))).join(sums, F.col("stretch") == F.col("s"))
    files = files.select("part", "path", (F.col("base") + F.col("within")).alias("start"))

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                docs, counts, ids = from_file(get(path))
                end = np.cumsum(counts.astype(np.int64))
                begin = end - counts
                flat = ids.astype("<u4")
                for lo in range(0, len(docs), 1000):
                    few = slice(lo, lo + 1000)
                    cols = {"doc_id": pa.array(docs[few], pa.int64()), "start": pa.array(start + begin[few]), "n_tokens": pa.array(counts[few].astype(np.int64))}
                    cols["ids_crc32"] = pa.array([zlib.crc32(flat[a:z].data) for a, z in zip(begin[few], end[few], strict=True)], pa.int64())
                    if with_ids:
                        a, z = int(begin[lo]), int(end[few][-1])
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, end[few] - a), pa.int32()), pa.array(flat[a:z].astype(np.int64)))
                    yield pa.record_batch(cols)
        release()

    spread = spread or manifest.sparkSession.sparkContext.defaultParallelism * 4
    return files.repartition(spread, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op4(docs: DataFrame) -> DataFrame:
    """What `read_tokens` finds after `write_tokens` with end id 0; odd rows are as there."""
    import public_tokenizers

    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), with_ids=False)
