"""PII: candidate spans, gradient-boosted trees over their format and context, calibrated thresholds.

DataFrame functions only. Base kinds (email, ip, card, phone) are patterns with checks and always
redacted. High-recall generators propose further spans, which may overlap: `secret` (keys, tokens,
passwords), `number` (account and identity numbers) and `contact` (spelled-out addresses). Boosted
trees score each of them; of neighbours that overlap the one with the higher score stays, and those
over their kind's threshold are redacted too. Scoring is a column expression.

No labels of personal data exist. The trees are fitted on all candidates of all documents, with
labels from the words before them (`WEAK`), which their features then don't show, and on texts made
by `training_texts`, MADE of them, whose features do. Thresholds reach PRECISION on a held-out third
of both. Spark counts the candidates by cell, that is by the steps (`EDGES`) their features fall in;
the trees split at these steps only, so the driver needs a number a cell, however many documents.

Positions are code points. They come from the text between the matches: the lengths of the pieces
that split() leaves and of the matches themselves, summed. Running sums, overlaps and pieces of a
text are taken by blocks, so that a text with very many matches costs about n * sqrt(n) steps for n
of them and never a copy of a long array or of the text for each.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
LABEL = r"\.[A-Za-z0-9-]++"
#: The base patterns as given, in forms that neither backtrack nor recurse deeply on long runs.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:{LABEL})++",  # a possessive group is a loop, without a stack
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE = {
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{10,}+",
    "number": r"(?<![A-Za-z0-9+])(?<![0-9][ .()-])[0-9][0-9 .()-]{7,}[0-9](?![A-Za-z0-9])",
    "contact": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++ ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}+",
}
KINDS = [*BASE, *MORE]
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
HINTS = {"h_secret": "(?i)(password|passwd|pwd|secret|token|key|auth)", "h_number": "(?i)(account|ssn|iban|passport|card|id|no|nr)[ .:=#-]*$", "h_assign": "[=:] ?[\"']?$"}
#: Code points of a piece of a text; a context or a gap is cut from pieces.
PIECE = 512
#: What marks a candidate of a document as personal for the training.
WEAK = {"secret": "(?i)(password|passwd|pwd|secret|token|key|auth)[\"' ]*[=:] ?[\"']?$", "number": HINTS["h_number"], "contact": "$"}
MADE = 3000
PRECISION = 0.98
ROUNDS = 40
RATE = 0.3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}
NEEDS = {"email": "@", "phone": "+", "contact": "at"}


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, op) -> Column:
    """The results of op over an array's elements up to each; an empty array gives an empty one."""

    def short(xs: Column) -> Column:
        return F.aggregate(F.slice(xs, 2, F.size(xs)), F.slice(xs, 1, 1), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def blocks(xs: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int")), lambda k: short(F.slice(xs, k * step + 1, step)))

    def whole(xs: Column) -> Column:
        return _let(blocks(xs), lambda parts: _let(short(F.transform(parts, lambda p: F.element_at(p, -1))), lambda upto: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: op(F.get(upto, k - 1), x)))))))

    return _let(values, lambda xs: F.when(F.size(xs) < 2, xs).otherwise(whole(xs)))


def _found(kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value) of the pattern's matches in the column text."""
    text = F.col("text")
    made = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, v: F.struct((F.length(p) + F.length(v)).alias("step"), v.alias("value")))
    some = F.filter(made, lambda x: x["value"].isNotNull())
    span = lambda x, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))
    spans = _let(some, lambda xs: F.zip_with(xs, _running(F.transform(xs, lambda x: x["step"]), lambda a, b: a + b), span))
    needed = text.contains(NEEDS[kind]) if kind in NEEDS else F.col("has_digit")
    return F.when(needed & text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))


def _apart(more: Column, base: Column) -> Column:
    """The spans of more that overlap none of base, in order of their starts."""
    last = F.lit(2**31 - 1)
    row = lambda x, other: F.struct(x["start"].alias("start"), F.lit(other).alias("other"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: row(x, 0)), F.transform(more, lambda x: row(x, 1))))

    def free(xs: Column) -> Column:
        ends = _running(F.transform(xs, lambda x: F.when(x["other"] == 0, x["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(xs, lambda x: F.when(x["other"] == 0, x["start"]).otherwise(last))), F.least))
        near = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        marked = F.zip_with(xs, near, lambda x, n: F.struct(x.alias("x"), ((x["other"] == 1) & (n["e"] <= x["start"]) & (n["s"] >= x["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: F.struct(m["x"]["kind"].alias("kind"), m["x"]["start"].alias("start"), m["x"]["end"].alias("end"), m["x"]["value"].alias("value")))

    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(_let(every, free))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, out of its pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    head = F.get(pieces, first)
    long = F.concat(F.substr(head, start % PIECE + 1), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substr(F.get(pieces, last), F.lit(1), end - last * PIECE))
    return F.when(end <= start, F.lit("")).when(first == last, F.substr(head, start % PIECE + 1, end - start)).otherwise(long)


def _passing(kind: str) -> Column:
    return F.filter(F.col(f"m_{kind}"), lambda x: CHECKS[kind](x["value"]))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, base, more, row): arrays of (kind, start, end, value), and the row itself; base spans have passed their checks."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct("*").alias("row"))
    rows = rows.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    rows = rows.select("doc_id", "text", "row", *(_found(k, p).alias(f"m_{k}") for k, p in (BASE | MORE).items()))
    base = F.concat(*(_passing(k) for k in BASE))
    return rows.select("doc_id", "text", "row", base.alias("base"), F.concat(*(F.col(f"m_{k}") for k in MORE)).alias("more"))


def features(pieces: Column, span: Column) -> dict[str, Column]:
    """Format and context of a span, as numbers; pieces: those of its text."""
    v, n = span["value"], F.length(span["value"])
    before = _cut(pieces, F.greatest(span["start"] - 24, F.lit(0)), span["start"])
    count = lambda pattern: n - F.length(F.regexp_replace(v, pattern, ""))
    out = {
        "secret": (span["kind"] == "secret").cast("double"),
        "number": (span["kind"] == "number").cast("double"),
        "length": n.cast("double"),
        "digits": count("[0-9]").cast("double"),
        "upper": count("[A-Z]") / n,
        "lower": count("[a-z]") / n,
        "marks": count("[^A-Za-z0-9]") / n,
        "hex": (count("[0-9a-f]") == n).cast("double"),
        "turns": F.length(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "1"), "[^0-9]+", "a")).cast("double"),
    }
    return out | {k: before.rlike(p).cast("double") for k, p in HINTS.items()}


FEATURES = ["secret", "number", "length", "digits", "upper", "lower", "marks", "hex", "turns", *HINTS]
_YES, _SHARE = [0.0, 1.0], [i / 8 for i in range(9)]
#: Values at which trees may split a feature: a value counts as the least of these that is not below it, or as the last.
EDGES = {k: np.array(_YES, dtype=np.float64) for k in FEATURES} | {
    "length": np.array([*range(6, 33), 36, 40, 44, 48, 56, 64, 80, 96, 128, 256], dtype=np.float64),
    "digits": np.array([*range(21), 24, 28, 32, 40, 48, 64, 128], dtype=np.float64),
    "upper": np.array(_SHARE),
    "lower": np.array(_SHARE),
    "marks": np.array(_SHARE),
    "turns": np.array([*range(1, 13), 16, 20, 24, 32, 64], dtype=np.float64),
}
#: What makes a cell of a document's candidate: whether it is held out and labelled, and its step of each feature that is no hint.
CELL = ["held", "weak", *(k for k in FEATURES if k not in HINTS)]
SHAPE = [len(EDGES.get(k, _YES)) for k in CELL]


@dataclass(frozen=True)
class Split:
    feature: int
    bound: float
    below: Split | float
    above: Split | float


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(RATE * g.sum() / (h.sum() + 1.0))


def _grow(codes: np.ndarray, values: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> Split | float:
    best, cut = 1e-6, None
    gain = lambda a, b: a**2 / (b + 1.0)
    for j, bounds in enumerate(values if depth else ()):
        n, a, b = (np.bincount(codes[:, j], w, len(bounds)).cumsum() for w in (None, g, h))
        won = np.where((n > 0) & (n < n[-1]), gain(a, b) + gain(a[-1] - a, b[-1] - b) - gain(a[-1], b[-1]), 0.0)
        k = int(won.argmax())
        if won[k] > best:
            best, cut = won[k], (j, k)
    if cut is None:
        return _leaf(g, h)
    j, k = cut
    low = codes[:, j] <= k
    return Split(j, float(values[j][k]), _grow(codes[low], values, g[low], h[low], depth - 1), _grow(codes[~low], values, g[~low], h[~low], depth - 1))


def _apply(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.bound, _apply(tree.below, x), _apply(tree.above, x))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS, depth: int = 3) -> list[Split | float]:
    """Trees on rows of x that count `weight` times each."""
    weight = np.ones(len(y)) if weight is None else weight
    values, codes = zip(*(np.unique(c, return_inverse=True) for c in x.T), strict=True)
    codes = np.stack(codes, axis=1)
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(codes, values, weight * (y - p), weight * p * (1 - p), depth))
        score += _apply(trees[-1], x)
    return trees


def _column(tree: Split | float, f: list[Column]) -> Column:
    if not isinstance(tree, Split):
        return F.lit(tree)
    return F.when(f[tree.feature] <= tree.bound, _column(tree.below, f)).otherwise(_column(tree.above, f))


def training_texts(n: int = MADE, seed: int = 7) -> list[tuple[int, str, int, int, int]]:
    """(id, text, label, start, end): made-up values in made-up prose; label 1 marks personal data and secrets."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    words = lambda k: " ".join(pick(low, r.randint(2, 9)) for _ in range(k))
    date = lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    good = [
        lambda: (r.choice(["password=", "password: ", "api_key=", "token: ", "secret ", "pwd="]), pick(hexa if r.random() < 0.5 else low + up + dig, r.randint(10, 40))),
        lambda: ("", "AKIA" + pick(up + dig, 16)),
        lambda: (r.choice(["", "key "]), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (r.choice(["", "auth "]), pick(low + up + dig + "_-", r.randint(24, 60))),
        lambda: (r.choice(["ssn ", "ssn: ", "account ", "passport no ", "id "]), f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}" if r.random() < 0.5 else pick(dig, r.randint(9, 14))),
        lambda: (r.choice(["card ", "iban "]), " ".join(pick(dig, 4) for _ in range(r.randint(3, 5)))),
        lambda: ("", f"{pick(low, 5)}.{pick(low, 6)} {r.choice(['(at)', '[at]'])} {pick(low, 7)}{r.choice([' (dot) ', '.', ' [dot] '])}com"),
    ]
    bad = [
        lambda: ("", f"{pick(low, r.randint(5, 12))}{r.randint(1, 2030)}"),
        lambda: ("", f"{date()}-{pick(low, 6)}"),
        lambda: ("on ", date()),
        lambda: ("", f"{r.randint(1, 99)}.{r.randint(100, 999)}.{r.randint(100, 999)}.00"),
        lambda: ("", f"{r.randint(1, 9)} {r.randint(100, 999)} {r.randint(100, 999)} {r.randint(100, 999)}"),
        lambda: ("", f"{pick(low, 4)}-{pick(low, 5)}-{r.randint(1, 99)}-{pick(low, 5)}"),
        lambda: ("", f"{pick(low, 6)}/{pick(low, 5)}/{r.randint(1, 3000)}"),
        lambda: ("", " ".join(str(r.randint(10, 99)) for _ in range(r.randint(4, 9)))),
        lambda: ("", f"{date()} {r.randint(10, 23)}.{r.randint(10, 59)}"),
    ]
    out = []
    for i in range(n):
        label = i % 2
        hint, value = r.choice(good if label else bad)()
        head = f"{words(r.randint(1, 12))} {hint}"
        out.append((i, f"{head}{value} {words(r.randint(1, 12))}", label, len(head), len(head) + len(value)))
    return out


@dataclass(frozen=True)
class Model:
    trees: list
    thresholds: dict[str, float]

    def score(self, f: dict[str, Column]) -> Column:
        def total(x: Column) -> Column:
            cols = [F.get(x, i) for i in range(len(FEATURES))]
            return sum((_column(t, cols) for t in self.trees), F.lit(0.0))

        return 1 / (1 + F.exp(-_let(F.array(*(f[k] for k in FEATURES)), total)))


_fitted: dict[tuple, Model] = {}


def _spans(rows: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, weak, the features) of the candidates apart from base spans."""
    found = candidates(rows).select("doc_id", "text", _apart(F.col("more"), F.col("base")).alias("more"))

    def described(pieces: Column, s: Column) -> Column:
        before = _cut(pieces, F.greatest(s["start"] - 24, F.lit(0)), s["start"])
        weak = F.coalesce(*(F.when(s["kind"] == k, before.rlike(p)) for k, p in WEAK.items()))
        return F.struct(*(s[k].alias(k) for k in ("kind", "start", "end")), weak.alias("weak"), *(c.alias(k) for k, c in features(pieces, s).items()))

    every = _let(_pieces(F.col("text")), lambda pieces: F.transform("more", lambda s: described(pieces, s)))
    return found.select("doc_id", F.explode(F.when(F.size("more") > 0, every)).alias("s")).select("doc_id", "s.*")


def _steps(x: np.ndarray) -> np.ndarray:
    """Each feature as the least of its edges that is not below it, or the last of them."""
    return np.stack([e[np.minimum(np.searchsorted(e, c), len(e) - 1)] for e, c in zip(EDGES.values(), x.T, strict=True)], axis=1)


def _step(value: Column, edges: np.ndarray) -> Column:
    """The place among edges that `_steps` gives a value."""
    return _let(value, lambda v: F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[:-1])), lambda e: e < v)))


def tally(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cell, count) of all candidates in all of docs; a cell is the flat index into SHAPE. Equal texts (by 64-bit hash) count once.

    Null texts have no candidates; an empty table gives an empty one.
    """
    spans = _spans(docs.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")))
    cell = (F.pmod("doc_id", F.lit(3)) == 2).cast("long") * 2 + F.col("weak").cast("long")
    for k in CELL[2:]:
        cell = cell * len(EDGES[k]) + _step(F.col(k), EDGES[k])
    return spans.select("doc_id", "start", cell.alias("cell")).distinct().groupBy("cell").count()


def fit(spark: SparkSession, docs: DataFrame | None = None, made: int = MADE, seed: int = 7, text: str = "text") -> Model:
    """The trees, and for each further kind the least threshold with PRECISION on the third held out.

    Every candidate of the documents counts, those of equal texts once. The made-up candidates count
    once each too, or where the documents have more of them, as much as these in all. Null texts, and
    no documents at all, leave the made-up texts.
    """
    if docs is None and (made, seed) in _fitted:
        return _fitted[made, seed]
    texts = training_texts(made, seed)
    got = _spans(spark.createDataFrame([(i, t) for i, t, *_ in texts], "doc_id long, text string")).collect()
    got.sort(key=lambda g: (g.doc_id, g.kind, g.start))
    x = _steps(np.array([[g[k] for k in FEATURES] for g in got], dtype=np.float64))
    y = np.array([float(texts[g.doc_id][2] and g.start < texts[g.doc_id][4] and texts[g.doc_id][3] < g.end) for g in got])
    third = np.array([g.doc_id % 6 >= 4 for g in got])
    weight = np.ones(len(got))
    if docs is not None and (cells := tally(docs, text).toArrow()).num_rows:
        cell, n = (cells[c].to_numpy() for c in cells.column_names)
        order = cell.argsort()
        own = dict(zip(CELL, np.unravel_index(cell[order], SHAPE), strict=True))
        x = np.concatenate([x, np.stack([EDGES[k][own[k]] if k in own else np.zeros(len(cell)) for k in FEATURES], axis=1)])
        y, third = np.append(y, own["weak"]), np.append(third, own["held"] == 1)
        weight = np.append(weight * max(1.0, n.sum() / len(got)), n[order])
    kinds = np.where(x[:, 0] == 1, "secret", np.where(x[:, 1] == 1, "number", "contact"))
    trees = boost(x[~third], y[~third], weight[~third])
    p = 1 / (1 + np.exp(-sum(_apply(t, x) for t in trees)))
    bounds = {}
    for kind in MORE:
        own = third & (kinds == kind)
        bounds[kind] = 1.0
        for bound in sorted({0.5, *np.round(p[own & (p >= 0.5)], 3)}, reverse=True):
            hit = own & (p >= bound)
            if hit.any() and np.average(y[hit], weights=weight[hit]) >= PRECISION:
                bounds[kind] = float(bound)
    model = Model(trees, bounds)
    if docs is None:
        _fitted[made, seed] = model
    return model


def _best(spans: Column) -> Column:
    """Of spans with a score, in order of their starts, those that no overlapping neighbour beats; ties go to the first."""

    def beaten(xs: Column, x: Column, i: Column, step: int) -> Column:
        y = F.get(xs, i + step)  # null outside of the array
        better = y["score"] > x["score"] if step > 0 else y["score"] >= x["score"]
        return F.coalesce((y["start"] < x["end"]) & (x["start"] < y["end"]) & better, F.lit(False))

    def keep(xs: Column) -> Column:
        marked = F.transform(xs, lambda x, i: F.struct(x.alias("x"), (beaten(xs, x, i, -2) | beaten(xs, x, i, -1) | beaten(xs, x, i, 1) | beaten(xs, x, i, 2)).alias("beaten")))
        return F.transform(F.filter(marked, lambda m: ~m["beaten"]), lambda m: m["x"])

    return _let(spans, keep)


def find_pii(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, base, spans, row): spans are base and the accepted others, by kind as in KINDS and start.

    A null text is empty and has no spans; a null id is kept. Repeated rows are each returned; an
    empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    model = model or fit(docs.sparkSession, docs, text=text)
    rows = candidates(docs, doc_id, text)
    bound = F.create_map(*(F.lit(x) for kv in model.thresholds.items() for x in kv))
    rows = rows.select("doc_id", "text", "row", "base", _apart(F.col("more"), F.col("base")).alias("more"))
    rows = rows.withColumn("pieces", F.when(F.size("more") > 0, _pieces(F.col("text"))))
    def scored(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"), model.score(features(F.col("pieces"), x)).alias("score"))

    taken = F.filter(_best(F.array_sort(F.transform("more", scored))), lambda x: x["score"] >= F.element_at(bound, x["kind"]))
    taken = F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    rows = rows.select("doc_id", "text", "row", "base", F.when(F.size("more") > 0, taken).alias("taken"))
    bykind = F.concat(*(_of_kind(k, "taken") for k in MORE))
    return rows.select("doc_id", "text", "row", "base", F.when(F.size("taken") > 0, F.concat("base", bykind)).otherwise(F.col("base")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    inorder = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def joined(xs: Column, ends: Column, pieces: Column) -> Column:
        last = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        gaps = F.transform(xs, lambda x, i: F.when(x["start"] >= last(i), F.concat(_cut(pieces, last(i), x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit("")))
        return F.concat(F.array_join(gaps, ""), _cut(pieces, F.element_at(ends, -1), F.length(text)))

    made = _let(inorder, lambda xs: _let(_running(F.transform(xs, lambda x: x["end"]), F.greatest), lambda ends: _let(_pieces(text), lambda pieces: joined(xs, ends, pieces))))
    return F.when(F.size(spans) == 0, text).otherwise(made)


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", model: Model | None = None) -> DataFrame:
    """docs with redacted texts, and the length in n_chars, if it is there, set anew; a null text stays null."""
    rows = find_pii(docs, model, doc_id, text)
    rows = rows.select("row", F.when(F.col("row")[text].isNotNull(), redact(F.col("text"), F.col("spans"))).alias("clean"))
    new = {text: F.col("clean"), n_chars: F.length("clean").cast(docs.schema[n_chars].dataType) if n_chars in docs.columns else None}
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str, spans: str = "base") -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op5(docs: DataFrame) -> DataFrame:
    """Counts and digests of what `find_pii` finds in each row; odd rows are as there."""
    rows = find_pii(docs)
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
