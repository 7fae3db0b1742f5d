"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees are grown on resampled labelled rows; every path from a root is a
conjunctive rule. A logistic model with an L1 penalty picks and weighs rules,
the penalty by a held-back fifth of the training rows, and the rules become
one Spark column expression over the statistics.

Statistics cover whole texts of all documents. Trees and weights are fitted on
at most ``MOST`` labelled rows, those with the smallest hash of doc_id. Labels,
lang, source and doc_id are not inputs of a score.

Null and empty texts have statistics of 0 and get a score. Rows with a null
label are not learned from; repeated labels of a document count by majority.
Without both labels among the training rows the score is their smoothed mean.
Rows with a null doc_id count as doc_id ''. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, workspace
from .langid import held_out

MOST = 20_000
TREES, DEPTH, LEAST, CUTS = 40, 3, 20, 24
THRESHOLD = 0.3
STATS = ("chars", "words", "word_len", "upper", "digits", "symbols", "bangs", "other", "blanks", "stops", "line_words", "repeated_lines", "repeated_words", "marked_words", "capital_words")
_UPPER = kernels.byte_class((0x41, 0x5A))
_DIGIT = kernels.byte_class((0x30, 0x39))
_STOP = np.isin(np.arange(256), list(b".,;:"))
_BANG = np.isin(np.arange(256), list(b"!?"))
_QUIET = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_SYMBOL = kernels.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & ~_QUIET
_OTHER = kernels.byte_class((0x80, 0xFF))
_BLANK = ~kernels.NONBLANK
_LINE = ~np.isin(np.arange(256), list(b"\n\r"))


def _distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    order = np.lexsort((hashes, doc)) if len(doc) else np.zeros(0, dtype=np.int64)
    h, d = hashes[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    return np.bincount(d[new].astype(np.int64), minlength=len(at) - 1)


def measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The statistics of each text, in the order of STATS."""
    n = len(offsets) - 1

    def per_text(table):
        return np.diff(np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))[offsets])

    size = np.diff(offsets)
    starts, ends = kernels.runs(kernels.NONBLANK[data], offsets)
    at = np.searchsorted(starts, offsets)
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    lines, line_ends = kernels.runs(_LINE[data], offsets)
    line_at = np.searchsorted(lines, offsets)
    n_lines = np.diff(line_at)
    marked = np.bincount(doc[_SYMBOL[data[ends - 1]]], minlength=n) if len(doc) else np.zeros(n)
    capital = np.bincount(doc[_UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, ends - 1)]] & (ends - starts > 1)], minlength=n) if len(doc) else np.zeros(n)
    by_size, by_words = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    return [
        size.astype(float), words.astype(float), np.bincount(doc, weights=ends - starts, minlength=n) * by_words,
        per_text(_UPPER) * by_size, per_text(_DIGIT) * by_size, per_text(_SYMBOL) * by_size, per_text(_BANG) * by_size, per_text(_OTHER) * by_size, per_text(_BLANK) * by_size, per_text(_STOP) * by_words,
        words / np.maximum(n_lines, 1), 1 - _distinct(kernels.hash_runs(data, lines, line_ends), line_at) / np.maximum(n_lines, 1) * (n_lines > 0) - (n_lines == 0),
        (words - _distinct(kernels.hash_runs(kernels.LOWER[data], starts, ends), at)) * by_words, marked * by_words, capital * by_words,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernels.utf8_slices(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *[pa.array(np.asarray(v, dtype=np.float64)) for v in measures(data, offsets)]], names=["doc_id", *STATS])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(work, plain.select("doc_id", *[F.lit(0.0).alias(s) for s in STATS]).schema)


def grow(x: np.ndarray, y: np.ndarray, seed: int, trees: int = TREES) -> list[tuple]:
    """Rules of trees on resampled rows: tuples of (statistic, above, cut)."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rules: dict[tuple, None] = {}

    def split(rows, path):
        if len(path) == DEPTH or len(rows) < 2 * LEAST or y[rows].min() == y[rows].max():
            return
        best, where = 1e-9, None
        whole = y[rows].mean() * (1 - y[rows].mean()) * len(rows)
        for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
            m = len(cuts[f]) + 1
            n = np.cumsum(np.bincount(bins[rows, f], minlength=m))[:-1]
            s = np.cumsum(np.bincount(bins[rows, f], weights=y[rows], minlength=m))[:-1]
            n2, s2 = len(rows) - n, y[rows].sum() - s
            ok = (n >= LEAST) & (n2 >= LEAST)
            gain = np.where(ok, whole - (s - s * s / np.maximum(n, 1)) - (s2 - s2 * s2 / np.maximum(n2, 1)), 0)
            if len(gain) and gain.max() > best:
                best, where = gain.max(), (f, int(gain.argmax()))
        if where is None:
            return
        f, k = where
        high = bins[rows, f] > k
        for above in (False, True):
            step = tuple(sorted({*path, (int(f), above, float(cuts[f][k]))}))
            rules.setdefault(step)
            split(rows[high == above], step)

    for _ in range(trees):
        split(rng.integers(0, len(y), size=min(len(y), 4000)), ())
    return list(rules)


def holds(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=bool)
    for k, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, k] &= (x[:, f] > cut) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start=None, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model, by accelerated proximal gradient steps."""
    n, m = r.shape
    b, w = (np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), np.zeros(m)) if start is None else start
    v, u, t = w.copy(), b, 1.0
    rate = 4.0 / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 / n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(r @ v + u, -30, 30)))
        g = (p - y) / n
        step = v - rate * (r.T @ g)
        w2 = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        b2 = u - rate * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        done = np.abs(w2 - w).max(initial=0) < 1e-6
        w, b, t = w2, b2, t2
        if done:
            break
    return float(b), w


class Rules:
    """Rules with their weights and the intercept."""

    def __init__(self, rules: list[tuple], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def column(self) -> Column:
        """The score as a Spark expression over the columns STATS."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            conds = [F.col(STATS[f]) > cut if above else F.col(STATS[f]) <= cut for f, above, cut in rule]
            both = conds[0]
            for c in conds[1:]:
                both = both & c
            total = total + F.when(both, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Rules:
    mean = (y.sum() + 1) / (len(y) + 2)
    plain = Rules([], [], float(np.log(mean / (1 - mean))))
    if len(y) < 4 * LEAST or y.min() == y.max():
        return plain
    rules = grow(x, y, seed)
    if not rules:
        return plain
    r = holds(rules, x)
    _, first = np.unique(np.packbits(r, axis=0), axis=1, return_index=True)
    rules, r = [rules[k] for k in sorted(first)], r[:, sorted(first)].astype(np.float64)
    scale = np.maximum(np.sqrt(r.mean(axis=0) * (1 - r.mean(axis=0))), 0.02)
    z = r / scale
    test = np.random.default_rng(seed).random(len(y)) < 0.2
    if y[test].min() == y[test].max() or y[~test].min() == y[~test].max():
        test = np.zeros(len(y), dtype=bool)
        test[: len(y) // 5] = True
    best, start, chosen = np.inf, None, 1e-3
    for penalty in np.geomspace(3e-2, 1e-4, 8):
        start = lasso(z[~test], y[~test], penalty, start, 150)
        p = 1 / (1 + np.exp(-np.clip(z[test] @ start[1] + start[0], -30, 30)))
        loss = -np.mean(y[test] * np.log(p + 1e-9) + (1 - y[test]) * np.log(1 - p + 1e-9))
        if loss < best - 1e-4:
            best, chosen = loss, penalty
    b, w = lasso(z, y, chosen, start)
    keep = np.flatnonzero(w)
    return Rules([rules[k] for k in keep], [float(w[k] / scale[k]) for k in keep], b)


def fit(stats: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5, label: str = "quality") -> Rules:
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(fold, of)).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST)
    got = stats.join(F.broadcast(some), "doc_id").select("doc_id", *STATS, "_y").toArrow().sort_by("doc_id")
    x = np.stack([got[s].to_numpy() for s in STATS], axis=1) if got.num_rows else np.zeros((0, len(STATS)))
    return fit_rules(x, got["_y"].to_numpy() if got.num_rows else np.zeros(0))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    stats = workspace.materialize(statistics(docs), "statistics")
    score = fit(stats, labels, fold, of).column()
    return stats.select("doc_id", held_out(fold, of).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
