"""Language ID by hierarchical discrimination.

A text is a vector of hashed byte trigrams of its lower-cased letters (square
roots of counts, length 1). Linear support vector machines tell the language
family first, one family against the others; within the family a machine for
each pair of languages votes. Margins become probabilities by a logistic fit;
the score is the family's probability times the language's mean probability
against each other one of the family, which is near 1 for a sure text in a
family of any size.

Training takes about ``QUOTA`` whole texts of every language, chosen by hash, and
about ``MOST`` in all: fewer a language where there are many languages, but one is
always expected. Every whole text is scored; a very long one takes the memory of
its bytes a few times over.

Null text, or text without a letter: ``und``, score 0. Without training rows
every text is ``und``; with one learned language all texts with a letter get it.
Null lang is not learned from. Repeated rows are scored alike. Rows with a null
doc_id count as doc_id ''. Other columns are ignored, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, workspace

BITS = 12
QUOTA, MOST = 600, 12_000
#: A text whose language is told with less is rejected by keep_known.
LEAST = 0.25
ROWS = 512
#: Families by ISO 639-1 code; a language not listed is a family of its own. Fixed values.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "as bn gu hi mr ne or pa si ur",
    "semitic": "am ar he mt ti",
    "celtic": "br cy ga gd gv",
    "baltic": "lt lv",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def held_out(fold: int, of: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(of)) == fold


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text; no more than some thousand texts at once."""
    n = len(offsets) - 1
    size = 1 << BITS
    low = _FOLD[data]
    if len(low) > 1:  # capital letters U+00C0 to U+00DE
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        low[second] += 0x20
    if len(low) < 3:
        return np.zeros((n, size), dtype=np.float32)
    a, b, c = (low[k : len(low) - 2 + k].astype(np.uint32) for k in range(3))
    slot = ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.flatnonzero((b != 0x20) & (doc[:-2] == doc[2:]))
    out = np.sqrt(np.bincount(doc[keep] * size + slot[keep], minlength=n * size).reshape(n, size)).astype(np.float32)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in kernels.utf8_slices(column):
        for i in range(a, b, ROWS):
            j = min(b, i + ROWS)
            lo = offsets[i - a]
            yield i, j, data[lo : offsets[j - a]], offsets[i - a : j - a + 1] - lo


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with hinge loss, by dual coordinate descent; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    most = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, alpha, square = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(y)), (x * x).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), most[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit_odds(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with smoothed labels."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    """Families, their languages, and the weights of all machines side by side."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs))
        family = np.array([_FAMILY_OF.get(v.split("-")[0].lower(), v) for v in langs])
        self.families = sorted(set(family))
        self.members = [[k for k, v in enumerate(self.langs) if _FAMILY_OF.get(v.split("-")[0].lower(), v) == f] for f in self.families]
        columns, self.odds, self.pairs = [], [], []
        if len(self.families) > 1:
            for f in self.families:
                self._add(columns, x, np.where(family == f, 1.0, -1.0))
        for own in self.members:
            for i, j in combinations(own, 2):
                both = np.flatnonzero((langs == self.langs[i]) | (langs == self.langs[j]))
                self.pairs.append((i, j))
                self._add(columns, x[both], np.where(langs[both] == self.langs[i], 1.0, -1.0))
        self.weights = np.array(columns, dtype=np.float32).T if columns else np.zeros((x.shape[1] + 1, 0), dtype=np.float32)

    def _add(self, columns, x, y):
        w = fit_svm(x, y)
        columns.append(w)
        self.odds.append(fit_odds(x @ w[:-1] + w[-1], y))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score of each row."""
        n, first = len(x), len(self.families) if len(self.families) > 1 else 0
        margin = x @ self.weights[:-1] + self.weights[-1]
        odds = np.array(self.odds).reshape(-1, 2)
        p = 1 / (1 + np.exp(-np.clip(margin * odds[:, 0] + odds[:, 1], -30, 30)))
        family = np.argmax(margin[:, :first], axis=1) if first else np.zeros(n, dtype=np.int64)
        sure = p[np.arange(n), family] / p[:, :first].sum(axis=1) if first else np.ones(n)
        votes, share = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            won = margin[:, first + k] >= 0
            votes[:, i] += won
            votes[:, j] += ~won
            share[:, i] += p[:, first + k]
            share[:, j] += 1 - p[:, first + k]
        out, score = np.zeros(n, dtype=np.int64), np.zeros(n)
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            if len(own) == 1:
                out[rows], score[rows] = own[0], sure[rows]
            elif len(rows):
                best = np.argmax(votes[np.ix_(rows, own)] + 1e-3 * share[np.ix_(rows, own)], axis=1)
                out[rows] = np.array(own)[best]
                score[rows] = sure[rows] * share[rows, out[rows]] / (len(own) - 1)
        return out, np.clip(score, 0, 1)


def fit(docs: DataFrame, fold: int = 2, of: int = 4) -> Model | None:
    """Learn from text and lang of the rows of ``docs`` outside the fold."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & ~held_out(fold, of))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    quota = min(QUOTA, max(1, MOST // len(counts)))
    shares = docs.sparkSession.createDataFrame([(k, min(1 << 30, int(quota / n * (1 << 30)))) for k, n in counts.items()], "lang string, _share bigint")
    chosen = known.join(F.broadcast(shares), "lang").filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < F.col("_share")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch["text"]):
                x = vectors(data, offsets)
                spots = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(a, b - a), pa.array([s.astype("<u2").tobytes() for s in spots], type=pa.binary()), pa.array([x[k, s].tobytes() for k, s in enumerate(spots)], type=pa.binary())], names=["lang", "spots", "values"])

    got = chosen.select("text", "lang").mapInArrow(work, "lang string, spots binary, values binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("spots", "ascending")])
    x = np.zeros((got.num_rows, 1 << BITS), dtype=np.float32)
    for k, (s, v) in enumerate(zip(got["spots"].to_pylist(), got["values"].to_pylist())):
        x[k, np.frombuffer(s, dtype="<u2")] = np.frombuffer(v, dtype=np.float32)
    return Model(x, np.array(got["lang"].to_pylist(), dtype=object))


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` (with text) and lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in keep if c != "text"], F.col("text").cast("string").alias("text"))
    schema = kept.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch["text"]
            lang, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            for a, b, data, offsets in slices(texts) if model else ():
                letters = np.concatenate(([0], np.cumsum(kernels.ASCII_LETTER[data])))
                has = np.diff(letters[offsets]) > 0
                for k in np.flatnonzero(~has):
                    has[k] = any(map(str.isalpha, bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")))
                found, sure = model.predict(vectors(data, offsets))
                lang[a:b][has] = np.array(model.langs, dtype=object)[found[has]]
                score[a:b][has] = sure[has]
            if texts.null_count:
                none = pc.is_null(texts).to_numpy(zero_copy_only=False)
                lang[none], score[none] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + [pa.array(lang, type=pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(work, schema)


def keep_known(docs: DataFrame, least: float = LEAST, fold: int = 2, of: int = 4) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more, with their own columns."""
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*workspace.own(docs, ("text",))).alias("rest"))
    told = predict(packed, fit(docs, fold, of), ("rest", "text")).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return told.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def identify(docs: DataFrame, fold: int = 2, of: int = 4) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs, fold, of))
    return out.select("doc_id", held_out(fold, of).alias("held_out"), "lang_pred", "score")
