"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a token after its predecessor mixes the maximum-likelihood
bigram and unigram estimates and a uniform share. The mixture depends on the
bucket of the predecessor's frequency (a power of 2). Expectation-maximisation
learns the weights on held-out counts: each training token in turn is deleted
from the counts that predict it.

Counts cover all training tokens. Documents are cut into segments; a segment
sends each different unigram and bigram key once, with its own count, to the
bucket of the key; the bucket adds up and answers in the order asked. A key is
a 64-bit hash. Segments and answers meet once; the per-token counts that come
of it are kept packed, and both the mixture and the scores are taken from them.
A frequent word is one key a segment, so no bucket is hot.

Tokens: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end a document.
Null or empty text: the end alone. Null doc_id counts as doc_id ''. Repeated
rows count as often as they come. Without training rows all counts are 0, the
vocabulary is empty and the uniform share has all the weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, workspace
from .langid import held_out

#: Hashes that stand for the end of a text, and for the place before its first token.
END, BEGIN = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
SEGMENT_BYTES = 8 << 20
BUCKET_TOKENS = 2_000_000
#: Steps of a halving in which estimates are binned for expectation-maximisation.
STEPS, ROUNDS = 8, 100


def _press(x: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpress(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _press_sorted(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64))


def _unpress_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpress(b, "u8"), dtype=np.uint64)


def segments(docs: DataFrame, fold: int, of: int) -> DataFrame:
    """A row per segment: doc_ids, train flags, the first token of each text, the segment's words and its tokens as numbers of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            train = batch["train"].to_numpy(zero_copy_only=False)
            for a, b, data, offsets in kernels.utf8_slices(batch["text"], SEGMENT_BYTES):
                hashes, at = kernels.words(data, offsets, kernels.NONBLANK)
                at = at + np.arange(len(at))
                flat = np.empty(at[-1], dtype=np.uint64)
                last = np.zeros(at[-1], dtype=bool)
                last[at[1:] - 1] = True
                flat[last], flat[~last] = END, hashes
                words, seq = np.unique(flat, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{k}"]), pa.array([batch["doc_id"].slice(a, b - a).to_pylist()], type=pa.list_(pa.int64())), pa.array([train[a:b].tolist()], type=pa.list_(pa.bool_())), pa.array([at.tolist()], type=pa.list_(pa.int64())), pa.array([int(at[-1])]), pa.array([_press_sorted(words)]), pa.array([_press(seq.astype(np.uint32))])],
                    names=["segment", "doc_ids", "train", "token_at", "tokens", "words", "seq"],
                )
                k += 1

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (~held_out(fold, of)).alias("train"))
    return plain.mapInArrow(work, "segment string, doc_ids array<bigint>, train array<boolean>, token_at array<bigint>, tokens bigint, words binary, seq binary")


def _opened(row: dict) -> tuple:
    """token_at, train flag of each token, words, seq, bigram keys (sorted, different) and the bigram of each token."""
    at = np.array(row["token_at"], dtype=np.int64)
    train = np.repeat(np.array(row["train"], dtype=bool), np.diff(at))
    words, seq = _unpress_sorted(row["words"]), _unpress(row["seq"], "u4")
    flat = words[seq]
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[at[:-1]] = BEGIN
    pairs, which = np.unique(kernels.mix(before * np.uint64(0x9E3779B97F4A7C15) + flat), return_inverse=True)
    return at, train, words, seq, pairs, which


def _asked(segs: DataFrame, buckets: int) -> DataFrame:
    """Each segment's keys with its own training counts, by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, train, words, seq, pairs, which = _opened(row)
                for kind, keys, ids in ((1, words, seq), (2, pairs, which)):
                    counts = np.bincount(ids[train], minlength=len(keys)).astype(np.uint32)
                    cuts = np.searchsorted(keys, _edges(buckets))
                    some = [(b, i, j) for b, (i, j) in enumerate(zip(cuts, np.append(cuts[1:], len(keys)))) if i < j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _, _ in some], type=pa.int32()), pa.array([row["segment"]] * len(some), type=pa.string()), pa.array([kind] * len(some), type=pa.int32()), pa.array([_press_sorted(keys[i:j]) for _, i, j in some], type=pa.binary()), pa.array([_press(counts[i:j]) for _, i, j in some], type=pa.binary())],
                        names=["bucket", "segment", "kind", "keys", "counts"],
                    )

    return segs.select("segment", "train", "token_at", "words", "seq").mapInArrow(work, "bucket int, segment string, kind int, keys binary, counts binary")


def _edges(buckets: int) -> np.ndarray:
    """The first key of each bucket of the key space."""
    return np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)


def _answered(asked: DataFrame) -> DataFrame:
    """The total counts for each asked row, and a row per bucket and kind with its distinct keys and total."""

    def work(table: pa.Table) -> pa.Table:
        out = []
        bucket = table["bucket"][0].as_py()
        for kind in (1, 2):
            rows = table.filter(pa.compute.equal(table["kind"], kind))
            if not rows.num_rows:
                continue
            keys = [_unpress_sorted(b) for b in rows["keys"].to_pylist()]
            counts = np.concatenate([_unpress(b, "u4") for b in rows["counts"].to_pylist()])
            found, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, weights=counts, minlength=len(found)).astype(np.int64)
            ends = np.cumsum([len(k) for k in keys])
            for seg, e, k in zip(rows["segment"].to_pylist(), ends, keys):
                out.append((bucket, seg, kind, _press(total[which[e - len(k) : e]]), 0, 0))
            out.append((bucket, None, kind, b"", int((total > 0).sum()), int(total.sum())))
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=["bucket", "segment", "kind", "totals", "types", "total"])

    return asked.groupBy("bucket").applyInArrow(work, "bucket int, segment string, kind int, totals binary, types bigint, total bigint")


class Corpus:
    """Totals of the training tokens: n, different ones, documents."""

    def __init__(self, n: int, types: int, docs: int):
        self.n, self.types, self.docs = n, types, docs


def _counted(segs: DataFrame, answers: DataFrame, corpus: Corpus) -> DataFrame:
    """Per segment the training counts of each token and bigram, and the binned estimates of its training tokens with themselves deleted."""
    gathered = answers.filter("segment is not null").groupBy("segment").agg(F.collect_list(F.struct("kind", "bucket", "totals")).alias("got"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, train, words, seq, pairs, which = _opened(row)
                totals = {kind: np.concatenate([_unpress(x["totals"], "i8") for x in sorted(row["got"], key=lambda x: x["bucket"]) if x["kind"] == kind] or [np.zeros(0, dtype=np.int64)]) for kind in (1, 2)}
                one, two = totals[1][seq], totals[2][which]
                bins, n = _bins(at, train, one, two, corpus)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"]], type=pa.list_(pa.int64())), pa.array([row["train"]], type=pa.list_(pa.bool_())), pa.array([row["token_at"]], type=pa.list_(pa.int64())), pa.array([_press(one)]), pa.array([_press(two)]), pa.array([bins.tolist()], type=pa.list_(pa.int64())), pa.array([n.tolist()], type=pa.list_(pa.int64()))],
                    names=["doc_ids", "train", "token_at", "one", "two", "bins", "n"],
                )

    joined = segs.select("segment", "doc_ids", "train", "token_at", "words", "seq").join(gathered, "segment")
    return joined.mapInArrow(work, "doc_ids array<bigint>, train array<boolean>, token_at array<bigint>, one binary, two binary, bins array<bigint>, n array<bigint>")


def _context(at: np.ndarray, one: np.ndarray, docs: int) -> np.ndarray:
    out = np.empty_like(one)
    out[1:] = one[:-1]
    out[at[:-1]] = docs
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the binary logarithm."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))) + 1, 1023), 0).astype(np.int64)


def _bins(at, train, one, two, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    context = _context(at, one, corpus.docs)[train] - 1
    p2 = (two[train] - 1) / np.maximum(context, 1)
    p1 = (one[train] - 1) / max(1, corpus.n - 1)
    return np.unique((bucket_of(context) << 20) + (_level(p2) << 10) + _level(p1), return_counts=True)


def learn(bins: np.ndarray, n: np.ndarray, types: int) -> np.ndarray:
    """Weights of bigram, unigram and uniform share for each context bucket, by expectation-maximisation over binned estimates."""
    out = np.zeros((65, 3))
    out[:, 1:] = (0.9, 0.1) if len(bins) else (0.0, 1.0)
    bucket = bins >> 20
    p = np.stack([np.where(level > 0, np.exp2(-(level - 1) / STEPS), 0.0) for level in (bins >> 10 & 1023, bins & 1023)] + [np.full(len(bins), 1 / (types + 1))], axis=1)
    for b in range(65):
        own = bucket == b
        if not own.any():
            continue
        q, w = p[own], n[own] + 0.0
        lam = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(ROUNDS):
            share = q * lam
            share *= (w / share.sum(axis=1))[:, None]
            new = share.sum(axis=0) / w.sum()
            moved, lam = np.abs(new - lam).max(), new
            if moved < 1e-7:
                break
        lam = np.maximum(lam, [0.0, 0.0, 1e-6])
        out[b] = lam / lam.sum()
    for b in range(1, 65):  # a bucket without held-out tokens takes the weights of the one below
        if not (bucket == b).any() and b > 1:
            out[b] = out[b - 1]
    return out


def _scored(counted: DataFrame, corpus: Corpus, weights: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["token_at"], dtype=np.int64)
                one, two = _unpress(row["one"], "i8"), _unpress(row["two"], "i8")
                context = _context(at, one, corpus.docs)
                lam = weights[bucket_of(context)]
                p = lam[:, 0] * two / np.maximum(context, 1) + lam[:, 1] * one / max(1, corpus.n) + lam[:, 2] / (corpus.types + 1)
                base = np.log10((one + 0.5) / (corpus.n + 0.5 * (corpus.types + 1)))
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                sums = [np.bincount(doc, weights=v, minlength=len(at) - 1) for v in (one > 0, base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], type=pa.int64()), pa.array([not t for t in row["train"]], type=pa.bool_()), pa.array(np.diff(at)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(at) - 1, corpus.n, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.select("doc_ids", "train", "token_at", "one", "two").mapInArrow(work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(docs: DataFrame, fold: int = 1, of: int = 5) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    segs = workspace.materialize(segments(docs, fold, of), "segments", "none")
    tokens, train_docs = segs.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.expr("cast(size(filter(train, t -> t)) as bigint)")), F.lit(0))).first()
    buckets = max(workspace.partitions(spark), -(-tokens // BUCKET_TOKENS))
    answers = workspace.materialize(_answered(_asked(segs, buckets)), "answers", "none")
    totals = answers.filter("segment is null and kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    corpus = Corpus(totals[0], totals[1], train_docs)
    counted = workspace.materialize(_counted(segs, answers, corpus), "counted", "none")
    binned = counted.select(F.explode(F.arrays_zip("bins", "n")).alias("x")).groupBy(F.col("x.bins").alias("bin")).agg(F.sum("x.n").alias("n")).toArrow()  # at most a row for each bin
    order = np.argsort(binned["bin"].to_numpy())
    return _scored(counted, corpus, learn(binned["bin"].to_numpy()[order], binned["n"].to_numpy()[order], corpus.types))
