"""Near-duplicate classes by Order MinHash.

A text is its sequence of five-word shingles (lower-cased alphanumeric words;
a text of fewer words is one shingle), each labelled with its occurrence number.
A sketch takes the ``PICK`` labelled shingles of smallest hash and keeps them
in text order, so texts meet in a sketch only if those shingles agree and stand
in the same order. ``SKETCHES`` sketches make the candidate buckets; two texts
whose shingles have a Jaccard similarity of 0.8 miss each other in all of them with
a chance of 3e-11, of 0.5 with 1e-3, of 0.4 with 1.5e-2.

Candidates are verified by banded alignment. Two texts are alike if their words
have an edit similarity 1 - d / max(a, b) of 0.8 or more, where d counts words put
in, left out or exchanged, in the band of diagonals that the threshold leaves; or
if the longest ascending chain of m common shingles within that band gives an
ordered Jaccard similarity m / (a + b - m) of 0.8 or more.

Texts that are equal are collapsed first. The members of a bucket are first
linked to the text that shares most sketches with others. Buckets that then
hold different classes, but at most ``FEW`` pairs of them a member, are left for the
comparison of all pairs in the end. The others are cut by the length of their texts,
as alike ones differ by no more than the threshold allows; where many pairs remain,
members are compared with one leader only, the shortest text b. If x and y have a
Jaccard similarity of ``LOOSE`` or more but x has too few shingles in common with b
for that, then |x n y n b| <= |x n b| < |x n y|, as
|b| <= |y|: they share a shingle that b lacks. So members are dealt on by such
shingles (a prefix of them, rarest first, as long as the needed overlap leaves) to
buckets of the next round; those that have enough in common with b are dealt on by
all that b lacks. Rounds go on while a bucket holds different classes, or until the
pairs that are left are at most ``PAIRS`` a text; those are all compared, but for pairs
whose words, out of order, already differ by more than the threshold allows. They are
formed of classes first, in buckets of which those that overlap are taken together, and
of texts only where two classes may hold some that are alike. No round forms the pairs
of a large group. Members whose ordered shingles, but for the order,
are like the leader's are compared across classes in the end: pairs grow with the
number of texts with moved parts times that of their unmoved copies.

So pairs of an ordered Jaccard similarity of 0.8 that share a sketch always end in
one class. Pairs that are alike by their words alone do so too if they share a
sketch and a Jaccard similarity of ``LOOSE``, but for one case: all the shingles
that they have in common stand in a leader that is like neither.

Null text: a class of its own row's doc_id. Equal texts are one class, also
empty ones; texts without words are otherwise alike to none. A class id is the
smallest doc_id of the class (null if all are null). Texts are told apart by their
md5, whatever their doc_ids. A very long text costs time in proportion to the
square of its words over 64. Other columns are ignored, or kept as they are. An
empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, workspace

WIDTH, PICK, SKETCHES, ALIKE = 5, 2, 24, 0.8
#: Shingle similarity down to which members that are not like their leader still meet.
LOOSE = 0.5
#: Parts into which the members of one leader are dealt.
SALTS = 256
#: Links of a node from which its neighbours hear its label in parts.
DEGREE = 100_000
#: Rows of ids that are broadcast, counted before; more are joined by shuffle.
SMALL = 200_000
#: Pairs a text that may be left for a comparison of all that are left.
PAIRS = 4
#: Pairs a member up to which all pairs of a bucket are left for that comparison.
FEW = 32
#: Counters of a text's words, for a bound on how far two texts are apart.
BINS = 128
#: Slots of the table of shingle frequencies.
SLOT_BITS = 17
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, labelled with their occurrence number, and the first of each text."""
    n_words = np.diff(at)
    counts = np.where(n_words > 0, np.maximum(n_words - WIDTH + 1, 1), 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    where = kernels.spread(at[:-1], counts)
    left = np.repeat(at[1:], counts) - where
    out = np.zeros(len(where), dtype=np.uint64)
    padded = np.concatenate((hashes, np.zeros(WIDTH, dtype=np.uint64)))
    for k in range(WIDTH):
        word = padded[where + k]
        word[left <= k] = 0
        out = out * np.uint64(0x9E3779B97F4A7C15) + word
    out = kernels.mix(out)
    doc = np.repeat(np.arange(len(n_words), dtype=np.int64), counts)
    order = np.lexsort((out, doc))
    same = np.zeros(len(out), dtype=bool)
    if len(out) > 1:
        h, d = out[order], doc[order]
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    if same.any():
        k = np.arange(len(out))
        label = np.zeros(len(out), dtype=np.uint64)
        label[order] = (k - np.maximum.accumulate(np.where(same, 0, k))).astype(np.uint64)
        again = label > 0
        out[again] = kernels.mix(out[again] + label[again] * np.uint64(0xD6E8FEB86659FD93))
    return out, first


def sketches(grams: np.ndarray, first: np.ndarray, number: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """A row of ``number`` sketch values for each text that has shingles."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(full), number), dtype=np.uint64)
    if not len(full):
        return out
    starts, sizes = first[full], np.diff(first)[full]
    doc = np.repeat(np.arange(len(full)), sizes)
    for s in range(number):
        h = (grams ^ np.uint64((s + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xE7037ED1A0B428DB)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x8EBC6AF09C88C6E3)
        h ^= h >> np.uint64(29)
        places = np.full((len(full), pick), -1, dtype=np.int64)
        for p in range(pick):
            low = np.minimum.reduceat(h, starts)
            spot = np.flatnonzero(h == low[doc])
            spot = spot[np.unique(doc[spot], return_index=True)[1]] if len(spot) != len(full) else spot
            open_ = p < sizes
            places[open_, p] = spot[open_]
            h[spot] = _TOP
        places.sort(axis=1)
        value = np.full(len(full), s + 1, dtype=np.uint64)
        for p in range(pick):
            value = kernels.mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(places[:, p] >= 0, grams[np.maximum(places[:, p], 0)], np.uint64(0)))
        out[:, s] = value
    return out


def _chain(i: np.ndarray, j: np.ndarray, band: int) -> int:
    """Longest chain of common shingles at places i and j that ascend in both, within a band of diagonals."""
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    ends: list[int] = []
    for x in j.tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def _least(a: int, b: int, alike: float) -> int:
    """Common shingles that similarity ``alike`` needs."""
    return max(1, int(np.ceil(alike / (1 + alike) * (a + b) - 1e-9)))


def similarity(a: np.ndarray, b: np.ndarray, alike: float = ALIKE) -> float:
    """Ordered Jaccard similarity of two sequences of labelled shingles; 0 if it is certainly below ``alike``."""
    least = _least(len(a), len(b), alike)
    if min(len(a), len(b)) < least:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least:
        return 0.0
    m = _chain(i, j, max(len(a), len(b)) - least)
    return m / (len(a) + len(b) - m)


def edits(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Words put in, left out or exchanged between ``x`` and ``y``, or more than ``most`` if they are more than that.

    Bit b of the vectors is the cell in row j - most + b of column j, so they hold the
    band of diagonals up to ``most`` and move down with the columns; a bit says whether
    a cell is one more (or less) than the cell above it.
    """
    if len(x) < len(y):
        x, y = y, x
    m, n = len(x), len(y)
    if m - n > most:
        return most + 1
    same = np.flatnonzero(x[:n] != y)
    if not len(same):
        return m - n
    head = int(same[0])
    tail = int(np.argmax((x[m - n + head :] != y[head:])[::-1]))
    x, y = x[head : m - tail].tolist(), y[head : n - tail].tolist()
    m, n, most = len(x), len(y), min(most, m)
    if not n or most >= m:
        return m if not n else _plain_edits(x, y)
    at: dict[int, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    full, below = (1 << 2 * most + 1) - 1, 2 * most
    up, down, d = ((1 << most + 1) - 1) << most, 0, most
    for j, w in enumerate(y, 1):
        hit, shift = at.get(w, 0), j - most - 1
        hit = (hit >> shift if shift >= 0 else hit << -shift) & full
        level = ((((hit & up) + up) ^ up) | hit | down) & full
        right, left = down | full & ~(level | up), level & up
        if j + most <= m:
            d += not level >> below & 1
            if d > 2 * most - m + n:
                return most + 1
        else:
            row = m - j + most
            d += (right >> row & 1) - (left >> row & 1)
        level >>= 1
        up, down = left | full & ~(level | right), level & right
    return d


def _plain_edits(x: list, y: list) -> int:
    """The same for short texts, row by row."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def word_similarity(x: np.ndarray, y: np.ndarray, alike: float = ALIKE) -> float:
    """Edit similarity of two sequences of words; 0 if it is below ``alike``."""
    size = max(len(x), len(y))
    most = int((1 - alike) * size + 1e-9)
    d = edits(x, y, most) if size else 0
    return 1 - d / size if size and d <= most else 0.0


def compare(lead: tuple, x: tuple, partner: int, rank: np.ndarray, alike: float = ALIKE, loose: float = LOOSE) -> tuple[bool, bool, np.ndarray]:
    """Whether ``x`` (words, shingles) is like its leader, whether it would be in another order, and the shingles by which it is dealt on; partners have ``partner`` shingles at least."""
    (lead_words, lead), (words, x) = lead, x
    least = _least(len(lead), len(x), alike)
    common, i, j = np.intersect1d(lead, x, assume_unique=True, return_indices=True)
    m = _chain(i, j, max(len(lead), len(x)) - least) if len(common) >= least else 0
    own = np.ones(len(x), dtype=bool)
    own[j] = False
    new = x[own]
    new = new[np.lexsort((new, rank[new >> _SLOT_SHIFT]))]
    need = max(1, _least(len(x), max(partner, int(np.ceil(loose * len(x) - 1e-9))), loose) - len(common))
    found = m >= least or len(common) > 0 and word_similarity(lead_words, words, alike) > 0
    return found, len(common) >= least, new[: max(0, len(new) - need + 1)]


def _ranks(words: DataFrame) -> np.ndarray:
    """How often shingles of each hash slot come: at most a row per slot comes to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for w in batch["words"]:
                np.add.at(total, (_grams(w.as_buffer()) >> _SLOT_SHIFT).astype(np.int64), 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["slot", "n"])

    got = words.select("words").mapInArrow(work, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id and sketch values of every row with words, with the key of its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernels.utf8_slices(batch["text"], 2 << 20):
                hashes, at = kernels.words(data, offsets)
                grams, first = shingles(hashes, at)
                values = sketches(grams, first).view(np.int64)
                counts = np.where(np.diff(first) > 0, values.shape[1], 0)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["key"].slice(a, b - a), kernels.lists(values.ravel(), np.concatenate(([0], np.cumsum(counts))), pa.int64()), pa.array(np.diff(first))], names=["doc_id", "key", "sketch", "size"])

    return docs.select("doc_id", "text", _key().alias("key")).mapInArrow(work, "doc_id bigint, key binary, sketch array<bigint>, size bigint")


def _key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("string")))


def _word_rows(docs: DataFrame) -> DataFrame:
    """node, its words as packed 32-bit hashes, their number, and how many fall in each of ``BINS`` (up to 255)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernels.utf8_slices(batch["text"]):
                hashes, at = kernels.words(data, offsets)
                small = (hashes >> np.uint64(32)).astype("<u4")
                packed = kernels.to_binary([small[i:j].tobytes() for i, j in zip(at, at[1:])])
                bags = kernels.to_binary([_bag(small[i:j]) for i, j in zip(at, at[1:])])
                yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a), packed, pa.array(np.diff(at)), bags, batch["many"].slice(a, b - a)], names=["node", "words", "n_words", "bag", "many"])

    found = workspace.materialize(docs.select("node", "text", "many").mapInArrow(work, "node bigint, words binary, n_words bigint, bag binary, many boolean"), "words")
    again = found.filter("many").dropDuplicates(["node"])  # only they can come in repeated rows
    return found.filter("not many").unionByName(workspace.materialize(again, "words")).drop("many")


def _bag(words: np.ndarray) -> bytes:
    return np.minimum(np.bincount(words % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def _bags(words: DataFrame) -> DataFrame:
    """node, n_words and bag of every text, and its reach and longest as a part of its own (see ``_reaches``)."""
    return words.select("node", "n_words", "bag", F.lit(0).cast("bigint").alias("reach"), F.col("n_words").alias("longest"))


def _apart(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows a to b, and by how many words, out of order, the texts of each differ at least.

    A word that is put in, left out or exchanged takes one from a bin at most and adds one
    to a bin at most, so what one bag has more than the other bounds the edits from below.
    A chain of m shingles leaves at most max(a, b) - m words of either text, which the
    threshold bounds by the same share.
    """
    n, n_lead = (batch[c].to_numpy() for c in ("n_words", "n_lead"))
    for (a, b, x, _), (_, _, y, _) in zip(kernels.utf8_slices(batch["bag"]), kernels.utf8_slices(batch["lead_bag"])):
        more = x.reshape(-1, BINS).astype(np.int16) - y.reshape(-1, BINS)
        apart = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        yield a, b, np.maximum(apart, np.abs(n[a:b] - n_lead[a:b]))


def _of_both(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``pairs`` (lead, node) with the ``bags`` of both."""
    bags = workspace.broadcast_if_small(bags, SMALL // 4)  # a row has some 150 bytes
    of_lead = bags.select(F.col("node").alias("lead"), F.col("n_words").alias("n_lead"), F.col("bag").alias("lead_bag"), F.col("reach").alias("lead_reach"), F.col("longest").alias("lead_longest"))
    return pairs.join(bags, "node").join(of_lead, "lead")


def _possible(pairs: DataFrame, words: DataFrame, alike: float, named: DataFrame | None = None) -> DataFrame:
    """``pairs`` (lead, node, and other columns) but for those whose texts cannot be alike, by their words out of order; with ``named``, those whose parts hold no such texts.

    How far bags are apart is a metric, so the texts of two parts are no nearer to each
    other than the texts that name the parts, less the reach of both.
    """
    kept = [f for f in pairs.schema if f.name not in ("lead", "node")]
    names = ["lead", "node", *(f.name for f in kept)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach, longest = ((batch[c].to_numpy(), batch[f"lead_{c}"].to_numpy()) for c in ("reach", "longest"))
            most = (1 - alike) * np.maximum(*longest) + reach[0] + reach[1] + 1e-9
            for a, b, apart in _apart(batch):
                may = pa.array(apart <= most[a:b])
                yield pa.RecordBatch.from_arrays([batch[c].slice(a, b - a).filter(may) for c in names], names=names)

    return _of_both(pairs, _bags(words) if named is None else named).mapInArrow(work, ", ".join(["lead bigint, node bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in kept)]))


def _reaches(own: DataFrame, words: DataFrame) -> DataFrame:
    """The texts that name the parts of ``own`` (node, part): node, n_words, bag, reach (how far the texts of the part are from it at most, by their bags) and longest (words of the longest of them)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, apart in _apart(batch):
                yield pa.RecordBatch.from_arrays([batch["lead"].slice(a, b - a), pa.array(apart.astype(np.int64)), batch["n_words"].slice(a, b - a)], names=["node", "reach", "longest"])

    bags = _bags(words)
    others = own.filter("node <> part").select(F.col("part").alias("lead"), "node").distinct()
    found = _of_both(others, bags).mapInArrow(work, "node bigint, reach bigint, longest bigint").groupBy("node").agg(F.max("reach").alias("far"), F.max("longest").alias("long"))
    found = workspace.broadcast_if_small(workspace.materialize(found, "reaches"), SMALL)
    named = bags.join(own.select(F.col("part").alias("node")).distinct(), "node", "left_semi").join(found, "node", "left")
    return named.select("node", "n_words", "bag", F.coalesce("far", "reach").alias("reach"), F.greatest("longest", "long").alias("longest"))


def _grams(words: bytes) -> np.ndarray:
    return _both(words)[1]


def _both(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    w = np.frombuffer(words, dtype="<u4")
    return w, shingles(kernels.mix(w.astype(np.uint64)), np.array([0, len(w)]))[0]


def _compared(stars: DataFrame, words: DataFrame, rank, alike: float) -> DataFrame:
    """``stars`` (lead, node, partner) with whether their texts are alike, and the keys of the next round.

    The words of a leader go to as many tasks as its members are dealt to.
    """
    words = words.select("node", "words")
    stars = stars.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    few = F.broadcast if stars.limit(SMALL + 1).count() <= SMALL else lambda df: df
    # both joins take the words in the same form, so one shuffle of them serves both where the stars are many
    leads = few(stars.select("lead", "salt").distinct()).join(words, F.col("lead") == F.col("node")).select("lead", "salt", F.col("words").alias("of_lead"))
    both = few(stars).join(words, "node").withColumnRenamed("words", "x").join(leads, ["lead", "salt"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = one = None
        for batch in batches:
            found, near, keys = [], [], []
            for lead, partner, of_lead, x in zip(batch["lead"].to_pylist(), batch["partner"].to_pylist(), batch["of_lead"], batch["x"]):
                if lead != last:
                    last, one = lead, _both(of_lead.as_buffer())
                like, enough, more = compare(one, _both(x.as_buffer()), partner, rank.value, alike)
                found.append(like)
                near.append(enough)
                keys.append(more.view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["lead"], batch["node"], pa.array(found, type=pa.bool_()), pa.array(near, type=pa.bool_()), kernels.lists(flat, at, pa.int64())], names=["lead", "node", "alike", "near", "keys"])

    return both.select("lead", "node", "partner", "of_lead", "x").mapInArrow(work, "lead bigint, node bigint, alike boolean, near boolean, keys array<bigint>")


def _of_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` joined with ``facts`` (a row for a bucket, with its number n of rows). Up to ``SMALL`` buckets are sent to all tasks; of more, only the few with more rows than a fourth of a task's share."""
    facts = workspace.materialize(facts, "buckets")
    buckets, total = facts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if buckets <= SMALL:
        return rows.join(F.broadcast(facts), "bucket")
    parts = 4 * workspace.partitions(rows.sparkSession)
    most = max(1000, total // parts)
    wide = F.broadcast(facts.filter(F.col("n") > most))  # at most ``parts`` rows
    plain = rows.join(wide.select("bucket"), "bucket", "left_anti").join(facts.filter(F.col("n") <= most), "bucket")
    return rows.join(wide, "bucket").unionByName(plain)


def _stars(members: DataFrame, order) -> DataFrame:
    """lead (the member of a bucket that is first in ``order``), node and size of the other members."""
    leads = members.groupBy("bucket").agg(F.min_by("node", order).alias("lead"), F.count("*").alias("n"))
    return _of_bucket(members, leads).filter("lead <> node").select("lead", "node", "size").distinct()


def _links(tested: DataFrame) -> DataFrame:
    return tested.filter("alike").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))


def _mixed(dealt: DataFrame, sizes: DataFrame) -> DataFrame:
    """bucket, node and size of the buckets of ``dealt`` (bucket, node, part) that hold different parts."""
    mixed = dealt.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("bucket", "n")
    return workspace.materialize(_of_bucket(dealt, mixed).select("bucket", "node").distinct().join(sizes, "node"), "members")


def _by_size(members: DataFrame, alike: float) -> DataFrame:
    """``members`` (bucket, node, size) with each bucket cut by the length of the texts; parts of one text go.

    Texts that are alike differ in length by the factor 1 / ``alike`` at most, so their size
    classes are equal or next to each other, and each text goes to its own class and the next.
    """
    step = np.log(1 / alike) + 1e-6  # more than the factor, so that rounding parts no pair
    rank = F.floor(F.log(F.col("size") + WIDTH - 1) / step)
    dealt = members.select("bucket", "node", "size", F.explode(F.array(rank, rank + 1)).alias("rank")).select(F.xxhash64("bucket", "rank").alias("bucket"), "node", "size")
    several = dealt.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("bucket", "n")
    return workspace.materialize(_of_bucket(dealt, several).select("bucket", "node", "size"), "members")


def _split(members: DataFrame, parts: DataFrame, texts: int) -> tuple[DataFrame, DataFrame | None]:
    """bucket and node of the ``members`` whose buckets hold few pairs of different parts, and the other members; these are None if there are few such pairs in all."""
    own = members.join(parts, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("part"))
    facts = own.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.expr("(sum(n) * sum(n) - sum(n * n)) div 2").alias("pairs")).filter("pairs > 0")
    found = workspace.materialize(_of_bucket(own, facts).select("bucket", "node", "size", (F.col("pairs") > FEW * F.col("n")).alias("wide"), (F.col("pairs") / F.col("n")).alias("share")), "members")
    left = found.filter("wide").agg(F.coalesce(F.sum("share"), F.lit(0))).first()[0]
    if left <= PAIRS * texts:
        return found.select("bucket", "node"), None
    return found.filter("not wide").select("bucket", "node"), found.filter("wide").select("bucket", "node", "size")


def _pairs_of(own: DataFrame) -> DataFrame:
    """Buckets of ``own`` (bucket, node, part) that hold different parts: n (texts), home (the first part, by hash), and the pairs of different parts and of texts of different parts."""
    facts = own.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.min_by("part", F.xxhash64("part")).alias("home"), F.expr("count(*) * (count(*) - 1) div 2").alias("of_parts"), F.expr("(sum(n) * sum(n) - sum(n * n)) div 2").alias("of_texts"))
    return facts.filter("of_parts > 0")


def _together(own: DataFrame) -> DataFrame:
    """``own`` (bucket, node, part), with overlapping buckets made one where that makes no more pairs; buckets of one part go.

    Texts meet in as many buckets as they share shingles, so many buckets hold much the
    same texts. Those with the same home are tried.
    """
    facts = workspace.materialize(_pairs_of(own), "facts")
    dealt = workspace.materialize(_of_bucket(own, facts.select("bucket", "n", "home")).select("bucket", "node", "part", "home"), "dealt")
    apart = facts.groupBy("home").agg(F.sum("of_parts").alias("parts_apart"), F.sum("of_texts").alias("texts_apart"), F.count("*").alias("buckets")).filter("buckets > 1")
    as_one = _pairs_of(dealt.select(F.col("home").alias("bucket"), "node", "part").distinct()).select(F.col("bucket").alias("home"), "of_parts", "of_texts")
    homes = apart.join(as_one, "home").filter("of_parts <= parts_apart and of_texts <= texts_apart").select("home")
    homes = workspace.broadcast_if_small(workspace.materialize(homes, "homes"), SMALL)
    one = dealt.join(homes, "home", "left_semi").select(F.xxhash64("home", F.lit(0)).alias("bucket"), "node", "part").distinct()
    return dealt.join(homes, "home", "left_anti").select("bucket", "node", "part").unionByName(one)


def _pairs(own: DataFrame, words: DataFrame, alike: float) -> DataFrame:
    """lead and node of the texts of different parts that meet in a bucket of ``own`` (bucket, node, part), but for those that cannot be alike.

    Pairs of parts are formed first, and of texts only where parts may hold some that are
    alike, so a group of copies counts as one.
    """
    own = workspace.materialize(_together(own), "own")
    met = workspace.materialize(own.select("bucket", F.col("part").alias("node")).distinct(), "met")
    pairs = met.join(met.select("bucket", F.col("node").alias("lead")), "bucket").filter("node < lead")
    near = workspace.materialize(_possible(pairs, words, alike, _reaches(own, words)), "near")
    of_node = own.select("bucket", F.col("part").alias("node"), F.col("node").alias("x"))
    of_lead = own.select("bucket", F.col("part").alias("lead"), F.col("node").alias("y"))
    texts = near.join(of_node, ["bucket", "node"]).join(of_lead, ["bucket", "lead"]).select(F.col("y").alias("lead"), F.col("x").alias("node")).distinct()
    return _possible(texts, words, alike)


def components(edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """node, component (its smallest node) of the graph with ``edges`` (a, b): smallest labels spread along edges and jump."""
    two = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    two = workspace.materialize(two, "edges")
    near = two.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("n"))
    labels = workspace.materialize(near.select("node", F.least("node", "least").alias("component"), "n"), "labels")
    widest = labels.agg(F.max("n")).first()[0] or 0
    labels = labels.select("node", "component")
    if widest > degree:
        two = workspace.materialize(two.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(-(-widest // degree)))), "edges")
        spots = workspace.materialize(two.select("b", "salt").distinct(), "spots")
    while True:
        told = labels.select(F.col("node").alias("b"), "component")
        told, on = (told, ["b"]) if widest <= degree else (spots.join(told, "b"), ["b", "salt"])
        heard = two.join(told, on).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        best = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("next"))
        new = workspace.materialize(best.join(jump, "c").select("node", "was", F.least("c", "next").alias("component")), "labels")
        labels, moved = new.select("node", "component"), not new.filter(F.col("was") != F.col("component")).isEmpty()
        if not moved:
            return labels


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) with those merged that ``links`` (a, b) connect; a node without a row is a part of its own.

    Links are taken between parts, so a large group costs as many as it has parts.
    """
    if parts is None:
        return components(links)
    small = workspace.broadcast_if_small(parts, SMALL)
    of_a, of_b = (small.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab")
    between = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    between = workspace.materialize(between.filter("a <> b").distinct(), "links")
    if between.isEmpty():
        return parts
    found = workspace.broadcast_if_small(components(between), SMALL)
    old = parts.join(found.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return workspace.materialize(old.unionByName(found.join(parts, "node", "left_anti").select("node", "component")), "parts")


def _texts(rows: DataFrame) -> DataFrame:
    """key, first (the smallest doc_id), n_copies, sketch, size and node (first, or a hash where it names several texts or none) of each text."""
    texts = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    texts = workspace.materialize(texts, "texts")
    shared = texts.filter(F.col("first").isNotNull()).groupBy("first").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("first").alias("one"))
    shared = workspace.broadcast_if_small(workspace.materialize(shared, "shared"), SMALL)
    own = F.col("first").isNotNull() & F.col("one").isNull()
    return texts.join(shared, F.col("first") == F.col("one"), "left").select("key", "first", "n_copies", "sketch", "size", F.when(own, F.col("first")).otherwise(F.xxhash64("key")).alias("node"))


def _classes(docs: DataFrame, alike: float) -> DataFrame:
    """doc_id and key of every row of ``docs``, and first, n_copies and class_id of its text."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = workspace.materialize(_sketched(plain), "sketched")
    texts = _texts(rows)
    names = texts.select("key", "node", F.col("first").alias("_first"), (F.col("n_copies") > 1).alias("many"))
    met = texts.select("node", "size", F.explode("sketch").alias("bucket"))
    full = met.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("bucket")
    full = workspace.broadcast_if_small(workspace.materialize(full, "full"), SMALL)
    members = workspace.materialize(met.join(full, "bucket").select("bucket", "node", "size").distinct(), "members")

    sizes = workspace.materialize(members.select("node", "size").distinct(), "sizes")
    asked = names.join(sizes.select("node"), "node", "left_semi").select(F.col("key").alias("_key"), "node", "_first", "many")
    asked = workspace.broadcast_if_small(workspace.materialize(asked, "asked"), SMALL)
    first_rows = plain.withColumn("_k", _key()).join(asked, (F.col("_k") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    words = _word_rows(first_rows)
    n_texts = texts.count()
    rank = plain.sparkSession.sparkContext.broadcast(_ranks(words))
    wide = members.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = workspace.materialize(_of_bucket(members, wide).groupBy("node").agg(F.sum("n").alias("weight")), "weight")
    stars = _stars(members.join(weight, "node"), F.struct(-F.col("weight"), F.xxhash64("node"), "node"))
    # a text is first compared with the heaviest of its leaders only
    heavy = stars.join(weight.select(F.col("node").alias("lead"), "weight"), "lead").groupBy("node").agg(F.max_by("lead", F.struct("weight", F.xxhash64("lead"), "lead")).alias("lead"))
    heavy = workspace.materialize(heavy.select("lead", "node", F.lit(1).cast("bigint").alias("partner")), "stars")
    parts = _merged(None, workspace.materialize(_links(_compared(heavy, words, rank, alike)).distinct(), "links"))
    members = _mixed(members.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part")), sizes)
    few, members = _split(members, parts, n_texts)
    turned = [few]
    if members is not None:
        few, members = _split(_by_size(members, alike), parts, n_texts)
        turned.append(few)
    while members is not None:
        stars = workspace.materialize(_stars(members, F.struct("size", F.xxhash64("node"), "node")), "stars")
        shortest = workspace.broadcast_if_small(stars.groupBy("lead").agg(F.min("size").alias("partner")), SMALL)
        tested = workspace.materialize(_compared(stars.select("lead", "node").join(shortest, "lead"), words, rank, alike), "tested")
        parts = _merged(parts, _links(tested))
        otherwise = tested.filter("near and not alike").select("lead").distinct()
        if not otherwise.isEmpty():
            turned.append(tested.filter("near").join(otherwise, "lead", "left_semi").select(F.xxhash64("lead", F.lit(len(turned))).alias("bucket"), "node"))
        failed = workspace.broadcast_if_small(tested.filter("not alike").select("lead").distinct(), SMALL)
        dealt = tested.join(failed, "lead", "left_semi").join(parts, "node", "left").select(F.coalesce("component", "node").alias("part"), "node", F.explode("keys").alias("key"), "lead")
        members = _mixed(dealt.select(F.xxhash64("lead", "key").alias("bucket"), "node", "part"), sizes)
        few, members = _split(members, parts, n_texts)  # few enough are all compared, across classes
        turned.append(few)
    own = reduce(DataFrame.unionByName, turned).join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    pairs = workspace.materialize(_pairs(own.distinct(), words, alike).withColumn("partner", F.lit(1).cast("bigint")), "pairs")
    parts = _merged(parts, workspace.materialize(_links(_compared(pairs, words, rank, alike)), "links"))

    named = workspace.materialize(texts.join(parts, "node", "left").select("key", "first", "n_copies", F.col("component").alias("bucket")), "named")
    alone = named.filter(F.col("bucket").isNull()).select("key", "first", "n_copies", F.col("first").alias("class_id"), F.col("key").alias("winner"))
    several = named.filter(F.col("bucket").isNotNull())
    lowest = several.groupBy("bucket").agg(F.min("first").alias("class_id"), F.min_by(F.col("key"), F.struct(F.col("first").isNull(), "first", "key")).alias("winner"), F.count("*").alias("n"))
    named = alone.unionByName(_of_bucket(several, lowest).select("key", "first", "n_copies", "class_id", "winner"))
    return rows.select("doc_id", "key").join(named, "key", "left")


def classes(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """A row per row of ``docs``: doc_id, class_id, n_copies (rows of equal text)."""
    alone = F.col("key").isNull()
    return _classes(docs, alike).select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("bigint").alias("n_copies"))


def keep_first(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """One row of each class of ``docs``: of the text with the smallest doc_id (the smallest md5 among several), a row with that doc_id.

    Rows with null text are kept. Rows go by their text, so different texts that share a
    doc_id, or have none, do not hide each other.
    """
    spark = docs.sparkSession
    with workspace.tables(spark):
        found = _classes(docs, alike).filter(F.col("key").isNotNull())
        kept = workspace.table_path(spark, "classes")  # outlives the tables that it is made from
        found.write.option("compression", "zstd").parquet(kept)
    found = spark.read.schema(found.schema).parquet(kept)
    goes = (F.col("winner") != F.col("key")) | ~F.col("doc_id").eqNullSafe(F.col("first"))
    gone = found.filter(goes).select(F.col("key").alias("_gone_key"), F.col("doc_id").alias("_gone_id")).distinct()
    packed = docs.select(F.struct(*workspace.own(docs)).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), _key().alias("_text"))
    gone = workspace.broadcast_if_small(workspace.materialize(gone, "gone"), SMALL)
    out = packed.join(gone, (F.col("_text") == F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left_anti")
    again = found.filter(~goes).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_again"))
    again = workspace.broadcast_if_small(workspace.materialize(again, "again"), SMALL)
    marked = out.join(again, F.col("_text") == F.col("_again"), "left")
    once = marked.filter(F.col("_again").isNull()).select("_row")
    repeated = marked.filter(F.col("_again").isNotNull())
    if not again.isEmpty():
        once = once.unionByName(repeated.groupBy("_again").agg(F.first("_row").alias("_row")).select("_row"))
    return once.select(*workspace.unpacked(once, "_row"))
