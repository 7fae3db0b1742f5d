"""Benchmark decontamination by a distributed positional inverted index.

The corpus is indexed in segments of consecutive documents: for every term (the
64-bit hash of a lower-cased word) its ascending word positions. A phrase is
looked up in a segment from its rarest term on: that term's list, shifted by
its place in the phrase, gives candidate starts, and each further term, in
ascending frequency, keeps the candidates it is found at. With ``slop`` 0 the
phrase must be exact; else each term may be up to ``slop`` words off its place
(a proximity match). Neither the index nor its lists leave their segment, so a
frequent word costs its own postings only and nothing is shuffled.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A phrase is
a window of ``window`` consecutive item words; an item of fewer words, but not
none, is one window. Windows do not go across documents.

Null or empty text: no words, no hits. Repeated rows are rows of their own.
Items that share an id are one item; a null item_id is named 'null'; items
without words match nothing. A very long text is a segment of its own, of some 30
times the memory of its bytes. Other columns are ignored, or kept as they are. Empty
tables: no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, workspace

INDEX = "segment string, doc_ids array<bigint>, word_at array<int>, terms binary, counts binary, positions binary"
FOUND = "segment string, row int, doc_id bigint, n_words bigint, spans array<struct<a:int,b:int>>, items array<string>"
#: Bytes of item texts that are sent to the executors at once; more go in several rounds.
ROUND_BYTES = 4 << 20
#: Ids that are broadcast; more are joined by shuffle.
SMALL = 200_000


def index_terms(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), a row per segment."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offsets in kernels.utf8_slices(batch["text"]):
                hashes, at = kernels.words(data, offsets)
                order = np.argsort(hashes, kind="stable").astype(np.int32)
                ordered = hashes[order]
                new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, dtype=np.int64)
                counts = np.diff(np.append(new, len(ordered))).astype(np.int32)
                row = [[f"{part}-{k}"], [batch["doc_id"].slice(a, b - a)], [at], [ordered[new].tobytes()], [counts.tobytes()], [order.tobytes()]]
                kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) if t != kinds[1] else pa.array([v[0].to_pylist()], type=t) for v, t in zip(row, kinds)], names=["segment", "doc_ids", "word_at", "terms", "counts", "positions"])
                k += 1

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, INDEX)


class Phrases:
    """Different windows of items as rows of term numbers, and the items of each window."""

    def __init__(self, items: list[str], texts: pa.Array, window: int):
        self.names = sorted(set(items))
        number = {x: k for k, x in enumerate(self.names)}
        held, grids, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros((0, window), dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        of = np.array([number[x] for x in items], dtype=np.int64)
        for a, b, data, offsets in kernels.utf8_slices(texts):
            hashes, at = kernels.words(data, offsets)
            n_words = np.diff(at)
            counts = np.where(n_words > 0, np.maximum(n_words - window + 1, 1), 0)
            where, size = kernels.spread(at[:-1], counts), np.repeat(np.minimum(n_words, window), counts)
            grid = np.concatenate((hashes, np.zeros(window, dtype=np.uint64)))[where[:, None] + np.arange(window)] if len(where) else grids[0]
            grid[np.arange(window) >= size[:, None]] = 0
            held.append(np.repeat(of[a:b], counts))
            grids.append(grid)
            sizes.append(size)
        held, grid, size = (np.concatenate(x) for x in (held, grids, sizes))
        key = size.astype(np.uint64)
        for c in range(window):
            key = kernels.mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, c])
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        grid, self.lengths = grid[first], size[first]
        filled = np.arange(window) < self.lengths[:, None]
        self.terms, rank = np.unique(grid[filled], return_inverse=True)
        self.grid = np.full(grid.shape, -1, dtype=np.int64)
        self.grid[filled] = rank
        pair = np.unique(which * max(1, len(self.names)) + held)
        self.items = pair % max(1, len(self.names))
        self.item_at = np.searchsorted(pair // max(1, len(self.names)), np.arange(len(first) + 1))


def occurrences(terms, counts, positions, word_at, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase, start)`` of every match in a segment."""
    none = np.zeros(0, dtype=np.int64)
    n, grid = len(positions), phrases.grid
    if not n or not len(grid):
        return none, none
    rank = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    held = np.append(terms[rank] == phrases.terms, True)  # the last stands for places after a short phrase
    alive = np.flatnonzero(held[grid].all(axis=1))
    if not len(alive):
        return none, none
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    keys = np.repeat(np.arange(len(terms), dtype=np.int64) * n, counts) + positions
    often = np.append(counts[rank].astype(np.int64), n + 1)[grid[alive]]
    order = np.argsort(often, axis=1, kind="stable")
    rarest = order[:, 0]
    lead = rank[grid[alive, rarest]]
    which = np.repeat(np.arange(len(alive)), counts[lead])
    start = positions[kernels.spread(first[lead], counts[lead].astype(np.int64))].astype(np.int64) - rarest[which]
    lengths = phrases.lengths[alive]
    keep = (start >= 0) & (start + lengths[which] <= n)
    which, start = which[keep], start[keep]
    for step in range(1, grid.shape[1]):
        place = order[which, step]
        term = grid[alive[which], place]
        base = rank[term] * n
        spot = start + place
        at = np.searchsorted(keys, base + np.maximum(spot - slop, 0))
        keep = (term < 0) | (keys[np.minimum(at, n - 1)] <= base + np.minimum(spot + slop, n - 1)) & (at < n)
        which, start = which[keep], start[keep]
    doc = np.searchsorted(word_at, start, "right") - 1
    keep = start + lengths[which] <= word_at[doc + 1]
    return alive[which[keep]], start[keep]


def _match(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        names = np.array(phrases.names, dtype=object)
        for batch in batches:
            for k in range(batch.num_rows):
                at = batch["word_at"][k].values.to_numpy().astype(np.int64)
                terms, counts, positions = (np.frombuffer(batch[c][k].as_buffer(), dtype=t) for c, t in (("terms", np.uint64), ("counts", np.int32), ("positions", np.int32)))
                which, start = occurrences(terms, counts, positions, at, phrases, slop)
                n, m = len(at) - 1, len(positions)
                depth = np.zeros(m + 1, dtype=np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + phrases.lengths[which], -1)
                begin, end = kernels.runs(np.cumsum(depth[:-1]) > 0, at) if m else (start, start)
                doc = np.searchsorted(at, begin, "right") - 1
                spans = np.searchsorted(doc, np.arange(n + 1))
                per = np.diff(phrases.item_at)[which]
                pair = np.unique(np.repeat(np.searchsorted(at, start, "right") - 1, per) * max(1, len(names)) + phrases.items[kernels.spread(phrases.item_at[which], per)])
                items = np.searchsorted(pair // max(1, len(names)), np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["segment"][k].as_py()] * n), pa.array(np.arange(n, dtype=np.int32)), batch["doc_ids"][k].values, pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pa.StructArray.from_arrays([pa.array((x - at[doc]).astype(np.int32)) for x in (begin, end)], names=["a", "b"])),
                        pa.ListArray.from_arrays(pa.array(items.astype(np.int32)), pa.array(names[pair % max(1, len(names))], type=pa.string())),
                    ],
                    names=["segment", "row", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(work, FOUND)


def _covered(spans: str) -> Column:
    """Words in the union of spans, which may overlap."""
    return F.expr(f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.b - greatest(x.a, s.to)), 'to', greatest(s.to, x.b)), s -> s.n)")


def match(docs: DataFrame, items: DataFrame, window: int = 8, slop: int = 0) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items, spans (hit word spans)."""
    index = workspace.materialize(index_terms(docs), "index")
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, -(-size // ROUND_BYTES))
    found = None
    for k in range(rounds):
        part = named.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == k).toArrow() if rounds > 1 else named.toArrow()
        one = _match(index, Phrases(part["item"].to_pylist(), part["text"].combine_chunks(), window), slop)
        found = one if found is None else found.unionByName(one)
    if rounds > 1:
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    items_ = F.array_sort("items")
    return found.select("doc_id", "n_words", _covered("spans").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), items_.alias("items"), "spans")


def contaminated(docs: DataFrame, items: DataFrame, window: int = 8, least: int = 2) -> DataFrame:
    """The digest of ``match``: a document is contaminated if windows of ``least`` items occur in it."""
    return match(docs, items, window).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_items") >= least).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 8, least: int = 1) -> DataFrame:
    """``docs`` without the rows in whose text windows of ``least`` items occur, whatever their doc_id.

    A text is known again by its 64-bit hash.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    found = contaminated(docs.select(key.alias("doc_id"), "text"), items, window, least)
    gone = workspace.materialize(found.filter("contaminated").select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    packed = docs.select(F.struct(*workspace.own(docs)).alias("_row"), key.alias("_gone"))
    out = packed.join(workspace.broadcast_if_small(gone, SMALL), "_gone", "left_anti")
    return out.select(*workspace.unpacked(out, "_row"))


def sql(window: int = 8, least: int = 2) -> str:
    """The digest of ``documents`` and ``benchmark`` in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), [])"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, {words} as w from documents),
i as (select coalesce(cast(item_id as varchar), 'null') as item, {words} as w from benchmark),
p as materialized (select distinct item, least(len(w), {window}) as n, array_to_string(w[k : k + {window - 1}], ' ') as p from (select *, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) as k from i where len(w) > 0)),
n as (select distinct n from p),
s as (select r, n, k, array_to_string(w[k : k + n - 1], ' ') as p from (select r, n, w, unnest(range(1, len(w) - n + 2)) as k from d, n where len(w) >= n)),
h as materialized (select r, k, s.n, item from s join p using (p)),
c as (select r, count(distinct place) as n_hit from (select r, unnest(range(k, k + n)) as place from h) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= {least} as contaminated
from d left join c using (r) left join t using (r)"""
