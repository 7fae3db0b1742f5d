"""The pipeline against plain Python and DuckDB, stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import extendible, langid, mixing, queries

from .test_small import alike_classes, groups_in_many_buckets, word_list

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_pipeline(spark):
    table = queries.table(spark, SF, "documents")
    told = {r["doc_id"]: r for r in langid.identify(table).collect()}
    docs = [r for r in table.collect() if told[r["doc_id"]]["lang_pred"] != "und" and told[r["doc_id"]]["score"] >= langid.LEAST]
    classes = alike_classes([(r["doc_id"], r["text"]) for r in docs])
    docs = [r for r in docs if classes[r["doc_id"]] == r["doc_id"]]
    windows = {}
    for r in queries.table(spark, SF, "benchmark").collect():
        w = word_list(r["text"])
        for k in range(max(1, len(w) - 7)) if w else ():
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r["item_id"])
    kept = []
    for r in docs:
        w, found = word_list(r["text"]), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found |= windows.get(tuple(w[k : k + n]), set())
        if not found:
            kept.append(r)
    assert len(kept) < len(docs)
    con = duckdb.connect()
    frame = spark.createDataFrame(kept, table.schema).toPandas()
    con.register("documents", frame)
    drawn = con.execute(mixing.sql(power=corpus_pipeline.MIX_POWER, keep=corpus_pipeline.MIX_KEEP)).df()
    frame = frame[frame.doc_id.isin(drawn[drawn.selected].doc_id)]
    con.unregister("documents")
    con.register("documents", frame)
    want = con.execute(extendible.sql(queries.SHARD_BYTES)).df().set_index("doc_id")
    got = corpus_pipeline.run(spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(want.index) and 0 < len(got) < len(docs)
    for c in ("shard", "depth", "shard_bytes", "shard_docs"):
        assert (got[c].sort_index().astype(str) == want[c].sort_index().astype(str)).all()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and shared ids, repeated rows, extra columns with clashing names."""
    own = {"en": "the that with shall house".split(), "fr": "les avec eaux que maison".split()}
    passage = "a passage of a benchmark item that has ten words"

    def text(lang, k):
        return " ".join(own[lang][(k * p + p // 3) % 5] + ("x" * (p % 4 == k % 4)) + str(k * 100 + p) for p in range(30))

    rows = [(k, text("en" if k % 2 else "fr", k), "en" if k % 2 else "fr", f"s{k % 3}") for k in range(40)]
    rows += [(50, None, "en", None), (None, "", None, "s0"), (51, text("en", 3), "en", "s1"), (51, text("en", 3), "en", "s1"), (None, text("en", 5), None, "s1"), (52, f"{text('en', 7)[:60]} {passage} {text('en', 9)[:60]}", "en", "s2"), (None, f"{passage} {text('fr', 60)}", "fr", "s2"), (1, text("fr", 70), "fr", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "mine", 7) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, `no.de` int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = [r for r in got.collect()]
    assert set(docs.columns) < set(got.columns) and {r["key"] for r in kept} == {"mine"}
    texts = [r["text"] for r in kept]
    assert len(texts) == len(set(texts)) and not any(t is None or not t or passage in t for t in texts)
    assert 30 <= len(texts) <= 41
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs.limit(0).select("doc_id", "text").withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_duplicates_pair_groups(spark, monkeypatch):
    """The stage forms no pair for each text of a large group, nor for each bucket."""
    texts, want, formed = groups_in_many_buckets(monkeypatch)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert sum(formed) <= 13 * 12 // 2
