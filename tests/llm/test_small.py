"""Every operator on nulls, empty texts, ties, repeated rows, empty tables and extra columns, and against plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ans, decontam, deleted, extendible, kernels, langid, mixing, omh, pivots, queries, rulefit, separators, tokens, workspace

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, topic string"
rng = random.Random(3)
WORDS = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(120)
    near = base.split()
    near[7], near[60] = "changed", "again"
    out = [(k, prose(40 + k), "en" if k % 2 else "fr", f"s{k % 3}") for k in range(12)]
    out += [(20, None, "en", "s0"), (21, "", None, None), (22, "", "en", "s0"), (23, base, "en", "s1"), (24, base, "en", "s1"), (25, " ".join(near), "fr", "s2"), (26, prose(5000), "en", "s0"), (27, "!!! 123", None, "s0"), (28, "Two words", "en", "s1"), (28, "Two words", "en", "s1")]
    return [(i, t, lang, s, len(t or ""), 0.5, "clash") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_kernels_hash_words_alike():
    col = pa.array(["Ab cd", "", None, "cd ab é1", "x" * (kernels._CHUNK + 5), "ab"])
    seen = []
    for a, b, data, offsets in kernels.utf8_slices(col, 16):
        h, at = kernels.words(data, offsets)
        seen += [list(h[i:j]) for i, j in zip(at, at[1:])]
    assert [len(x) for x in seen] == [2, 0, 0, 3, 1, 1]
    assert seen[0][0] == seen[3][1] == seen[5][0] and seen[0][1] == seen[3][0]


def test_encoder_equals_the_library():
    enc = tokens.encoder(queries.tokenizer_path(), 1)
    texts = ["Hello, World.. it's 2024!", "élan Éa queçé. ñandú", "a.b , c", "", "<|endoftext|> x", "don't\tstop\nnow", "日本 語."]
    for mark in ("<|endoftext|>", "<|startoftext|>"):
        texts += [t.replace("@", x) for x in (mark, mark.upper(), mark.title(), "<|EndOfText|>") for t in ("@", "@ x", "Ab@Cd, e", "Ab @. @@,", "X.@", "<@>", "<|@ |")]
    for _, _, data, offsets in kernels.utf8_slices(pa.array(texts)):
        ids, at = enc.encode(data, offsets)
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [list(ids[i : j - 1]) for i, j in zip(at, at[1:])] == [x.ids for x in want]


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 200_000])
def test_block_round_trip(n):
    g = np.random.default_rng(n)
    ids = (g.zipf(1.3, n) % 40_000).astype(np.uint32)
    kinds, counts = np.unique(ids, return_counts=True)
    table = ans.Table.scaled(kinds, counts)
    block = ans.encode_block(ids, table, lanes=64, every=16)
    assert (ans.decode_block(block, table) == ids).all()
    marks = ans.HEAD.unpack_from(block)[5]
    assert (np.concatenate([ans.decode_block(block, table, k, k + 1) for k in range(marks)]) == ids).all()
    for place in (0, 5, ans.HEAD_MARKS, ans.HEAD.size - 8, ans.HEAD.size, len(block) - 1):  # magic, bits, header, checksum, checkpoint, word
        damaged = bytearray(block)
        damaged[place] ^= 1
        with pytest.raises(ValueError):
            ans.decode_block(bytes(damaged), table)


def test_op1(spark, docs, none, rows):
    path = workspace.table_path(spark, "t")
    ans.write(docs, path, queries.tokenizer_path(), block_ids=500)
    got = sorted(ans.read(spark, path).collect(), key=lambda r: (r["doc_id"], r["start"]))
    lib = tokens.encoder(queries.tokenizer_path(), 1).tokenizer
    start = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    spans = b"".join(bytes(r["ids"]) for r in sorted(ans.read_spans(spark, path).collect(), key=lambda r: (r["part"], r["block"], r["span"])))
    assert spans == b"".join(bytes(r["ids"]) for r in got)
    path = workspace.table_path(spark, "t")
    ans.write(none, path, queries.tokenizer_path())
    assert ans.read(spark, path).count() == 0


def test_op2(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == 22 and all(0 <= r["probability"] <= 1 + 1e-9 for r in got)
    cells = mixing.fit(mixing.described(docs), {"lang": {"en": 0.5, "fr": 0.3, "(none)": 0.2}}, sweeps=40).toPandas()
    share = cells.groupby("lang").w.sum() / cells.w.sum()
    assert abs(share["fr"] - 0.3) < 0.05
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    chosen = {r["doc_id"] for r in got if r["selected"]}
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == chosen and 0 < len(chosen) < 22


@pytest.mark.parametrize("rare", [0, 1, 10])
def test_op2_rate_does_not_hang_on_the_rarest_cell(spark, rare):
    table = [(k, prose(50), "en", f"s{k % 3 // 2}", 0, 0.0, "") for k in range(300)] + [(900 + k, None if k % 2 else "one", "xx", "tiny", 0, 0.0, "") for k in range(rare)]
    got = mixing.mix(spark.createDataFrame(table, SCHEMA), keep=0.8).toPandas()
    assert abs((got.probability * got.n_tokens).sum() / got.n_tokens.sum() - 0.8) < 1e-6 and got.probability.max() <= 1
    small, large = (got[got.source == s].probability.iloc[0] for s in ("s1", "s0"))
    assert small > large > 0.5


def test_op3(spark, docs, none, rows):
    passage = " ".join(rows[3][1].split()[5:17])
    items = [(1, passage), (2, " ".join(rows[3][1].split()[20:30])), (3, "two words"), (4, None), (5, ""), (1, "absent phrase of eight words in no document"), (None, "changed")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for i, t in items:
        w = word_list(t)
        for k in range(max(1, len(w) - 7)) if w else ():
            windows.setdefault(tuple(w[k : k + 8]), set()).add("null" if i is None else str(i))
    want = collections.Counter()
    for i, t, *_ in rows:
        w, hit, found = word_list(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[i, len(w), len(hit), ",".join(sorted(found))] += 1
    for rounds in (1 << 24, 40):
        decontam.ROUND_BYTES, kept = rounds, decontam.ROUND_BYTES
        got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontam.match(docs, bench).collect())
        decontam.ROUND_BYTES = kept
        assert got == want
    assert decontam.match(none, bench).count() == 0
    assert decontam.match(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    near = spark.createDataFrame([(9, "one two blah three")], "doc_id bigint, text string")
    three = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert decontam.match(near, three).first()["n_items"] == 0 and decontam.match(near, three, slop=1).first()["n_items"] == 1
    assert decontam.keep_clean(none, bench).count() == 0
    long_ = bench.filter("item_id < 3")
    odd = docs.withColumn("a.b`c", F.lit(1)).unionByName(spark.createDataFrame([(None, f"x {passage} y", "en", "s", 0, 0.0, "", 1), (3, "another text of row three that is clean", "en", "s", 0, 0.0, "", 1)], SCHEMA + ", `a.b``c` int"))
    kept = decontam.keep_clean(odd, long_)
    assert kept.columns == odd.columns
    assert collections.Counter(r["text"] for r in odd.collect()) - collections.Counter(r["text"] for r in kept.collect()) == {rows[3][1]: 1, f"x {passage} y": 1}


def test_op4(docs, none, rows):
    lib = tokens.encoder(queries.tokenizer_path(), 1).tokenizer
    want = collections.Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    for size in (7, 1 << 20):
        got = separators.count_tokens(docs, queries.tokenizer_path(), queries.FLAT_END_ID, size)
        assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert separators.count_tokens(none, queries.tokenizer_path(), queries.FLAT_END_ID).count() == 0


def test_op4_unclosed_file(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], dtype="<u2").tofile(tmp_path / "a.bin")
    got = separators.stitch(separators.scan_blocks(spark, f"file://{tmp_path}", 9, 2, 2)).orderBy("doc").collect()
    assert [(r["start"], r["n_ids"], r["closed"]) for r in got] == [(0, 3, True), (3, 1, True), (4, 1, False)]


def test_op5(docs, none):
    got = extendible.shard(docs, 2000).toPandas()
    assert len(got) == 22
    for shard, part in got.groupby("shard"):
        size = part.text.fillna("").str.encode("utf8").str.len().sum()
        assert size == part.shard_bytes.iloc[0] and (size <= 2000 or part.doc_id.nunique() == 1 and part.oversize.all())
    names = sorted(got.shard.unique())
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    odd = docs.select("*", F.lit("mine").alias("_x"), F.lit("too").alias("_h"), F.lit(3).alias("_row"), F.lit(4).alias("a.b"))
    assert {(r["_x"], r["_h"], r["_row"], r["a.b"]) for r in extendible.shard(odd, 2000).collect()} == {("mine", "too", 3, 4)}
    assert extendible.shard(none, 100).count() == 0 and set(extendible.shard(docs, 10**9).toPandas().depth) == {0}


def test_op6(spark, docs, none):
    table = [(k, prose(60) if k % 3 else "*** ".join(prose(60).split()), "en", "s", 0, 0.0, "") for k in range(400)]
    many = spark.createDataFrame(table, SCHEMA)
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0, 0) for k in range(400)] + [(5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = rulefit.classify(many, labels).toPandas()
    held = got[got.held_out]
    assert ((held.score >= 0.5) == (held.doc_id % 3 > 0)).mean() > 0.97 and (got.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id]).all()
    few = rulefit.classify(docs, labels.limit(0)).collect()
    assert len(few) == 22 and {r["score"] for r in few} == {0.5}
    assert rulefit.classify(none, labels).count() == 0


def test_op6_junk_in_late_rows():
    """Rules that hold alike on the first 4000 rows and differ later are kept apart."""
    g = np.random.default_rng(4)
    x = np.zeros((6000, len(rulefit.STATS)))
    x[4000:, :2] = g.random((2000, 2))
    y = ((x[:, 0] <= 0.5) & (x[:, 1] <= 0.5)).astype(float)
    found = rulefit.fit_rules(x, y)
    score = found.intercept + rulefit.holds(found.rules, x) @ np.array(found.weights)
    assert ((score > 0) == (y > 0))[4000:].mean() > 0.95


def test_op7(spark, docs, none):
    own = {"en": ["the", "that", "with", "shall"], "de": ["und", "nicht", "schon", "ich"], "fr": ["les", "avec", "eaux", "que"], "es": ["los", "ción", "ella", "ñandú"]}
    table = [(k, prose(30, own[lang]), lang, "s", 0, 0.0, "") for k, lang in enumerate(list(own) * 40)]
    many = spark.createDataFrame(table + [(900, None, "en", "s", 0, 0.0, ""), (901, "12 !", "en", "s", 0, 0.0, "")], SCHEMA)
    got = langid.identify(many).toPandas().set_index("doc_id")
    assert all(got.lang_pred[k] == lang for k, lang in enumerate(list(own) * 40))
    assert got.lang_pred[900] == got.lang_pred[901] == "und" and got.score.between(0, 1).all()
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(none).count() == 0
    assert langid.keep_known(many).columns == many.columns and langid.keep_known(many).count() == 160


def test_op7_keeps_a_large_family(spark):
    langs = "be bg cs hr mk pl ru sk uk".split()
    own = {lang: ["".join(rng.choice("bcdfgklmprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)] for lang in langs}
    many = spark.createDataFrame([(k, prose(30, own[lang]), lang, "s", 0, 0.0, "") for k, lang in enumerate(langs * 30)], SCHEMA)
    got = langid.identify(many).toPandas().set_index("doc_id")
    assert all(got.lang_pred[k] == lang for k, lang in enumerate(langs * 30)) and got.score.min() > 0.5
    assert langid.keep_known(many).count() == 270


def test_op8(spark):
    g = np.random.default_rng(2)
    v = [(k, (g.integers(-3, 4, 6) / 4).astype(float).tolist()) for k in range(120)]
    v += [(200, None), (250, [1.0, float("nan")]), (300, [None, 1.0]), (None, [1.0]), (350, [0.5]), (7, [0.5, 0.5])]
    table = spark.createDataFrame(v, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))
    good = [(i, [math.floor(256 * x) for x in e] + [0] * (6 - len(e))) for i, e in v if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = set()
    for q, e in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, c)), i) for i, c in good if i != q)[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in pivots.search(table).collect()} == want
    assert pivots.search(table.limit(0)).count() == 0


def test_op8_leaves_out_far_groups():
    g = np.random.default_rng(3)
    centres = g.normal(0, 300, (20, 8))
    x = np.floor(np.repeat(centres, 200, axis=0) + g.normal(0, 3, (4000, 8)))
    ids = g.permutation(4000)
    pivots_ = pivots.choose(x, 24)
    dists, norms = pivots._distances(x, pivots_), (x * x).sum(axis=1)[:, None]
    order = np.argsort(dists.argmin(axis=1), kind="stable")
    block, q = (ids[order], x[order], norms[order], dists[order]), np.arange(0, 4000, 100)
    best = pivots.Best(len(q), 5)
    done = pivots.search_block(best, (ids[q], x[q], norms[q], dists[q]), block, 64, 16)
    for k, row in enumerate(q):
        want = sorted((-int(x[j] @ x[row]), int(ids[j])) for j in range(4000) if ids[j] != ids[row])[:5]
        assert [(-s, i) for s, i in zip(best.scores[k].tolist(), best.ids[k].tolist())] == want
    assert done < 0.5 * len(q) * 4000


def interpolated(toks):
    """Scores by deleted interpolation in plain Python, with the estimates as they are (the operator bins them)."""
    train = [ws for i, ws in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = collections.Counter(w for ws in train for w in ws), collections.Counter()
    one[None] = len(train)  # the place before a text
    for ws in train:
        two.update(zip([None, *ws], ws))
    n, types = sum(one.values()) - len(train), len(one) - 1

    def bucket(c):
        return int(math.log2(c)) + 1 if c > 0 else 0

    held = collections.defaultdict(list)
    for ws in train:
        for a, b in zip([None, *ws], ws):
            held[bucket(one[a] - 1)].append(((two[a, b] - 1) / max(one[a] - 1, 1), (one[b] - 1) / (n - 1), 1 / (types + 1)))
    lam = {0: (0.0, 0.9, 0.1)}
    for b in range(65):
        lam[b] = lam[b - 1] if b > 1 else (0.0, 0.9, 0.1)
        if b in held:
            w = (0.4, 0.4, 0.2) if b else (0.0, 0.7, 0.3)
            for _ in range(100):
                total = [0.0] * 3
                for q in held[b]:
                    whole = sum(x * y for x, y in zip(w, q))
                    for k in range(3):
                        total[k] += w[k] * q[k] / whole
                w = tuple(t / len(held[b]) for t in total)
            w = (*w[:2], max(w[2], 1e-6))
            lam[b] = tuple(x / sum(w) for x in w)
    out = []
    for _, ws in toks:
        score = 0.0
        for a, b in zip([None, *ws], ws):
            w = lam[bucket(one[a])]
            score += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] / (types + 1))
        out.append(score)
    return out


def test_op9(docs, none, rows):
    got = collections.defaultdict(list)
    for r in deleted.score(docs).collect():
        got[r["doc_id"]].append(r)
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]) for i, t, *_ in rows]
    count = collections.Counter(w for i, ws in toks if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in toks:
        for r in got[i]:
            base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n) and math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
    assert deleted.score(none).count() == 0
    want = interpolated(toks)
    off = [min(abs(r["score"] / score - 1) for r in got[i]) for (i, _), score in zip(toks, want)]
    assert max(off) < 0.03 and sorted(off)[len(off) // 2] < 0.001  # estimates are binned by eighths of a halving
    lam = deleted.learn(np.array([(1 << 20) + (1 << 10) + 9]), np.array([10]), 100)
    assert np.allclose(lam.sum(axis=1), 1)


def alike_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = word_list(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
        sets[i] = ({(g, n) for g, c in grams.items() for n in range(c)}, t, w)
    parent = {i: i for i in sets}

    def alike(a, b):
        (x, s, v), (y, t, w) = sets[a], sets[b]
        if s is None or t is None or s == t:
            return s == t is not None
        size = max(len(v), len(w))
        return bool(x & y) and (len(x & y) >= 0.8 * len(x | y) or abs(len(v) - len(w)) <= 0.2 * size and omh._plain_edits(v, w) <= 0.2 * size + 1e-9)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and find(a) != find(b) and alike(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_op10(spark, docs, none, rows):
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(docs).collect()}
    assert got == alike_classes(rows) and got[24] == got[25] == 23 and got[22] == 21 and got[20] == 20
    assert omh.classes(none).count() == 0
    kept = omh.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("small", [0, omh.SMALL])
def test_op10_rows_go_by_their_text(spark, monkeypatch, small):
    """Null and shared doc_ids, repeated rows, names that clash."""
    monkeypatch.setattr(omh, "SMALL", small)
    base, other, third = prose(60), prose(60), prose(60)
    near = base.replace(base.split()[9], "changed")
    table = [(5, base), (5, other), (5, other), (None, base), (None, near), (None, third), (None, None), (7, None), (3, near), (9, third), (9, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in table], "doc_id bigint, text string, key int, `no.de` int")
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in omh.classes(docs).collect())
    assert got == {(5, 3): 1, (5, 5): 2, (None, 3): 2, (None, 9): 1, (None, None): 1, (7, 7): 1, (3, 3): 1, (9, 9): 2}
    kept = omh.keep_first(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == {(3, near): 1, (5, other): 1, (9, third): 1, (9, ""): 1, (None, None): 1, (7, None): 1}


@pytest.mark.parametrize("small", [0, omh.SMALL])
def test_op10_edit_similarity(spark, monkeypatch, small):
    """Copies with a change in every twelfth word have a shingle similarity of 0.4 only, and are alike."""
    monkeypatch.setattr(omh, "SMALL", small)
    table = []
    for k in range(30):
        w = prose(140).split()
        table.append((2 * k, " ".join(w)))
        table.append((2 * k + 1, " ".join(f"new{k}" if p % 12 == 3 else x for p, x in enumerate(w))))
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert all(got[k] >= k // 2 * 2 for k in got) and sum(got[2 * k + 1] == 2 * k for k in range(30)) >= 27


def test_components_of_a_star(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(60, 61), (59, 62)], "a bigint, b bigint")
    for degree in (5, 1000):
        assert {r["node"]: r["component"] for r in omh.components(edges, degree).collect()} == {k: 60 if k in (60, 61) else 0 for k in range(63)}


def test_edits_within_a_band():
    for _ in range(500):
        x = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        y = [rng.randrange(6) if rng.random() < 0.2 else v for v in x if rng.random() > 0.1]
        most, want = rng.randint(0, 12), omh._plain_edits(x, y)
        got = omh.edits(np.array(x, dtype="<u4"), np.array(y, dtype="<u4"), most)
        assert got == want if want <= most else got > most


def test_op10_large_group_around_a_base(spark):
    """Copies that are near their base but not near each other are one class."""
    base = prose(150).split()
    table = [(0, " ".join(base))]
    for k in range(1, 80):
        w = list(base)
        for p in rng.sample(range(150), 2 + k % 3):
            w[p] = f"new{k}x{p}"
        table.append((k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert got == alike_classes(table)


def test_op10_passage_in_longer_texts(spark):
    """Short-tailed copies of a passage are alike, also where most texts with it have longer tails."""
    passage = " ".join(f"common{p}" for p in range(400))
    tails = [96] * 3 + [104] * 100
    table = [(k, f"{passage} " + " ".join(f"own{k}x{p}" for p in range(n))) for k, n in enumerate(tails)]
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert got == {k: 0 if k < 3 else k for k in range(103)}


@pytest.mark.parametrize("pairs", [0, 1 << 40])
def test_op10_rounds_find_what_comparing_all_finds(spark, monkeypatch, pairs):
    """All texts in one bucket; the leader holds all that two texts with moved parts share."""
    sketched = omh._sketched
    monkeypatch.setattr(omh, "_sketched", lambda docs: sketched(docs).withColumn("sketch", F.expr("if(size > 0, array(1L), sketch)")))
    monkeypatch.setattr(omh, "PAIRS", pairs)
    a, b = (" ".join(f"{side}{p}" for p in range(100)) for side in "ab")
    texts = [f"{a} {b}" + f" end{k}" * (k > 0) for k in range(20)] + [f"{b} " + " ".join(f"own{k}x{p}" for p in range(12)) + f" {a}" for k in range(2)]
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {k: 0 if k < 20 else 20 for k in range(22)}


def test_op10_rounds_without_few_pairs(spark, monkeypatch):
    """The same with no bucket left for the comparison of all pairs."""
    monkeypatch.setattr(omh, "FEW", 0)
    test_op10_rounds_find_what_comparing_all_finds(spark, monkeypatch, 0)


def test_op10_unlike_pairs_are_not_compared(spark, monkeypatch):
    """Texts that share common lines only: besides the first star, hardly a pair gets as far as its words in order."""
    sketched, compared, tested = omh._sketched, omh._compared, []
    monkeypatch.setattr(omh, "_sketched", lambda docs: sketched(docs).withColumn("sketch", F.expr("if(size > 0, array(1L), sketch)")))

    def counted(stars, *rest):
        tested.append(stars.count())
        return compared(stars, *rest)

    monkeypatch.setattr(omh, "_compared", counted)
    first, second = (" ".join(f"{line}{p}" for p in range(12)) for line in ("first", "second"))
    texts = [f"{first} " + " ".join(f"own{k}x{p}" for p in range(60 + k)) + f" {second}" * (k % 2) for k in range(24)] + [f"{first} " + " ".join(f"own5x{p}" for p in range(2, 65)) + f" {second}"]
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {k: 5 if k == 24 else k for k in range(25)}
    assert sum(tested) <= 24 + 3


def groups_in_many_buckets(monkeypatch):
    """Texts that meet in three buckets (30 near copies, 12 texts that share two lines only), the classes to come, and the numbers of pairs that are formed."""
    sketched, possible, formed = omh._sketched, omh._possible, []
    monkeypatch.setattr(omh, "_sketched", lambda docs: sketched(docs).withColumn("sketch", F.expr("if(size > 0, array(1L, 2L, 3L), sketch)")))

    def counted(pairs, *rest):
        formed.append(pairs.count())
        return possible(pairs, *rest)

    monkeypatch.setattr(omh, "_possible", counted)
    line = " ".join(f"line{p}" for p in range(12))
    base = " ".join(f"base{p}" for p in range(80))
    texts = [f"{line} {base} end{k}" for k in range(30)] + [f"{line} " + " ".join(f"own{k}x{p}" for p in range(70 + k)) for k in range(12)]
    return texts, {k: 0 if k < 30 else k for k in range(42)}, formed


def test_op10_pairs_go_by_groups(spark, monkeypatch):
    """Not 30 pairs for each text besides a group of 30, nor one for each bucket."""
    texts, want, formed = groups_in_many_buckets(monkeypatch)
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == want
    assert sum(formed) <= 13 * 12 // 2


def test_op10_pairs_of_groups_lose_no_alike_pair(spark):
    """Pairs by way of groups and of buckets taken together, against all pairs of each bucket."""
    texts = []
    for size in (30, 60, 61):
        base = [f"w{rng.randrange(size)}" for _ in range(size)]
        for k in range(16):
            gone = set(rng.sample(range(size), rng.randint(0, size // 4)))
            texts.append([f"z{k}" if p in gone else w for p, w in enumerate(base)])
    words = omh._word_rows(spark.createDataFrame([(k, " ".join(t), False) for k, t in enumerate(texts)], "node bigint, text string, many boolean"))
    part = {k: k - k % 16 + rng.choice([0, 3, k % 16]) for k in range(len(texts))}
    part |= {p: p for p in part.values()}
    buckets = {b: set(rng.sample(range(len(texts)), rng.choice([2, 12, 30]))) for b in range(30)} | {b: set(range(6, 40)) - {b} for b in range(30, 45)}
    own = spark.createDataFrame([(b, k, part[k]) for b, ks in buckets.items() for k in ks], "bucket bigint, node bigint, part bigint")
    got = {frozenset((r["lead"], r["node"])) for r in omh._pairs(own, words, 0.8).collect()}
    both = {r["node"]: omh._both(bytes(r["words"])) for r in words.collect()}
    met = {frozenset((a, b)) for ks in buckets.values() for a in ks for b in ks if part[a] != part[b]}
    alike = {m for m in met for a, b in [sorted(m)] if omh.similarity(both[a][1], both[b][1]) >= 0.8 or omh.word_similarity(both[a][0], both[b][0]) > 0}
    assert len(alike) > 20 and alike <= got and all(part[a] != part[b] for a, b in map(sorted, got)) and len(got) < len(met) // 2
    one = omh._together(own)
    pairs = [sum(r["of_texts"] for r in omh._pairs_of(x).collect()) for x in (own, one)]
    assert pairs[1] < pairs[0]


def test_op10_bounds_lose_no_alike_pair(spark):
    """Words out of order and length classes, against all pairs."""
    texts = []
    for size in (1, 4, 5, 6, 40, 300):
        base = [f"w{rng.randrange(size)}" for _ in range(size)]
        for share in (0.0, 0.1, 0.19, 0.2, 0.25, 0.4):
            gone = set(rng.sample(range(size), int(share * size)))
            texts += [[w for p, w in enumerate(base) if p not in gone], ["z" if p in gone else w for p, w in enumerate(base)], base + ["more"] * int(share * size)]
    texts = [t for t in texts if t]
    words = omh._word_rows(spark.createDataFrame([(k, " ".join(t), False) for k, t in enumerate(texts)], "node bigint, text string, many boolean"))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    kept = {(r["lead"], r["node"]) for r in omh._possible(spark.createDataFrame(pairs, "lead bigint, node bigint"), words, 0.8).collect()}
    both = {r["node"]: omh._both(bytes(r["words"])) for r in words.collect()}
    alike = {(a, b) for a, b in pairs if omh.similarity(both[a][1], both[b][1]) >= 0.8 or omh.word_similarity(both[a][0], both[b][0]) > 0}
    assert alike <= kept and len(kept) < len(pairs) // 2
    members = spark.createDataFrame([(1, k, len(both[k][1])) for k in both], "bucket bigint, node bigint, size bigint")
    at = {}
    for r in omh._by_size(members, 0.8).collect():
        at.setdefault(r["node"], set()).add(r["bucket"])
    assert all(at[a] & at[b] for a, b in alike) and not at[0] & at[len(texts) - 1]


def test_order_matters():
    a = np.arange(100, dtype=np.uint64)
    assert omh.similarity(a, a) == 1
    assert omh.similarity(a, np.roll(a, 50)) < 0.8
    assert omh.word_similarity(a, np.roll(a, 50)) == 0
    forward, back = (omh.sketches(x, np.array([0, 2])) for x in (a[:2], a[:2][::-1].copy()))
    assert not (forward == back).any()


def test_op4_documents_across_blocks_and_files(spark, tmp_path):
    rng, want = np.random.default_rng(4), []
    for name, n in (("a.bin", 999), ("b.bin", 40), ("c.bin", 1)):
        ids = np.where(rng.random(n) < 0.05, 9, 5)
        ids.astype("<u2").tofile(tmp_path / name)
        cuts = [0, *(np.flatnonzero(ids == 9) + 1).tolist()]
        want += [(name, k, a, b - a, True) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        if cuts[-1] < n:
            want.append((name, len(cuts) - 1, cuts[-1], n - cuts[-1], False))
    for size in (1, 13, 5000):
        got = separators.stitch(separators.scan_blocks(spark, f"file://{tmp_path}", 9, 2, size))
        assert sorted((r["file"], r["doc"], r["start"], r["n_ids"], r["closed"]) for r in got.collect()) == want
