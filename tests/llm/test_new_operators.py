"""Spelling variants, hard negatives and quality rules against brute force."""

import random
import zlib

import numpy as np
import pytest

from graphloom.llm import hard_negatives, quality, variants
from graphloom.llm.components import components
from graphloom.llm.queries import op11_spelling_variants, op12_hard_negatives, op13_quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- spelling variants


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {w: min((v for v in near[w] if counts[v] >= 5 * counts[w]), key=lambda v: (-counts[v], v), default=None) for w in counts}
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return out


@pytest.mark.parametrize("leaf", [1, 5, 4096])
def test_near_words_are_all_pairs_at_distance_one(spark, leaf):
    rng = random.Random(leaf)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)} | {"a" * n for n in range(1, 30)} | {"a" * 14 + "b" + "a" * n for n in range(15)} | {"x" * 300, "x" * 299 + "y", "x" * 301}
    counts = {w: rng.choice([5, 6, 30, 200, 1000, 5000]) for w in words}
    found = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), leaf=leaf)
    got = found.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == brute_variants(counts)


def test_hot_prefixes_are_cut_until_they_fit(spark):
    words = [("international" + a + b + c, 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = variants.subtries(spark.createDataFrame(words, "word string, n long"), leaf=40)
    assert rows.groupBy("m", "a", "b", "head", "tail").count().agg({"count": "max"}).first()[0] <= 64 + 8
    near = variants.near_words(spark.createDataFrame(words, "word string, n long"), leaf=40)
    assert near.count() == 512 * 21


def test_words_of_whole_texts(spark):
    texts = [(1, "Straße STRASSE strasse, abcdef×ghij short"), (2, None), (3, ""), (None, "Straße " * 3), (4, "q" * 100_000 + " ÀÉÎÕÜß"), (1, "Straße STRASSE strasse, abcdef×ghij short")]
    rows = [(i, t, None, None, 0) for i, t in texts]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS word", "2 AS n")
    want = {}
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run
                if len(word) >= 6:
                    want[word] = want.get(word, 0) + 1
                run = ""
    got = variants.occurrences(docs, deletes=3).groupBy("word").count().collect()
    assert {r[0]: r[1] for r in got} == want
    assert variants.spelling_variants(spark.createDataFrame([], DOC)).isEmpty()


def test_variant_chains_end_at_the_root(spark):
    counts = {"abcdefg": 5, "abcdefh": 25, "abcdefi": 125, "abcdexi": 625, "abcdexy": 3125, "abcddxy": 20000, "zzzzzz": 7}
    got = {r["word"]: r["root"] for r in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: r for w, *_, r in brute_variants(counts)} and got["abcdexi"] == "abcddxy"


# --- hard negatives


def brute_negatives(rows, m=hard_negatives.Mining(), every=100):
    rows = [(i, label, [int(np.floor(m.scale * float(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    out = []
    for i, label, v in rows:
        if i % every == 0:
            scored = sorted([(-sum(a * b for a, b in zip(v, w)), j, k) for j, k, w in rows if j != i])
            for s, j, _ in [x for x in scored if x[2] == label][: m.positives]:
                fit = [x for x in scored if x[2] != label and m.low * -s <= 100 * -x[0] <= m.high * -s]
                out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fit[: m.negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=100, **kw):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS square", "3 AS rank")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, label, **kw).collect())


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "PART", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8) * np.exp(spread * rng.normal())], int(rng.integers(4))) for i in range(700)]
    rows += [(700, None, 1), (701, [1.0, None] * 4, 1), (702, [float("nan")] * 8, 1), (703, [float("inf")] * 8, 1), (704, [0.5] * 8, None), (None, [0.5] * 8, 1)]
    rows += [(705, [0.1] * 8, 2)] * 4 + [(800, [0.0] * 8, 1), (900, [], 2), (901, [0.5] * 3, 2), (902, [0.5] * 11, 3)]
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and len({r[0] for r in want}) > 5


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    one = [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [0.5, 0.0], 2), (103, [0.5, 0.0], 2), (104, [-1.0, 0.0], 2)]
    assert mined(spark, one) == [(100, 101, 1, 102, 65536, 32768), (100, 101, 2, 103, 65536, 32768)]
    big = [(100, [3e6, 2e6], 1), (101, [3e6, 1e6], 1), (102, [2e6, 1e6], 2), (103, [1e30, 1.0], 2)]
    assert mined(spark, big) == brute_negatives(big[:3])  # beyond 2^53; what can't fit 64 bits takes no part


def test_buckets_that_cannot_reach_a_window_are_passed_over():
    block = hard_negatives.Block(np.array([1]), np.array([0]), np.array([[3.0, 4.0]]), np.array([5.0]), np.array([0]), np.array([100]), np.array([200]), False, 10)
    assert 19.9 < block.reach() <= 20
    block.floor[0] = -5
    assert block.reach() <= 0
    block.floor[0], block.ceiling[0] = 5, 4
    assert block.reach() == np.inf


# --- quality rules


def brute_counts(text):
    words = text.encode().split()
    again = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(again) if again.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_grams(text):
    words = [w.decode() for w in text.encode().split()]
    s = f" {' '.join(words)} " if words else ""
    return [((ord(a) * 1000003 + ord(b)) * 1000003 + ord(c)) % 2147483647 % 65536 for a, b, c in zip(s, s[1:], s[2:])]


TEXTS = ["", " \n\t", "a", "ä ß x 日本 #$", "one two three " * 12, "l\nl\n \nl\nm\n\n", " ".join(map(str, range(50))), "a b c d e f g h " + "x y z " + "a b c d e f g h", "A a " * 30, "🙂 <b>|&%*</b>\r\nq\x0bq\x0cq", "w " * 9]


def test_base_counts_and_grams(monkeypatch):
    for text in TEXTS:
        assert quality.base_counts(text.encode()) == brute_counts(text), text
        assert np.concatenate([np.zeros(0, int), *quality.n_grams(text.encode())]).tolist() == brute_grams(text), text
    from graphloom.llm import _shingles

    monkeypatch.setattr(_shingles, "BLOCK", 7)  # texts in many pieces
    for text in TEXTS:
        assert quality.base_counts(text.encode()) == brute_counts(text), text
        assert np.concatenate([np.zeros(0, int), *quality.n_grams(text.encode())]).tolist() == brute_grams(text), text


def test_verdicts_follow_the_two_multinomials(spark):
    good = ["the cat sat on the mat and saw a dog that ran to the old house by the sea at night " + "again " * i for i in range(30)]
    bad = ["THE!! CAT### SAT$$$ ON%%% THE&&& MAT*** " * 4 + f"X{i} " * 3 for i in range(10)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(good + bad)] + [(900, None, None, None, 0), (None, good[0], None, None, 0), (901, good[3] * 4000, None, None, 0), (5, good[5], None, None, 0)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "true AS kept", "1 AS trusted", "2 AS is_good", "3 AS id_")
    trusted = spark.createDataFrame([(i,) for i in [*range(20), 5, 5, None]], "doc_id long")
    weights = quality.train(docs, trusted)
    raw, target = np.zeros(65536), np.zeros(65536)
    for i, t, *_ in rows:
        for g in brute_grams(t or ""):
            raw[g] += 1
            target[g] += i is not None and i < 20
    want = np.round(1000 * np.log(((target + 1) / (target.sum() + 65536)) / ((raw + 1) / (raw.sum() + 65536))))
    assert np.array_equal(weights, want.astype(int))
    got = quality.judge(docs, weights).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t, *_ in rows if i == r["doc_id"])
        counts, grams = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), brute_grams(text)
        if len(text) < 5000:
            assert counts == brute_counts(text)
        assert (r["n_grams"], r["ratio_sum"]) == (len(grams), sum(weights[grams]))
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r["kept"] == (not r["base_failed"] and r["ratio_sum"] >= -300 * len(grams))
    kept = quality.keep_good(docs, weights)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["kept"])
    assert not quality.train(docs, trusted.limit(0)).any()
    assert quality.judge(docs.limit(0), weights).isEmpty()


def test_held_out_quality_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = "crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1"
    weights = quality.train(docs, labels.filter(f"quality = 1 AND NOT {held}").select("doc_id"))
    rows = quality.judge(docs, weights).filter(held).join(labels, "doc_id")
    got = {(r["quality"], r["kept"]): r["count"] for r in rows.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert (1, False) not in got and got[0, False] >= 10 * got.get((0, True), 0)


@pytest.mark.parametrize("query", [op11_spelling_variants, op12_hard_negatives, op13_quality_rules])
def test_queries_agree_with_their_sql(spark, query):
    import duckdb

    from graphloom.llm.queries import oracle_sql

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got = query(spark, d)
    names = ", ".join(got.columns)
    want = con.sql(f"SELECT {names} FROM ({oracle_sql()[query.__name__]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and want


def test_new_chunks_of_a_text_are_tokenized_in_one_call():
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import packing

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.calls = tokenizer, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.tokenizer, name)

    path = packing.default_tokenizer()
    whole = packing.chunk_ids(path).tokenizer
    known = packing._LOADED[path] = packing.ChunkIds(Counted(whole))
    texts = ["Rädchen*** rädchen%%% Gear.$$$ gear, x×** don't' a.b. 3**  **", "", "<|endoftext|>. Gear*** X<|y", "gear"]
    try:
        (found,) = packing._cut(path, 2048)(iter([pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])]))
        assert known.tokenizer.calls == 2
        assert "rädchen".encode() in known and not any(c.startswith("rädchen*".encode()) for c in known)
        for text in texts:
            assert known.of(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert found.column("length").to_pylist() == [len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    finally:
        del packing._LOADED[path]


def test_language_sample_comes_to_the_driver_as_counts(spark, monkeypatch):
    from graphloom.llm import langid

    sizes, split = [], langid._split
    monkeypatch.setattr(langid, "_split", lambda lists: sizes.append(lists.type.value_type.bit_width) or split(lists))
    given = []
    monkeypatch.setattr(langid, "give_back", lambda: given.append(True))
    model = langid.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sizes == [16, 32] and given and len(model.langs) == 4


def test_components_of_links_that_lie_together_take_few_stages(spark):
    """Links are contracted where they lie: no round of shuffles for each step of a way."""
    rng = np.random.default_rng(7)
    ids = rng.permutation(6000).astype(int) - 3000
    ways = [(int(ids[i]), int(ids[i + 1])) for i in range(5999) if i % 40]  # ways of 40 nodes, in no order
    links = spark.createDataFrame(ways + ways[:100] + [(5, 5)], "a long, b long").repartition(3)
    smallest = {}
    for i in range(0, 6000, 40):
        way = [int(x) for x in ids[i + 1 : i + 41]]
        smallest |= {x: min(way) for x in way}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "")
    try:
        found = components(links).collect()
        stages = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setJobGroup("others", "")
    assert {r.node: r.label for r in found} == {x: smallest[x] for p in ways for x in p} and len(found) == len({x for p in ways for x in p})
    assert stages <= 60, stages


def test_components_where_contraction_stalls(spark):
    """One link to a task, along a way: what contraction leaves, the stars do."""
    links = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long").repartitionByRange(12, "a")
    assert {(r.node, r.label) for r in components(links).collect()} == {(i, 0) for i in range(13)}
    assert components(links.filter("a < 0")).collect() == []
