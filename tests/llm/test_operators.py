"""Small cases for the corpus operators: nulls, empty and repeated rows, empty tables, clashing names, brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import chat, exact_dedup, langid, line_dedup, mixing, ngram_join, packing, toxicity, warc, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size long"


def words(rng, n):
    return " ".join(rng.choice("the of and to in is was for on with as by".split()) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    texts += [t + " extra" for t in texts[:8]] + texts[:5] + [None, "", " \n", "word", "ä" * 5]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 7 else None, 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, nothing):
    rows = exact_dedup.annotate(docs, counters=4).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    want = {hashlib.sha256(k.encode()).hexdigest(): (len(v), min((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in v)[2]) for k, v in groups.items()}
    assert len(rows) == docs.count()
    assert all((r.group_size, r.keep_id or 0) == want[r.text_sha256] for r in rows)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(nothing).isEmpty()


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def smallest_reachable(sets):
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_ngram_join(docs, nothing):
    rows = docs.filter("doc_id IS NOT NULL").collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    label = smallest_reachable(sets)
    got = ngram_join.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), label[i]) for i, s in sets.items()}
    assert ngram_join.near_duplicates(nothing).isEmpty()
    kept = ngram_join.near_dedup(docs)
    assert {r.doc_id for r in kept.collect()} == set(label.values()) | {None} and kept.columns == docs.columns


@pytest.mark.parametrize("tuning", [ngram_join.TUNING, ngram_join.Tuning(crowd=2, crowded=2, common=4, slice=3000), ngram_join.Tuning(crowd=3, crowded=2, margin=-9.0, slice=40_000)])
def test_ngram_join_equals_brute_force_however_it_is_tuned(spark, tuning):
    """Groups around the threshold, a passage that all share, and chunk counts too low for most sets."""
    rng = random.Random(3)
    passage, texts = words(rng, 30), []
    for _ in range(4):
        base = words(rng, 90).split()
        for _ in range(25):
            edited = list(base)
            for at in rng.sample(range(90), rng.randrange(1, 6)):
                edited[at] = f"new{rng.randrange(5)}"
            texts.append(" ".join(edited) + (" " + passage if rng.random() < 0.5 else ""))
    texts += [words(rng, 60) + " " + passage for _ in range(30)]
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tuning=tuning)
    assert {r.doc_id: r.component_id for r in got.collect()} == smallest_reachable(sets)


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        both, one, other = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in rng.integers(1, 200, 3))
        a, b = ngram_join.bit_sketches([np.unique(np.append(both, one)), np.unique(np.append(both, other))], 256)
        assert np.bitwise_count(a ^ b).sum() <= len(one) + len(other)


def test_bounds_of_the_join():
    for n in range(1, 300):
        for m in range(n, 100 * n // 75 + 1):
            most = max((n + m - 2 * i for i in range(n + 1) if 100 * i >= 75 * (n + m - i)), default=None)
            assert most is None or most == ngram_join.difference(n, m, 75)


def test_mixing(docs, nothing):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(sum(r.size for r in rows))
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 1
        assert v[0].target <= 3 * v[0].source_size + 1e-6
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan_mix(nothing).isEmpty() and mixing.mix(nothing).isEmpty()


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, capacity=64).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0][r.start : r.start + 64]
        assert len(ids) == r.length
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(r.length for r in rows) / 64 + 2
    assert packing.pack(nothing).isEmpty()


def test_mixing_places_every_copy(spark):
    rows = [(i, "w " * (1 + i % 4), "small") for i in range(8)] + [(100 + i, "w " * 5, "tall") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"weights": (3, 1), "schedules": ((0.5, 1.0, 1.5), (1.0, 1.0))}
    plan = {r.doc_id: r for r in mixing.plan_mix(df, **options).collect()}
    size, copies = {i: len(t.split()) for i, t, _ in rows}, []
    for source in ("small", "tall"):
        stream = sorted((i for i, _, s in rows if s == source), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        target, at = plan[stream[0]].target, 0
        left, want = int(target), {i: [] for i in stream}
        while left > 0:
            for i in stream:
                took = min(size[i], left)
                if took > 0:
                    share = (at + took / 2) / target
                    # The integral of 0.5 + t is (t + t * t) / 2, which is 1 at time 1.
                    want[i].append((2 * share + 0.25) ** 0.5 - 0.5 if source == "small" else share)
                    copies += [(want[i][-1], i)] * (2 * took >= size[i])
                at, left = at + size[i], left - took
        for i in stream:
            assert plan[i].positions == pytest.approx(want[i])
            assert plan[i].position == (plan[i].positions[0] if want[i] else None)
    assert max(len(r.positions) for r in plan.values()) == 3
    assert [r.doc_id for r in mixing.mix(df, **options).collect()] == [i for _, i in sorted(copies)]


def fewest_bins(items, capacity, bins=()):
    """Brute force: each piece into every bin where it fits, or a new one."""
    if not items:
        return len(bins)
    n, rest = items[0], items[1:]
    found = [fewest_bins(rest, capacity, (*bins[:i], b + n, *bins[i + 1 :])) for i, b in enumerate(bins) if b + n <= capacity and b not in bins[:i]]
    return min([*found, fewest_bins(rest, capacity, (*bins, n))])


def test_packing_branches():
    def used(histogram, capacity, nodes=10**6):
        found, spent = packing.packed(histogram, capacity, nodes), {}  # None: until it is proven
        for pattern, times in found:
            assert times > 0 and sum(n * c for n, c in pattern.items()) <= capacity
            for n, c in pattern.items():
                spent[n] = spent.get(n, 0) + c * times
        assert spent == {n: c for n, c in histogram.items() if c}
        return sum(times for _, times in found)

    for k in (1, 3):
        assert used({6: k, 5: 4 * k, 4: k, 3: k, 2: k}, 12) == 3 * k
    rng = random.Random(2)
    for _ in range(60):
        items = sorted((rng.randrange(2, 11) for _ in range(8)), reverse=True)
        assert used({n: items.count(n) for n in items}, 17) == used({n: items.count(n) for n in items}, 17, None) == fewest_bins(items, 17)
    # A filling that the steps of the first search don't reach.
    counts = [0] * 101
    for n in range(10, 50, 2):
        counts[n] = 1
    counts[51], counts[7] = 1, 1
    assert packing.completion(counts, 51, 100, 1) == packing.completion(counts, 51, 100, 10**6)
    assert used({}, 12) == 0


@pytest.mark.parametrize("text", ["A.B, c. <|endoftext|> <|ENDOFTEXT|>", "don't I'll 1.5 ... a.. b,, É. é,", "İstanbul. ß, ﬁ. 北京. x́."])
def test_chunks_equal_whole_texts(text):
    ids = b"".join(map(packing.chunk_ids(packing.default_tokenizer()).__getitem__, text.encode().split()))
    whole = packing.chunk_ids(packing.default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids
    assert ids == b"".join(i.to_bytes(4, "little") for i in whole)


def test_language(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "the of and")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", False) and got[None][0] != "und"
    assert langid.train(nothing) is None and langid.identify(nothing, None).isEmpty()


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs)
    rng = random.Random(1)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(40))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    swahili = "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu."
    odd = spark.createDataFrame([(1, junk), (2, finnish), (3, swahili), (4, "xqzjk wvvxk " * 30)], "doc_id long, text string")
    assert [r.doc_id for r in langid.identify(odd, model).collect() if r.accepted] == []
    assert langid.identify(docs, model).filter("NOT accepted").count() <= 0.005 * docs.count()


def test_toxicity(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.94 * len(rows)
    assert sum(r.predicted > r.toxic for r in rows) <= 0.005 * len(rows)
    words = lambda text: set(re.sub("[^a-z]", " ", text.lower()).split())
    known = docs.join(labels, "doc_id").withColumn("out", F.expr("crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1")).collect()
    seen = {t: Counter(w for r in known if r.toxic == t and not r.out for w in words(r.text or "")) for t in (0, 1)}
    insults = [w for w, n in seen[1].items() if n >= 50 and not seen[0][w]]
    assert len(insults) >= 8
    for w in insults:
        assert min(model.scores([f"anly {w} hend", f"anly {w[:2]}*{w[2:]} hend"])) >= 0.7, w
    grown = [f"anly {w[:i]}{c}{w[i:]} hend" for w in insults for i in range(1, len(w)) for c in "xek"]
    assert np.mean(model.scores(grown) >= 0.7) >= 0.8
    by_rule = {r.doc_id for r in known if r.out and r.toxic and words(r.text or "") & set(insults)}
    assert sum(r.predicted and r.toxic for r in rows) >= len(by_rule)
    plain = model.scores(["anly scum hend"])[0]
    assert plain > 0.7
    for sign in (".", "-", "*", "\u2022", "\u2019", "\u200b", "\u0301", " "):
        assert model.scores([f"anly {sign.join('scum')} hend"])[0] == pytest.approx(plain)
    assert model.scores(["anly \uff53\u00e7\u00fbm hend"])[0] == pytest.approx(plain)
    long = "anly hend " * 3000
    whole = model.scores([long + "scum " + long, long, ""], size=1 << 30)
    assert model.scores([long + "scum " + long, long, ""], size=500) == pytest.approx(whole) and whole[0] > 0.7 > whole[1]
    assert all(p == q for p, q in zip(toxicity.words_of("don\u2019t \u0432\u043e\u0434\u0430"), toxicity.words_of("dont \u0434\u043e\u043c\u0430"), strict=True))
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score < 0.5 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(nothing, None).isEmpty()


def test_subsequence_kernel():
    """Sums over a table equal those over every three places of a word, the blanks around it included."""
    rng = np.random.default_rng(6)
    table = rng.normal(size=1 << 15).astype(np.float32)
    for word in ("ab", "abab", "scum", "aaaaaa", "subsequence"):
        codes = [0, *(ord(c) - 96 for c in word), 0]
        places = [(i, j, k) for i in range(len(codes)) for j in range(i + 1, len(codes)) for k in range(j + 1, len(codes)) if k - i <= toxicity.SPAN]
        want = sum(toxicity.DECAY ** (k - i) * table[(codes[i] << 10) + (codes[j] << 5) + codes[k]] for i, j, k in places)
        norm = sum(toxicity.DECAY ** (2 * (k - i)) for i, j, k in places) ** 0.5
        c, starts, _ = toxicity.letters(f" {word} ")
        assert toxicity.word_sums(c, starts, table)[0] == pytest.approx(want / norm, rel=1e-4)
        found = dict.fromkeys(range(1 << 15), 0.0)
        for code, weight in zip(*toxicity.subsequences(bytes(codes[1:-1])), strict=True):
            found[code] += weight
        assert sum(table[code] * weight for code, weight in found.items()) == pytest.approx(want / norm, rel=1e-4)


def test_letters_are_of_category_l(spark):
    odd = ["\u00b2", "\u00bd 12", "\u2167", "_", "\u0661"]
    assert not any(langid.has_letter(t.encode()) for t in odd) and langid.has_letter("12 \u00e9".encode()) and langid.has_letter("\u4eac".encode())


def test_exact_dedup_breaks_ties(spark):
    rows = [(1, "a b", 1), (1, "ab ", 2), (1, "a b", 3), (2, "ab", 4), (3, "x", 5), (3, "x", 6), (None, "y", 7), (None, "y", 8), (4, "y", 9)] + [(9, "hot", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of_best int")
    for counters in (2, 256):
        marks = exact_dedup.annotate(df, counters=counters).collect()
        assert sorted((r.keep_id, r.group_size) for r in marks if r.kept) == [(1, 4), (3, 2), (4, 3), (9, 20)]
        kept = exact_dedup.exact_dedup(df, counters=counters)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 9] and kept.columns == df.columns


def test_clashing_names(spark):
    names = "marked_ string, starts_ int, lines_ int, n_ int, i_ int, s_ int, z_ int, words_here int, plan_id int, key_digest int, best int, row int, hub int, member int, label int, slice int, kind int, value int"
    df = spark.createDataFrame([(1, "a\nb\nc", "s"), (2, "a\nb\nc\nd", None), (None, "\u00e9 " * 9, "s")], "doc_id long, text string, source string").select("*", *(F.lit(None).cast(n.split()[1]).alias(n.split()[0]) for n in names.split(", ")))
    assert line_dedup.line_dedup(df).count() == 3 and mixing.mix(df).columns == df.columns
    assert exact_dedup.exact_dedup(df).columns == df.columns and ngram_join.near_dedup(df).columns == df.columns
    assert packing.pack(df).count() == winnowing.compared(df).count() == langid.identify(df, None).count() == toxicity.score(df, None).count() == 3


def test_long_texts(spark):
    """A text of millions of characters, beside its copy and a null id."""
    rng = random.Random(8)
    long = words(rng, 300_000)
    df = spark.createDataFrame([(1, long, "s"), (2, long + " more", "s"), (None, long, None)], "doc_id long, text string, source string")
    assert [r.component_id for r in ngram_join.near_duplicates(df).orderBy("doc_id").collect()] == [None, 1, 1]
    assert exact_dedup.exact_dedup(df).count() == 2 and mixing.plan_mix(df).filter("size >= 300000").count() == 3
    assert packing.pack(df).agg(F.sum("length")).first()[0] > 900_000
    assert winnowing.compared(df).filter("near_next > 0.99").count() == 3
    lines = df.withColumn("text", F.translate("text", " ", "\n"))
    assert line_dedup.line_dedup(lines).agg(F.sum("n_removed")).first()[0] >= 600_000


def test_warc(spark):
    long = "x" * 1200
    pages = spark.createDataFrame([(1, "http://a.b.com/x?y", long), (2, None, long), (3, "https://A.b.com/ü\r\nz", "short"), (4, "http://c", "short"), (5, "q", None), (5, "q", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.write(pages).lookup(warc.captures(pages)).collect()}
    assert (rows[1].record_type, rows[1].refers_to, rows[1].payload_bytes) == ("revisit", 2, 1200)
    assert rows[2].record_type == rows[3].record_type == rows[4].record_type == "response"
    assert rows[5].payload_bytes == 0 and rows[3].payload_digest == hashlib.sha1(b"short").hexdigest()
    again = {r.page_id: r for r in warc.write(pages, broadcast_rows=0, index_rows=1).lookup(warc.captures(pages)).collect()}
    assert again == rows
    none = warc.write(pages.limit(0))
    assert none.lookup(warc.captures(pages)).isEmpty()
    assert {r.key for r in warc.captures(pages).collect()} >= {"com,b,a)/x?y", ")", "c)"}


def test_chat_tree(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0.0, "user", "hi <|end|>[x]&amp;"), (1, 2, 1, 5.0, "assistant", "a\n"), (1, 3, 1, 1.0, "assistant", "b"), (1, 4, 2, 5.0, "user", ""), (9, 1, None, 0.0, None, None), (2, 1, 2, 0.0, "user", "loop"), (2, 2, 1, 0.0, "user", "loop")], "tree long, node long, parent long, score double, role string, text string").na.fill("", ["role", "text"])
    rows = {(r.tree, r.rank): r for r in chat.parsed(chat.format_conversations(nodes)).collect()}
    assert set(rows) == {(1, 1), (1, 2), (9, 1)}
    assert [tuple(t) for t in rows[1, 1].turns] == [("user", "hi <|end|>[x]&amp;"), ("assistant", "a\n"), ("user", "")]
    assert rows[1, 1].loss_text == "a\n" and rows[1, 2].loss_text == "b"
    assert chat.branches(nodes, best=1).count() == 2


def test_chat_paths_equal_brute_force(spark):
    """Random trees with a long chain, a missing parent, cycles, leaves below them, a null tree and ties in score."""
    rng = random.Random(10)
    rows = [(tree, i, rng.randrange(i) if i else None, float(rng.randrange(3))) for tree in (1, 2, None) for i in range(25)]
    rows += [(3, i, i - 1 if i else None, None) for i in range(70)] + [(4, 1, 99, 1.0), (4, 2, 1, 2.0)]
    rows += [(5, 1, 2, 0.0), (5, 2, 1, 0.0), (5, 3, 2, 0.0), (5, 4, 3, 0.0), (5, 5, 5, 0.0), (5, 6, None, 0.0)]
    above = {(t, n): p for t, n, p, _ in rows}
    score = {(t, n): s or 0.0 for t, n, _, s in rows}
    want = {}
    for t, n in above:
        path, now = [], n
        while (t, now) in above and len(path) <= len(rows):
            path.insert(0, now)
            now = above[t, now]
        if len(path) <= len(rows) and n not in {p for (x, _), p in above.items() if x == t}:
            want.setdefault(t, []).append((-sum(score[t, x] for x in path) / len(path), n, path))
    nodes = spark.createDataFrame([(*r, "user", "x") for r in rows], "tree long, node long, parent long, score double, role string, text string")
    got = {}
    for r in chat.branches(nodes).orderBy("rank").collect():
        got.setdefault(r.tree, []).append((r.leaf, r.path))
    assert got == {t: [(n, path) for _, n, path in sorted(found)] for t, found in want.items()}
    assert chat.format_conversations(nodes.limit(0)).isEmpty()


def test_winnowing(docs, nothing):
    rows = {r.doc_id: r for r in winnowing.compared(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        t, n = texts[k], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[k].n_chars == len(t)
    assert rows[0].fingerprint == rows[68].fingerprint != rows[1].fingerprint
    assert winnowing.compared(nothing).isEmpty()


def gram_hashes(text):
    def rolled(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else (x % 2**64).to_bytes(8, "little"), seed)
        return seed - 2**64 if seed >= 2**63 else seed

    h = [rolled(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    for step in (1, 2):
        if len(h) > step:
            h = [rolled(a, b) for a, b in zip(h, h[step:], strict=False)]
        elif h:
            h = [rolled(("[" + ",".join(map(str, h)) + "]").encode())]
    return h


def winnowed(text):
    h, chosen = gram_hashes(text), set()
    for at in range(max(1, len(h) - winnowing.WINDOW + 1) if h else 0):
        window = range(at, min(len(h), at + winnowing.WINDOW))
        chosen.add(min(window, key=lambda i: ((h[i] % 2**64) >> 32, -i)))
    return [(h[i] % 2**64, i) for i in sorted(chosen)]


def test_winnowing_equals_brute_force(spark):
    """Fingerprints, edited fingerprints and both likenesses, over many small buckets."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40))) for _ in range(40)] + [words(rng, n) for n in range(30)] + ["\u00e9 \t\u4eac", ""]
    df = spark.createDataFrame([(7 * i % 97, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = {7 * i % 97: t for i, t in enumerate(texts)}
    order = sorted(known, reverse=True)

    def alike(a, b):
        a, b = ({h for h, _ in x} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for bucket_rows in (4000, 5, 1):
        for r in winnowing.compared(df, bucket_rows=bucket_rows).collect():
            text, after = known[r.doc_id], known[order[(order.index(r.doc_id) + 1) % len(order)]]
            edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
            shown = lambda t: " ".join(f"{h:x}@{i}" for h, i in winnowed(t))
            assert (r.fingerprint, r.edited_fingerprint) == (shown(text), shown(edited))
            assert (r.near_edited, r.near_next) == pytest.approx((alike(winnowed(text), winnowed(edited)), alike(winnowed(text), winnowed(after))))


def test_winnowing_cuts_evenly():
    for rows in (3_999, 4_000, 400_000, 16_400_000, 300_000_000):
        edges = [0.0, *winnowing.cut_shares(rows, 4000), 1.0]
        assert max(b - a for a, b in zip(edges, edges[1:], strict=False)) <= max(4000 / rows, 1 / 65536) * 1.001 or rows < 4000


def test_winnowing_shares_long_runs(spark):
    rng = random.Random(5)
    shared = words(rng, winnowing.GRAM + winnowing.WINDOW - 1)
    df = spark.createDataFrame([(i, words(rng, 30) + " " + shared + " " + words(rng, 30)) for i in range(6)], "doc_id long, text string")
    found = [{x.split("@")[0] for x in r.fingerprint.split()} for r in winnowing.fingerprints(df).collect()]
    assert set.intersection(*found)


def test_line_dedup(spark, nothing):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", 7), (2, "x\na\nb\nc\nd\ny", 7), (3, "a\nb", 7), (4, None, 7), (5, "q\nq\nq\nq\nq", 7), (5, "q\nq\nq\nq\nq", 7)], "doc_id long, text string, n_lines int")
    out = line_dedup.line_dedup(df)
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].text for i in (1, 2, 3, 4)] == ["a\nb\nc\nd", "x\ny", "a\nb", None]
    assert rows[5].text == "q" and rows[5].n_removed == 4 and out.count() == 6
    assert out.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_removed"]
    assert line_dedup.line_dedup(nothing).isEmpty()


def test_line_dedup_equals_brute_force(spark):
    """Overlapping windows, with hot ones broadcast and not."""
    rng = random.Random(12)
    texts = {i: "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for i in range(40)}
    seen, want = set(), {}
    for i, text in texts.items():
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()} == want
    few, many = (line_dedup.repeated(df, "doc_id", "text", hot=n).select("doc_id", "starts") for n in (1000, 5))
    assert sorted(few.collect()) == sorted(many.collect())



def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = ngram_join.near_dedup(exact_dedup.exact_dedup(docs))
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.collect()}
    assert docs.filter(F.col("doc_id").isin([r.doc_id for r in rows])).count() > 0
