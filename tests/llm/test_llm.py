"""The training-data operators: brute force, round trips, held-out accuracy, and the odd cases of every table."""

import base64
import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithmesh.llm import ann, mixing, neardup, packing, quality, repair, sharding, spotsigs, tokens, toxicity, warc
from kithmesh.llm.queries import tokenizer
from kithmesh.llm.tokens import Pieces

DOCS = "doc_id long, text string, lang string, score double, n_tokens long"
ODD = [
    (1, "The cat sat on the mat and looked at the dog. It was a fine day.", "en", 0.1, 1),
    (2, None, "en", None, None),
    (3, "", None, None, None),
    (4, "The cat sat on the mat and looked at the dog. It was a fine day.", "en", 0.2, 2),
    (4, "The cat sat on the mat and looked at the dog. It was a fine day.", "en", 0.2, 2),
    (None, "wörter ohne ende 日本語   x", "de", 0.0, 0),
    (6, "?!", "en", 0.0, 0),
    (7, "long words " * 20_000, "en", 0.0, 0),
    (8, "one", "en", 0.0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_the_tokenizer(name):
    texts = ["a  b", "a   b c", " x y", "x\n y", "x \n\ny z", "", "don't we 're I'LL", "ΑΣ b", "é ́a b", "a b c", "<|endoftext|> a", "a\tb c  ", "İstanbul x", "日本 語 a", "| a |b", "a\n\nb c\n", "a\x1cb c", "Naïve, (words) end. 12a a12 a_b ###", *(t for _, t, *_ in ODD if t)]
    p = Pieces(tokenizer(name))
    for _ in range(2):  # the second time from what was kept
        for t, raw in zip(texts, p.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == ids_of(name, t)[:-1], t


@pytest.mark.parametrize(("span", "most"), [(1 << 22, 1 << 21), (40, 50)])
def test_plain_texts_are_looked_up_together(span, most, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "_SPAN", span, raising=False)
    monkeypatch.setattr(tokens, "_KEPT_WORDS", most, raising=False)
    rng = np.random.default_rng(5)
    letters, signs = list("abcdehinorstuABTéßÿÖ"), list(".,;:!?-()\"#_{~")
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 22, 2000)]  # more than the table begins with; some too long for a key
    odd = ["don't", "'s", "12", "a1", "(a", "a-b", "x" + "." * 20, "ª", "a×b", "µm", "§", "a½", "..", "\u00a1no", "'"]
    texts = []
    for n in rng.integers(1, 60, 400):
        some = [w + "".join(rng.choice(signs, k)) if k else w for w, k in zip(rng.choice(words, n), rng.integers(0, 3, n), strict=True)]
        some = [rng.choice(odd) if x else w for w, x in zip(some, rng.random(n) < 0.1, strict=True)]
        texts.append("".join(x for w in some for x in (rng.choice([" ", " ", "\n"]), w))[1:])
    texts += ["a", "", "a\x00b c", " a", "a<|endoftext|>b c", "日本 a b", "\x7f a", "w" * 200, "one two " * 300 + "end", *(w + "." for w in words)]
    p, whole = Pieces(tokenizer("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for _ in range(2):  # the second time from what was kept
        for t, raw in zip(texts, p.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    plain = [w for w in words if len(w) <= 15]
    p = Pieces(tokenizer("byte_bpe_50k.json"))
    p.encode([" ".join(w + "." for w in plain)])
    assert not p._kept  # no piece is looked up alone


# --- 1


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    rows = [(i, x[i].tolist()) for i in range(3000)]
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, [1.0]), (None, [1.0] * 16)]
    copies = [(5000 + k, x[0].tolist()) for k in range(30)]
    df = spark.createDataFrame(rows + bad + copies, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, list_mean=30, list_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([i for i, _ in rows + copies])
    want = ann.brute_force(np.array([v for _, v in rows + copies]), ids, ids[ids % 20 == 0], 20)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [v for _, v, _ in sorted(got[0])] == [v for v, _ in want[0]]  # ties between copies go to the smaller ids
    assert all([r for r, *_ in sorted(g)] == list(range(1, 21)) and not any(v == q for _, v, _ in g) for q, g in got.items())


def test_ann_reads_as_many_lists_as_recall_needs(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(4000, 32))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]  # no clusters
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, list_mean=10, read_lists=6).collect():  # 400 lists, as 64 of 4,096
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = ann.brute_force(x, np.arange(4000), np.arange(0, 4000, 20), 20)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values())) >= 0.93


def test_ann_rows_of_a_query_dont_grow_with_its_lists(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made, found = spark.sparkContext.accumulator(0), ann._found

    def counted(members, queries, k):
        out = found(members, queries, k)
        made.add(len(out))
        return out

    monkeypatch.setattr(ann, "_found", counted)
    answers = lambda **kw: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 20 == 0, list_mean=10, list_rows=50, **kw).collect())
    got = answers()
    assert made.value < 200 * 21 * (8 + 4)  # 200 queries; their lists gave ten times as many before
    assert got == answers(first_units=1_000_000)  # without floors


def test_ann_small_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert ann.search(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 0.0])], kind)
    assert [(r["vec_id"], r["score"]) for r in ann.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 2.0), (2, -1.0)]


# --- 2


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 63, 60).astype(np.uint64)
    a, b = (h[:45], rng.integers(1, 4, 45).astype(float)), (h[10:], rng.integers(1, 4, 50).astype(float))
    a, b = ((x[np.argsort(x)], w[np.argsort(x)]) for x, w in (a, b))
    exact = 0.0
    wa, wb = dict(zip(a[0].tolist(), a[1], strict=True)), dict(zip(b[0].tolist(), b[1], strict=True))
    for i in wa.keys() & wb.keys():
        exact += 1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in wa.keys() | wb.keys())
    assert neardup.likeness(*a, *b) == pytest.approx(exact, rel=1e-9)
    agree = []
    for s in range(40):  # other hashes, other draws
        k = np.uint64(s * 7919)
        sig = neardup.signatures(np.repeat([0, 1], [45, 50]), np.concatenate([a[0] ^ k, b[0] ^ k]), np.concatenate([a[1], b[1]]), 2)
        agree.append((sig[0] == sig[1]).mean())
    assert np.mean(agree) == pytest.approx(exact, abs=0.03)


def brute_classes(texts):
    words, counts = neardup.word_hashes(texts)
    doc, h, w = neardup.shingles(words, counts)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [(h[i:j], w[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or neardup.likeness(*sets[i], *sets[j]) >= 0.8:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [[f"w{rng.integers(10**6)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for k in range(150):
        t = list(base[k % 6])
        for p in rng.integers(0, 120, rng.integers(0, 7)):
            t[p] = f"x{rng.integers(40)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    want = brute_classes(texts)
    assert [got[k] for k in range(150)] == want
    assert neardup.dedup(df).count() == len(set(want))


def plain_likeness(a, b):
    """Probability Jaccard of two texts from its definition, over word tuples."""
    def bag(t):
        w = t.lower().split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    x, y = bag(a), bag(b)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_classes_against_the_definition(spark):
    rng = np.random.default_rng(15)
    base = [f"w{rng.integers(10**6)}" for _ in range(80)]
    texts = []
    for _ in range(60):  # one group around the threshold
        t = list(base)
        for p in rng.integers(0, 80, rng.integers(0, 5)):
            t[p] = f"x{rng.integers(30)}"
        texts.append(" ".join(t))
    want = list(range(60))
    for i, j in itertools.combinations(range(60), 2):
        if texts[i] == texts[j] or plain_likeness(texts[i], texts[j]) >= 0.8:
            a, b = sorted((want[i], want[j]))
            want = [a if x == b else x for x in want]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for exact in (False, True):
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df, exact=exact).collect()}
        assert [got[k] for k in range(60)] == want


def test_two_long_texts_of_different_words(spark):
    words = [f"w{k}" for k in range(200_000)]
    other = [w if k % 1000 else "x" for k, w in enumerate(words)]
    far = [w if k % 20 else "x" for k, w in enumerate(words)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((words, other, far))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_dedup_leaves_clashing_columns_alone(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "a b", 5, 6, 7)], "doc_id long, text string, _id long, _hash long, label long")
    kept = neardup.dedup(df)
    assert [tuple(r) for r in kept.collect()] == [(1, "a b", 5, 6, 7)] and kept.columns == df.columns
    model = mixing.fit_domains(["a", "b"], ["en", "de"])
    assert mixing.resample(df, model, {"en": 1.0}).columns == df.columns


def test_classes_of_odd_rows(odd, empty):
    got = [(r["doc_id"], r["class_id"]) for r in neardup.classes(odd).collect()]
    assert len(got) == len(ODD) and (4, 1) in got and (3, 2) in got and (None, None) in got and (6, 6) in got
    kept = neardup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert neardup.classes(empty).count() == 0 and neardup.dedup(empty).count() == 0


def test_dedup_keeps_a_row_of_each_class_whatever_its_id(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (10, text(2)), (None, text(3)), (11, text(3)), (7, text(4)), (7, text(5)), (8, text(5)), (12, text(6)), (None, None), (None, "")]
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(0, text(1)), (0, text(2)), (0, text(3)), (7, text(4)), (7, text(5)), (12, text(6)), (0, "")])


# --- 3


def test_mixing_reaches_targets(spark, empty, odd):
    rng = np.random.default_rng(3)
    vocab = {"en": ["the", "and", "of"], "de": ["der", "und", "von"]}
    rows = [(i, " ".join(rng.choice(vocab[d], 50)), d) for i in range(400) for d in ["en" if i % 4 else "de"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = mixing.train(df, df.select("doc_id"))
    out = mixing.mix(df, model, {"en": 0.5, "de": 0.5}).toPandas()
    total = (out["rate"] * out["n_tokens"]).groupby(out["domain"]).sum()
    assert abs(total["en"] / total.sum() - 0.5) < 0.02 and (out["rate"] >= 0).all()
    up = mixing.resample(df, model, {"en": 0.5, "de": 0.5})
    share = {r["lang"]: r["count"] for r in up.groupBy("lang").count().collect()}
    assert share["en"] >= 300 and abs(share["de"] / up.count() - 0.5) < 0.06 and up.columns == df.columns
    assert mixing.mix(empty, model, {"en": 1.0}).count() == 0
    assert mixing.mix(odd, model, {"en": 0.6, "de": 0.4}).count() == len(ODD)
    assert mixing.resample(odd, model, {"en": 0.6, "de": 0.4}).count() >= len(ODD)


@pytest.mark.parametrize("start, least, total", [(1.0, 0.0, None), (5.0, 1.0, 5e6)])
def test_rates_reach_a_plentiful_and_a_scarce_domain(spark, start, least, total):
    rng = np.random.default_rng(9)
    kind = rng.choice(4, 1000, p=[0.4, 0.4, 0.18, 0.02])  # targets .1 .5 .2 .2: the first at 4 times its target, the last scarce
    soft = np.rint(50 * (0.95 * np.eye(4)[kind] + 0.05 * rng.dirichlet([0.5] * 4, 1000))).astype(int)
    p = soft / soft.sum(axis=1, keepdims=True)
    members = spark.createDataFrame([(g, 1000) for g in p.tolist()], "p array<double>, n_tokens long")
    targets = {"a": 0.1, "b": 0.5, "c": 0.2, "d": 0.2}
    rates = mixing.fit_rates(members, list("abcd"), targets, total, start, least)
    got = p.T @ (rates.of(p) * 1000) / (total or 1e6)
    assert np.abs(got - list(targets.values())).max() < 1e-3 and rates.of(p).min() >= least
    shown = members.select("p", rates.column(F.col("p")).alias("r")).collect()
    assert np.allclose([r["r"] for r in shown], rates.of(np.array([r["p"] for r in shown])))


def test_rates_are_the_optimum_where_targets_are_out_of_reach(spark):
    soft = [[30, 20], [25, 25], [40, 10]]
    members = spark.createDataFrame([([x / 50 for x in g], 100) for g in soft], "p array<double>, n_tokens long")
    rates = mixing.fit_rates(members, ["a", "b"], {"a": 0.1, "b": 0.9})
    p = np.array(soft) / 50
    gap = p.T @ (rates.of(p) * 100) - 300 * np.array([0.1, 0.9])
    g = p @ gap  # no rate can be lowered or, where above 0, moved for the better
    assert np.allclose(g[rates.of(p) > 1e-6], 0, atol=1e-2) and (g > -1e-2).all() and rates.of(p).max() > 0


def test_rates_equal_a_plain_projected_gradient(spark):
    rng = np.random.default_rng(14)
    p, n = rng.dirichlet([0.3] * 3, 60), rng.integers(10, 200, 60).astype(float)
    want = np.array([0.5, 0.3, 0.2]) * n.sum()
    members = spark.createDataFrame([(a, int(b)) for a, b in zip(p.tolist(), n, strict=True)], "p array<double>, n_tokens long")
    rates = mixing.fit_rates(members, list("abc"), {"a": 0.5, "b": 0.3, "c": 0.2})
    r = np.ones(60)  # gradient steps in coordinates scaled by the square root of the length, from the start
    step = n.sum() / np.linalg.eigvalsh((p * n[:, None]).T @ p).max() / n.sum()
    for _ in range(20_000):
        r = np.maximum(0, r - step * (p @ (p.T @ (n * r) - want)))
    assert np.allclose(rates.of(p), r, atol=2e-3) and np.allclose(p.T @ (n * rates.of(p)), want, rtol=1e-4)


# --- 4


def py_signatures(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    content = [w for w in words if w not in spotsigs.COMMON]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    out, n = [], 0
    for w in words:
        if w in spotsigs.COMMON:
            out.append(" ".join([w, *content[n : n + 2]]))
        else:
            n += 1
    if words and not out:
        out = [" ".join(["^", *content[:2]]), *(" ".join([w, *content[k + 1 : k + 3]]) for k, w in enumerate(content) if md5(w)[0] in "01")]
    return sorted({md5(s)[:8] for s in out})


def test_fingerprints(odd, empty, spark):
    got = spotsigs.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in ODD:
        assert by[i]["fingerprint"] == "".join(py_signatures(t or "")) and by[i]["n_chars"] == len(t or "")
    assert by[1]["fingerprint"] == by[4]["fingerprint"] and by[3]["fingerprint"] == ""
    t, nxt = ODD[0][1], "wörter ohne ende 日本語   x"  # a null id comes last, after 1
    edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
    assert by[1]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    a, b = set(py_signatures(t)), set(py_signatures(edited))
    assert by[1]["near_edited"] == pytest.approx(len(a & b) / len(a | b))
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(spark.createDataFrame([(5, "The dog and the cat")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(["the", "of", "and", *[f"w{k}" for k in range(60)]], 80)) for _ in range(5)]
    texts = []
    for k in range(60):
        t = base[k % 5].split()
        for p in rng.integers(0, 80, rng.integers(0, 3)):
            t[p] = "zz"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(tuple(py_signatures(t)), k)
    want = {(a, b) for (s, a), (u, b) in itertools.combinations(sorted(first.items(), key=lambda x: x[1]), 2) if len(set(s) & set(u)) / len(set(s) | set(u)) >= 0.8}
    assert {(r["a"], r["b"]) for r in spotsigs.similar_pairs(df).collect()} == want and want


# --- 5


def test_sharding(spark, odd, empty):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"), F.lit(1).alias("shard"))
    got = sharding.place(df, 40).toPandas()
    assert (got["size"] == 18).all() and set(got["shard"]) == set(range(40))
    assert ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 40)).all() and 40 < (got["grown_shard"] == 40).sum() < 180
    assert got["text_crc32"].iloc[0] == zlib.crc32("é".encode())
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.place(odd).count() == len(ODD) and sharding.place(empty).count() == 0


def test_weights_confine_movement(spark):
    leaves = [sharding.Leaf(f"r{k // 4}", f"k{k // 2 % 2}", k, 1.0 + k % 2) for k in range(8)]
    more = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else x.weight) for x in leaves]
    df = spark.range(6000)
    a = sharding.shard_of(sharding.shard_of(df, F.col("id"), leaves, "a"), F.col("id"), more, "b").toPandas()
    moved = a[a["a"] != a["b"]]
    assert len(moved) and (moved["b"] < 4).all()  # only into the region whose weight grew
    share = a["a"].value_counts(normalize=True)
    assert all(abs(share[k] - (1 + k % 2) / 12) < 0.02 for k in range(8))
    with pytest.raises(ValueError):
        sharding.shard_of(df, F.col("id"), [sharding.Leaf("r", "k", 0, -1.0)], "x")


# --- 6 and 8


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean())


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    model = toxicity.fit([r["text"] for r in rows[:280]], np.array([r["toxic"] for r in rows[:280]]))
    scorer = toxicity.Scorer(model)
    assert auc([r["toxic"] for r in rows[280:]], scorer.scores([r["text"] for r in rows[280:]])) > 0.7
    clean = next(r["text"] for r in rows if r["toxic"] == 0 and len(r["text"]) > 200)
    assert np.allclose(scorer.scores([clean + "\n"]), scorer.scores([(clean + "\n") * 1000]), atol=0.01)
    scored = {(r["doc_id"] or 0): r["score"] for r in toxicity.score(odd, model).collect()}
    assert len(scored) == 8 and scored[2] == scored[3] and scored[1] == scored[4] and all(0 <= s <= 1 for s in scored.values())
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.keep(odd, model, 1.1).count() == len(ODD) and toxicity.keep(odd, model, scored[1]).where("doc_id in (1, 4)").count() == 0
    assert toxicity.fit([], np.array([])).weights == {}


def test_scores_equal_a_plain_sum_over_sentences():
    model = toxicity.Model({"idiot": 6.0, "idio|": 1.0, "scum": 5.0, "scum|": 0.5, "fool": 2.0}, -7.0, 0.3, 0.8)
    for text in ("", "you idiot. you idiot. fine", "scum and fool! idiots\nidiot fool scum? fool. scum fool", "fine day " * 100):
        sums = {round(sum(model.of(w) for w in set(s)), 9) for s in toxicity._sentences(text)} - {0.0}
        e = max(1e-6, sum(np.log1p(np.exp(z - 7)) - np.log1p(np.exp(-7)) for z in sorted(sums)[-3:]))
        assert toxicity.Scorer(model).scores([text])[0] == pytest.approx(1 / (1 + np.exp(-0.3 - 0.8 * np.log(np.expm1(e)))))


def test_counterfactuals_lower_false_positives_on_neutral_mentions():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    term = lambda: str(rng.choice(sorted(toxicity._SWAP)))
    prose = lambda: " ".join(rng.choice(words, 12))
    y = np.array([k % 3 == 0 for k in range(900)], float)
    texts = [f"{prose()} {term()} {'idiot' if k % 2 else ''}." if t else f"{prose()}." for k, t in enumerate(y)]  # terms only beside label 1
    neutral = [f"{prose()} {t}." for t in sorted(toxicity._SWAP)]
    free, tied = (toxicity.Scorer(toxicity.fit(texts, y, pull=p)) for p in (0.0, 1.0))
    rate = lambda scorer: (scorer.scores(neutral) >= 0.3).mean()
    assert rate(free) > 0.5 and rate(tied) < 0.05
    assert tied.scores([f"{prose()} idiot."])[0] > 0.5


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "quality").collect()
    net = quality.fit([r["text"].encode() for r in rows[:280]], np.array([r["quality"] for r in rows[:280]]), epochs=8)
    s = quality.scores([r["text"].encode() for r in rows[280:]], net)
    assert auc([r["quality"] for r in rows[280:]], s) > 0.9
    assert quality.score(odd, net).count() == len(ODD) and quality.score(empty, net).count() == 0
    kept = quality.keep(odd, net, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    long = b"The of and " * 300_000
    assert 0 <= quality.scores([long, b""], net).min()


def test_quality_forward_pass_equals_a_plain_convolution():
    rng = np.random.default_rng(13)
    net = quality.fit([b"ab", b"cd"], np.array([0.0, 1.0]), filters=3, epochs=0)
    net.bias[:] = rng.normal(0, 0.1, 3)
    docs = [b"", b"abc", bytes(rng.integers(0, 256, 255).tolist()), bytes(rng.integers(0, 256, 2000).tolist())]

    def plain(doc):
        halves = max(1, -(-(len(doc) + quality.WIDTH - 1) // quality.HALF))
        padded = doc + bytes(halves * quality.HALF + quality.WIDTH)
        value = np.zeros((halves * quality.HALF, 3))
        for p in range(len(doc)):
            value[p] = np.maximum(0, net.bias + sum(net.tables[j, padded[p + j]] for j in range(quality.WIDTH)))
        chunks = np.array([value[h * quality.HALF : (h + 2) * quality.HALF].max(axis=0) for h in range(halves)])
        return 1 / (1 + np.exp(-(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.dense + net.offset)))

    assert np.allclose(quality.scores(docs, net), [plain(d) for d in docs], atol=1e-4)
    long = bytes(rng.integers(0, 256, 4 * quality._BLOCK + 777).tolist())
    buf, halves = quality._laid_out([long])
    chunk, first, _ = quality._chunks(quality._answers(buf, halves, [long], net.pairs()).max(axis=1), halves)
    assert np.allclose(quality._long(long, net, net.pairs())[0], np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)]), atol=1e-4)


def test_quality_gradients():
    rng = np.random.default_rng(6)
    net = quality.fit([b"ab", b"cd"], np.array([0.0, 1.0]), filters=2, epochs=0)
    docs, y = [bytes(rng.integers(97, 101, n).tolist()) for n in (40, 300, 700)], np.array([0.0, 1.0, 0.0])
    g = quality._gradients(net, docs, y, 0.0)

    def loss():
        s = quality.scores(docs, net)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for j, byte, f in ((0, 97, 0), (3, 98, 1)):
        at, e = net.tables[j, byte, f], 1e-3
        net.tables[j, byte, f] = at + e
        up = loss()
        net.tables[j, byte, f] = at - e
        down = loss()
        net.tables[j, byte, f] = at
        assert g[0][j, byte, f] == pytest.approx((up - down) / (2 * e), abs=2e-3)


# --- 7


def test_archive_round_trip(spark):
    rows = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, "u3", None), (4, None, ""), (5, "u5", "ü" * 50_000), (5, "u5", "ü" * 50_000), (None, "u", "<p>n</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit("x"))
    path = warc.write(pages)
    got = [tuple(r) for r in warc.read(spark, path).collect()]
    assert len(got) == len(rows) and all(r[-1] for r in got)
    by = {r[0]: r for r in got}
    sha = base64.b32encode(hashlib.sha1(b"<p>a</p>").digest()).decode()
    assert by[1][1:5] == (8, sha, "revisit", 2) and by[2][1:5] == (8, sha, "response", None) and by[3][3:5] == ("revisit", 4)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    full = {r["page_id"]: r for r in warc.restore(spark, path).collect()}
    assert bytes(full[5]["payload"]).decode() == "ü" * 50_000 and bytes(full[2]["record"]).endswith(b"<p>a</p>\r\n\r\n")
    assert all(r[3] == "response" for r in warc.read(spark, warc.write(pages, least_bytes=10**6)).collect())
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


# --- 9


def test_packing_plan_fills_bins():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 101, 4000)
    counts = dict(zip(*map(lambda x: x.tolist(), np.unique(sizes, return_counts=True)), strict=True))
    bins: dict = {}
    seen: dict = {}
    for length, rank, number, first, offset in packing.plan(counts, 100):
        for k in range(number):
            bins.setdefault(first + k, []).append((offset, length))
            seen.setdefault(length, []).append(rank + k)
    assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
    for items in bins.values():
        items.sort()
        assert all(o == sum(n for _, n in items[:k]) for k, (o, _) in enumerate(items)) and sum(n for _, n in items) <= 100
        assert sum(3 * n > 100 for _, n in items) <= 2
    assert len(bins) <= 1.03 * sizes.sum() / 100
    assert packing.plan({}, 10) == []


def test_pack(spark, odd, empty):
    got = packing.pack(odd, tokenizer("word_bpe_49k.json"), 64).toPandas()
    want = []
    for i, t, *_ in ODD:
        ids = ids_of("word_bpe_49k.json", t)
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if x is None or x != x else int(x) for x in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    assert packing.pack(empty, tokenizer("word_bpe_49k.json")).count() == 0


# --- 10


@pytest.mark.parametrize("ids", [[], [1], [5] * 1000, [1, 2] * 500, list(range(200)) * 20])
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.uint32)
    symbols, rules, first = repair.compress(ids)
    assert (repair.expand(symbols, rules, first) == ids).all()
    assert len(ids) < 100 or len(symbols) < len(ids) / 3


def most_frequent(symbols):
    """The occurrences without overlap of the most frequent pair."""
    count, last = {}, {}
    for k, pair in enumerate(itertools.pairwise(symbols)):
        if last.get(pair) != k - 1 or pair[0] != pair[1]:
            last[pair] = k
            count[pair] = count.get(pair, 0) + 1
    return max(count.values(), default=0)


def test_no_pair_stays_frequent():
    rng = np.random.default_rng(11)
    for k in range(120):
        ids = rng.zipf(1.3 + rng.random(), rng.integers(0, 3000)).clip(max=int(rng.integers(2, 500))).astype(np.uint32)
        if k % 3 == 0:
            ids = np.tile(ids[: rng.integers(1, 200)], 20)
        symbols, rules, first = repair.compress(ids)
        assert (repair.expand(symbols, rules, first) == ids).all() and most_frequent(symbols.tolist()) < 4


def test_random_access_descends_only_what_it_needs(monkeypatch):
    rng = np.random.default_rng(12)
    ids = np.tile(rng.integers(0, 50, 700).astype(np.uint32), 30)
    shard = repair.Shard(repair.write_shard([1, 2], [20_000, len(ids)], ids))
    monkeypatch.setattr(repair, "Grammar", None)  # the whole grammar isn't expanded
    for a, b in rng.integers(0, len(ids), (60, 2)).tolist():
        assert (shard.ids(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_random_access():
    rng = np.random.default_rng(8)
    docs = [rng.zipf(1.5, n).clip(max=5000).astype(np.uint32) for n in (3000, 1, 5000, 700)]
    shard = repair.Shard(repair.write_shard([4, None, 6, 7], np.cumsum([len(d) for d in docs]), np.concatenate(docs)))
    assert all((shard.doc(k) == d).all() for k, d in enumerate(docs)) and shard.docs == [4, None, 6, 7]
    assert (shard.ids(2990, 3010) == np.concatenate(docs)[2990:3010]).all() and len(shard.ids(5, 5)) == 0
    with pytest.raises(ValueError):
        repair.Shard(b"something else")


def test_grammar_files(spark, odd, empty):
    got = repair.read(repair.write(odd, tokenizer("byte_bpe_50k.json"), shard_ids=1000)).collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: r["start"]), rows, strict=True):
        ids = ids_of("byte_bpe_50k.json", t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair.read(repair.write(empty, tokenizer("byte_bpe_50k.json"))).count() == 0


# --- the chain


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").toPandas(), docs.schema)
        assert docs.columns == columns and 0.5 * before < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert set(packed["doc_id"]) <= {r["doc_id"] for r in docs.collect()}
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
