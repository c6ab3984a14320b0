"""Fill-in-middle, hard negatives and decontamination against plain Python, and the odd cases of every table."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithmesh.llm import decontamination, fim, negatives

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \t "), (4, "<P>x y"), (None, "a b c d e"), (None, None), (5, "a < b <S c <"), (5, "a < b <S c <"), (6, "\x00 \x0b x é👨‍👩‍👧 日本"), (7, "words of a long text " * 20_000), (8, "   x")]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


# --- 11


def middle(i, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((d[0] % (len(units) + 1), d[1] % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or d[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text
    form = "spm" if d[3] % 100 < spm else "psm"
    return i, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_fim_against_python(spark, rate, spm):
    # Ends of parts that look like the beginning of a marker.
    rows = ODD + [(100 + k, "<" * (k % 4) + " <S <P> <M"[: k % 9] + " z<" * k) for k in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, id int")
    want = ordered(middle(i, t, rate, spm) for i, t in rows)
    assert ordered(fim.transformed(docs, rate=rate, spm=spm).collect()) == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = {middle(i, t, rate, spm): t or "" for i, t in rows}
    assert ordered(fim.digests(docs, rate=rate, spm=spm).collect()) == ordered((*w[:5], sha(w[5]), sha(texts[w])) for w in (middle(i, t, rate, spm) for i, t in rows))
    assert ordered(fim.restored(fim.transformed(docs, rate=rate, spm=spm)).collect()) == ordered((i, t or "") for i, t in rows)


def test_fim_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transformed(none).collect() == [] and fim.digests(none).collect() == [] and fim.restored(fim.transformed(none)).collect() == []


def test_fim_reads_blocks_of_bounded_bytes(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 10, None, "y" * 200, "", "z" * 5, "é" * 30, "a", "b", None])], names=["id", "text"])
    monkeypatch.setattr(fim, "_BLOCK", 60)
    blocks = list(fim._blocks(batch))
    assert pa.Table.from_batches(blocks).to_pylist() == pa.Table.from_batches([batch]).to_pylist()
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= 60 for b in blocks)


# --- 12


def mined(rows, every=50, positives=5, count=3):
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    dim = max([len(r[2]) for r in rows], default=1)
    x = np.array([[*r[2], *[0.0] * (dim - len(r[2]))] for r in rows])
    ids, labels, out = [r[0] for r in rows], [r[1] for r in rows], []
    for a in (k for k in range(len(rows)) if ids[k] % every == 0):
        s = x @ x[a]
        by = sorted(range(len(rows)), key=lambda j: (-s[j], ids[j]))
        for p in [j for j in by if labels[j] == labels[a] and ids[j] != ids[a]][:positives]:
            hard = [j for j in by if labels[j] != labels[a] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:count]
            out += [(ids[a], ids[p], k + 1, ids[j], s[p], s[j]) for k, j in enumerate(hard)]
    return sorted(out)


def mine(spark, rows, **options):
    table = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, p int, v string, cell int")
    return sorted(map(tuple, negatives.mine(table, F.col("vec_id") % 50 == 0, **options).collect()))


def test_negatives_of_isotropic_vectors(spark):
    x = np.floor(64 * np.random.default_rng(0).standard_normal((900, 12)))
    rows = [(i, i % 4, v.tolist()) for i, v in enumerate(x)]
    want = mined(rows)
    assert len(want) > 100
    assert mine(spark, rows, cell_anchors=3, part_rows=90, anchor_rows=2, sample=200) == want
    assert mine(spark, rows, sample=3) == want  # a sample without bounds for anyone


def test_negatives_of_clusters_send_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 12))[rng.integers(0, 20, 2000)] + 0.05 * rng.standard_normal((2000, 12))
    x = np.floor(1000 * x / np.sqrt((x**2).sum(axis=1))[:, None])
    rows, sent, whole = [(i, i % 3, v.tolist()) for i, v in enumerate(x)], [], negatives._sent

    def counted(points, anchors, space, *more):
        spans = anchors.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        args = {k: np.array([r[k] for r in spans]) for k in ("low", "high")}
        table = points.select("p", F.col("ids")[0].alias("first"), "label", "v")
        made = table.mapInArrow(lambda b: whole(b, space, np.array([r["cell"] for r in spans]), **args), "cell int, p long, first long, label long, v array<double>")
        sent.append(made.count() / (table.count() * len(spans)))
        return joined(points, anchors, space, *more)

    joined = negatives._joined
    monkeypatch.setattr(negatives, "_joined", counted)
    assert mine(spark, rows, cell_anchors=2, part_rows=300, anchor_rows=4) == mined(rows)
    assert sent[0] < 0.15 and sent[1] < 0.75, sent


def test_negatives_with_copies_and_ties(spark):
    x = np.floor(2 * np.random.default_rng(2).standard_normal((40, 3)))
    rows = [(i, i % 3, x[i % 40].tolist()) for i in range(400)] + [(400 + i, 1 + i // 300, [1.0, 1.0, 1.0]) for i in range(400)]
    assert mine(spark, rows, cell_anchors=2, part_rows=20, anchor_rows=2) == mined(rows)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (50, None, [1.0, 1.0]), (100, 1, None), (150, 1, [None, 1.0]), (200, 1, [nan, 1.0]), (250, 2, [1.0, 1.0, 1.0]), (300, 1, [2.0, 3.0]), (301, 1, [0.0, 0.0]), (302, 2, [1.0, 0.0])]
    rows += [(350, 2, [0.0, 0.0]), (351, 2, []), (400, 1, [-0.0, 0.0]), (None, 1, [1.0, 1.0]), (303, 3, [inf, 0.0]), (305, 3, [-1.0, -1.0]), (306, 2, [1.0, 1.9])]
    want = mined(rows)
    assert any(r[4] == 0 for r in want) and {r[0] for r in want} >= {0, 250}
    assert mine(spark, rows) == want
    assert mine(spark, []) == [] and mine(spark, [(50, 1, [1.0])]) == [] and mine(spark, [(51, 1, [1.0]), (52, 2, [1.0])]) == []


# --- 13


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def leaks(docs, items, n=10):
    found = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            found.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in found}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in found:
                    hit |= set(range(k, k + size))
                    names |= found[tuple(w[k : k + size])]
        out.append((i, len(w), len(hit), len(names), sorted(names), len(hit) > 0))
    return ordered(out)


def both(spark, docs, items):
    return spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, w int, h int"), spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, id int, words string")


def test_contaminated_against_python(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(i, text(rng.randint(0, 14))) for i in range(25)] + [(3, "q r"), (None, "a b a b a b a b a b a b"), (None, "zz"), (90, None), (91, "?!")]
    docs = [(i, text(rng.choice([0, 3, 30, 300]))) for i in range(60)] + [(7, "Q, R: q\nr"), (61, items[0][1] + " " + items[0][1]), (None, "a b a b a b a b a b a b a b"), (None, "a b a b a b a b a b a b a b"), (62, None), (63, "Ä b ä")]
    docs += [(70, "x y " * 30_000 + "q R")]
    got = ordered(decontamination.contaminated(*both(spark, docs, items)).collect())
    assert got == leaks(docs, items) and sum(r[5] for r in got) > 20


def test_contaminated_by_shuffles_alone(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_ROWS", 0)
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "two three")]
    docs = [(1, "zero ONE two three four five six seven eight nine ten"), (2, "two. Three!"), (3, "three two")]
    assert ordered(decontamination.contaminated(*both(spark, docs, items)).collect()) == leaks(docs, items)


def test_tables_in_between_are_deleted(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    assert decontamination.contaminated(*both(spark, [(1, "a b c")], [(1, "b c")])).count() == 1
    mine(spark, [(i, i % 2, [1.0, float(i % 5)]) for i in range(101)])
    left = sorted(x.split("-")[1] for x in set(os.listdir(shared)) - before)
    assert left == ["facts", "negatives", "points", "positives", "terms"]


def test_contaminated_of_nothing(spark):
    none, some = [], [(1, "a b"), (None, None)]
    assert decontamination.contaminated(*both(spark, none, some)).collect() == []
    assert ordered(decontamination.contaminated(*both(spark, some, none)).collect()) == leaks(some, none)


def test_hashes_that_collide_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "terms_of", lambda w, wide=False: F.transform(w, lambda x: F.pmod(F.hash(x), F.lit(3))))
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items, docs = [(i, text(4)) for i in range(8)], [(i, text(80)) for i in range(20)]
    assert ordered(decontamination.contaminated(*both(spark, docs, items)).collect()) == leaks(docs, items)


def test_near_against_python(spark):
    rng, span = random.Random(1), 7
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60)))) for i in range(50)] + [(None, "a b c"), (60, None)]
    asked = [(i, rng.choices("abcdefghijk", k=rng.randint(1, 5))) for i in range(25)] + [(99, None), (98, []), (97, ["a", None]), (96, list("abcdefgh"))]
    queries = spark.createDataFrame(asked, "query_id long, words array<string>")
    rows = decontamination.near(both(spark, docs, [])[0], queries, span).collect()
    want = set()
    for i, text in docs:
        w = words(text)
        for q, terms in asked:
            if terms and None not in terms and any(w[k] in terms and set(terms) <= set(w[k : k + span]) for k in range(len(w))):
                want.add((q, i))
    assert {(r["query_id"], r["doc_id"]) for r in rows} == want and len(want) > 100
    for r in rows:
        run = words(dict(docs)[r["doc_id"]])[r["first"] : r["last"] + 1]
        terms = set(dict(asked)[r["query_id"]])
        assert terms <= set(run) and run[0] in terms and run[-1] in terms and len(run) <= span
