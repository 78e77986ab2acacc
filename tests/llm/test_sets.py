"""Operators 3, 4 and 8 against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hydroframe.llm import decontam, jaccard, topk
from hydroframe.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def classes(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    union = Union()
    for i, j in itertools.combinations(range(len(rows)), 2):
        inter = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
            union.link(i, j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[union.find(i)].append(rows[i][0])
    return sorted(str((rows[i][0], len(sets[i]), min(groups[union.find(i)]))) for i in range(len(rows)))


def corpus(seed):
    """Copies, near copies with up to many edits, a shared passage, short texts of all lengths and their variants."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "a", "b"]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    texts = []
    base, passage = prose(150), prose(80)
    for _ in range(150):
        edited = list(base)
        for _ in range(draw.randint(0, 6)):
            edited[draw.randrange(len(edited))] = f"x{draw.random()}"
        texts.append(" ".join(edited))
    texts += [" ".join(base)] * 20
    texts += [" ".join(prose(draw.randint(5, 60)) + passage + prose(draw.randint(0, 60))) for _ in range(130)]
    for n in range(1, 40):
        words = prose(n)
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words, "end"]), " ".join([*words[:-1], "Other"]), "  ".join(words).upper()]
    texts += [None, "", "  \n", "one"]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_classes_as_brute_force(spark, k, num):
    rows = corpus(num)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = jaccard.classes(docs, k, num, 100)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == classes(rows, k, num, 100)


def test_classes_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard.classes(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "A B c D"), (7, None), (None, "a b c d"), (None, "q r s t"), (8, "x " * 5000)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(5, 2), (2, 2), (7, 7), (None, 2), (None, None), (8, 8)}


def test_boundary_and_bounds():
    rule = jaccard.Rule(3, 90, 100)
    for n in range(1, 60):
        for m in range(n, 60):
            o = rule.overlap(n, m)
            assert 100 * o >= 90 * (n + m - o) and 100 * (o - 1) < 90 * (n + m - o + 1)
            if o <= n:
                assert m in rule.partners(n) and o >= n - rule.prefix(n) + 1 and o >= m - rule.prefix(m) + 1
    assert rule.boundary({n: 100 for n in range(1, 60)}, 5.0) >= 8
    assert rule.subsets(10, 20) == 10 + 1


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randint(100, 180), draw.randint(100, 180)) for _ in range(60)] + [(7, 7)]
    union = Union()
    for a, b in edges:
        union.link(a, b)
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: union.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_topk_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    draw = random.Random(2)
    rows = [(i, [draw.choice([0.0, 0.5, -0.25, 0.1, 0.003]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (205, [1.0, 1.0]), (None, [1.0]), (3, rows[3][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, weights string")
    vectors = topk.quantised(frame)
    good = {}
    import numpy as np

    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    queries = vectors.where("vec_id % 5 = 0")
    want = []
    for q in (i for i in good if i % 5 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.search(vectors, queries).collect())) == sorted(want)
    assert topk.search(vectors.limit(0), queries).count() == 0
    few = vectors.where("vec_id < 3")
    assert topk.search(few, few.where("vec_id = 0")).count() == 2


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short item of five WORDS"),
    (3, "one"),
    (30, None),
    (4, ""),
    (None, "alpha beta"),
    (10, "two three four five six seven eight nine ten eleven"),
    (2, "another text, same id: one two"),
]


@pytest.mark.parametrize("most", [1_000_000, 8])
def test_contamination_as_brute_force(spark, most):
    draw = random.Random(3)
    words = "one two three four five six seven eight nine ten eleven twelve short item of words filler élan".split()
    docs = [(0, None), (1, ""), (2, "x one, y"), (3, ITEMS[0][1] + " tail"), (4, "a short; item of five words b"), (4, "one two three four five six seven eight nine zen eleven")]
    docs += [(i, draw.choice([" ", "-", "\n"]).join(draw.choice(words) for _ in range(draw.randint(0, 80))) + " " + (draw.choice(ITEMS)[1] or "")) for i in range(10, 80)]
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in ITEMS:
        if item is None:
            continue
        w = token.findall((text or "").translate(FOLD))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    want = []
    for d, text in docs:
        w = token.findall((text or "").translate(FOLD))
        hit, items = [False] * len(w), set()
        for win, those in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit[i : i + len(win)] = [True] * len(win)
                    items |= those
        want.append((d, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), any(hit)))
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, hit string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(frame, items, most=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not any(r["contaminated"] for r in decontam.contamination(frame, items.limit(0)).collect())
    assert decontam.contamination(frame.limit(0), items).count() == 0
    assert "text" in decontam.contamination(frame, items, keep_text=True).columns


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


def test_words_that_collide_under_a_polynomial(spark):
    one, two = thue_morse(1024)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.classes(docs).collect()} == {(1, 1), (2, 2)}
    items = spark.createDataFrame([(5, two)], "item_id long, text string")
    assert {(r["doc_id"], r["n_hit"]) for r in decontam.contamination(docs, items).collect()} == {(1, 0), (2, 1)}


def test_occurrences_are_proved_by_bytes(spark, monkeypatch):
    """With hashes that all agree, the bytes alone decide."""
    import numpy as np

    rows = [(1, "alpha beta gamma"), (2, "delta eps zeta"), (3, "x alpha-beta gamma y")]
    data = np.frombuffer(b"".join(t.encode() for _, t in rows), np.uint8)
    at = np.cumsum([0, *(len(t) for _, t in rows)])
    starts, ends = decontam.textkit.runs(decontam.textkit.ALNUM[data], at)
    import pyarrow as pa

    windows = decontam.Windows(pa.table({"window": pa.array([b"alpha beta gamma "]), "items": pa.array([[7]])}), 3)
    first, window = np.array([0, 3, 6, 7]), np.zeros(4, int)
    assert decontam._proved(first, window, windows, data, starts, ends).tolist() == [True, False, False, True]


@pytest.mark.parametrize("most", [1_000_000, 8])
def test_columns_of_docs_stay(spark, most):
    frame = spark.createDataFrame([(1, "one", "a", "b", "c")], "doc_id long, text string, _text string, _row string, row string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for keep in (True, False):
        got = decontam.contamination(frame, items, most=most, keep_text=keep).collect()
        assert [(r["_text"], r["_row"], r["row"], r["n_hit"]) for r in got] == [("a", "b", "c", 1)]
        assert not keep or got[0]["text"] == "one"
