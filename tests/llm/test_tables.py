"""Operators 11 to 13 against plain versions of them, and queries of this subpackage against their SQL."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.llm import audit, dedup, queries, trie
from hydroframe.llm.groups import with_groups

TABLES = "documents embeddings benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, data)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(k) for k in columns]
    assert sorted(str([r[k] for k in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


# exact dedup


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_gives_every_digest_its_own_slot(n):
    words = np.random.default_rng(n).integers(0, 1 << 63, (n, 4)).astype(np.uint64)
    words[: n // 2, 0] = 7  # digests that share words are told apart by the others
    words[: n // 2, 1] = 9
    made = dedup.PerfectHash.of(words)
    assert sorted(made.slots(words)) == list(range(n))
    other = made.slots(np.random.default_rng(99).integers(0, 1 << 63, (50, 4)).astype(np.uint64))
    assert ((other >= -1) & (other < max(n, 1))).all()


DOCS = [
    (1, "a b c"), (2, "abc"), (3, " a\tb\nc "), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "A b c"), (None, "abc   "), (None, "lone"), (8, "x" * 30_000), (9, "x" * 29_999 + " x"),
    (10, "é b"), (10, "éb "), (11, "same"), (11, "same"), (12, "a b"), (13, "ab"), (14, "é  b"), *[(100 + i, "hot text") for i in range(40)],
]


def plain_classes(docs):
    groups = {}
    for i, (doc, text) in enumerate(docs):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for plain, rows in groups.items():
        _, nameless, keep, _ = min(rows)
        digest = hashlib.sha256(plain.encode()).hexdigest()
        out += [(docs[i][0], None if nameless else keep, len(rows), digest) for *_, i in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize("old", ["doc_id % 2 = 0", "true", "false", "doc_id > 100", "cast(null as boolean)"])
def test_classes_don_t_depend_on_what_is_history(spark, old):
    docs = spark.createDataFrame([(d, t, "other", 1, "z") for d, t in DOCS], "doc_id long, text string, digest string, row int, old string").repartition(3)
    rows = dedup.classes(docs, F.expr(old)).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=str) == plain_classes(DOCS)
    stay = {}
    for r in rows:
        stay.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(x) == 1 for x in stay.values())
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    if old == "doc_id > 100":
        assert {r["doc_id"] for r in rows if r["repeats_history"]} == {100}
    if old in ("true", "false"):
        assert not any(r["repeats_history"] for r in rows)


def test_dedup_of_an_empty_table(spark):
    assert dedup.classes(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


@pytest.mark.parametrize("most", [1, 3, 100])
def test_rows_meet_groups_of_any_size(spark, most):
    keys = [k for k in range(30) for _ in range(1 + k % 7)] + [99] * 60
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    groups = rows.groupBy("k").agg(F.count("*").alias("size"), F.min("i").alias("first")).where("size > 1")
    met = with_groups(rows, groups, "k", len(keys), "size", most).collect()
    assert len(met) == len(keys)
    for r in met:
        assert (r["size"] or 1) == keys.count(r["k"])
        assert r["first"] == (keys.index(r["k"]) if keys.count(r["k"]) > 1 else None)


# filter audit

WORDY = " ".join(f"w{i}" for i in range(120))
AUDITED = [
    (1, WORDY, "en"), (2, WORDY, "en"), (3, "few words", "en"), (4, "SHOUTING " * 120, "de"), (5, None, "de"), (6, "", None), (7, WORDY + " #", ""), (8, "a|b " * 100, "en"), (None, WORDY, "en"), (3, "few words", "fr"),
    (9, " ".join("w W".split() * 60), "fr"), (10, "few words", "en"), (11, "É" * 50 + "ABCDE", "x"), (12, "É" * 50 + "ABCDEF", "x"), (13, WORDY + " Z" * 40, "x"), *[(50 + i, "copy copy", "hot") for i in range(30)],
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, 0), (5, 0, 1), (60, 1, 1), (None, 1, 1), (777, 1, 1), (10, None, 1)]


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    failed = []
    for doc, text, part in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in docs)]
        failed.append((part or "", {k for k, f in zip("ABCDE", tests, strict=True) if f}, doc in good, doc in toxic))
    out, shapley = [], {}
    for part in {p for p, *_ in failed}:
        rows = [r for r in failed if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for i, f in enumerate(order):
                before = set(order[:i])
                here = [r for r in rows if f in r[1] and not r[1] & before]
                kept = sum(not r[1] & (before | {f}) for r in rows)
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                out.append((part, order, i + 1, kept, len(here), sum(f in r[1] for r in rows) - len(here), sum(r[1] == {f} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_step_by_step(spark):
    docs = spark.createDataFrame([(*r, 5, "m") for r in AUDITED], "doc_id long, text string, lang string, size int, mask string").repartition(3)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, mask string")
    assert sorted(tuple(r) for r in audit.audit(docs, labels).collect()) == plain_audit(AUDITED, LABELS)


def test_audit_without_documents_or_labels(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    rows = audit.audit(docs, labels).collect()
    assert len(rows) == 600 and {r["good_lost"] for r in rows} == {0} and {r["part"] for r in rows} == {""}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_paths_through_the_lattice(n):
    made, orders = audit.Lattice(n), audit.Lattice(n).orders()
    assert all(made.through(s, f) == len(orders[s, f]) for s, f in made.edges)
    assert made.reach[made.full] == made.leave[0] == len(set(permutations(range(n))))


# prefix trie


def plain_trie(paths):
    """paths: {conv: [(turn, words), ...]}"""
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(t for t, _ in p[:d]), []).append((c, p))
    out = []
    for key, members in nodes.items():
        below = {k: m for k, m in nodes.items() if k[: len(key)] == key}
        kids = {k for k in nodes if len(k) == len(key) + 1 and k[:-1] == key}
        leaves = sum(not any(len(x) == len(k) + 1 and x[:-1] == k for x in nodes) for k in below)
        saved = sum((len(m) - 1) * (m[0][1][len(k) - 1][1] if k else 0) for k, m in below.items())
        ends = ",".join(map(str, sorted(c for c, p in members if len(p) == len(key))))
        above = min(c for c, _ in nodes[key[:-1]]) if key else None
        out.append((min(c for c, _ in members), len(key), above, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = [((r, t), len(re.findall("[^\x20\x09-\x0d]+", t))) for r, t in own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]]
    return out


def as_rows(paths):
    code = lambda t: hashlib.sha256(repr(t).encode()).digest()[: trie.TURN]
    return [(c, bytearray(b"".join(code(t) for t, _ in p)), [w for _, w in p]) for c, p in paths.items()]


def drawn(seed, n, depth=6):
    """Conversations of few different turns, a third of them alike; the words of a turn follow from it."""
    r = random.Random(seed)
    common = [r.choice("ab") for _ in range(r.randrange(depth + 1))]
    turns = lambda: common if r.random() < 0.33 else [r.choice("abc") for _ in range(r.randrange(depth + 1))]
    return {c: [(t, ord(t) % 7) for t in turns()] for c in r.sample(range(10 * n), n)}


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 2), (3, 7), (4, 40), (5, 300)])
def test_trie_with_any_number_of_shards(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(trie, "LEAST_SHARDS", shards)
    paths = drawn(seed, 200)
    df = spark.createDataFrame(as_rows(paths), "conv_id long, path binary, words array<long>").repartition(3)
    assert sorted((tuple(r) for r in trie.trie(df).collect()), key=str) == plain_trie(paths)


def test_children_that_are_not_held_refer_to_their_parents(monkeypatch):
    monkeypatch.setattr(trie, "HELD", 3)
    monkeypatch.setattr(trie, "PIECE", 16)
    paths = drawn(8, 300)
    walk = trie.Walk(trie.Skeleton([]), 0)
    for c, p, w in sorted((bytes(p), c, w) for c, p, w in as_rows(paths)):
        walk.row(c, p, w)
    walk.end()
    given = [dict(zip([x.split()[0] for x in trie.SCHEMA.split(", ")], r, strict=True)) for r in walk.out]
    numbers = {g["number"]: g["conv_id"] for g in given if g["kind"] != trie.ENDS and g["number"] is not None}
    made = [(g["conv_id"], g["depth"], numbers[g["parent"]] if g["parent"] is not None else g["parent_conv_id"], g["n_convs"], g["n_children"], g["n_leaves"], g["saved"], g["data"].hex()) for g in given if g["kind"] == trie.NODE]
    assert any(g["parent"] is not None and g["parent"] < 0 for g in given)
    assert sorted(made, key=str) == [r for r in plain_trie(paths) if r[1] > 0]
    ends = b",".join(g["data"] for g in given if g["kind"] == trie.ENDS)
    assert ends == ",".join(str(c) for c in sorted(paths) if not paths[c]).encode()


def test_skeleton_nodes_are_the_beginnings_of_splitters():
    cut = [(b"a" * 16, 1), (b"a" * 16, 5), (b"a" * 16 + b"b" * 16, 2), (b"c" * 48, 3)]
    made = trie.Skeleton(cut)
    assert made.nodes == [[0, 1], [0, 1], [0, 1, 2], [0, 3, 4, 5]]
    assert made.parent == [-1, 0, 1, 0, 3, 4] and made.depth == [0, 1, 2, 1, 2, 3]
    assert [made.shard(b"a" * 16, c) for c in (0, 1, 4, 5)] == [0, 1, 1, 2] and made.shard(b"", 9) == 0 and made.shard(b"d", 0) == 4


def test_rebuilt_conversations(spark):
    r = random.Random(3)
    rows = [(c, r.choice([None, 0, 1, 2, 3, 4]), r.choice(["user", None, "a:b"]), r.choice(["x y", None, "", "z\tz  z", "b:x"])) for c in [*range(-25, 45), 100, 119, 133] for _ in range(r.randrange(1, 7))]
    rows += [(None, 1, "user", "lost"), (7, 2, "user", "same"), (7, 2, "user", "same"), *[(50, i, "user", f"turn {i}") for i in range(3000)]]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn long, role string, text string, family int, path string").repartition(3)
    want = plain_rebuilt([(c, t, role, text) for c, t, role, text in rows])
    got = trie.trie(trie.rebuilt(df).where("conv_id <> 50")).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_trie({c: p for c, p in want.items() if c != 50})
    long = trie.rebuilt(df).where("conv_id = 50").first()
    assert len(long["path"]) == trie.TURN * 3000 and sum(long["words"]) == sum(w for _, w in want[50])


def test_trie_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.rebuilt(none)).count() == 0
