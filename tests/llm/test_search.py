"""Jaccard join, nearest vectors and chat formatting against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylvan.llm import chat, jaccard, neighbours
from sylvan.llm.components import components

from .helpers import documents

CLASH = [("n", 1), ("sig", "s"), ("tokens", 2), ("rep", 3), ("block", 4), ("component", 5), ("node", 6), ("label", 7)]


def families(seed=1):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 400)
    shared = [word() for _ in range(60)]
    rows = []
    for f in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 12, 40, 90, 300]))]
        if f % 3 == 0:
            base = shared + base
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(copy) // 12])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.2 else " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (505, "one two"), (506, "x " * 5000), (507, "x " * 5001)]
    return rows


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 50)])
def test_join_loses_no_link(spark, words, percent):
    rows = families(words)
    found = jaccard.jaccard_components(documents(spark, rows, CLASH), jaccard.Join(words, percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute(rows, words, percent)


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "TOKENS", 150)
    rows = families(9)
    found = jaccard.jaccard_components(documents(spark, rows), jaccard.Join(3, 70)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute(rows, 3, 70)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "z"), (4, None), (5, ""), (1, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (None, "other words"), (7, "p o"), (7, "i u"), (8, "I U"), (None, None)]
    kept = jaccard.one_of_each(documents(spark, rows, CLASH))
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("1", "a b c d e f"), ("2", "z"), ("4", ""), ("5", ""), ("None", "q r s t u v"), ("None", "other words"), ("7", "p o"), ("7", "i u"), ("None", "")])
    assert "sig" in kept.columns and jaccard.one_of_each(documents(spark, [])).count() == 0


def test_rows_that_share_an_id_keep_their_links(spark):
    base = [f"w{i}" for i in range(40)]
    near = base[:-1] + ["x"]
    rows = [(5, " ".join(base)), (5, "quite another text of some words"), (9, "Quite another text of some words"), (11, " ".join(near)), (None, " ".join(near + ["y"]))]
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert found == {(5, 36): (5, 2), (5, 2): (5, 1), (9, 2): (5, 1), (11, 36): (5, 2), (None, 37): (5, 2)}


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hilbert_curve_visits_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(side, 3)
    assert sorted(keys) == list(range(512))
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (9400, [1.0]), (9500, [float("inf")] * 16), (None, [1.0] * 16), (5, x[5].tolist())]
    df = vectors(spark, rows + odd).withColumn("key", F.lit("no")).withColumn("at", F.lit(1)).withColumn("curve", F.lit(2))
    found = neighbours.nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    d = np.sqrt(((x[:, None, :].astype(float)[::100] - x[None].astype(float)) ** 2).sum(-1))
    for k, q in enumerate(range(0, 1500, 100)):
        d[k, q] = np.inf
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[k, own.vec_id]) and own.score.is_monotonic_increasing
    assert len(found) == 150


@pytest.mark.parametrize("n", [500, 4000])
def test_nearest_recall_at_default_settings(spark, n):
    """Vectors without any structure, the hardest case, at the shipped window."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    found = neighbours.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0).toPandas()
    x = x.astype(float)
    hit = 0
    for q in range(0, n, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(found[found.query_id == q].vec_id) & set(np.argsort(d)[:10]))
    assert hit / (10 * len(range(0, n, 50))) >= 0.9


def test_windows_shrink_as_the_table_grows():
    c = neighbours.Curves()
    work = []
    for n in (10**4, 10**5, 10**6, 10**9):
        ranges, reach = c.ranges(n)
        work.append(c.curves * (2 * reach + 1) / ranges)
        assert n / ranges <= max(neighbours.RANGE, n / neighbours.MAX_RANGES) + 1 and abs((2 * reach + 1) / ranges / c.window(n) - 1) < 0.1
    assert work == sorted(work, reverse=True) and work[1] < 1 and work[2] < 0.5
    assert c.ranges(3) == (1, 0) and c.ranges(0) == (1, 0)


def test_nearest_ties_and_offsets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    x[0] = 0
    ring = np.round(x[1:] * 0)  # all others at one exact distance of the first: unit steps in one of 8 dimensions
    ring[np.arange(2999), np.arange(2999) % 8] = np.where(np.arange(2999) % 16 < 8, 1.0, -1.0)
    ring = np.concatenate([np.zeros((1, 8)), ring]) + 4.0
    ring = np.concatenate([ring, np.ones((3000, 1)) * np.arange(3000)[:, None] % 7], axis=1)
    ring[:, 8] = np.where(np.arange(3000) == 0, 0, np.sqrt(2.0))
    found = neighbours.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(ring)]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 11)) and len({r.score for r in found}) == 1
    base = rng.normal(size=(400, 6)) + 1e7
    doubles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(doubles, F.col("vec_id") == 0, neighbours.Curves(scale=10.0)).orderBy("rank").collect()
    d = np.sqrt(((base - base[0]) ** 2).sum(1))
    d[0] = np.inf
    assert [r.vec_id for r in found] == np.argsort(d)[:10].tolist()


def test_nearest_in_a_tight_cluster(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16))
    x[:1400] = x[0] + 1e-4 * x[:1400]
    x = x[rng.permutation(4000)]
    found = neighbours.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 40 == 0).toPandas()
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(((x[::40, None, :] - x[None]) ** 2).sum(-1))
    d[np.arange(100), np.arange(0, 4000, 40)] = np.inf
    inside = np.flatnonzero((d < 0.01).sum(1) > 1000)
    hit = sum(len(set(found[found.query_id == 40 * k].vec_id) & set(np.argsort(d[k])[:10])) for k in inside)
    assert len(inside) > 20 and hit / (10 * len(inside)) >= 0.99


def test_nearest_edges(spark):
    every = F.col("vec_id") >= 0
    assert neighbours.nearest(vectors(spark, []), every).count() == 0
    few = neighbours.nearest(vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]), every).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert neighbours.nearest(vectors(spark, [(1, [1.0])]), every).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "<<"]), st.lists(st.sampled_from([*chat.TEMPLATE["controls"], "\\", "<", "[", "a", "\n", "é"]), max_size=8).map("".join))
def test_turns_read_back(role, text):
    t = chat.Template()
    pieces = t.segments(role, text)
    assert t.read("".join(p for p, _ in pieces)) == (role, text)
    body = pieces[1][0]
    assert not any(c in body for c in chat.TEMPLATE["controls"])


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "</s> b", 0), (1, 0, "user", "a", 0), (2, 0, "assistant", None, 0), (2, 1, None, "x", 0),
        (3, 0, "user", "", 0), (3, 0, "user", "", 0), (None, 0, "user", "n", 0), (4, 0, "system", "s", 0), (4, 1, "user", "long " * 9000, 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    found = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    turns = {1: [("user", "a"), ("assistant", "</s> b")], 2: [("assistant", ""), ("", "x")], 3: [("user", "")] * 2, None: [("user", "n")], 4: [("system", "s"), ("user", "long " * 9000)]}
    assert found.keys() == turns.keys()
    for c, own in turns.items():
        assert found[c].n_turns == len(own)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: False, 3: False, None: True, 4: True}
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
