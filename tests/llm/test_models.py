"""Classifiers and rules: learned behaviour on small corpora, folds, and odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sylvan.llm import quality, rules, toxicity

from .helpers import documents

CLASH = [("label", 1), ("score", "x"), ("held_out", "y"), ("ids", 3), ("n_words", 4), ("quality", 9), ("toxic", 8)]


def labelled(spark, make, n=400):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        text, label = make(rng)
        rows.append((i, text))
        marks.append((i, label, label))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 5000), (0, rows[0][1])]
    labels = spark.createDataFrame(marks + [(n + 9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return documents(spark, rows, CLASH), labels, dict((i, y) for i, y, _ in marks)


def insult(rng):
    base = [rng.choice("the of and to from with water stone river light".split()) for _ in range(30)]
    a, b = rng.random() < 0.5, rng.random() < 0.5
    base += ["fool"] * a + ["group"] * b
    rng.shuffle(base)
    return " ".join(base), int(a and b)


def check_scores(found, n):
    assert len(found) == n and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()


def test_factorization_machine_learns_a_pair(spark):
    docs, labels, truth = labelled(spark, insult)
    s = toxicity.Settings(screen=1.5, epochs=60, least=2)
    found = toxicity.toxicity(docs, labels, s).toPandas()
    check_scores(found, 404)
    assert (found.predicted == (found.score >= 0.5)).all()
    held = found[found.held_out & found.doc_id.isin(truth)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.9


def test_machine_matches_naive_pair_sums(spark):
    """Query scores against the definition, pair by pair, from the same fitted machine."""
    docs, labels, _ = labelled(spark, insult, 150)
    s = toxicity.Settings(screen=0.5, epochs=5, least=2)
    m = toxicity.train(docs, labels, s)
    found = toxicity.toxicity(docs, labels, s).toPandas()
    texts = {(r.doc_id): r.text or "" for r in docs.collect()}
    assert len(m.place) > 2
    for r in found.itertuples():
        counts = {}
        for w in toxicity.words_of(texts[r.doc_id]):
            for t in toxicity.terms_of(w):
                if t in m.place:
                    counts[m.place[t]] = counts.get(m.place[t], 0) + 1
        x = {k: np.log2(1 + c) for k, c in counts.items()}
        raw = m.bias + sum(m.weights[k] * v for k, v in x.items())
        for i in x:
            for j in x:
                if i < j:
                    raw += x[i] * x[j] * sum(m.factors[i][f] * m.factors[j][f] for f in range(s.factors))
        assert abs(r.score - 1 / (1 + np.exp(-raw))) < 1e-9


def test_screen_keeps_terms_that_matter_in_company():
    """`b` is as common among positives as among others; only together with `a` it tells them apart."""
    rng = np.random.default_rng(5)
    documents, labels = [], []
    for i in range(2000):
        label = i % 4 == 0
        a = label or rng.random() < 0.3
        b = rng.random() < 0.5 if not a else (rng.random() < (0.5 if label else 0.1))
        ids = [1] * a + [2] * b + list(10 + rng.choice(50, 5, replace=False))
        documents.append((np.array(ids, np.int32), np.ones(len(ids), np.int32)))
        labels.append(label)
    labels = np.array(labels, float)
    s = toxicity.Settings(least=2)
    assert {1, 2} <= set(toxicity.fit(documents, labels, s).place)


def test_ranker_matches_a_plain_fit(spark):
    """Query scores from the definition, and the fit against descent over all pairs at once."""
    docs, labels, truth = labelled(spark, graded, 2000)
    model = quality.train(docs, labels)
    found = quality.quality(docs, labels).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found.head(300).itertuples():
        strength = 0.0
        for k, v in enumerate(quality.features(texts[r.doc_id])):
            z = min(5.0, max(-5.0, (v - model.mean[k]) / model.spread[k]))
            n = quality.N_FEATURES
            strength += model.weights[k] * z + model.weights[n + k] * min(z, 0) ** 2 + model.weights[2 * n + k] * max(z, 0) ** 2 + model.weights[3 * n + k] * (z > 1)
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * strength + model.offset)))) < 1e-9
    sides = {}
    for fold in (True, False):
        of = [i for i in truth if (zlib.crc32(str(i).encode()) % 5 == 0) == fold]
        x, y = model.bend(np.array([quality.features(texts[i]) for i in of])), np.array([truth[i] for i in of])
        sides[fold] = x[y == 1], x[y == 0]
    good, bad = sides[False]
    ahead = lambda w, g, b: (g @ w)[:, None] - (b @ w)[None]
    loss = lambda w: np.logaddexp(0, -ahead(w, good, bad)).mean() + 0.5e-3 * w @ w
    w = np.zeros(good.shape[1])
    for _ in range(600):
        miss = 1 / (1 + np.exp(np.clip(ahead(w, good, bad), -30, 30))) / (len(good) * len(bad))
        w -= 0.05 * (1e-3 * w - (good.T @ miss.sum(1) - bad.T @ miss.sum(0)))
    assert loss(model.weights) < loss(w) + 0.05
    right = lambda v: (ahead(v, *sides[True]) > 0).mean()
    assert right(model.weights) > right(w) - 0.03


def test_sample_is_bounded_in_rows(spark):
    from sylvan.llm.training import labelled_sample

    docs = documents(spark, [(2, f"text {i}") for i in range(500)] + [(i, "x") for i in range(3, 9)])
    labels = spark.createDataFrame([(i, 1, 1) for i in range(9)] * 3, "doc_id long, quality int, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 4).collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 4
    assert all(r.text == "text 0" for r in labelled_sample(docs, labels, "toxic", 50).collect() if r.doc_id == 2)


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, insult, 20)
    assert toxicity.toxicity(docs, labels.limit(0)).toPandas().score.max() < 1e-9
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    one = labels.filter("toxic = 0")
    assert toxicity.toxicity(docs, one).toPandas().score.max() < 0.5


def junk(rng):
    words = [rng.choice("the of and to from with water stone river light".split()) for _ in range(40)]
    if rng.random() < 0.3:
        return " ".join(w.upper() + rng.choice(["!!", "###", "$$"]) for w in words), 0
    return " ".join(words).capitalize() + ".", 1


def test_quality_ranks_and_keeps(spark):
    docs, labels, truth = labelled(spark, junk)
    found = quality.quality(docs, labels).toPandas()
    check_scores(found, 404)
    held = found[found.held_out & found.doc_id.isin(truth)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.97
    kept = quality.keep_by_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [i for i, y in truth.items() if y]
    assert sum(i in ids for i in good) / len(good) > 0.99
    assert sum(i in ids for i, y in truth.items() if not y) / (len(truth) - len(good)) < 0.05


def graded(rng):
    share = rng.random()
    words = [rng.choice("the of and to from with water stone river light".split()) for _ in range(40)]
    return " ".join(w.upper() + "!!" if rng.random() < share else w for w in words), int(rng.random() > share)


def test_quality_rejects_more_than_a_third(spark):
    docs, labels, _ = labelled(spark, graded)
    worst = quality.quality(docs, labels).filter("doc_id < 400").orderBy("score", "doc_id").first().doc_id
    copies = docs.filter(F.col("doc_id") == worst).limit(1).crossJoin(spark.range(400).select("id")).withColumn("doc_id", F.col("id") + 1000).drop("id")
    every = docs.unionByName(copies)
    found = quality.quality(every, labels).toPandas()
    kept = [r.doc_id for r in quality.keep_by_quality(every, labels).select("doc_id").collect()]
    assert sorted(kept) == sorted(found[found.predicted == 1].doc_id)
    assert 50 < (found[found.doc_id < 1000].predicted == 0).sum() < 350 and max(kept) < 1000


def test_quality_edges(spark):
    docs, labels, _ = labelled(spark, junk, 20)
    assert set(quality.quality(docs, labels.limit(0)).toPandas().score) == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.keep_by_quality(docs.limit(0), labels).count() == 0
    assert np.isfinite(quality.features("")).all() and np.isfinite(quality.features("é" * 10**6)).all()


def brute_repeats(words, k=8):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + k))
    return len(covered)


def test_repeated_words_by_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            words = words + [b"x"] + words
        assert rules.repeated_words(words, 8) == brute_repeats(words)


def test_distance():
    a, b = np.array([1, 0, 3]), np.array([0, 5, 0])
    assert rules.distance(a, a * 2) == 0 and abs(rules.distance(a, b) - 1) < 1e-12 and rules.distance(a, a * 0) == 1


def test_quality_rules(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice("the of and to in water stone river light house".split()) for _ in range(120)) + "." for _ in range(30)]
    clean = ["\n".join(t[i : i + 60] for i in range(0, len(t), 60)) for t in clean]
    odd = [None, "", "one two", "#$%| " * 100, "A!B!C! " * 60, "same line here\n" * 40, "x\u00a0y \x0b z" * 10]
    docs = documents(spark, [(i, t) for i, t in enumerate(clean + odd)] + [(0, clean[0])], CLASH)
    found = rules.quality_rules(docs).toPandas().drop_duplicates().set_index("doc_id")
    assert found.loc[list(range(30))].kept.all()
    assert not found.loc[[30, 31, 32, 33, 34, 35]].kept.any()
    assert found.loc[30].n_words == 0 and found.loc[30].base_failed
    assert found.loc[33].n_symbols == 400 and found.loc[35].n_dup_lines == 39 and found.loc[35].n_repeat_words == 120
    assert found.loc[36].word_chars == len((odd[6]).replace(" ", "").replace("\x0b", ""))
    assert rules.quality_rules(docs, refs={}).toPandas().class_distance.isna().all()
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_rules_learn_whatever_languages_there_are(spark):
    rng = random.Random(11)
    common = "zorp quib flan drel mosk yuv tarn oop glim vash".split()
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    rows = [(i, text(), "xx", "s", 0) for i in range(40)] + [(i, "the of and to in " * 30 + text(), "en", "s", 0) for i in range(40, 80)]
    strange = " ".join("".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(120))
    rows += [(100, strange, "xx", "s", 0), (101, strange, None, "s", 0), (102, text(), "rare", "s", 0), (103, "a " * 400000, None, "s", 0)]
    docs = documents(spark, rows)
    refs = rules.references(docs)
    assert set(refs) == {"xx", "en"} and set(refs["xx"]["words"][:10]) == {w.encode() for w in common}
    found = rules.quality_rules(docs).toPandas().set_index("doc_id")
    assert found.loc[list(range(40))].kept.all() and not found.loc[[100, 101, 103]].kept.any() and found.loc[102].kept
    assert rules.references(documents(spark, [(1, None, "en", "s", 0), (2, "short", "en", "s", 0)])) == {}
