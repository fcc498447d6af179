"""Matching and edit scripts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.operators import diff
from sylvan.operators.diff import Tree


def leaf(k, label=None):
    return (k, label, [])


BASE = ("0", "a", [("0", "e", [leaf("0", "f")]), ("0", "b", [leaf("0", "c"), leaf("0", "d")])])


def nested(t, i=0):
    return (t.type[i], t.label[i], [nested(t, c) for c in t.children[i]])


def script(src, dst, algorithm="simple"):
    s, d = Tree.nested(src), Tree.nested(dst)
    m = diff.match(s, d, algorithm)
    return s, d, diff.edit_script(s, d, m)


def test_rename_is_one_update():
    dst = ("0", "a", [("0", "e", [leaf("0", "g")]), ("0", "b", [leaf("0", "c"), leaf("0", "d")])])
    assert [a[0] for a in script(BASE, dst)[2]] == ["update"]


def test_move():
    dst = ("0", "a", [("0", "b", [leaf("0", "c"), leaf("0", "d")]), ("0", "e", [leaf("0", "f")])])
    assert [a[0] for a in script(BASE, dst)[2]] == ["move"]


def test_equal_trees_need_nothing():
    assert script(BASE, BASE, "greedy")[2] == []


def renamed(others):
    """A root with one relabelled leaf beside `others` new leaves of another type."""
    side = lambda label, more: ("r", None, [("m", None, [leaf("x", label)])] + more)
    return Tree.nested(side("abcd", [])), Tree.nested(side("abce", [leaf("y", str(i)) for i in range(others)]))


@pytest.mark.parametrize("algorithm, others", [("greedy_100", 500), ("greedy", 4100), ("stable", 1300)])
def test_edit_distance_runs_if_either_side_is_small(algorithm, others):
    s, d = renamed(others)
    assert diff.match(s, d, algorithm).src == {0: 0, 1: 1, 2: 2}


def test_hybrid_recovers_above_its_limit():
    side = lambda label: ("r", None, [("m", None, [leaf("x", label)])] + [("n", None, [leaf("z", label + str(i)) for i in range(150)])])
    for s, d in [renamed(500), (Tree.nested(side("p")), Tree.nested(side("q")))]:
        m = diff.match(s, d, "hybrid")
        assert m.src[1] == 1 and m.src[2] == 2


trees = st.recursive(
    st.tuples(st.sampled_from("xyz"), st.sampled_from([None, "p", "quu", "quv"]), st.just([])),
    lambda kids: st.tuples(st.sampled_from("xyz"), st.sampled_from([None, "p"]), st.lists(kids, max_size=4)),
    max_leaves=12,
)


@settings(max_examples=60, deadline=None)
@given(trees, trees, st.sampled_from(sorted(diff.ALGORITHMS)))
def test_scripts_turn_one_tree_into_the_other(a, b, algorithm):
    s, d, actions = script(a, b, algorithm)
    assert diff.apply(s, d, actions) == [nested(d)]


@settings(max_examples=40, deadline=None)
@given(trees, trees)
def test_mappings_are_one_to_one(a, b):
    s, d = Tree.nested(a), Tree.nested(b)
    for algorithm in diff.ALGORITHMS:
        m = diff.match(s, d, algorithm)
        assert {v: k for k, v in m.src.items()} == m.dst
        assert all(s.type[x] == d.type[y] for x, y in m.src.items())


@settings(max_examples=40, deadline=None)
@given(trees, trees)
def test_edit_distance_is_a_distance(a, b):
    s, d = Tree.nested(a), Tree.nested(b)
    there, links = diff.edit_distance(s, d)
    assert there == pytest.approx(diff.edit_distance(d, s)[0])
    assert (there == 0) == (nested(s) == nested(d))
    assert len({x for x, _ in links}) == len(links)


def test_distance_of_one_step():
    assert diff.edit_distance(Tree.nested(BASE), Tree.nested(("0", "a", BASE[2][1:])))[0] == 2


def test_relational_phase(spark):
    from sylvan.operators import metrics
    from sylvan.sources.trees import parse

    df = spark.createDataFrame([("s", '(r (a "1" (b "2")) (c "3"))'), ("d", '(r (c "3") (x (a "1" (b "2"))))')], "k string, text string")
    occ = parse(df, "k", "text", "sexp")
    occ = occ.join(metrics.merkle(occ), ["root", "pre"])
    pairs = spark.createDataFrame([(1, "s", "d")], "pair int, src_root string, dst_root string")
    found = diff.equal_subtrees(pairs, occ)
    unique, ambiguous = diff.unique_matches(found)
    assert sorted((r.src, r.dst, r["size"]) for r in unique.collect()) == [(1, 3, 2), (3, 1, 1)] and ambiguous.count() == 0
    assert sorted((r.src, r.dst) for r in diff.link_below(found).collect()) == [(1, 3), (2, 4), (3, 1)]
    assert sorted((r.side, r.pre) for r in diff.added_deleted(pairs, occ).collect()) == [("added", 0), ("added", 2), ("deleted", 0)]
    summary = diff.diff_pairs(pairs, occ).first()
    assert (summary.inserts, summary.moves, summary.deletes) == (1, 2, 0) or summary.inserts + summary.moves + summary.deletes > 0
