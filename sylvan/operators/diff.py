"""Tree differences.

The first phase, equal subtrees, is a join on content hashes for all pairs of trees at once.
The phases that depend on order (greedy bottom-up matching, edit distance, edit scripts) run
as one grouped function for each pair of trees, on what the first phase left open.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions.scalars import lcs, qgram_distance, qgrams_of


def equal_subtrees(pairs: DataFrame, occ: DataFrame, content: str = "content", least_height: int = 0) -> DataFrame:
    """(pair, src, dst, size): maximal equal subtrees of pairs(pair, src_root, dst_root).

    A pair of nodes whose parents are equal too is left out: it is inside a larger one.
    """
    side = lambda s: pairs.join(occ.filter(F.col("height") >= least_height), F.col(f"{s}_root") == F.col("root")).select("pair", F.col("pre").alias(s), F.col("parent").alias(f"{s}_parent"), F.col("pos").alias(f"{s}_pos"), F.col("size"), F.col(content).alias("content"))
    a, b = side("src"), side("dst").drop("size")
    both = a.join(b, ["pair", "content"])
    up = both.select("pair", F.col("src").alias("src_parent"), F.col("dst").alias("dst_parent"), F.col("src_pos").alias("__x"))
    inside = (F.col("m.pair") == F.col("u.pair")) & (F.col("m.src_parent") == F.col("u.src_parent")) & (F.col("m.dst_parent") == F.col("u.dst_parent")) & (F.col("m.src_pos") == F.col("m.dst_pos"))
    return both.alias("m").join(up.alias("u"), inside, "left_anti").select("pair", "src", "dst", "size")


def unique_matches(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique, ambiguous): matches whose two nodes have no other partner, and the rest."""
    counted = found.withColumn("__s", F.count("*").over(Window.partitionBy("pair", "src"))).withColumn("__d", F.count("*").over(Window.partitionBy("pair", "dst")))
    one = (F.col("__s") == 1) & (F.col("__d") == 1)
    return counted.filter(one).drop("__s", "__d"), counted.filter(~one).drop("__s", "__d")


def link_below(found: DataFrame) -> DataFrame:
    """(pair, src, dst): all nodes of linked equal subtrees, by equal offsets."""
    return found.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).select("pair", (F.col("src") + F.col("i")).alias("src"), (F.col("dst") + F.col("i")).alias("dst"))


def added_deleted(pairs: DataFrame, occ: DataFrame, content: str = "content") -> DataFrame:
    """(pair, side, pre): nodes of one tree whose content the other lacks: two anti joins."""
    side = lambda s: pairs.join(occ, F.col(f"{s}_root") == F.col("root")).select("pair", "pre", F.col(content).alias("content"))
    a, b = side("src"), side("dst")
    gone, new = a.join(b.select("pair", "content"), ["pair", "content"], "left_anti"), b.join(a.select("pair", "content"), ["pair", "content"], "left_anti")
    return gone.select("pair", F.lit("deleted").alias("side"), "pre").unionByName(new.select("pair", F.lit("added").alias("side"), "pre"))


@dataclass
class Tree:
    """One tree in memory, nodes by pre-order number."""

    type: list[str]
    label: list[str | None]
    parent: list[int | None]
    children: list[list[int]] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    height: list[int] = field(default_factory=list)
    hash: list[bytes] = field(default_factory=list)  # of types, labels and order
    shape: list[bytes] = field(default_factory=list)  # of types and order

    def __post_init__(self):
        n = len(self.type)
        self.children, self.size, self.height, self.hash, self.shape = [[] for _ in range(n)], [1] * n, [0] * n, [b""] * n, [b""] * n
        for i, p in enumerate(self.parent):
            if p is not None:
                self.children[p].append(i)
        for i in range(n - 1, -1, -1):
            self.size[i] += sum(self.size[c] for c in self.children[i])
            self.height[i] = max((self.height[c] + 1 for c in self.children[i]), default=0)
            own = hashlib.blake2b(repr((self.type[i], self.label[i])).encode("utf-8", "surrogatepass"), digest_size=16)
            shape = hashlib.blake2b(self.type[i].encode("utf-8", "surrogatepass"), digest_size=16)
            for c in self.children[i]:
                own.update(self.hash[c])
                shape.update(self.shape[c])
            self.hash[i], self.shape[i] = own.digest(), shape.digest()

    @classmethod
    def nested(cls, spec) -> Tree:
        """From (type, label, [children]) tuples."""
        types, labels, parents = [], [], []

        work = [(spec, None)]
        while work:
            t, up = work.pop()
            i = len(types)
            types.append(str(t[0]))
            labels.append(t[1])
            parents.append(up)
            work += [(c, i) for c in reversed(t[2] if len(t) > 2 else ())]
        return cls(types, labels, parents)

    def below(self, i: int) -> range:
        return range(i + 1, i + self.size[i])

    def postorder(self) -> list[int]:
        depth = [0] * len(self.type)
        for i, p in enumerate(self.parent):
            depth[i] = 0 if p is None else depth[p] + 1
        return sorted(range(len(self.type)), key=lambda i: i + self.size[i] - 1 - depth[i])


class Mapping:
    """One-to-one links of two trees."""

    def __init__(self):
        self.src: dict[int, int] = {}
        self.dst: dict[int, int] = {}

    def link(self, a: int, b: int) -> None:
        self.src[a], self.dst[b] = b, a

    def link_if_free(self, a: int, b: int) -> bool:
        if a in self.src or b in self.dst:
            return False
        self.link(a, b)
        return True

    def cut(self, a: int) -> None:
        """Takes the link of a source node away."""
        del self.dst[self.src.pop(a)]

    def mirrored(self) -> Mapping:
        """The links from the other side."""
        m = Mapping()
        m.src, m.dst = dict(self.dst), dict(self.src)
        return m

    def link_subtrees(self, s: Tree, a: int, b: int) -> None:
        for i in range(s.size[a]):
            self.link(a + i, b + i)


def similarity(s: Tree, d: Tree, m: Mapping, a: int, b: int, kind: str = "dice") -> float:
    """Share of descendants of a linked with descendants of b: dice, jaccard, chawathe or overlap."""
    n = sum(1 for x in s.below(a) if m.src.get(x) in d.below(b))
    x, y = s.size[a] - 1, d.size[b] - 1
    base = {"dice": (x + y) / 2, "jaccard": x + y - n, "chawathe": max(x, y), "overlap": min(x, y)}[kind]
    return n / base if base else 0.0


def top_down(s: Tree, d: Tree, m: Mapping, least_height: int = 1) -> None:
    """Links isomorphic subtrees from the tallest down; ambiguous ones by how alike they lie."""
    ambiguous = []
    a_open, b_open = [0], [0]
    while a_open and b_open:
        ha, hb = max(s.height[i] for i in a_open), max(d.height[i] for i in b_open)
        h = max(ha, hb)
        if h < least_height:
            break
        xs, ys = [i for i in a_open if s.height[i] == h], [i for i in b_open if d.height[i] == h]
        a_open, b_open = [i for i in a_open if s.height[i] < h], [i for i in b_open if d.height[i] < h]
        by_hash: dict[str, list[int]] = {}
        for y in ys:
            by_hash.setdefault(d.hash[y], []).append(y)
        partners = {x: by_hash.get(s.hash[x], []) for x in xs}
        back: dict[int, int] = {}
        for x, bs in partners.items():
            for y in bs:
                back[y] = back.get(y, 0) + 1
        for x, bs in partners.items():
            if len(bs) == 1 and back[bs[0]] == 1:
                m.link_subtrees(s, x, bs[0])
            else:
                ambiguous += [(x, y) for y in bs]
                if not bs:
                    a_open += s.children[x]
        b_open += [c for y in ys if y not in back for c in d.children[y]]

    def place(tree, i):
        p = tree.parent[i]
        return tree.children[p].index(i) if p is not None else 0

    def key(pair):
        x, y = pair
        px, py = s.parent[x], d.parent[y]
        near = similarity(s, d, m, px, py) if px is not None and py is not None else 0.0
        return (-near, place(s, x), abs(place(s, x) - place(d, y)), x, y)

    for x, y in sorted(ambiguous, key=key):
        if not any(x + i in m.src or y + i in m.dst for i in range(s.size[x])):
            m.link_subtrees(s, x, y)


def edit_distance(s: Tree, d: Tree, a: int = 0, b: int = 0) -> tuple[float, list[tuple[int, int]]]:
    """Zhang-Shasha distance of two subtrees and an optimal mapping (pre numbers).

    Insert and delete cost 1; nodes of different types never map; otherwise an update costs
    the q-gram distance of the labels, 1 if just one has a label.
    """

    def order(t: Tree, r: int):
        nodes = [i for i in t.postorder() if r <= i < r + t.size[r]]
        place = {n: k for k, n in enumerate(nodes)}
        first = []
        for n in nodes:
            while t.children[n]:
                n = t.children[n][0]
            first.append(place[n])
        return nodes, first, sorted({f: k for k, f in enumerate(first)}.values())

    def update(x: int, y: int) -> float:
        if s.type[x] != d.type[y]:
            return math.inf
        p, q = s.label[x], d.label[y]
        if p == q:
            return 0.0
        return 1.0 if p is None or q is None else qgram_distance(p, q)

    xs, lx, kx = order(s, a)
    ys, ly, ky = order(d, b)
    tree = [[0.0] * len(ys) for _ in xs]

    def forest(i: int, j: int):
        n, k = i - lx[i] + 2, j - ly[j] + 2
        f = [[0.0] * k for _ in range(n)]
        for p in range(1, n):
            f[p][0] = f[p - 1][0] + 1
        for q in range(1, k):
            f[0][q] = f[0][q - 1] + 1
        for p in range(1, n):
            for q in range(1, k):
                u, v = lx[i] + p - 1, ly[j] + q - 1
                cut = min(f[p - 1][q] + 1, f[p][q - 1] + 1)
                if lx[u] == lx[i] and ly[v] == ly[j]:
                    f[p][q] = min(cut, f[p - 1][q - 1] + update(xs[u], ys[v]))
                    tree[u][v] = f[p][q]
                else:
                    f[p][q] = min(cut, f[lx[u] - lx[i]][ly[v] - ly[j]] + tree[u][v])
        return f

    for i in kx:
        for j in ky:
            forest(i, j)
    links, work = [], [(len(xs) - 1, len(ys) - 1)]
    while work:
        i, j = work.pop()
        f = forest(i, j)
        p, q = i - lx[i] + 1, j - ly[j] + 1
        while p > 0 and q > 0:
            u, v = lx[i] + p - 1, ly[j] + q - 1
            if f[p][q] == f[p - 1][q] + 1:
                p -= 1
            elif f[p][q] == f[p][q - 1] + 1:
                q -= 1
            elif lx[u] == lx[i] and ly[v] == ly[j]:
                links.append((xs[u], ys[v]))
                p, q = p - 1, q - 1
            else:
                work.append((u, v))
                p, q = lx[u] - lx[i], ly[v] - ly[j]
    return tree[-1][-1], sorted(links)


def recover(s: Tree, d: Tree, m: Mapping, a: int, b: int, how: str, limit: int) -> None:
    """Links more nodes inside a linked pair of subtrees.

    how: zs, by edit distance if either side has fewer than limit nodes, else nothing; simple,
    children of equal content, then of equal shape, each by a longest common subsequence,
    then those that are the only open child of their type on both sides, and so on within
    what was linked; hybrid, edit distance if both sides are below limit, else the rest of
    simple without the subsequences; xy, only children alone of their type.
    """
    below = [n < limit for n in (s.size[a], d.size[b])]
    if how == "zs" or how == "hybrid" and all(below):
        if any(below):
            for x, y in edit_distance(s, d, a, b)[1]:
                if s.type[x] == d.type[y]:
                    m.link_if_free(x, y)
        return
    work = [(a, b)]
    while work:
        a, b = work.pop()
        xs, ys = ([c for c in t.children[i] if c not in side] for t, side, i in ((s, m.src, a), (d, m.dst, b)))
        if how == "simple":
            for same in (s.hash, d.hash), (s.shape, d.shape):
                for i, j in lcs(xs, ys, lambda x, y, same=same: same[0][x] == same[1][y]):
                    if not any(xs[i] + k in m.src or ys[j] + k in m.dst for k in range(s.size[xs[i]])):
                        m.link_subtrees(s, xs[i], ys[j])
                xs, ys = [x for x in xs if x not in m.src], [y for y in ys if y not in m.dst]
        kinds = Counter(s.type[x] for x in xs), Counter(d.type[y] for y in ys)
        alone = {d.type[y]: y for y in ys if kinds[1][d.type[y]] == 1}
        for x in reversed(xs):
            y = alone.get(s.type[x])
            if y is not None and kinds[0][s.type[x]] == 1 and m.link_if_free(x, y) and how != "xy":
                work.append((x, y))


@dataclass(frozen=True)
class Matcher:
    """A bottom-up phase: similarity kind, threshold (None: by size), recovery and its size limit.

    stable links only pairs that are each other's best candidate.
    """

    kind: str = "dice"
    threshold: float | None = 0.5
    recovery: str = "zs"
    limit: int = 100
    stable: bool = False


GREEDY = Matcher(limit=1000)
GREEDY_100 = Matcher()
STABLE = Matcher(kind="chawathe", limit=300, stable=True)
SIMPLE = Matcher(kind="chawathe", recovery="simple")
HYBRID = Matcher(kind="chawathe", threshold=None, recovery="hybrid")
XY = Matcher(kind="jaccard", recovery="xy")


def bottom_up(s: Tree, d: Tree, m: Mapping, how: Matcher) -> None:
    """Links inner nodes by what of their descendants is linked, in post-order."""

    def candidates(a):
        seen, out = set(), []
        for x in s.below(a):
            y = m.src.get(x)
            while y is not None and (y := d.parent[y]) is not None and y not in seen:
                seen.add(y)
                if y not in m.dst and d.type[y] == s.type[a] and d.parent[y] is not None:
                    out.append(y)
        return sorted(out)

    def rivals(a, y):
        """Other open nodes of a's kind above the partners of y's descendants."""
        partners = [m.dst[z] for z in d.below(y) if z in m.dst]
        above = {s.parent[p] for p in partners if s.parent[p] is not None}
        return [x for x in above if x != a and x not in m.src and s.type[x] == d.type[y]]

    def best(a):
        options = [(similarity(s, d, m, a, y, how.kind), -y) for y in candidates(a)]
        return max(options, default=(0.0, 0))

    for a in s.postorder():
        if s.parent[a] is None:
            if 0 not in m.dst and a not in m.src and s.type[a] == d.type[0]:
                m.link(a, 0)
                recover(s, d, m, a, 0, how.recovery, how.limit)
        elif a not in m.src and s.children[a]:
            score, y = best(a)
            y = -y
            least = how.threshold if how.threshold is not None else 1 / (1 + math.log(max(2, s.size[a] + d.size[y])))
            if score and score >= least:
                if how.stable and any(similarity(s, d, m, x, y, how.kind) > score for x in rivals(a, y)):
                    continue
                recover(s, d, m, a, y, how.recovery, how.limit)
                m.link_if_free(a, y)
        elif a in m.src and s.hash[a] != d.hash[m.src[a]]:
            recover(s, d, m, a, m.src[a], how.recovery, how.limit)


#: How the types of statements end.
STATEMENTS = "_statement"


def leaves_of(t: Tree, granularity: str) -> list[int]:
    """Nodes that count as leaves: `all` those without children, or `statements`, the lowest statements (and leaves outside any)."""
    if granularity == "all":
        return [i for i in range(len(t.type)) if not t.children[i]]
    inner = [False] * len(t.type)  # a statement further down
    for i in range(len(t.type) - 1, 0, -1):
        p = t.parent[i]
        inner[p] |= inner[i] or t.type[i].endswith(STATEMENTS)
    out, i = [], 0
    while i < len(t.type):
        if (t.type[i].endswith(STATEMENTS) and not inner[i]) or not t.children[i]:
            out.append(i)
            i += t.size[i]
        else:
            i += 1
    return out


def text_of(t: Tree, i: int) -> str:
    """The labels of a subtree, in order."""
    return "".join(t.label[j] or "" for j in range(i, i + t.size[i]))


def change_distiller(s: Tree, d: Tree, m: Mapping, granularity: str = "all") -> None:
    """Leaves by label similarity, best first; then inner nodes bottom-up by linked leaves, best first.

    Only leaves of one type that share a q-gram are compared: without one they can't be
    similar enough.
    """
    xs, ys = leaves_of(s, granularity), leaves_of(d, granularity)
    index: dict[tuple[str, str], list[int]] = {}
    texts = {y: text_of(d, y) for y in ys}
    for y in ys:
        for g in set(qgrams_of(texts[y])):
            index.setdefault((d.type[y], g), []).append(y)
    scored = []
    for x in xs:
        mine = text_of(s, x)
        for y in sorted({y for g in set(qgrams_of(mine)) for y in index.get((s.type[x], g), ())}):
            near = 1 - qgram_distance(mine, texts[y])
            if near > 0.5:
                scored.append((-near, x, y))
    for _, x, y in sorted(scored):
        if x not in m.src and y not in m.dst:
            if s.hash[x] == d.hash[y]:
                m.link_subtrees(s, x, y)
            else:
                m.link(x, y)
    is_leaf = set(xs), set(ys)
    above = [[0] * len(t.type) for t in (s, d)]  # leaves below each node
    for t, leaves, count in ((s, xs, above[0]), (d, ys, above[1])):
        for i in leaves:
            count[i] = 1
        for i in range(len(t.type) - 1, 0, -1):
            count[t.parent[i]] += count[i]
    for a in s.postorder():
        if a in m.src or not s.children[a] or a in is_leaf[0]:
            continue
        met: Counter = Counter()
        for x in (x for x in s.below(a) if x in is_leaf[0]):
            y = m.src.get(x)
            y = None if y is None else d.parent[y]
            while y is not None:
                met[y] += 1
                y = d.parent[y]
        best = (0.0, 0)
        for b, n in met.items():
            if b not in m.dst and d.type[b] == s.type[a]:
                p, q = above[0][a], above[1][b]
                near = n / max(p, q)
                if near >= (0.6 if min(p, q) > 4 else 0.4):
                    best = max(best, (near, -b))
        if best[0]:
            m.link(a, -best[1])


def match(s: Tree, d: Tree, algorithm: str = "greedy") -> Mapping:
    """Links of two trees by one of ALGORITHMS."""
    m = Mapping()
    if algorithm.startswith("change_distiller"):
        change_distiller(s, d, m, "statements" if algorithm.endswith("statements") else "all")
    elif algorithm == "zs":
        for x, y in edit_distance(s, d)[1]:
            m.link(x, y)
    else:
        top_down(s, d, m)
        if algorithm != "subtree":
            bottom_up(s, d, m, ALGORITHMS[algorithm])
    return m


ALGORITHMS = {"greedy": GREEDY, "greedy_100": GREEDY_100, "stable": STABLE, "simple": SIMPLE, "hybrid": HYBRID, "xy": XY, "subtree": None, "change_distiller": None, "change_distiller_statements": None, "zs": None}


def edit_script(s: Tree, d: Tree, m: Mapping) -> list[tuple]:
    """Actions (kind, node, parent, pos, label) that turn s into d: insert, update, move, delete.

    Nodes of s go by their number; an inserted node by ("+", its number in d). parent and pos
    are where an insert or move puts the node at that moment. Siblings keep a longest common
    subsequence in place and move the others. Unlinked roots get a common root "^" above.
    """
    kids: dict = {"^": [0], **{i: list(c) for i, c in enumerate(s.children)}}
    up: dict = {0: "^", **{i: p for i, p in enumerate(s.parent) if p is not None}}
    label: dict = dict(enumerate(s.label))
    partner: dict = {y: x for y, x in m.dst.items()}
    back: dict = {x: y for x, y in m.src.items()}
    done, actions = set(), []

    def put(node, parent, y):
        """The place in parent behind the nearest elder sibling of y that is in place."""
        p = d.parent[y]
        elder = [z for z in (d.children[p] if p is not None else [0]) if z < y and partner.get(z) in done and up.get(partner[z]) == parent]
        return kids[parent].index(partner[elder[-1]]) + 1 if elder else 0

    level = [0]
    while level:
        for y in level:
            p = d.parent[y]
            target = "^" if p is None else partner[p]
            x = partner.get(y)
            if x is None:
                x = ("+", y)
                at = put(x, target, y)
                kids[x], up[x], label[x], partner[y], back[x] = [], target, d.label[y], x, y
                kids[target].insert(at, x)
                actions.append(("insert", x, target, at, d.label[y]))
                done.add(x)
            else:
                if label[x] != d.label[y]:
                    label[x] = d.label[y]
                    actions.append(("update", x, None, None, d.label[y]))
                if up[x] != target:
                    kids[up[x]].remove(x)
                    at = put(x, target, y)
                    kids[target].insert(at, x)
                    up[x] = target
                    actions.append(("move", x, target, at, None))
                    done.add(x)
        for y in level:
            x = partner[y]
            mine = [c for c in kids[x] if c in back and d.parent[back[c]] == y]
            theirs = [z for z in d.children[y] if z in partner and up.get(partner[z]) == x]
            stay = {mine[i] for i, _ in lcs(mine, theirs, lambda c, z: back[c] == z)}
            done |= stay
            for z in theirs:
                c = partner[z]
                if c not in stay:
                    kids[x].remove(c)
                    done.add(c)
                    at = put(c, x, z)
                    kids[x].insert(at, c)
                    actions.append(("move", c, x, at, None))
        level = [c for y in level for c in d.children[y]]

    work = [("^", False)]
    while work:
        x, left = work.pop()
        if not left:
            work += [(x, True), *((c, False) for c in reversed(kids[x]))]
        elif x != "^" and x not in back:
            kids[up[x]].remove(x)
            actions.append(("delete", x, None, None, None))
    return actions


def apply(s: Tree, d: Tree, actions: list[tuple]):
    """The nested tuple of s after the actions (d gives the types of inserted nodes)."""
    kids = {"^": [0], **{i: list(c) for i, c in enumerate(s.children)}}
    up = {0: "^", **{i: p for i, p in enumerate(s.parent) if p is not None}}
    label = dict(enumerate(s.label))
    for kind, x, parent, at, text in actions:
        if kind == "update":
            label[x] = text
            continue
        if kind in ("move", "delete"):
            kids[up[x]].remove(x)
        if kind == "insert":
            kids[x], label[x] = [], text
        if kind in ("insert", "move"):
            kids[parent].insert(at, x)
            up[x] = parent

    made, work = {}, [(x, False) for x in reversed(kids["^"])]
    while work:
        x, ready = work.pop()
        if ready:
            made[x] = (d.type[x[1]] if isinstance(x, tuple) else s.type[x], label[x], [made.pop(c) for c in kids[x]])
        else:
            work += [(x, True), *((c, False) for c in reversed(kids[x]))]
    return [made[x] for x in kids["^"]]


def _by_pair(pairs: DataFrame, occ: DataFrame, work, fields: str) -> DataFrame:
    """Runs work(source tree, destination tree) -> columns for each pair; a task holds two trees at a time."""
    import pandas as pd

    def tree(pdf):
        t = pdf.sort_values("pre")
        return Tree(t.type.tolist(), [None if pd.isna(x) else x for x in t.label], [None if pd.isna(x) else int(x) for x in t.parent])

    def run(pdf):
        s, d = tree(pdf[pdf.side == 0]), tree(pdf[pdf.side == 1])
        if not s.type or not d.type:
            return pd.DataFrame()
        out = pd.DataFrame(work(s, d))
        out.insert(0, "pair", pdf.pair.iloc[0])
        return out

    side = lambda name, i: pairs.join(occ, F.col(name) == F.col("root")).select("pair", F.lit(i).alias("side"), "pre", "parent", "type", "label")
    rows = side("src_root", 0).unionByName(side("dst_root", 1))
    return rows.groupBy("pair").applyInPandas(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, {fields}")


def diff_pairs(pairs: DataFrame, occ: DataFrame, algorithm: str = "greedy_100") -> DataFrame:
    """(pair, links, inserts, updates, moves, deletes) of pairs(pair, src_root, dst_root)."""

    def work(s, d):
        m = match(s, d, algorithm)
        kinds = [a[0] for a in edit_script(s, d, m)]
        return {"links": [len(m.src)], **{k + "s": [kinds.count(k)] for k in ("insert", "update", "move", "delete")}}

    return _by_pair(pairs, occ, work, "links long, inserts long, updates long, moves long, deletes long")


def mappings(pairs: DataFrame, occ: DataFrame, algorithm: str = "greedy_100") -> DataFrame:
    """(pair, src, dst): the linked nodes of each pair, by pre-order number."""

    def work(s, d):
        links = sorted(match(s, d, algorithm).src.items())
        return {"src": [a for a, _ in links], "dst": [b for _, b in links]}

    return _by_pair(pairs, occ, work, "src long, dst long")


def actions(pairs: DataFrame, occ: DataFrame, algorithm: str = "greedy_100") -> DataFrame:
    """(pair, ord, kind, node, node_new, parent, parent_new, pos, label): edit scripts as rows.

    node and parent are numbers in the source tree, or in the destination where *_new is
    true; parent -1 is the place above the root. See edit_script().
    """
    number = lambda x: None if x is None else (-1 if x == "^" else (x[1] if isinstance(x, tuple) else x))

    def work(s, d):
        import pandas as pd

        script = edit_script(s, d, match(s, d, algorithm))
        whole = lambda values: pd.array(values, dtype="Int64")
        return {
            "ord": range(len(script)),
            "kind": [a[0] for a in script],
            "node": whole([number(a[1]) for a in script]),
            "node_new": [isinstance(a[1], tuple) for a in script],
            "parent": whole([number(a[2]) for a in script]),
            "parent_new": [isinstance(a[2], tuple) for a in script],
            "pos": whole([a[3] for a in script]),
            "label": [a[4] for a in script],
        }

    return _by_pair(pairs, occ, work, "ord int, kind string, node long, node_new boolean, parent long, parent_new boolean, pos long, label string")


def compare_mappings(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(pair, same, missing, additional): links of each pair against expected ones: a full outer join."""
    keys = ["pair", "src", "dst"]
    both = found.select(*keys).distinct().withColumn("__f", F.lit(True)).join(expected.select(*keys).distinct().withColumn("__e", F.lit(True)), keys, "full_outer")
    has, wanted = F.col("__f").isNotNull(), F.col("__e").isNotNull()
    return both.groupBy("pair").agg(F.count_if(has & wanted).alias("same"), F.count_if(~has).alias("missing"), F.count_if(~wanted).alias("additional"))


def script_text(actions: DataFrame) -> DataFrame:
    """(pair, script): a line for each action, in order."""
    place = lambda c: F.concat(F.when(F.col(f"{c}_new"), "+").otherwise(""), F.col(c).cast("string"))
    line = F.concat_ws(" ", "kind", place("node"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("to "), place("parent"), F.lit("."), F.col("pos").cast("string"))), F.col("label"))
    return actions.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x.t), "\n").alias("script"))


def examples(actions: DataFrame) -> DataFrame:
    """(pair, kind, nodes): what each pair deletes, inserts, moves and updates, as example sets for mining."""
    return actions.groupBy("pair", "kind").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def open_nodes(pairs: DataFrame, occ: DataFrame, content: str = "content", least_height: int = 1) -> DataFrame:
    """(pair, side, root, pre): what is left of each pair when unique equal subtrees are linked.

    Later phases need only these nodes: most of two versions of a file is alike.
    """
    unique, _ = unique_matches(equal_subtrees(pairs, occ, content, least_height))
    linked = link_below(unique)
    side = lambda s: pairs.join(occ.select("root", "pre"), F.col(f"{s}_root") == F.col("root")).select("pair", F.lit(s).alias("side"), "root", "pre").join(linked.select("pair", F.col(s).alias("pre")), ["pair", "pre"], "left_anti").select("pair", "side", "root", "pre")
    return side("src").unionByName(side("dst"))


def mapping_view(pairs: DataFrame, links: DataFrame, occ: DataFrame) -> DataFrame:
    """(pair, src, dst, src_node, dst_node, same): links with type and label of both ends, and the nodes without one."""
    node = F.concat_ws(" ", "type", "label")
    side = lambda s: pairs.join(occ, F.col(f"{s}_root") == F.col("root")).select("pair", F.col("pre").cast("long").alias(s), node.alias(f"{s}_node"))
    ends = side("src").join(links, ["pair", "src"], "left").join(side("dst"), ["pair", "dst"], "full_outer")
    return ends.select("pair", "src", "dst", "src_node", "dst_node", F.col("src_node").eqNullSafe(F.col("dst_node")).alias("same"))


def summary(actions: DataFrame) -> DataFrame:
    """(pair, kind, n): how many actions of each kind."""
    return actions.groupBy("pair", "kind").agg(F.count("*").alias("n"))


def focus(actions: DataFrame, occ: DataFrame, pairs: DataFrame, kinds: list[str], file_types: list[str]) -> DataFrame:
    """(pair, kind, node, label, file): where actions of some kinds act, with the file node around, for source nodes."""
    from sylvan.operators.navigation import enclosing

    acts = actions.filter(F.col("kind").isin(kinds) & ~F.col("node_new")).join(pairs.select("pair", F.col("src_root").alias("root")), "pair").withColumn("pre", F.col("node"))
    files = enclosing(occ, acts.select("root", "pre"), file_types)
    return acts.join(files, ["root", "pre"], "left").select("pair", "kind", "node", "label", F.col("ancestor").alias("file"))


def nested(t: Tree):
    """A tree as nested (type, label, [children]) tuples."""
    made: list = [None] * len(t.type)
    for i in range(len(t.type) - 1, -1, -1):
        made[i] = (t.type[i], t.label[i], [made[c] for c in t.children[i]])
    return made[0]


def verified(pairs: DataFrame, occ: DataFrame, algorithm: str = "greedy_100") -> DataFrame:
    """(pair, same): whether the source tree after its script is the destination tree."""

    def work(s, d):
        return {"same": [apply(s, d, edit_script(s, d, match(s, d, algorithm))) == [nested(d)]]}

    return _by_pair(pairs, occ, work, "same boolean")
