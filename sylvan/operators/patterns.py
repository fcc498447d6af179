"""Tree patterns: an S-expression language compiled to structural joins.

    (type role: (child) @capture . (next) "token" _ [alternatives] !field (#eq? @a @b))

A pattern becomes one aliased scan of the occurrences for each step, with type, role and text
conditions on the scan, an equi-join for each parent-child step and conditions on places for
sibling order and anchors. A repeated step becomes one array of the siblings it matches, so a
run gives one row, the longest. The result has one row for each distinct set of captured nodes.
"""

from __future__ import annotations

import copy
import itertools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut
from sylvan.sources.types import ABSTRACT, SHARED, typed

_TOKEN = re.compile(r"""\s+|;[^\n]*|"(?:[^"\\]|\\.)*"|[()\[\]]|[.](?=[\s()\[\]])|[?*+]|@[\w.-]+|#[\w-]+[?!]?|![\w-]+|[\w-]+:|[\w/.-]+""")


@dataclass
class Step:
    """A node to match. types: alternatives; None any named node; "_" any node at all."""

    types: list[str] | None = None
    supertype: str | None = None  # (sup/sub): sup must be among the node's supertypes
    any_node: bool = False
    role: str | None = None
    captures: list[str] = field(default_factory=list)
    children: list[Step] = field(default_factory=list)
    without: list[str] = field(default_factory=list)
    anchored: bool = False  # right behind the step before it, or the first child
    last: bool = False  # the last child
    quantifier: str = ""
    predicates: list[tuple] = field(default_factory=list)  # immediate ones, on this node
    options: list[Step] = field(default_factory=list)  # alternation of whole patterns
    group: bool = False  # only holds its children together


@dataclass
class Pattern:
    root: Step
    predicates: list[tuple] = field(default_factory=list)
    properties: dict = field(default_factory=dict)


def parse(source: str) -> list[Pattern]:
    """Patterns of a query text."""
    tokens = []
    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"unexpected {source[at : at + 10]!r} at {at}")
        at = m.end()
        if not m[0].isspace() and not m[0].startswith(";"):
            tokens.append(m[0])
    patterns, i = [], 0
    while i < len(tokens):
        if tokens[i] == "(" and i + 1 < len(tokens) and tokens[i + 1].startswith("#"):
            predicate, i = _predicate(tokens, i)
            if not patterns:
                raise ValueError("a predicate without a pattern")
            _attach(patterns[-1], predicate)
            continue
        late: list[tuple] = []
        step, i = _step(tokens, i, late)
        patterns.append(Pattern(step))
        for predicate in late:
            _attach(patterns[-1], predicate)
    return patterns


def _attach(pattern: Pattern, predicate: tuple) -> None:
    if predicate[0] == "#set!":
        pattern.properties[predicate[1][0]] = predicate[1][1] if len(predicate[1]) > 1 else True
    elif predicate[0] in ("#is?", "#is-not?"):
        pattern.properties[predicate[1][0]] = predicate[0] == "#is?"
    else:
        pattern.predicates.append(predicate)


def _predicate(tokens, i):
    name, args = tokens[i + 1], []
    i += 2
    while tokens[i] != ")":
        args.append(json.loads(tokens[i]) if tokens[i].startswith('"') else tokens[i])
        i += 1
    return (name, args), i + 1


def _step(tokens, i, late):
    role = None
    if tokens[i].endswith(":") and len(tokens[i]) > 1:
        role, i = tokens[i][:-1], i + 1
    t = tokens[i]
    if t == "[":
        options, i = [], i + 1
        while tokens[i] != "]":
            option, i = _step(tokens, i, late)
            options.append(option)
        i += 1
        plain = all(o.types and not (o.supertype or o.children or o.captures or o.options or o.without or o.role or o.quantifier or o.predicates) for o in options)
        step = Step(types=[x for o in options for x in o.types]) if plain else Step(options=options)
    elif t == "(":
        i += 1
        if tokens[i] in ("(", "[", ".") or tokens[i].startswith('"') or tokens[i].endswith(":"):
            step = Step(types=[], any_node=True, group=True)  # siblings, below whatever parent
        else:
            above, _, name = tokens[i].rpartition("/")
            step = Step(types=None if name == "_" else [name], supertype=above or None)
            i += 1
        anchored = False
        while tokens[i] != ")":
            if tokens[i] == ".":
                anchored, i = True, i + 1
            elif tokens[i].startswith("!"):
                step.without.append(tokens[i][1:])
                i += 1
            elif tokens[i] == "(" and tokens[i + 1].startswith("#"):
                predicate, i = _predicate(tokens, i)
                if predicate[0][1:].rstrip("?").replace("-", "").isupper():
                    (step.children[-1] if step.children else step).predicates.append(predicate)
                else:
                    late.append(predicate)
            else:
                child, i = _step(tokens, i, late)
                child.anchored, anchored = anchored or child.anchored, False
                step.children.append(child)
        if anchored and step.children:
            step.children[-1].last = True
        i += 1
        if step.group and len(step.children) == 1:
            step = step.children[0]  # ((a) @x (#eq? ...)): brackets around one step and its predicates
    elif t.startswith('"'):
        step, i = Step(types=[json.loads(t)]), i + 1
    elif t == "_":
        step, i = Step(any_node=True), i + 1
    else:
        raise ValueError(f"unexpected {t!r}")
    step.role = role or step.role
    while i < len(tokens) and (tokens[i] in ("?", "*", "+") or tokens[i].startswith("@")):
        if tokens[i] in ("?", "*", "+"):
            step.quantifier = tokens[i]
        else:
            step.captures.append(tokens[i][1:])
        i += 1
    if step.group and (step.quantifier or step.captures):
        raise ValueError("a group of several siblings can't be repeated or captured")
    return step, i


def _sequences(step: Step) -> list[list[Step]]:
    """What a step stands for among its siblings: alternatives, each a list of steps without groups or options."""
    if step.options:
        out = []
        for option in step.options:
            for steps in _sequences(option):
                steps = [copy.deepcopy(x) for x in steps]
                first, last = steps[0], steps[-1]
                first.anchored, last.last = step.anchored or first.anchored, step.last or last.last
                if len(steps) == 1:
                    first.captures += step.captures
                    first.predicates = first.predicates + step.predicates
                    first.role, first.quantifier = step.role or first.role, step.quantifier or first.quantifier
                elif step.captures or step.quantifier or step.role:
                    raise ValueError("a group of several siblings can't be repeated, captured or named")
                out.append(steps)
        return out
    below = [[x for part in parts for x in part] for parts in itertools.product(*(_sequences(c) for c in step.children))]
    if not step.group:
        out = []
        for kids in below:
            whole = copy.copy(step)
            whole.children = kids
            out.append([whole])
        return out
    for kids in below:
        kids[0] = copy.copy(kids[0])
        kids[0].anchored = step.anchored or kids[0].anchored
        kids[-1] = copy.copy(kids[-1])
        kids[-1].last = step.last or kids[-1].last
    return below


def _expand(root: Step) -> list[Step]:
    """A pattern without alternations, for each choice; a rootless group hangs below any node."""
    return [steps[0] if len(steps) == 1 else Step(types=[], any_node=True, children=steps) for steps in _sequences(root)]


def walk(step: Step):
    """A step and all below it, options included."""
    yield step
    for x in [*step.children, *step.options]:
        yield from walk(x)


def visible(occ: DataFrame) -> DataFrame:
    """occ without rows that `is_hidden` marks; what they hold hangs below the nearest visible node.

    One join for each level of hidden nodes in a row. Places among siblings are numbered anew.
    """
    keys = cut(occ.select("root", "pre", "parent", "is_hidden"))
    while True:
        hidden = keys.filter("is_hidden").select("root", F.col("pre").alias("parent"), F.col("parent").alias("__up"))
        if keys.join(hidden, ["root", "parent"], "left_semi").isEmpty():
            break
        lifted = keys.join(hidden.withColumn("__hit", F.lit(True)), ["root", "parent"], "left")
        keys = cut(lifted.select("root", "pre", F.when(F.col("__hit"), F.col("__up")).otherwise(F.col("parent")).alias("parent"), "is_hidden"))
    rest = occ.filter(~F.col("is_hidden")).drop("parent", "pos").join(keys.select("root", "pre", "parent"), ["root", "pre"])
    return rest.withColumn("pos", F.row_number().over(Window.partitionBy("root", "parent").orderBy("pre")) - 1)


def prepared(occ: DataFrame) -> DataFrame:
    """Adds what steps look at: named, and places and counts among named and among all but white space.

    Nodes marked by a column is_hidden are looked through.
    """
    if "is_hidden" in occ.columns:
        occ = visible(occ)
    named = F.col("type").rlike("^[A-Za-z_]") & (F.col("type") != "spaces")
    if "text" not in occ.columns:
        occ = occ.withColumn("text", F.col("label"))
    siblings = Window.partitionBy("root", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = occ.withColumn("named", named)
    rank = F.sum(F.col("named").cast("int")).over(siblings)
    every = Window.partitionBy("root", "parent")
    solid = (F.col("type") != "spaces").cast("int")
    return rows.withColumns({"named_pos": rank - 1, "named_count": F.sum(F.col("named").cast("int")).over(every), "solid_pos": F.sum(solid).over(siblings) - 1, "solid_count": F.sum(solid).over(every)})


#: What a predicate on a node's text tests, by its name without "any-": text, arguments -> condition.
TESTS: dict[str, Callable] = {
    "eq": lambda text, args: text == args[0],
    "not-eq": lambda text, args: text != args[0],
    "match": lambda text, args: text.rlike(args[0]),
    "not-match": lambda text, args: ~text.rlike(args[0]),
    "any-of": lambda text, args: text.isin(args),
    "any": lambda text, args: text.isin(args),
    "not-any-of": lambda text, args: ~text.isin(args),
}


def _kind(name: str) -> tuple[str, bool]:
    """(test, whether one node that holds is enough) of a predicate's name."""
    bare = name[1:].rstrip("?").lower()
    some = bare.startswith("any-") and bare != "any-of"
    return (bare[4:] if some else bare), some


def _text_test(text: Column, name: str, args: list) -> Column:
    kind, _ = _kind(name)
    if kind not in TESTS:
        raise ValueError(f"unknown predicate {name}")
    return F.coalesce(TESTS[kind](text, args), F.lit(kind.startswith("not")))


def _named(nodes: Column, name: str, *fields: str) -> Column:
    """An array of nodes with a capture's name before some of their fields."""
    return F.transform(nodes, lambda e: F.struct(F.lit(name).alias("name"), *(e[f].alias(f) for f in fields)))


def _of_name(nodes: Column, name: str) -> Column:
    """The nodes of one capture, without its name."""
    return F.transform(F.filter(nodes, lambda e: e["name"] == name), lambda e: F.struct(e.pre.alias("pre"), e.text.alias("text"), e.content.alias("content")))


class _Plan:
    """Joins the scans of one pattern. Node columns are prefixed by the step's alias; a repeated
    step has one column, an array of structs, and the node before it in `before`."""

    FIELDS = ("root", "pre", "parent", "pos", "named_pos", "named_count", "solid_pos", "solid_count", "text")

    def __init__(self, occ: DataFrame, content: str | None, start: int = 0):
        self.occ, self.content, self.count = occ, content, start
        self.df: DataFrame | None = None
        self.captured: dict[str, list[Column]] = {}  # arrays of struct(pre, text, content)
        self.plain: dict[str, str] = {}  # captures of just one node that is always there
        self.mark: dict[str, bool] = {}
        self.run: dict[str, str | None] = {}
        self.steps = 0

    def fields(self):
        return [*self.FIELDS, *([self.content] if self.content else [])]

    def scan(self, step: Step) -> tuple[str, DataFrame]:
        """The step's rows, columns prefixed by a new alias."""
        name = f"s{self.count}"
        self.count += 1
        self.steps += 1
        rows = self.occ
        if step.types:
            rows = rows.filter(F.col("type").isin(step.types))
        elif not step.any_node:
            rows = rows.filter(F.col("named") & (F.col("type") != "ERROR"))
        else:
            rows = rows.filter(F.col("type") != "ERROR")
        if step.supertype:
            rows = rows.filter(F.array_contains("supertypes", step.supertype))
        if step.role:
            rows = rows.filter(F.col("role") == step.role)
        for predicate, args in step.predicates:
            rows = rows.filter(_text_test(F.col("text"), predicate, args))
        for role in step.without:
            having = self.occ.filter(F.col("role") == role).select("root", F.col("parent").alias("pre"))
            rows = rows.join(having, ["root", "pre"], "left_anti")
        self.mark[name] = bool(step.types) and not any(t[0].isalpha() or t[0] == "_" for t in step.types)
        return name, rows.select(*(F.col(c).alias(f"{name}_{c}") for c in self.fields()))

    def place(self, last: str | None, among: str) -> Column:
        """The place of what stands before a step: of a node, or the last of a run, or of what is before an empty run."""
        if last is None:
            return F.lit(-1)
        if last not in self.run:
            return F.col(f"{last}_{among}")
        return F.coalesce(F.get(F.col(last), F.size(last) - 1)[among], self.place(self.run[last], among))

    def touching(self, name: str, last: str | None) -> str:
        """Marks (unnamed nodes) are adjacent to what stands next to them; named nodes look past marks."""
        return "solid_pos" if any(self.mark[a] for a in (name, last) if a is not None) else "named_pos"

    def trim(self, last: str, here: Column) -> None:
        """Leaves of a run what lies before a place; a run that must not be empty drops the row."""
        while last in self.run:
            self.df = self.df.withColumn(last, F.filter(last, lambda e: e.pos < here))
            if self.mark[last + "+"]:
                self.df = self.df.filter(F.size(last) > 0)
                return
            last = self.run[last]

    def add(self, step: Step, parent: str | None, before: str | None) -> str:
        name, rows = self.scan(step)
        if self.df is None:
            self.df = rows
        else:
            on = (rows[f"{name}_root"] == self.df[f"{parent}_root"]) & (rows[f"{name}_parent"] == self.df[f"{parent}_pre"])
            optional, after_run = step.quantifier == "?", before in self.run
            among = self.touching(name, before)
            follows = F.col(f"{name}_{among}") == self.place(before, among) + 1 if step.anchored else (F.col(f"{name}_pos") > self.place(before, "pos") if before is not None else F.lit(True))
            own = "solid" if self.mark[name] else "named"
            ends = F.col(f"{name}_{own}_pos") == F.col(f"{name}_{own}_count") - 1 if step.last else F.lit(True)
            if after_run:
                if optional:
                    raise ValueError("an optional step right behind a repeated one")
                self.df = self.df.join(rows, on & ends)
                self.trim(before, F.col(f"{name}_pos"))
                self.df = self.df.filter(follows)
            else:
                self.df = self.df.join(rows, on & follows & ends, "left" if optional else "inner")
        entry = F.struct(F.col(f"{name}_pre").cast("long").alias("pre"), F.col(f"{name}_text").alias("text"), F.col(f"{name}_{self.content or 'text'}").alias("content"))
        for c in step.captures:
            self.captured.setdefault(c, []).append(F.filter(F.array(entry), lambda e: e.pre.isNotNull()))
            self.plain[c] = name if step.quantifier != "?" and len(self.captured[c]) == 1 and c not in self.plain else ""
        self.below(step, name)
        return name

    def below(self, step: Step, name: str) -> None:
        last = None
        for child in step.children:
            if child.quantifier in ("*", "+"):
                last = self.repeat(child, name, last)
            else:
                here = self.add(child, name, last)
                last = last if child.quantifier == "?" else here

    def repeat(self, step: Step, parent: str, before: str | None) -> str:
        """Joins the run of siblings that match a step, by one array for each parent."""
        one = copy.copy(step)
        one.quantifier, one.anchored, one.last = "", False, False
        inner = _Plan(self.occ, self.content, self.count)
        top = inner.add(one, None, None)
        self.count, self.steps = inner.count, self.steps + inner.steps
        caps = [_named(values, c, "pre", "text", "content") for c, arrays in sorted(inner.captured.items()) for values in arrays]
        empty = F.array().cast("array<struct<name:string,pre:bigint,text:string,content:string>>")
        element = F.struct(*(F.col(f"{top}_{c}").cast("long").alias(c) for c in ("pos", "pre", "named_pos", "named_count", "solid_pos", "solid_count")), (F.concat(*caps) if caps else empty).alias("caps"))
        name = f"r{self.count}"
        self.count += 1
        runs = inner.df.groupBy(F.col(f"{top}_root").alias(f"{name}_root"), F.col(f"{top}_parent").alias(f"{name}_parent")).agg(F.array_sort(F.collect_set(element)).alias(name))
        self.mark[name], self.mark[name + "+"] = inner.mark[top], step.quantifier == "+"
        on = (F.col(f"{name}_root") == F.col(f"{parent}_root")) & (F.col(f"{name}_parent") == F.col(f"{parent}_pre"))
        self.df = self.df.join(runs, on, "inner" if step.quantifier == "+" else "left").drop(f"{name}_root", f"{name}_parent")
        self.df = self.df.withColumn(name, F.coalesce(F.col(name), F.array().cast(runs.schema[name].dataType)))
        start = self.place(before, "pos")
        if before in self.run:
            raise ValueError("a repeated step right behind another")
        self.df = self.df.withColumn(name, F.filter(name, lambda e: e.pos > start))
        self.run[name] = before
        among, own = self.touching(name, before), "solid" if self.mark[name] else "named"
        fits = F.lit(True)
        if step.anchored:
            fits &= F.get(F.col(name), 0)[among] == self.place(before, among) + 1
        if step.last:
            final = F.get(F.col(name), F.size(name) - 1)
            fits &= final[f"{own}_pos"] == final[f"{own}_count"] - 1
        self.df = self.df.filter((F.size(name) > 0) & fits if step.quantifier == "+" else (F.size(name) == 0) | fits)
        for c in inner.captured:
            self.captured.setdefault(c, []).append(_of_name(F.flatten(F.transform(name, lambda e: e.caps)), c))
            self.plain[c] = ""
        return name

    def nodes(self, capture: str) -> Column:
        if capture not in self.captured:
            raise ValueError(f"no capture @{capture}")
        return F.concat(*self.captured[capture])

    def test(self, name: str, args: list, hooks: dict[str, Callable]) -> Column:
        """The condition of a predicate on captures."""
        kind, some = _kind(name)
        first = args[0][1:]
        self.nodes(first)
        if kind not in TESTS:
            if name not in hooks:
                raise ValueError(f"unknown predicate {name}")
            return hooks[name](*(F.transform(self.nodes(a[1:]), lambda e: e.text) if isinstance(a, str) and a.startswith("@") else a for a in args))
        a = self.plain.get(first)
        if len(args) > 1 and isinstance(args[1], str) and args[1].startswith("@"):
            other = args[1][1:]
            self.nodes(other)
            b = self.plain.get(other)
            negative = kind.startswith("not")
            if a and b:
                what = self.content or "text"
                same = F.col(f"{a}_{what}").eqNullSafe(F.col(f"{b}_{what}"))
                return ~same if negative else same
            x, y = self.nodes(first), self.nodes(other)
            equal = F.zip_with(x, y, lambda e, g: (e.isNotNull() & g.isNotNull() & e.content.eqNullSafe(g.content)) != negative)
            return F.exists(equal, lambda v: v) if some else (F.size(x) == F.size(y)) & F.forall(equal, lambda v: v)
        if a:
            return _text_test(F.col(f"{a}_text"), name, args[1:])
        return (F.exists if some else F.forall)(self.nodes(first), lambda e: _text_test(e.text, name, args[1:]))


CAPTURES = "array<struct<name:string,pre:bigint>>"


def matches(occ: DataFrame, source: str | list[Pattern], content: str | None = None, root_only: bool = False, enabled: list[int] | None = None, predicates: dict[str, Callable] | None = None) -> DataFrame:
    """(root, pattern, at, captures): one row for each distinct match.

    at is the pre of the pattern's root node; captures lists (name, pre). `content` names a
    column of content hashes: with it #eq? on two captures compares subtrees, else texts.
    A repeated step (`+`, `*`) matches all siblings it can between its neighbours, in one row;
    an `any-` predicate holds if some captured node does, others if all do. root_only matches
    at tree roots alone; enabled lists the patterns to run. predicates gives further ones by
    name ("#near?"): functions of their arguments that return a condition, where a capture
    comes as the array of its nodes' texts. A supertype is looked for in the column
    `supertypes` or, without one, in the types that sources.types derives; unknown
    supertypes, predicates and captures raise ValueError.
    """
    patterns = parse(source) if isinstance(source, str) else source
    every = [s for p in patterns for s in walk(p.root)]
    above = {s.supertype for s in every if s.supertype}
    if above and "supertypes" not in occ.columns:
        unknown = above - {name for name, _ in [*ABSTRACT, *SHARED]}
        if unknown:
            raise ValueError(f"unknown supertypes: {sorted(unknown)}")
        occ = typed(occ)
    base = prepared(occ)
    keep = ["root", "pre", "parent", "pos", "named", "named_pos", "named_count", "solid_pos", "solid_count", "type", "role", "text", *([content] if content else []), *(["supertypes"] if above else [])]
    # Only types that some step names are kept; places among siblings are known by now.
    roles = {r for s in every for r in s.without}
    kinds = [None if s.any_node and not s.group or s.types is None and not s.options else s.types for s in every if not s.group or s.types]
    rootless = any(len(steps) > 1 for p in patterns for steps in _sequences(p.root))
    base = base.select(*keep)
    if None not in kinds and not rootless:
        base = base.filter(F.col("type").isin(sorted({t for k in kinds for t in k})) | F.col("role").isin(sorted(roles)))
    if len(every) > 1:
        base = cut(base)
    out = None
    for index, pattern in enumerate(patterns):
        if enabled is not None and index not in enabled:
            continue
        choices = _expand(pattern.root)
        found, once = None, len(choices) == 1
        for step in choices:
            plan = _Plan(base, content)
            top = plan.add(step, None, None)
            df = plan.df
            if root_only:
                df = df.filter(F.col(f"{top}_parent").isNull())
            for name, args in pattern.predicates:
                df = df.filter(plan.test(name, args, predicates or {}))
            pairs = [_named(values, c, "pre") for c, arrays in sorted(plan.captured.items()) for values in arrays]
            captured = F.concat(*pairs) if pairs else F.array()
            part = df.select(F.col(f"{top}_root").alias("root"), F.lit(index).alias("pattern"), F.col(f"{top}_pre").cast("long").alias("at"), captured.cast(CAPTURES).alias("captures"))
            found = part if found is None else found.unionByName(part)
            # Each step but the first is told apart by its capture, or a match could come twice.
            once &= all(s.captures for s in walk(step) if s is not step)
        found = found if once else found.distinct()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else base.select("root", F.lit(0).alias("pattern"), F.lit(0).cast("long").alias("at"), F.array().cast(CAPTURES).alias("captures")).limit(0)


def counts(occ: DataFrame, source: str, keys: DataFrame | None = None, **options) -> DataFrame:
    """(root, pattern, matches), zero where there are none; keys(root) lists the trees."""
    n = len(parse(source))
    trees = (keys if keys is not None else occ).select("root").distinct()
    every = trees.select("root", F.explode(F.array(*map(F.lit, range(n)))).alias("pattern"))
    found = matches(occ, source, **options).groupBy("root", "pattern").agg(F.count("*").alias("found"))
    return every.join(found, ["root", "pattern"], "left").select("root", "pattern", F.coalesce("found", F.lit(0)).alias("matches"))


def limited(found: DataFrame, limit: int) -> DataFrame:
    """At most `limit` matches of each pattern in each tree, first nodes first."""
    order = Window.partitionBy("root", "pattern").orderBy("at", F.transform("captures", lambda c: c.pre), F.transform("captures", lambda c: c["name"]))
    return found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= limit).drop("__r")


def skip_by_bits(occ: DataFrame, bits: str, needed: int) -> DataFrame:
    """Trees whose root lacks a needed sub-query's bit can't match: a semi join on the rest."""
    able = occ.filter((F.col("pre") == 0) & (F.col(bits).bitwiseAND(F.lit(needed)) == needed)).select("root")
    return occ.join(able, "root", "left_semi")


def to_text(step: Step, captures: bool = True) -> str:
    """The pattern text of a step; without captures it tells which patterns look for the same."""
    parts = [to_text(o, captures) for o in step.options] if step.options else []
    below = []
    for c in step.children:
        below += [*(["."] if c.anchored else []), to_text(c, captures), *(["."] if c.last else [])]
    tests = [f"({n} {' '.join(json.dumps(a) for a in args)})" for n, args in step.predicates]
    if parts:
        text = "[" + " ".join(parts) + "]" + "".join(" " + t for t in tests)
    elif step.group:
        text = "(" + " ".join(below) + ")"
    elif len(step.types or ()) == 1 and not (step.types[0][0].isalpha() or step.types[0][0] == "_"):
        text = json.dumps(step.types[0])
    elif len(step.types or ()) > 1:
        text = "[" + " ".join(f"({t})" if t[0].isalpha() or t[0] == "_" else json.dumps(t) for t in step.types) + "]" + "".join(" " + t for t in tests)
    elif step.any_node and not (below or tests or step.without):
        text = "_"
    else:
        name = step.types[0] if step.types else "_"
        text = "(" + " ".join([(step.supertype + "/" if step.supertype else "") + name, *("!" + r for r in step.without), *tests, *below]) + ")"
    text = (step.role + ": " if step.role else "") + text + step.quantifier
    return text + "".join(" @" + c for c in step.captures) if captures else text


def shared_patterns(source: str, precomputed: str) -> list[list[int]]:
    """For each pattern of source the precomputed ones (single patterns, by number) it can't match without.

    One that equals a step of it, whatever is captured, with all below; steps that may be
    absent, alternatives and what lies in them don't count, nor do roles, as a precomputed
    pattern is one on its own.
    """
    ready = {}
    for i, p in enumerate(parse(precomputed)):
        ready.setdefault(to_text(p.root, captures=False), []).append(i)

    def needed(step: Step):
        if step.quantifier in ("?", "*") or step.options:
            return
        bare = copy.copy(step)
        bare.role, bare.quantifier = None, ""
        yield from ready.get(to_text(bare, captures=False), [])
        for c in step.children:
            yield from needed(c)

    return [sorted(set(needed(p.root))) for p in parse(source)]


def with_precomputed(occ: DataFrame, source: str, precomputed: str, bits: str = "bits", **options) -> DataFrame:
    """matches() of source, looked for only in trees whose root has the bits each pattern needs.

    bits: bit i of a root is set where pattern i of `precomputed` matches in the tree; see
    match_bits(), which gives them at ingest.
    """
    out = None
    for index, needs in enumerate(shared_patterns(source, precomputed)):
        trees = skip_by_bits(occ, bits, sum(1 << i for i in needs)) if needs else occ
        found = matches(trees, source, enabled=[index], **options)
        out = found if out is None else out.unionByName(found)
    return out


def match_bits(occ: DataFrame, precomputed: str, name: str = "bits") -> DataFrame:
    """Adds name: for every node, bit i is set where pattern i matches at it or below."""
    from sylvan.operators.metrics import precomputed_bits

    hits = matches(occ, precomputed).groupBy("root", F.col("at").alias("pre")).agg(F.collect_set("pattern").alias("__hits"))
    marked = occ.join(hits, ["root", "pre"], "left")
    n = len(parse(precomputed))
    return precomputed_bits(marked, [F.coalesce(F.array_contains("__hits", i), F.lit(False)) for i in range(n)]).withColumnRenamed("bits", name).drop("__hits")
