"""Use-def analysis of Java trees: reference terms, scopes, and a solver over whole projects.

Everything is joins on (tree, name) with intervals as residual conditions; what a round of
the solver learns about the types of expressions lets the next one look up members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators.lineage import cut
from sylvan.operators.metrics import top_down

#: Node types with a meaning here: fixed values.
TYPES = ["class_declaration", "interface_declaration", "enum_declaration", "record_declaration", "annotation_type_declaration"]
CALLABLES = ["method_declaration", "constructor_declaration", "compact_constructor_declaration"]
PRIMITIVES = ["integral_type", "floating_point_type", "boolean_type", "void_type"]
#: Node type -> kind of reference term.
TERMS = {
    "scoped_identifier": "scoped",
    "field_access": "scoped",
    "type_identifier": "type",
    "scoped_type_identifier": "type",
    "method_invocation": "invocation",
    "method_reference": "method_reference",
    "object_creation_expression": "constructor_invocation",
    "explicit_constructor_invocation": "constructor_invocation",
    "array_type": "array",
    "array_access": "array_access",
    "this": "this",
    "super": "super",
    **dict.fromkeys(PRIMITIVES, "primitive"),
}
#: Kinds of declarations a use of each kind can mean.
MEANS = {"type": ["type"], "method": ["method"], "value": ["local", "field", "type"], "member": ["field"]}


def _children(occ: DataFrame, role: str, name: str, field: str) -> DataFrame:
    """(root, pre, name): what the child with a role holds: its `field`."""
    return occ.filter(F.col("role") == role).groupBy("root", F.col("parent").alias("pre")).agg(F.min(field).alias(name))


def terms(occ: DataFrame) -> DataFrame:
    """(root, pre, term, object, leaf, arguments): reference terms; object is the node a term hangs on.

    Terms are those of TERMS, and `name` for identifiers on their own, constructor_reference
    for X::new. arguments counts those of invocations.
    """
    kind = F.create_map(*(F.lit(x) for pair in TERMS.items() for x in pair))
    rows = occ.withColumn("term", F.when(F.col("type") == "identifier", "name").otherwise(F.try_element_at(kind, F.col("type")))).filter("term IS NOT NULL")
    first = occ.filter("pos = 0 AND parent IS NOT NULL").select("root", F.col("parent").alias("pre"), F.col("pre").alias("__first"))
    last = occ.filter("parent IS NOT NULL").groupBy("root", F.col("parent").alias("pre")).agg(F.max_by(F.struct("label", "type"), "pos").alias("__last"))
    for role, name, field in (("object", "__object", "pre"), ("scope", "__scope", "pre"), ("array", "__array", "pre"), ("element", "__element", "pre"), ("type", "__type", "pre"), ("constructor", "__constructor", "pre"), ("name", "__name", "label"), ("field", "__field", "label"), ("arguments", "__list", "pre")):
        rows = rows.join(_children(occ, role, name, field), ["root", "pre"], "left")
    given = occ.filter(~F.col("type").isin("(", ")", ",", "spaces", "line_comment", "block_comment")).groupBy("root", F.col("parent").alias("__list")).agg(F.count("*").alias("arguments"))
    rows = rows.join(first, ["root", "pre"], "left").join(last, ["root", "pre"], "left").join(given, ["root", "__list"], "left")
    hung = F.when(F.col("term") == "method_reference", F.col("__first")).when(F.col("type") == "scoped_type_identifier", F.col("__first"))
    term = F.when((F.col("term") == "method_reference") & (F.col("__last.type") == "new"), "constructor_reference").otherwise(F.col("term"))
    leaf = F.coalesce("__field", "__name", "label", F.when(F.col("term").isin("type", "method_reference"), F.col("__last.label")))
    calls = F.col("term").isin("invocation", "constructor_invocation")
    return rows.select("root", "pre", term.alias("term"), F.coalesce("__object", "__scope", "__array", "__element", F.when(calls, F.coalesce("__type", "__constructor")), hung).alias("object"), F.when(term != "constructor_reference", leaf).alias("leaf"), F.when(calls, F.coalesce("arguments", F.lit(0))).alias("arguments"))


def declarations(occ: DataFrame) -> DataFrame:
    """(root, declared, name, name_pre, kind, begin, end, owner, type_pre): what is declared and where it can be seen.

    kind: type, method, field or local. A name is seen at nodes numbered begin to end - 1:
    members in the body that holds them, locals from their declaration to the end of what
    encloses it. owner: the type declaration a member belongs to. type_pre: its type's node.
    """
    up = occ.select("root", F.col("pre").alias("__p"), F.col("parent").alias("__pp"), F.col("type").alias("__t"), "size")
    rows = occ.filter(F.col("role").isin("name", "parameters") & (F.col("type") == "identifier") | F.col("type").isin("type_identifier", "identifier")).select("root", "pre", "parent", "pos", "type", "label", "role")
    for i, at in ((1, "parent"), (2, "p1_pp"), (3, "p2_pp"), (4, "p3_pp")):
        rows = rows.join(up.select("root", F.col("__p").alias(at), F.col("__pp").alias(f"p{i}_pp"), F.col("__t").alias(f"t{i}"), F.col("size").alias(f"n{i}")), ["root", at], "left")
    named = F.col("role") == "name"
    p, n = (F.col("parent"), F.col("p1_pp"), F.col("p2_pp"), F.col("p3_pp")), [F.col(f"n{i}") for i in (1, 2, 3, 4)]
    t = [F.col(f"t{i}") for i in (1, 2, 3, 4)]
    whole = lambda i, declared, kind: F.struct(declared.alias("declared"), F.lit(kind).alias("kind"), p[i].alias("begin"), (p[i] + n[i]).alias("end"))
    later = lambda i, declared: F.struct(declared.alias("declared"), F.lit("local").alias("kind"), F.col("pre").alias("begin"), (p[i] + n[i]).alias("end"))
    what = (
        F.when(named & t[0].isin(TYPES), whole(1, p[0], "type"))
        .when(named & t[0].isin(CALLABLES), whole(1, p[0], "method"))
        .when(named & (t[0] == "enum_constant"), whole(1, p[0], "field"))
        .when(named & (t[0] == "variable_declarator") & (t[1] == "field_declaration"), whole(2, p[0], "field"))
        .when(named & (t[0] == "variable_declarator") & (t[1] == "local_variable_declaration"), later(2, p[0]))
        .when(named & (t[0] == "variable_declarator") & (t[1] == "spread_parameter"), later(3, p[0]))
        .when(named & (t[0] == "formal_parameter"), later(2, p[0]))
        .when(named & (t[0] == "catch_formal_parameter"), later(1, p[0]))
        .when(named & (t[0] == "resource"), later(2, p[0]))
        .when(named & (t[0] == "enhanced_for_statement"), later(0, F.col("pre")))
        .when((F.col("role") == "parameters") & (t[0] == "lambda_expression"), later(0, F.col("pre")))
        .when(t[0] == "inferred_parameters", later(1, F.col("pre")))
        .when((t[0] == "type_parameter") & (F.col("type") == "type_identifier") & (F.col("pos") == 0), whole(2, p[0], "type"))
    )
    found = rows.withColumn("d", what).filter("d IS NOT NULL").withColumn("holder", F.when(t[1].isin("field_declaration", "local_variable_declaration", "spread_parameter"), p[1]).when(t[0].isin("formal_parameter", "resource", "enhanced_for_statement", "method_declaration"), p[0]))
    kinds = _children(occ, "type", "type_pre", "pre").withColumnRenamed("pre", "holder")
    own = enclosing_types(occ).withColumnRenamed("pre", "parent")
    # A type's own name lies in the type itself; its owner is the one around it.
    around = found.join(own, ["root", "parent"], "left").join(kinds, ["root", "holder"], "left")
    outer = enclosing_types(occ).select("root", F.col("pre").alias("__self"), F.col("outer").alias("__outer"))
    placed = around.join(outer, (around.root == outer.root) & (around.d.declared == outer["__self"]), "left").drop(outer.root)
    return placed.select("root", "d.declared", F.col("label").alias("name"), F.col("pre").alias("name_pre"), "d.kind", "d.begin", "d.end", F.when(F.col("d.kind") == "type", F.col("__outer")).otherwise(F.col("owner")).alias("owner"), "type_pre")


def enclosing_types(occ: DataFrame) -> DataFrame:
    """(root, pre, owner, outer): the nearest type declaration at or above each node, and above it."""
    own = F.when(F.col("type").isin(TYPES), F.col("pre").cast("long"))
    start = F.struct(own.alias("owner"), F.lit(None).cast("long").alias("outer"))
    handed = top_down(occ.select("root", "pre", "parent", "depth", "type"), start, lambda up: F.struct(F.coalesce(own, up.owner).alias("owner"), up.owner.alias("outer")), "__t")
    return cut(handed.select("root", "pre", "__t.owner", "__t.outer"))


def uses(occ: DataFrame, decls: DataFrame) -> DataFrame:
    """(root, pre, name, use, object): identifiers that aren't declared there; object is what they are looked up on.

    use: type, method, value, or member for a field of an object.
    """
    ids = occ.filter(F.col("type").isin("identifier", "type_identifier")).select("root", "pre", "parent", "label", "type", "role")
    above = occ.select("root", F.col("pre").alias("parent"), F.col("type").alias("__above"))
    objects = _children(occ, "object", "object", "pre").withColumnRenamed("pre", "parent")
    rows = ids.join(decls.select("root", F.col("name_pre").alias("pre")), ["root", "pre"], "left_anti").join(above, ["root", "parent"], "left").join(objects, ["root", "parent"], "left")
    skipped = F.col("__above").isin("package_declaration", "scoped_identifier", "import_declaration", "element_value_pair", "labeled_statement", "break_statement", "continue_statement") | (F.col("__above").isin("marker_annotation", "annotation") & (F.col("role") == "name"))
    use = F.when(F.col("type") == "type_identifier", "type").when((F.col("__above") == "method_invocation") & (F.col("role") == "name"), "method").when((F.col("__above") == "field_access") & (F.col("role") == "field"), "member").otherwise("value")
    mine = use.isin("method", "member")
    return rows.filter(~F.coalesce(skipped, F.lit(False))).select("root", "pre", F.col("label").alias("name"), use.alias("use"), F.when(mine, F.col("object")).alias("object"))


def resolve_in_scope(decls: DataFrame, used: DataFrame) -> DataFrame:
    """(root, pre, declared_root, declared): simple names with the innermost declaration they can see in their tree."""
    means = F.create_map(*(x for k, v in MEANS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    d = decls.select("root", "name", "declared", "kind", "begin", "end")
    hit = used.filter("object IS NULL").join(d, ["root", "name"]).filter((F.col("pre") > F.col("begin")) & (F.col("pre") < F.col("end")) & F.array_contains(F.try_element_at(means, F.col("use")), F.col("kind")))
    inner = Window.partitionBy("root", "pre").orderBy(F.desc("begin"), F.desc("declared"))
    return hit.withColumn("__r", F.row_number().over(inner)).filter("__r = 1").select("root", "pre", F.col("root").alias("declared_root"), "declared")


def packages(occ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, package) of each tree, "" where none is declared, and (root, package, name) imported; name null for all."""
    def spelled(kind, name):
        top = occ.filter(F.col("type") == kind).select("root", F.col("pre").alias("__at"), (F.col("pre") + F.col("size")).alias("__end"))
        inside = occ.filter(F.col("type").isin("identifier", "asterisk")).join(top, "root").filter((F.col("pre") > F.col("__at")) & (F.col("pre") < F.col("__end")))
        return inside.groupBy("root", "__at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "label"))), lambda x: x.label).alias(name))

    own = occ.filter("pre = 0").select("root").join(spelled("package_declaration", "parts"), "root", "left").select("root", F.coalesce(F.array_join("parts", "."), F.lit("")).alias("package"))
    last, front = F.element_at("parts", -1), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), ".")
    got = spelled("import_declaration", "parts").select("root", front.alias("package"), F.when(last != "*", last).alias("name"))
    return own, got


def solve(occ: DataFrame, rounds: int = 8) -> DataFrame:
    """(root, pre, name, use, declared_root, declared): uses of all trees with what they refer to.

    First scopes within a tree, then types of the same package or imported. After that each
    round gives expressions the types of what they refer to and looks up members on them, in
    a type and those it extends or implements, until nothing new is found.
    """
    occ = cut(occ.select("root", "pre", "parent", "pos", "size", "depth", "type", "label", "role"))
    decls = cut(declarations(occ))
    used = cut(uses(occ, decls))
    found = resolve_in_scope(decls, used)
    own, imports = packages(occ)
    top = decls.filter("kind = 'type' AND owner IS NULL").join(own, "root").select(F.col("root").alias("declared_root"), "declared", "name", "package")
    open_ = used.filter(F.col("use").isin("type", "value") & F.col("object").isNull()).join(found.select("root", "pre"), ["root", "pre"], "left_anti")
    seen = own.withColumn("rank", F.lit(1)).withColumn("only", F.lit(None).cast("string")).select("root", "package", "only", "rank").unionByName(imports.select("root", "package", F.col("name").alias("only"), F.when(F.col("name").isNull(), 2).otherwise(0).alias("rank")))
    far = open_.join(seen, "root").filter("only IS NULL OR only = name").join(top, ["package", "name"]).filter("root <> declared_root")
    first = Window.partitionBy("root", "pre").orderBy("rank", "package", "declared_root")
    far = far.withColumn("__r", F.row_number().over(first)).filter("__r = 1").select("root", "pre", "declared_root", "declared")
    found = cut(found.unionByName(far))

    # Super types: type nodes in the clauses after a type's name.
    clause = occ.filter(F.col("type").isin("superclass", "super_interfaces", "extends_interfaces")).select("root", F.col("parent").alias("sub"), F.col("pre").alias("__c"), (F.col("pre") + F.col("size")).alias("__e"))
    named = used.filter("use = 'type'").join(found, ["root", "pre"])
    direct = named.join(clause, "root").filter((F.col("pre") > F.col("__c")) & (F.col("pre") < F.col("__e"))).select(F.col("root").alias("sub_root"), "sub", F.col("declared_root").alias("sup_root"), F.col("declared").alias("sup"))
    lifted = cut(decls.filter("kind = 'type'").select(F.col("root").alias("sub_root"), F.col("declared").alias("sub"), F.col("root").alias("sup_root"), F.col("declared").alias("sup"), F.lit(0).alias("far")))
    edge, far_ = lifted, 0
    while True:
        far_ += 1
        step = edge.select("sub_root", "sub", F.col("sup_root").alias("mid_root"), F.col("sup").alias("mid")).join(direct.select(F.col("sub_root").alias("mid_root"), F.col("sub").alias("mid"), "sup_root", "sup"), ["mid_root", "mid"])
        edge = cut(step.select("sub_root", "sub", "sup_root", "sup").distinct().join(lifted.select("sub_root", "sub", "sup_root", "sup"), ["sub_root", "sub", "sup_root", "sup"], "left_anti").withColumn("far", F.lit(far_)))
        if edge.isEmpty():
            break
        lifted = lifted.unionByName(edge)

    members = decls.filter(F.col("kind").isin("method", "field") & F.col("owner").isNotNull()).select(F.col("root").alias("sup_root"), F.col("owner").alias("sup"), "name", "kind", "declared")
    holders = cut(enclosing_types(occ))
    typed_decl = cut(decls.filter("type_pre IS NOT NULL").select(F.col("root").alias("declared_root"), "declared", "type_pre"))
    type_at = occ.select("root", F.col("pre").alias("type_pre"), "size").alias("a")
    # The type a type node names: itself, or the first name inside it (of List<A>, that of List).
    inside = named.alias("u").join(type_at, (F.col("u.root") == F.col("a.root")) & (F.col("u.pre") >= F.col("a.type_pre")) & (F.col("u.pre") < F.col("a.type_pre") + F.col("a.size"))).groupBy(F.col("a.root").alias("root"), F.col("a.type_pre").alias("type_pre")).agg(F.min_by(F.struct("u.declared_root", "u.declared"), "u.pre").alias("__t"))
    names = cut(inside.select("root", "type_pre", F.col("__t.declared_root").alias("of_root"), F.col("__t.declared").alias("of")))
    is_type = decls.filter("kind = 'type'").select(F.col("root").alias("declared_root"), "declared", F.lit(True).alias("__is_type"))
    for _ in range(rounds):
        value = found.join(is_type, ["declared_root", "declared"], "left").join(typed_decl, ["declared_root", "declared"], "left").join(names.select(F.col("root").alias("declared_root"), "type_pre", "of_root", "of"), ["declared_root", "type_pre"], "left")
        of = lambda c, d: F.when(F.col("__is_type"), F.col(d)).otherwise(F.col(c))
        simple = value.select("root", "pre", of("of_root", "declared_root").alias("of_root"), of("of", "declared").alias("of"))
        # An invocation or field access has the type of the member it names.
        outer = simple.join(occ.filter(F.col("role").isin("name", "field")).select("root", "pre", "parent"), ["root", "pre"]).join(occ.filter(F.col("type").isin("method_invocation", "field_access")).select("root", F.col("pre").alias("parent")), ["root", "parent"]).select("root", F.col("parent").alias("pre"), "of_root", "of")
        made = occ.filter((F.col("role") == "type")).join(occ.filter("type = 'object_creation_expression'").select("root", F.col("pre").alias("parent")), ["root", "parent"]).join(names.withColumnRenamed("type_pre", "pre"), ["root", "pre"]).select("root", F.col("parent").alias("pre"), "of_root", "of")
        this = occ.filter("type = 'this'").join(holders, ["root", "pre"]).select("root", "pre", F.col("root").alias("of_root"), F.col("owner").alias("of"))
        above = occ.filter("type = 'super'").join(holders, ["root", "pre"]).join(lifted.filter("far = 1").select(F.col("sub_root").alias("root"), F.col("sub").alias("owner"), F.col("sup_root").alias("of_root"), F.col("sup").alias("of")), ["root", "owner"]).select("root", "pre", "of_root", "of")
        exprs = simple.unionByName(outer).unionByName(made).unionByName(this).unionByName(above).filter("of IS NOT NULL")
        rest = used.filter(F.col("use").isin("method", "member", "value")).join(found.select("root", "pre"), ["root", "pre"], "left_anti")
        on = rest.filter("object IS NOT NULL").join(exprs.select("root", F.col("pre").alias("object"), "of_root", "of"), ["root", "object"])
        bare = rest.filter("object IS NULL").join(holders, ["root", "pre"]).filter("owner IS NOT NULL").select("root", "pre", "name", "use", F.col("root").alias("of_root"), F.col("owner").alias("of"))
        looked = on.select("root", "pre", "name", "use", "of_root", "of").unionByName(bare)
        up = lifted.select(F.col("sub_root").alias("of_root"), F.col("sub").alias("of"), "sup_root", "sup", "far")
        hit = looked.join(up, ["of_root", "of"]).join(members, ["sup_root", "sup", "name"]).filter(F.col("kind") == F.when(F.col("use") == "method", "method").otherwise("field"))
        near = Window.partitionBy("root", "pre").orderBy("far", "sup_root", "declared")
        new = cut(hit.withColumn("__r", F.row_number().over(near)).filter("__r = 1").select("root", "pre", F.col("sup_root").alias("declared_root"), "declared"))
        if new.isEmpty():
            break
        found = cut(found.unionByName(new))
    return used.join(found, ["root", "pre"]).select("root", "pre", "name", "use", "declared_root", "declared")


def merged(*solved: DataFrame) -> DataFrame:
    """Results of several runs as one: a use keeps one declaration, the least."""
    out = solved[0]
    for s in solved[1:]:
        out = out.unionByName(s)
    return out.groupBy("root", "pre", "name", "use").agg(F.min(F.struct("declared_root", "declared")).alias("__d")).select("root", "pre", "name", "use", "__d.declared_root", "__d.declared")


def find(solved: DataFrame, wanted: DataFrame) -> DataFrame:
    """Uses of the declarations wanted(declared_root, declared): who refers to them, anywhere."""
    return solved.join(wanted.select("declared_root", "declared").distinct(), ["declared_root", "declared"], "left_semi")
