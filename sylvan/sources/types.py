"""The types dimension: what a node type is, derived from its name by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (class, pattern of type names), first match wins: fixed values.
SHARED = [
    ("comment", r"^(line_|block_)?comment$"),
    ("identifier", r"(^|_)identifier$"),
    ("type_declaration", r"^(class|interface|enum|record|annotation_type|struct|union|type)_(declaration|specifier)$"),
    ("branch", r"^(if|for|enhanced_for|while|do|switch|try)_statement$|^switch_(label|block)$|^catch_clause$|^ternary_expression$"),
]
#: Abstract types, of which a type can have several: fixed values.
ABSTRACT = [
    ("expression", r"_expression$|^(method|call)_invocation$|_access$"),
    ("statement", r"_statement$|^block$|^local_variable_declaration$"),
    ("executable", r"^(method|constructor|function)_(declaration|definition)$|^lambda_expression$"),
    ("declaration", r"_declaration$|_definition$|_declarator$|_specifier$"),
    ("literal", r"_literal$|^(true|false|null)$|^(string|number)$"),
]


def shared_class(kind: Column) -> Column:
    """comment, identifier, type_declaration, branch or other."""
    out = F.lit("other")
    for name, pattern in reversed(SHARED):
        out = F.when(kind.rlike(pattern), name).otherwise(out)
    return out


def abstract_types(kind: Column) -> Column:
    """The abstract types of a type, in the order of ABSTRACT."""
    return F.filter(F.array(*(F.when(kind.rlike(p), F.lit(n)) for n, p in ABSTRACT)), lambda x: x.isNotNull())


def dimension(occ: DataFrame) -> DataFrame:
    """(type, shared, supertypes, is_named, is_spaces, is_file, is_directory): a row for each type in occ."""
    kind = F.col("type")
    return occ.select("type").distinct().select(
        "type",
        shared_class(kind).alias("shared"),
        abstract_types(kind).alias("supertypes"),
        (kind.rlike("^[A-Za-z_]") & (kind != "spaces")).alias("is_named"),
        (kind == "spaces").alias("is_spaces"),
        kind.isin("program", "translation_unit", "document", "source_file", "makefile").alias("is_file"),
        kind.isin("directory", "folder").alias("is_directory"),
    )


def typed(occ: DataFrame) -> DataFrame:
    """occ with shared and supertypes, so that patterns can say (expression/binary_expression) or (statement/_).

    The rules are expressions on the type's name, so there is no join with the dimension.
    """
    return occ.withColumns({"shared": shared_class(F.col("type")), "supertypes": abstract_types(F.col("type"))})


def declarations(occ: DataFrame) -> DataFrame:
    """Rows of occ that declare something."""
    return occ.filter(F.array_contains(abstract_types(F.col("type")), "declaration"))


def of_grammar(spark, text: str, lang: str) -> DataFrame:
    """(lang, type, is_named, is_hidden, supertypes, fields) from a grammar's node types as JSON.

    The JSON is a list of {type, named, subtypes?, fields?}. A type with subtypes is one of
    their supertypes; types that begin with _ are hidden.
    """
    import json

    nodes = json.loads(text)
    above: dict[str, list[str]] = {}
    for n in nodes:
        for sub in n.get("subtypes", ()):
            above.setdefault(sub["type"], []).append(n["type"])
    rows = [(lang, n["type"], bool(n["named"]), n["type"].startswith("_"), sorted(above.get(n["type"], [])), sorted(n.get("fields", {}))) for n in nodes]
    return spark.createDataFrame(rows, "lang string, type string, is_named boolean, is_hidden boolean, supertypes array<string>, fields array<string>")


def predicate(name: str) -> Column:
    """What scripts ask of a node by name, as a condition on the columns of occ."""
    kind = F.col("type")
    conditions = {
        "is_branch": lambda: shared_class(kind) == "branch",
        "is_comment": lambda: shared_class(kind) == "comment",
        "is_type_decl": lambda: shared_class(kind) == "type_declaration",
        "is_spaces": lambda: kind == "spaces",
        "is_nl": lambda: (kind == "spaces") & F.coalesce(F.col("label").contains("\n"), F.lit(False)),
        "is_file": lambda: kind.isin("program", "translation_unit", "document", "source_file", "makefile"),
        "is_directory": lambda: kind.isin("directory", "folder", "module"),
        "is_java_file": lambda: kind == "program",
    }
    if name not in conditions:
        raise ValueError(f"unknown predicate {name}")
    return conditions[name]()
