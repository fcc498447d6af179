"""Secret scan over an incremental blob ledger.

Texts are content-addressed: every version of a document with the same bytes is one blob.
Only pairs of blob and rule version that the ledger does not hold are scanned; findings are
joined back to all paths that carry the blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import table

#: (kind, pattern, group whose length counts, least length): leftmost non-overlapping matches,
#: of which those with a shorter group are dropped. Fixed values; the first three are the base.
#: access and hex are maximal runs, so the least length stands in the pattern; [xX] pairs are
#: used for letters in either case.
RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{20,}", 0, 1),
    ("url", r"://[^\s:/@]+:[^\s:/@]{3,}@", 0, 1),
]
BASE = ("assign", "access", "hex")
#: Rules whose whole extent is replaced: a key to its END line or, without one, the end of its
#: base64 lines; user and password of any length. Possessive, so work is linear and the stack flat.
WHOLE = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:[\r\n]++[A-Za-z0-9+/]{1,15}+={0,2}(?![^\r\n]))?)",
    "url": r"://[^\s:/@]++:[^\s:/@]{3,}+@",
}
REDACTION = [(kind, WHOLE.get(kind, pattern), group, least) for kind, pattern, group, least in RULES]
SPAN = "array<struct<start:int,kind_no:int,end:int>>"
#: Lengths summed in one fold, and spans of a text beyond which it is cut by its characters.
BLOCK, FEW = 256, 64


def rules_version(rules=None) -> str:
    """Identifies a rule set by its content."""
    return hashlib.sha256(repr(RULES if rules is None else rules).encode()).hexdigest()[:16]


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once; an expression outside a lambda is evaluated for each element within."""
    return F.get(F.transform(F.array(value), body), 0)


def running(lengths: Column) -> Column:
    """Running sums of an array of integers: [l1, l1 + l2, ...].

    Summed in blocks, so that work stays near linear: a fold copies what it has gathered at
    each step, here a block's sums or the blocks' totals.
    """
    fold = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    inside = lambda blocks, offsets: F.transform(blocks, lambda b, i: let(F.get(offsets, i), lambda o: F.transform(F.slice(fold(b), 2, BLOCK), lambda x: x + o)))
    whole = lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)
    split = lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), lambda i: F.slice(xs, i, F.lit(BLOCK)))
    return F.flatten(let(split(lengths), lambda blocks: let(fold(F.transform(blocks, whole)), lambda offsets: inside(blocks, offsets))))


def rule_spans(text: Column, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, kind number, end in code points, end exclusive) of one rule's matches.

    The pieces between the matches come from a split by the same pattern, so start is the
    length of all pieces up to a match and of the matches before it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("p"), matches.alias("m"), groups.alias("g")),
        lambda x: F.struct((F.length(x.p) + F.coalesce(F.length(x.m), F.lit(0))).alias("step"), F.length(x.m).alias("m"), (F.length(x.g) >= least).alias("fits")),
    )
    ended = let(pairs, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda x: x.step)), lambda x, end: F.struct((end - x.m).alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), x.fits.alias("fits"))))
    found = F.transform(F.filter(ended, lambda x: x.fits), lambda x: F.struct(x.start.alias("start"), x.kind_no.alias("kind_no"), x.end.alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(SPAN)


def all_spans(text: Column, rules=None) -> Column:
    """All rules' spans by start, then by the rule's place in the list."""
    rules = RULES if rules is None else rules
    return F.array_sort(F.concat(*(rule_spans(text, i, p, g, n) for i, (_, p, g, n) in enumerate(rules))))


def blob_of(text: Column) -> Column:
    """The content address: SHA-256 of the UTF-8 bytes; null text is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=None) -> DataFrame:
    """New ledger entries (blob, rules_version, spans) for the blobs of docs(text) not in ledger.

    ledger holds entries of earlier scans, of any rule versions. Copies of a text, however
    many, are one blob: they meet in a partial aggregation before the shuffle. An entry
    without spans records that the blob is clean. Null and empty texts are one clean blob; an
    empty table gives no entries. Whole texts are scanned, however long, in time that grows
    with their length; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    version = rules_version(rules)
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rules_version") == version).select("blob"), "blob", "left_anti")
    return blobs.select("blob", F.lit(version).alias("rules_version"), all_spans(F.col("text"), rules).alias("spans"))


def with_findings(docs: DataFrame, entries: DataFrame, rules=None, name: str = "spans") -> DataFrame:
    """Every row of docs with a column of its blob's findings under this rule set, [] where clean.

    Only blobs with findings take part in the join. A column of docs of that name is replaced.
    """
    found = entries.filter((F.col("rules_version") == rules_version(rules)) & (F.size("spans") > 0)).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    joined = docs.drop(name).withColumn("__key", blob_of(F.col("text"))).join(found, F.col("__key") == F.col("__blob"), "left")
    return joined.withColumn(name, F.coalesce("__spans", F.array().cast(SPAN))).drop("__key", "__blob", "__spans")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules=None) -> tuple[DataFrame, DataFrame]:
    """(docs with spans, ledger with the new entries).

    Repeated rows each get the findings. Columns of docs stay, whatever their names, but for
    one named spans, which is replaced.
    """
    entries = scan(docs, ledger, rules)
    if ledger is not None:
        entries = ledger.select("blob", "rules_version", "spans").unionByName(entries)
    return with_findings(docs, entries, rules), entries


def span_text(spans: Column, rules=None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*(F.lit(r[0]) for r in (RULES if rules is None else rules)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind_no), s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every stretch covered by spans replaced by mark; overlapping spans are one.

    A text with more than FEW spans is split into its characters once, as finding a place in
    a text takes a walk from its beginning.
    """
    step = lambda acc, s: F.when(
        s.start >= acc.at, F.struct(F.array_append(acc.gaps, F.struct(acc.at.alias("a"), s.start.alias("b"))).alias("gaps"), s.end.alias("at"))
    ).otherwise(F.struct(acc.gaps.alias("gaps"), F.greatest(acc.at, s.end).alias("at")))
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("gaps"), F.lit(0).alias("at"))
    gaps = F.aggregate(spans, start, step, lambda acc: F.array_append(acc.gaps, F.struct(acc.at.alias("a"), F.lit(2**31 - 1).alias("b"))))
    by_place = F.transform(gaps, lambda g: F.substring(text, g.a + 1, g.b - g.a))
    by_chars = let(F.split(text, ""), lambda chars: F.transform(gaps, lambda g: F.array_join(F.slice(chars, g.a + 1, F.greatest(F.lit(0), F.least(g.b, F.size(chars)) - g.a)), "")))
    return F.array_join(F.when(F.size(spans) > FEW, by_chars).otherwise(by_place), mark)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced and n_chars counted again; same columns and rows."""
    found = with_findings(docs, scan(docs, rules=REDACTION), rules=REDACTION, name="__found")
    dirty = F.size("__found") > 0
    out = found.withColumn("text", F.when(dirty, redacted(F.col("text"), F.col("__found"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dirty, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: counts, digest and spans of the secrets in every document."""
    found, _ = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda i: F.size(F.filter("spans", lambda s: s.kind_no == i)).cast("long")
    base = F.filter("spans", lambda s: s.kind_no < len(BASE))
    return found.select(
        "doc_id",
        *(number(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    parts, sums, spans = [], [], []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(f"regexp_extract_all(t, '{p}', 0) AS m{i}, regexp_extract_all(t, '{p}', {group}) AS g{i}, string_split_regex(t, '{p}') AS p{i}")
        start = f"list_sum(list_transform(p{i}[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:j - 1], lambda x: length(x))), 0)"
        sums.append(f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda j: length(g{i}[j]) >= {least}), lambda j: {{'s': ({start})::BIGINT, 'k': {i}, 'e': (length(m{i}[j]) + {start})::BIGINT}}) AS s{i}")
        spans.append(f"s{i}")
    kinds = "[" + ", ".join(f"'{r[0]}'" for r in RULES) + "]"
    text = f"array_to_string(list_transform({{0}}, lambda x: ({kinds})[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(parts)} FROM d),
s AS (SELECT doc_id, {', '.join(sums)} FROM m),
a AS (SELECT doc_id, s0, s1, s2, list_sort(list_concat({', '.join(spans[:3])})) AS base, list_sort(list_concat({', '.join(spans)})) AS every FROM s)
SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex,
       sha256({text.format('base')}) AS base_sha256, {text.format('every')} AS spans FROM a
"""


SQL = _sql()
