"""Quality rules: plain counts, then divergence from language references.

A document's histograms of character classes and of common words are compared with those
of its language by the Jensen-Shannon distance. References are sums over the whole corpus:
every language that the table names has one, and its common words are its most frequent ones.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.llm.common import cut, table

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Character classes by UTF-8 byte: lower, upper, digit, blank, sentence mark, other ASCII, start of a longer character.
CLASSES = 7
_CLASS = np.full(256, CLASSES, dtype=np.int64)
_CLASS[:128] = 5
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[list(SPACE)], _CLASS[list(b".,;:!?'\"()-")], _CLASS[0xC0:] = 3, 4, 6
CLASS_OF_BYTE = np.eye(CLASSES + 1, dtype=np.int64)[_CLASS][:, :CLASSES]


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the distances (0 to 1, base-2 Jensen-Shannon).

    A language's reference has its common_words most frequent words; the `languages` with
    most words have one, if they have reference_words at least.
    """

    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    guard_chars: int = 200
    class_distance: float = 0.3
    guard_words: int = 50
    word_distance: float = 0.5
    common_words: int = 64
    languages: int = 100
    reference_words: int = 1000


def class_counts(data: bytes) -> np.ndarray:
    """How many characters of each class."""
    return np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ CLASS_OF_BYTE


def word_counts(counts: Counter, n_words: int, common: list[bytes]) -> np.ndarray:
    """Counts of a language's common words, then of all other words."""
    own = np.array([counts.get(w, 0) for w in common], dtype=np.int64)
    return np.append(own, n_words - own.sum())


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: 0 alike, 1 disjoint; 1 if one is empty."""
    if not a.sum() or not b.sum():
        return 1.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    part = lambda x: (x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in windows of so many words found twice or more, the first included."""
    if len(words) < window + 1:
        return 0
    keys = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(keys)
    if len(counts) == len(keys):
        return 0
    end = total = 0
    for i, key in enumerate(keys):
        if counts[key] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    blank = SPACE.decode()
    lines = [x for x in text.split("\n") if x.strip(blank)]
    return len(lines) - len(set(lines))


def _language_sums(batches):
    import pyarrow as pa

    for batch in batches:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if lang is not None and text:
                data = text.encode()
                classes[lang] = classes.get(lang, 0) + class_counts(data)
                words.setdefault(lang, Counter()).update(data.lower().split())
        rows = [(lang, "class", b"%d" % i, int(v)) for lang, counts in classes.items() for i, v in enumerate(counts)]
        rows += [(lang, "word", w, n) for lang, counts in words.items() for w, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64()))], ["lang", "kind", "key", "n"])


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, dict]:
    """Language -> its common words and histograms summed over all its documents.

    At most common_words and CLASSES rows for each of at most `languages` languages come to
    the driver; words are counted and ranked by the executors.
    """
    sums = cut(docs.select("text", "lang").mapInArrow(_language_sums, "lang string, kind string, key binary, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    totals = sums.filter("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= rules.reference_words)
    total = {r.lang: r.total for r in totals.orderBy(F.desc("total"), "lang").limit(rules.languages).collect()}
    mine = sums.filter(F.col("lang").isin(list(total)))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = mine.filter("kind = 'word'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rules.common_words).orderBy("lang", "place").collect()
    out = {lang: {"class": np.zeros(CLASSES, np.int64), "words": [], "counts": []} for lang in total}
    for r in mine.filter("kind = 'class'").collect():
        out[r.lang]["class"][int(r.key)] = r.n
    for r in top:
        out[r.lang]["words"].append(bytes(r.key))
        out[r.lang]["counts"].append(r.n)
    for lang, ref in out.items():
        ref["word"] = np.array([*ref["counts"], total[lang] - sum(ref["counts"])], dtype=np.int64)
    return out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def judge(text: str | None, lang: str | None, refs: dict, rules: Rules) -> tuple:
    """The values of FIELDS for one document."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    blanks = sum(data.count(b) for b in SPACE)
    symbols = sum(data.count(s.encode()) for s in SYMBOLS)
    repeats = repeated_words(words, rules.window)
    failed = n < rules.least_words or 100 * repeats > rules.repeat_percent * n
    by_class = by_word = None
    near = [lang] if lang in refs else sorted(refs)
    if near and len(text) >= rules.guard_chars:
        own = class_counts(data)
        by_class = min(distance(own, refs[x]["class"]) for x in near)
    if near and n >= rules.guard_words:
        counts = Counter(data.lower().split())
        by_word = min(distance(word_counts(counts, n, refs[x]["words"]), refs[x]["word"]) for x in near)
    far = (by_class is not None and by_class > rules.class_distance) or (by_word is not None and by_word > rules.word_distance)
    return n, len(text) - blanks, symbols, repeated_lines(text), repeats, by_class, by_word, failed, not (failed or far)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), refs: dict | None = None) -> DataFrame:
    """Per row of docs(doc_id, text, lang): doc_id and FIELDS.

    A document of a language without a reference (a null one, or one with too few words) is
    held against the nearest reference. Texts under the guards' lengths, and all texts of a corpus without
    any reference, have null distances and are judged by the base rules alone. Null text is
    empty: no words, base_failed. Whole texts are judged, however long; repeated rows alike,
    each returned; other columns are ignored. An empty table gives no rows.
    """
    import pyarrow as pa

    refs = references(docs, rules) if refs is None else refs
    kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [judge(t, x, refs, rules) for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *names])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return plain.mapInArrow(run, "doc_id long, " + FIELDS)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: base counts, distances and verdict of every document."""
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _sql() -> str:
    r = Rules()
    word = r"[^\x20\x09-\x0D]"
    js = "sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
    # of[kind]: counts of each document by class or common word, as (doc_id, lang of the histogram, i, n)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM documents),
g AS (SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (
      SELECT doc_id, unnest(range(1, len(w) - {r.window - 2})) AS i, unnest(list_transform(range(1, len(w) - {r.window - 2}), lambda i: array_to_string(w[i:i + {r.window - 1}], ' '))) AS k FROM d WHERE len(w) > {r.window})),
rep AS (SELECT doc_id, sum(least({r.window}, i - prev))::BIGINT AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {r.window}) AS prev FROM g WHERE c > 1) GROUP BY 1),
b AS (SELECT d.doc_id, lang, t, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (doc_id)),
c0 AS (SELECT doc_id, [len(regexp_extract_all(t, '[a-z]')), len(regexp_extract_all(t, '[A-Z]')), len(regexp_extract_all(t, '[0-9]')), len(regexp_extract_all(t, '[ \\t\\n\\x0b\\x0c\\r]')),
      len(regexp_extract_all(t, '[.,;:!?''"()-]'))] AS c, length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) AS wide, length(t) AS n FROM d),
c1 AS (SELECT doc_id, list_concat(c, [n - wide - list_sum(c), wide]) AS c FROM c0),
cls AS (SELECT doc_id, unnest(range(7)) AS i, unnest(c)::DOUBLE AS n FROM c1),
tok AS MATERIALIZED (SELECT doc_id, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d),
cnt AS MATERIALIZED (SELECT doc_id, k, count(*) AS n FROM tok GROUP BY 1, 2),
refs AS MATERIALIZED (SELECT lang FROM tok WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) >= {r.reference_words} ORDER BY count(*) DESC, lang LIMIT {r.languages}),
voc AS MATERIALIZED (SELECT lang, k FROM (SELECT lang, k, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, k) AS place FROM tok JOIN refs USING (lang) GROUP BY 1, 2) WHERE place <= {r.common_words}),
near AS (SELECT doc_id, r.lang FROM b JOIN refs r ON r.lang = b.lang OR b.lang IS NULL OR b.lang NOT IN (SELECT lang FROM refs)),
own AS (SELECT near.doc_id, near.lang, voc.k, coalesce(cnt.n, 0)::DOUBLE AS n FROM near JOIN voc USING (lang) LEFT JOIN cnt ON cnt.doc_id = near.doc_id AND cnt.k = voc.k),
wrd AS (SELECT * FROM own UNION ALL SELECT o.doc_id, o.lang, chr(0), b.n_words - o.n FROM (SELECT doc_id, lang, sum(n) AS n FROM own GROUP BY 1, 2) o JOIN b USING (doc_id)),
cref AS (SELECT b.lang, i, sum(n) AS n FROM cls JOIN b USING (doc_id) JOIN refs USING (lang) GROUP BY 1, 2),
wref AS (SELECT wrd.lang, k, sum(n) AS n FROM wrd JOIN b ON b.doc_id = wrd.doc_id AND b.lang = wrd.lang GROUP BY 1, 2),
cdist AS (SELECT doc_id, min(v) AS v FROM (SELECT doc_id, lang, {js} AS v FROM (
      SELECT near.doc_id, near.lang, cls.n / sum(cls.n) OVER x AS p, cref.n / sum(cref.n) OVER x AS q FROM near JOIN cls USING (doc_id) JOIN cref ON cref.lang = near.lang AND cref.i = cls.i JOIN b ON b.doc_id = near.doc_id WHERE length(b.t) >= {r.guard_chars}
      WINDOW x AS (PARTITION BY near.doc_id, near.lang)) GROUP BY 1, 2) GROUP BY 1),
wdist AS (SELECT doc_id, min(v) AS v FROM (SELECT doc_id, lang, {js} AS v FROM (
      SELECT wrd.doc_id, wrd.lang, wrd.n / sum(wrd.n) OVER x AS p, wref.n / sum(wref.n) OVER x AS q FROM wrd JOIN wref USING (lang, k) JOIN b ON b.doc_id = wrd.doc_id WHERE n_words >= {r.guard_words}
      WINDOW x AS (PARTITION BY wrd.doc_id, wrd.lang)) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT b.*, n_words < {r.least_words} OR 100 * n_repeat_words > {r.repeat_percent} * n_words AS base_failed, cdist.v AS cd, wdist.v AS wd FROM b LEFT JOIN cdist USING (doc_id) LEFT JOIN wdist USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, base_failed,
       NOT (base_failed OR coalesce(cd > {r.class_distance}, false) OR coalesce(wd > {r.word_distance}, false)) AS kept FROM j
"""


SQL = _sql()
