"""Scalar functions on columns and strings."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F


def qgrams(text: Column, q: int = 3) -> Column:
    """All substrings of length q, with repeats; the text itself if it is shorter."""
    return F.when(F.length(text) <= q, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q)))


def qgram_similarity(a: Column, b: Column, q: int = 3) -> Column:
    """Share of common distinct q-grams (Dice); 1 for equal texts."""
    x, y = F.array_distinct(qgrams(a, q)), F.array_distinct(qgrams(b, q))
    return F.when(a == b, 1.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def qgrams_of(text: str, q: int = 3) -> list[str]:
    """Substrings of length q of a string with padded ends."""
    pad = "#" * (q - 1)
    text = pad + text + pad
    return [text[i : i + q] for i in range(len(text) - q + 1)]


def qgram_distance(a: str, b: str, q: int = 3) -> float:
    """Normalised multiset q-gram distance of two strings with padded ends: 0 equal, 1 disjoint."""
    if a == b:
        return 0.0
    x, y = Counter(qgrams_of(a, q)), Counter(qgrams_of(b, q))
    return sum(abs(x[g] - y[g]) for g in x.keys() | y.keys()) / (sum(x.values()) + sum(y.values()))


def lcs(a: list, b: list, same=None) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; earliest in a on ties."""
    same = same or (lambda x, y: x == y)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if same(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def common_run(a: str, b: str) -> str:
    """The longest piece that two strings share; the first in a of equals."""
    best, end, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                if new[j + 1] > best:
                    best, end = new[j + 1], i + 1
        row = new
    return a[end - best : end]


def hunks(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of index pairs that go on in step, as (first a, past a, first b, past b)."""
    out: list[list[int]] = []
    for i, j in pairs:
        if out and (out[-1][1], out[-1][3]) == (i, j):
            out[-1][1], out[-1][3] = i + 1, j + 1
        else:
            out.append([i, i + 1, j, j + 1])
    return [tuple(h) for h in out]


def text_similarity(a: Column, b: Column, q: int = 3) -> Column:
    """1 less the normalised multiset q-gram distance of two texts with padded ends; null if either is."""
    pad = F.lit("#" * (q - 1))
    x, y = (qgrams(F.concat(pad, t, pad), q) for t in (a, b))
    both = F.array_distinct(F.concat(x, y))
    apart = F.aggregate(both, F.lit(0), lambda acc, g: acc + F.abs(F.size(F.filter(x, lambda e: e == g)) - F.size(F.filter(y, lambda e: e == g))))
    return F.when(a == b, 1.0).otherwise(1 - apart / (F.size(x) + F.size(y)))


def summarize_border(text: Column, width: int) -> Column:
    """text with both ends cut to at most width characters in all, the middle kept."""
    start = F.floor((F.length(text) - (width - 2)) / 2)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("…"), F.substr(text, (start + 1).cast("int"), F.lit(width - 2)), F.lit("…")))


def pearson_table(seed: int = 0) -> list[int]:
    """A permutation of 0..255 for pearson(), by a fixed linear congruence from a seed."""
    table, x = list(range(256)), seed
    for i in range(255, 0, -1):
        x = (x * 1103515245 + 12345) % 2**31
        j = x % (i + 1)
        table[i], table[j] = table[j], table[i]
    return table


def pearson(text: Column, seed: int = 0) -> Column:
    """The 8-bit Pearson hash of a text's characters below 256, others by their lowest byte."""
    table = F.array(*map(F.lit, pearson_table(seed)))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda h, c: F.get(table, h.bitwiseXOR(F.ascii(c).bitwiseAND(F.lit(255)))))


def hash16(text: Column, modulus: int = 2**16) -> Column:
    """A 16-bit hash of a text, below modulus."""
    return F.pmod(F.xxhash64(text), F.lit(modulus)).cast("int")


def identifier_format(name: Column) -> Column:
    """The case style of an identifier."""
    return (
        F.when(name.rlike("^[a-z][a-z0-9]*$"), "flat")
        .when(name.rlike("^[A-Z][A-Z0-9]*$"), "upper_flat")
        .when(name.rlike("^[a-z][a-zA-Z0-9]*$"), "camel")
        .when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "pascal")
        .when(name.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike("^[A-Z0-9]+(_[A-Z0-9]+)+$"), "screaming_snake")
        .when(name.rlike("^[A-Z][a-z0-9]*(_[A-Z][a-z0-9]*)+$"), "pascal_snake")
        .when(name.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab")
        .otherwise("other")
    )


def summarize_center(text: Column, width: int) -> Column:
    """text cut in the middle to at most width characters."""
    left, right = (width - 1 + 1) // 2, (width - 1) // 2
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, left), F.lit("…"), F.right(text, F.lit(right))))


def without_comments(query: Column) -> Column:
    """A query text without its ; comments."""
    return F.regexp_replace(query, r";[^\n]*", "")


def diff_url(base: str, user: Column, name: Column, before: Column, after: Column, file: Column, first: Column) -> Column:
    """A forge's address of a line in the difference of two commits."""
    return F.format_string(base + "/%s/%s/compare/%s..%s#diff-%sR%d", user, name, before, after, F.sha2(file, 256), first)


def code_url(base: str, user: Column, name: Column, commit: Column, file: Column, first: Column, last: Column) -> Column:
    """A forge's address of a line range."""
    return F.format_string(base + "/%s/%s/blob/%s/%s#L%d-L%d", user, name, commit, file, first, last)


def commit_time(seconds: Column, tz_minutes: Column) -> Column:
    """Local time of a commit from epoch seconds and an offset in minutes."""
    return F.timestamp_seconds(seconds) + F.make_dt_interval(mins=tz_minutes)


def common_prefix(a: Column, b: Column) -> Column:
    """The common beginning of two paths."""
    n = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s.n + F.when(s.on & x.a.eqNullSafe(x.b) & x.a.isNotNull(), 1).otherwise(0)).alias("n"), (s.on & x.a.eqNullSafe(x.b)).alias("on")), lambda s: s.n)
    return F.slice(a, F.lit(1), n)
