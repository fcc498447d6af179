"""URL filter: base rules first, then a tree of path templates per host.

A url no rule reaches is judged by its template. The tree is generalised level by level from
the root: at each branch variable segments become wildcards and branches with statistically
similar labels merge, and the next level is grouped below the merged branches. A template is
rejected when its smoothed labelled purity says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import ascii_lower, cut, table

#: (host, path, verdict): a rule fits its host and all subdomains below its path.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: A segment with more siblings than this is variable if it has less than MIN_SHARE of their rows.
MAX_CHILDREN, MIN_SHARE = 50, 0.05
#: Branches with this many labels merge into their siblings if |z| stays below Z.
MIN_LABELS, Z = 5, 1.96
#: Weight of the prior in a smoothed purity, and the purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.8
#: Levels of the tree; what lies below the last is one segment.
LEVELS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://(.*)", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; nulls if none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def lexical_template(path: Column) -> Column:
    """Array of path segments with runs of digits and long hex ids generalised."""
    plain = F.regexp_replace(path, r"[0-9a-f]{12,}", "{h}")
    return F.split(F.regexp_replace(plain, r"[0-9]+", "{n}"), "/")


def template_verdicts(urls: DataFrame) -> DataFrame:
    """Judges every (host, template) of urls(host, template, bad).

    bad: 1 for a url labelled as rejected, 0 as accepted, null without a label. Returns
    host, template, general (the template after merging), purity and verdict. All work
    after the first aggregation is on distinct templates, never on urls. The prior of a
    template is the mean of its purities on the hosts that label it, each host counting once.
    """
    leaves = urls.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tail = F.concat(F.slice("template", 1, LEVELS - 1), F.array(F.array_join(F.slice("template", LEVELS, 2**31 - 1), "/")))
    leaves = cut(leaves.withColumns({"steps": F.when(F.size("template") > LEVELS, tail).otherwise(F.col("template")), "general": F.lit(None).cast("string")}))
    deepest = leaves.agg(F.max(F.size("steps"))).first()[0] or 0
    branch = ["host", "general", "segment"]
    for depth in range(deepest):
        ends = leaves.filter(F.size("steps") <= depth)
        here = leaves.filter(F.size("steps") > depth).withColumn("segment", F.get("steps", F.lit(depth)))
        nodes = here.groupBy(*branch).agg(*(F.sum(c).alias(c) for c in ("n", "labels", "bad")))
        parents = nodes.groupBy("host", "general").agg(F.count("*").alias("children"), *(F.sum(c).alias("all_" + c) for c in ("n", "labels", "bad")))
        rate = F.col("all_bad") / F.col("all_labels")
        rest = F.col("all_labels") - F.col("labels")
        spread = F.sqrt(rate * (1 - rate) * (1 / F.col("labels") + 1 / rest))
        apart = F.abs(F.col("bad") / F.col("labels") - (F.col("all_bad") - F.col("bad")) / rest)
        similar = (F.col("labels") >= MIN_LABELS) & (rest >= MIN_LABELS) & (apart <= Z * spread)
        variable = (F.col("children") > MAX_CHILDREN) & (F.col("n") < MIN_SHARE * F.col("all_n"))
        met = [F.col("n.host") == F.col("p.host"), F.col("n.general").eqNullSafe(F.col("p.general"))]
        wild = nodes.alias("n").join(parents.alias("p"), met).filter((F.col("children") > 1) & (F.coalesce(similar, F.lit(False)) | variable)).select("n.host", "n.general", "segment", F.lit("*").alias("star"))
        met = [F.col("h.host") == F.col("w.host"), F.col("h.general").eqNullSafe(F.col("w.general")), F.col("h.segment") == F.col("w.segment")]
        named = F.concat_ws("/", F.col("h.general"), F.coalesce("star", F.col("h.segment")))
        down = here.alias("h").join(wild.alias("w"), met, "left").select("h.host", "h.template", "h.n", "h.labels", "h.bad", "h.steps", named.alias("general"))
        leaves = cut(ends.unionByName(down))
    merged = leaves.groupBy("host", "general").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    everywhere = merged.groupBy("general").agg(F.count_if(F.col("labels") > 0).alias("hosts"), F.coalesce(F.sum(F.when(F.col("labels") > 0, F.col("bad") / F.col("labels"))), F.lit(0.0)).alias("purities"))
    total = merged.agg(F.coalesce(F.sum("labels"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = (F.col("purities") + PRIOR * ((total[1] + 0.5) / (total[0] + 1.0))) / (F.col("hosts") + PRIOR)
    judged = (
        merged.join(everywhere, "general")
        .withColumn("purity", (F.col("bad") + PRIOR * prior) / (F.col("labels") + PRIOR))
        .select("host", "general", "purity", F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("verdict"))
    )
    return leaves.join(judged, ["host", "general"]).select("host", "template", "general", "purity", "verdict")


def filter_urls(pages: DataFrame, rules=None, labels: Column | None = None, url: str = "url") -> DataFrame:
    """Adds host, path, rule, template, purity and verdict to every row of pages.

    labels: an expression, 1 for a known bad url, 0 for a known good one, else null; by
    default the verdict of the fitting rule, so that the tree extends the rules to the
    urls that none reaches. A url without a label in its template gets the prior of that
    template on all hosts that label it, then of all labels; without any label anywhere all
    are allowed. A host that no label reaches is thus judged by what others do with the same
    templates. Null urls and urls without "://" have empty host and path and are judged like
    others; below LEVELS segments a path counts as one segment, however long. Repeated rows
    are judged alike, each returned; columns of pages with the names of added ones are
    replaced. An empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    host, path = url_parts(F.col(url))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.withColumns({"host": host, "path": path}).withColumns({"rule": name, "rule_verdict": verdict})
    bad = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0) if labels is None else labels
    rows = rows.withColumns({"template": lexical_template(F.col("path")), "bad": bad.cast("long")})
    judged = template_verdicts(rows.select("host", "template", "bad")).withColumnRenamed("verdict", "tree_verdict")
    kept = rows.drop("general", "purity", "tree_verdict", "verdict")
    return (
        kept.join(judged, ["host", "template"], "left")
        .withColumn("verdict", F.coalesce("rule_verdict", "tree_verdict"))
        .withColumn("template", F.col("general"))
        .drop("general", "tree_verdict", "rule_verdict", "bad")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every page's url judged."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def _sql() -> str:
    level, done = [], []
    for d in range(LEVELS):
        # An absent prefix is chr(0), so that joins need no null-safe comparison.
        level.append(f"""h{d} AS MATERIALIZED (SELECT *, steps[{d + 1}] AS segment FROM g{d} WHERE len(steps) > {d}
), n{d} AS MATERIALIZED (SELECT host, general, segment, sum(n) AS n, sum(labels) AS labels, sum(bad) AS bad FROM h{d} GROUP BY 1, 2, 3
), p{d} AS MATERIALIZED (SELECT host, general, count(*) AS children, sum(n) AS all_n, sum(labels) AS all_labels, sum(bad) AS all_bad FROM n{d} GROUP BY 1, 2
), w{d} AS MATERIALIZED (SELECT host, general, segment, '*' AS star FROM n{d} JOIN p{d} USING (host, general)
  WHERE children > 1 AND ((children > {MAX_CHILDREN} AND n < {MIN_SHARE} * all_n) OR (labels >= {MIN_LABELS} AND all_labels - labels >= {MIN_LABELS}
    AND abs(bad::DOUBLE / labels - (all_bad - bad)::DOUBLE / (all_labels - labels))
        <= {Z} * sqrt((all_bad::DOUBLE / all_labels) * (1 - all_bad::DOUBLE / all_labels) * (1.0 / labels + 1.0 / (all_labels - labels)))))
), g{d + 1} AS MATERIALIZED (SELECT host, tpl, n, labels, bad, steps, CASE WHEN general = chr(0) THEN '' ELSE general || '/' END || coalesce(star, segment) AS general
  FROM h{d} LEFT JOIN w{d} USING (host, general, segment)
)""")
        done.append(f"SELECT host, tpl, labels, bad, general FROM g{d + 1} WHERE len(steps) = {d + 1}")
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)://(.*)', 1) AS rest FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(h, p, v) AS (VALUES {rules}
), ruled AS MATERIALIZED (
  SELECT hp.*, (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS rule,
         (SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS rule_verdict,
         string_split(regexp_replace(regexp_replace(path, '[0-9a-f]{{12,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g'), '/') AS tpl FROM hp
), g0 AS MATERIALIZED (
  SELECT *, CASE WHEN len(tpl) > {LEVELS} THEN list_append(tpl[1:{LEVELS - 1}], array_to_string(tpl[{LEVELS}:], '/')) ELSE tpl END AS steps, chr(0) AS general
  FROM (SELECT host, tpl, count(*) AS n, count(rule_verdict) AS labels, count(*) FILTER (rule_verdict = 'block') AS bad FROM ruled GROUP BY 1, 2)
), {", ".join(level)}, general AS MATERIALIZED (
  {" UNION ALL ".join(done)}
), branch AS MATERIALIZED (SELECT host, general, sum(labels)::DOUBLE AS labels, sum(bad)::DOUBLE AS bad FROM general GROUP BY 1, 2
), everywhere AS (SELECT general, count(*) FILTER (labels > 0) AS hosts, coalesce(sum(bad / labels) FILTER (labels > 0), 0) AS purities FROM branch GROUP BY 1
), total AS (SELECT sum(labels) AS t_labels, sum(bad) AS t_bad FROM branch
), judged AS (
  SELECT host, general, (bad + {PRIOR} * ((purities + {PRIOR} * ((t_bad + 0.5) / (t_labels + 1.0))) / (hosts + {PRIOR}))) / (labels + {PRIOR}) AS purity
  FROM branch JOIN everywhere USING (general) CROSS JOIN total
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       general AS template, round(purity, 6) AS purity
FROM ruled JOIN general USING (host, tpl) JOIN judged USING (host, general)
"""


SQL = _sql()
