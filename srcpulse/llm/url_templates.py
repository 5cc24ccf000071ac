"""Operator 5: URL filter by rules, and by a tree of path templates where no rule fits.

Rules name a host (its subdomains included) and the start of a path; the longest rule that fits decides. The pages that
rules decide are the labelled ones. All paths of a host make a tree: runs of digits in a segment become `{n}`, and below
each node a branch keeps its name only where labels set it apart. Branches that are rare among many (variable segments)
and branches whose share of blocked labels is like that of their siblings (two-proportion test) merge into one wildcard.
A template is rejected if its share of blocked labels, smoothed by the share of all labels, reaches `purity`.

The tree is as deep as the deepest path: level by level, the paths that go on below a node are its branches, and a path
that ends at a node has that node as its template. One closing slash makes no segment.
All counting is on distinct (host, shape) rows, combined before the shuffle, so a host with a third of all pages is as
cheap as another, and a level looks only at shapes that reach it. A null url, or one without `://`, has an empty host and path and is judged like any other. Repeated
rows are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import written

#: verdict, host, path
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Share of a node's pages below which a branch counts as variable, where the node has more than so many branches.
RARE_SHARE, MANY_BRANCHES = 0.02, 8
#: Standard errors by which a branch's share must differ from its siblings'.
APART = 1.96


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"), F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, PARTS, 2).alias("path"),
    )


def rule_of(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of `rule` and `verdict`; null if none does."""
    found = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shaped(pages: DataFrame) -> DataFrame:
    """Adds `segments`: those of the path, runs of digits as `{n}`, without the empty one after a closing slash."""
    parts = F.split(F.regexp_replace("path", "[0-9]+", "{n}"), "/")
    n = F.size(parts)
    n = n - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return pages.withColumn("segments", F.when(n > 1, F.slice(parts, F.lit(2), n - 1)).otherwise(F.array().cast("array<string>")))


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """`node` of each row one level further down: with the branch's name where labels set it apart from its siblings, else `*`."""
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    rows = rows.withColumn("branch", F.element_at("segments", depth))
    kids = rows.groupBy("host", "node", "branch").agg(*counts)
    all_ = kids.groupBy("host", "node").agg(F.count("*").alias("branches"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
    kids = kids.join(all_, ["host", "node"])
    rest_labelled, rest_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    pooled = (F.col("all_blocked") + 1) / (F.col("all_labelled") + 2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest_labelled))
    differs = F.abs(F.col("blocked") / F.col("labelled") - rest_blocked / rest_labelled) > APART * spread
    variable = (F.col("branches") > MANY_BRANCHES) & (F.col("n") <= RARE_SHARE * F.col("all_n"))
    apart = F.when((F.col("labelled") > 0) & (rest_labelled > 0), differs).otherwise(False) & ~variable
    named = kids.select("host", "node", "branch", F.concat_ws("/", "node", F.when(apart, F.col("branch")).otherwise("*")).alias("below"))
    return rows.join(named, ["host", "node", "branch"]).drop("branch", "node").withColumnRenamed("below", "node")


def templates(labelled: DataFrame, purity: float, weight: float) -> DataFrame:
    """host, segments, template, share, rejected of every shape among rows of (host, segments, blocked), blocked null where unlabelled."""
    shapes = labelled.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.sum(F.coalesce("blocked", F.lit(0))).alias("blocked"))
    shapes = written(shapes.withColumn("node", F.lit("")), "url-shapes")
    total = shapes.agg((F.sum("blocked") / F.sum("labelled")).alias("p"), F.max(F.size("segments")).alias("deepest")).first()
    done, open_ = shapes.where(F.size("segments") == 0), shapes
    for depth in range(1, (total.deepest or 0) + 1):
        open_ = written(_level(open_.where(F.size("segments") >= depth), depth), "url-level").select(*shapes.columns)
        done = done.unionByName(open_.where(F.size("segments") == depth))
    by = ["host", "node"]
    share = (F.sum("blocked") + weight * (total.p or 0.0)) / (F.sum("labelled") + weight)
    judged = done.groupBy(*by).agg(share.alias("share"))
    return done.join(judged, by).select("host", "segments", F.col("node").alias("template"), "share", (F.col("share") >= purity).alias("rejected"))


def judge(
    pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", purity: float = 0.8, weight: float = 10.0,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row."""
    rows = shaped(parsed(pages, id_col, url_col)).withColumn("by_rule", rule_of(rules))
    blocked = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule.verdict") == "block").cast("int"))
    judged = templates(rows.select("host", "segments", blocked.alias("blocked")), purity, weight)
    by_method = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(judged, ["host", "segments"]).select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", by_method).alias("verdict"), "template"
    )


def judge_sql(rules: Sequence[Rule], purity: float = 0.8, weight: float = 10.0, levels: int = 8) -> str:
    """The same as one DuckDB statement over `pages`, for paths of at most `levels` segments."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    named = """
      kids{k} AS (SELECT host, node, segments[{k}] AS branch, sum(n) n, sum(labelled) labelled, sum(blocked) blocked
        FROM rows{before} WHERE len(segments) >= {k} GROUP BY ALL),
      all{k} AS (SELECT host, node, count(*) branches, sum(n) an, sum(labelled) al, sum(blocked) ab FROM kids{k} GROUP BY ALL),
      names{k} AS (SELECT host, node, branch, node || '/' || CASE WHEN labelled > 0 AND al > labelled
          AND abs(blocked / labelled - (ab - blocked) / (al - labelled))
            > {apart} * sqrt(((ab + 1) / (al + 2)) * (1 - (ab + 1) / (al + 2)) * (1 / labelled + 1 / (al - labelled)))
          AND NOT (branches > {many} AND n <= {rare} * an) THEN branch ELSE '*' END AS below
        FROM kids{k} JOIN all{k} USING (host, node)),
      rows{k} AS (SELECT host, segments, n, labelled, blocked, node FROM rows{before} WHERE len(segments) < {k}
        UNION ALL SELECT host, segments, n, labelled, blocked, below FROM rows{before} r JOIN names{k} USING (host, node)
          WHERE len(segments) >= {k} AND branch = segments[{k}]),"""
    tree = "".join(named.format(k=k, before=k - 1, apart=APART, many=MANY_BRANCHES, rare=RARE_SHARE) for k in range(1, levels + 1))
    return rf"""
    WITH rules(verdict, rule_host, rule_path) AS (VALUES {listed}),
      cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      parts AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
      fitting AS (SELECT host, path, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC) AS k
        FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
      ruled AS (SELECT page_id, parts.host, parts.path, rule, verdict FROM parts
        LEFT JOIN fitting f ON f.host = parts.host AND f.path = parts.path AND k = 1),
      rows_ AS (SELECT *, CASE WHEN path IN ('', '/') THEN []::VARCHAR[]
        ELSE string_split(regexp_replace(regexp_replace(path, '/$', ''), '[0-9]+', '{{n}}', 'g'), '/')[2:] END AS segments FROM ruled),
      rows0 AS (SELECT host, segments, count(*)::DOUBLE n, count(verdict)::DOUBLE labelled,
        count(*) FILTER (verdict = 'block')::DOUBLE blocked, '' AS node FROM rows_ GROUP BY ALL),{tree}
      judged AS (SELECT host, node, (sum(blocked) + {weight} * (SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0) FROM rows0))
        / (sum(labelled) + {weight}) AS share FROM rows{levels} GROUP BY ALL),
      all_ AS (SELECT host, segments, node, share FROM rows{levels} JOIN judged USING (host, node))
    SELECT page_id, host, path, rule, coalesce(rows_.verdict, CASE WHEN share >= {purity} THEN 'block' ELSE 'allow' END) AS verdict, node AS template
    FROM rows_ JOIN all_ USING (host, segments)"""
