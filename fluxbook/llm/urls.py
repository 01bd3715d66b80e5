"""Operator 10: URL filters by a tree of path templates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxbook.llm.staging import lower_ascii, staged


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class TreeSettings:
    """``fan_out``: a node whose children are at least this share of its pages, and at least
    ``least_children``, has a variable segment. ``z``: a branch whose shares (of blocked pages among labelled ones, of pages that
    end in it, of pages that go on with a number) differ from its siblings' by at most so many standard errors is
    like them, if both have ``least_children`` pages. ``strength``: pseudo-labels that a template gets from its parent, and a host from an even
    prior. ``reject``: purity below which a template is blocked."""

    fan_out: float = 0.5
    least_children: int = 4
    z: float = 1.96
    strength: float = 2.0
    reject: float = 0.25


ANY = "*"
#: Shares into which the children of a node, and the pages of a variable segment, are dealt.
SHARES = 16


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[UrlRule], result: str) -> Column:
    """Attribute ``result`` of the longest rule that fits ``host`` and ``path``, else NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        host = (F.col("host") == rule.host) | F.endswith("host", F.lit(f".{rule.host}"))
        out = F.when(host & F.startswith("path", F.lit(rule.path)), F.lit(getattr(rule, result))).otherwise(out)
    return out


def _masked(segment: Column) -> Column:
    return F.when(segment.rlike("[0-9]"), F.lit(ANY)).otherwise(segment)


def path_templates(paths: DataFrame, settings: TreeSettings) -> DataFrame:
    """``host``, ``path``, the ``template`` of each path and the template's ``purity``; from counts ``n``, ``blocked``, ``allowed`` by path.

    Level by level, a segment is replaced by the name of its branch. A segment with a digit, and
    every child of a node with as many children as pages, is variable. Of the other children,
    those that are like their siblings are merged into the same wildcard: in how many of their pages
    end there or go on with a number and, where labels can be compared, in how many are blocked. The
    rest keep branches of their own. Each branch's purity, its share of allowed pages among labelled ones, is drawn
    to its parent's. A path that is alone in its node goes no further: its other segments stand as they are. The
    levels end with the last node that two paths share.
    """
    a, b, s = F.col("allowed"), F.col("blocked"), settings.strength
    even = paths.groupBy("host").agg(((F.sum(a) + s / 2) / (F.sum(a) + F.sum(b) + s)).alias("purity"))
    rest = F.filter(F.split("path", "/"), lambda x: x != "")
    tree = staged(paths.join(even, "host").withColumns({"rest": rest, "template": F.lit("")}), "urls-paths")
    while not tree.filter(F.size("rest") > 0).isEmpty():
        raw, after = F.get("rest", F.lit(0)), F.get("rest", F.lit(1))
        segment = _masked(raw)
        children = tree.filter(F.size("rest") > 0).groupBy("host", "template", segment.alias("segment")).agg(
            *[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")], F.count_distinct(raw).alias("kinds"), F.count("*").alias("paths"),
            F.coalesce(F.sum(F.when(F.size("rest") == 1, F.col("n"))), F.lit(0)).alias("ended"),
            F.coalesce(F.sum(F.when(after.rlike("[0-9]"), F.col("n"))), F.lit(0)).alias("numbered"), F.max("purity").alias("above"),
        )
        parents = children.groupBy("host", "template").agg(
            F.sum("n").alias("pages"), F.sum("kinds").alias("fan"), F.sum("paths").alias("all_paths"), F.sum("blocked").alias("all_blocked"),
            F.sum(a + b).alias("all_labelled"), F.sum("ended").alias("all_ended"), F.sum("numbered").alias("all_numbered"),
        ).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))

        def like(own: Column, size: Column, all_own: Column, all_size: Column) -> Column:
            """Two shares differ by chance only: a branch's and that of its siblings. NULL where there is nothing to hold it against."""
            others = all_size - size
            p = all_own / F.nullif(all_size, F.lit(0))
            error = F.sqrt(p * (1 - p) * (1 / F.nullif(size, F.lit(0)) + 1 / F.nullif(others, F.lit(0))))
            return F.abs(own / F.nullif(size, F.lit(0)) - (all_own - own) / F.nullif(others, F.lit(0))) <= settings.z * error

        n, pages = F.col("n"), F.col("pages")
        same_labels = F.coalesce(like(b, a + b, F.col("all_blocked"), F.col("all_labelled")), F.lit(True))
        same_shape = like(F.col("ended"), n, F.col("all_ended"), pages) & like(F.col("numbered"), n, F.col("all_numbered"), pages)
        enough = (n >= settings.least_children) & (pages - n >= settings.least_children)
        alike = enough & same_labels & same_shape
        variable = (F.col("fan") >= settings.least_children) & (F.col("fan") >= settings.fan_out * F.col("pages"))
        branch = F.when(F.col("all_paths") == 1, F.lit(None)).when((F.col("segment") == ANY) | variable | alike, F.lit(ANY)).otherwise(F.col("segment"))
        dealt = children.withColumn("share", F.pmod(F.xxhash64("segment"), F.lit(SHARES)).cast("int"))
        named = staged(
            dealt.join(parents, ["host", "template", "share"])
            .select("host", "template", "segment", branch.alias("branch"), "allowed", "blocked", "above"),
            "urls-branches",
        )
        purity = ((F.sum(a) + s * F.max("above")) / (F.sum(a) + F.sum(b) + s)).alias("own")
        pure = named.filter("branch is not null").groupBy("host", "template", "branch").agg(purity)
        # of a variable segment, which may hold most pages of a host, each share of the pages finds its own row
        shares = F.when(F.col("segment") == ANY, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
        names = named.select("host", "template", "segment", "branch").join(pure, ["host", "template", "branch"], "left").withColumn("share", F.explode(shares))
        share = F.when(F.col("segment") == ANY, F.pmod(F.xxhash64("path"), F.lit(SHARES))).otherwise(0).cast("int")
        moved = tree.withColumn("segment", segment).withColumn("share", share).join(names, ["host", "template", "segment", "share"], "left")
        goes_on, alone = F.col("branch").isNotNull(), F.col("branch").isNull() & (F.size("rest") > 0)
        tail = F.concat(F.lit("/"), F.array_join(F.transform("rest", _masked), "/"))
        tree = staged(
            moved.select(
                "host", "path", "n", "blocked", "allowed", F.when(goes_on, F.col("own")).otherwise(F.col("purity")).alias("purity"),
                F.when(goes_on, F.expr("slice(rest, 2, size(rest))")).otherwise(F.array().cast("array<string>")).alias("rest"),
                F.when(goes_on, F.concat("template", F.lit("/"), "branch")).when(alone, F.concat("template", tail)).otherwise(F.col("template")).alias("template"),
            ),
            "urls-level",
        )
    return tree.select("host", "path", "template", "purity")


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[UrlRule] = RULES, settings: TreeSettings = TreeSettings(),
) -> DataFrame:
    """The id, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` of every page.

    A page with a rule gets the rule's verdict, and these verdicts are the labels of the tree. A
    page without one is blocked where the purity of its template is below ``reject``, else allowed; so a
    template without labels follows its nearest labelled ancestors, and a host without any allows. NULL
    urls and urls without ``://`` have an empty host and path and fall under no rule. Repeated rows
    are judged each; an empty table gives no rows; other columns are left aside.
    """
    slim = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumns(
        {"rule": longest_rule(rules, "name"), "given": longest_rule(rules, "verdict")}
    )
    slim = staged(slim, "urls-pages")
    paths = slim.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("given") == "block").alias("blocked"), F.count_if(F.col("given") == "allow").alias("allowed")
    )
    learned = F.when(F.col("purity") < settings.reject, F.lit("block")).otherwise(F.lit("allow"))
    return slim.join(path_templates(paths, settings), ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), "template", "purity"
    )


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{folder}/pages.parquet"))


def _rule_sql(result: str) -> str:
    lines = []
    for r in sorted(RULES, key=lambda r: -len(r.name)):
        lines.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, result)}'")
    return "CASE " + " ".join(lines) + " END"


def _level_sql(level: int, s: TreeSettings) -> str:
    def like(own: str, size: str, all_own: str, all_size: str) -> str:
        p, others = f"({all_own}::DOUBLE / nullif({all_size}, 0))", f"nullif({all_size} - {size}, 0)"
        error = f"sqrt({p} * (1 - {p}) * (1 / nullif({size}, 0)::DOUBLE + 1 / {others}::DOUBLE))"
        return f"abs({own}::DOUBLE / nullif({size}, 0) - ({all_own} - {own})::DOUBLE / {others}) <= {s.z} * {error}"

    return f""", named{level} AS (
  SELECT *, CASE WHEN len(rest) = 0 THEN NULL WHEN regexp_matches(rest[1], '[0-9]') THEN '*' ELSE rest[1] END AS segment FROM tree{level - 1}
), children{level} AS (
  SELECT host, template, segment, sum(n) AS n, sum(blocked) AS blocked, sum(allowed) AS allowed, count(DISTINCT rest[1]) AS kinds, count(*) AS paths,
    coalesce(sum(n) FILTER (len(rest) = 1), 0) AS ended, coalesce(sum(n) FILTER (regexp_matches(rest[2], '[0-9]')), 0) AS numbered, max(purity) AS above
  FROM named{level} WHERE segment IS NOT NULL GROUP BY ALL
), parents{level} AS (
  SELECT host, template, sum(n) AS pages, sum(kinds) AS fan, sum(paths) AS all_paths, sum(blocked) AS all_blocked,
    sum(blocked + allowed) AS all_labelled, sum(ended) AS all_ended, sum(numbered) AS all_numbered
  FROM children{level} GROUP BY ALL
), branches{level} AS (
  SELECT host, template, segment, allowed, blocked, above, CASE WHEN all_paths = 1 THEN NULL
    WHEN segment = '*' OR (fan >= {s.least_children} AND fan >= {s.fan_out} * pages) THEN '*'
    WHEN n >= {s.least_children} AND pages - n >= {s.least_children} AND coalesce({like("blocked", "(blocked + allowed)", "all_blocked", "all_labelled")}, TRUE)
      AND {like("ended", "n", "all_ended", "pages")} AND {like("numbered", "n", "all_numbered", "pages")} THEN '*'
    ELSE segment END AS branch
  FROM children{level} JOIN parents{level} USING (host, template)
), pure{level} AS (
  SELECT host, template, branch, (sum(allowed) + {s.strength} * max(above))::DOUBLE / (sum(allowed) + sum(blocked) + {s.strength})::DOUBLE AS own
  FROM branches{level} WHERE branch IS NOT NULL GROUP BY ALL
), tree{level} AS (
  SELECT n.host, n.path, n.n, n.blocked, n.allowed, coalesce(p.own, n.purity) AS purity,
    CASE WHEN b.branch IS NOT NULL THEN n.rest[2:] ELSE [] END AS rest,
    CASE WHEN b.branch IS NOT NULL THEN n.template || '/' || b.branch
      WHEN len(n.rest) > 0 THEN n.template || '/' || array_to_string(list_transform(n.rest, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END), '/')
      ELSE n.template END AS template
  FROM named{level} n LEFT JOIN branches{level} b ON n.host = b.host AND n.template = b.template AND n.segment = b.segment
  LEFT JOIN pure{level} p ON p.host = b.host AND p.template = b.template AND p.branch = b.branch
)"""


_S = TreeSettings()
#: Levels that the SQL spells out; the operator goes on as long as two paths share a node.
SQL_LEVELS = 8
OP10_SQL = f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, {_rule_sql("name")} AS rule, {_rule_sql("verdict")} AS given FROM parsed
), paths AS (
  SELECT host, path, count(*) AS n, count(*) FILTER (given = 'block') AS blocked, count(*) FILTER (given = 'allow') AS allowed FROM ruled GROUP BY host, path
), tree0 AS (
  SELECT host, path, n, blocked, allowed,
    ((sum(allowed) OVER h) + {_S.strength / 2})::DOUBLE / ((sum(allowed) OVER h) + (sum(blocked) OVER h) + {_S.strength})::DOUBLE AS purity,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS rest, '' AS template
  FROM paths WINDOW h AS (PARTITION BY host)
){"".join(_level_sql(i + 1, _S) for i in range(SQL_LEVELS))}
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN purity < {_S.reject} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM ruled JOIN tree{SQL_LEVELS} USING (host, path)
"""
