"""URL filters: fixed rules first, then a path-template tree learned from labelled urls.

Per host, runs of digits become ``#``, and the paths' segments make a tree. It is generalised from the
root down, level by level: where a branch, itself already generalised, has many children and none of
them prevails, all of them become one wildcard ``*``, and what lies below them comes together under
it. Whether a branch varies is judged by its distinct paths, so pages of the same url count once.

Labelled siblings are merged if their blocked shares do not differ from that of all siblings by more
than ``merge_z`` standard errors. A template is rejected when its smoothed blocked share, with
that of what it merged with, reaches ``reject_purity``. A template without labels belongs to the
nearest branch above it of which ``min_branches`` labelled children, and all that are labelled, are
alike; where there is none it is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed;
segments beyond ``max_depth`` are one segment; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.scratch import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeLimits:
    #: A branch varies with at least this many distinct children ...
    min_children: int = 20
    #: ... if as many equal ones as this share of them would be as uneven (inverse Simpson index).
    min_even: float = 0.25
    merge_z: float = 2.0
    #: Labels that a template is thought to have before any is seen, half of them blocked.
    prior_labels: float = 4.0
    reject_purity: float = 0.8
    #: Labelled children from which a branch speaks for its unlabelled ones.
    min_branches: int = 3
    max_depth: int = 12


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def templates(paths: DataFrame, limits: TreeLimits, tag: str = "") -> DataFrame:
    """The columns of ``paths`` (distinct host and path) and template, its segments joined by ``/``."""
    segs = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), lambda s: s != "")
    beyond = F.array_join(F.slice("segs", limits.max_depth, F.greatest(F.lit(1), F.size("segs"))), "\x01")
    cut = F.concat(F.slice("segs", 1, limits.max_depth - 1), F.array(beyond))
    rows = paths.withColumn("segs", segs).withColumn("segs", F.when(F.size("segs") > limits.max_depth, cut).otherwise(F.col("segs")))
    rows = materialize(rows.withColumn("template", F.lit("")), "paths", tag)
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(1, deepest + 1):
        seg = F.get("segs", F.lit(level - 1))
        children = rows.where(F.size("segs") >= level).groupBy("host", "template", seg.alias("seg")).agg(F.count("*").cast("double").alias("n"))
        kinds = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        even = F.col("n") * F.col("n") >= limits.min_even * F.col("kinds") * F.col("squares")
        varies = kinds.where((F.col("kinds") >= limits.min_children) & even).select("host", "template", F.lit("*").alias("any"))
        rows = rows.join(varies, ["host", "template"], "left")
        mark = F.when(F.size("segs") >= level, F.concat(F.lit("/"), F.coalesce("any", seg))).otherwise(F.lit(""))
        rows = rows.withColumn("template", F.concat("template", mark)).drop("any")
        rows = materialize(rows, "templates", tag)
    return rows.withColumn("template", F.substring("template", F.lit(2), F.length("template"))).drop("segs")


def _purity(labelled: Column | str, blocked: Column | str, limits: TreeLimits) -> Column:
    count = lambda c: F.col(c) if isinstance(c, str) else c
    return (count(blocked) + limits.prior_labels / 2) / (count(labelled) + limits.prior_labels)


def purities(leaves: DataFrame, limits: TreeLimits) -> DataFrame:
    """host, template, purity of templates with their labels (host, template, labelled, blocked)."""
    segs = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", "/"))
    above = leaves.withColumn("segs", segs).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("segs"))))
    above = above.withColumn("node", F.concat(F.col("depth").cast("string"), F.lit("/"), F.array_join(F.slice("segs", F.lit(1), F.col("depth")), "/")))
    parent = F.concat((F.col("depth") - 1).cast("string"), F.lit("/"), F.array_join(F.slice("segs", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))), "/"))
    sums = (F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    nodes = above.where("depth > 0").groupBy("host", "node", parent.alias("parent")).agg(*sums).where("labelled > 0")
    pooled = nodes.groupBy("host", "parent").agg(F.sum("labelled").alias("p_labelled"), F.sum("blocked").alias("p_blocked"), F.count("*").alias("kinds"))
    share = F.col("p_blocked") / F.col("p_labelled")
    gap = F.abs(F.col("blocked") / F.col("labelled") - share)
    nodes = nodes.join(pooled, ["host", "parent"]).withColumn("alike", gap <= limits.merge_z * F.sqrt(share * (1 - share) / F.col("labelled")))
    of_alike = lambda c: F.sum(F.when(F.col("alike"), F.col(c)).otherwise(0))
    merged = nodes.groupBy("host", "parent").agg(of_alike("labelled").alias("m_labelled"), of_alike("blocked").alias("m_blocked"), F.every("alike").alias("all_alike"), F.count("*").alias("kinds"))
    own = nodes.drop("kinds").join(merged, ["host", "parent"])
    own = own.select("host", "node", F.when(F.col("alike"), _purity("m_labelled", "m_blocked", limits)).otherwise(_purity("labelled", "blocked", limits)).alias("purity"))
    speaks = merged.where(F.col("all_alike") & (F.col("kinds") >= limits.min_branches))
    speaks = speaks.select("host", F.col("parent").alias("node"), _purity("m_labelled", "m_blocked", limits).alias("inherited"))
    found = above.join(own, ["host", "node"], "left").join(speaks, ["host", "node"], "left")
    # The root has no siblings; its own labels count as they are.
    itself = F.when(F.col("labelled") > 0, F.coalesce("purity", _purity("labelled", "blocked", limits)))
    value = F.when(F.col("depth") == F.size("segs"), F.coalesce(itself, F.when(F.col("labelled") == 0, F.col("inherited")))).when(F.col("labelled") == 0, F.col("inherited"))
    nearest = F.max(F.when(value.isNotNull(), F.struct("depth", value.alias("v"))))["v"]
    return found.groupBy("host", "template").agg(F.coalesce(nearest, F.lit(0.5)).alias("purity"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, limits: TreeLimits = TreeLimits(), id_col: str = "page_id", url_col: str = "url", tag: str = "") -> DataFrame:
    """Every row with page_id, host, path, rule, verdict, template and purity. The rules' verdicts are the labels."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    blank = (F.col("host") == "") & (F.col("path") == "")
    block = F.sum(F.when(F.col("found.verdict") == "block", 1).otherwise(0)).alias("blocked")
    paths = rows.where(~blank).groupBy("host", "path").agg(F.count("found.verdict").alias("labelled"), block)
    placed = templates(paths, limits, tag)
    leaves = placed.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    by_path = placed.select("host", "path", "template").join(purities(leaves, limits), ["host", "template"])
    learned = F.when(F.col("purity") >= limits.reject_purity, "block").otherwise("allow")
    judged = rows.where(~blank).join(by_path, ["host", "path"])
    judged = judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learned).alias("verdict"), "template", "purity")
    # Urls without a host would all meet in one key, and have no labels.
    nothing = rows.where(blank).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit("allow")).alias("verdict"), F.lit("").alias("template"), F.lit(0.5).alias("purity"))
    return judged.unionByName(nothing)


def _levels(limits: TreeLimits) -> str:
    """SQL of the templates, one level after the other."""
    parts = []
    for k in range(1, limits.max_depth + 1):
        parts.append(f"""
kids{k} AS (SELECT host, t, segs[{k}] AS seg, count(*)::DOUBLE AS n FROM lv{k - 1} WHERE len(segs) >= {k} GROUP BY ALL),
any{k} AS (SELECT host, t FROM kids{k} GROUP BY host, t HAVING count(*) >= {limits.min_children} AND sum(n) * sum(n) >= {limits.min_even} * count(*) * sum(n * n)),
lv{k} AS MATERIALIZED (
  SELECT l.* REPLACE (CASE WHEN len(segs) < {k} THEN l.t ELSE l.t || '/' || CASE WHEN a.host IS NULL THEN segs[{k}] ELSE '*' END END AS t)
  FROM lv{k - 1} l LEFT JOIN any{k} a ON l.host = a.host AND l.t = a.t
),""")
    return "".join(parts)


#: The verdicts in DuckDB SQL, over the view ``pages``, with the rules and limits above.
ORACLE = r"""
WITH rest AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parsed AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM raw
),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/'
    END AS rule
  FROM parsed
),
paths AS (
  SELECT host, path, count(rule) AS labelled, count(*) FILTER (WHERE rule IN ('net/', 'example.com/de/')) AS blocked
  FROM ruled WHERE host <> '' OR path <> '' GROUP BY host, path
),
cut AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') AS s FROM paths),
lv0 AS (
  SELECT host, path, labelled, blocked, '' AS t, CASE WHEN len(s) > 12 THEN list_append(s[1:11], array_to_string(s[12:], chr(1))) ELSE s END AS segs FROM cut
),{LEVELS}
placed AS (SELECT host, path, labelled, blocked, substr(t, 2) AS template FROM lv12),
leaves AS (SELECT host, template, sum(labelled) AS l, sum(blocked) AS b, CASE WHEN template = '' THEN [] ELSE string_split(template, '/') END AS segs FROM placed GROUP BY host, template),
above AS (SELECT *, unnest(range(0, len(segs) + 1)) AS d FROM leaves),
named AS (SELECT *, d || '/' || array_to_string(segs[1:d], '/') AS node, (d - 1) || '/' || array_to_string(segs[1:d-1], '/') AS parent FROM above),
nodes AS (SELECT host, node, parent, sum(l) AS l, sum(b) AS b FROM named WHERE d > 0 GROUP BY host, node, parent HAVING sum(l) > 0),
pooled AS (SELECT *, sum(l) OVER w AS pl, sum(b) OVER w AS pb FROM nodes WINDOW w AS (PARTITION BY host, parent)),
told AS (SELECT *, abs(b / l - pb / pl) <= 2.0 * sqrt((pb / pl) * (1 - pb / pl) / l) AS alike FROM pooled),
merged AS (
  SELECT host, parent, coalesce(sum(l) FILTER (WHERE alike), 0) AS ml, coalesce(sum(b) FILTER (WHERE alike), 0) AS mb, bool_and(alike) AS every, count(*) AS kinds FROM told GROUP BY host, parent
),
own AS (SELECT t.host, t.node, CASE WHEN alike THEN (mb + 2.0) / (ml + 4.0) ELSE (b + 2.0) / (l + 4.0) END AS p FROM told t JOIN merged m ON t.host = m.host AND t.parent = m.parent),
each AS (
  SELECT n.host, n.template, n.d, CASE WHEN n.l > 0 AND n.d = len(n.segs) THEN coalesce(o.p, (n.b + 2.0) / (n.l + 4.0)) WHEN n.l = 0 AND m.every AND m.kinds >= 3 THEN (m.mb + 2.0) / (m.ml + 4.0) END AS v
  FROM named n LEFT JOIN own o ON n.host = o.host AND n.node = o.node LEFT JOIN merged m ON n.host = m.host AND n.node = m.parent
),
pure AS (SELECT host, template, coalesce(arg_max(v, d) FILTER (WHERE v IS NOT NULL), 0.5) AS purity FROM each GROUP BY host, template)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN r.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow' WHEN u.purity >= 0.8 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN placed p ON r.host = p.host AND r.path = p.path LEFT JOIN pure u ON p.host = u.host AND p.template = u.template
""".replace("{LEVELS}", _levels(TreeLimits()))
