"""URL filter: rules first, then a tree of path templates per host.

Segments with digits, and segments of places with very many values, become
wildcards.  Templates that differ only in their last fixed segment are sibling
branches.  A branch is merged with its siblings of the same majority where a test
of two proportions finds its share of good pages like that of the most labelled of
them; one that differs, and one without labels of its own, stands alone.  A merged template is
rejected if too small a share of its labelled pages, smoothed towards one half,
is good; without labels that share is one half, so it is allowed.  Labels are the
verdicts of the rules.  Only DataFrame expressions, joins and aggregates are used,
in the same order as in the SQL twin, which agrees to the last row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: ``(verdict, host and path)``; fixed values of the query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TemplateConfig:
    """A place is variable from ``wide_kinds`` shapes on, if its pages are fewer than ``wide_pages`` a shape.

    A template is rejected if ``(good + smoothing / 2) / (labelled + smoothing)``
    is below one in ``least_share``.
    """

    wide_kinds: int = 20
    wide_pages: int = 2
    smoothing: int = 4
    least_share: int = 5
    #: Standard errors by which the shares of merged branches may differ.
    errors: float = 2.0


def _split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), pattern, k)
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        own_host, own_path = _split_rule(text)
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def templates(links: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """Template of each ``host, path`` (with its pages ``n`` and ``label``)."""
    segs = F.filter(F.split("path", "/"), lambda x: x != "")
    cut = links.withColumn("_segs", segs).withColumn("_shapes", F.transform("_segs", lambda x: F.regexp_replace(x, "[0-9]+", "#")))
    levels = cut.select("host", "path", "n", "label", "_shapes", F.posexplode_outer("_segs").alias("pos", "seg")).select(
        "host",
        "path",
        "n",
        "label",
        "pos",
        "seg",
        F.get("_shapes", F.col("pos")).alias("shape"),
        F.array_join(F.slice("_shapes", F.lit(1), F.coalesce("pos", F.lit(0))), "/").alias("prefix"),
    )
    places = levels.groupBy("host", "prefix", "shape").agg(F.sum("n").alias("n")).where(F.col("shape").isNotNull())
    wide = (
        places.groupBy("host", "prefix")
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"))
        .where((F.col("kinds") >= config.wide_kinds) & (F.col("pages") < config.wide_pages * F.col("kinds")))
        .select("host", "prefix", F.lit(True).alias("wide"))
    )
    fixed = F.when(F.col("shape").contains("#") | F.col("wide"), F.lit("*")).otherwise(F.col("seg"))
    named = levels.join(wide, ["host", "prefix"], "left").select(
        "host", "path", "n", "label", F.when(F.col("seg").isNotNull(), F.struct("pos", fixed.alias("s"))).alias("step")
    )
    whole = named.groupBy("host", "path").agg(F.max("n").alias("n"), F.max("label").alias("label"), F.array_sort(F.collect_list("step")).alias("steps"))
    return whole.select("host", "path", "n", "label", F.array_join(F.col("steps.s"), "/").alias("template"))


def rejected(found: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """``host, template`` and whether its merged branch is rejected."""
    good, bad = F.col("label") == "allow", F.col("label") == "block"
    each = found.groupBy("host", "template").agg(
        F.sum(F.when(good, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad")
    )
    # a/b/* has the parent a, the branch b and the tail /*
    tail = F.regexp_extract("template", "((?:/?\\*)*)$", 1)
    body = F.expr("substring(template, 1, length(template) - length(tail))")
    each = each.withColumn("tail", tail).withColumn("body", body).withColumn("parent", F.regexp_extract("body", "^(.*)/[^/]*$", 1))
    labelled = F.col("good") + F.col("bad")
    side = F.when(labelled > 0, F.when(F.col("good") >= F.col("bad"), "good").otherwise("bad")).otherwise("none")
    each = each.withColumn("side", side)
    keys = ["host", "parent", "tail", "side"]
    around = each.groupBy(*keys).agg(F.max(F.struct(labelled.alias("labelled"), "template", "good")).alias("kin"))
    each = each.join(around, keys).withColumn("alike", _alike(config))
    merged = each.where("alike").groupBy(*keys).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    each = each.join(merged, keys, "left")
    each = each.withColumns({f"all_{c}": F.when(F.col("alike"), F.col(f"all_{c}")).otherwise(F.col(c)) for c in ("good", "bad")})
    low = config.least_share * (2 * F.col("all_good") + config.smoothing) < 2 * (F.col("all_good") + F.col("all_bad") + config.smoothing)
    return each.select("host", "template", low.alias("rejected"))


def _alike(config: TemplateConfig) -> Column:
    """Whether a branch's share of good pages is within the errors of that of ``kin``, the largest of its siblings."""
    g, n = F.col("good").cast("double"), (F.col("good") + F.col("bad")).cast("double")
    kin_g, kin_n = F.col("kin.good").cast("double"), F.col("kin.labelled").cast("double")
    share = F.try_divide(g + kin_g, n + kin_n)
    gap = F.try_divide(g, n) - F.try_divide(kin_g, kin_n)
    spread = share * (1.0 - share) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), kin_n))
    return (n == 0) | (gap * gap <= config.errors * config.errors * spread)


def judge(df: DataFrame, rules=RULES, config: TemplateConfig = TemplateConfig(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    Null and malformed urls have an empty host and path and share one template;
    hosts without labels are allowed; repeated rows stay; other columns, pages'
    contents among them, are not read.  Urls are counted once per host and path
    before anything is shuffled by host, and joins by host carry one row per
    url or template, which skew handling can split.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("label", verdict)
    links = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))
    found = templates(links, config)
    by_url = found.join(rejected(found, config), ["host", "template"]).select("host", "path", "template", "rejected")
    own = F.coalesce("label", F.when(F.col("rejected"), "block").otherwise("allow"))
    return pages.join(by_url, ["host", "path"]).select("page_id", "host", "path", "rule", own.alias("verdict"), "template")


def judge_sql(rules=RULES, config: TemplateConfig = TemplateConfig()) -> str:
    """The same rows in DuckDB SQL."""

    def case(value) -> str:
        arms = []
        for action, text in sorted(rules, key=lambda r: -len(r[1])):
            host, path = _split_rule(text)
            arms.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value(action, text)}'")
        return "CASE " + " ".join(arms) + " END"

    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{pattern}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path FROM pages
),
ruled AS (SELECT *, {case(lambda a, t: t)} AS rule, {case(lambda a, t: a)} AS label FROM parsed),
links AS (SELECT host, path, count(*) AS n, max(label) AS label FROM ruled GROUP BY host, path),
cut AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM links),
shaped AS (SELECT *, list_transform(segs, lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS shapes FROM cut),
levels AS (
  SELECT host, path, n, pos, segs[pos] AS seg, shapes[pos] AS shape, array_to_string(shapes[1:pos - 1], '/') AS prefix
  FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS pos FROM shaped)
),
wide AS (
  SELECT host, prefix FROM (SELECT host, prefix, shape, sum(n) AS n FROM levels GROUP BY ALL)
  GROUP BY host, prefix HAVING count(*) >= {config.wide_kinds} AND sum(n) < {config.wide_pages} * count(*)
),
named AS (
  SELECT l.host, l.path, string_agg(CASE WHEN contains(shape, '#') OR w.host IS NOT NULL THEN '*' ELSE seg END, '/' ORDER BY pos) AS template
  FROM levels l LEFT JOIN wide w ON l.host = w.host AND l.prefix = w.prefix GROUP BY l.host, l.path
),
found AS (SELECT k.*, coalesce(template, '') AS template FROM links k LEFT JOIN named m ON k.host = m.host AND k.path = m.path),
each_one AS (
  SELECT host, template, sum(CASE WHEN label = 'allow' THEN n ELSE 0 END) AS good, sum(CASE WHEN label = 'block' THEN n ELSE 0 END) AS bad
  FROM found GROUP BY host, template
),
bodies AS (
  SELECT *, regexp_extract(template, '((?:/?\\*)*)$', 1) AS tail, left(template, length(template) - length(regexp_extract(template, '((?:/?\\*)*)$', 1))) AS body
  FROM each_one
),
sides AS (
  SELECT *, regexp_extract(body, '^(.*)/[^/]*$', 1) AS parent, CAST(good AS DOUBLE) AS g, CAST(good + bad AS DOUBLE) AS n,
    CASE WHEN good + bad > 0 THEN CASE WHEN good >= bad THEN 'good' ELSE 'bad' END ELSE 'none' END AS side
  FROM bodies
),
kin AS (
  SELECT *, CAST(k.good AS DOUBLE) AS kg, CAST(k.labelled AS DOUBLE) AS kn
  FROM (SELECT *, max({{'labelled': good + bad, 'template': template, 'good': good}}) OVER (PARTITION BY host, parent, tail, side) AS k FROM sides)
),
tested AS (
  SELECT *, n = 0 OR (g / n - kg / kn) * (g / n - kg / kn)
    <= {config.errors} * {config.errors} * ((g + kg) / (n + kn) * (1.0::DOUBLE - (g + kg) / (n + kn)) * (1.0::DOUBLE / n + 1.0::DOUBLE / kn)) AS alike
  FROM kin
),
totals AS (
  SELECT host, template, CASE WHEN alike THEN sum(good) FILTER (alike) OVER w ELSE good END AS all_good, CASE WHEN alike THEN sum(bad) FILTER (alike) OVER w ELSE bad END AS all_bad
  FROM tested WINDOW w AS (PARTITION BY host, parent, tail, side)
),
merged AS (
  SELECT host, template, {config.least_share} * (2 * all_good + {config.smoothing}) < 2 * (all_good + all_bad + {config.smoothing}) AS rejected FROM totals
)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.label, CASE WHEN m.rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN found f ON r.host = f.host AND r.path = f.path JOIN merged m ON f.host = m.host AND f.template = m.template
"""
