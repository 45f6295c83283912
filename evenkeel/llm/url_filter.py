"""URL filtering by empirical-Bayes host reputation.

Labelled page outcomes (bad: quality 0 or toxic 1) are counted for each host, registered domain
and suffix. Each level is a beta-binomial whose prior mean is the level above: the suffix shrinks
to the corpus mean, the registered domain to its suffix, the host to its registered domain. The
prior strength of a level is estimated from all its groups by the method of moments; a level whose groups scatter no more than their
numbers of labels explain has none, and its groups have the posterior of the level above. A host
without labels stands on its domain, suffix or the corpus. A page is blocked where the lower
posterior bound of its host's bad rate exceeds ``limit`` times the mean of the corpus, that is, where its host is worse than
the corpus beyond the doubt that its few labels leave; fixed rules, longest match first, decide before the method.

Rules are a table. Each depth of rule hosts is one join on the page's last names with the rules grouped by host, so there may be any
number of rules; Catalyst broadcasts them where they are small.

Counting is partial before every shuffle, so a hot host costs one row for each task; the join of
hosts to pages is left to Catalyst, which splits a hot host's rows. Hosts, suffixes and domains are
staged, as each level is read several times.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the
verdict of the host of that name. Very long urls are read in one pass. Repeated labels of one page count once, bad if any is bad; null
labels say nothing. Rules of equal length cannot fit one page unless they are equal; of those the
first listed wins. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: A prior weighs as much as so many labelled pages at least.
LEAST_PRIOR = 1.0
#: Posterior standard deviations below the mean, and the multiple of the corpus mean that they may not exceed.
BOUND_SD, LIMIT = 1.645, 1.0
# fixed values: second-level names under which a country's registry sells names
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) == 0, "").otherwise(host)


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) == 0, "").otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """place, action and rule of a list of rules."""
    rows = [F.struct(F.lit(i).alias("place"), F.lit(action).alias("action"), F.lit(rule).alias("rule")) for i, (action, rule) in enumerate(rules)]
    kind = "array<struct<place:int,action:string,rule:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows: host, path and more. Adds __ek_rule, the (rule, verdict) of the longest rule that fits, else null."""
    slash = F.locate("/", "rule")
    name = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    start = F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit("/"))
    # the longest of a host's rules first, of equal ones the first listed
    one = F.struct((-F.length("rule")).alias("less"), "place", start.alias("start"), "rule", F.col("action").alias("verdict"))
    named = rules.select("*", name.alias("name"), one.alias("one")).groupBy("name").agg(F.array_sort(F.collect_list("one")).alias("ones"))
    named = staged(named.withColumn("depth", F.size(F.split("name", r"\."))), "url-rules")
    found = []
    for depth in sorted(r[0] for r in named.select("depth").distinct().collect()):
        here = named.where(F.col("depth") == depth).select(F.col("name").alias("__ek_name"), F.col("ones").alias(f"__ek_{depth}"))
        rows = rows.join(here, F.substring_index("host", ".", -depth) == F.col("__ek_name"), "left").drop("__ek_name")
        found.append(F.get(F.filter(f"__ek_{depth}", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0)))
    out = "struct<rule:string,verdict:string>"
    best = F.array_min(F.array_compact(F.array(*found))) if found else F.lit(None).cast(out)
    if found:
        best = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))
    return rows.withColumn("__ek_rule", best).drop(*[c for c in rows.columns if c.startswith("__ek_")])


def registered_domain(host: Column) -> Column:
    """The last two names, or three below a second-level registry name of a two-letter country."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    second = F.element_at(parts, F.when(n >= 2, -2).otherwise(-1))
    deep = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & second.isin(*SECOND_LEVEL)
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix(host: Column) -> Column:
    """What is registered under: the registered domain without its first name."""
    domain = registered_domain(host)
    return F.when(F.locate(".", domain) > 0, F.substring(domain, F.locate(".", domain) + 1, F.length(domain))).otherwise(domain)


def _strength(n: Column, bad: Column, mean: Column) -> Column:
    """Prior strength of a level by moments, over its groups with n labels, bad of them, and prior mean.

    The squared residuals of a beta-binomial of strength s sum to m(1-m) n (s + n) / (s + 1) each.
    """
    square = F.sum((bad - n * mean) * (bad - n * mean))
    flat = F.sum(n * mean * (1 - mean))
    steep = F.sum(n * n * mean * (1 - mean))
    # square * (s + 1) = s * flat + steep
    return F.when(square > flat, F.greatest(F.lit(LEAST_PRIOR), (steep - square) / (square - flat)))


def _posterior(n: Column, bad: Column, strength: Column, mean: Column, sd: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of a group's bad rate; those of the level above, mean and sd, where its own level has no strength."""
    alpha, beta = bad + strength * mean, n - bad + strength * (1 - mean)
    own = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    return F.coalesce(alpha / (alpha + beta), mean), F.coalesce(own, sd)


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts: host, n, bad (labelled pages), one row for each host. Adds lower, the posterior bound of the bad rate, mean0, the corpus mean, and k0, k1 and k2, the strengths of
    the priors of suffixes, domains and hosts, null where there is none."""
    hosts = staged(hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("d_n"), F.sum("bad").alias("d_bad"))
    mean0 = ((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean0")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("s_n"), F.sum("bad").alias("s_bad"))
    suffixes = staged(suffixes.crossJoin(F.broadcast(hosts.agg(mean0))), "url-suffixes")
    strength0 = suffixes.agg(_strength(F.col("s_n"), F.col("s_bad"), F.col("mean0")).alias("k0"))
    mean, sd = _posterior(F.col("s_n"), F.col("s_bad"), F.col("k0"), F.col("mean0"), F.lit(0.0))
    suffixes = suffixes.crossJoin(F.broadcast(strength0)).select("suffix", "mean0", "k0", mean.alias("s_mean"), sd.alias("s_sd"))
    domains = staged(domains.join(suffixes, "suffix"), "url-domains")
    strength1 = domains.agg(_strength(F.col("d_n"), F.col("d_bad"), F.col("s_mean")).alias("k1"))
    mean, sd = _posterior(F.col("d_n"), F.col("d_bad"), F.col("k1"), F.col("s_mean"), F.col("s_sd"))
    domains = domains.crossJoin(F.broadcast(strength1)).select("domain", "suffix", "mean0", "k0", "k1", mean.alias("d_mean"), sd.alias("d_sd"))
    hosts = staged(hosts.join(domains, ["domain", "suffix"]), "url-rated")
    strength2 = hosts.agg(_strength(F.col("n"), F.col("bad"), F.col("d_mean")).alias("k2"))
    mean, sd = _posterior(F.col("n"), F.col("bad"), F.col("k2"), F.col("d_mean"), F.col("d_sd"))
    return hosts.crossJoin(F.broadcast(strength2)).select("host", "n", "bad", (mean - F.lit(BOUND_SD) * sd).alias("lower"), "mean0", "k0", "k1", "k2")


def judged(pages: DataFrame, labels: DataFrame, rules: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages. labels: page_id, bad (0, 1 or null); rules: place, action, rule."""
    outcomes = labels.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("l_id")).agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = rows.select("page_id", "host").join(outcomes, F.col("page_id") == F.col("l_id"), "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    worse = F.col("lower") > F.lit(limit) * F.col("mean0")
    verdicts = reputations(hosts).select(F.col("host").alias("r_host"), F.when(worse, "block").otherwise("allow").alias("learned"))
    ruled = with_rule(rows, rules_table(pages.sparkSession) if rules is None else rules)
    return ruled.join(verdicts, F.col("host") == F.col("r_host"), "left").select(
        "page_id", "host", "path", F.col("__ek_rule.rule").alias("rule"), F.coalesce(F.col("__ek_rule.verdict"), F.col("learned")).alias("verdict")
    )


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes are the labels of the document of the same number."""
    labels = read_table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return judged(read_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


_PRIOR = "CASE WHEN sq > flat THEN greatest(1.0, (steep - sq) / (sq - flat)) END"
_SD = "sqrt((bad + k * {m}) * (n - bad + k * (1 - {m})) / ((n + k) * (n + k) * (n + k + 1)))"


def _moments(n: str, bad: str, mean: str) -> str:
    return (
        f"sum(({bad} - {n} * {mean}) ** 2) AS sq, sum({n} * {mean} * (1 - {mean})) AS flat, "
        f"sum({n} * {n} * {mean} * (1 - {mean})) AS steep"
    )


ORACLE_SQL = f"""
WITH split AS (
  SELECT page_id,
         CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages
), outcome AS (
  SELECT doc_id AS id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM split LEFT JOIN outcome ON id = page_id GROUP BY host
), named AS (
  SELECT host, n, bad, list_reverse(string_split(host, '.')) AS p FROM hosts
), domained AS (
  SELECT host, n, bad,
         CASE WHEN len(p) >= 3 AND len(p[1]) = 2 AND p[2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN p[3] || '.' || p[2] || '.' || p[1]
              WHEN len(p) >= 2 THEN p[2] || '.' || p[1] ELSE host END AS domain
  FROM named
), levels AS (
  SELECT *, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM domained
), corpus AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM levels),
suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM levels GROUP BY suffix),
k0 AS (SELECT {_PRIOR} AS k FROM (SELECT {_moments("n", "bad", "m")} FROM suf, corpus)),
sufm AS (SELECT suffix, coalesce((bad + k * m) / (n + k), m) AS m, coalesce({_SD.format(m="m")}, 0) AS sd FROM suf, corpus, k0),
dom AS (SELECT l.domain, l.suffix, m, sd, sum(n) AS n, sum(bad) AS bad FROM levels l JOIN sufm USING (suffix) GROUP BY l.domain, l.suffix, m, sd),
k1 AS (SELECT {_PRIOR} AS k FROM (SELECT {_moments("n", "bad", "m")} FROM dom)),
domm AS (SELECT domain, coalesce((bad + k * m) / (n + k), m) AS m, coalesce({_SD.format(m="m")}, sd) AS sd FROM dom, k1),
hostm AS (SELECT l.host, l.n, l.bad, m, sd FROM levels l JOIN domm USING (domain)),
k2 AS (SELECT {_PRIOR} AS k FROM (SELECT {_moments("n", "bad", "m")} FROM hostm)),
post AS (SELECT host, coalesce((bad + k * m) / (n + k), m) AS mean, coalesce({_SD.format(m="m")}, sd) AS sd FROM hostm, k2),
learned AS (SELECT host, CASE WHEN mean - 1.645 * sd > corpus.m THEN 'block' ELSE 'allow' END AS v FROM post, corpus),
rules(action, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), best AS (
  SELECT page_id, host, path, max_by(rule, len(rule)) AS rule, max_by(action, len(rule)) AS action
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path
)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.action, l.v) AS verdict
FROM split s JOIN learned l ON l.host = s.host LEFT JOIN best b ON b.page_id = s.page_id AND b.host = s.host AND b.path = s.path
"""
