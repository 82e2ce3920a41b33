"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are counted by host. Counts are shrunk from host to registered domain to suffix to all
hosts: at each level the units below scatter around the level's rate, and a beta-binomial fit by moments says how
strongly. A unit's prior is a beta distribution around its parent's posterior mean. Pages of a host are blocked when
the lower posterior bound of its bad rate is above a limit. Fixed rules come before reputation.

Pages are reduced to one row per host before anything is joined. The one join that brings the verdict back to the
pages is a plain equi-join, so a host with a third of all pages is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import written

#: Fixed values of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Blocked when the bad rate is above LIMIT with the certainty of SIGMAS standard deviations.
LIMIT = 0.5
SIGMAS = 1.645
#: Bounds of a prior's weight in pages, for levels with few units or none that differ.
WEIGHT_BOUNDS = (2.0, 1000.0)


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*+://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*+://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and the start of the path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # From the shortest to the longest: the last one that is asked first wins.
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Suffixes of two labels under which the public registers names. Fixed values, the common ones; any other suffix is the
#: last label.
TWO_LABELS = (
    "ac.at ac.jp ac.uk asn.au blogspot.com co.at co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au "
    "com.br com.cn com.co com.hk com.mx com.my com.ng com.pk com.sg com.tr com.tw com.ua com.vn edu.au edu.cn firebaseapp.com "
    "github.io gitlab.io go.jp gov.au gov.br gov.cn gov.in gov.uk herokuapp.com ltd.uk me.uk ne.jp net.au net.br net.cn "
    "net.nz netlify.app nhs.uk or.at or.jp or.kr org.au org.br org.cn org.nz org.uk org.za pages.dev plc.uk sch.uk vercel.app "
    "web.app wordpress.com"
).split()
_ADDRESS = r"^(?:[0-9]{1,3}(?:[.][0-9]{1,3}){3}|\[.*)$"


def site_of(host: Column) -> Column:
    """A host without user part and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def domain_of(host: Column) -> Column:
    """The registered name: one label and the suffix. An address is its own."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(_ADDRESS), site).when(two.isin(*TWO_LABELS), F.substring_index(site, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    """What names are registered under; all addresses share one."""
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(_ADDRESS), "[]").when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(site, ".", -1))


def _prior_weight(units: DataFrame, of: str) -> DataFrame:
    """Weight in pages of the prior under each value of `of`, by moments of the units' bad rates.

    With rates p_i of n_i pages around m: the share of the variance that pages alone do not explain is
    rho = (S / (m(1-m)) - (k-1)) / (sum n - sum n^2 / sum n - (k-1)), S = sum n_i (p_i - m)^2; weight = 1 / rho - 1.
    """
    sums = units.groupBy(of).agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.count("*").alias("k"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"),
    )
    m = F.col("bad") / F.col("n")
    scatter = F.col("bb") - F.col("bad") * m
    spread = m * (1 - m)
    free = F.col("k") - 1
    room = F.col("n") - F.col("nn") / F.col("n") - free
    rho = F.when((spread > 0) & (room > 0), (scatter / spread - free) / room)
    low, high = WEIGHT_BOUNDS
    weight = F.when(rho > 0, F.least(F.lit(high), F.greatest(F.lit(low), 1 / rho - 1))).otherwise(F.lit(high))
    return sums.select(of, weight.alias("weight"))


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts: host, n, bad (n and bad over labelled pages, n may be 0). Adds rate and lower for every host.

    Parameters of a level come from its labelled units; a level without any takes the level above.
    """
    known = hosts.where("n > 0").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    known = known.withColumn("all", F.lit(1))
    domains = known.groupBy("all", "suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("all", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.groupBy("all").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Half a bad and half a good page more: the rate of all pages is never 0 or 1.
    top = top.select("all", ((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("mean"))
    top = top.join(_prior_weight(suffixes, "all"), "all")

    def below(units: DataFrame, parent: DataFrame, of: str, unit: str, inner: DataFrame) -> DataFrame:
        """Posterior mean of each unit and the weight of the prior for what is under it."""
        own = units.join(parent, of).select(
            unit, ((F.col("mean") * F.col("weight") + F.col("bad")) / (F.col("weight") + F.col("n"))).alias("mean")
        )
        return own.join(_prior_weight(inner, unit), unit)

    of_suffix = below(suffixes, top, "all", "suffix", domains)
    of_domain = below(domains, of_suffix, "suffix", "domain", known)
    every = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    every = every.withColumn("all", F.lit(1))
    for level, parent in (("domain", of_domain), ("suffix", of_suffix), ("all", top)):
        named = parent.select(level, F.col("mean").alias(f"{level}_mean"), F.col("weight").alias(f"{level}_weight"))
        every = every.join(named, level, "left")
    mean = F.coalesce("domain_mean", "suffix_mean", "all_mean", F.lit(0.5))
    weight = F.coalesce("domain_weight", "suffix_weight", "all_weight", F.lit(WEIGHT_BOUNDS[0]))
    a, b = mean * weight + F.col("bad"), (1 - mean) * weight + F.col("n") - F.col("bad")
    rate = a / (a + b)
    deviation = F.sqrt(rate * (1 - rate) / (a + b + 1))
    return every.select("host", rate.alias("rate"), (rate - F.lit(SIGMAS) * deviation).alias("lower"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT
) -> DataFrame:
    """pages: page_id, url. outcomes: page_id, bad (0 or 1; null rows are none). Adds to every page's id
    host, path, rule, verdict, rate, lower.

    A null url or one without `://` has an empty host, which is a host like others. Hosts without labelled pages get
    their parents' rate. A page with several outcomes counts once with each; pages repeated in the table count again.
    Other columns are not read. An empty table gives no rows.
    """
    url = F.col("url").cast("string")
    sites = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    marks = outcomes.select(F.col("page_id").cast("long").alias("marked"), F.col("bad").cast("int").alias("bad"))
    marks = marks.where(F.col("bad").isin(0, 1))
    seen = sites.join(marks, F.col("page_id") == F.col("marked"), "left")
    hosts = seen.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")
    )
    standing = written(reputation(written(hosts, "hosts")), "reputation")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    out = sites.join(standing, "host").withColumn("found", rule)
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "rate",
        "lower",
    )


#: DuckDB SQL for judge() with the contract's rules and the outcomes of the registered query.
SQL = r"""
WITH two AS (SELECT unnest(string_split('TWO_LABELS', ' ')) AS name),
sites AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
named AS (
  SELECT page_id, host, regexp_matches(site, '^([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*)$') AS is_address, site,
         string_split(site, '.') AS labels, array_to_string(string_split(site, '.')[-2:], '.') IN (SELECT name FROM two) AS is_two
  FROM (SELECT page_id, host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM sites)),
u AS (
  SELECT host, CASE WHEN any_value(is_address) THEN any_value(site) ELSE array_to_string(any_value(
           CASE WHEN is_two THEN labels[-3:] ELSE labels[-2:] END), '.') END AS domain,
         CASE WHEN any_value(is_address) THEN '[]' WHEN any_value(is_two) THEN array_to_string(any_value(labels)[-2:], '.')
              ELSE any_value(labels)[-1] END AS suffix,
         count(quality)::DOUBLE AS n, coalesce(sum(1 - quality), 0)::DOUBLE AS bad
  FROM named LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)) ON page_id = doc_id GROUP BY host),
kn AS (SELECT * FROM u WHERE n > 0),
do_ AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM kn GROUP BY suffix, domain),
su AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM do_ GROUP BY suffix),
m0 AS (SELECT 1 AS unit, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, count(*) AS k, sum(bad * bad / n) AS bb FROM su),
m1 AS (SELECT suffix AS unit, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, count(*) AS k, sum(bad * bad / n) AS bb FROM do_ GROUP BY suffix),
m2 AS (SELECT domain AS unit, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, count(*) AS k, sum(bad * bad / n) AS bb FROM kn GROUP BY domain),
ms AS (
  SELECT 0 AS level, unit::VARCHAR AS unit, n, bad, nn, k, bb FROM m0 WHERE k > 0
  UNION ALL SELECT 1, unit, n, bad, nn, k, bb FROM m1 UNION ALL SELECT 2, unit, n, bad, nn, k, bb FROM m2),
rh AS (
  SELECT level, unit, CASE WHEN bad / n * (1 - bad / n) > 0 AND n - nn / n - (k - 1) > 0
         THEN ((bb - bad * (bad / n)) / (bad / n * (1 - bad / n)) - (k - 1)) / (n - nn / n - (k - 1)) END AS rho FROM ms),
w AS (SELECT level, unit, CASE WHEN rho > 0 THEN least(1000.0, greatest(2.0, 1 / rho - 1)) ELSE 1000.0 END::DOUBLE AS weight FROM rh),
t AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS mean, (SELECT weight FROM w WHERE level = 0) AS weight FROM su),
s AS (SELECT suffix, (t.mean * t.weight + bad) / (t.weight + n) AS mean, w.weight FROM su, t, w WHERE w.level = 1 AND w.unit = suffix),
d AS (SELECT do_.domain, (s.mean * s.weight + bad) / (s.weight + n) AS mean, w.weight
      FROM do_ JOIN s USING (suffix) JOIN w ON w.level = 2 AND w.unit = do_.domain),
p AS (
  SELECT host, n, bad, coalesce(d.mean, s.mean, t.mean, 0.5) AS mean, coalesce(d.weight, s.weight, t.weight, 2.0) AS weight
  FROM u LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix) CROSS JOIN t),
q AS (SELECT host, mean * weight + bad AS a, (1 - mean) * weight + n - bad AS b FROM p),
r AS (SELECT host, a / (a + b) AS rate, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS lower FROM q),
f AS (
  SELECT *, '.' || host AS dotted FROM sites JOIN r USING (host)),
x AS (
  SELECT *, CASE WHEN dotted LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN dotted LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN dotted LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN dotted LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM f)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
                 WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN lower > 0.5 THEN 'block' ELSE 'allow' END END AS verdict,
       rate, lower
FROM x
""".replace("TWO_LABELS", " ".join(TWO_LABELS))
