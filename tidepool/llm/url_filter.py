"""URL filter by empirical-Bayes host reputation, with explicit rules on top.

Labelled page outcomes (bad or not) are counted by host.  The counts are shrunk through
beta-binomial priors: a suffix towards the corpus, a registered domain towards its suffix, a
host towards its domain.  Each level's concentration is estimated from the over-dispersion of
its groups (method of moments).  A host is blocked if the lower posterior bound of its bad
rate exceeds ``max_bad``: if its Beta posterior puts at least ``surety`` above that.  The tail
is integrated over the log odds in ``CELLS`` cells to each side of ``max_bad``, with the exponential
ends in closed form.  Only built-in functions run on the executors; what reaches the
driver is one row of moments for each level.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged
as the host ``''``.  Pages without an outcome count for no host and still get a verdict, from
the priors if nothing is known of the host.  Repeated pages count once each; several outcomes
of one page count as bad if any is.  Null outcomes are ignored.  Empty tables give no rows.
Further columns of the inputs are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the rules that override reputation.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Public suffixes of two labels; every other suffix is a host's last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")

SURETY, MAX_BAD, LEAST_RHO, MOST_RHO = 0.95, 0.2, 1e-4, 0.5
CELLS, REACH = 64, 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text = verdict = None
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path) if text is None else text.when(fits, rule_host + rule_path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def with_levels(df: DataFrame) -> DataFrame:
    """Adds ``suffix`` and ``domain`` of ``host`` (its port aside)."""
    name = F.regexp_replace("host", r":\d*$", "")
    two = F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    domain = F.when(two.isin(*TWO_LABEL_SUFFIXES), F.regexp_extract(name, r"([^.]*\.[^.]*\.[^.]*)$", 1)).otherwise(two)
    return df.withColumns({"suffix": suffix, "domain": F.when(domain == "", name).otherwise(domain)})


def _concentration(groups: DataFrame, overall: float) -> float:
    """Beta-binomial concentration from groups (n, k, p of the parent)."""
    spread = overall * (1 - overall)
    q, g, free = groups.agg(F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("p")) ** 2), F.count(F.lit(1)), F.sum(F.col("n") - 1)).first()
    rho = ((q or 0.0) / spread - g) / free if free and spread > 0 else LEAST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def beta_tail(a: Column, b: Column, above: float) -> Column:
    """The share of Beta(a, b) above ``above``.

    In log odds u the density is proportional to exp(a log p + b log(1 - p)), with its peak at
    log(a / b); it is taken relative to the peak, which keeps counts of any size in range.
    """
    exponent = lambda u: a * u - (a + b) * F.when(u > 0, u + F.log1p(F.exp(-u))).otherwise(F.log1p(F.exp(u)))
    peak, sd, at = F.log(a / b), F.sqrt(1 / a + 1 / b), F.lit(math.log(above / (1 - above)))
    height = lambda u: F.exp(exponent(u) - exponent(peak))
    low, high = F.least(peak - REACH * sd, at - sd), F.greatest(peak + REACH * sd, at + sd)

    def area(start: Column, end: Column) -> Column:
        step = (end - start) / CELLS
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(2 * CELLS - 1)), F.lit(0.0), lambda t, i: t + F.when(i % 2 == 1, 4.0).otherwise(2.0) * height(start + i * step / 2))
        return step / 6 * (height(start) + inner + height(end))

    upper = area(at, high) + height(high) / b
    return upper / (area(low, at) + height(low) / a + upper)


def host_reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """host, n, k, bad_rate (posterior mean) and bad_tail (posterior share above ``max_bad``) for every host of ``pages``.

    ``outcomes``: page_id and bad (0 or 1).
    """
    hosts = with_levels(pages.select("page_id", host_of(F.col("url")).alias("host")))
    bad = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    counts = hosts.join(bad, "page_id", "left").groupBy("suffix", "domain", "host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    counts = Scratch(pages.sparkSession, "hosts").table(counts, "counts")
    domains = counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = total["k"] / total["n"] if total["n"] else 0.5

    known = lambda df: df.where("n > 0")
    raw = lambda df, *key: known(df).select(*key, (F.col("k") / F.col("n")).alias("p"))
    m_suffix = _concentration(known(suffixes).withColumn("p", F.lit(overall)), overall)
    m_domain = _concentration(known(domains).join(raw(suffixes, "suffix"), "suffix"), overall)
    m_host = _concentration(known(counts).join(raw(domains, "suffix", "domain"), ["suffix", "domain"]), overall)

    def shrunk(p: Column, m: float) -> Column:
        return (F.col("k") + F.lit(m) * p) / (F.col("n") + F.lit(m))

    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), m_suffix).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk(F.col("p_suffix"), m_domain).alias("p_domain"))
    out = counts.join(domains, ["suffix", "domain"]).withColumn("bad_rate", shrunk(F.col("p_domain"), m_host))
    out = out.withColumns({"a": F.col("bad_rate") * (F.col("n") + F.lit(m_host)), "b": (1 - F.col("bad_rate")) * (F.col("n") + F.lit(m_host))})
    # Without any bad outcome in the corpus (or any good one) the posterior has all its mass at one end.
    tail = F.when(F.col("a") <= 0, 0.0).when(F.col("b") <= 0, 1.0).otherwise(beta_tail(F.col("a"), F.col("b"), max_bad))
    return out.select("host", "n", "k", "bad_rate", tail.alias("bad_tail"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD, surety: float = SURETY) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_tail of every page.

    The longest rule that fits decides; without one, reputation does.  Hot hosts: counts are
    pre-aggregated before they are shuffled, and the join back is one that adaptive execution
    splits by partition size.
    """
    reputation = host_reputation(pages, outcomes, max_bad).select("host", "bad_rate", "bad_tail")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_tail") >= surety, "block").otherwise("allow")
    return rows.join(reputation, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "bad_rate", "bad_tail")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page judged.  A page's outcome is the quality label of the row with its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return filter_urls(pages, outcomes).withColumns({"bad_rate": F.round("bad_rate", 6), "bad_tail": F.round("bad_tail", 6)})


_RULE_TEXT = {verdict: [f"{h}{p}" for h, p, v in RULES if v == verdict] for verdict in ("allow", "block")}
_RULE_CASE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

OP1_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS nm FROM p),
two AS (SELECT *, regexp_extract(nm, '([^.]*\.[^.]*)$', 1) AS tw FROM named),
lev AS (SELECT *, CASE WHEN tw IN ({_TWO}) THEN tw ELSE regexp_extract(nm, '([^.]*)$', 1) END AS suffix,
  CASE WHEN (CASE WHEN tw IN ({_TWO}) THEN regexp_extract(nm, '([^.]*\.[^.]*\.[^.]*)$', 1) ELSE tw END) = '' THEN nm
       WHEN tw IN ({_TWO}) THEN regexp_extract(nm, '([^.]*\.[^.]*\.[^.]*)$', 1) ELSE tw END AS domain FROM two),
bad AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT suffix, domain, host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
      FROM lev LEFT JOIN bad ON doc_id = page_id GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
g AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0.5 END AS p FROM s),
es AS (SELECT sum(n * (k / n - p) ** 2) AS q, count(*) AS c, sum(n - 1) AS f FROM s, g WHERE n > 0),
ed AS (SELECT sum(d.n * (d.k / d.n - s.k / s.n) ** 2) AS q, count(*) AS c, sum(d.n - 1) AS f FROM d JOIN s USING (suffix) WHERE d.n > 0),
eh AS (SELECT sum(h.n * (h.k / h.n - d.k / d.n) ** 2) AS q, count(*) AS c, sum(h.n - 1) AS f FROM h JOIN d USING (suffix, domain) WHERE h.n > 0),
m AS (SELECT g.p AS p0,
  1 / least(greatest(CASE WHEN es.f > 0 AND g.p * (1 - g.p) > 0 THEN (es.q / (g.p * (1 - g.p)) - es.c) / es.f ELSE {LEAST_RHO} END, {LEAST_RHO}), {MOST_RHO}) - 1 AS ms,
  1 / least(greatest(CASE WHEN ed.f > 0 AND g.p * (1 - g.p) > 0 THEN (ed.q / (g.p * (1 - g.p)) - ed.c) / ed.f ELSE {LEAST_RHO} END, {LEAST_RHO}), {MOST_RHO}) - 1 AS md,
  1 / least(greatest(CASE WHEN eh.f > 0 AND g.p * (1 - g.p) > 0 THEN (eh.q / (g.p * (1 - g.p)) - eh.c) / eh.f ELSE {LEAST_RHO} END, {LEAST_RHO}), {MOST_RHO}) - 1 AS mh
  FROM g, es, ed, eh),
ps AS (SELECT suffix, (k + ms * p0) / (n + ms) AS p FROM s, m),
pd AS (SELECT d.suffix, d.domain, (k + md * ps.p) / (n + md) AS p FROM d JOIN ps USING (suffix), m),
ph AS (SELECT h.host, h.n, (k + mh * pd.p) / (n + mh) AS p, mh FROM h JOIN pd USING (suffix, domain), m),
ab AS (SELECT host, p, p * (n + mh) AS a, (1 - p) * (n + mh) AS b, ln({MAX_BAD} / (1 - {MAX_BAD})) AS t FROM ph),
pk AS (SELECT *, ln(a / b) AS u0, sqrt(1 / a + 1 / b) AS sd FROM ab WHERE a > 0 AND b > 0),
ends AS (SELECT host, a, b, t, u0, least(u0 - {REACH} * sd, t - sd) AS lo, greatest(u0 + {REACH} * sd, t + sd) AS hi FROM pk),
cell AS (SELECT host, a, b, u0, side, i, CASE side WHEN 0 THEN lo + i * (t - lo) / {2 * CELLS} ELSE t + i * (hi - t) / {2 * CELLS} END AS u,
  CASE side WHEN 0 THEN t - lo ELSE hi - t END / {6 * CELLS} * CASE WHEN i IN (0, {2 * CELLS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS wt
  FROM ends, range(0, 2) AS sides(side), range(0, {2 * CELLS} + 1) AS steps(i)),
hgt AS (SELECT *, exp(a * (u - u0) - (a + b) * ((greatest(u, 0) + ln(1 + exp(-abs(u)))) - (greatest(u0, 0) + ln(1 + exp(-abs(u0)))))) AS y FROM cell),
area AS (SELECT host, sum(CASE WHEN side = 1 THEN wt * y + CASE WHEN i = {2 * CELLS} THEN y / b ELSE 0 END END) AS up,
  sum(CASE WHEN side = 0 THEN wt * y + CASE WHEN i = 0 THEN y / a ELSE 0 END END) AS down FROM hgt GROUP BY host),
r2 AS (SELECT ab.host AS rhost, p, CASE WHEN a <= 0 THEN 0 WHEN b <= 0 THEN 1 ELSE up / (down + up) END AS tail FROM ab LEFT JOIN area USING (host)),
j AS (SELECT page_id, host, path, CASE {_RULE_CASE} END AS rule, p, tail FROM p AS pg LEFT JOIN r2 ON host = rhost)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({', '.join(f"'{x}'" for x in _RULE_TEXT['allow'])}) THEN 'allow'
       WHEN rule IN ({', '.join(f"'{x}'" for x in _RULE_TEXT['block'])}) THEN 'block'
       WHEN tail >= {SURETY} THEN 'block' ELSE 'allow' END AS verdict,
  round(p, 6) AS bad_rate, round(tail, 6) AS bad_tail FROM j
"""
