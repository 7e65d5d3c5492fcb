"""URL filtering: explicit rules first, then empirical-Bayes host reputation.

The pages that a rule decides are the labelled outcomes. Their block rates are counted by host, registered
domain and suffix; each level's beta prior has its parent's shrunk rate as mean, and as strength the
method-of-moments estimate over all of that level's members. A page without a rule is blocked when the lower
bound (mean less `z` standard deviations) of its host's beta posterior lies above `limit`.

The suffix is the host's last two labels where `suffixes` holds them ("co.uk"), else its last one; the registered
domain is one label more. Ports and user names stay part of the host, as the url gives them. Hosts without outcomes
take their domain's posterior, and so on upward.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the
overall rate; a very long url costs its own length; with no outcomes at all everything is allowed; repeated rows,
and rows that tie in id or url, are judged alike and give a row each; a null id is passed on; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels under which the public registers names.
SUFFIXES = (
    "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl",
    "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.uy", "com.ve", "com.vn", "edu.au", "edu.br", "edu.cn", "edu.tw", "go.jp", "gob.mx", "gouv.fr",
    "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "gov.za", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "nhs.uk", "or.at", "or.jp",
    "or.kr", "org.ar", "org.au", "org.br", "org.cn", "org.mx", "org.nz", "org.tw", "org.uk", "org.za", "sch.uk",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level's prior counts for at least and at most so many outcomes.
STRENGTH = (1.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    text = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, mean: Column) -> DataFrame:
    """One row: how many outcomes a prior of this level is worth, from the spread of its members' rates.

    For a beta-binomial, E[(b - n m)^2] = n m (1 - m) (1 + (n - 1) / (k + 1)): solved for k with both sides
    summed over the members.
    """
    spread = level.select("n", (F.col("b") - F.col("n") * mean).alias("off"), (F.col("n") * mean * (1 - mean)).alias("v"))
    sums = spread.agg(F.sum(F.col("off") ** 2).alias("seen"), F.sum("v").alias("alone"), F.sum(F.col("v") * (F.col("n") - 1)).alias("pull"))
    rho = (F.col("seen") - F.col("alone")) / F.col("pull")
    k = F.when(F.col("pull") > 0, F.when(rho > 0, 1 / rho - 1).otherwise(STRENGTH[1]))
    return sums.select(F.least(F.greatest(F.coalesce(k, F.lit(STRENGTH[0])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("k"))


def reputations(outcomes: DataFrame) -> dict[str, DataFrame]:
    """outcomes: host, domain, suffix, n, b (blocked). By level: the posterior's mean and weight.

    `all` has one row, as has each level's strength; these are what the cross joins below attach.
    """
    overall = outcomes.agg(F.coalesce(F.sum("b") / F.sum("n"), F.lit(0.0)).alias("m0"))
    found, parent_key, parents = {"all": overall}, None, None
    for key, keys in (("suffix", ["suffix"]), ("domain", ["domain", "suffix"]), ("host", ["host", "domain"])):
        level = outcomes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        if parents is None:
            level = level.crossJoin(F.broadcast(overall)).withColumnRenamed("m0", "up")
        else:
            level = level.join(parents.select(parent_key, F.col("m").alias("up")), parent_key)
        strength = _strength(level, F.col("up"))
        level = level.crossJoin(F.broadcast(strength)).select(
            *keys, ((F.col("k") * F.col("up") + F.col("b")) / (F.col("k") + F.col("n"))).alias("m"), (F.col("k") + F.col("n")).alias("w")
        )
        level = written(level, f"reputation_{key}")
        found[key], parent_key, parents = level, key, level
    return found


def registered(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """domain and suffix of a host."""

    def last(k: int) -> Column:
        return F.regexp_extract(host, rf"((?:[^.]*\.){{0,{k - 1}}}[^.]*)$", 1)

    two = last(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(two, last(3)).otherwise(last(2)).alias("domain"), F.when(two, last(2)).otherwise(last(1)).alias("suffix")


def judge(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = 1.0, limit: float = 0.4, suffixes=SUFFIXES
) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation (the posterior's lower bound; null where a rule decides)."""
    host, path = split_url(F.col(url_col))
    split = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    pages = split.select("*", rule.alias("rule"), verdict.alias("says"), *registered(F.col("host"), suffixes))
    ruled, rest = pages.where("rule IS NOT NULL"), pages.where("rule IS NULL")
    outcomes = written(
        ruled.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum((F.col("says") == "block").cast("bigint")).alias("b")),
        "outcomes",
    )
    levels = reputations(outcomes)
    at = {
        k: levels[k].select(k, F.col("m").alias(f"{k}_m"), F.col("w").alias(f"{k}_w")) for k in ("host", "domain", "suffix")
    }
    # one row per host that any page without a rule has: the pages themselves meet only this
    hosts = rest.groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages"))
    rated = hosts.join(at["host"], "host", "left").join(at["domain"], "domain", "left").join(at["suffix"], "suffix", "left")
    rated = rated.crossJoin(F.broadcast(levels["all"]))
    m = F.coalesce("host_m", "domain_m", "suffix_m", "m0")
    w = F.coalesce("host_w", "domain_w", "suffix_w", F.lit(STRENGTH[0]))
    rated = rated.select("host", F.round(m - z * F.sqrt(m * (1 - m) / (w + 1)), 9).alias("reputation"))
    judged = rest.join(rated, "host", "left").select(
        "page_id", "host", "path", "rule", F.when(F.col("reputation") > limit, "block").otherwise("allow").alias("verdict"), "reputation"
    )
    return ruled.select("page_id", "host", "path", "rule", F.col("says").alias("verdict"), F.lit(None).cast("double").alias("reputation")).unionByName(judged)


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_STRENGTH_SQL = """least(greatest(coalesce(CASE WHEN sum(v * (n - 1)) > 0 THEN
    CASE WHEN (sum((b - n * up) ** 2) - sum(v)) / sum(v * (n - 1)) > 0
         THEN 1 / ((sum((b - n * up) ** 2) - sum(v)) / sum(v * (n - 1))) - 1 ELSE 1000.0 END END, 1.0), 1.0), 1000.0)"""


def _level_sql(key: str, keys: str, parent: str) -> str:
    return f"""
{key}_raw AS (SELECT *, n * up * (1 - up) AS v FROM (
  SELECT {keys}, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b FROM outcomes GROUP BY {keys}) l {parent}),
{key}_k AS (SELECT {_STRENGTH_SQL} AS k FROM {key}_raw),
{key}_rep AS (SELECT {keys}, (k * up + b) / (k + n) AS m, k + n AS w FROM {key}_raw, {key}_k)"""


_TWO = f"regexp_extract(host, '((?:[^.]*\\.)?[^.]*)$', 1) IN ({', '.join(repr(x) for x in SUFFIXES)})"
ORACLE_OP7 = f"""
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), rules(says, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}
), numbered AS (SELECT *, row_number() OVER () AS rid FROM split
), best AS (
  SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(says, length(h || p)) AS says
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid
), pg AS (
  SELECT n.*, rule, says,
    regexp_extract(host, CASE WHEN {_TWO} THEN '((?:[^.]*\\.){{0,2}}[^.]*)$' ELSE '((?:[^.]*\\.)?[^.]*)$' END, 1) AS domain,
    regexp_extract(host, CASE WHEN {_TWO} THEN '([^.]*\\.[^.]*)$' ELSE '([^.]*)$' END, 1) AS suffix
  FROM numbered n LEFT JOIN best USING (rid)
), outcomes AS (
  SELECT host, domain, suffix, count(*) AS n, sum((says = 'block')::INT) AS b FROM pg WHERE rule IS NOT NULL GROUP BY ALL
), overall AS (SELECT coalesce(sum(b) / sum(n), 0) AS m0 FROM outcomes),
{_level_sql("suffix", "suffix", ", (SELECT m0 AS up FROM overall)")},
{_level_sql("domain", "domain, suffix", "JOIN (SELECT suffix, m AS up FROM suffix_rep) USING (suffix)")},
{_level_sql("host", "host, domain", "JOIN (SELECT domain, m AS up FROM domain_rep) USING (domain)")}
SELECT page_id, pg.host, path, rule,
  CASE WHEN rule IS NOT NULL THEN says
       WHEN round(coalesce(h.m, d.m, s.m, m0) - 1.0 * sqrt(coalesce(h.m, d.m, s.m, m0) * (1 - coalesce(h.m, d.m, s.m, m0))
            / (coalesce(h.w, d.w, s.w, 1.0) + 1)), 9) > 0.4 THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN
       round(coalesce(h.m, d.m, s.m, m0) - 1.0 * sqrt(coalesce(h.m, d.m, s.m, m0) * (1 - coalesce(h.m, d.m, s.m, m0))
            / (coalesce(h.w, d.w, s.w, 1.0) + 1)), 9) END AS reputation
FROM pg, overall
LEFT JOIN host_rep h ON pg.host = h.host LEFT JOIN domain_rep d ON pg.domain = d.domain LEFT JOIN suffix_rep s ON pg.suffix = s.suffix
"""
