"""URL verdicts: host and path rules, and trust propagated over the host link graph.

Native DataFrame code only. Rules decide where they fit. Each host then has two seeds, the
shares of its pages that allow and block rules decide. Trust is a personalised PageRank from
the first along links; distrust is one from the second against links (who links to blocked
hosts is distrusted). Both are whole numbers (``SCALE`` is 1), so sums have no order:

    score = seed * (1 - damping) + damping * sum over edges (score * links / links of the other end)

A host without a rule for a page is blocked where distrust exceeds trust and reaches
``threshold`` (as a share of what a host with nothing but blocked pages has); else allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import materialize

SCALE = 1_000_000_000
DAMPING = 85                 # hundredths
ROUNDS = 10
THRESHOLD = 50               # hundredths
#: Links to a named host in href attributes; relative links stay within their host
LINK = r"""[hH][rR][eE][fF][ \t\r\n]*=[ \t\r\n]*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"' \t\r\n>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    got = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, got).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    got = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, got).otherwise("")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict, r.host + r.path) for r in rules],
                                 "rule_host string, rule_path string, rule_verdict string, rule string")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path, ...) with the longest fitting rule and its verdict (null if none fits).

    A rule fits its host and all subdomains if the path starts with the rule's path. Of rules of
    equal length, which then differ in host and path, the one with the longer host wins."""
    if rules.count() <= BROADCAST_RULES:                  # its size is checked; longer lists are shuffled
        rules = F.broadcast(rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (places.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
            .join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path"))))
    best = fits.groupBy("host", "path").agg(F.max_by(
        F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("rule_host"))).alias("best"))
    return places.join(best, ["host", "path"], "left").select(
        *places.columns, F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def propagate(hosts: DataFrame, edges: DataFrame, seed: str, rounds: int, damping: int) -> DataFrame:
    """(host, score): ``seed`` of ``hosts`` passed along ``edges`` (src, dst, links). Edges that leave
    a host share its score in proportion to their links."""
    out = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    share = materialize(edges.join(out, "src").select("src", "dst", "links", "all_links"), "trust-edges")
    base = hosts.select("host", F.expr(f"({seed} * {100 - damping}) div 100").alias("base"))
    base = materialize(base, "trust-base")
    score = base.withColumnRenamed("base", "score")
    if share.limit(1).count() == 0:
        return score
    for _ in range(rounds):
        given = (share.join(score, F.col("src") == F.col("host"))
                 .select(F.col("dst").alias("host"), F.expr(f"(score * {damping} div 100 * links) div all_links").alias("got"))
                 .groupBy("host").agg(F.sum("got").alias("got")))
        score = materialize(base.join(given, "host", "left").select(
            "host", (F.col("base") + F.coalesce("got", F.lit(0))).alias("score")), "trust-score")
    return score


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               rounds: int = ROUNDS, damping: int = DAMPING, threshold: int = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row per input row.

    Null urls and urls without :// have an empty host and path, fit no rule, link nowhere and
    are allowed. Null html has no links. Repeated rows count as often as they occur; an empty
    table gives an empty result; other columns are ignored."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"),
                       path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    places = src.groupBy("host", "path").agg(F.count("*").alias("pages"))
    ruled = materialize(match_rules(places, rule_table(spark, rules)), "url-rules")
    in_rule = lambda v: F.sum(F.when(F.col("rule_verdict") == v, F.col("pages")).otherwise(0))
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        F.sum("pages").alias("pages"), in_rule("allow").alias("allowed"), in_rule("block").alias("blocked"))
    hosts = materialize(hosts.select("host", F.expr(f"allowed * {SCALE} div pages").alias("good"),
                                     F.expr(f"blocked * {SCALE} div pages").alias("bad")), "url-hosts")
    links = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    edges = (src.where("host <> '' and html is not null").select(F.col("host").alias("src"), links.alias("link"))
             .select("src", F.translate("link", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links")))
    known = hosts.select(F.col("host").alias("dst"))
    edges = materialize(edges.join(known, "dst", "left_semi").select("src", "dst", "links"), "url-edges")
    trust = propagate(hosts, edges, "good", rounds, damping).withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = propagate(hosts, back, "bad", rounds, damping).withColumnRenamed("score", "distrust")
    full = SCALE * (100 - damping) // 100
    judged = trust.join(distrust, "host").withColumn("host_verdict", F.when(
        (F.col("distrust") > F.col("trust")) & (F.col("distrust") * 100 >= threshold * full), "block").otherwise("allow"))
    per_place = ruled.join(judged, "host", "left").select(
        "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    per_place = materialize(per_place, "url-verdicts")
    return src.select("page_id", "host", "path").join(per_place, ["host", "path"]).select(
        "page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def oracle(rules: list[Rule], rounds: int = ROUNDS, damping: int = DAMPING, threshold: int = THRESHOLD) -> str:
    """The same in DuckDB's SQL."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ", ".join(f"({q(r.host)}, {q(r.path)}, {q(r.verdict)}, {q(r.host + r.path)})" for r in rules)
    after = "substr(url, strpos(url, '://') + 3)"
    has = "coalesce(strpos(url, '://'), 0) > 0"
    chain = []
    for name, seed, src, dst in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        chain.append(f"{name}w as materialized (select {src} as src, {dst} as dst, links, "
                     f"cast(sum(links) over (partition by {src}) as bigint) as all_links from edges)")
        chain.append(f"{name}0 as materialized (select host, {seed} * {100 - damping} // 100 as base, "
                     f"{seed} * {100 - damping} // 100 as score from hosts)")
        for i in range(1, rounds + 1):
            chain.append(f"{name}{i} as materialized (select p.host, p.base, p.base + coalesce(g.got, 0) as score from {name}{i - 1} p "
                         f"left join (select w.dst, cast(sum(s.score * {damping} // 100 * w.links // w.all_links) as bigint) as got "
                         f"from {name}w w join {name}{i - 1} s on w.src = s.host group by w.dst) g on g.dst = p.host)")
    full = SCALE * (100 - damping) // 100
    return f"""with rules(rule_host, rule_path, rule_verdict, rule) as (values {values}),
src as materialized (select page_id, html,
    case when {has} then translate(regexp_extract({after}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') else '' end as host,
    case when {has} then regexp_extract({after}, '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
fits as (select p.host, p.path, r.*, row_number() over (partition by p.host, p.path
      order by length(r.rule) desc, length(r.rule_host) desc) as n
    from (select distinct host, path from src) p join rules r
      on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)),
ruled as materialized (select s.page_id, s.html, s.host, s.path, f.rule, f.rule_verdict from src s
    left join fits f on f.n = 1 and f.host = s.host and f.path = s.path),
hosts as materialized (select host, count(*) filter (rule_verdict = 'allow') * {SCALE} // count(*) as good,
    count(*) filter (rule_verdict = 'block') * {SCALE} // count(*) as bad from ruled where host <> '' group by host),
links as (select host as src, translate(unnest(regexp_extract_all(html, {q(LINK)}, 1)), '{UPPER}', '{LOWER}') as dst
    from ruled where host <> '' and html is not null),
edges as materialized (select src, dst, count(*) as links from links
    where src <> dst and dst in (select host from hosts) group by src, dst),
{", ".join(chain)}
select r.page_id, r.host, r.path, r.rule, coalesce(r.rule_verdict, case when d.score > t.score
      and d.score * 100 >= {threshold * full} then 'block' else 'allow' end) as verdict,
    coalesce(t.score, 0) as trust, coalesce(d.score, 0) as distrust
  from ruled r left join t{rounds} t on t.host = r.host left join d{rounds} d on d.host = r.host"""
