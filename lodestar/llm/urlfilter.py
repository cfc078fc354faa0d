"""URL filters with trust and distrust spread over the host graph, in DataFrame operations only.

Rules decide the urls they fit. The rest is decided per host: hosts whose pages rules allow are trusted seeds, those whose
pages rules block are blocked seeds, each weighted by its number of such pages. A personalised PageRank walks from the
trusted seeds along links, another from the blocked seeds against them, so that who links to bad hosts is distrusted, too.
A host with more than ``THRESHOLD`` of both ranks' sum as distrust is blocked, any other allowed.

Links are counted per pair of hosts before anything else, so the graph has a row for each pair and not for each link, and a host with a third
of all pages is a few rows. Both walks share one table of edges. They go on until no host is new and no rank changes by more than
``TOLERANCE`` of itself. Only the final share is rounded, so small ranks of a large graph count as large ones do.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.llm.common import stage, table


class Rule(NamedTuple):
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (Rule("com", "/en/", False), Rule("example.com", "/en/7", True), Rule("net", "/de/", True), Rule("example.net", "/de/8", False), Rule("org", "/es/", False))
DAMPING, THRESHOLD = 0.85, 0.5
TOLERANCE, MOST_ROUNDS = 1e-8, 1000
#: The walk written out in SQL: rounds, and digits its ranks are rounded to.
ROUNDS, DIGITS = 8, 12
#: Rounds between two tables that cut the lineage.
STAGED = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: a link's target in a page. A tag ends where the next one begins, so a page of unclosed tags is read once.
_HREF = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?\s*([^\"'\s>]+)"


def _after(url: Column) -> Column:
    """What stands behind the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def match(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (null: none) and whether it allows."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        name, allow = F.when(fits(r, host, path), r.name).otherwise(name), F.when(fits(r, host, path), r.allow).otherwise(allow)
    return name, allow


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, counted; relative ones and those to the own host don't count."""
    links = pages.filter(F.instr(F.lower("html"), "href") > 0).select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).alias("to"))
    links = links.filter(F.col("to").rlike(r"^(?i:https?:)?//")).select(F.col("host").alias("src"), host_of(F.concat(F.lit("x:"), F.regexp_extract("to", r"//.*", 0))).alias("dst"))
    return links.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from (src, dst, n) edges and (host, good, bad) seed weights.

    With rounds None the walks go on until they are settled; after MOST_ROUNDS that is an error. A host that no walk reaches is no row. Rank that meets a host without further links goes back to the seeds.
    """
    both = edges.select(F.lit(True).alias("good"), "src", "dst", "n").unionByName(edges.select(F.lit(False).alias("good"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    outgoing = both.groupBy("good", "src").agg(F.sum("n").alias("all"))
    steps = stage(both.join(outgoing, ["good", "src"]).select("good", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")), "steps")
    start = seeds.select(F.lit(True).alias("good"), "host", F.col("good").alias("w")).unionByName(seeds.select(F.lit(False).alias("good"), "host", F.col("bad").alias("w"))).filter("w > 0")
    total = start.groupBy("good").agg(F.sum("w").alias("total"))
    start = stage(start.join(total, "good").select("good", "host", (F.col("w") / F.col("total")).alias("seed")), "start")
    now = start.select("good", "host", F.col("seed").alias("rank"))
    for k in range(MOST_ROUNDS if rounds is None else rounds):
        before = now
        moved = now.join(steps, ["good", "host"]).groupBy("good", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        kept = moved.groupBy("good").agg(F.sum("got").alias("kept"))
        back = start.join(kept, "good", "left").select("good", "host", (F.col("seed") * (1 - damping * F.coalesce("kept", F.lit(0.0)))).alias("again"))
        now = back.join(moved, ["good", "host"], "full").select("good", "host", (damping * F.coalesce("got", F.lit(0.0)) + F.coalesce("again", F.lit(0.0))).alias("rank"))
        if k % STAGED == STAGED - 1:
            now = stage(now.join(before.withColumnRenamed("rank", "was"), ["good", "host"], "left"), "ranks")
            settled = F.coalesce(F.abs(F.col("rank") - F.col("was")) <= TOLERANCE * F.col("rank"), F.lit(False))
            if rounds is None and now.filter(~settled).isEmpty():
                break
            now = now.drop("was")
    else:
        if rounds is None:
            raise RuntimeError(f"ranks are not settled after {MOST_ROUNDS} rounds")
    return now.groupBy("host").agg(F.sum(F.when(F.col("good"), F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("good"), 0.0).otherwise(F.col("rank"))).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD, rounds: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust) for every row of pages (page_id, url, html; other columns are ignored).

    A null url, or one without ``://``, has neither host nor path and fits no rule; it is allowed, as is a host without any rank.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    name, allow = match(F.col("host"), F.col("path"), rules)
    seen = own.select("page_id", "host", "path", name.alias("rule"), allow.alias("allow"))
    seeds = seen.filter("rule is not null and host <> ''").groupBy("host").agg(F.count_if("allow").cast("double").alias("good"), F.count_if(~F.col("allow")).cast("double").alias("bad"))
    rank = ranks(stage(host_edges(own), "links"), stage(seeds, "seeds"), rounds)
    hosts = stage(rank.select("host", F.round(F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)), 6).alias("distrust")), "hosts")
    out = seen.join(hosts, "host", "left")
    verdict = F.when(F.coalesce("allow", F.coalesce("distrust", F.lit(0.0)) <= threshold), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


queries = {"op2_urlfilter": op2_urlfilter}


def _sql(rounds: int = ROUNDS) -> str:
    """The same walk in SQL, its rounds written out."""
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fit = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    name = " ".join(f"WHEN {fit(r)} THEN '{r.name}'" for r in rules)
    allow = " ".join(f"WHEN rule = '{r.name}' THEN {str(r.allow).lower()}" for r in rules)
    host = f"translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    walk = []
    for k in range(rounds):
        walk.append(
            f"m{k} AS MATERIALIZED (SELECT good, dst AS host, round(sum(rank * share), {DIGITS}) AS got FROM r{k} JOIN steps USING (good, host) GROUP BY good, dst), "
            f"b{k} AS (SELECT s.good, s.host, seed * (1 - {DAMPING} * coalesce(kept, 0)) AS again FROM start s LEFT JOIN (SELECT good, sum(got) AS kept FROM m{k} GROUP BY good) x ON x.good = s.good), "
            f"r{k + 1} AS MATERIALIZED (SELECT good, host, round({DAMPING} * coalesce(got, 0) + coalesce(again, 0), {DIGITS}) AS rank FROM b{k} FULL JOIN m{k} USING (good, host))"
        )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN {host} ELSE '' END AS host, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
v AS MATERIALIZED (SELECT page_id, html, host, path, CASE {name} END AS rule FROM u), a AS MATERIALIZED (SELECT page_id, host, path, rule, CASE {allow} END AS allow FROM v),
seeds AS (SELECT host, CAST(count(*) FILTER (WHERE allow) AS DOUBLE) AS good, CAST(count(*) FILTER (WHERE NOT allow) AS DOUBLE) AS bad FROM a WHERE rule IS NOT NULL AND host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^<>]*?href\\s*=\\s*[\"'']?\\s*([^\"''\\s>]+)', 1))) AS target FROM v),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(target, '^(?:[hH][tT][tT][pP][sS]?:)?//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst FROM l WHERE regexp_matches(target, '^(?i:https?:)?//')) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
both_ AS (SELECT true AS good, src AS host, dst, n FROM edges UNION ALL SELECT false, dst, src, n FROM edges),
steps AS (SELECT good, host, dst, n / sum(n) OVER (PARTITION BY good, host) AS share FROM both_),
weights AS (SELECT true AS good, host, good AS w FROM seeds WHERE good > 0 UNION ALL SELECT false, host, bad FROM seeds WHERE bad > 0),
start AS MATERIALIZED (SELECT good, host, w / sum(w) OVER (PARTITION BY good) AS seed FROM weights), r0 AS (SELECT good, host, seed AS rank FROM start),
{", ".join(walk)},
t AS (SELECT host, sum(CASE WHEN good THEN rank ELSE 0 END) AS trust, sum(CASE WHEN good THEN 0 ELSE rank END) AS distrust FROM r{rounds} GROUP BY host),
f AS (SELECT host, round(distrust / nullif(trust + distrust, 0), 6) AS distrust FROM t)
SELECT page_id, a.host, path, rule, CASE WHEN coalesce(allow, coalesce(distrust, 0.0) <= {THRESHOLD}) THEN 'allow' ELSE 'block' END AS verdict, coalesce(distrust, 0.0) AS distrust FROM a LEFT JOIN f ON f.host = a.host
"""


oracle_sql = {"op2_urlfilter": _sql()}
