"""URL filters: rules by host and path, and link-graph propagation for the rest.

Rules decide the urls they fit. Every other page is judged by its host: trust spreads by
personalised PageRank from hosts with allowed pages along host edges, distrust from hosts
with blocked pages against them, each in proportion to its pages, and a host whose distrust exceeds its trust is blocked. Host
edges are hyperlinks between hosts and, with the weight of one link each way, those between a host and
the domain it is a subdomain of (as corpora with relative links have no others). Built of
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm import common

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, RATIO = 0.85, 1.0
#: PageRank ends when a round adds at most so much of what there is; rounds between two looks at it; the rounds of the SQL, more than that takes.
TOLERANCE, STEPS, SQL_ROUNDS = 1e-7, 10, 130
#: Trust and distrust that differ by less than this part of their sum are equal.
EQUAL = 1e-6
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: Tables of at most so many hosts are sent to every executor.
BROADCAST_HOSTS = 200_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def node(host: Column) -> Column:
    """A host as the graph has it: without user name and port, for pages and links alike."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and what it says, null where none does. A rule is a host and a path in one text."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, says = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(says)
    return rule, says


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts; pages: (host, html)."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("dst")).select("src", node(lower_ascii(F.col("dst"))).alias("dst"))
    links = links.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    known = pages.where("host <> ''").select(F.col("host")).distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    chain = known.where(F.size(labels) > 2).select(tails.alias("t")).select(F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("low"), F.slice("t", 2, F.size("t")).alias("high"))).alias("e")).select("e.low", "e.high").where("high is not null").distinct()
    part = chain.select(F.col("low").alias("src"), F.col("high").alias("dst"), F.lit(1).cast("long").alias("n")).unionByName(chain.select(F.col("high").alias("src"), F.col("low").alias("dst"), F.lit(1).cast("long").alias("n")))
    return links.unionByName(part).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) of personalised PageRank; seeds: (kind, host, score), kinds trust and distrust. Each kind's scores sum to 1.

    Trust follows edges (src to dst), distrust runs against them. What reaches a host without
    edges goes back to the seeds: that multiplies all scores of a kind by one number, so it is lost on the way and the sums are made 1
    at the end. Scores only grow, so their sum tells when a round adds nothing more; with damping 0.85
    that takes 100 rounds at most, whatever the graph. Every ``STEPS`` rounds the state is written to the shared folder, so
    plans stay short; a hot host's edges are split by adaptive execution, which this needs. A round is dealt over as many tasks as the
    edges need: each task of each round writes files, however few its rows.
    """
    flows = [("trust", "src", "dst"), ("distrust", "dst", "src")]
    steps = None
    for kind, a, b in flows:
        total = common.materialize(edges.groupBy(F.col(a).alias("__at")).agg(F.sum("n").alias("__all")), "totals")
        flow = edges.join(total, edges[a] == total["__at"]).select(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), (F.col("n") / F.col("__all")).alias("share"))
        steps = flow if steps is None else steps.unionByName(flow)
    n = 2 * edges.count()
    steps = common.materialize(steps, "steps", n)
    n += seeds.count()
    start = common.materialize(of_one(seeds).select("kind", "host", ((1 - damping) * F.col("score")).alias("score")), "start", n)
    state, before = start, start.agg(F.sum("score")).first()[0] or 0.0
    while True:
        after = state
        for _ in range(STEPS):
            moved = after.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
            after = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")).coalesce(common.tasks_for(n))
        after = common.materialize(after, "rank")
        if state is not start:
            common.drop(state)
        state, now = after, after.agg(F.sum("score")).first()[0] or 0.0
        if now - before <= STEPS * tolerance * now:
            return of_one(state)
        before = now


def of_one(scores: DataFrame) -> DataFrame:
    """Scores (kind, host, score) as parts of their kind's sum."""
    sums = common.materialize(scores.groupBy("kind").agg(F.sum("score").alias("__sum")), "sums")  # two rows
    return scores.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("score") / F.col("__sum")).alias("score"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed. Hosts that neither trust nor distrust reaches are allowed. Null html has no
    links. Repeated rows are judged alike and count each as a page of their host.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = common.materialize(picked.select("page_id", "host", node(F.col("host")).alias("node"), "path", rule.alias("rule"), says.alias("says")), "ruled")
    edges = common.materialize(host_edges(picked.select(node(F.col("host")).alias("host"), "html")), "edges")
    seeds = ruled.where("says is not null and node <> ''").groupBy("says", F.col("node").alias("host")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    seeds = common.materialize(seeds.select(F.when(F.col("says") == "allow", "trust").otherwise("distrust").alias("kind"), "host", "score"), "seeds")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    judged = propagate(edges, seeds).groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    blocked = common.materialize(judged.where(F.col("distrust") - ratio * F.col("trust") > EQUAL * (F.col("distrust") + F.col("trust"))).select(F.col("host").alias("__host")), "blocked")
    few = blocked.count() <= BROADCAST_HOSTS
    joined = ruled.join(F.broadcast(blocked) if few else blocked, ruled["node"] == blocked["__host"], "left")
    verdict = F.coalesce("says", F.when(F.col("__host").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle() -> str:
    """The same in DuckDB SQL over the view ``pages``."""
    rest = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda t: f"((host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}'))"
    pick = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in ordered) + " END"
    link = LINK.replace("'", "''")
    at = lambda x: f"regexp_replace(regexp_replace({x}, '^.*@', ''), ':[0-9]*$', '')"
    sql = f"""
WITH RECURSIVE split AS (SELECT page_id, {rest} AS rest, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, {low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, html FROM split),
ruled AS (SELECT *, {at("host")} AS node, {pick(0)} AS rule, {pick(1)} AS says FROM p),
links AS (SELECT src, {at(low("dst"))} AS dst FROM (SELECT {at("host")} AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM p WHERE {at("host")} <> '')),
labels AS (SELECT DISTINCT {at("host")} AS host, string_split({at("host")}, '.') AS l FROM p WHERE {at("host")} <> ''),
chain AS (SELECT DISTINCT array_to_string(l[i:], '.') AS low, array_to_string(l[i + 1:], '.') AS high FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels WHERE len(l) > 2)),
edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, 1 AS n FROM links WHERE dst <> '' AND src <> dst UNION ALL SELECT low, high, 1 FROM chain UNION ALL SELECT high, low, 1 FROM chain) GROUP BY ALL),
steps AS (SELECT 'trust' AS kind, src AS a, dst AS b, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT 'distrust', dst, src, n::DOUBLE / sum(n) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS score FROM (SELECT CASE says WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, node AS host, count(*)::DOUBLE AS n FROM ruled WHERE says IS NOT NULL AND node <> '' GROUP BY ALL)),
r AS (SELECT 0 AS i, kind, host, score FROM seeds UNION ALL SELECT any_value(r.i) + 1, r.kind, s.b, sum({DAMPING} * r.score * s.share) FROM r JOIN steps s ON s.kind = r.kind AND s.a = r.host WHERE r.i < {SQL_ROUNDS} GROUP BY r.kind, s.b),
y AS (SELECT kind, host, sum(score) AS score FROM r GROUP BY ALL),
z AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM y),
t AS (SELECT host, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS bad, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS good FROM z GROUP BY host)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN node IN (SELECT host FROM t WHERE bad - {RATIO} * good > {EQUAL} * (bad + good)) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""
    return sql
