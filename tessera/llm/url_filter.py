"""URL filters: rules, and trust that spreads over the host graph.

Rules name a host and the beginning of a path; a rule fits its host and all
subdomains, and the longest rule wins. Urls without a rule are judged by their
host: trust flows from hosts that rules allow along links (personalised
PageRank), distrust flows from hosts that rules block against the links, from a
linked host to those that link to it. A host whose distrust exceeds its trust by
more than a threshold is blocked.

Host edges come from links in the pages that name a host (`http://host/`, or
`//host/`; all others stay on their own host), and from each host to its parent
domains, both ways. Linked hosts and parent domains are hosts of the graph
with or without pages, so hosts of one domain are joined. Edges are counted per
page batch before they are shuffled, so a host with a third of all pages costs no
more than another. The walks go on until the sum of all ranks' errors is less than
TOLERANCE of their mass, which takes log(TOLERANCE) / log(DAMPING) = 86 steps at
most, in runs of STEPS. A step is one join and one sum, dealt to as many tasks as
the graph's rows need, not as the pages do. Everything is joins and sums in Spark;
only sums of ranks are collected.

Nulls and edges: a null url, or one without `://`, has an empty host and path,
fits no rule and is allowed; null html has no links; repeated pages count as
often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import checkpointed
from tessera.operators.ordering import Rounds

# Host, path prefix, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING = 0.85
#: Greatest sum of all hosts' errors in a rank, where ranks sum to 1 at most.
TOLERANCE = 1e-6
#: Steps between checkpoints and tests of the ranks.
STEPS = 8
THRESHOLD = 0.0
#: Rows of the graph that a task of a step holds, about.
TASK_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The fitting rule (host and path) and its verdict, the longest first; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, weight of distinct host pairs."""
    host = host_of(F.col(url_col))
    links = (
        pages.select(
            host.alias("src"),
            F.explode(F.regexp_extract_all(html_col, F.lit(r"(?i)href=[\"']?(?:https?:)?//([^/\"'?#\s>]+)"), F.lit(1))).alias("dst"),
        )
        .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    links = checkpointed(links)
    hosts = pages.select(host.alias("host")).filter("host <> ''").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    # Parents with one label, as `com`, are not hosts of their own.
    parents = hosts.select(
        F.col("host").alias("src"),
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.size(labels) - 1, F.lit(2))),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
            )
        ).alias("dst"),
    ).filter("dst <> '' AND dst <> src AND instr(dst, '.') > 0").withColumn("weight", F.lit(1.0))
    both = links.unionByName(parents).unionByName(parents.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(nodes: DataFrame, edges: DataFrame, seeds: dict[str, tuple[str, bool]], damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host and a rank by each name: personalised PageRank that restarts at hosts in proportion to a seed column.

    seeds: by name the seed column, and whether the walk goes against the edges.
    """
    ends = lambda back: (F.col("dst"), F.col("src")) if back else (F.col("src"), F.col("dst"))
    walks = F.array(*[F.struct(F.lit(n).alias("walk"), ends(back)[0].alias("src"), ends(back)[1].alias("dst")) for n, (_, back) in seeds.items()])
    steps = edges.select("weight", F.explode(walks).alias("w")).select("w.*", "weight")
    total = steps.groupBy("walk", "src").agg(F.sum("weight").alias("out"))
    shares = checkpointed(steps.join(total, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("share")))
    mass = nodes.agg(*[F.sum(c).alias(n) for n, (c, _) in seeds.items()]).first()
    start = F.array(*[F.struct(F.lit(n).alias("walk"), ((1 - damping) * F.col(c) / max(1.0, mass[n] or 0.0)).alias("rank")) for n, (c, _) in seeds.items()])
    tasks = 1 + shares.count() // TASK_ROWS
    rounds = Rounds(nodes.sparkSession)
    state = base = checkpointed(nodes.select("host", F.explode(start).alias("s")).select("s.walk", "host", "s.rank"))
    before: dict[str, float] = {}
    while True:
        for _ in range(STEPS):
            moved = state.filter("rank > 0").join(shares, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
            state = base.unionByName(moved).coalesce(tasks).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        state = rounds.next(state)
        now = {r["walk"]: r["total"] for r in state.groupBy("walk").agg(F.sum("rank").alias("total")).collect()}
        # No rank falls from step to step, and what a run adds is at most damping ** STEPS of what the run before added.
        added = max((now[n] - before.get(n, 0.0) for n in now), default=0.0)
        if added * damping**STEPS / (1 - damping**STEPS) <= tolerance:
            break
        before = now
    return state.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("walk") == n, F.col("rank"))), F.lit(0.0)).alias(n) for n in seeds])


def judge(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    url = F.col(url_col)
    split = pages.select(page_col, host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    split = split.select("*", rule.alias("rule"), ruled.alias("ruled"))
    # Seeds: the pages of a host that rules allow or block, of all its pages.
    nodes = checkpointed(
        split.filter("host <> ''")
        .groupBy("host")
        .agg(
            F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trusted"),
            F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked"),
        )
    )
    edges = checkpointed(host_edges(pages, url_col, html_col))
    judged = propagate(nodes, edges, {"trust": ("trusted", False), "distrust": ("blocked", True)})
    verdict = F.coalesce(
        "ruled",
        F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > threshold, "block").otherwise("allow"),
    )
    # Written, so that a host with a third of all pages can be split in the join.
    return split.join(checkpointed(judged), "host", "left").select(page_col, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
