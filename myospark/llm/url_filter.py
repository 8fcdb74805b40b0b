"""URL filter: host and path rules, and for all else trust and distrust carried over the links between hosts.

Trust is personalised PageRank from hosts whose pages the rules allow, along links; distrust is the same from hosts whose
pages the rules block, against links: who links to a blocked host is suspect. DataFrame operations alone.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, hot_keys, join_hot, join_keyed, materialize, release
from .exact_dedup import lower_ascii

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5
LINK = r"""(?i)(?:href|src)\s*+=\s*+["']?+(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s<>]++)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty where the url is null or has no ://."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*+", 0)
    upto = F.regexp_extract(rest, "^[^?#]*+", 0)
    return lower_ascii(raw), F.substring(upto, F.length(raw) + 1, F.length(upto))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(say)).otherwise(verdict)
    return text, verdict


def _hot(sizes: DataFrame) -> DataFrame | None:
    """Hosts with so many links that their rows must not meet in one task. ``sizes`` has a host and its rows."""
    known = materialize(sizes)
    found = hot_keys(known, "rows", known.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    release(known)
    return found


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank both ways over ``edges`` (src, dst, n): host, trust, distrust.

    ``seeds`` has host, trust, distrust in [0, 1]. A host passes its trust on by its links' shares and receives distrust
    from the hosts it links to by their shares of incoming links. Scores are in units of the seeds: a host without links
    keeps its own. Rounds go on until what is still to come, summed over all hosts, is below ``tolerance``: a round passes on
    at most ``damping`` of what moved in the last one. ``iterations`` stops them before. Hosts with very many links are
    joined by broadcast, so that their links stay where they are.
    """
    e = materialize(edges.where("src <> dst").select("src", "dst", "n"))
    if e.isEmpty():
        release(e)
        return seeds.select("host", "trust", "distrust")
    shares = []
    for end, name in (("src", "all_out"), ("dst", "all_in")):
        sums = e.groupBy(end).agg(F.sum("n").alias(name), F.count(F.lit(1)).alias("rows"))
        hot = _hot(sums.select(end, "rows"))
        shares.append(join_hot(e, sums.drop("rows"), [end], hot))
    out, into = shares
    both = (
        out.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all_out")).alias("wt"), F.lit(0.0).alias("wd"))
        .unionByName(into.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("all_in")).alias("wd")))
        .groupBy("a", "b").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd"))
    )
    both = materialize(both.withColumnRenamed("a", "host"))
    release(e)
    nodes = seeds.select("host").union(both.select("b")).distinct()
    seeds = materialize(nodes.join(seeds, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("s_t"), F.coalesce("distrust", F.lit(0.0)).alias("s_d")))
    ranks, last = seeds.select("host", F.col("s_t").alias("trust"), F.col("s_d").alias("distrust")), None
    hot = _hot(both.groupBy("host").agg(F.count(F.lit(1)).alias("rows")))
    for _ in count() if iterations is None else range(iterations):
        flow = join_hot(both, ranks, ["host"], hot).groupBy(F.col("b").alias("host")).agg(F.sum(F.col("trust") * F.col("wt")).alias("f_t"), F.sum(F.col("distrust") * F.col("wd")).alias("f_d"))
        step = seeds.join(flow, "host", "left").join(ranks, "host").select(
            "host",
            (F.col("s_t") + damping * F.coalesce("f_t", F.lit(0.0))).alias("trust"),
            (F.col("s_d") + damping * F.coalesce("f_d", F.lit(0.0))).alias("distrust"),
            F.abs(F.col("s_t") + damping * F.coalesce("f_t", F.lit(0.0)) - F.col("trust")).alias("moved_t"),
            F.abs(F.col("s_d") + damping * F.coalesce("f_d", F.lit(0.0)) - F.col("distrust")).alias("moved_d"),
        )
        after = materialize(step)
        moved = max(v or 0.0 for v in after.agg(F.sum("moved_t"), F.sum("moved_d")).first())
        if last is not None:
            release(last)
        last, ranks = after, after.select("host", "trust", "distrust")
        if moved * damping / (1 - damping) < tolerance:
            break
    return ranks


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many pages of a host link to another host. ``pages`` has host and html."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: lower_ascii(h)))
    return pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(hosts).alias("dst")).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: list[tuple[str, str, str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits decides. Pages without one follow their host: block where its distrust exceeds its trust by
    ``threshold`` or more, in units of a host all of whose pages the rules block; else allow. Hosts that no score reaches,
    and pages without a host (null urls or none with ://), are allowed. Null html has no links. Repeated rows are all
    judged; an empty table gives an empty result; other columns are not read.
    """
    rules = RULES if rules is None else rules
    host, path = host_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), said.alias("said"))
    share = lambda v: (F.count_if(F.col("said") == v) / F.count(F.lit(1)))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagate(host_links(split), seeds)
    blocked = ranks.where(F.col("distrust") - F.col("trust") >= threshold).select("host", F.lit(True).alias(P + "bad"))
    out = join_keyed(ruled.drop("html"), blocked, "host")
    verdict = F.coalesce("said", F.when(F.col(P + "bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
