import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from myospark.llm import common
from myospark.llm.mixing import poisson_count, poisson_mix
from myospark.llm.url_filter import RULES, host_links, judge, propagate


def brute_count(seed, doc_id, rate):
    ident = doc_id if doc_id is not None else ""
    parts, total = max(1, math.ceil(rate / 500)), 0
    for j in range(parts if rate > 0 else 0):
        u = int(hashlib.md5((f"{seed}:part:{ident}:{j}" if j else f"{seed}:{ident}").encode()).hexdigest()[:13], 16) / 2**52
        mean, k = rate / parts, 0
        p = cum = math.exp(-mean)
        while u >= cum and k < math.ceil(mean + 10 * math.sqrt(mean) + 20):
            k += 1
            p *= mean / k
            cum += p
        total += k
    return total


@pytest.mark.parametrize("rate", [499.0, 501.0, 1000.0, 5000.0])
def test_poisson_at_any_rate(spark, rate):
    n = 400
    rows = spark.range(n).select("id", poisson_count(F.lit(13), F.col("id").cast("string"), F.lit(rate)).alias("n")).collect()
    counts = [r["n"] for r in rows]
    assert counts[:20] == [brute_count(13, i, rate) for i in range(20)]
    mean = sum(counts) / n
    variance = sum((c - mean) ** 2 for c in counts) / (n - 1)
    assert abs(mean - rate) < 5 * math.sqrt(rate / n)
    assert 0.65 < variance / rate < 1.45  # five deviations of the variance of 400 Poisson numbers


def test_poisson_sql_at_high_rates(spark):
    import duckdb

    from myospark.llm.queries import OP8_SQL

    docs = spark.createDataFrame([(i, f"t{i}", "big" if i else "small") for i in range(6000)], "doc_id long, text string, source string")
    ours = poisson_mix(docs, alpha=0.5).count()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert con.sql(f"SELECT count(*) FROM ({OP8_SQL})").fetchall()[0][0] == ours
    raised = OP8_SQL.replace("(SELECT sum(n) FROM n)::DOUBLE *", "700 * (SELECT sum(n) FROM n)::DOUBLE *")
    few = docs.limit(20)
    con.register("documents", few.toPandas())
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, count(*) FROM ({raised}) GROUP BY ALL").fetchall()}
    got = {r["doc_id"]: r["count"] for r in poisson_mix(few, total=700 * 20).groupBy("doc_id").count().collect()}
    assert got == want and max(got.values()) > 1000


@pytest.mark.parametrize("most", [100_000, 1])
def test_poisson_counts(make, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    n = 400
    docs = make([f"t{i}" for i in range(n)], sources=["hot" if i % 3 else ("b" if i % 2 else None) for i in range(n)])
    sizes = Counter(r["source"] for r in docs.collect())
    want = {s: c**0.5 for s, c in sizes.items()}
    rate = {s: n * want[s] / sum(want.values()) / sizes[s] for s in sizes}
    rows = poisson_mix(docs).collect()
    got = Counter(r["doc_id"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert {i: got.get(i, 0) for i in range(n)} == {i: brute_count(13, i, rate[source[i]]) for i in range(n)}
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and [r["u"] for r in rows[:2]] == [0.5, 0.5]


def test_poisson_weights_and_edges(make):
    docs = make([f"t{i}" for i in range(300)], sources=["a"] * 100 + ["b"] * 200)
    rows = poisson_mix(docs, weights={"a": 3.0, "b": 1.0}, total=4000).collect()
    share = Counter(r["source"] for r in rows)
    assert 2700 < share["a"] < 3300 and 800 < share["b"] < 1200
    assert poisson_mix(docs, weights={"a": 1.0}).where("source = 'b'").count() == 0
    assert poisson_mix(docs, weights={}).count() == 0
    assert poisson_mix(make([])).count() == 0
    twice = poisson_mix(make(["x", "x"], ids=[1, 1]), total=40).groupBy("doc_id", "copy").count().collect()
    assert {r["count"] for r in twice} == {2}
    many = poisson_mix(make(["x"]), total=5000).count()
    assert 4600 < many < 5400
    with pytest.raises(ValueError):
        poisson_mix(docs, weights={"a": -1})


def brute_rule(host, path):
    best = None
    for say, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, say)
    return best


URLS = ["http://A.Example.NET/en/x?q", "https://x.net", "https://x.net/", "ftp://example.com/de/1#f", "//nope/", None, "", "http://deep.example.com/de", "https://fr.org/fr/", "http://org/fr/?a=1/b", "http://knet/en/", "http://h?x=/de/", "x://y://example.net/en/"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:cut].translate(fold), rest[cut:end]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "clash", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string, host string")
    got = {r["page_id"]: r for r in judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        rule = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule[0] if rule else None)
        if rule:
            assert got[i]["verdict"] == rule[1]
    assert judge(pages.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/p">x</a>' for h in hosts)
    rows = [("http://bad.net/1", link("bad.net")), ("http://spam.info/1", link("bad.net", "bad.net")), ("http://spam.info/2", link("bad.net")), ("http://clean.info/1", link("nice.info")), ("http://good.org/fr/1", link("mixed.info")), ("http://mixed.info/1", link("bad.net", "other.info"))]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in judge(pages, threshold=0.3).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    edges = host_links(pages.selectExpr("regexp_extract(url, '//([^/]*)', 1) AS host", "html"))
    assert {(r["src"], r["dst"]): r["n"] for r in edges.collect()}[("spam.info", "bad.net")] == 2


def test_propagate_against_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1), ("e", "e", 5)]
    seeds = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 0.5), "d": (0.0, 0.0), "e": (0.2, 1.0)}
    got = {r["host"]: (r["trust"], r["distrust"]) for r in propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), iterations=6, tolerance=0.0).collect()}
    e = [x for x in edges if x[0] != x[1]]
    t, d = ({h: s[k] for h, s in seeds.items()} for k in (0, 1))
    for _ in range(6):
        t, d = (
            {h: seeds[h][0] + 0.85 * sum(t[a] * n / sum(x[2] for x in e if x[0] == a) for a, b, n in e if b == h) for h in seeds},
            {h: seeds[h][1] + 0.85 * sum(d[b] * n / sum(x[2] for x in e if x[1] == b) for a, b, n in e if a == h) for h in seeds},
        )
    for h in seeds:
        assert got[h] == pytest.approx((t[h], d[h]))


def test_propagate_until_converged(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 0.0, 0.15), ("b", 0.0, 0.0)], "host string, trust double, distrust double")
    got = {r["host"]: r["distrust"] for r in propagate(edges, seeds, tolerance=0.02).collect()}
    assert got == pytest.approx({"a": 0.15 / (1 - 0.85**2), "b": 0.85 * 0.15 / (1 - 0.85**2)}, abs=0.02)


@pytest.mark.parametrize("hot_rows", [10_000, 0])
def test_judge_against_brute_force(spark, monkeypatch, hot_rows):
    """Every verdict of a linked web: rules, shares of ruled pages, trust and distrust summed until nothing moves."""
    import random
    import re

    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)  # at 0 every host counts as hot
    rng = random.Random(11)
    hosts = [f"bad{i}.net" for i in range(4)] + [f"site{i}.info" for i in range(25)] + ["www.example.net", "a.example.com", "good.org"]
    rows = []
    for i in range(260):
        host = rng.choice(hosts)
        to = rng.sample(hosts[:4] if host in hosts[4:16] and rng.random() < 0.8 else hosts, rng.randrange(0, 4))
        html = "".join(f'<a href="http://{h.upper() if rng.random() < 0.2 else h}/x">x</a>' for h in to)
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'fr', 'x'])}/{i}", html if i % 17 else None))
    rows += [(990, None, '<a href="//bad0.net/">x</a>'), (991, "no scheme", ""), (0, "http://site0.info/again", "")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).na.fill("-", ["rule"]).collect())

    parts = [(i, *split(u), html) for i, u, html in rows]
    said = [brute_rule(h, p) if h else None for _, h, p, _ in parts]
    pages, ruled = Counter(), Counter()
    links = Counter()
    for (_, h, _, html), rule in zip(parts, said, strict=True):
        if h:
            pages[h] += 1
            if rule:
                ruled[h, rule[1]] += 1
            for dst in {x.lower() for x in re.findall(r'href="(?:http:)?//([^/"]+)', html or "")}:
                if dst != h:
                    links[h, dst] += 1
    nodes = set(pages) | {b for _, b in links}
    seed = {h: (ruled[h, "allow"] / pages[h], ruled[h, "block"] / pages[h]) if pages[h] else (0.0, 0.0) for h in nodes}
    out_n, in_n = Counter(), Counter()
    for (a, b), n in links.items():
        out_n[a] += n
        in_n[b] += n
    t, d = {h: seed[h][0] for h in nodes}, {h: seed[h][1] for h in nodes}
    for _ in range(400):
        nt, nd = {h: seed[h][0] for h in nodes}, {h: seed[h][1] for h in nodes}
        for (a, b), n in links.items():
            nt[b] += 0.85 * t[a] * n / out_n[a]
            nd[a] += 0.85 * d[b] * n / in_n[b]
        t, d = nt, nd
    assert all(abs(d[h] - t[h] - 0.5) > 1e-3 for h in nodes)
    want = sorted((i, h, p, rule[0] if rule else "-", rule[1] if rule else "block" if h and d[h] - t[h] >= 0.5 else "allow") for (i, h, p, _), rule in zip(parts, said, strict=True))
    assert got == want
    by_method = [w for w in want if w[3] == "-"]
    assert sum(w[4] == "block" for w in by_method) > 20 and sum(w[4] == "allow" for w in by_method) > 20
