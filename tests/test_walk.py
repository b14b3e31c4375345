"""Walks against a plain first-in-first-out queue, and robots rules against the standard library."""

import random
from collections import deque
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from mailweave.operators import robots as R
from mailweave.operators import walk as W

# a cycle, a self link, a fragment variant, a dead link, an external link, a blocked path
GRAPH = {
    "a": ["b", "c", "a", "dead", "b"], "b": ["d", "a", "ext/x"], "c": ["b", "e", "e#top"], "d": ["c", "f"], "e": ["f", "g", "private/1"],
    "f": ["a"], "g": ["h", "i"], "h": ["j"], "i": [], "j": ["k"], "private/1": ["z"], "k": ["a"],
}
SITE = "https://s.example.edu/"


def full(name):
    return "https://other.org/" + name if name.startswith("ext/") else SITE + name


def queue_walk(graph, starts, cap, admit=lambda u: True, follow=lambda visited, u: True):
    seen, order, todo = set(), [], deque(starts)
    while todo and (cap is None or len(order) < cap):
        url = todo.popleft()
        if url in seen or not admit(url):
            continue
        seen.add(url)
        order.append(url)
        for target in graph.get(url, []):
            if target not in seen and follow(len(order), target):
                todo.append(target)
    return order


def links_of(spark, graph):
    rows = [(u, v, v, v, i) for u, vs in graph.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "url string, target string, href string, text string, pos int")


def visited(df):
    return [r["url"] for r in df.orderBy("level", "trail").collect()]


@pytest.mark.parametrize("cap", [None, 1, 3, 6, 100])
def test_walk_site_equals_a_queue(spark, cap):
    graph = {full(k): [full(x) for x in v] for k, v in GRAPH.items()}
    rules = spark.createDataFrame(
        [("s.example.edu", "*", "/private", False, 1)], "host string, agent string, path_prefix string, allow boolean, rule_no int"
    )
    seeds = spark.createDataFrame([("all", full("a"), 0), ("all", full("g"), 1)], "walk string, url string, seed_no int")
    got = W.walk_site(links_of(spark, graph), seeds, "example.edu", rules, "bot", cap)
    want = queue_walk(graph, [full("a"), full("g")], cap, lambda u: u.startswith(SITE) and "/private" not in u)
    assert visited(got) == want
    if cap:
        assert [r["ord"] for r in got.orderBy("ord").collect()] == list(range(1, len(want) + 1))


def test_many_walks_at_once_on_random_graphs(spark):
    rng = random.Random(7)
    urls = {h: [f"https://h{h}.org/{i}" for i in range(25)] for h in range(4)}
    graph = {u: [rng.choice(us + us + urls[(h + 1) % 4]) for _ in range(4)] for h, us in urls.items() for u in us[:22]}
    starts = spark.createDataFrame([(h, us[0]) for h, us in urls.items()] + [(9, None)], "dept int, web string")
    got = W.walk_hosts(links_of(spark, graph), starts, "dept", "web", 15)
    for h, us in urls.items():
        host = f"https://h{h}.org/"
        want = queue_walk(graph, [us[0]], 15, follow=lambda _, v, host=host: v.startswith(host))
        assert visited(got.filter(F.col("walk") == h)) == want


def test_relevant_links_only_after_the_first_pages(spark):
    graph = {f"https://h.org/{i}": [f"https://h.org/{i + 1}", f"https://h.org/staff{i}"] for i in range(30)}
    starts = spark.createDataFrame([(1, "https://h.org/0")], "dept int, web string")
    got = W.walk_relevant(links_of(spark, graph), starts, ("staff",), "dept", "web", 40)
    want = queue_walk(graph, ["https://h.org/0"], 40, follow=lambda n, v: "staff" in v or n < 10)
    assert visited(got) == want


def test_compaction_does_not_change_a_deep_walk(spark):
    chain = {f"https://h.org/{i}": [f"https://h.org/{i + 1}"] for i in range(7)}
    seeds = spark.createDataFrame([(1, "https://h.org/0", 0)], "walk int, url string, seed_no int")
    assert W.walk(links_of(spark, chain), seeds, None, compact_every=2).count() == 8


RULES = [
    ("h.org", "*", "/private", False, 1), ("h.org", "*", "/private/open", True, 2), ("h.org", "goodbot", "/good", False, 3), ("h.org", "goodbot", "/", True, 4),
    ("i.org", "*", "/a/open", True, 1), ("i.org", "*", "/a", False, 2), ("j.org", "*", "", False, 1),
]


def robots_text(host):
    lines, last = [], None
    for h, agent, prefix, allow, _ in RULES:
        if h == host:
            if agent != last:
                lines += ["", f"User-agent: {agent}"]
            last = agent
            lines.append(f"{'Allow' if allow else 'Disallow'}: {prefix}")
    return lines


@pytest.mark.parametrize("agent", ["bot/1.0", "GoodBot/2.0 (+x)"])
def test_robots(spark, agent):
    paths = ["/", "/private", "/private/open/x", "/good/x", "/a", "/a/open/1", "/b?x=/a", ""]
    urls = [f"https://{h}{p}" for h in ("h.org", "i.org", "j.org", "unknown.org") for p in paths]
    rules = spark.createDataFrame(RULES, "host string, agent string, path_prefix string, allow boolean, rule_no int")
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"] for r in R.allowed(df, rules, agent).collect()}
    parsers = {}
    for host in ("h.org", "i.org", "j.org"):
        parsers[host] = RobotFileParser()
        parsers[host].parse(robots_text(host))
    want = {u for u in urls if (p := parsers.get(u.split("/")[2])) and p.can_fetch(agent, u)}
    assert got == want
