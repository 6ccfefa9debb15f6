from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import url_lists

DAY = dt.date(2024, 1, 1)
HOSTS = ["a.com", "x.a.com", "y.x.a.com", "b.org", "a.com.", "A.COM", "u:p@b.org", "b.org:80"]
PATHS = ["", "/", "/p", "/p/", "/p/q", "/p/q/r.html", "//", "/p?x=/z/", "#/p/"]


def patterns(url):
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)", url or "")
    if not m:
        return set()
    host = re.sub(r"\.$", "", m[1].lower())
    labels = host.split(".")
    parts = m[2].split("/")
    return {".".join(labels[i:]) for i in range(len(labels))} | {host + "/".join(parts[:i]) + "/" for i in range(2, len(parts))}


def brute(url, day, log):
    """Replays the log for one capture."""
    state = {}
    for pattern, action, at in sorted((e for e in log if None not in e), key=lambda e: (e[2], e[1])):
        if day is not None and at <= day:
            state[pattern] = (action, at)
    hits = [(len(p), p, *state[p]) for p in patterns(url) if p in state and state[p][0] != "remove"]
    if day is None or not hits:
        return ("none", None, None, 0)
    _, rule, verdict, since = max(hits)
    return (verdict, rule, since, len(hits))


@pytest.fixture(scope="module")
def world():
    rng = random.Random(11)
    day = lambda: DAY + dt.timedelta(days=rng.randrange(12))
    names = ["a.com", "x.a.com", "com", "org", "b.org", "a.com/p/", "b.org/p/q/", "x.a.com/p/", "b.org//"]
    log = [(rng.choice(names), rng.choice(("allow", "block", "remove")), day()) for _ in range(60)]
    log += [(None, "block", DAY), ("a.com", None, DAY), ("a.com", "block", None), ("a.com", "odd", DAY)]
    captures = [(i, f"{rng.choice(('http', 'https'))}://{rng.choice(HOSTS)}{rng.choice(PATHS)}", day()) for i in range(400)]
    captures += [(900, None, DAY), (901, "", DAY), (902, "not a url", DAY), (903, "http://a.com/", None), (904, "http://a.com/" + "p/" * 300, DAY)]
    captures += [(0, *captures[0][1:])] * 3 + [(None, *captures[1][1:])]
    return captures, [e for e in log if e[1] != "odd"], log


@pytest.mark.parametrize("few", [True, False])
def test_verdicts_are_those_of_replaying_the_log(spark, world, monkeypatch, few):
    monkeypatch.setattr(url_lists, "BROADCAST_INTERVALS", 100_000 if few else 0)
    captures, log, raw = world
    frame = spark.createDataFrame([(*c, "z") for c in captures], "page_id long, url string, day date, verdict string")
    entries = spark.createDataFrame(raw, "pattern string, action string, day date")
    found = url_lists.judge(frame, entries)
    assert found.columns == ["page_id", "url", "day", "verdict", "rule", "since", "n_active"]
    expected = [(*c, *brute(c[1], c[2], log)) for c in captures]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_clashing_names(spark, world):
    frame = spark.createDataFrame([(1, "http://a.com/", DAY, "k")], "page_id long, url string, day date, pattern string")
    entries = spark.createDataFrame([("a.com", "block", DAY)], "pattern string, action string, day date")
    row = url_lists.judge(frame, entries).first()
    assert (row["pattern"], row["verdict"], row["rule"]) == ("k", "block", "a.com")


def test_moments_of_a_day(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    log = [("a.com", "block", at(3)), ("a.com", "remove", at(9)), ("[::1]", "block", at(5)), ("1]", "block", at(1))]
    captures = [(i, u, at(h)) for i, (u, h) in enumerate(
        [("http://a.com/", 2), ("http://a.com/", 3), ("http://a.com/x", 8), ("http://a.com/", 9), ("http://[::1]:80/p", 6), ("http://u@[::1]/", 4)]
    )]
    found = url_lists.judge(
        spark.createDataFrame(captures, "page_id long, url string, day timestamp"), spark.createDataFrame(log, "pattern string, action string, day timestamp")
    )
    verdicts = {r["page_id"]: (r["verdict"], r["rule"]) for r in found.collect()}
    none = ("none", None)
    assert [verdicts[i] for i in range(6)] == [none, ("block", "a.com"), ("block", "a.com"), none, ("block", "[::1]"), none]


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "http://a.com/", DAY)], "page_id long, url string, day date")
    entries = spark.createDataFrame([("a.com", "block", DAY)], "pattern string, action string, day date")
    assert url_lists.judge(frame, entries.limit(0)).first()["verdict"] == "none"
    assert url_lists.judge(frame.limit(0), entries).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "http://a.com/", DAY)], "page_id long, url string, day date")
    entries = frame.select(F.lit("a.com").alias("pattern"), F.lit("block").alias("action"), "day")
    plan = url_lists.judge(frame, entries)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
