from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.edge import ROWS, ascii_lower, documents
from weftgraph.llm import ngram_join


def sets(rows):
    out = []
    for _, text in rows:
        words = ascii_lower(text).encode().split()
        n = min(5, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    return out


def brute(rows, percent=80):
    """Sizes and component identifiers by comparing all pairs."""
    s = sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(name, len(x), least.get(find(i)) if x else name) for i, ((name, _), x) in enumerate(zip(rows, s, strict=True))]


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs, **options).collect()]
    assert sorted(found, key=str) == sorted(brute(rows, options.get("percent", 80)), key=str)


def near_copies(seed: int, n: int = 220):
    """Texts with few and many edits, chains of edits, shared passages, repeated words, and several sizes."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    texts: list[list[str]] = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                if t:
                    at = rng.randrange(len(t))
                    t[at : at + rng.choice((0, 1))] = [word()] * rng.choice((0, 1))
        elif kind < 0.65:
            t = passage + [word() for _ in range(rng.choice((1, 5, 14, 200)))]
        elif kind < 0.75:
            t = [word()] * rng.choice((1, 5, 40))
        else:
            t = [word() for _ in range(rng.choice((0, 1, 3, 4, 5, 6, 9, 30, 120, 400)))]
        texts.append(t)
    return [(i, rng.choice((" ", "\n", "\t ")).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    check(spark, near_copies(seed))


def test_components_in_dealt_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 5)
    check(spark, near_copies(3))


def test_components_by_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_HASHES", 500)
    assert len(ngram_join._bucket_keys(spark, 20_000)) == 40
    check(spark, near_copies(6))


def test_bucket_keys_are_dealt_evenly(spark):
    keys = ngram_join._bucket_keys(spark, 3 * 4 * ngram_join.BUCKET_HASHES)
    frame = spark.createDataFrame([(k,) for k in keys.tolist()], "key int")
    counts = frame.groupBy(ngram_join.F.expr("pmod(hash(key), 4)")).count().collect()
    assert [r["count"] for r in counts] == [3] * 4


def test_other_similarities(spark):
    check(spark, near_copies(4, 120), percent=60)


def test_edge_rows(spark):
    rows = [(i, t) for i, t, _ in ROWS]
    found = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(documents(spark, "key")).collect()]
    assert sorted(found, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("extra", ["key", "_own", "print"])
def test_one_of_each_group_stays(spark, extra):
    docs = documents(spark, extra)
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    expected = [(i, t, x) for (i, t, x), (_, _, c) in zip(ROWS, brute([(i, t) for i, t, _ in ROWS]), strict=True) if i == c]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    assert ngram_join.link(documents(spark).limit(0)).count() == 0 and ngram_join.keep_one(documents(spark).limit(0)).count() == 0


def test_signatures_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 200), np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.75, 0.9, 1.0])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 20), np.uint64)]))
        if len(b):
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 80 * (len(a) + len(b) - both)
            labels = ngram_join.settle([a, b], ["", ""], 80)
            assert (labels[0] == labels[1]) == linked


def test_shingles_that_fall_together_at_the_threshold(spark):
    buckets = len(ngram_join._bucket_keys(spark, 0))
    words = [f"w{i}" for i in range(300_000 * buckets)]
    h = np.concatenate(ngram_join.shingle_sets(words, 1))
    token = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    order = np.argsort(token)
    same = np.flatnonzero(token[order][1:] == token[order][:-1])[0]
    pair = [words[order[same]], words[order[same + 1]]]
    few = [*pair, *"abcdef"]
    docs = spark.createDataFrame([(1, " ".join(few)), (2, " ".join([*few, "g", "h"])), (3, "g2 h2")], "doc_id long, text string")
    found = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs, width=1).collect()}
    assert found == {1: (8, 1), 2: (10, 1), 3: (2, 3)}
