from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import ROWS, documents
from weftgraph.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    scores = {r["id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(scores[r["doc_id"]] >= 0.5, r["quality"] == 1) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) >= 0.97
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    x = np.array([quality.measure(t) for t in ("One plain text. Two of them.", "A!! B!! C!!", "")])
    assert (quality.train(docs, labels).scores(x) == quality.train(docs, turned).scores(x)).all()


def test_pairs_explain_what_single_measures_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.MEASURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((500, len(quality.MEASURES)))
    model = quality.fit(x, (x[:, 2] + x[:, 3] > 1).astype(float))
    for row, score in zip(x[:20], model.scores(x[:20]), strict=True):
        total = model.base
        for j, value in enumerate(row):
            total += model.tables[j][int((model.cuts[j] <= value).sum())]
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[int((model.pair_cuts[a] <= row[a]).sum()), int((model.pair_cuts[b] <= row[b]).sum())]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_training_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id % 7 as int))").alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("cast(id % 7 > 3 as int)").alias("quality"))
    model = quality.train(docs, labels, rows=300)
    assert (model.scores(np.array([quality.measure("word " * n) for n in (1, 6)])) >= 0.5).tolist() == [False, True]


@pytest.mark.parametrize("labels", [[], [(1, 1), (5, 1)], [(1, None), (None, 0), (5, 7)]])
def test_without_labels_of_both_kinds(spark, labels):
    docs = documents(spark, "score")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = quality.score(docs, model).collect()
    assert len(found) == len(ROWS) and {r["score"] for r in found} == {0.5}
    assert quality.keep(docs, model).count() == len(ROWS)


def test_edge_rows(spark):
    docs = documents(spark, "x")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] * 2, "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = quality.score(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in scores)
    assert quality.score(docs.limit(0), model).count() == 0 and quality.keep(docs.limit(0), model).count() == 0


def plain_tree(g, h, depth):
    """A tree over ordered bins, every cut tried."""
    best, at = sum(g) ** 2 / (sum(h) + 1) + 1e-9, 0
    for i in range(1, len(g)) if depth else ():
        gain = sum(g[:i]) ** 2 / (sum(h[:i]) + 1) + sum(g[i:]) ** 2 / (sum(h[i:]) + 1)
        if gain > best + 1e-12:
            best, at = gain, i
    if not at:
        return [sum(g) / (sum(h) + 1)] * len(g)
    return plain_tree(g[:at], h[:at], depth - 1) + plain_tree(g[at:], h[at:], depth - 1)


def plain_quadrants(g, h):
    """A table of two measures cut into four, every cut tried: values by cell, and the gain."""
    rows, cols = len(g), len(g[0])
    total = lambda t, r, c: sum(t[i][j] for i in r for j in c)
    best, out = 0.0, None
    for i in range(1, rows):
        for j in range(1, cols):
            parts = [(r, c) for r in (range(i), range(i, rows)) for c in (range(j), range(j, cols))]
            gain = sum(total(g, r, c) ** 2 / (total(h, r, c) + 1) for r, c in parts)
            if gain > best + 1e-12:
                best, out = gain, {(x, y): total(g, r, c) / (total(h, r, c) + 1) for r, c in parts for x in r for y in c}
    every = range(rows), range(cols)
    return out, best - total(g, *every) ** 2 / (total(h, *every) + 1)


def plain_scores(x, y):
    """Cyclic boosting row by row: single measures in turn, then the pairs that explain most of the rest."""
    n, d = x.shape
    cut = lambda j, bins: sorted({float(np.quantile(x[:, j], q)) for q in np.linspace(0, 1, bins + 1)[1:-1]})
    bins = [[sum(c <= v for c in cut(j, quality.BINS)) for v in x[:, j]] for j in range(d)]
    coarse = [[sum(c <= v for c in cut(j, quality.PAIR_BINS)) for v in x[:, j]] for j in range(d)]
    margin = [float(np.log(y.mean() / (1 - y.mean())))] * n

    def slopes():
        p = [1 / (1 + np.exp(-m)) for m in margin]
        return [y[i] - p[i] for i in range(n)], [p[i] * (1 - p[i]) for i in range(n)]

    for _ in range(quality.ROUNDS):
        for j in range(d):
            size = len(cut(j, quality.BINS)) + 1
            g, h = ([sum(w[i] for i in range(n) if bins[j][i] == b) for b in range(size)] for w in slopes())
            tree = plain_tree(g, h, 2)
            margin = [m + quality.STEP * tree[b] for m, b in zip(margin, bins[j], strict=True)]

    def grids(a, b):
        r, c = (range(len(cut(k, quality.PAIR_BINS)) + 1) for k in (a, b))
        return [[[sum(w[i] for i in range(n) if coarse[a][i] == u and coarse[b][i] == v) for v in c] for u in r] for w in slopes()]

    gains = {(a, b): plain_quadrants(*grids(a, b))[1] for a in range(d) for b in range(a + 1, d)}
    for _ in range(quality.PAIR_ROUNDS):
        for a, b in sorted(gains, key=lambda k: (-gains[k], k))[: quality.PAIRS]:
            values = plain_quadrants(*grids(a, b))[0]
            margin = [m + quality.STEP * values[u, v] for m, u, v in zip(margin, coarse[a], coarse[b], strict=True)]
    return [1 / (1 + np.exp(-m)) for m in margin]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boosting_is_that_of_plain_python(monkeypatch, seed):
    for name, value in (("BINS", 7), ("PAIR_BINS", 4), ("ROUNDS", 6), ("PAIR_ROUNDS", 4), ("PAIRS", 2)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(70, 4)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=70) * 0.5) > 0).astype(float)
    model = quality.fit(x, y)
    assert len(model.pairs) == 2 and np.allclose(model.scores(x), plain_scores(x, y), atol=1e-9)
