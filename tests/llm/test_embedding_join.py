from __future__ import annotations

import numpy as np
import pytest

from weftgraph.llm import embedding_join


def brute(rows, cosine=0.9):
    vectors = [None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, np.float32).astype(float) for _, v in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None and len(vectors[i]) == len(vectors[j])
               and vectors[i] @ vectors[j] >= cosine * np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])] for i in range(n)]
    out = []
    for i, (name, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in linked[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((name, len(linked[i]), min(names) if names and linked[i] else name))
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = [tuple(r) for r in embedding_join.link(frame, **options).select("id", "n_links", "component_id").collect()]
    assert sorted(found, key=str) == sorted(brute(rows), key=str)


def clusters(seed: int, dim: int, n: int = 260, spread: float = 0.25):
    """Groups of very different tightness, chains among them, in a space whose axes differ in variance."""
    rng = np.random.default_rng(seed)
    scale = 0.97 ** np.arange(dim)
    centres = rng.normal(size=(25, dim)) * scale
    rows = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, dim)) * spread * rng.random((n, 1)) * scale
    return [(i, [float(x) for x in np.float32(r * rng.choice([0.01, 1, 50]))]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "dim"), [(1, 64), (2, 40)])
def test_links_are_those_of_all_pairs(spark, seed, dim):
    check(spark, clusters(seed, dim))


def test_links_in_many_cells_and_parts(spark):
    check(spark, clusters(3, 64), cell=16)


def test_links_with_narrow_blocks(spark):
    check(spark, clusters(4, 64, 150), axes=4, cell=32)


def test_a_flat_space(spark):
    """All vectors in a plane: blocks without variance get no budget."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2, 32))
    check(spark, [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.normal(size=(80, 2)) @ base)], cell=16)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, -1.0]), (10, [-1.0, 0.0]), (11, [0.0, 1e-30]), (12, [0.0, 3e30]),
        (13, [1.0, 0.0]),
    ]
    check(spark, rows)


def test_empty_table_and_other_columns(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "y")], "vec_id long, embedding array<double>, key string")
    assert embedding_join.link(frame.limit(0)).count() == 0
    assert {tuple(r) for r in embedding_join.link(frame).select("id", "n_links", "component_id").collect()} == {(1, 1, 1), (2, 1, 1)}


def test_regions_hold_all_within_the_budget():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 3))
    tree = embedding_join.Tree(points[:200], 8)
    own = np.empty(400, int)
    for rows, leaf, mine in tree.near(points, 0.0):
        own[rows[mine]] = leaf
    visits = {(r, leaf) for rows, leaf, _ in tree.near(points, 0.09) for r in rows.tolist()}
    close = ((points[:, None] - points[None]) ** 2).sum(2) <= 0.09
    assert tree.leaves == 8 and all((i, own[j]) in visits for i, j in zip(*np.nonzero(close), strict=True))
