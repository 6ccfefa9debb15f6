"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within a squared distance of 2 - 2c. The vectors are rotated onto the axes of the second
moments of a sample and split into blocks; each block gets a share of the squared distance in proportion to its share of the
variance. A pair within the whole distance is within its budget in at least one block, so the union of the blocks' range
joins holds every link. A block's range join cuts the space into the cells of a k-d tree: a vector visits the cells whose
region is within its budget, and the pairs of two cells meet in one tile. Candidates are verified by their cosine in
double precision; a link counts in the first block whose budget holds it.

Rotation, budgets and trees are fitted on a sample of at most SAMPLE vectors and every vector is dealt by them; any rotation
and any shares of the distance are right, so the sample changes the cells' sizes and never the result. Cells larger than CELL are dealt in salted parts. Equal vectors are joined as one.

Defined results: a vector that is null, empty or zero, or that holds null or non-finite components, links with nothing;
vectors link with those of their own length only; rows with one identifier are rows like any others; null identifiers
link, but name no component unless all its identifiers are null; an empty table gives no rows; other columns (labels
among them) are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, trimmed
from weftgraph.llm.components import connected_components

COSINE = 0.9
#: Axes of a block.
AXES = 16
#: Vectors of a part of a cell; a tile holds two parts.
CELL = 16_384
#: Bounds of the sample on which the rotation and the trees are fitted: vectors, and bytes of them.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: What names a tile: its block, and its two cells with their parts.
TILE = ("block", "cell", "cell_part", "other", "other_part")
#: Blocks with less than this share of the variance get no budget.
LEAST_SHARE = 1e-4
#: Beyond rounding of the 32-bit products that choose candidates, and of the rotation.
LOOSE, TIGHT = 1e-5, 1e-9


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _key(vector: Column) -> Column:
    parts = [F.lpad(F.hex(F.xxhash64(vector, F.lit(i))), 16, "0") for i in (0, 1)]
    return F.unhex(F.concat(*parts))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the same bits whatever rows stand beside them."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * x[:, k]
    return x / np.sqrt(total)[:, None]


def _rotate(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(x.shape[1]):
        out += x[:, k : k + 1] * axes[k]
    return out


class Tree:
    """A k-d tree over one block: inner nodes split an axis at a value; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.value, self.low, self.high = [], [], [], []
        self.leaves = 0
        self._grow(sample, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        """The number of the node; leaves have numbers below 0."""
        if leaves <= 1 or len(points) < 2 or not (spread := np.ptp(points, axis=0)).any():
            self.leaves += 1
            return -self.leaves
        node, axis = len(self.axis), int(spread.argmax())
        value = float(np.median(points[:, axis]))
        for x, v in zip((self.axis, self.value, self.low, self.high), (axis, value, 0, 0), strict=True):
            x.append(v)
        below = points[:, axis] < value
        self.low[node] = self._grow(points[below], leaves // 2)
        self.high[node] = self._grow(points[~below], leaves - leaves // 2)
        return node

    def near(self, points: np.ndarray, budget: float):
        """Pairs (point, leaf) of the leaves whose region is within the budget, and whether it is the point's own."""
        root = 0 if self.axis else -1
        stack = [(root, np.arange(len(points)), np.zeros((len(points), points.shape[1])), np.zeros(len(points)))]
        while stack:
            node, rows, gaps, far = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield rows, -node - 1, far == 0
                continue
            axis = self.axis[node]
            offset = points[rows, axis] - self.value[node]
            for child, outside in ((self.low[node], offset >= 0), (self.high[node], offset < 0)):
                gap = np.where(outside, np.maximum(gaps[:, axis], np.abs(offset)), gaps[:, axis])
                distance = far - gaps[:, axis] ** 2 + gap**2
                # a point on the border is outside the lower half even at distance 0
                distance = np.where(outside & (distance == 0), np.finfo(float).tiny, distance)
                keep = distance <= budget
                moved = gaps[keep].copy()
                moved[:, axis] = gap[keep]
                stack.append((child, rows[keep], moved, distance[keep]))


class Plan:
    """The rotation, the blocks with their budgets, and their trees."""

    def __init__(self, sample: np.ndarray, cosine: float, axes_per_block: int):
        unit = _unit(sample)
        variance, axes = np.linalg.eigh(unit.T @ unit)
        order = np.argsort(-variance)
        self.axes, variance = np.ascontiguousarray(axes[:, order]), np.maximum(variance[order], 0)
        dim = len(variance)
        blocks = [range(a, min(a + axes_per_block, dim)) for a in range(0, dim, axes_per_block)]
        share = np.array([variance[list(b)].sum() for b in blocks])
        share = share / share.sum()
        kept = share >= LEAST_SHARE
        self.blocks = [b for b, k in zip(blocks, kept, strict=True) if k]
        self.budgets = (2 - 2 * cosine + TIGHT) * share[kept] / share[kept].sum()
        self.trees: list[Tree] = []
        #: By block and cell, the number of salted parts.
        self.parts: list[np.ndarray] = []

    def grow(self, sample: np.ndarray, leaves: int) -> None:
        rotated = _rotate(_unit(sample), self.axes)
        self.trees = [Tree(rotated[:, b.start : b.stop], leaves) for b in self.blocks]
        self.parts = [np.ones(tree.leaves + 1, np.int64) for tree in self.trees]

    def own(self, vectors: np.ndarray):
        """(block, leaf of each vector)."""
        rotated = _rotate(_unit(vectors), self.axes)
        for i, b in enumerate(self.blocks):
            leaf = np.zeros(len(vectors), np.int64)
            for rows, number, own in self.trees[i].near(rotated[:, b.start : b.stop], 0.0):
                leaf[rows[own]] = number
            yield i, leaf

    def tiles(self, vectors: np.ndarray, salts: np.ndarray):
        """Arrays (row, block, cell, part, other cell, other part, side) of all tiles that the vectors go to.

        The lesser of a tile's two parts comes first; ``side`` tells which of them a row belongs to.
        """
        rotated = _rotate(_unit(vectors), self.axes)
        for i, (b, (_, leaf)) in enumerate(zip(self.blocks, self.own(vectors), strict=True)):
            parts = self.parts[i]
            salt = salts % parts[leaf]
            for rows, other, _ in self.trees[i].near(rotated[:, b.start : b.stop], self.budgets[i] * (1 + TIGHT) + TIGHT):
                mine, own = leaf[rows], salt[rows]
                for part in range(int(parts[other])):
                    second = (mine > other) | ((mine == other) & (own > part))
                    yield (
                        rows, np.full(len(rows), i), np.where(second, other, mine), np.where(second, part, own),
                        np.where(second, mine, other), np.where(second, own, part), second,
                    )


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining pairs: the smallest index reachable."""
    while True:
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            return label
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (label[label] != label).any():
            label = label[label]


def _join(plan: Plan, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        block, *ends = (table.column(c)[0].as_py() for c in TILE)
        across = ends[:2] != ends[2:]
        keys = table.column("key").to_pylist()
        x = _matrix(table.column("vector"))
        weight = table.column("weight").to_numpy()
        # a tile of two parts compares one with the other, even if only one of them has rows here
        part = table.column("side").to_numpy().astype(bool)
        order = np.argsort(part, kind="stable")
        x, weight, part, keys = x[order], weight[order], part[order], [keys[i] for i in order]
        m, split = len(x), int((~part).sum())
        norm = np.sqrt((x * x).sum(axis=1))
        b, budget = plan.blocks[block], plan.budgets[block]
        # close enough to choose candidates by; what decides is computed row by row below
        scale = np.abs(x).max(axis=1, keepdims=True)
        unit = (x / scale) / np.linalg.norm(x / scale, axis=1, keepdims=True)
        y = (unit @ plan.axes[:, b.start : b.stop]).astype(np.float32)
        del unit
        half = (y * y).sum(axis=1, dtype=np.float32) / 2
        one = np.ones(m, np.float32)
        left, right = np.column_stack([y, -half, one]), np.ascontiguousarray(np.column_stack([y, one, -half]).T)
        links, label = np.zeros(m, np.int64), np.arange(m)

        def first_block(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether this is the first block whose budget holds a pair."""
            rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            rotated = _rotate(_unit(x[rows]), plan.axes)
            i, j = at[: len(i)], at[len(i) :]
            first = np.ones(len(i), bool)
            for k in range(block + 1):
                total = np.zeros(len(i))
                for axis in plan.blocks[k]:
                    gap = rotated[i, axis] - rotated[j, axis]
                    total += gap * gap
                within = total <= plan.budgets[k]
                first &= within if k == block else ~within
            return first

        step = max(1, 4_000_000 // m)
        for at in range(0, split if across else m, step):
            end = min(at + step, split if across else m)
            start = split if across else at
            close = left[at:end] @ right[:, start:] >= -(budget + LOOSE) / 2
            hit = np.flatnonzero(close.ravel())
            for few in range(0, len(hit), 200_000):
                i, j = np.divmod(hit[few : few + 200_000], m - start)
                i, j = i + at, j + start
                if not across:
                    i, j = i[i < j], j[i < j]
                dot = np.einsum("ij,ij->i", x[i], x[j])
                sure = dot >= cosine * (norm[i] * norm[j])
                i, j = i[sure], j[sure]
                mine = first_block(i, j)
                i, j = i[mine], j[mine]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                label = _connect(label, i, j)
        found = np.flatnonzero(links)
        return pa.table({
            "key": pa.array([keys[i] for i in found], pa.binary()),
            "links": pa.array(links[found]),
            "root": pa.array([keys[i] for i in label[found]], pa.binary()),
        })

    return run


def _links(scratch: Scratch, vectors: DataFrame, dim: int, count: int, cosine: float, axes: int, cell: int) -> DataFrame:
    """(key, links, root): parts of the number of links of each vector, and a vector that it is connected with."""
    leaves = 1
    while leaves * cell < count:
        leaves *= 2
    rows = min(SAMPLE, max(64, SAMPLE_BYTES // (8 * dim)))
    chosen = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) <= F.lit(int(rows / count * (1 << 20)))).limit(rows)
    sample = np.array([r[0] for r in chosen.select("vector").collect()], np.float64).reshape(-1, dim)
    plan = Plan(sample if len(sample) else np.ones((1, dim)), cosine, axes)
    plan.grow(sample if len(sample) else np.ones((1, dim)), leaves)

    def own(batches):
        for batch in batches:
            if batch.num_rows:
                for block, leaf in plan.own(_matrix(batch.column(0))):
                    number, n = np.unique(leaf, return_counts=True)
                    arrays = [pa.array([block] * len(n), pa.int32()), pa.array(number), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "leaf", "n"])

    sizes = vectors.select("vector").mapInArrow(trimmed(own), "block int, leaf long, n long")
    for block, leaf, n in sizes.groupBy("block", "leaf").agg(F.sum("n")).collect():  # a row for each cell
        plan.parts[block][leaf] = -(-n // cell)

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                for rows, *tile, side in plan.tiles(_matrix(some.column(1)), some.column(3).to_numpy()):
                    arrays = [some.column(i).take(pa.array(rows)) for i in range(3)]
                    arrays += [pa.array(x, pa.int32()) for x in tile] + [pa.array(side)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "vector", "weight", *TILE, "side"])

    salted = vectors.select("key", "vector", "weight", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)).alias("salt"))
    element = vectors.schema["vector"].dataType.simpleString()
    tiled = ", ".join(f"{c} int" for c in TILE)
    dealt = salted.mapInArrow(trimmed(deal), f"key binary, vector {element}, weight long, {tiled}, side boolean")
    return dealt.groupBy(*TILE).applyInArrow(_join(plan, cosine), "key binary, links long, root binary")


def link(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    axes: int = AXES,
    cell: int = CELL,
) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest identifier reachable by links, itself included)."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    vector = F.col(vector_col)
    keyed = vectors.select(F.col(id_col).alias("id"), vector.alias("vector"), F.when(_valid(vector), _key(vector)).alias("key"))
    rows = scratch.table(keyed.select("id", "key"), "rows")
    classes = keyed.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")
    )
    classes = scratch.table(classes, "classes")
    found = None
    for dim, count in classes.groupBy(F.size("vector")).count().collect():
        one = _links(scratch, classes.where(F.size("vector") == dim), dim, count, cosine, axes, cell)
        found = one if found is None else found.unionByName(one)
    own = classes.select("key", "least", "weight")
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = scratch.table(found, "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(scratch, found.select("key", "root"), "key", "root").withColumnRenamed("node", "key")
    own = own.join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select(
        "key", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return rows.join(named, "key", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
