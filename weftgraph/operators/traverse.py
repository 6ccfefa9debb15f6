"""Graph traversals as frontier joins, all seeds in one job.

The adjacency is written once for a walk of several hops. A hop joins the frontier with it, drops what was reached before with
an anti-join and is checkpointed; depth is bounded, so a traversal is a bounded number of jobs whatever the size of the graph.
A frontier that has been counted and found small is broadcast: links then stay where they are, and a hub's links, which lie in
all partitions, are worked on by all tasks. A larger one is joined by shuffling, where adaptive execution splits hubs. Excluded
types are filtered before the walk where the walk must not use them, and after it where it may.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators.graph import Graph, cut, has_label, kept_types, undirected

MAX_NEIGHBORS = 50
#: Rows of a frontier, or of what was reached, that are broadcast (under 100 bytes each).
BROADCAST_FRONTIER = 100_000
#: Buckets of a model's neighbours, first match first: name, labels, and the types that it is limited to.
MODEL_BUCKETS = (
    ("developed_by", ("AICompany", "Organization"), ()),
    ("architecture", ("Architecture",), ()),
    ("techniques", ("Technique",), ()),
    ("benchmarks", ("Benchmark",), ()),
    ("datasets", ("Dataset",), ()),
    ("related_models", ("AIModel",), ("FINE_TUNED_FROM", "SUCCEEDED_BY", "SIMILAR_TO")),
    ("applications", ("Application",), ()),
)


def adjacency(relationships: DataFrame, direction: str = "both") -> DataFrame:
    """(src, dst, type) as a walk in that direction sees it."""
    edges = relationships.select("src", "dst", "type")
    if direction == "both":
        return undirected(relationships)
    if direction == "in":
        return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    if direction == "out":
        return edges
    raise ValueError(f"direction must be both, out or in, not {direction!r}")


def _links(relationships: DataFrame, direction: str, depth: int) -> DataFrame:
    """(id, _next) of the adjacency in that direction; written first if several hops read it, each relationship once, and
    turned round as it is read."""
    rels = adjacency(relationships, "out" if direction == "both" else direction)
    pairs = rels.select(F.col("src").alias("id"), F.col("dst").alias("_next"))
    pairs = cut(pairs) if depth > 1 else pairs
    if direction != "both":
        return pairs
    ends = F.array(F.struct("id", "_next"), F.struct(F.col("_next").alias("id"), F.col("id").alias("_next")))
    return pairs.select(F.explode(ends).alias("e")).select("e.id", "e._next")


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_FRONTIER else frame


def _walk(start: DataFrame, links: DataFrame, keys: Sequence[str], depth: int, done: int = 0) -> DataFrame:
    """Nodes reached from start (keys..., id, dist), which is ``done`` hops away, each at its least distance."""
    reached = frontier = cut(start)
    rows = total = frontier.count()
    for hop in range(done + 1, depth + 1):
        if not rows:
            break
        following = links.join(_small(frontier, rows), "id").select(*keys, F.col("_next").alias("id")).distinct()
        following = following.join(_small(reached.select(*keys, "id"), total), [*keys, "id"], "left_anti")
        frontier = cut(following.withColumn("dist", F.lit(hop)))
        rows = frontier.count()
        reached, total = reached.unionByName(frontier), total + rows
    return reached


def distances(
    relationships: DataFrame, seeds: DataFrame, depth: int, *, direction: str = "both", excluded: Sequence[str] = ()
) -> DataFrame:
    """(seed, id, dist) of all nodes within depth hops of each seed (a frame with a column id), seeds included."""
    return _distances(_links(kept_types(relationships, excluded), direction, depth), seeds, depth)


def _distances(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    return _walk(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("dist", F.lit(0)), links, ["seed"], depth)


def distance_to_any(
    relationships: DataFrame, seeds: DataFrame, depth: int, *, excluded: Sequence[str] = ()
) -> DataFrame:
    """(id, dist): the least distance to any seed; one frontier for all seeds."""
    start = seeds.select("id").distinct().withColumn("dist", F.lit(0))
    return _walk(start, _links(kept_types(relationships, excluded), "both", depth), [], depth)


#: Targets at most whose own surroundings are searched.
FEW_TARGETS = 100


def distance_between(
    relationships: DataFrame, seeds: DataFrame, targets: DataFrame, depth: int, *, excluded: Sequence[str] = ()
) -> DataFrame:
    """(id, dist) of the targets within depth hops of any seed, as ``distance_to_any`` has them.

    The search ends where all targets are met. Few targets are walked from as well, always from the side whose frontier is
    smaller: when the sides have gone as far as the distance together, their outermost nodes meet.
    """
    links = _links(kept_types(relationships, excluded), "both", depth)
    # of each side the keys of a walk and its frontier
    sides = [
        [[], cut(seeds.select("id").where("id IS NOT NULL").distinct())],
        [["seed"], cut(targets.select(F.col("id").alias("seed"), "id").where("id IS NOT NULL").distinct())],
    ]
    rows = [frame.count() for _, frame in sides]
    waiting, few, found = rows[1], rows[1] <= FEW_TARGETS, None
    reached, total = [frame for _, frame in sides], list(rows)
    for hop in range(depth + 1):
        if hop:
            at = 1 if few and rows[1] < rows[0] else 0
            keys, frontier = sides[at]
            following = links.join(_small(frontier, rows[at]), "id").select(*keys, F.col("_next").alias("id")).distinct()
            following = cut(following.join(_small(reached[at], total[at]), [*keys, "id"], "left_anti"))
            sides[at][1], rows[at] = following, following.count()
            reached[at], total[at] = reached[at].unionByName(following), total[at] + rows[at]
        small = 0 if rows[0] <= rows[1] else 1
        ends = [_small(frame, rows[i]) if i == small else frame for i, (_, frame) in enumerate(sides)]
        met = cut(ends[1].join(ends[0], "id").select(F.col("seed").alias("id")).distinct().withColumn("dist", F.lit(hop)))
        hits = met.count()
        found = met if found is None else found.unionByName(met)
        waiting -= hits
        if hits:
            left = sides[1][1].join(_small(met.select(F.col("id").alias("seed")), hits), "seed", "left_anti")
            sides[1][1] = left = cut(left)
            rows[1] = left.count()
        if not waiting or not all(rows):
            break
    return found


def neighbors(
    graph: Graph,
    seeds: DataFrame,
    depth: int = 1,
    *,
    direction: str = "both",
    types: Sequence[str] | None = None,
    excluded: Sequence[str] = ("MENTIONS",),
    limit: int | None = MAX_NEIGHBORS,
) -> DataFrame:
    """Nodes within depth hops: seed, id, name, description, labels, relationship (type of the first hop), dist.

    A node has a row for each type by which a walk to it can begin, at the least distance of such a walk.
    """
    rels = kept_types(graph.relationships, excluded)
    if types:
        rels = rels.where(F.col("type").isin(list(types)))
    links = adjacency(rels, direction)
    seeds = cut(seeds.select("id").distinct())
    asked = _small(seeds.withColumnRenamed("id", "seed"), seeds.count())
    first = links.join(asked, F.col("src") == F.col("seed")).select("seed", F.col("type").alias("relationship"), F.col("dst").alias("id"))
    start = first.distinct().withColumn("dist", F.lit(1))
    found = _walk(start, _links(rels, direction, depth - 1), ["seed", "relationship"], depth, 1).where("id <> seed")
    named = found.join(graph.nodes, "id").select(
        "seed", "id", F.coalesce("name", "id").alias("name"), "description", "labels", "relationship", "dist"
    )
    if limit is None:
        return named
    # the optimizer limits each task's rows of a seed before they meet
    place = F.row_number().over(_by_seed())
    return named.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def _by_seed():
    return Window.partitionBy("seed").orderBy("dist", "id", "relationship")


class Subgraph(NamedTuple):
    """nodes and relationships kept, bridges between seeds, and (seed, id) of all nodes reached."""

    nodes: DataFrame
    relationships: DataFrame
    bridges: DataFrame
    by_seed: DataFrame


def _edges_within(relationships: DataFrame, reached: DataFrame, depth: int, edges: str) -> DataFrame:
    """The relationships inside the expansion of any seed. A node has one row with its seeds, so that a relationship isn't
    multiplied by them.

    "induced": both ends reached; "trail": an end closer than depth, so that a walk of that length can hold it.
    """
    if edges not in ("induced", "trail"):
        raise ValueError(f"edges must be induced or trail, not {edges!r}")
    marks = reached.groupBy("id").agg(F.collect_list(F.struct("seed", "dist")).alias("_m"))
    a = marks.select(F.col("id").alias("src"), F.col("_m").alias("_a"))
    b = marks.select(F.col("id").alias("dst"), F.col("_m").alias("_b"))
    near = lambda x, y: F.least(x["dist"], y["dist"]) < depth if edges == "trail" else F.lit(True)
    both = F.exists("_a", lambda x: F.exists("_b", lambda y: (x["seed"] == y["seed"]) & near(x, y)))
    return relationships.join(a, "src").join(b, "dst").where(both).select(*relationships.columns)


def expand(
    graph: Graph, seeds: DataFrame, depth: int = 3, *, excluded: Sequence[str] = ("MENTIONS",), edges: str = "induced"
) -> Subgraph:
    """All seeds' surroundings merged: what takes part in a kept relationship, and nodes that join several seeds.

    Walks use excluded types too; relationships of those types are dropped afterwards. Bridges are kept nodes, other than
    seeds, that at least two seeds reach.
    """
    reached = cut(distances(graph.relationships, seeds, depth))
    rels = _edges_within(kept_types(graph.relationships, excluded), reached, depth, edges)
    rels = cut(rels.dropDuplicates(["src", "dst", "type"]))
    taking = rels.select(F.col("src").alias("id")).unionByName(rels.select(F.col("dst").alias("id")))
    kept = taking.unionByName(seeds.select("id")).distinct()
    nodes = graph.nodes.join(kept, "id", "left_semi")
    shared = reached.groupBy("id").agg(F.countDistinct("seed").alias("seeds")).where("seeds >= 2")
    bridges = nodes.join(shared, "id").join(seeds.select("id"), "id", "left_anti")
    return Subgraph(nodes, rels, bridges, reached)


def subgraph(
    graph: Graph, center: DataFrame, depth: int = 2, *, excluded: Sequence[str] = ("MENTIONS",), edges: str = "induced"
) -> Subgraph:
    """A centre's surroundings, itself included; nodes reached only by excluded types stay."""
    reached = cut(distances(graph.relationships, center, depth))
    rels = _edges_within(kept_types(graph.relationships, excluded), reached, depth, edges)
    nodes = graph.nodes.join(reached.select("id").distinct(), "id", "left_semi")
    return Subgraph(nodes, rels.dropDuplicates(["src", "dst", "type"]), nodes.limit(0).withColumn("seeds", F.lit(0)), reached)


def shortest_path(
    graph: Graph, start: str, end: str, max_depth: int = 5, *, excluded: Sequence[str] = ("MENTIONS",)
) -> dict | None:
    """{"nodes": [{id, name, labels}], "relationships": [{type, start, end}]} or None; of several, the smallest parents.

    Levels remember one parent of each node; the search ends where the target is reached, and only the path's own rows
    come to the driver.
    """
    spark = graph.relationships.sparkSession
    if graph.nodes.where(F.col("id").isin(start, end)).select("id").distinct().count() < len({start, end}):
        return None
    links = adjacency(kept_types(graph.relationships, excluded))
    links = cut(links) if max_depth > 1 else links
    level = spark.createDataFrame([(start, None, None)], "id string, parent string, type string")
    levels, reached, found, rows, total = [], level, start == end, 1, 1
    while not found and len(levels) < max_depth:
        step = links.join(_small(level.select(F.col("id").alias("src")), rows), "src")
        best = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.col("src").alias("parent"), "type")).alias("p"))
        level = cut(best.select("id", "p.parent", "p.type").join(_small(reached.select("id"), total), "id", "left_anti"))
        here = level.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") == end).alias("hits")).first()
        rows, found = here["rows"], here["hits"] > 0
        if not rows:
            return None
        levels.append(level)
        reached, total = reached.unionByName(level), total + rows
    if not found:
        return None
    ids, types = [end], []
    for level in reversed(levels):
        row = level.where(F.col("id") == ids[-1]).first()
        ids.append(row["parent"])
        types.append(row["type"])
    ids.reverse()
    types.reverse()
    rows = {r["id"]: r for r in graph.nodes.where(F.col("id").isin(ids)).collect()}
    nodes = [{"id": i, "name": rows[i]["name"], "labels": list(rows[i]["labels"] or [])} for i in ids]
    hops = [{"type": t, "start": a, "end": b} for t, a, b in zip(types, ids, ids[1:], strict=False)]
    return {"nodes": nodes, "relationships": hops}


def path_length(
    relationships: DataFrame, pairs: DataFrame, max_depth: int = 5, *, excluded: Sequence[str] = ("MENTIONS",)
) -> DataFrame:
    """(start, end, length) of the pairs that are within max_depth, by two frontiers that meet half way."""
    links = _links(kept_types(relationships, excluded), "both", max_depth)
    near = _distances(links, pairs.select(F.col("start").alias("id")), (max_depth + 1) // 2)
    far = _distances(links, pairs.select(F.col("end").alias("id")), max_depth // 2)
    ahead = near.select(F.col("seed").alias("start"), "id", F.col("dist").alias("_a"))
    behind = far.select(F.col("seed").alias("end"), "id", F.col("dist").alias("_b"))
    met = pairs.select("start", "end").distinct().join(ahead, "start").join(behind, ["end", "id"])
    return met.groupBy("start", "end").agg(F.min(F.col("_a") + F.col("_b")).cast("int").alias("length"))


def find_connections(
    graph: Graph, a: str, b: str, max_depth: int = 5, *, excluded: Sequence[str] = ("MENTIONS",)
) -> dict:
    """Whether and how two nodes connect: documents and digests on the way aren't told."""
    path = shortest_path(graph, a, b, max_depth, excluded=excluded)
    if path is None:
        return {"connected": False, "path": None, "hops": -1, "description": f"No connection found between {a} and {b}."}
    told, before = [], None
    for at, node in enumerate(path["nodes"]):
        name = node["name"] or node["id"]
        if "Document" in node["labels"] or _is_digest(name):
            continue
        if before is not None:
            told.append(f" --[{path['relationships'][at - 1]['type']}]--> ")
        told.append(name)
        before = at
    visible = sum("Document" not in n["labels"] for n in path["nodes"])
    return {"connected": True, "path": path, "hops": visible - 1, "description": "".join(told)}


def _is_digest(name: str) -> bool:
    return len(name) == 32 and all(c in "0123456789abcdefABCDEF" for c in name)


def lineage(graph: Graph, origin: str, depth: int = 3, limit: int = 20) -> DataFrame:
    """Papers, models and techniques that lead to a node: id, name, labels, published, by their dates as text."""
    start = graph.relationships.sparkSession.createDataFrame([(origin,)], "id string")
    found = distances(graph.relationships, start, depth, direction="in").where("dist > 0").select("id").distinct()
    nodes = graph.entities.join(found, "id").where(has_label("labels", "Paper", "AIModel", "Technique"))
    props = F.col("props") if "props" in graph.entities.columns else F.lit(None).cast("map<string,string>")
    date = (
        F.when(F.array_contains("labels", "Paper"), F.try_element_at(props, F.lit("publication_date")))
        .when(F.array_contains("labels", "AIModel"), F.try_element_at(props, F.lit("release_date")))
    )
    dated = nodes.select("id", "name", "labels", F.coalesce(date, F.lit("1900")).alias("published"))
    return dated.orderBy("published", "id").limit(limit)


def bucket(labels: Column | str = "labels", relationship: Column | str = "relationship") -> Column:
    """The bucket of a model's neighbour; null if it is in none."""
    chosen = F.lit(None).cast("string")
    for name, wanted, types in reversed(MODEL_BUCKETS):
        hit = has_label(labels, *wanted)
        hit = hit & text.col(relationship).isin(list(types)) if types else hit
        chosen = F.when(hit, F.lit(name)).otherwise(chosen)
    return chosen


def model_neighbors(graph: Graph, model: DataFrame, *, excluded: Sequence[str] = ("MENTIONS",)) -> DataFrame:
    """A model's direct neighbours with their bucket."""
    return neighbors(graph, model, 1, excluded=excluded).withColumn("bucket", bucket()).where("bucket IS NOT NULL")


def common_neighbors(left: DataFrame, right: DataFrame, buckets: Sequence[str] = ("techniques", "benchmarks", "datasets")) -> DataFrame:
    """(bucket, common): how many neighbours two models share in each bucket, 0 included."""
    spark = left.sparkSession
    both = left.select("bucket", "id").intersect(right.select("bucket", "id")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(b,) for b in buckets], "bucket string")
    return names.join(both, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("common"))
