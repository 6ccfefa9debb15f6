"""Sharding by extendible hashing.

A row's shard is a prefix of the bits of its key's hash. The directory starts from no bits; only buckets over the byte
limit split on another bit, until each fits. Sums per bucket are taken for several depths at once from one fine histogram
(pre-aggregated before its shuffle), and only the rows of buckets that are still too large are summed again, deeper. A
bucket of one key's repeated rows can't split on its key's bits: it goes on with bits of the row's number, below a "+".

Defined results: null text counts as empty (0 bytes); null keys hash like empty text; a single row over the limit is a
shard of its own; an empty table has no shards; extra columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, fresh

LIMIT = 64 << 20
BITS = 60
#: Bits by which a level looks deeper than the sizes suggest.
AHEAD = 6


def hash_bits(key: Column) -> Column:
    """60 bits of the key's MD5."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth) -> Column:
    return F.shiftrightunsigned(bits, F.lit(BITS) - depth) if not isinstance(depth, int) else F.shiftrightunsigned(
        bits, BITS - depth
    )


def _label(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, "0"))


def _level(rows: DataFrame, start: int, stop: int, limit: int) -> DataFrame:
    """Buckets of all depths from start to stop that exist: parent, depth, prefix, size, n, alone, splits."""
    fine = rows.groupBy("parent", F.shiftrightunsigned("bits", BITS - stop).alias("fine")).agg(
        F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("n"),
        F.min("bits").alias("low"),
        F.max("bits").alias("high"),
    )
    deep = fine.select("*", F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("depth"))
    prefix = F.expr(f"shiftrightunsigned(fine, {stop} - depth)")
    buckets = deep.groupBy("parent", "depth", prefix.alias("prefix")).agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return buckets.withColumn("splits", (F.col("size") > limit) & (F.col("low") != F.col("high")))


def directory(scratch: Scratch, rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Leaves of the directory over rows (parent, bits, size): parent, prefix, depth, size, n, chain; and its depth."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    start, stop = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    leaves, left = None, rows
    while True:
        buckets = scratch.table(_level(left, start, stop, limit), "buckets")
        above = buckets.where("splits").select(
            "parent", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_above")
        )
        first = F.col("depth") == start
        half = buckets.withColumn("_above", F.shiftrightunsigned("prefix", 1))
        # a bucket exists if it is the first of this level or the half of one that splits
        real = half.where(first).drop("_above").unionByName(
            half.where(~first).join(above, ["parent", "depth", "_above"], "left_semi").drop("_above")
        )
        done = real.where(~F.col("splits")).select(
            "parent", "prefix", "depth", "size", "n", ((F.col("size") > limit) & (F.col("n") > 1)).alias("chain")
        )
        leaves = done if leaves is None else leaves.unionByName(done)
        large = scratch.table(
            real.where(F.col("splits") & (F.col("depth") == stop)).select("parent", F.col("prefix").alias("_large")),
            "large",
        )
        if stop == BITS or large.isEmpty():
            return scratch.table(leaves, "leaves"), stop
        # a bucket that splits at the last depth is the parent of two buckets of the next one
        held = left.withColumn("_large", F.shiftrightunsigned("bits", BITS - stop))
        left = scratch.table(held.join(large, ["parent", "_large"], "left_semi").drop("_large"), "deeper")
        start, stop = stop + 1, min(BITS, stop + 1 + AHEAD)


def _find(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows with their leaf; each depth that has leaves is looked up by its prefix, in one join."""
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]
    at = F.explode(F.array(*[F.lit(d) for d in sorted(depths)])) if depths else F.lit(0)
    keyed = rows.select("*", at.alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(bits, {BITS} - depth)"))
    return keyed.join(leaves.withColumnRenamed("size", "shard_bytes").withColumnRenamed("n", "shard_rows"),
                      ["parent", "depth", "prefix"])


def _assigned(docs: DataFrame, row: Column, *, limit: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, row (its number), shard, depth, shard_bytes, shard_rows."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.table(
        docs.select(
            F.col(id_col).alias("id"),
            F.lit("").alias("parent"),
            hash_bits(F.col(id_col)).alias("bits"),
            F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("size"),
            row.alias("row"),
        ),
        "rows",
    )
    leaves, _ = directory(scratch, rows, limit)
    found = _find(rows, leaves).withColumn("shard", _label(F.col("prefix"), F.col("depth")))
    out = ["id", "row", "shard", "depth", "shard_bytes", "shard_rows"]
    if leaves.where("chain").isEmpty():
        return found.select(*out)
    chained = scratch.table(
        found.where("chain").select(
            "id", "row", F.concat("shard", F.lit("+")).alias("parent"), hash_bits(F.col("row")).alias("bits"), "size",
            F.col("depth").alias("base"),
        ),
        "chained",
    )
    under, _ = directory(scratch, chained, limit)
    below = _find(chained, under).withColumn("shard", F.concat("parent", _label(F.col("prefix"), F.col("depth"))))
    below = below.withColumn("depth", F.col("base") + F.col("depth"))
    return found.where(~F.col("chain")).select(*out).unionByName(below.select(*out))


def assign(
    docs: DataFrame, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, shard (bits of the prefix), depth, shard_bytes, shard_rows."""
    row = F.monotonically_increasing_id()
    return _assigned(docs, row, limit=limit, id_col=id_col, text_col=text_col).drop("row")


def write_shards(docs: DataFrame, path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"):
    """Writes the rows to one folder ``shard=b<bits>`` per shard; returns the assignment.

    If the input has a column ``shard``, the folders' column has underscores in front.
    """
    scratch = Scratch(docs.sparkSession, "write")
    # rows are numbered once and written, as another run of the same plan may number them otherwise
    row, own, place = fresh(docs, "row", "own", "shard")
    place = place if "shard" in (c.lower() for c in docs.columns) else "shard"
    numbered = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    assigned = scratch.table(_assigned(numbered, F.col(row), limit=limit, id_col=id_col, text_col=text_col), "assigned")
    places = assigned.select(F.col("row").alias(own), F.concat(F.lit("b"), "shard").alias(place))
    joined = numbered.join(places, F.col(row) == F.col(own)).drop(row, own)
    joined.repartition(place).write.partitionBy(place).parquet(path)
    scratch.drop("numbered")
    return assigned.drop("row")
