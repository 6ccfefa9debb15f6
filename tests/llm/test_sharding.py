from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.edge import ROWS, documents
from weftgraph.llm import sharding


def bits(key) -> str:
    digest = hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15]
    return f"{int(digest, 16):060b}"


def brute(rows, limit):
    """Splits buckets one bit at a time."""
    def split(members, depth):
        size = sum(s for _, s in members)
        if size <= limit or len({bits(k) for k, _ in members}) == 1:
            for k, _ in members:
                out[k] = (bits(k)[:depth], depth, size, len(members))
            return
        for b in "01":
            if half := [m for m in members if bits(m[0])[depth] == b]:
                split(half, depth + 1)

    out: dict = {}
    split(rows, 0)
    return out


@pytest.mark.parametrize("limit", [10**9, 5000, 700, 120])
def test_shards_are_those_of_splitting_bit_by_bit(spark, limit):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id * id % 97 as int))").alias("text"), F.lit(1).alias("size"))
    rows = [(i, i * i % 97) for i in range(400)]
    found = {r["id"]: (r["shard"], r["depth"], r["shard_bytes"], r["shard_rows"]) for r in sharding.assign(docs, limit=limit).collect()}
    assert found == brute(rows, limit)


def test_deep_splits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "AHEAD", 0)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    found = {r["id"]: (r["shard"], r["depth"], r["shard_bytes"], r["shard_rows"]) for r in sharding.assign(docs, limit=120).collect()}
    assert found == brute([(i, 50) for i in range(300)], 120)


def test_one_key_with_most_rows_goes_on_below_a_plus(spark):
    docs = spark.range(200).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("y" * 10).alias("text"))
    found = sharding.assign(docs, limit=100).collect()
    sizes = defaultdict(int)
    for r in found:
        sizes[r["shard"]] += 10
        assert r["shard_bytes"] <= 100
    assert len(found) == 200 and max(sizes.values()) <= 100
    assert {r["shard"] for r in found if r["id"] == 7 and "+" in r["shard"]}
    names = [s.replace("+", "") for s in sizes]
    assert len(set(names)) == len(names)


def test_edge_rows(spark):
    found = sharding.assign(documents(spark, "bits"), limit=1000).collect()
    assert sorted((str(r["id"]) for r in found)) == sorted(str(i) for i, _, _ in ROWS)
    assert all(r["shard_bytes"] <= 1000 or r["shard_rows"] == 1 for r in found)
    assert sharding.assign(documents(spark).limit(0)).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark, "parent")
    shards = sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "shard"}
    assert {"b" + r["shard"] for r in shards.collect()} >= {r["shard"] for r in back.select("shard").distinct().collect()}


def test_a_column_named_shard_is_kept(spark, tmp_path):
    docs = documents(spark, "shard")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "_shard"}
    assert sorted(map(str, back.select("doc_id", "shard").collect())) == sorted(map(str, docs.select("doc_id", "shard").collect()))


def test_written_shards_of_repeated_identifiers_fit(spark, tmp_path):
    docs = spark.range(50).select(F.lit(7).alias("doc_id"), F.lit("z" * 100).alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    written = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert sum(r["n"] for r in written) == 5000 and max(r["n"] for r in written) <= 1000


def test_written_shards_of_a_hot_key_keep_their_sizes(spark, tmp_path):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    docs = spark.range(200).select(key.alias("doc_id"), F.lit("y" * 10).alias("text"), F.col("id").alias("row"))
    shards = sharding.write_shards(docs, str(tmp_path / "out"), limit=100)
    promised = {("b" + r["shard"], r["shard_bytes"], r["shard_rows"]) for r in shards.collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    written = back.groupBy("shard").agg(F.sum(F.octet_length("text")), F.count(F.lit(1)))
    assert {tuple(r) for r in written.collect()} == promised
    assert max(size for _, size, _ in promised) <= 100
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "row").collect()) == sorted(tuple(r) for r in docs.collect())
