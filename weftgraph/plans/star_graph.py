"""A property graph over the star schema's tables, for queries that need one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(frame: DataFrame, prefix: str, key: str, name, label: str) -> DataFrame:
    return frame.select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), name.alias("name"),
        F.array(F.lit(label)).alias("labels"), F.lit(None).cast("string").alias("description"),
    )


def _edge(frame: DataFrame, a: str, src: str, b: str, dst: str, kind: str) -> DataFrame:
    return frame.select(
        F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"),
        F.lit(kind).alias("type"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    out = _node(t("customer"), "C", "c_custkey", F.col("c_name"), "Customer")
    for more in (
        _node(t("orders"), "O", "o_orderkey", F.lit(None).cast("string"), "Order"),
        _node(t("part"), "P", "p_partkey", F.col("p_name"), "Part"),
        _node(t("supplier"), "S", "s_suppkey", F.col("s_name"), "Supplier"),
        _node(t("nation"), "N", "n_nationkey", F.col("n_name"), "Nation"),
        _node(t("region"), "R", "r_regionkey", F.col("r_name"), "Region"),
        _node(t("documents").select("lang").distinct(), "L", "lang", F.col("lang"), "Language"),
        _node(t("documents").select("source").distinct(), "SRC", "source", F.col("source"), "Source"),
    ):
        out = out.unionByName(more)
    return out


#: Pairs of a task that makes them distinct, about.
PAIRS_OF_A_TASK = 2_000_000


def _pairs(frame: DataFrame, *keys: str) -> DataFrame:
    """Distinct pairs, in as many tasks as their rows ask for: the number of a session's shuffles is the same for any size."""
    pairs = frame.select(*keys)
    tasks = -(-frame.count() // PAIRS_OF_A_TASK)  # the number of rows is in the files' footers
    most = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pairs.repartition(tasks, *keys) if tasks > most else pairs).distinct()


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    out = _edge(t("orders"), "C", "o_custkey", "O", "o_orderkey", "PLACED")
    for more in (
        _edge(_pairs(t("lineitem"), "l_orderkey", "l_partkey"), "O", "l_orderkey", "P", "l_partkey", "CONTAINS"),
        _edge(_pairs(t("lineitem"), "l_partkey", "l_suppkey"), "P", "l_partkey", "S", "l_suppkey", "SUPPLIED_BY"),
        _edge(t("customer"), "C", "c_custkey", "N", "c_nationkey", "LOCATED_IN"),
        _edge(t("supplier"), "S", "s_suppkey", "N", "s_nationkey", "LOCATED_IN"),
        _edge(t("nation"), "N", "n_nationkey", "R", "n_regionkey", "PART_OF"),
        _edge(t("documents"), "D", "doc_id", "L", "lang", "MENTIONS"),
        _edge(t("documents"), "D", "doc_id", "SRC", "source", "MENTIONS"),
    ):
        out = out.unionByName(more)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), "text", F.col("source").alias("source_file"),
        F.concat(F.lit("/corpus/"), "source").alias("source_path"), F.lit(0).alias("page"),
    )


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(entities(spark, sf_dir), documents(spark, sf_dir), relationships(spark, sf_dir))


#: The same graph for SQL: prepended to queries as common table expressions.
SQL = """
    ents AS (
        SELECT 'C' || c_custkey AS id, c_name AS name, 'Customer' AS label FROM customer
        UNION ALL SELECT 'O' || o_orderkey, NULL, 'Order' FROM orders
        UNION ALL SELECT 'P' || p_partkey, p_name, 'Part' FROM part
        UNION ALL SELECT 'S' || s_suppkey, s_name, 'Supplier' FROM supplier
        UNION ALL SELECT 'N' || n_nationkey, n_name, 'Nation' FROM nation
        UNION ALL SELECT 'R' || r_regionkey, r_name, 'Region' FROM region
        UNION ALL SELECT DISTINCT 'L' || lang, lang, 'Language' FROM documents
        UNION ALL SELECT DISTINCT 'SRC' || source, source, 'Source' FROM documents),
    nodes AS (SELECT * FROM ents UNION ALL SELECT 'D' || doc_id, NULL, 'Document' FROM documents),
    rels AS (
        SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst, 'PLACED' AS type FROM orders
        UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, 'CONTAINS' FROM lineitem
        UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 'SUPPLIED_BY' FROM lineitem
        UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN' FROM customer
        UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN' FROM supplier
        UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF' FROM nation
        UNION ALL SELECT 'D' || doc_id, 'L' || lang, 'MENTIONS' FROM documents
        UNION ALL SELECT 'D' || doc_id, 'SRC' || source, 'MENTIONS' FROM documents),
    und AS (SELECT src, dst, type FROM rels UNION ALL SELECT dst, src, type FROM rels)
"""
