from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph

SF = "/root/testdata/sf0.001"

EDGES = [
    ("GPT-4", "DEVELOPED_BY", "OpenAI"), ("GPT-3.5", "DEVELOPED_BY", "OpenAI"), ("Claude-3", "DEVELOPED_BY", "Anthropic"),
    ("OpenAI", "PARTNERED_WITH", "Microsoft"), ("GPT-4", "USES_ARCHITECTURE", "Transformer"),
    ("Claude-3", "USES_ARCHITECTURE", "Transformer"), ("GPT-4", "IMPLEMENTS", "RLHF"), ("Claude-3", "IMPLEMENTS", "RLHF"),
    ("GPT-4", "EVALUATED_ON", "MMLU"), ("Claude-3", "EVALUATED_ON", "HumanEval"), ("doc1", "MENTIONS", "GPT-4"),
    ("doc1", "MENTIONS", "Anthropic"),
]
LABELS = {
    "GPT-4": "AIModel", "GPT-3.5": "AIModel", "Claude-3": "AIModel", "OpenAI": "AICompany", "Anthropic": "AICompany",
    "Microsoft": "AICompany", "Transformer": "Architecture", "RLHF": "Technique", "MMLU": "Benchmark", "HumanEval": "Benchmark",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark) -> Graph:
    """The small graph of models, companies and one document."""
    from weftgraph.operators.extract import HashingEmbedder

    embed = HashingEmbedder(64)
    about = {n: f"{n} is a {label} known to many people" for n, label in LABELS.items()}
    rows = [(n, n, [label], about[n], {}, [float(x) for x in embed([f"{n}: {about[n]}"])[0]]) for n, label in LABELS.items()]
    entities = spark.createDataFrame(
        rows, "id string, name string, labels array<string>, description string, props map<string,string>, embedding array<float>"
    )
    page = "GPT-4 is a large model that was developed by OpenAI. Anthropic is another company."
    documents = spark.createDataFrame(
        [("doc1", page, "a.txt", "/x/a.txt", 0, [float(x) for x in embed([page])[0]])],
        "id string, text string, source_file string, source_path string, page int, embedding array<float>",
    )
    relationships = spark.createDataFrame([(a, b, t) for a, t, b in EDGES], "src string, dst string, type string")
    return Graph(entities.cache(), documents.cache(), relationships.cache())


def ids(frame, column: str = "id") -> set:
    return {r[0] for r in frame.select(column).collect()}


def one(spark, column):
    """The value of a column expression."""
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit_array(*values):
    return F.array(*map(F.lit, values))
