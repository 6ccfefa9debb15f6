"""The corpus pipeline: each stage against a plain version on the rows that the stage before it kept."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tests.llm.edge import ascii_lower, documents
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import plain_spans
from weftgraph.llm import pii, quality
from weftgraph.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes in and comes out, stage by stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], after.columns)
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_quality_stage(spark, stages):
    before, after, _ = stages["quality"]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    good = {d["doc_id"] for d in before if model.scores(np.array([quality.measure(d["text"])]))[0] >= 0.5}
    assert {d["doc_id"] for d in after} == good
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert clean <= good and len(good) < len(before)


def test_exact_stage(stages):
    before, after, _ = stages["exact_dedup"]
    keep = {}
    for d in before:
        norm = ascii_lower(d["text"])
        keep[norm] = max(d["doc_id"], keep.get(norm, -1))
    assert sorted(d["doc_id"] for d in after) == sorted(keep.values())


def test_near_stage(stages):
    before, after, _ = stages["ngram_jaccard"]
    expected = [i for i, _, c in brute([(d["doc_id"], d["text"]) for d in before]) if i == c]
    assert sorted(d["doc_id"] for d in after) == sorted(expected)


def test_pii_stage(stages):
    before, after, _ = stages["pii"]
    texts = {d["doc_id"]: d["text"] for d in after}
    assert len(after) == len(before)
    for d in before:
        spans = [{"kind": k, "start": a, "end": b} for k, a, b in plain_spans(d["text"])]
        assert texts[d["doc_id"]] == pii.mask(d["text"], spans)
    assert all(d["n_chars"] == len(d["text"]) for d in after)


def test_packing_stage(stages):
    before, after, _ = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {d["doc_id"]: len(library.encode(d["text"], add_special_tokens=False).ids) + 1 for d in before}
    packed, whole = {}, {}
    for r in sorted(after, key=lambda r: r["piece"]):
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert packed == sizes
    for d in before:
        assert whole[d["doc_id"]] == np.array([*library.encode(d["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert len({r["sequence_id"] for r in after}) <= sum(sizes.values()) / 1024 * 1.02 + 1


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_edge_rows(spark, tmp_path, at):
    name, stage = corpus_pipeline.STAGES[at]
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, "spans")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
