from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.edge import ROWS, ascii_lower, documents
from weftgraph.llm import exact_dedup


def expected():
    groups = defaultdict(list)
    for i, text, _ in ROWS:
        groups[ascii_lower(text)].append(i)
    rows = Counter()
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            first = not kept and i == keep
            kept |= first
            rows[i, keep, len(ids), first, sha256(norm.encode()).hexdigest()] += 1
    return rows


def weak(text):
    """A digest of two values, so that different texts share one."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 1).between("0", "7").cast("string")


@pytest.mark.parametrize("extra", ["norm", "digest", "id", "_own"])
def test_decisions(spark, extra):
    found = exact_dedup.decide(documents(spark, extra))
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in found.collect()) == expected()


def test_digests_that_collide_are_resolved_by_the_bytes(spark):
    found = exact_dedup.decide(documents(spark), digest=weak)
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()) == Counter(
        {k[:4]: sum(n for x, n in expected().items() if x[:4] == k[:4]) for k in expected()}
    )


@pytest.mark.parametrize("extra", ["norm", "_own", "_seen"])
def test_one_row_of_each_text_stays(spark, extra):
    docs = documents(spark, extra)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    kept = Counter(ascii_lower(r["text"]) for r in out.collect())
    assert set(kept) == {ascii_lower(t) for _, t, _ in ROWS} and set(kept.values()) == {1}


def test_empty_table(spark):
    assert exact_dedup.decide(documents(spark).limit(0)).count() == 0
    assert exact_dedup.dedup(documents(spark).limit(0)).count() == 0


def test_digests_that_collide_lose_no_text(spark):
    docs = documents(spark)
    kept = Counter(ascii_lower(r["text"]) for r in exact_dedup.dedup(docs, digest=weak).collect())
    assert set(kept) == {ascii_lower(t) for _, t, _ in ROWS} and set(kept.values()) == {1}


@pytest.mark.parametrize(("digest", "parts"), [(exact_dedup.sha_hex, 2), (weak, 3)])
def test_several_calls_equal_one_on_the_union(spark, tmp_path, digest, parts):
    state = str(tmp_path / "state")
    for i in range(parts):
        part = spark.createDataFrame(ROWS[i::parts], "doc_id long, text string, extra string")
        now = exact_dedup.decide(part, digest=digest, state=state).collect()
        assert Counter(r["id"] for r in now) == Counter(i for i, _, _ in ROWS[i::parts])
    found = exact_dedup.decisions(spark, state)
    columns = ("id", "keep_id", "group_size", "kept")
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == Counter(
        {k[:4]: sum(n for x, n in expected().items() if x[:4] == k[:4]) for k in expected()}
    )
    # a locator reads the bytes of a row of the same text
    texts = {r["locator"]: ascii_lower(r["text"]) for r in exact_dedup.located(spark, state, found).collect()}
    groups = defaultdict(set)
    for i, text, _ in ROWS:
        groups[i].add(ascii_lower(text))
    assert all(texts[r["locator"]] in groups[r["id"]] for r in found.collect())


def test_a_call_that_is_repeated_by_name_counts_once(spark, tmp_path):
    state, docs = str(tmp_path / "state"), documents(spark)
    for _ in range(2):
        found = exact_dedup.decide(docs, state=state, name="monday")
        assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in found.collect()) == expected()


def test_lower_case_is_that_of_ascii(spark):
    values = [t for _, t, _ in ROWS] + ["ÀÉÎ ABC xyz", "ABCxyz[]^_`@{}", "İI ıi ſS KÅ", "ẞ Ω Σς"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", exact_dedup.ascii_lower(F.col("t")).alias("low"))
    assert all(r["low"] == ascii_lower(r["t"]) for r in rows.collect())


def test_a_hot_text_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMPARED", 7)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.decide(docs, digest=lambda t: F.substring(t, 1, 1)).collect()
    assert {r["id"] for r in found if r["kept"]} == {i for i in range(300) if i % 3} | {297}
