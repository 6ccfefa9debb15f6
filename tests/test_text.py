from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import lit_array, one
from weftgraph.config import ENTITY_LABELS, RELATIONSHIP_TYPES, Settings, parse_bool, parse_csv
from weftgraph.functions import text

PIECES = ["GPT-4", " ", ".", "\n", " ", "\x1c", "the", "a b", "OpenAI", "éa", "\t", ":", "'", "http://x.org/a-b_c", "www.q.de", "", "word word "]


def samples(n: int = 60) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 20))) for _ in range(n)]


def applied(spark, values, make) -> list:
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in frame.select("i", make("t").alias("x")).orderBy("i").collect()]


def test_normalize_is_pythons(spark):
    values = samples()
    assert applied(spark, values, text.normalize) == [" ".join(v.split()) for v in values]
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""


def test_strip_is_pythons(spark):
    values = samples()
    assert applied(spark, values, text.strip) == [v.strip() for v in values]


def test_keywords_keep_order(spark):
    values = samples() + ["What is the GPT-4 and the gpt-4 Model for OpenAI?"]

    def expected(v):
        found = [w for w in re.findall(r"[a-z0-9][a-z0-9\\-]{2,}", v.lower()) if w not in text.KEYWORD_STOPWORDS]
        return list(dict.fromkeys(found))[:10]

    assert applied(spark, values, text.query_keywords) == [expected(v) for v in values]


def test_overlaps_differ_in_stopwords(spark):
    assert one(spark, text.token_overlap(F.lit("what is the model"), F.lit("a model"))) == 1.0
    assert one(spark, text.plain_overlap(F.lit("what is the model"), F.lit("a model"))) == 0.25
    assert one(spark, text.token_overlap(F.lit("is the"), F.lit("model"))) == 0.0


def test_description_takes_the_first_telling_sentence(spark):
    page = "GPT-4 wins. The model GPT-4 was released in March of that year. GPT-4 is good."
    assert one(spark, text.entity_description(F.lit("gpt-4"), F.lit(page))) == "The model GPT-4 was released in March of that year"
    long = "GPT " + "word " * 60
    cut = one(spark, text.entity_description(F.lit("gpt"), F.lit(long)))
    assert cut.endswith(" word...") and len(cut) <= 203
    assert one(spark, text.entity_description(F.lit(""), F.lit(page))) == ""
    assert one(spark, text.entity_description(F.lit("zzz"), F.lit(page))) == ""


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("https://arxiv.org/abs/attention-is_all", "attention is all"), ("http://a/b", "External Link"), (None, "Unknown"), ("  ", "Unknown"),
        ("A title: " + "x" * 60, "A title"), ("One thing - " + "y" * 60, "One thing"), ("Musk's " + "z" * 60, "Musk's " + "z" * 60),
        ("many words " * 9, "many words many words many words many words many..."), ("see https://q.org/abc now", "see now"), ("GPT-4", "GPT-4"),
    ],
)
def test_node_names(spark, raw, name):
    assert one(spark, text.node_name(F.lit(raw).cast("string"))) == name


def test_node_confidence(spark):
    made = lambda *a: one(spark, text.node_confidence(*[F.lit(x).cast("string") for x in a]))
    assert made("GPT-4", "GPT-4", "d" * 40, "about gpt-4") == 0.95
    assert made("GPT-4", "GPT-4", "short", "nothing") == 0.8
    assert made(None, "unknown", None, None) == 0.5


def test_chunk_ids_and_sources(spark):
    made = one(spark, text.chunk_id(F.lit("a.txt"), F.lit(None).cast("string"), F.lit(2), F.lit(5), F.lit("x  y")))
    assert re.fullmatch(r"a\.txt#p2:c5:[0-9a-f]{12}", made)
    assert one(spark, text.chunk_id(F.lit(None).cast("string"), F.lit("/d/b.pdf"), F.lit(None).cast("int"), F.lit(0), F.lit("")))[:8] == "b.pdf#p0"
    assert one(spark, text.chunk_source(F.lit("a.pdf"), F.lit(0))) == "a.pdf p.1"
    assert one(spark, text.chunk_source(F.lit("a.pdf"), F.lit(-1))) == "a.pdf"


def test_signals(spark):
    assert one(spark, text.numeric_focus(F.lit("Which update came?")))  # "date" counts inside a word
    assert not one(spark, text.single_intent(F.lit("A and B")))
    assert one(spark, text.ungrounded_answer(F.lit("This is Common Knowledge.")))
    assert one(spark, text.contains_all(F.lit("OpenAI made it"), lit_array("openai", "MADE")))
    assert one(spark, text.canonical_label(F.lit(" aimodel "), ENTITY_LABELS)) == "AIModel"
    assert one(spark, text.is_digest(F.lit("a" * 32))) and not one(spark, text.is_digest(F.lit("g" * 32)))


def test_estimated_chunks(spark):
    assert [one(spark, text.estimated_chunks(F.lit(n), 2000)) for n in (0, 1, 4096, 9000)] == [0, 1, 1, 2]


def test_settings():
    assert len(ENTITY_LABELS) == len(set(ENTITY_LABELS)) == 16 and len(set(RELATIONSHIP_TYPES)) == 29
    assert parse_bool("Yes") and not parse_bool("0") and parse_csv(" a, ,b ") == ("a", "b")
    made = Settings.from_env(env={"WEFTGRAPH_CHUNK_SIZE": "9", "WEFTGRAPH_GLOBAL_CONTEXT": "off", "WEFTGRAPH_EXCLUDED_TYPES": "A, B"})
    assert (made.chunk_size, made.global_context, made.excluded_types) == (9, False, ("A", "B"))
