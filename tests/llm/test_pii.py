from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.edge import ascii_lower
from weftgraph.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str):
    """The rules as written, without short cuts."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_seeds_are_those_of_the_rules():
    parts = ["a", "b.", "@", "@", ".", "com", "1", "22", "255", "256", "0", "+", "+1", " ", "(", "-", "%", "é", "٣", "4111111111111111",
             "5555 5555 5555 4444", "\n", "1.2.3.4", "+1 (456) 555-2186"]
    rng = random.Random(4)
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 60_000, "@" * 100_000, "1 2 " * 50_000, ":" * 50_000, "0" * 5000 + ".1.2.3"):
        spans = pii.base_spans(text)
        pii.candidates(text, spans)


def corpus():
    """Numbers after "call me" are mostly phones; the ones without a plus are unseen. "room" stands before any number."""
    rows = [(i, f"Please call me at +1 (456) 555-{2000 + i} or later in week {i}") for i in range(12)]
    rows += [(100 + i, f"Please call me at 456-555-{7000 + i} or later today") for i in range(3)]
    rows += [(200 + i, f"We met in room 123456{i}9 or elsewhere") for i in range(9)]
    rows += [(300, "No number here, call me at once or later"), (301, ""), (302, None)]
    return rows


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    return {r["id"]: [(s["kind"], s["start"], s["end"], s["source"]) for s in r["spans"]] for r in pii.find(docs).collect()}


def test_patterns_discover_unseen_numbers(found):
    texts = dict(corpus())
    for i in range(3):
        ((kind, a, b, source),) = found[100 + i]
        assert (kind, source, texts[100 + i][a:b]) == ("phone", "pattern", f"456-555-{7000 + i}")
    assert all(not found[200 + i] for i in range(9)) and not found[300] and not found[301] and not found[302]


def test_patterns_that_are_joined(spark, found, monkeypatch):
    monkeypatch.setattr(pii, "PATTERNS", 0)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in corpus()], "doc_id long, text string, _k1 int, _held string")
    again = {r["id"]: [(s["kind"], s["start"], s["end"], s["source"]) for s in r["spans"]] for r in pii.find(docs).collect()}
    assert again == found
    out = pii.redact(docs)
    masked = {r["doc_id"]: r["text"] for r in out.collect()}
    assert masked[100] == "Please call me at [PHONE] or later today" and masked[302] is None and out.columns == docs.columns


def plain_graph(texts: list[str], support: int):
    """Patterns, instances and their scores in plain Python, words as they stand: ({(kind, words, form): confidence}, discovered)."""
    low = [ascii_lower(t) for t in texts]

    def near(t, a, b):
        left, right = re.findall(r"[^\x20\x09-\x0d]+", t[:a]), re.match(r"[\x20\x09-\x0d]+([^\x20\x09-\x0d]+)", t[b:])
        if not a or t[a - 1] not in " \t\n\x0b\x0c\r":
            return []
        out = [(left[-2], left[-1], 1)] if len(left) > 1 else []
        return out + ([(left[-1], right[1], 2)] if left and right else [])

    seeds, unseen, total = defaultdict(Counter), [], Counter()
    for t, l in zip(texts, low, strict=True):
        spans = plain_spans(t)
        for kind, a, b in spans:
            for p in near(l, a, b):
                seeds[p, kind][t[a:b]] += 1
        for a, b in pii.candidates(t, spans):
            kinds = [k for k in pii.KINDS if pii._like(k, t[a:b])]
            unseen += [(p, k, t[a:b]) for p in near(l, a, b) for k in kinds]
        words = re.findall(r"[^\x20\x09-\x0d]+", l)
        for x, y, z in zip(words, words[1:], words[2:], strict=False):
            total[x, y, 1] += 1
            total[x, z, 2] += 1
    hits = {key: sum(c.values()) for key, c in seeds.items()}
    distinct = {key: set(c) for key, c in seeds.items()}
    found, weights, strong = set(), {}, None
    while True:
        now = {key for key, names in distinct.items() if len(names) >= support}
        if now == strong:
            return score, found
        strong = now
        edges = Counter((p, k, v) for p, k, v in unseen if (p, k) in strong)
        weights = {(k, v): weights.get((k, v), 0.0) for _, k, v in edges}
        for _ in range(3):
            score = {}
            for p, k in strong:
                mine = [(v, n) for (q, j, v), n in edges.items() if (q, j) == (p, k)]
                others = sum(n for _, n in mine)
                more = sum(n * weights[k, v] for v, n in mine)
                score[p, k] = (hits.get((p, k), 0) + more) / (max(total[p], hits.get((p, k), 0) + others) + 1)
            for k, v in weights:
                miss = 1.0
                for q, j, w in edges:
                    miss *= 1 - min(score[q, j], 0.999) if (j, w) == (k, v) else 1
                weights[k, v] = 1 - miss
        best = {}
        for (p, k), c in score.items():
            if c >= 0.8:
                best[p] = max(best.get(p, (0, "")), (c, k))
        before = set(found)
        found |= {(k, v) for p, k, v in edges if best.get(p, (0, ""))[1] == k}
        if found == before:
            return score, found
        for p, k, v in unseen:
            if (k, v) in found:
                distinct.setdefault((p, k), set()).add(v)


def graph_texts(seed: int) -> list[str]:
    """Texts in which a few words stand around numbers and addresses of several kinds, mostly where they belong."""
    rng = random.Random(seed)
    out = []
    for i in range(200):
        lead, value = rng.choice([
            ("please call", f"+1 212 555 {rng.randrange(1000, 1060)}"), ("Call us", f"+1 212 555 {rng.randrange(1000, 1060)}"),
            ("please call", f"212-555-{rng.randrange(7000, 7012)}"), ("desk phone", f"212-555-{rng.randrange(7000, 7012)}"),
            ("desk phone", f"212-555-{rng.randrange(8000, 8012)}"), ("write to", f"user{rng.randrange(30)}@mail.org"),
            ("write to", f"user{rng.randrange(9)}(at)mail.org"), ("host at", f"10.0.0.{rng.randrange(40)}"),
            ("host at", f"fe80::{rng.randrange(9)}:ab"), ("room number", f"{rng.randrange(10**7, 10**8)}"), ("card no", "4111111111111111"),
        ])
        if rng.random() < 0.05:
            lead = rng.choice(["please call", "write to", "host at", "desk phone"])
        words = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(4))]
        out.append(" ".join([*words, lead, value, rng.choice(["now", "or later", "", f"x{i}"]), *words]))
    return out


@pytest.mark.parametrize(("seed", "support"), [(1, 3), (2, 2), (3, 5)])
def test_the_scored_graph_is_that_of_plain_python(spark, seed, support):
    texts = graph_texts(seed)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    expected, found = plain_graph(texts, support)
    assert len(expected) > 5 and found
    names = {pii._pattern(x, y, form): (x, y, form) for (x, y, form), _ in expected}
    scored = {(names[r["pattern"]], r["kind"]): r["confidence"] for r in pii.score_patterns(frame, support=support).collect()}
    assert scored.keys() == expected.keys()
    assert all(scored[k] == pytest.approx(expected[k], abs=1e-9) for k in expected)


def test_seeds_stay(found):
    for i, text in corpus():
        assert [s[:3] for s in found[i] if s[3] == "base"] == plain_spans(text or "")


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a.b@c.org or 1.2.3.4 now", 9, "x"), (2, None, None, None), (None, "", 0, "y"), (1, "mail a.b@c.org or 1.2.3.4 now", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _spans string")
    out = sorted(map(tuple, pii.redact(docs).collect()), key=str)
    masked = "mail [EMAIL] or [IP] now"
    assert out == sorted([(1, masked, len(masked), "x")] * 2 + [(2, None, None, None), (None, "", 0, "y")], key=str)
    assert pii.redact(docs.limit(0)).count() == 0 and pii.find(docs.limit(0)).count() == 0


def test_masks_of_overlapping_spans():
    spans = [{"kind": "card", "start": 2, "end": 8}, {"kind": "phone", "start": 0, "end": 5}]
    assert pii.mask("0123456789", spans) == "[PHONE]89"


def test_neighbours_are_whole_words():
    long, gap = "x" * 5000, " " * 9000
    short = pii.around("call me 555-0101 now", 8, 16)
    text = f"{gap}call{gap}me 555-0101{gap}now"
    at = text.index("555")
    assert len(short) == 2 and short == pii.around(text, at, at + 8)
    text = f"{long}1 {long}2 555-0101 {long}3"
    at = text.index("555")
    assert pii.around(text, at, at + 8) == [pii._pattern(long + "1", long + "2", 1), pii._pattern(long + "2", long + "3", 2)]


def test_discovered_strings_induce_patterns(spark):
    seeds = [f"word{i} please call +1 (212) 555-{i:04d} soon{i}" for i in range(60)]
    local = [f"item{i} please call 456-555-{7000 + i} later{i}" for i in range(8)]
    other = [f"item{i} office line 456-555-{7000 + i} closed{i}" for i in range(8)]
    last = [f"item{i} office line 789-555-{8000 + i} closed{i}x" for i in range(2)]
    plain = ["a plain text", None]
    texts = [*seeds, *local, *other, *last, *plain]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = {r["id"]: [(s["kind"], s["source"], texts[r["id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find(docs).collect()}
    for i in range(2):
        assert spans[76 + i] == [("phone", "pattern", f"789-555-{8000 + i}")]
    assert spans[78] == spans[79] == [] and all(len(spans[i]) == 1 for i in range(78))
