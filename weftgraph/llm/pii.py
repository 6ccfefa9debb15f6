"""Personal data by bootstrapped contextual extraction.

Fixed rules find the seeds: e-mail addresses, IP addresses, payment cards and international phone numbers. The words
around seeds induce lexical patterns: the two words on the left, or the word on the left with the word on the right.
Patterns and instances form a graph. Spark scores it in turns: a pattern by the scores of the instances that it surrounds,
over all of its occurrences in the corpus, seeds or not; an unseen instance by the patterns around it. Patterns of high
confidence and support then discover identifier-like strings that no rule matches; with these as further seeds, patterns
are induced and scored again, until no pattern is new. All seeds stay.

A pattern must surround several distinct seeds of one kind and hardly anything else, so ordinary words never become a
pattern. Which patterns occur is tested against a bitmap of fixed size before any of their occurrences are counted; what
passes by chance drops out in the join. Accepted patterns are broadcast while they are few, and joined with the candidates
otherwise; the graph itself never leaves its tables.

Defined results: null text counts as empty; positions are code points of the whole text, ends exclusive; null or repeated
identifiers have a row each; an empty table gives no rows; extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, fresh, trimmed
from weftgraph.llm.packing import slices
from weftgraph.llm.words import BASE, hash_words, mix

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many distinct seeds, and so high a share of its occurrences.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
#: Bits of the bitmap of patterns (8 MB), and accepted patterns that are broadcast (9 bytes each); more are joined.
BITMAP, PATTERNS = 1 << 26, 1_000_000
#: Words are the same as those that hash_words sees.
WHITE = tuple(" \t\n\x0b\x0c\r")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
#: Characters beside an entity in which its neighbouring words are looked for first.
REACH = 4096

#: Fixed patterns. Possessive runs and the look-behind only spare attempts that can't match.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Strings like an identifier: runs of digits, and tokens with an at sign (also spelt out) or with colons.
LIKE_DIGITS = re.compile(r"(?<![\w.])\(?[0-9](?:[\x20().-]{0,2}[0-9])+(?!\w)")
LIKE_TOKEN = re.compile(r"(?<!\S)\S*(?:@|\(at\)|\[at\]|:[0-9a-f]*:)\S*")


def _octet(part: str) -> bool:
    value = part.lstrip("0") or "0"
    return len(value) <= 3 and int(value) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from their at signs: the longest run before one, then a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Seeds, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _like(kind: str, value: str) -> bool:
    """Whether an unseen string has the form of a kind."""
    digits = sum("0" <= c <= "9" for c in value)
    if kind == "email":
        return bool(re.search(r"@|\(at\)|\[at\]", value)) and len(value) >= 6
    if kind == "ip":
        return value.count(":") >= 2 or value.count(".") == 3 and digits >= 4
    return digits >= 12 if kind == "card" else 7 <= digits <= 15


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that overlap no seed."""
    found = []
    if DIGIT.search(text):
        found += [m.span() for m in LIKE_DIGITS.finditer(text) if sum("0" <= c <= "9" for c in m[0]) >= 7]
    if "@" in text or "(at)" in text or "[at]" in text or ":" in text:
        for m in LIKE_TOKEN.finditer(text):
            value = m[0].rstrip(".,;!?)]}>\"'")
            lead = len(value) - len(value.lstrip("([{<\"'"))
            if len(value) - lead >= 6:
                found.append((m.start() + lead, m.start() + len(value)))
    taken = sorted((a, b) for _, a, b in spans)
    out, end, at = [], 0, 0
    for a, b in sorted(found):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= end and not (at < len(taken) and taken[at][0] < b):
            out.append((a, b))
            end = b
    return out


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((a * np.uint64(BASE) + b) * np.uint64(BASE) + np.uint64(salt))


def _pattern(a: str, b: str, salt: int) -> int:
    h = hash_words([f"{a} {b}"])[0]
    return int(_mix(h[:1], h[1:], salt).astype(np.int64)[0])


def _left(text: str, start: int) -> list[str]:
    """The last two words before a place, whole; what is looked at doubles until it holds them."""
    reach = REACH
    while True:
        at = max(0, start - reach)
        words = WORD.findall(text[at:start])
        # a word in front of the two, or white space, shows that the first of them is whole
        if not at or len(words) > 2 or len(words) == 2 and text[at] in WHITE:
            return words[-2:]
        reach *= 2


def _right(text: str, end: int) -> list[str]:
    """The word after the white space at a place, whole."""
    found = WORD.search(text, end) if text[end : end + 1] in WHITE else None
    return [found[0]] if found else []


def around(text: str, start: int, end: int) -> list[int]:
    """The patterns around a span that stands free: (two words on the left), (left, right)."""
    if text[start - 1 : start] not in WHITE:
        return []
    left, right, found = _left(text, start), _right(text, end), []
    if len(left) == 2:
        found.append(_pattern(*left, 1))
    if left and right:
        found.append(_pattern(left[-1], right[0], 2))
    return found


def _instance(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def _marked(pattern: int, bitmap: np.ndarray) -> bool:
    low = pattern & (BITMAP - 1)
    return bool(int(bitmap[low >> 6]) >> (low & 63) & 1)


def _occurrences(texts: list[str], bitmap: np.ndarray) -> np.ndarray:
    """Hashes of the patterns in the bitmap at each word of the texts."""
    h, counts = hash_words(texts)
    if len(h) < 3:
        return np.empty(0, np.int64)
    # a pattern lies within a text: the third word isn't one of the first two of its text
    inside = np.ones(len(h), bool)
    starts = np.cumsum(counts) - counts
    for i in (0, 1):
        inside[(starts + i)[counts > i]] = False
    found = []
    for salt, second in ((1, h[1:-1]), (2, h[2:])):  # left of a word, and around it
        every = _mix(h[:-2], second, salt)
        low = every & np.uint64(BITMAP - 1)
        hit = bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)
        found.append(every[hit.astype(bool) & inside[2:]])
    return np.concatenate(found).astype(np.int64)


SPANS = "array<struct<kind:string,start:int,end:int,source:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string())])


def _seeds(texts: DataFrame) -> DataFrame:
    """(pattern, kind, instance, n): the patterns around seeds, added up within each batch."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                t = text.as_py() or ""
                for k, a, b in base_spans(t):
                    value = _instance(t[a:b])
                    seen.update((p, k, value) for p in around(t, a, b))
            columns = list(zip(*((*key, n) for key, n in seen.items()), strict=True)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["pattern", "kind", "instance", "n"])

    return texts.mapInArrow(trimmed(run), "pattern long, kind string, instance long, n long")


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """A bitmap of the patterns' hashes; its words are put together before they reach the driver (at most BITMAP / 64)."""
    low = f"(pattern & {BITMAP - 1}L)"
    words = patterns.selectExpr(
        f"shiftright({low}, 6) AS word", f"shiftleft(1L, cast({low} & 63 AS int)) AS bit"
    ).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    out = np.zeros(BITMAP // 64, np.uint64)
    for word, bits in words.toLocalIterator():
        out[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _graph(texts: DataFrame, bitmap) -> DataFrame:
    """(pattern, instance, kinds, n): unseen strings that a pattern surrounds, and without instance all its occurrences."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            texts = batch.column(0).to_pylist()
            for _, some in slices(texts):
                seen.update((p, None, None) for p in _occurrences(some, bitmap.value).tolist())
            for t in texts:
                for a, b in candidates(t, base_spans(t)):
                    value = t[a:b]
                    kinds = tuple(k for k in KINDS if _like(k, value))
                    seen.update((p, _instance(value), kinds) for p in around(t, a, b) if kinds and _marked(p, bitmap.value))
            columns = list(zip(*((*key, n) for key, n in seen.items()), strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["pattern", "instance", "kinds", "n"])

    return texts.mapInArrow(trimmed(run), "pattern long, instance long, kinds array<string>, n long")


def _again(texts: DataFrame, bitmap) -> DataFrame:
    """(pattern, kind, instance, n): the patterns around unseen strings in the bitmap, for each kind that they have the form of."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                t = text.as_py() or ""
                for a, b in candidates(t, base_spans(t)):
                    value = t[a:b]
                    if _marked(instance := _instance(value), bitmap.value):
                        kinds = [k for k in KINDS if _like(k, value)]
                        seen.update((p, k, instance) for p in around(t, a, b) for k in kinds)
            columns = list(zip(*((*key, n) for key, n in seen.items()), strict=True)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["pattern", "kind", "instance", "n"])

    return texts.mapInArrow(trimmed(run), "pattern long, kind string, instance long, n long")


def _scored(scratch: Scratch, texts: DataFrame, strong: DataFrame, known: DataFrame | None):
    """(pattern, kind, confidence) of the strong patterns; the unseen strings around them; their weights, from known ones on."""
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(strong.select("pattern").distinct()))
    graph = _graph(texts, bitmap).groupBy("pattern", "instance", "kinds").agg(F.sum("n").alias("n"))
    graph = scratch.table(graph.join(strong.select("pattern").distinct(), "pattern", "left_semi"), "graph")
    total = graph.where("instance IS NULL").select("pattern", F.col("n").alias("occurrences"))
    # an unseen string is an instance of a kind only if it has its form
    unseen = graph.where("instance IS NOT NULL").join(strong.select("pattern", "kind"), "pattern")
    edges = scratch.table(unseen.where("array_contains(kinds, kind)").select("pattern", "kind", "instance", "n"), "unseen")
    weights = edges.select("kind", "instance", F.lit(0.0).alias("weight")).distinct()
    if known is not None:
        weights = weights.drop("weight").join(known, ["kind", "instance"], "left").na.fill(0.0)
    scored = strong
    for _ in range(ROUNDS):
        more = edges.join(weights, ["kind", "instance"]).groupBy("pattern", "kind").agg(
            F.sum(F.col("weight") * F.col("n")).alias("more"), F.sum("n").alias("others")
        )
        joined = strong.join(more, ["pattern", "kind"], "left").join(total, "pattern", "left").na.fill(0)
        every = F.greatest(F.col("occurrences"), F.col("hits") + F.col("others")) + 1
        confidence = ((F.col("hits") + F.col("more")) / every).alias("confidence")
        scored = scratch.table(joined.select("pattern", "kind", confidence), "scored")
        # an unseen string is what it seems unless all patterns around it err
        err = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        around_it = edges.join(scored, ["pattern", "kind"]).groupBy("kind", "instance")
        weights = scratch.table(around_it.agg((1 - F.exp(err)).alias("weight")), "weights")
    return scored, edges, weights


def _surest(patterns: DataFrame) -> DataFrame:
    """One kind a pattern, the surest."""
    best = patterns.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    return best.select("pattern", F.col("best.kind").alias("kind"))


def score_patterns(texts: DataFrame, *, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) of all patterns with the support. Texts: one column, no nulls.

    Patterns are induced again, from the seeds with what the sure patterns discover, until none is new.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "pii")
    counted = scratch.table(_seeds(texts).groupBy("pattern", "kind", "instance").agg(F.sum("n").alias("n")), "counted")

    def induced(every: DataFrame) -> DataFrame:
        patterns = every.groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("seeds"), F.sum("n").alias("hits"))
        return scratch.table(patterns.where(F.col("seeds") >= support), "strong")

    strong, found, weights = induced(counted), None, None
    while True:
        scored, edges, weights = _scored(scratch, texts, strong, weights)
        sure = _surest(scored.where(F.col("confidence") >= CONFIDENCE))
        now = edges.join(sure, ["pattern", "kind"]).select("kind", "instance")
        # what has been discovered once stays
        found, before = scratch.table((now if found is None else now.unionByName(found)).distinct(), "found"), found
        if found.count() == (0 if before is None else before.count()):
            return scored
        bitmap = spark.sparkContext.broadcast(_bitmap(found.select(F.col("instance").alias("pattern")).distinct()))
        # they induce as seeds do; their hits are counted with their weights, as those of all unseen strings
        again = _again(texts, bitmap).join(found, ["kind", "instance"], "left_semi")
        again = again.groupBy("pattern", "kind", "instance").agg(F.lit(0).cast("long").alias("n"))
        more = induced(counted.unionByName(again))
        if more.count() == strong.count():
            return scored
        strong = more


class Known:
    """The kinds of at most PATTERNS patterns, in two sorted arrays."""

    def __init__(self, patterns: DataFrame):
        rows = sorted((p, KINDS.index(k)) for p, k in patterns.toLocalIterator())
        self.patterns, self.kinds = np.array([p for p, _ in rows], np.int64), np.array([k for _, k in rows], np.int8)

    def get(self, pattern: int) -> str | None:
        at = int(np.searchsorted(self.patterns, pattern))
        return KINDS[self.kinds[at]] if at < len(self.patterns) and self.patterns[at] == pattern else None


def discovered(text: str, spans: list[tuple[str, int, int]], known) -> list[tuple[str, int, int]]:
    """Spans of unseen strings that known patterns surround."""
    out = []
    for a, b in candidates(text, spans):
        kind = next((k for p in around(text, a, b) if (k := known.get(p)) and _like(k, text[a:b])), None)
        if kind:
            out.append((kind, a, b))
    return out


def _text_keys(text: Column) -> list[Column]:
    """128 bits of a text, under which equal texts share what is found in them."""
    return [F.xxhash64(text), F.xxhash64(text, F.lit(1))]


def _discovered_by_join(texts: DataFrame, sure: DataFrame) -> DataFrame:
    """(k1, k2, found): what accepted patterns discover in each text, by a join of the candidates' patterns with them."""
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(sure.select("pattern")))

    def run(batches):
        for batch in batches:
            rows = []
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in candidates(text, base_spans(text)):
                    kinds = [k for k in KINDS if _like(k, text[a:b])]
                    rows += [(k1, k2, a, b, i, p, kinds) for i, p in enumerate(around(text, a, b)) if kinds and _marked(p, bitmap.value)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            labels = ["k1", "k2", "start", "end", "at", "pattern", "kinds"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], labels)

    keyed = texts.select(*[k.alias(f"k{i}") for i, k in enumerate(_text_keys(F.col("text")), 1)], "text")
    met = keyed.mapInArrow(trimmed(run), "k1 long, k2 long, start int, end int, at int, pattern long, kinds array<string>")
    met = met.distinct().join(sure, "pattern").where("array_contains(kinds, kind)")
    one = met.groupBy("k1", "k2", "start", "end").agg(F.min_by("kind", "at").alias("kind"))
    # the spans of one text, which are one value in the result
    return one.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))


def _rows(spans: list[tuple[str, int, int]], source: str) -> list[dict]:
    return [{"kind": k, "start": a, "end": b, "source": source} for k, a, b in spans]


def _annotated(docs: DataFrame, text_col: str, support: int, finish, schema) -> DataFrame:
    """Batches of the documents with their spans, by kind and start, as ``finish(batch, spans)`` makes them."""
    scratch = Scratch(docs.sparkSession, "found")
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(whole.alias("text"))
    sure = scratch.table(_surest(score_patterns(texts, support=support).where(F.col("confidence") >= CONFIDENCE)), "sure")
    at, order = docs.columns.index(text_col), {k: i for i, k in enumerate(KINDS)}
    few = sure.count() <= PATTERNS
    known = docs.sparkSession.sparkContext.broadcast(Known(sure)) if few else None
    joined = docs
    if not few:
        k1, k2, held = fresh(docs, "k1", "k2", "held")
        found = _discovered_by_join(texts, sure).toDF(k1, k2, held)
        own = fresh(docs.withColumns({c: F.lit(0) for c in (k1, k2, held)}), "own1", "own2")
        keyed = docs.withColumns(dict(zip(own, _text_keys(whole), strict=True)))
        same = (F.col(own[0]) == F.col(k1)) & (F.col(own[1]) == F.col(k2))
        joined = keyed.join(scratch.table(found, "discovered"), same, "left").select(*docs.columns, held)

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(at)]
            spans = [base_spans(t) for t in texts]
            if few:
                more = [discovered(t, s, known.value) for t, s in zip(texts, spans, strict=True)]
            else:
                more = [[(x["kind"], x["start"], x["end"]) for x in found or []] for found in batch.column(batch.num_columns - 1).to_pylist()]
                batch = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            rows = [_rows(s, "base") + _rows(m, "pattern") for s, m in zip(spans, more, strict=True)]
            yield finish(batch, [sorted(r, key=lambda s: (order[s["kind"]], s["start"])) for r in rows])

    return joined.mapInArrow(trimmed(run), schema)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """One row per document: id, spans (kind, start, end, source: base or pattern), by kind and start."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def finish(batch, spans):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["id", "spans"])

    return _annotated(chosen, "text", support, finish, f"id {kind}, spans {SPANS}")


def mask(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, one mark stands for all."""
    parts, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= end:
            parts += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
        end = max(end, s["end"])
    return "".join(parts) + text[end:]


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", support: int = SUPPORT) -> DataFrame:
    """The documents with personal data replaced, null texts as they are; ``chars_col``, if there, is counted anew."""
    at = docs.columns.index(text_col)

    def finish(batch, spans):
        texts = [t.as_py() if not s else mask(t.as_py() or "", s) for t, s in zip(batch.column(at), spans, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = _annotated(docs, text_col, support, finish, docs.schema)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.coalesce(F.char_length(text_col).cast(kind), F.col(chars_col)))
    return out


def digest(spans) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
