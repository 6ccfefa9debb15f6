"""Text functions as column expressions.

Python's notion of white space is wider than Java's default; WHITE spells it out. Rounding is half up, by floor, so that
every engine agrees.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and its regular expressions see it.
WHITE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Words that carry no meaning in overlaps and in keywords.
OVERLAP_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "of", "to", "in", "on", "for", "and", "or", "what", "which", "who",
    "when", "where", "how", "why", "with", "by", "from", "at", "as",
)
KEYWORD_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "what", "which", "who", "when", "where", "how",
)
# Phrases by which a question or an answer is recognised.
SPLIT_SIGNALS = (" and ", ";", " vs ", " versus ", "compare", "also", " then ", ", and ")
NUMERIC_SIGNALS = (
    "how much", "how many", "percent", "percentage", "date", "when", "rank", "top ", "count", "valuation", "funding", "$",
)
UNGROUNDED_MARKERS = (
    "not derived from the provided source", "not found in the provided source", "not in the provided source",
    "common knowledge", "outside the provided", "not grounded in the retrieved evidence",
)


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def half_up(value: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def normalize(text) -> Column:
    """White space collapsed to single spaces, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(blank(col(text)), WHITE + "+", " "))


def strip(text) -> Column:
    return F.regexp_replace(blank(col(text)), f"^{WHITE}+|{WHITE}+$", "")


def fingerprint(text) -> Column:
    """First 16 hex digits of the SHA-1 of a normalised text."""
    return F.substring(F.sha1(normalize(text).cast("binary")), 1, 16)


def short_md5(text, digits: int = 12) -> Column:
    return F.substring(F.md5(blank(col(text)).cast("binary")), 1, digits)


def file_name(path) -> Column:
    return F.regexp_extract(blank(col(path)), "([^/\\\\\\\\]*)$", 1)


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def chunk_id(source_file, source, page, index, text) -> Column:
    """source#p{page}:c{index}:{digest of the normalised text}; the first known name of the source is used."""
    name = F.coalesce(filled(col(source_file)), filled(file_name(source)), F.lit("unknown"))
    parts = (name, F.lit("#p"), F.coalesce(col(page), F.lit(0)).cast("string"), F.lit(":c"), col(index).cast("string"))
    return F.concat(*parts, F.lit(":"), short_md5(normalize(text)))


def fallback_chunk_id(source, page, text) -> Column:
    page = F.coalesce(col(page), F.lit(0)).cast("string")
    return F.concat(F.coalesce(filled(col(source)), F.lit("unknown")), F.lit("#p"), page, F.lit(":"), short_md5(text))


def estimated_chunks(size, chunk_size: int) -> Column:
    """Chunks to expect of a file of so many bytes."""
    per_chunk = max(1024, int(chunk_size / 2000 * 4096))
    size = col(size)
    return F.when(size <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / per_chunk))).cast("long")


def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(blank(text)), F.lit(pattern), F.lit(0))


def overlap_tokens(text) -> Column:
    stop = F.array(*map(F.lit, OVERLAP_STOPWORDS))
    kept = F.filter(_words(col(text), "[a-z0-9]+"), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))
    return F.array_distinct(kept)


def plain_tokens(text) -> Column:
    return F.array_distinct(_words(col(text), "[a-z0-9]+"))


def _share(left: Column, right: Column) -> Column:
    """Share of the left tokens, which are distinct, that are among the right words; each side is computed once."""
    common = lambda l: F.size(F.array_intersect(l, right)) / F.size(l)  # noqa: E731, E741
    return _bound(left, lambda l: F.when(F.size(l) > 0, common(l)).otherwise(F.lit(0.0)))  # noqa: E741


def token_overlap(left, right) -> Column:
    """Share of the left tokens that the right has; stopwords and short tokens don't count.

    The left has none of them, so the right's words needn't be freed of them.
    """
    return _share(overlap_tokens(left), _words(col(right), "[a-z0-9]+"))


def plain_overlap(left, right) -> Column:
    """Share of the left tokens that the right has; all tokens count."""
    return _share(plain_tokens(left), _words(col(right), "[a-z0-9]+"))


def match_form(text) -> Column:
    """Lower case, with single spaces for everything but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(blank(col(text))), "[^a-z0-9]+", " "))


def query_keywords(text, limit: int = 10) -> Column:
    stop = F.array(*map(F.lit, KEYWORD_STOPWORDS))
    found = F.filter(_words(col(text), r"[a-z0-9][a-z0-9\\-]{2,}"), lambda t: ~F.array_contains(stop, t))
    return F.slice(F.array_distinct(found), 1, limit)


def contains_any(text, phrases: Sequence[str]) -> Column:
    low = F.lower(blank(col(text)))
    hits = [F.contains(low, F.lit(p)) for p in phrases]
    return F.greatest(*[h.cast("int") for h in hits]) == 1


def single_intent(question) -> Column:
    return ~contains_any(question, SPLIT_SIGNALS)


def numeric_focus(question) -> Column:
    return contains_any(question, NUMERIC_SIGNALS)


def ungrounded_answer(answer) -> Column:
    return contains_any(answer, UNGROUNDED_MARKERS)


def keyword_hits(text, keywords: Column) -> Column:
    """How many of the keywords the lower-cased text contains."""
    low = F.lower(blank(col(text)))
    return _bound(low, lambda low: F.aggregate(keywords, F.lit(0), lambda n, k: n + F.contains(low, k).cast("int")))


def contains_all(answer, keywords: Column) -> Column:
    low = F.lower(blank(col(answer)))
    return F.forall(keywords, lambda k: F.contains(low, F.lower(k)))


def _cut_at_word(text: Column, most: int) -> Column:
    """The first characters of a text without its last, broken word."""
    head = F.substring(text, 1, most)
    return F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)


def entity_description(name, text, most: int = 200) -> Column:
    """The first sentence that names the entity and is over 20 characters long, cut at a word if too long.

    Only sentences that can be it are stripped, and the one that is it is bound once.
    """
    name = blank(col(name))
    sentences = F.split(F.replace(blank(col(text)), F.lit("\n"), F.lit(" ")), "[.]")
    fits = lambda s: (F.length(s) > 20) & F.contains(F.lower(s), F.lower(name))
    hit = F.filter(F.transform(F.filter(sentences, fits), strip), fits)
    shown = F.transform(
        F.slice(hit, 1, 1), lambda s: F.when(F.length(s) > most, F.concat(_cut_at_word(s, most), F.lit("..."))).otherwise(s)
    )
    return F.when((name == "") | (blank(col(text)) == ""), F.lit("")).otherwise(F.coalesce(F.try_element_at(shown, F.lit(1)), F.lit("")))


def node_name(node_id, most: int = 50) -> Column:
    """A readable name: the telling part of a URL, long titles cut at a break, white space collapsed.

    Each step over the whole text is bound, so that it runs once.
    """

    def of(raw: Column) -> Column:
        is_url = raw.startswith("http://") | raw.startswith("https://")
        segments = F.filter(F.split(raw, "/"), lambda p: (F.length(p) > 3) & ~p.startswith("http"))
        last = _bound(segments, lambda s: F.when(F.size(s) > 0, F.translate(F.element_at(s, -1), "-_", "  ")))
        # null: a URL without a telling part
        return _bound(F.when(is_url, last).otherwise(raw), lambda named: F.when(named.isNotNull(), _bound(without_urls(named), cut)))

    def without_urls(named: Column) -> Column:
        named = F.when(F.contains(named, F.lit("http")), F.regexp_replace(named, r"https?://\S+", "")).otherwise(named)
        return _bound(named, lambda n: F.when(F.contains(n, F.lit("www.")), F.regexp_replace(n, r"www\.\S+", "")).otherwise(n))

    def cut(named: Column) -> Column:
        # a break within the head is the text's first one
        head = F.substring(named, 1, most)
        word = _cut_at_word(named, most)
        short = (
            F.when(F.length(named) <= most, named)
            .when(F.contains(head, F.lit(":")), F.substring_index(head, ":", 1))
            .when(F.contains(head, F.lit(" - ")), F.substring_index(named, " - ", 1))
            .when(F.contains(head, F.lit("'")), named)
            .otherwise(F.when(word.endswith("..."), word).otherwise(F.concat(word, F.lit("..."))))
        )
        return normalize(short)

    name = _bound(_bound(strip(node_id), of), lambda clean: F.when(clean == "", "Unknown").otherwise(F.coalesce(clean, F.lit("External Link"))))
    return F.when(blank(col(node_id)) == "", "Unknown").otherwise(name)


def node_confidence(node_id, name, description, source) -> Column:
    """How well an entity is grounded in its source, 0.05 to 0.95."""
    id_, name_, low = (F.lower(strip(x)) for x in (node_id, name, source))
    described, low = F.length(strip(description)), F.lower(blank(col(source)))
    named = (name_ != "") & ~name_.isin("unknown", "n/a")
    seen = ((id_ != "") & F.contains(low, id_)) | ((name_ != "") & F.contains(low, name_))
    points = (
        F.lit(500)
        + F.when(named, 150).otherwise(0)
        + F.when(described > 0, 150).otherwise(0)
        + F.when(described >= 40, 50).otherwise(0)
        + F.when((low != "") & seen, 100).otherwise(0)
    )
    return F.least(F.greatest(points, F.lit(50)), F.lit(950)) / F.lit(1000.0)


def embedding_text(name, description) -> Column:
    name, description = blank(col(name)), blank(col(description))
    return F.when(description != "", F.concat(name, F.lit(": "), description)).otherwise(name)


def chunk_source(name, page) -> Column:
    """Name of a chunk's source, with the page as people count."""
    page, name = col(page), F.coalesce(filled(col(name)), F.lit("unknown"))
    return F.when(page >= 0, F.concat(name, F.lit(" p."), (page + 1).cast("string"))).otherwise(name)


def is_digest(text) -> Column:
    return blank(col(text)).rlike("^[0-9a-fA-F]{32}$")


def canonical_label(label, vocabulary: Sequence[str]) -> Column:
    """The vocabulary's spelling of a label, whatever its case; others are trimmed."""
    known = F.create_map(*[F.lit(x) for v in vocabulary for x in (v.lower(), v)])
    trimmed = strip(label)
    return F.coalesce(F.try_element_at(known, F.lower(trimmed)), trimmed)
