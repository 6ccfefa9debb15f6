"""URL filtering against dated lists.

A list is a log of entries (pattern, action, day): an entry holds from its day until the next one of its pattern, so the
log becomes validity intervals. A capture asks for its host, each parent domain and each folder of its path; an as-of join
on the pattern finds the entries active on the day of the capture. The longest active pattern decides.

Patterns are "example.com" (that host and its subdomains) or "example.com/a/" (URLs of that host below that folder); an IPv6
host, "[::1]", has no parents. Days may be dates or, for finer intervals, timestamps, of the same type on both sides.
Actions are allow, block and remove (which ends the pattern's entry).

Defined results: of entries of one pattern and day the last in the order allow, block, remove holds; entries with a null
pattern, action or day are ignored; a null, empty or unparsable URL and a null day match nothing; repeated captures each
have their row; an empty list gives every capture the verdict none; an empty table gives no rows; extra columns are
kept, but for those named like an output column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import UPPER, fresh

#: The intervals are sent to all executors only up to this many (about 100 bytes each); beyond, the join shuffles.
BROADCAST_INTERVALS = 100_000

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.regexp_replace(F.translate(found, UPPER, UPPER.lower()), r"\.$", "")


def keys(url: Column) -> Column:
    """All patterns that a URL can match: its host, the parent domains, and the folders of its path."""
    name, path = host(url), F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)
    labels = F.split(name, r"\.")
    domains = F.when(name.startswith("["), F.array(name)).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    parts = F.split(path, "/")
    folders = F.when(
        F.size(parts) > 2,
        F.transform(
            F.sequence(F.lit(2), F.size(parts) - 1),
            lambda i: F.concat(name, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(domains, folders))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (pattern, action, since, until) of a log of entries (pattern, action, day)."""
    order = "PARTITION BY pattern ORDER BY day, action"
    valid = entries.where("pattern IS NOT NULL AND day IS NOT NULL AND action IN ('allow', 'block', 'remove')")
    dated = valid.selectExpr(
        "pattern", "action", "day AS since", f"lead(day) OVER ({order}) AS until"
    )
    return dated.where("action <> 'remove' AND (until IS NULL OR since < until)")


def judge(
    captures: DataFrame, entries: DataFrame, *, url_col: str = "url", day_col: str = "day"
) -> DataFrame:
    """Captures with verdict (allow, block or none), rule, since and n_active (active entries that match)."""
    url, day, pattern = fresh(captures, "url", "day", "pattern")
    asked = captures.select(F.col(url_col).alias(url), F.col(day_col).alias(day)).distinct()
    asked = asked.select(url, day, F.explode(keys(F.col(url))).alias(pattern))
    active = intervals(entries)
    if active.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS:
        active = F.broadcast(active)
    on = (
        (F.col(pattern) == F.col("pattern"))
        & (F.col("since") <= F.col(day))
        & (F.col("until").isNull() | (F.col(day) < F.col("until")))
    )
    longest = F.max(F.struct(F.length("pattern").alias("chars"), "pattern", "action", "since")).alias("top")
    found = asked.join(active, on).groupBy(url, day).agg(longest, F.count(F.lit(1)).alias("n_active"))
    u, d, verdict, rule, since, n = fresh(captures, "u", "d", "verdict", "rule", "since", "n")
    found = found.select(
        F.col(url).alias(u), F.col(day).alias(d),
        F.col("top.action").alias(verdict), F.col("top.pattern").alias(rule), F.col("top.since").alias(since),
        F.col("n_active").alias(n),
    )
    joined = captures.join(found, (F.col(url_col) == F.col(u)) & (F.col(day_col) == F.col(d)), "left")
    added = ("verdict", "rule", "since", "n_active")
    return joined.select(
        *[c for c in captures.columns if c.lower() not in added],
        F.coalesce(verdict, F.lit("none")).alias("verdict"),
        F.col(rule).alias("rule"),
        F.col(since).alias("since"),
        F.coalesce(n, F.lit(0)).alias("n_active"),
    )
