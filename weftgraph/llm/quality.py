"""Quality by a generalised additive model with pairwise interactions.

A text becomes a row of measures, each cut into bins. Cyclic boosting visits one measure after another and adds a shallow
tree over its bins, many rounds with small steps; the trees of a measure add up to one look-up table. Then the pairs of
measures that explain most of what is left are boosted in the same way, as tables of two measures. A score is the logistic
function of the sum of the tables' entries.

The model is fitted on the driver, on at most ``TRAIN_ROWS`` labelled rows that a hash of the identifier chooses; scoring
covers every text, whole. Only the text enters a score.

Defined results: null text counts as empty, and an empty text has a score like any other; rows without a label, and labels
other than 0 and 1, teach nothing; without labels of both kinds every score is 0.5; null and repeated identifiers have a
row each; an empty table gives no rows; extra columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, prepare, trimmed

#: Bound of the labelled rows used in training (a row has under 200 bytes).
TRAIN_ROWS = 40_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, STEP = 32, 8, 120, 60, 6, 0.15

MEASURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "lower", "digit", "symbol", "stop",
    "space", "high_bytes", "entropy", "distinct_words", "distinct_lines", "mean_line", "ended_lines", "capital_words",
    "marked_words", "top_word", "repeated_pairs", "brackets",
)

_BYTE = np.arange(256)
_IS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "symbol": np.isin(_BYTE, list(b"#$%&*!@^~=+|\\/<>_`")),
    "stop": np.isin(_BYTE, list(b".,;:?'\"-")),
    "space": np.isin(_BYTE, list(b" \t\n\r\x0b\x0c")),
    "high_bytes": _BYTE >= 128,
    "brackets": np.isin(_BYTE, list(b"()[]{}<>")),
}


def measure(text: str | None) -> np.ndarray:
    """The measures of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = {k: counts[v].sum() / n for k, v in _IS.items()}
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    m, k = max(1, len(words)), max(1, len(lines))
    p = counts[counts > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean() if len(words) else 0.0, (sizes > 14).sum() / m,
        (sizes <= 3).sum() / m, share["upper"], share["lower"], share["digit"], share["symbol"], share["stop"],
        share["space"], share["high_bytes"], -(p * np.log2(p)).sum() if len(raw) else 0.0, len(seen) / m,
        len(set(lines)) / k, np.log1p(len(raw) / k), sum(x.rstrip()[-1:] in b".!?:" for x in lines) / k,
        sum(w[:1].isupper() for w in words) / m, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m,
        max(seen.values(), default=0) / m, 1 - pairs / max(1, len(words) - 1), share["brackets"],
    ])


@dataclass
class Model:
    """Look-up tables: ``cuts`` of each measure, ``tables`` by bin, and tables of pairs over coarser bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            at = (np.searchsorted(self.pair_cuts[i], x[:, i], "right") for i in (a, b))
            total += table[tuple(at)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins with gradient sums g and weights h: its value for each bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return out
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a table of two measures into four quadrants: its values, and the gain."""
    cg, ch = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    best, out = 0.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [
                tuple(c[x1, y1] - c[x0, y1] - c[x1, y0] + c[x0, y0] for c in (cg, ch))
                for x0, x1 in ((0, i), (i, -1))
                for y0, y1 in ((0, j), (j, -1))
            ]
            gain = sum(a * a / (b + 1) for a, b in parts)
            if gain > best:
                best = gain
                out = np.empty(g.shape)
                for (a, b), rows, cols in zip(parts, (slice(0, i),) * 2 + (slice(i, None),) * 2,
                                              (slice(0, j), slice(j, None)) * 2, strict=True):
                    out[rows, cols] = _leaf(a, b)
    return out, best - g.sum() ** 2 / (h.sum() + 1)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single measures, then of the pairs that explain most of the rest."""
    d = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0, [np.empty(0)] * d, [np.zeros(1)] * d, [], [np.empty(0)] * d, [])
    rate = y.mean()
    base = float(np.log(rate / (1 - rate)))
    cuts = [_cuts(x[:, j], BINS) for j in range(d)]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    margin = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = (np.bincount(bins[j], w, len(tables[j])) for w in slopes())
            step = STEP * _tree(g, h)
            tables[j] += step
            margin += step[bins[j]]

    pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]
    size = [len(c) + 1 for c in pair_cuts]

    def grids(a: int, b: int):
        at = coarse[a] * size[b] + coarse[b]
        return [np.bincount(at, w, size[a] * size[b]).reshape(size[a], size[b]) for w in slopes()]

    gains = {(a, b): _quadrants(*grids(a, b))[1] for a in range(d) for b in range(a + 1, d)}
    pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    pair_tables = [np.zeros((size[a], size[b])) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(pairs, pair_tables, strict=True):
            step = STEP * _quadrants(*grids(a, b))[0]
            table += step
            margin += step[coarse[a], coarse[b]]
    return Model(base, cuts, tables, pairs, pair_cuts, pair_tables)


def held_out(id_: Column) -> Column:
    """Rows from whose labels nothing is learnt: crc32 of the identifier as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measured(texts: DataFrame, extra: str, names: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(0)]
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0))
            lists = pa.FixedSizeListArray.from_arrays(flat, len(MEASURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], [*names, "x"])

    return texts.mapInArrow(trimmed(run), f"{extra}, x array<double>")


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = TRAIN_ROWS,
) -> Model:
    """A model of the labelled rows that aren't held out, or of a chosen share of them if they are more than ``rows``."""
    scratch = Scratch(docs.sparkSession, "quality")
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    usable = usable.where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    share = rows / max(1, usable.count())
    if share < 1:
        # a little less than the bound, so that chance doesn't exceed it
        usable = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(0.97 * share * (1 << 20)))
    chosen = F.broadcast(scratch.table(usable.limit(rows), "labels"))
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("_doc"))
    joined = texts.join(chosen, F.col("_doc") == F.col("_id")).select("text", F.col("_label").alias("label"))
    # repeated documents of one identifier could exceed the bound
    found = _measured(joined, "label int", ["label"]).limit(2 * rows).toPandas()
    if not len(found):
        return fit(np.empty((0, len(MEASURES))), np.empty(0))
    order = sorted(range(len(found)), key=lambda i: (found.label[i], tuple(found.x[i])))
    return fit(np.array(found.x.tolist())[order], found.label.to_numpy(float)[order])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([measure(t.as_py()) for t in batch.column(0)])
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.scores(x))], ["id", "score"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    return texts.mapInArrow(trimmed(run), f"id {kind}, score double")


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``least``, with all their columns."""
    prepare(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([measure(t.as_py()) for t in batch.column(at)])
                yield batch.filter(pa.array(model.scores(x) >= least))

    return docs.mapInArrow(trimmed(run), docs.schema)
