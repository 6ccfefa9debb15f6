"""Packing documents into sequences of a fixed number of tokens by best-two-fit.

Only documents longer than a sequence are cut: into full sequences, of which the first piece may be shorter. A sequence
has integer lengths of 1 to ``capacity``, so the packing is planned on the histogram of lengths (at most ``capacity``
counts, whatever the size of the corpus): the longest length left opens a bin, the bin is filled greedily with the longest
that fit, then its smallest document, if it isn't the opening one, is replaced by two unpacked ones that fit the expanded gap more tightly, as long as
that helps. A plan is a list of bins with multiplicities. Pieces find their bin by their rank among pieces of their
length; ranks are counted within each task and offset by the counts of the tasks before, so that a length shared by a
third of all documents is never gathered.

Defined results: null text counts as empty; an empty text is one piece that holds the end id alone; null or repeated
identifiers are packed like any others; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, trimmed

END = 2
CAPACITY = 1024
#: Counts by task and length that are broadcast (about 40 bytes each), those of about 1,000 tasks; beyond, the join shuffles.
BROADCAST_COUNTS = 1_000_000
#: Fixed value: how byte-level vocabularies of this kind split texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's search keeps a state for each white-space character of a run and fails at a million of them.
RUN = 100_000
LONG_RUN = re.compile(rf"(?<!\s)\s{{{RUN}}}")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Ids of a tokenizers file as little-endian unsigned 32-bit integers, as its library gives them by default: the string
    of an added token in a text is that token.

    Where the file's merges are in the order of their ids, and it splits as usual, merging by rank gives the same ids: its
    vocabulary is then run by tiktoken, which takes a quarter of the time. Any other file is run by tokenizers, and so are
    texts that hold the string of an added token, or a very long run of white space, at which tiktoken fails.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        file = json.loads(Path(path).read_text())
        self.ranked, self.added = self._ranked(file), [t["content"] for t in file.get("added_tokens", []) if t["content"]]

    @staticmethod
    def _ranked(file: dict):
        split, bpe = file.get("pre_tokenizer") or {}, file["model"]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        merges = [m if isinstance(m, str) else " ".join(m) for m in bpe.get("merges", [])]
        ids = [bpe["vocab"].get(m.replace(" ", "")) for m in merges]
        odd = (bpe.get("dropout"), bpe.get("unk_token"), bpe.get("continuing_subword_prefix"), bpe.get("end_of_word_suffix"))
        if (
            bpe["type"] != "BPE" or file.get("normalizer") or any(odd) or bpe.get("ignore_merges")
            or any(split.get(k) != v for k, v in usual.items()) or None in ids or ids != sorted(set(ids))
        ):
            return None
        import tiktoken

        special = {t["content"] for t in file.get("added_tokens", [])}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in k): i for k, i in bpe["vocab"].items() if k not in special}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def direct(self, texts: list[str]) -> list[bytes]:
        if self.tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self.direct(texts)
        ids = self.ranked.encode_ordinary
        return [self.direct([t])[0] if self._odd(t) else np.array(ids(t), "<u4").tobytes() for t in texts]

    def _odd(self, text: str) -> bool:
        return any(a in text for a in self.added) or len(text) >= RUN and LONG_RUN.search(text) is not None


_TOKENIZERS: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteBpe(path)
    return _TOKENIZERS[path]


def slices(texts: list[str], chars: int = 1_000_000):
    """Runs of texts of about so many characters, and where each run begins."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(
    docs: DataFrame,
    path: str,
    *,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids (null unless asked for), task, rank.

    ``rank`` counts the pieces of a length within a task; both only mean something in a table that has been written.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, task int, rank long"

    def run(batches):
        from pyspark import TaskContext

        encode, task, seen = tokenizer(path).encode, TaskContext.get().partitionId(), Counter()
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names = batch.column(0)
            for at, part in slices(texts):
                of, rows = [], []
                for i, ids in enumerate(encode(part), at):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        of.append(i)
                        rows.append((k, start, length, zlib.crc32(own), own if with_ids else None, task, seen[length]))
                        seen[length] += 1
                columns = list(zip(*rows, strict=True))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                arrays = [names.take(pa.array(of, pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                labels = ["id", "piece", "start", "length", "ids_crc32", "ids", "task", "rank"]
                yield pa.RecordBatch.from_arrays(arrays, labels)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times), from the number of pieces of each length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens can't be packed into {capacity}")
        left[length] = n
    bins = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return bins
        held = Counter([top])
        gap = capacity - top

        def longest(most: int, but: Counter) -> int:
            return next((x for x in range(min(most, top), 0, -1) if left[x] > but[x]), 0)

        while gap and (x := longest(gap, held)):
            held[x] += 1
            gap -= x
        while gap and sum(held.values()) > 1:
            smallest = min(held)
            rest = held - Counter([smallest])
            room = gap + smallest
            # two unpacked documents for the smallest one; it stays available itself
            best = (smallest, 0)
            for x in range(min(room - 1, top), room // 2 - 1, -1):
                if x < 1 or sum(best) == room:
                    break
                if left[x] > rest[x]:
                    y = longest(min(room - x, x), rest + Counter([x]))
                    if y and x + y > sum(best):
                        best = (x, y)
            if not best[1]:
                break
            held = rest + Counter(best)
            gap = room - sum(best)
        times = min(left[x] // n for x, n in held.items())
        for x, n in held.items():
            left[x] -= n * times
        bins.append((sorted(held.elements(), reverse=True), times))


def _slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go: from rank ``low`` on, to sequence ``base + rank - low`` at ``offset``."""
    rows, used, base = [], Counter(), 0
    for lengths, times in bins:
        at = 0
        for length in lengths:
            rows.append((length, used[length], base, at))
            used[length] += times
            at += length
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "low", "base", "offset"), table.T, strict=True))


def pack(table: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (columns length, task and rank)."""
    scratch = Scratch(table.sparkSession, "ranks")
    counts = scratch.table(table.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = _slots(plan(histogram, capacity))
    before = counts.selectExpr(
        "task", "length", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before"
    )
    # pieces with their ids stay where they are while there are few enough tasks
    joined = table.join(F.broadcast(before) if counts.count() <= BROADCAST_COUNTS else before, ["task", "length"])
    kept = [c for c in table.columns if c not in ("task", "rank")]
    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id long, offset long"
    key = slots["length"] * (1 << 44) + slots["low"]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            sequence, offset = slots["base"][at] + rank - slots["low"][at], slots["offset"][at]
            arrays = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])

    return joined.select(*kept, *(c for c in ("rank", "before") if c not in kept)).mapInArrow(trimmed(run), schema)


def pack_documents(
    docs: DataFrame,
    path: str,
    *,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids (null unless asked for), sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pack")
    cuts = pieces(docs, path, capacity=capacity, id_col=id_col, text_col=text_col, with_ids=with_ids)
    return pack(scratch.table(cuts, "pieces"), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves (at most ``capacity`` ids each): sequence_id, ids as packed integers, document ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "id")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id",
        F.expr("aggregate(rows, cast('' as binary), (a, r) -> concat(a, r.ids))").alias("ids"),
        F.col("rows.id").alias("documents"),
    )
