"""Encoding and decoding with merge-type piece vocabularies.

A text becomes one string with U+2581 for spaces and one in front. Symbols are its characters; an agenda holds the
adjacent pairs that form a piece, best score first, then leftmost; the best pair merges until none is left. What is no
piece at the end becomes byte pieces. No piece holds U+2581 after another character (checked at load), so merges never
cross from a word into the next one: words are merged one by one and their ids kept. In each Arrow batch every whole text is
encoded by the sentencepiece library too; where the two differ, the library's ids are returned and ``agrees`` is false. Ids are
decoded by the library.

Defined results: null text counts as empty; an empty text is the begin and end ids alone; null or repeated identifiers
give a row each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import prepare, trimmed
from weftgraph.llm.packing import slices

SPACE = "▁"
#: A worker keeps the ids of so many words, of so many characters.
CACHED_WORDS, CACHED_CHARS = 400_000, 8_000_000
#: Words of up to so many characters are merged side by side, so many at a time.
SHORT, SIDE_BY_SIDE = 32, 8192
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """A vocabulary read through the library's accessors; its encoder serves as the check."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.vocab_size()
        pieces = [p.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i)}
        self.begin, self.end = p.bos_id(), p.eos_id()
        self.ids = {piece: i for i, piece in enumerate(pieces) if i not in special}
        self.cost = {piece: -p.get_score(i) for piece, i in self.ids.items()}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if p.is_byte(i)}
        if len(self.byte_ids) != 256 or any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("only vocabularies with byte pieces and word-initial spaces are supported")
        self.size = size
        self.char_ids = np.full(0x110000, -1, np.int32)
        parts: dict[int, tuple[float, int]] = {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
            for at in range(1, len(piece)):
                left, right = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if left is not None and right is not None:
                    parts[left * size + right] = (self.cost[piece], i)
        self.pair_keys = np.array(sorted(parts), np.int64)
        self.pair_costs, self.pair_ids = (
            np.array([parts[k][j] for k in self.pair_keys.tolist()], t) for j, t in ((0, np.float64), (1, np.int32))
        )
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise OSError("packed ids need a little-endian machine with 32-bit integers")
        self.words: dict[str, bytes] = {}
        self.chars = 0

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Packed ids of words. Short ones merge side by side, each round the best pair of each word's agenda."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT and "\0" not in w]
        short.sort(key=lambda i: len(words[i]))
        done = set()
        for at in range(0, len(short), SIDE_BY_SIDE):
            rows = short[at : at + SIDE_BY_SIDE]
            width = len(words[rows[-1]])
            chars = np.array([words[i] for i in rows], f"<U{width}").view(np.uint32).reshape(len(rows), width)
            symbols = self.char_ids[chars]
            plain = ((symbols >= 0) | (chars == 0)).all(axis=1)  # others need byte pieces
            merged = self._rounds(symbols[plain])
            counts = (merged >= 0).sum(axis=1)
            packed = merged.astype("<u4")
            for i, row, n in zip(np.array(rows)[plain].tolist(), packed, counts.tolist(), strict=True):
                out[i] = row[:n].tobytes()
                done.add(i)
        for i, w in enumerate(words):
            if i not in done:
                out[i] = array("I", self._ids(self._merge_long(w))).tobytes()
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of the pieces that pairs of ids form; infinite where they form none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_costs[at], np.inf), np.where(known, self.pair_ids[at], -1)

    def _rounds(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of ids (-1 after the end) with their merges done."""
        result = np.full_like(symbols, -1)
        place = np.arange(len(symbols))
        cost, piece = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1 and len(symbols):
            best = cost.argmin(axis=1)  # the leftmost of the best
            row = np.arange(len(symbols))
            ended = np.isinf(cost[row, best])
            if ended.any():
                result[place[ended], : symbols.shape[1]] = symbols[ended]
                symbols, cost, piece, best, place = (x[~ended] for x in (symbols, cost, piece, best, place))
                row = np.arange(len(symbols))
                if not len(row):
                    return result
            symbols[row, best] = piece[row, best]
            width = symbols.shape[1] - 1
            step = np.arange(width)
            symbols = np.take_along_axis(symbols, step + (step > best[:, None]), axis=1)
            step = step[:-1]
            after = step + (step >= best[:, None])
            cost, piece = np.take_along_axis(cost, after, axis=1), np.take_along_axis(piece, after, axis=1)
            for at in (best - 1, best):
                here = (at >= 0) & (at < width - 1)
                r, c = row[here], at[here]
                cost[r, c], piece[r, c] = self._pairs(symbols[r, c], symbols[r, c + 1])
        result[place, : symbols.shape[1]] = symbols
        return result

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        return self._ids(self._merge_long(word))

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            known = self.ids.get(s)
            out += [known] if known is not None else [self.byte_ids[b] for b in s.encode()]
        return out

    def _merge_long(self, word: str) -> list[str]:
        symbols = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        cost, agenda = self.cost.get, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (c := cost(pair)) is not None:
                agenda.append((c, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != len(pair):
                continue  # one of the two has merged since
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                joined = pair + symbols[following]
                if (c := cost(joined)) is not None:
                    heapq.heappush(agenda, (c, left, following, joined))
            if (previous := before[left]) >= 0:
                joined = symbols[previous] + pair
                if (c := cost(joined)) is not None:
                    heapq.heappush(agenda, (c, previous, left, joined))
        return [s for s in symbols if s]

    def _split(self, text: str) -> list[str]:
        """The words of a text, as they are cached: without the space in front, if it is one, else as they stand."""
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        words = WORDS.findall(SPACE + text.replace(" ", SPACE))
        return [w[1:] if len(w) > 1 and w[1] != SPACE else w for w in words]

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """Ids without begin and end, and whether merging and the library agree on them; where they don't, the library's."""
        known = self.words
        if len(known) > CACHED_WORDS or self.chars > CACHED_CHARS:
            known.clear()
            self.chars = 0
        split = [self._split(t) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if new:
            self.chars += sum(map(len, new))
            known.update(zip(new, self.merge_many([w if w[0] == SPACE else SPACE + w for w in new]), strict=True))
        get = known.__getitem__
        theirs = self.library.encode(texts, num_threads=1)
        return [(ids, b"".join(map(get, words)) == array("I", ids).tobytes()) for words, ids in zip(split, theirs, strict=True)]

    def coded(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """Packed ids with begin and end, their text as the library decodes it, and whether merging and the library agree."""
        out = []
        for ids, agrees in self.encode(texts):
            framed = [self.begin, *ids, self.end]
            out.append((array("I", framed).tobytes(), self.library.decode(framed), agrees))
        return out


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per document: id, n_tokens, ids (packed; null unless asked for), ids_sha256, decoded, decoded_sha256, agrees.

    ``ids`` and ``decoded`` are real outputs; digests let a caller leave them in the worker.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string, agrees boolean"
    )

    def run(batches):
        m = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names = batch.column(0)
            for at, part in slices(texts):
                rows = []
                for packed, decoded, agrees in m.coded(part):
                    rows.append((
                        len(packed) // 4, packed if with_ids else None, hashlib.sha256(packed).hexdigest(),
                        decoded if with_ids else None, hashlib.sha256(decoded.encode()).hexdigest(), agrees,
                    ))
                types = (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.bool_())
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                labels = ["id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256", "agrees"]
                yield pa.RecordBatch.from_arrays([names.slice(at, len(part)), *arrays], labels)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), schema)
