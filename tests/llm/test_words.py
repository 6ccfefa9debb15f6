from __future__ import annotations

import random

import numpy as np

from weftgraph.llm import words


def test_equal_words_have_equal_hashes(monkeypatch):
    rng = random.Random(1)
    parts = ["a", "B", "é", "漢", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "word", "WORD", "ab", "ba", "\x00", ""]
    for block in (1 << 20, 64, 7):
        monkeypatch.setattr(words, "BLOCK", block)
        texts = [None, "", " ", "x" * 300, *("".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400))]
        hashes, counts = words.hash_words(texts)
        expected = [w for t in texts for w in (t or "").encode().lower().split()]
        assert counts.tolist() == [len((t or "").encode().split()) for t in texts] and len(hashes) == len(expected)
        names: dict[int, bytes] = {}
        seen: dict[bytes, int] = {}
        for h, w in zip(hashes.tolist(), expected, strict=True):
            assert names.setdefault(h, w) == w and seen.setdefault(w, h) == h


def test_hashes_spread():
    hashes, _ = words.hash_words([" ".join(f"{a}{b}" for a in range(1000) for b in "abcdefgh")])
    assert len(np.unique(hashes)) == 8000
    assert len(np.unique(hashes >> np.uint64(40))) > 7900 and len(np.unique(hashes & np.uint64(0xFFFFFF))) > 7900


def test_no_texts():
    hashes, counts = words.hash_words([])
    assert len(hashes) == len(counts) == 0
