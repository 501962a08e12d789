"""Hashed word shingles of text batches as flat arrays."""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True


def mix(x: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(seed)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct run of ``words`` words, ordered by both; words are runs of [a-z0-9] in lower case."""
    texts = [t or "" for t in texts]
    joined = "\0".join(texts)
    if joined.count("\0") != max(len(texts) - 1, 0):
        joined = "\0".join(t.replace("\0", " ") for t in texts)
    data = np.frombuffer(joined.lower().encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    place = np.arange(len(at), dtype=np.uint64) - np.repeat(np.cumsum(end - start) - (end - start), end - start).astype(np.uint64)
    h = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * mix(place + np.uint64(12345)), np.append(0, np.cumsum(end - start)[:-1]))
    h = mix(h + (end - start).astype(np.uint64))
    text = np.searchsorted(np.flatnonzero(data == 0), start)
    last = len(h) - words + 1
    s = np.zeros(last, np.uint64)
    for i in range(words):
        s = mix(s + h[i : i + last] + np.uint64(i + 1))
    same = text[:last] == text[words - 1 :]
    s, text = s[same], text[:last][same]
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.append(True, (s[1:] != s[:-1]) | (text[1:] != text[:-1])) if len(s) else np.zeros(0, bool)
    return text[new], s[new]
