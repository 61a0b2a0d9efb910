"""Statistics of whole texts, worked out for many texts at once in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import WORD_BYTES, mix64

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Distinct words a worker remembers the hash of; the table is emptied when full.
CACHE = 400_000
#: Bytes of text handled at a time; a longer text is handled alone, but whole.
BATCH_BYTES = 4_000_000

_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")


class WordHashes(dict):
    """Word -> a random 64-bit value, from Python's bytes through a fixed scrambling."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 3)
        return value


def chunked(texts: list[str], most: int = BATCH_BYTES):
    """Runs ``(start, end)`` of texts of at most ``most`` characters, or one long text."""
    at = 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < len(texts) and size + len(texts[end]) <= most:
            size, end = size + len(texts[end]), end + 1
        yield at, end
        at = end


def hash_words(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's number of words."""
    if len(known) > CACHE:
        known.clear()
    words = [WORD_BYTES.findall(t) for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    get = known.__getitem__
    flat = np.fromiter((get(w) for ws in words for w in ws), dtype=np.uint64, count=int(counts.sum()))
    return flat, counts


_SPREAD, _PLACE = np.random.default_rng(9).integers(1, 1 << 62, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(texts: list[bytes]):
    """Words of all texts in one buffer: buffer, starts, ends, and the text of each word."""
    buffer = np.frombuffer(b"".join([t + b"\n" for t in texts]), dtype=np.uint8)
    space = _SPACE[buffer]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text = np.searchsorted(np.cumsum(sizes + 1), start, side="right")
    return buffer, start, end, text


def span_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a sum of random values of byte and place, scrambled."""
    if not start.size:
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    inside = np.flatnonzero(~_SPACE[buffer])
    place = inside - np.repeat(start, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_SPREAD[buffer[inside]] * _PLACE[place & 255], np.cumsum(length) - length)
    h = mix64(h ^ (length.astype(np.uint64) << np.uint64(48)))
    for k in np.flatnonzero(length > 256):
        h[k] = xxhash.xxh64_intdigest(buffer[start[k] : end[k]].tobytes(), 3)
    return h


def repeated_windows(flat: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words found twice or more in its text."""
    n = flat.size
    covered = np.zeros(n, dtype=bool)
    if n < width:
        return covered
    text = np.repeat(np.arange(counts.size), counts)
    m = n - width + 1
    key = mix64(text[:m].astype(np.uint64))
    for k in range(width):
        key = mix64(key ^ flat[k : m + k])
    inside = np.flatnonzero(text[:m] == text[width - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(s.size, dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k in range(width):
        covered[order[twice] + k] = True
    return covered


def duplicate_lines(text: str) -> tuple[int, int]:
    r"""Lines (\n-split) that hold a word, and how many of them equal an earlier line."""
    if "\n" not in text:
        return int(bool(_LINE_WORD.search(text))), 0
    lines = [s for s in text.split("\n") if _LINE_WORD.search(s)]
    return len(lines), len(lines) - len(set(lines))


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's words; texts without words sum to 0."""
    ends = np.cumsum(counts)
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[ends] - total[ends - counts]
