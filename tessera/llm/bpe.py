"""Byte-level BPE by depth-first traversal of the prefix trie of distinct words.

For every prefix of a word the byte-pair merges end in exactly one token, and the
encoding of the prefix is the encoding of what stands before that token, plus the
token. So one state, the last token, is kept for each trie node. Sorted words visit
the trie depth first: states of the path shared with the word before stay on the
stack, and only new nodes are worked out. A node's last token is the one vocabulary
token ending there that merges would leave standing next to the last token before it.
An automaton over the vocabulary (Aho and Corasick's) names the tokens that end at a node.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space on both sides of a space, or before one that ends the text.
UNSAFE = regex.compile(r"[\s\x1c-\x1f] (?:[\s\x1c-\x1f]|\Z)")
#: Bytes of units and ids, with what Python adds, in a generation of a task's cache, and characters of the longest unit kept in it.
CACHE_BYTES = 20 << 20
CACHED_UNIT = 48
ENTRY = 200
#: Characters of text encoded at a time.
BATCH_CHARS = 3_000_000
#: Pairs of neighbours whose fit is remembered.
FITS = 250_000
#: Steps of the automaton that are remembered, its edges among them.
STEPS = 500_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-in character of each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, chars = spec["model"], _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            rank.setdefault(a + b, 256 + k)
            self.halves.append((rank[a], rank[b]))
            self.joined.setdefault((rank[a], rank[b]), 256 + k)
        self.rank = rank
        ids = {raw(s): i for s, i in model["vocab"].items() if all(c in chars for c in s)}
        self.ident = np.zeros(256 + len(pairs), dtype="<u4")
        self.bytes_of: dict[int, bytes] = {i: s for s, i in ids.items()}
        for s, r in rank.items():
            self.ident[r] = ids[s]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths = [0] * len(self.ident)
        for s, r in rank.items():
            self.lengths[r] = len(s)
        self.packed = [int(i).to_bytes(4, "little") for i in self.ident]
        self._automaton()
        self.forget()

    def _automaton(self) -> None:
        """States are the prefixes of tokens; 0 is the empty one.

        edges: state << 8 | byte to the longer prefix; back: the longest proper suffix that
        is a prefix, too; ends: the tokens, longest first, that end a state, and their lengths.
        """
        self.edges: dict[int, int] = {}
        self.back, self.ends, own = [0], [()], [None]
        for token, r in self.rank.items():
            state = 0
            for byte in token:
                state = self.edges.setdefault(state << 8 | byte, len(own))
                if state == len(own):
                    own.append(None), self.back.append(0), self.ends.append(())
            own[state] = r
        # Shorter prefixes first: what a state falls back to is shorter and so is settled.
        level = [0]
        below: list[list[int]] = [[] for _ in own]
        for key in self.edges:
            below[key >> 8].append(key)
        while level:
            deeper = []
            for state in level:
                for key in below[state]:
                    child = self.edges[key]
                    self.back[child] = back = self._step(self.back[state], key & 255) if state else 0
                    self.ends[child] = self.ends[back] if own[child] is None else ((own[child], self.lengths[own[child]]), *self.ends[back])
                    deeper.append(child)
            level = deeper

    def _step(self, state: int, byte: int) -> int:
        """The longest prefix of a token that ends the state's text and the byte."""
        while True:
            to = self.edges.get(state << 8 | byte)
            if to is not None:
                return to
            state = self.back[state]

    def forget(self) -> None:
        """Empty the caches; the vocabulary stays."""
        self.fits: dict[int, bool] = {}
        self.steps = dict(self.edges)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def stands(self, left: int, right: int) -> bool:
        """Whether merges leave the border between two adjacent tokens alone.

        Merges are undone latest first on either side of the border; if a pair that
        then meets there merges earlier than what was undone, the border would not
        have survived.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            bound, ok = 1 << 60, True
            while True:
                if self.joined.get((left, right), bound) < bound:
                    ok = False
                    break
                if left < 256 and right < 256:
                    break
                if left > right:  # the left token came last: only its tail remains at the border
                    bound, left = left, self.halves[left][1]
                else:
                    bound, right = right + 1, self.halves[right][0]
            if len(self.fits) > FITS:
                self.fits.clear()
            known = self.fits[key] = ok
        return known

    def encode_words(self, words) -> dict[str, bytes]:
        """Packed little-endian ids of each distinct word."""
        known, steps, ends, fits, stands, lengths, packed = self.steps.get, self.steps, self.ends, self.fits, self.stands, self.lengths, self.packed
        out, path, last, states = {}, b"", [0], [0]
        push, reach = last.append, states.append
        for word in sorted(words):
            raw, shared = word.encode(), 0
            for a, b in zip(path, raw):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for byte in raw[shared:]:
                end += 1
                key = state << 8 | byte
                state = known(key)
                if state is None:
                    state = self._step(key >> 8, byte)
                    if len(steps) < STEPS:
                        steps[key] = state
                reach(state)
                for token, size in ends[state]:
                    if size == end:
                        break
                    fit = fits.get(last[end - size] << 20 | token)
                    if fit or fit is None and stands(last[end - size], token):
                        break
                push(token)
            path, tokens = raw, []
            while end:
                token = last[end]
                tokens.append(packed[token])
                end -= lengths[token]
            tokens.reverse()
            out[word] = b"".join(tokens)
        return out

    def encode_units(self, units) -> dict[str, bytes]:
        """Packed ids of each distinct unit.

        A unit is what stands between two cuts no piece crosses. The cache has two
        generations of CACHE_BYTES; a unit used again moves to the young one, and when
        that is full it becomes the old one, so memory is bounded and common units stay.
        Long units are not kept.
        """
        out, words, cut = {}, set(), {}
        young, old = self.young, self.old
        for unit in units:
            known = young.get(unit)
            if known is None:
                known = old.get(unit)
                if known is None:
                    # ASCII letters, a space at most before them, are one piece.
                    if unit.isascii() and unit[unit[0] == " " :].isalpha():
                        words.add(unit)
                    else:
                        cut[unit] = pieces = PIECES.findall(unit)
                        words.update(pieces)
                    out[unit] = None
                    continue
                self._keep(unit, known)
                young, old = self.young, self.old
            out[unit] = known
        codes = self.encode_words(words)
        for unit, ids in out.items():
            if ids is None:
                pieces = cut.get(unit)
                out[unit] = ids = codes[unit] if pieces is None else b"".join([codes[w] for w in pieces])
                if len(unit) <= CACHED_UNIT:
                    self._keep(unit, ids)
        return out

    def _keep(self, unit: str, ids: bytes) -> None:
        self.held += len(unit) + len(ids) + ENTRY
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[unit] = ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts.

        Texts are cut before spaces: there a piece always ends unless white space
        stands on both sides, and such texts stay whole. Each distinct unit of a
        batch is worked out once.
        """
        # Of each text a unit that stands as it is, or many that follow a space each, by turns.
        cut, whole, spaced = [], set(), set()
        for text in texts:
            parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else (text,)
            runs = []
            for part in parts:
                if part in self.special:
                    runs.append(part)
                elif part and UNSAFE.search(part):
                    runs.append(part)
                    whole.add(part)
                elif part:
                    first, *rest = part.split(" ")
                    if first:
                        runs.append(first)
                        whole.add(first)
                    runs.append(rest)
                    spaced.update(rest)
            cut.append(runs)
        whole.update([" " + unit for unit in spaced])
        codes = self.encode_units(whole)
        after = {unit: codes[" " + unit] for unit in spaced}.__getitem__
        codes.update((s, i.to_bytes(4, "little")) for s, i in self.special.items())
        return [b"".join([codes[run] if isinstance(run, str) else b"".join(map(after, run)) for run in runs]) for runs in cut]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def load(path: str) -> TrieBPE:
    """The vocabulary file is part of the installed tokenizers on every machine."""
    with open(path, encoding="utf-8") as f:
        return TrieBPE(f.read())


def vocabulary(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, columns=("doc_id",), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """Encode and decode every whole text of ``docs``.

    ``columns`` of docs are kept; ``outputs`` chooses among n_tokens long, ids (packed
    little-endian uint32), decoded string and the lowercase hex digests of both.
    Null text counts as empty: no ids, digest of the empty string. Rows are handled
    one by one in Arrow batches, without a shuffle; a very long text is one row and
    no row is cut. Repeated rows repeat their results, an empty table gives an empty
    one. Special-token strings in a text become their id, as in the library.
    """
    path = vocabulary(path)
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("binary", pa.binary()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches):
        bpe = load(path)
        for batch in batches:
            n, texts = len(columns), [t or "" for t in batch.column(len(columns)).to_pylist()]
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                    size, end = size + len(texts[end]), end + 1
                ids = bpe.encode_batch(texts[at:end])
                made = {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}
                back = [bpe.decode(x) for x in ids]
                if "decoded" in outputs:
                    made["decoded"] = back
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                if "decoded_sha256" in outputs:
                    made["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                cols = [batch.column(k).slice(at, end - at) for k in range(n)] + [pa.array(made[k], kinds[k][1]) for k in outputs]
                yield pa.RecordBatch.from_arrays(cols, [*(f"c{k}" for k in range(n)), *outputs])
                at = end
        # A worker that is used again keeps the vocabulary alone.
        bpe.forget()

    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], F.col("text").alias("text"))
    schema = ", ".join([*(f"c{k} {rows.schema[k].dataType.simpleString()}" for k in range(len(columns))), *(f"{k} {kinds[k][0]}" for k in outputs)])
    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], *outputs)


def op6_bpe_trie(spark, sf_dir: str) -> DataFrame:
    """Contract query: token count and digests of ids and decoded text per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
