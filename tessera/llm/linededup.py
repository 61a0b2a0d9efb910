"""Line dedup by a deletion-neighbourhood join.

Lines are what newlines part; a line's words are what lies between white space, and lines
compare by their words. A line is dropped if an earlier line, by (doc_id, text hash,
line number), has the same words or is within the edit bound: so many words changed,
left out or added. Earlier lines count whether or not they are dropped themselves.
The bound is a function of the number of words n of the shorter line, ``edit_bound``:
none under MIN_WORDS words (one edit would be a third of them or more), else one for
each EDIT_WORDS words, one at least.

1. Each line sends keys that two lines within the bound must share. Lines of up to LONG
   words (a bound of one) send their words without one of SEGMENTS stretches. Longer ones
   send winnowed fingerprints, the least hash of SHINGLE words in each window of WINDOW
   places: k edits leave a stretch of (n - k) / (k + 1) words alone, here
   SHINGLE + WINDOW - 1 or more. Lines that share no key have no partner.
2. The words of the others are read again. Lines of up to LONG words emit all variants
   with at most one word deleted as hashed keys; within one edit two lines share a
   variant. Members of a variant meet its earliest line alone, never one another.
3. Longer lines meet the earliest line of each fingerprint. Those it leaves open meet the
   other members in pieces that no group outgrows: first each its likeliest partners of a
   piece, by counts of words, then, if still open, all whose counts allow the bound.
4. The edit distance of every pair found so is worked out over the words.

Equal lines are equal in 96 hashed bits; keys of 64 bits only propose pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize, mix64, parts, text_bytes, unused
from .hotgroups import by_piece, chunk_pairs
from .textstats import chunked, span_hashes, word_spans

SEGMENTS = 3
#: Lines with fewer words allow no edit.
MIN_WORDS = 4
#: Words to an edit; from LONG words on the bound is more than one.
EDIT_WORDS = 24
LONG = 2 * EDIT_WORDS
#: SHINGLE + WINDOW - 1 = 16 words are the least stretch that k edits leave of 24 * k words or more, k > 1.
SHINGLE = 8
WINDOW = 9
#: A long line's words are counted by hash in so many bins; an edit moves two counts by one.
BINS = 32
#: Hashes of lines a task remembers, so that a line that repeats sends its keys once.
SEEN = 500_000
#: Members of a fingerprint compared in one piece, and partners of a line tried at first.
CHUNK = 1024
LIKELY = 4
#: Words of pairs compared at a time.
WORDS = 1 << 20
#: Keys a task packs at a time, keys of a pack at most, buckets of packs to a partition, and keys of a bucket held.
PACKED = 1 << 19
PACK = 128
BUCKETS = 32
HELD = 1 << 20

#: Place of a line: the order in which the earliest is kept.
AT = ("doc_id", "row", "line")

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OTHER = 0xC2B2AE3D27D4EB4F
_TAG = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _mix(x: np.ndarray, tag: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (tag.astype(np.uint64) * _TAG)
        x ^= x >> np.uint64(32)
        x *= _TAG
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


class Lines:
    """The lines with words of some texts, with polynomial hashes of any stretch of their words.

    text, number: place of each line; first, n: its words; sums: running sums of word
    hashes times powers, so that sums[first + k] - sums[first] hashes the first k words.
    """

    def __init__(self, texts: list[bytes]):
        buffer, start, end, text = word_spans(texts)
        self.words = h = span_hashes(buffer, start, end)
        breaks = np.flatnonzero(buffer == 10)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        line = np.searchsorted(breaks, start)
        self.first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if line.size else np.zeros(0, np.int64)
        self.n = np.diff(np.r_[self.first, line.size])
        self.text = text[self.first]
        self.number = line[self.first] - np.searchsorted(breaks, np.cumsum(sizes) - sizes)[self.text]
        place = np.arange(line.size) - np.repeat(self.first, self.n)
        most = int(self.n.max(initial=0))
        self.inverse = _powers(_INVERSE, most)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, most)[place], dtype=np.uint64)]
        self.total = self._prefix(self.n)
        self.hash = _mix(self.total, self.n)
        # An independent hash of the same words in order.
        with np.errstate(over="ignore"):
            other = np.r_[np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(29))) * _powers(_OTHER, most)[place], dtype=np.uint64)]
            self.check = ((other[self.first + self.n] - other[self.first]) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def _prefix(self, k) -> np.ndarray:
        return self.sums[self.first + k] - self.sums[self.first]

    def coarse_keys(self, segments: int = SEGMENTS) -> np.ndarray:
        """Hashes of each line without one stretch, as the shorter or the longer of a pair.

        Stretches are cut by the length n of the shorter line. As the shorter (or equally
        long) line it drops one of ``segments`` stretches of its n words; as the longer
        line, with n + 1 words, the stretch dropped has one word more.
        """
        keys = []
        with np.errstate(over="ignore"):
            for n in (self.n, self.n - 1):
                for i in range(segments):
                    a, b = n * i // segments, n * (i + 1) // segments + self.n - n
                    keys.append(_mix(self._prefix(a) + (self.total - self._prefix(b)) * self.inverse[b - a], n * segments + i))
        return np.stack(keys, axis=1)

    def fingerprints(self, some: np.ndarray):
        """The distinct winnowed fingerprints of some lines of LONG words or more: values and lines."""
        n = self.n[some] - SHINGLE + 1
        line = np.repeat(some, n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.first[line] + p
        with np.errstate(over="ignore"):
            value = _mix((self.sums[at + SHINGLE] - self.sums[at]) * self.inverse[p], np.full(p.size, SHINGLE))
        whole = np.flatnonzero(p + WINDOW <= self.n[line] - SHINGLE + 1)
        least = value[whole]
        for k in range(1, WINDOW):
            least = np.minimum(least, value[whole + k])
        line = line[whole]
        new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (line[1:] != line[:-1])]) if least.size else whole
        least, line = least[new], line[new]
        order = np.lexsort((least, line))
        new = order[np.r_[True, (least[order][1:] != least[order][:-1]) | (line[order][1:] != line[order][:-1])]] if order.size else order
        return least[new], line[new]

    def variants(self, some: np.ndarray):
        """Hash of each of some lines without its p-th word: values, lines, and p from 0."""
        n = self.n[some]
        line = np.repeat(some, n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.first[line] + p
        with np.errstate(over="ignore"):
            before, after = self.sums[at] - self.sums[self.first[line]], self.sums[at + 1] - self.sums[self.first[line]]
            return before + (self.total[line] - after) * self.inverse[1], line, p


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two lines, a column of the whole table at a time as the bits of integers (Myers)."""
    at: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        at[word] = at.get(word, 0) | 1 << i
    every, last, edits = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    # Where a value is one more, or one less, than the one above it.
    more, less = every, 0
    for word in b.tolist():
        same = at.get(word, 0)
        down = same | less
        same = ((same & more) + more ^ more) | same
        up, fall = less | (every & ~(same | more)), more & same
        if up & last:
            edits += 1
        elif fall & last:
            edits -= 1
        up, fall = (up << 1 | 1) & every, fall << 1 & every
        more, less = fall | (every & ~(down | up)), up & down
    return edits


def within_edits(a: np.ndarray, b: np.ndarray, k: int) -> bool:
    """Whether at most ``k`` words changed, added or left out make ``a`` into ``b``.

    For each number of edits and diagonal d, how many words of ``a`` can be matched to
    as many plus d of ``b``: steps grow with k * k, not with the length. Where that
    comes to cost as much as a table of bits does, the table is worked out.
    """
    n, m = len(a), len(b)
    reach: dict[int, int] = {}
    for e in range(k + 1):
        # A diagonal costs some ten columns of 1500 bits.
        if n and 16 * e * e > m * (1 + n / 1500):
            return _edits(a, b) <= k
        now: dict[int, int] = {}
        for d in range(-e, e + 1):
            i = 0 if e == 0 else max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            size = min(n - i, m - i - d)
            other = a[i : i + size] != b[i + d : i + d + size]
            stop = int(other.argmax()) if size else 0
            now[d] = i + (stop if size and other[stop] else size)
        if now.get(m - n, -1) >= n:
            return True
        reach = now
    return False


def edit_bound(n):
    """Edits allowed between two lines, by the number of words of the shorter: ints or arrays."""
    return np.where(np.asarray(n) < MIN_WORDS, 0, np.maximum(1, np.asarray(n) // EDIT_WORDS))


def _agree(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` and ``to`` on (backwards for a step of -1) agree, ``most`` at most, for each pair."""
    pair = np.repeat(np.arange(most.size), most)
    p = np.arange(pair.size) - np.repeat(np.cumsum(most) - most, most)
    other = np.flatnonzero(a[at[pair] + step * p] != b[to[pair] + step * p])
    first = other[np.flatnonzero(np.r_[True, pair[other][1:] != pair[other][:-1]])] if other.size else other
    out = most.copy()
    out[pair[first]] = p[first]
    return out


def near_pairs(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, to: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of lines, n words of ``a`` from ``at`` on and m of ``b`` from ``to`` on, are within their bound.

    What agrees at both ends is left out, which leaves the distance as it is. If no more
    words than the bound remain, the pair is near, and a bound of one allows no others;
    the rest go through ``within_edits`` one by one.
    """
    most = edit_bound(np.minimum(n, m))
    some = np.flatnonzero(np.abs(n - m) <= most)
    near = []
    # So many words at a time, or one pair.
    for own in np.split(some, np.flatnonzero(np.diff(np.cumsum((n + m)[some]) // WORDS)) + 1):
        x, y = n[own], m[own]
        low = np.minimum(x, y)
        head = _agree(a, at[own], b, to[own], low, 1)
        tail = _agree(a, at[own] + x - 1, b, to[own] + y - 1, low - head, -1)
        left = np.maximum(x, y) - head - tail
        near.append(own[left <= most[own]])
        open_ = np.flatnonzero((left > most[own]) & (most[own] > 1))
        if not open_.size:
            continue
        cut = lambda flat, first, size: [flat[i : i + k] for i, k in zip((first[own] + head)[open_].tolist(), (size - head - tail)[open_].tolist())]
        u, v, k = cut(a, at, x), cut(b, to, y), most[own][open_]
        fit = np.flatnonzero(np.abs(_bins(u).astype(np.int16) - _bins(v)).sum(axis=1) <= 2 * k)
        near.append(own[open_[[j for j in fit.tolist() if within_edits(u[j], v[j], int(k[j]))]]])
    return np.sort(np.concatenate(near))


def line_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, line, hash, check, n, keys)`` of each line with words.

    ``row``: hash of the whole text, which tells rows that share a doc_id apart. Keys
    with the last bit set are fingerprints of lines of LONG words or more; a line that a
    task has met before has none.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), text_bytes())

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, row, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in chunked(texts):
                found = Lines(texts[a:b])
                new = np.zeros(found.n.size, dtype=bool)
                _, first = np.unique(found.hash, return_index=True)
                first = first[found.n[first] >= MIN_WORDS]
                if len(seen) > SEEN:
                    seen.clear()
                new[first] = [h not in seen for h in found.hash[first].tolist()]
                seen.update(found.hash[first].tolist())
                short = np.flatnonzero(new & (found.n <= LONG))
                prints, line = found.fingerprints(np.flatnonzero(new & (found.n >= LONG)))
                keys = np.r_[found.coarse_keys()[short].ravel() & ~np.int64(1), prints | np.int64(1)]
                owner = np.r_[np.repeat(short, 2 * SEGMENTS), line]
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(found.n.size + 1))
                place = pa.array(found.text + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(place), row.take(place), pa.array(found.number, pa.int32()), pa.array(found.hash), pa.array(found.check), pa.array(found.n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order]))],
                    ["doc_id", "row", "line", "hash", "check", "n", "keys"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, row long, line int, hash long, check int, n int, keys array<long>")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The distinct ``(hash, key)`` of the keys that lines of two hashes or more have.

    ``keyed``: ``(hash, key)``, or ``(hash, keys)`` with lists of them. Most keys are found
    once, so they are exchanged in packs of one bucket of keys each and sorted in numpy. Packs
    come in order of bucket and one bucket is held; where that has more than HELD keys, those
    shared so far are returned at once, and a pair among them may come again.
    """
    rows = keyed.select("hash", "keys" if "keys" in keyed.columns else F.array("key").alias("keys"))
    buckets = np.uint64(parts(keyed) * BUCKETS)

    def packs(held):
        pairs = np.concatenate(held)
        bucket = (mix64(pairs[:, 0].view(np.uint64)) % buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pairs, bucket = pairs[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        start = np.flatnonzero((np.arange(bucket.size) - np.repeat(first, np.diff(np.r_[first, bucket.size]))) % PACK == 0)
        ends = (np.r_[start, bucket.size] * 16).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), start.size, [None, pa.py_buffer(ends), pa.py_buffer(pairs.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket[start]), packed], ["bucket", "pairs"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(1)
            own = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            held.append(np.stack([lists.flatten().to_numpy(), own], axis=1))
            size += own.size
            if size > PACKED:
                yield packs(held)
                held, size = [], 0
        if size:
            yield packs(held)

    def shared(held, told):
        """Rows of shared keys, and the other rows."""
        pairs = np.concatenate(held)
        pairs = pairs[np.argsort(pairs[:, 0])]
        key = pairs[:, 0]
        same = key[1:] == key[:-1]
        again = (np.r_[False, same] | np.r_[same, False])[: key.size]
        if told.size:
            again |= np.isin(key, told)
        some = pairs[again]
        some = some[np.lexsort((some[:, 1], some[:, 0]))]
        new = np.flatnonzero(np.r_[True, (some[1:] != some[:-1]).any(axis=1)][: len(some)])
        some = some[new]
        same = some[1:, 0] == some[:-1, 0]
        mixed = (np.r_[False, same] | np.r_[same, False])[: len(some)]
        if told.size:
            mixed |= np.isin(some[:, 0], told)
        return some[mixed], [pairs[~again], some[~mixed]]

    def give(some):
        return pa.RecordBatch.from_arrays([pa.array(some[:, 1].copy()), pa.array(some[:, 0].copy())], ["hash", "key"])

    def run(batches):
        held, now, none = [], None, np.zeros(0, np.int64)
        told, limit = none, HELD
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed))
            pairs = np.frombuffer(b"".join(packed), dtype=np.int64).reshape(-1, 2)
            last = bucket[-1]
            if now != last:
                done = size[: int(np.searchsorted(bucket, last))].sum() // 16
                yield give(shared([*held, pairs[:done]], told)[0])
                held, now, pairs, told, limit = [], last, pairs[done:], none, HELD
            held.append(pairs)
            if sum(map(len, held)) > limit:
                some, held = shared(held, told)
                told = np.union1d(told, some[:, 0])
                limit = max(HELD, 2 * sum(map(len, held)))
                yield give(some)
        if held:
            yield give(shared(held, told)[0])

    rows = rows.mapInArrow(pack, "bucket long, pairs binary").repartition(parts(keyed), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "hash long, key long")


def _bins(words: list[np.ndarray]) -> np.ndarray:
    """Counts of each line's words in BINS bins by hash, at most 255."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    at = np.repeat(np.arange(lens.size), lens) * BINS + ((flat >> 20) & (BINS - 1))
    return np.minimum(np.bincount(at, minlength=lens.size * BINS), 255).astype(np.uint8).reshape(-1, BINS)


def line_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(hash, doc_id, row, line, n, words, bins)`` of the lines ``places``, rows of ``(hash, at)``, read again.

    A document's asked lines come as one list, which its text bounds.
    """
    asked = places.groupBy("at.doc_id", "at.row").agg(F.collect_list(F.struct("at.line", "hash")).alias("asked"))
    asked = checked(materialize(asked, "line-candidates"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), text_bytes()).join(asked, ["doc_id", "row"])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunked(texts):
                found = Lines(texts[a:b])
                lists = batch.column(3).slice(a, b - a)
                owner = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
                line, own = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
                place = (found.text.astype(np.int64) << 32) | found.number
                at = np.searchsorted(place, (owner << 32) | line)
                ok = (at < place.size) & (found.hash[np.minimum(at, place.size - 1)] == own) if place.size else np.zeros(0, bool)
                some = np.unique(at[ok])
                words = [found.words[found.first[k] : found.first[k] + found.n[k]].view(np.int64) for k in some]
                bins = pa.array([x.tobytes() for x in _bins(words)], pa.binary())
                where = pa.array(found.text[some] + a)
                flat = pa.array(np.concatenate(words) if words else np.zeros(0, np.int64))
                words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(found.n[some])], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.hash[some]), batch.column(0).take(where), batch.column(1).take(where), pa.array(found.number[some], pa.int32()), pa.array(found.n[some], pa.int32()), words, bins],
                    ["hash", "doc_id", "row", "line", "n", "words", "bins"],
                )

    # Rows that repeat a doc_id and text give a line twice.
    return rows.mapInArrow(run, f"hash long, doc_id {kind}, row long, line int, n int, words array<long>, bins binary").dropDuplicates(["hash"])


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Hashes ``hash`` of the pairs ``(hash, other)`` whose edit distance is within the bound.

    The pairs go to the words of either side, broadcast if they are few, and only the
    words of pairs are exchanged.
    """
    few = checked(materialize(pairs, "line-pairs"))
    side = lambda own, name: words.select(F.col("hash").alias(own), F.col("words").alias(name)).join(few, own).select("hash", "other", name)
    rows = side("hash", "b").join(side("other", "a"), ["hash", "other"]).select("hash", "a", "b")

    def run(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            (a, n), (b, m) = ((c.flatten().to_numpy(), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) for c in (batch.column(1), batch.column(2)))
            near = near_pairs(a, np.cumsum(n) - n, n, b, np.cumsum(m) - m, m)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[near], pa.int64())], ["hash"])

    return rows.mapInArrow(run, "hash long").distinct()


def short_pairs(words: DataFrame) -> DataFrame:
    """``(hash, other)``: lines of up to LONG words, and the earliest other line of each variant they share."""
    rows = words.where(F.col("n") <= LONG).select("hash", "doc_id", "row", "line", "words")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = Lines.__new__(Lines)
            lists = batch.column(4)
            found.n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy().view(np.uint64)
            found.first = np.cumsum(found.n) - found.n
            place = np.arange(flat.size) - np.repeat(found.first, found.n)
            most = int(found.n.max(initial=0))
            found.inverse = _powers(_INVERSE, most)
            with np.errstate(over="ignore"):
                found.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(flat * _powers(_BASE, most)[place], dtype=np.uint64)]
            found.total = found._prefix(found.n)
            some = np.arange(found.n.size)
            v, line, p = found.variants(some)
            # Kind 0: the p-th word changed; kind 1: whole line; kind 2: one word left out.
            less = _mix(v, (found.n[line] - 1) * 4 + 1)
            order = np.lexsort((less, line))
            new = order[np.r_[True, (less[order][1:] != less[order][:-1]) | (line[order][1:] != line[order][:-1])]] if order.size else order
            key = np.r_[_mix(v, (p + 1) * 4), _mix(found.total[some], found.n[some] * 4 + 1), less[new]]
            kinds = np.repeat(np.array([0, 1, 2], dtype=np.int8), [v.size, some.size, new.size])
            line = pa.array(np.r_[line, some, line[new]])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kinds), *[batch.column(k).take(line) for k in range(4)]], ["key", "kind", "hash", "doc_id", "row", "line"])

    made = rows.mapInArrow(run, f"key long, kind tinyint, hash long, doc_id {kind}, row long, line int")
    at = F.struct("doc_id", "row", "line", "hash")
    made = made.select("key", "kind", "hash", at.alias("at")).repartition(parts(words), "key")
    first = made.groupBy("key").agg(
        *[F.min(F.when(F.col("kind") == k, F.col("at"))).alias(c) for k, c in enumerate(("same", "whole", "less"))],
        F.count("*").alias("n"),
        # Both uses of the exchange need the same columns to share it.
        F.max("hash").alias("any"),
    )
    first = first.where("n > 1 and any is not null").drop("n", "any")
    other = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("less")).otherwise(F.col("whole"))
    return made.join(first, "key").where(other < F.col("at")).select("hash", other["hash"].alias("other")).distinct()


def _piece_pairs(rows: DataFrame, likely: int | None, chunk: int = CHUNK) -> DataFrame:
    """``(hash, other, more)``: open lines and earlier ones of a fingerprint whose lengths and counts allow the bound.

    ``likely``: at most so many likeliest partners of a piece; ``more`` tells of others.
    rows: ``(key, hash, doc_id, row, line, n, bins, open)``.
    """

    def work(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c).to_numpy() for c in ("key", "__i", "__j"))
        border = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        rank = np.empty(key.size, dtype=np.int64)
        rank[table.sort_by([(c, "ascending") for c in ("doc_id", "row", "line")]).column("__at").to_numpy()] = np.arange(key.size)
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, BINS).astype(np.int16)
        n, open_, salt, hashes = (table.column(c).to_numpy() for c in ("n", "open", "__k", "hash"))
        a, b, more = [], [], []
        for start, end in zip(border[:-1], border[1:]):
            own = start + np.flatnonzero(open_[start:end])
            for at in range(0, own.size, 128):
                x = own[at : at + 128]
                most = edit_bound(np.minimum(n[x][:, None], n[start:end]))
                apart = np.abs(bins[x][:, None] - bins[None, start:end]).sum(axis=2)
                fit = (apart <= 2 * most) & (np.abs(n[x][:, None] - n[start:end]) <= most) & (rank[start:end] < rank[x][:, None]) & (hashes[start:end] != hashes[x][:, None])
                if i[start] != j[start]:
                    fit &= salt[x][:, None] != salt[start:end]
                rest = likely is not None and fit.sum(axis=1) > likely
                if likely is not None and rest.any():
                    cost = np.where(fit, apart, 1 << 14)
                    fit &= ~rest[:, None] | (cost <= np.partition(cost, likely - 1, axis=1)[:, likely - 1 : likely])
                    # Ties beyond the number wait with the others.
                    fit &= ~rest[:, None] | (np.cumsum(fit, axis=1) <= likely)
                k, m = np.nonzero(fit)
                a, b, more = [*a, x[k]], [*b, start + m], [*more, rest[k] if likely is not None else np.zeros(k.size, bool)]
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.table({"hash": hashes[a], "other": hashes[b], "more": np.concatenate(more) if more else np.zeros(0, bool)})

    numbered = lambda table: work(table.append_column("__at", pa.array(np.arange(table.num_rows))))
    return by_piece(chunk_pairs(rows, "key", "hash", chunk), "key", numbered, "hash long, other long, more boolean").distinct()


def near_long_lines(found: DataFrame, words: DataFrame) -> DataFrame:
    """Hashes of the lines of LONG words or more that have an earlier one within the bound.

    ``found``: ``(hash, key)`` of the keys that lines share.
    """
    rows = found.where(F.col("key").bitwiseAND(F.lit(1)) == 1).join(words.select("hash", "doc_id", "row", "line", "n", "bins"), "hash")
    rows = materialize(rows, "long-keys")
    at = F.struct("doc_id", "row", "line", "hash", "n")
    first = rows.groupBy("key").agg(F.min(at).alias("first"))
    met = rows.join(first, "key").where(F.col("first.hash") != F.col("hash"))
    most = F.greatest(F.lit(1), F.floor(F.least("n", "first.n") / EDIT_WORDS))
    pairs = met.where(F.abs(F.col("n") - F.col("first.n")) <= most).select("hash", F.col("first.hash").alias("other")).distinct()
    near = materialize(_verified(pairs, words), "long-near")
    more = None
    for likely in (LIKELY, None):
        # Only where a line still open stands behind another one.
        open_ = rows.join(checked(near), "hash", "left_anti").select("hash").distinct()
        open_ = checked(materialize((open_ if more is None else open_.join(more, "hash", "left_semi")).withColumn("late", F.lit(True)), "long-open"))
        now = rows.join(open_, "hash", "left").select(*rows.columns, F.col("late").isNotNull().alias("open"))
        late = now.join(first, "key").where(F.col("open") & (F.col("first.hash") != F.col("hash"))).select("key").distinct()
        # Groups without an open line, most of them, stay out of the pieces.
        pairs = materialize(_piece_pairs(now.join(checked(materialize(late, "long-late")), "key", "left_semi"), likely), "long-pairs")
        near = materialize(near.union(_verified(pairs.select("hash", "other").distinct(), words)).distinct(), "long-near")
        more = materialize(pairs.where("more").select("hash").distinct().join(checked(near), "hash", "left_anti"), "long-more")
        if more.isEmpty():
            return near
    return near


def removals(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, lines)``: the line numbers to drop, for texts that lose one.

    ``row`` is the hash of the text, so rows that share a doc_id keep their own lines.
    Rows with a null doc_id and null texts have no lines here; rows that repeat a
    doc_id and text repeat its decisions, so each keeps its first lines.
    """
    docs = docs.where("doc_id is not null and text is not null")
    lines = materialize(line_table(docs), "lines")
    found = materialize(shared_keys(lines.select("hash", "keys").where(F.size("keys") > 0)), "shared-keys")
    at = F.struct("doc_id", "row", "line")
    reps = materialize(lines.groupBy("hash", "check").agg(F.min(at).alias("at"), F.count("*").alias("n")), "distinct-lines")
    words = materialize(line_words(docs, reps.join(found.select("hash").distinct(), "hash", "left_semi").select("hash", "at")), "line-words")
    near = _verified(short_pairs(words), words).union(near_long_lines(found, words)).distinct()
    near = checked(materialize(near.withColumn("near", F.lit(True)), "near-lines"))
    # Only lines that occur again or have an earlier neighbour need a decision.
    state = reps.join(near, "hash", "left").where("near or n > 1").select("hash", "check", "at", F.coalesce("near", F.lit(False)).alias("near"))
    state = checked(materialize(state, "line-decisions"))
    gone = lines.select("hash", "check", *AT).join(state, ["hash", "check"]).where(F.col("near") | (at != F.col("at")))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def drop_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with the lines named in ``gone`` cut out of the text; other columns, whatever their names, as they are."""
    ident, row, lines = unused(docs, "gone_id", "gone_row", "gone_lines")
    gone = checked(gone.toDF(ident, row, lines))
    rows = docs.join(gone, (F.col("doc_id") == F.col(ident)) & (F.xxhash64("text") == F.col(row)), "left")
    split = F.split(F.col("text"), "\n", -1)
    cut = F.array_join(F.filter(split, lambda x, k: ~F.array_contains(F.col(lines), k)), "\n")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(cut)
    return rows.withColumn("text", text).select(*docs.columns)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, exactly or within the bound.

    Lines without words (blank ones) always stay. A document may end up with an empty
    text; its row stays. Null texts stay null. Rows that repeat a doc_id are told apart
    by their texts, and rows without a doc_id keep all their lines. An empty table
    gives an empty one.
    """
    return drop_lines(docs, materialize(removals(docs), "line-removals"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: how many lines the dedup drops, and their numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = checked(materialize(removals(docs), "line-removals"))
    out = docs.select("doc_id", F.xxhash64("text").alias("row")).join(gone, ["doc_id", "row"], "left")
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return out.select("doc_id", F.size(lines).cast("long").alias("n_removed"), F.array_join(lines, ",").alias("removed_lines"))


#: The same decisions by comparing word lists: exact repeats, one-edit variants with the
#: deleted place in the key where lengths agree, and the edit distance of longer lines that
#: share SHINGLE words. That is worked out three times, over words hashed to 90 characters
#: in three ways, and the largest counts.
ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), l AS (
  SELECT doc_id, line, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM raw
), lines AS (SELECT doc_id, line, array_to_string(w, ' ') AS t, w, len(w) AS n FROM l WHERE len(w) > 0
), ranked AS (SELECT *, (doc_id::HUGEINT + 9223372036854775808::HUGEINT) * 4294967296::HUGEINT + line AS pos FROM lines
), reps AS (SELECT t, min(pos) AS pos, first(w) AS w, first(n) AS n FROM ranked GROUP BY t
), p AS (SELECT *, unnest(range(1, n + 1)) AS p FROM reps WHERE n >= 4
), v AS (
  SELECT t, pos, n, p, array_to_string(w[1:p-1], ' ') || '|' || array_to_string(w[p+1:], ' ') AS split_key,
    array_to_string(list_concat(w[1:p-1], w[p+1:]), ' ') AS key FROM p
), sub AS (SELECT t, pos, min(pos) OVER (PARTITION BY n, p, split_key) AS low FROM v
), long AS (
  SELECT t, pos, n, w, list_transform(['a', 'b', 'c'], lambda s: array_to_string(list_transform(w, lambda x: chr((33 + hash(s || x) % 90)::INT)), '')) AS e
  FROM reps WHERE n >= 48
), shingles AS (
  SELECT DISTINCT t, pos, n, unnest(list_transform(range(1, n - 6), lambda p: hash(array_to_string(w[p:p+7], ' ')))) AS h FROM long
), met AS (
  SELECT DISTINCT a.t AS ta, b.t AS tb, least(a.n, b.n) // 24 AS k FROM shingles a JOIN shingles b USING (h)
  WHERE a.pos < b.pos AND abs(a.n - b.n) <= least(a.n, b.n) // 24
), far AS (
  SELECT m.tb, m.k, a.e AS ea, b.e AS eb FROM met m JOIN long a ON a.t = m.ta JOIN long b ON b.t = m.tb
), near AS (
  SELECT t FROM sub WHERE low < pos
  UNION SELECT v.t FROM v JOIN reps r ON r.t = v.key AND r.n >= 4 WHERE r.pos < v.pos
  UNION SELECT r.t FROM v JOIN reps r ON r.t = v.key AND r.n >= 4 WHERE v.pos < r.pos
  UNION SELECT tb FROM far
    WHERE levenshtein(ea[1], eb[1]) <= k AND levenshtein(ea[2], eb[2]) <= k AND levenshtein(ea[3], eb[3]) <= k
), gone AS (
  SELECT DISTINCT x.doc_id, x.line FROM ranked x JOIN reps r USING (t) LEFT JOIN near USING (t)
  WHERE x.pos > r.pos OR near.t IS NOT NULL
), g AS (SELECT doc_id, count(*) AS n_removed, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(g.removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN g USING (doc_id)
"""
