"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints of one block bucket are sorted by Gray rank, so neighbours share most
bits. Runs of them form leaves, runs of leaves form upper nodes, and each node holds
the bits all its members share (a mask and their values). Two nodes whose shared bits
differ in more places than the bound are pruned with all their members; otherwise the
differences that remain are worked out one level below.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, WORD_BYTES, checked, materialize, settle, text_bytes, unused
from .components import components
from .hotgroups import by_piece, chunk_pairs

WIDTH = 3
BITS = 3
SEED = 42
FANOUT = 16
#: Pairs expanded at a time below two nodes.
STEP = 2_000_000
#: Fingerprints of a bucket that share its bits by chance, at most, while keys can be made longer.
CROWD = 64


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; no words: 0."""
    words = WORD_BYTES.findall(text.translate(LOWER_AZ))
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, h.size, 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > h.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns=("doc_id",), width: int = WIDTH) -> DataFrame:
    """``columns`` of docs and ``fp`` (the fingerprint's bits as a long)."""
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], text_bytes())

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(len(columns)).to_pylist()], dtype=np.uint64)
            cols = [batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], [*(f"c{k}" for k in range(len(columns))), "fp"])

    schema = ", ".join([*(f"c{k} {rows.schema[k].dataType.simpleString()}" for k in range(len(columns))), "fp long"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each uint64 in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _expand(a, b, first, count):
    """Pairs of children of the node pairs (a, b): all of them, upper half where a is b."""
    na, nb = count[a], count[b]
    total = na * nb
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    wide = np.repeat(nb, total)
    x = np.repeat(first[a], total) + at // wide
    y = np.repeat(first[b], total) + at % wide
    keep = (np.repeat(a != b, total)) | (x <= y)
    return x[keep], y[keep]


def _nodes(group, ones, zeros):
    """Runs of up to FANOUT neighbours of one group: first, count, group, AND, OR."""
    n = group.size
    new = np.r_[True, group[1:] != group[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    first = np.flatnonzero((np.arange(n) - start) % FANOUT == 0)
    count = np.diff(np.r_[first, n])
    return first, count, group[first], np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(zeros, first)


def near_pairs(group: np.ndarray, fp: np.ndarray, bits: int = BITS, step: int = STEP):
    """Yield index arrays (i, j), i < j, of fingerprints of one group within ``bits``.

    ``group`` is sorted and ``fp`` in Gray order within each group.
    """
    levels = [(None, None, group, fp, fp)]
    while True:
        first, count, g, ones, zeros = _nodes(*levels[-1][2:])
        levels.append((first, count, g, ones, zeros))
        if len(g) == len(np.unique(g)):
            break
    top = len(levels) - 1
    n = len(levels[top][2])
    todo = [(top, np.arange(n), np.arange(n))]
    while todo:
        level, a, b = todo.pop()
        first, count, _, _, _ = levels[level]
        ends = np.cumsum(count[a] * count[b])
        if ends.size > 1 and ends[-1] > step:
            cut = max(1, int(np.searchsorted(ends, step)))
            todo.append((level, a[cut:], b[cut:]))
            a, b = a[:cut], b[:cut]
        x, y = _expand(a, b, first, count)
        _, _, _, ones, zeros = levels[level - 1]
        # Bits that differ between the shared bits of two nodes differ between all their members.
        apart = (ones[x] & ~zeros[y]) | (ones[y] & ~zeros[x])
        keep = np.bitwise_count(apart) <= bits
        x, y = x[keep], y[keep]
        if level == 1:
            keep = x < y
            yield x[keep], y[keep]
        elif x.size:
            todo.append((level - 1, x, y))


def blocks_for(n: int, bits: int = BITS) -> int:
    """Into how many blocks to cut fingerprints so that a bucket of ``n`` unrelated ones has about CROWD."""
    blocks = bits + 1
    while blocks < 2 * bits and n >> min(64 * (blocks - bits) // blocks, 62) > CROWD:
        blocks += 1
    return blocks


def links(fps: DataFrame, bits: int = BITS, fp: str = "fp", blocks: int | None = None) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints within ``bits`` of one another.

    64 bits are cut into ``blocks`` blocks, more of them the more fingerprints are
    counted; two fingerprints within the bound agree in all but ``bits`` blocks, so each
    goes to one bucket for each such choice of blocks. Large buckets are dealt out as
    chunk pairs. Each piece returns a spanning forest, at most one link a member,
    never all pairs.
    """
    blocks = blocks or blocks_for(fps.count(), bits)
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in some) for some in combinations(range(blocks), blocks - bits)]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)])
    rows = fps.select(F.col(fp).alias("fp"), F.explode(keys).alias("bucket"))
    rows = chunk_pairs(rows, "bucket", "fp")

    def work(table: pa.Table) -> pa.Table:
        signed = table.column("fp").to_numpy()
        fp = signed.view(np.uint64)
        k, i, j = (table.column(c).to_numpy() for c in ("bucket", "__i", "__j"))
        group = np.cumsum(np.r_[False, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        order = np.lexsort((gray_rank(fp), group))
        group, fp, signed = group[order], fp[order], signed[order]
        root = np.arange(fp.size)
        for a, b in near_pairs(group, fp, bits):
            if a.size:
                joined = settle(fp.size, np.r_[np.arange(fp.size), a], np.r_[root, b])
                root = joined
        far = np.flatnonzero(root != np.arange(fp.size))
        return pa.table({"u": signed[far], "v": signed[root[far]]})

    return by_piece(rows, "bucket", work, "u long, v long").distinct()


def _rooted(fps: DataFrame, bits: int) -> DataFrame:
    """``(fp, rep, root)``: each distinct fingerprint, its smallest doc_id, and the root of its component."""
    one = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    root = components(links(one, bits))
    known = one.join(root.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    return materialize(known, "rooted")


def groups(docs: DataFrame, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over near fingerprints.

    Equal fingerprints are counted once before any comparison, so a group of copies
    is one row whatever its size. Null texts count as empty; empty texts share the
    fingerprint zero. Rows with a null doc_id get the component of their
    fingerprint; a component of such rows alone has a null id. Repeated rows give
    repeated rows.
    """
    fps = materialize(fingerprints(docs, width=width), "fingerprints")
    known = _rooted(fps, bits)
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(known.join(least, "root").select("fp", "component_id"), "named")
    return fps.join(checked(named), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of the smallest doc_id.

    Rows are told apart by doc_id and text: of rows that share the smallest doc_id the
    one whose text has the smallest hash stays, and of rows that repeat it whole one.
    Rows without a doc_id come last, so one of them stays only where no row of their
    group has an id. Null and empty texts are one group. Columns of docs, whatever
    their names, pass through; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    fps = materialize(fingerprints(rows, ("doc_id", "row"), width), "fingerprints")
    per = fps.groupBy("doc_id", "row", "fp").agg(F.count("*").alias("n"))
    per = materialize(per.join(checked(_rooted(fps, bits).select("fp", "root")), "fp"), "rows-rooted")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = per.groupBy("root").agg(F.min(place).alias("first"))
    same = place.eqNullSafe(F.col("first"))
    ident, row, again = unused(docs, "odd_id", "odd_row", "again")
    odd = per.join(first, "root").where(~same | (F.col("n") > 1)).select(F.col("doc_id").alias(ident), F.col("row").alias(row), same.alias(again))
    odd = materialize(odd, "not-kept")
    found = docs.join(checked(odd), F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(row)), "left")
    once = found.where(F.col(again).isNull()).drop(ident, row, again)
    if odd.where(again).isEmpty():
        return once
    # Of rows that repeat the doc_id and text one, whichever its other columns.
    twice = found.where(again).dropDuplicates(["doc_id", row]).drop(ident, row, again)
    return once.unionByName(twice)


def op7_simhash_gray(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
