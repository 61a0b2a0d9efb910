"""Quality rules: an isolation forest over rule statistics.

Each text gives STATS statistics. Trees split random subsamples of labelled good texts
at random places; a text that few splits suffice to isolate is an anomaly. The depth
under which a text is dropped is calibrated on labelled rows the trees did not see.
A fixed base rule (too short, or mostly repeated) applies before the forest.

All labelled rows count: each tree draws its rows from all good ones of the growing half,
ranges come from that whole half and the threshold from the whole other half. What
reaches the driver is bounded: the trees' rows, and counts by rounded value.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, labelled, materialize, mix64, text_bytes
from .textstats import SEPARATORS, SYMBOLS, WordHashes, chunked, duplicate_lines, hash_words, per_text, repeated_windows

TREES = 200
#: Texts each tree splits.
SUBSAMPLE = 256
#: Mean depths are multiples of this, so that rows can be counted by depth.
STEP = 2.0**-12
#: Bits of a statistic left out where rows are counted by its value; 10 of the fraction stay.
COARSE = 42
MIN_WORDS = 50
#: Cuts fall beyond a node's rows by this share of a statistic's range (1 to 99 percent of labelled rows).
MARGIN = 0.25
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = (
    "log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "exclaim", "punctuation", "distinct", "line_words", "non_ascii", "longest_line", "lone_symbols",
)

_BYTE = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:'\"()-")):
    _BYTE[list(_chars)] = _k + 1
_BYTE[128:192] = 5


def statistics(texts: list[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of COUNTS (int64) and of STATS (float64) for whole texts."""
    raw = [t.encode() for t in texts]
    flat, words = hash_words(raw, known)
    chars = np.array([len(t) - sum(map(t.count, SEPARATORS)) for t in texts], dtype=np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64)
    lines = np.array([duplicate_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    repeat = per_text(repeated_windows(flat, words), words)
    counts = np.stack([words, chars, symbols, lines[:, 1], repeat], axis=1)
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    kind = np.stack([np.bincount(_BYTE[np.frombuffer(t, dtype=np.uint8)], minlength=6) for t in raw])
    text = np.repeat(np.arange(words.size), words)
    order = np.lexsort((flat, text))
    new = np.r_[True, (flat[order][1:] != flat[order][:-1]) | (text[order][1:] != text[order][:-1])] if flat.size else np.zeros(0, dtype=bool)
    distinct = np.bincount(text[order][new], minlength=words.size) if flat.size else np.zeros(words.size)
    lone = np.isin(flat, np.array([known[bytes([b])] for b in SYMBOLS.encode()], dtype=np.uint64))
    longest = np.array([max(map(len, t.split(b"\n"))) for t in raw])
    some, w, c = np.maximum(size, 1), np.maximum(words, 1), np.maximum(chars, 1)
    stats = np.stack([
        np.log1p(words), chars / w, np.sqrt(symbols / w), lines[:, 1] / np.maximum(lines[:, 0], 1), repeat / w, kind[:, 1] / c, kind[:, 2] / c, kind[:, 3] / w, kind[:, 4] / w,
        # Distinct words fall with length in any text; what counts is the distance from that.
        np.log1p(distinct) - 0.9 * np.log1p(words), np.log1p(words / np.maximum(lines[:, 0], 1)), kind[:, 5] / some, np.log1p(longest),
        np.sqrt(per_text(lone, words) / w),
    ], axis=1)
    return counts, stats


def _harmonic(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of ``n`` nodes."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def grow(draws: list[np.ndarray], margin: np.ndarray, rng: np.random.Generator) -> dict:
    """The forest as flat arrays: feature, cut, left child (right is next), depth at leaves.

    ``draws``: the rows of each tree. A cut falls up to ``margin`` (one value a statistic)
    beyond the range of the rows at its node, so values none of them has are cut off early.
    """
    feature, cut, left, depth, roots = [], [], [], [], []
    limit = 2 * int(np.ceil(np.log2(max(2, *map(len, draws)))))
    for x in draws:
        rows = np.arange(len(x))
        roots.append(len(feature))
        feature.append(0), cut.append(0.0), left.append(-1), depth.append(0.0)
        todo = [(roots[-1], rows, 0)]
        while todo:
            node, rows, d = todo.pop()
            part = x[rows]
            low, high = part.min(axis=0) - margin, part.max(axis=0) + margin
            spread = np.flatnonzero(high > low)
            if d >= limit or len(rows) == 1 or not len(spread):
                depth[node] = d + _harmonic(len(rows))
                continue
            f = int(rng.choice(spread))
            c = rng.uniform(low[f], high[f])
            go = part[:, f] < c
            feature[node], cut[node], left[node] = f, c, len(feature)
            for k in (go, ~go):
                todo.append((len(feature), rows[k], d + 1)) if k.any() else None
                feature.append(0), cut.append(0.0), left.append(-1)
                depth.append(0.0 if k.any() else float(d + 1))
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "depth": np.array(depth), "roots": np.array(roots)}


def mean_depth(forest: dict, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over the trees, rounded to STEP; small means anomalous."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for root in forest["roots"]:
        node = np.full(len(x), root)
        while True:
            left = forest["left"][node]
            on = left >= 0
            if not on.any():
                break
            go = x[rows, forest["feature"][node]] >= forest["cut"][node]
            node = np.where(on, left + go, node)
        total += forest["depth"][node]
    return np.round(total / max(1, len(forest["roots"])) / STEP) * STEP


_TREE = mix64(np.arange(1, TREES + 1, dtype=np.uint64))


def _draw(key: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of each tree's draw from ``of`` rows: trees, rows, and their order in the draw.

    A tree takes the SUBSAMPLE rows first by a hash of their keys. Rows that cannot be
    among them (but for a chance far below 1e-20) are left out: about twice as many stay.
    """
    bound = np.uint64(int(min(1.0, 2 * SUBSAMPLE / max(1, of)) * (2**64 - 2**12)))
    tree, row, order = [], [], []
    for k, salt in enumerate(_TREE):
        h = mix64(key.view(np.uint64) ^ salt)
        some = np.flatnonzero(h <= bound) if of > 2 * SUBSAMPLE else np.arange(h.size)
        tree.append(np.full(some.size, k)), row.append(some), order.append(h[some])
    return np.concatenate(tree), np.concatenate(row), np.concatenate(order)


def _draws(tree: np.ndarray, order: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The rows each tree draws, of its candidates ``x``, whatever order they come in."""
    by = np.lexsort((*x.T[::-1], order, tree))
    ends = np.searchsorted(tree[by], np.arange(TREES + 1))
    return [x[by[a:b][:SUBSAMPLE]] for a, b in zip(ends[:-1], ends[1:])]


def _codes(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the float64 values, equal for those that agree in all but COARSE bits."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits) >> COARSE


def _spans(stat: np.ndarray, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Range of each statistic from 1 to 99 percent of the rows, given how many rows have each code."""
    out = np.zeros(len(STATS))
    for k in range(len(STATS)):
        own = np.flatnonzero(stat == k)
        own = own[np.argsort(code[own])]
        upto = np.cumsum(rows[own])
        bits = code[own][np.searchsorted(upto, np.array([0.01, 0.99]) * upto[-1])] << COARSE
        out[k] = np.ptp(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits).view(np.float64))
    return out


def _count_codes(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistic, code and number of rows of each distinct code of each statistic."""
    found = [np.unique(_codes(np.ascontiguousarray(c)), return_counts=True) for c in stats.T]
    sizes = [len(c) for c, _ in found]
    return np.repeat(np.arange(len(found)), sizes), np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])


def _threshold(depth: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The depth to keep texts from, given how many good and bad texts have each of the distinct depths.

    It keeps most labels right, a good text lost counting twice.
    """
    order = np.argsort(depth)
    ranked = depth[order]
    # Dropping the texts of the first k depths: bad ones caught minus twice the good ones lost.
    best = int(np.argmax(np.r_[0, np.cumsum(bad[order] - 2 * good[order])]))
    if best == 0:
        return -1.0
    if best == len(ranked):
        return float(ranked[-1]) + STEP / 2
    return float(ranked[best - 1] + ranked[best]) / 2


def fit(sample, seed: int = 3) -> dict | None:
    """Forest and threshold from all ``(doc_id, text, label)`` rows, in memory; deterministic.

    Half of the texts (by crc32 of the text) grow the trees (good ones only), the others calibrate.
    Without texts of both classes there is no forest and every text passes it. ``fit_table`` does the
    same with rows of a table.
    """
    rows = [(i, t or "", y) for i, t, y in sample]
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    known = WordHashes()
    stats = np.concatenate([statistics([r[1] for r in rows[a:b]], known)[1] for a, b in chunked([r[1] for r in rows])])
    part = np.array([zlib.crc32(r[1].encode()) % 2 == 0 for r in rows])
    grown = part & (y == 1)
    rest = ~part
    if not grown.any() or len(set(y[rest].tolist())) < 2:
        grown, rest = y == 1, np.ones(len(y), dtype=bool)
    margin = MARGIN * _spans(*_count_codes(stats[part | grown]))
    key = np.array([xxhash.xxh64_intdigest(f"{r[0]} {r[1]}".encode()) for r in rows], dtype=np.uint64)[grown]
    tree, row, order = _draw(key, key.size)
    forest = grow(_draws(tree, order, stats[grown][row]), margin, np.random.default_rng(seed))
    depth, at = np.unique(mean_depth(forest, stats[rest]), return_inverse=True)
    good = np.bincount(at, y[rest] == 1, depth.size)
    forest["threshold"] = _threshold(depth, good, np.bincount(at, minlength=depth.size) - good)
    return forest


def measure(docs: DataFrame, columns=("doc_id",)) -> DataFrame:
    """``columns`` of docs, the COUNTS, stats (the STATS in order) and crc (of the text) of every row.

    Whole texts, null as empty. No shuffle.
    """
    raw = text_bytes()
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], F.coalesce("text", F.lit("")).alias("text"), F.crc32(raw).alias("crc"))
    n = len(columns)

    def run(batches):
        known = WordHashes()
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for a, b in chunked(texts):
                counts, stats = statistics(texts[a:b], known)
                own = [batch.column(k).slice(a, b - a) for k in (*range(n), n + 1)]
                ends = pa.array(np.arange(b - a + 1) * len(STATS), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*own[:n], *map(pa.array, counts.T.copy()), pa.ListArray.from_arrays(ends, pa.array(stats.ravel())), own[n]],
                    [*(f"c{k}" for k in range(n)), *COUNTS, "stats", "crc"],
                )

    kinds = [rows.schema[k].dataType.simpleString() for k in range(n)]
    schema = ", ".join([*(f"c{k} {t}" for k, t in enumerate(kinds)), *(f"{c} long" for c in COUNTS), "stats array<double>, crc long"])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], *COUNTS, "stats", "crc")


def _matrix(column) -> np.ndarray:
    """A batch's stats as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def judge_measured(rows: DataFrame, model: dict | None, columns=("doc_id",)) -> DataFrame:
    """``judge`` for rows that ``measure`` returned."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    n = len(columns)
    rows = rows.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], *COUNTS, "stats")
    names = [*rows.columns[:-1], "base_failed", "depth", "kept"]

    def run(batches):
        model = shared.value
        for batch in batches:
            words, repeated = (batch.column(n + COUNTS.index(c)).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (words < MIN_WORDS) | (100 * repeated > 50 * words)
            depth = mean_depth(model, _matrix(batch.column(batch.num_columns - 1))) if model else None
            kept = ~failed & (depth >= model["threshold"] if model else True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(failed), pa.array(depth) if model else pa.nulls(batch.num_rows, pa.float64()), pa.array(kept)], names)

    kinds = [rows.schema[k].dataType.simpleString() for k in range(n)]
    schema = ", ".join([*(f"c{k} {t}" for k, t in enumerate(kinds)), *(f"{c} long" for c in COUNTS), "base_failed boolean, depth double, kept boolean"])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], *COUNTS, "base_failed", "kept", "depth")


def judge(docs: DataFrame, model: dict | None, columns=("doc_id",)) -> DataFrame:
    """``columns`` of docs, the COUNTS, base_failed, depth (null without a forest) and kept.

    Whole texts, null as empty; an empty text has no words and fails the base rule.
    No shuffle; the model has about 2 * TREES * SUBSAMPLE nodes.
    """
    return judge_measured(measure(docs, columns), model, columns)


def fit_table(measured: DataFrame, labels: DataFrame, seed: int = 3) -> dict | None:
    """``fit`` on every labelled row of ``measure(docs)``.

    An id labelled twice has its larger label; every row with a labelled id counts.
    """
    ids = checked(materialize(labelled(labels, "quality", F.lit(True)), "quality-labels"))
    rows = measured.select("doc_id", "stats", "crc").join(ids, "doc_id")
    rows = materialize(rows.select("label", (F.col("crc") % 2 == 0).alias("part"), F.xxhash64("doc_id", "crc").alias("key"), "stats"), "labelled-stats")
    many = {(r.part, r.label): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    if len({y for _, y in many}) < 2:
        return None
    grown, rest = F.col("part") & (F.col("label") == 1), ~F.col("part")
    good = many.get((True, 1), 0)
    if not good or not ((False, 0) in many and (False, 1) in many):
        grown, rest = F.col("label") == 1, F.lit(True)
        good = sum(n for (_, y), n in many.items() if y == 1)

    def coarse(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _count_codes(_matrix(batch.column(0)))], ["stat", "code", "rows"])

    def draw(batches):
        for batch in batches:
            tree, row, order = _draw(batch.column(0).to_numpy(), good)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(order.view(np.int64)), batch.column(1).take(pa.array(row))], ["tree", "place", "stats"])

    codes = rows.where(F.col("part") | grown).select("stats").mapInArrow(coarse, "stat long, code long, rows long")
    codes = codes.groupBy("stat", "code").agg(F.sum("rows").alias("rows")).toArrow()
    margin = MARGIN * _spans(*(codes.column(c).to_numpy() for c in ("stat", "code", "rows")))
    drawn = rows.where(grown).select("key", "stats").mapInArrow(draw, "tree long, place long, stats array<double>").toArrow()
    draws = _draws(drawn.column("tree").to_numpy(), drawn.column("place").to_numpy().view(np.uint64), _matrix(drawn.column("stats").combine_chunks()))
    forest = grow(draws, margin, np.random.default_rng(seed))
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def depths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mean_depth(shared.value, _matrix(batch.column(1)))), batch.column(0)], ["depth", "label"])

    found = rows.where(rest).select("label", "stats").mapInArrow(depths, "depth double, label int")
    found = found.groupBy("depth").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).toArrow()
    forest["threshold"] = _threshold(*(found.column(c).to_numpy() for c in ("depth", "good", "bad")))
    return forest


def op3_isolation_forest(spark, sf_dir: str) -> DataFrame:
    """Contract query: rule statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = materialize(measure(docs), "statistics")
    return judge_measured(rows, fit_table(rows, labels))
