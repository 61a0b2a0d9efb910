"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

A unit is a word, or letters spelled one by one. The kernel of two units counts the
three-character subsequences they share, each occurrence weighing DECAY to the power
of the stretch it covers (at most SPAN characters), so gaps and inserted characters
cost weight but do not hide a match; both sides are scaled to length one. A unit's
ends count as characters; digits and ASCII punctuation match nothing, so a unit of
these alone has no features and scores as the bias. Landmark units give Nyström features in which a linear SVM
with squared hinge loss is trained. The kernel is a dot product of explicit counts,
so the trained function folds into one table over three-character codes: scoring is
as exact as with the landmarks and costs a few look-ups a character.

Labels are known for whole texts only, so training picks each toxic text's most
toxic-looking unit, trains, and picks again; a text scores as its worst unit, turned
into a probability by a logistic fit on texts the SVM was not trained on, weighted to the
share of toxic texts among all labelled ones, whatever share the fitted sample has.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, WORD_BYTES, id_crc, label_share, sample_labels, text_bytes

SPAN = 6
DECAY = 0.85
LANDMARKS = 192
#: Labelled texts of each class the model is fitted on, at most.
PER_CLASS = 2000
#: Units a worker keeps scores of; the table is emptied when full.
CACHE = 100_000
#: Units whose counts are held at a time.
UNITS = 5_000
NONE = -3.0

_SPELLED = re.compile(rb"(?<![^\x20\x09-\x0D])(?:[!-\x7e][\x20\x09-\x0D]+){2,}[!-\x7e](?![^\x20\x09-\x0D])")
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[1], _CLASS[2] = 27, 28
_CLASS[128:] = 32 + (np.arange(128, 256) & 31)
_STEPS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]
_GAP = b"\x00" * SPAN


def units(text: bytes) -> set[bytes]:
    """The distinct units of a text, A-Z lower-cased."""
    text = text.translate(LOWER_AZ)
    found = set(WORD_BYTES.findall(text))
    found.update(_SPACE.sub(b"", m) for m in _SPELLED.findall(text))
    return found


def _occurrences(some: list[bytes]):
    """Starts of the units in one buffer, and the class of each of its characters; 0 never matches."""
    raw = np.frombuffer(_GAP + _GAP.join([b"\x01" + u + b"\x02" for u in some]) + _GAP, dtype=np.uint8)
    lens = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 2
    starts = SPAN + np.cumsum(lens + SPAN) - (lens + SPAN)
    return starts, _CLASS[raw]


_WEIGHTS = np.array([w for *_, w in _STEPS])


def features(some: list[bytes]):
    """The scaled subsequence counts of units: place of the unit, code and value of each entry.

    Occurrences of equal codes are added up within a unit before its length is taken.
    """
    starts, c = _occurrences(some)
    n = c.size - SPAN
    unit = np.repeat(np.arange(len(some), dtype=np.int64), np.diff(np.r_[starts, n]))
    first = c[: starts[0] + unit.size][starts[0] :] if len(some) else c[:0]
    keys = []
    for k, (a, b, _) in enumerate(_STEPS):
        x, y, z = first, c[starts[0] + a : starts[0] + a + unit.size], c[starts[0] + b : starts[0] + b + unit.size]
        real = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        keys.append((((unit[real] << 18) | (x[real] << 12) | (y[real] << 6) | z[real]) << 4) | k)
    keys = np.sort(np.concatenate(keys))
    both = keys >> 4
    new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if both.size else both
    value = np.add.reduceat(_WEIGHTS[keys & 15], new) if new.size else np.zeros(0)
    both = both[new]
    unit, code = both >> 18, both & ((1 << 18) - 1)
    norm = np.sqrt(np.bincount(unit, value * value, minlength=len(some)))
    return unit, code, value / norm[unit]


def apply_table(table: np.ndarray, some: list[bytes]) -> np.ndarray:
    """Dot product of each unit's scaled counts with ``table``."""
    out = [np.zeros(0)]
    for k in range(0, len(some), UNITS):
        unit, code, value = features(some[k : k + UNITS])
        out.append(np.bincount(unit, table[code] * value, minlength=len(some[k : k + UNITS])))
    return np.concatenate(out)


def counts(unit: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scaled subsequence counts of one unit: codes and values."""
    return features([unit])[1:]


def _gram(some: list[bytes], codes: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Kernel of units (rows) and landmarks, given by their counts ``phi`` over sorted ``codes``."""
    unit, code, value = features(some)
    at = np.minimum(np.searchsorted(codes, code), codes.size - 1)
    on = codes[at] == code
    unit, at, value = unit[on], at[on], value[on]
    return np.stack([np.bincount(unit, row[at] * value, minlength=len(some)) for row in phi], axis=1)


def dense(codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 18)
    table[codes] = values
    return table


def _log_odds(bags: list[set[bytes]], y: np.ndarray) -> np.ndarray:
    """Per subsequence, the log odds of standing in a toxic against a clean text."""
    seen = np.zeros((2, 1 << 18))
    for bag, label in zip(bags, y):
        if bag:
            some = list(bag)
            own = [np.unique(features(some[k : k + UNITS])[1]) for k in range(0, len(some), UNITS)]
            seen[label][np.unique(np.concatenate(own))] += 1
    rate = (seen + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1.0)
    return np.log(rate[1] / rate[0]) * np.log1p(seen[1])


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared-hinge SVM by Newton steps on the violating rows; the last entry is the bias."""
    z = np.c_[z, np.ones(len(z))]
    w = np.zeros(z.shape[1])
    eye = np.eye(z.shape[1]) * ridge * weight.sum() / len(y)
    eye[-1, -1] *= 1e-3
    for _ in range(30):
        on = y * (z @ w) < 1
        zs = z[on] * weight[on, None]
        new = np.linalg.solve(zs.T @ z[on] + eye * len(y) * 1e-2, zs.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _train_units(bags, y, landmarks: int, rng):
    """The table and bias of the unit SVM."""
    table, bias = _log_odds(bags, y), 0.0
    clean: set[bytes] = set().union(*[b for b, k in zip(bags, y) if not k]) if len(bags) else set()
    clean_list = sorted(clean)
    # Units that many toxic texts hold and no clean one does are toxic in any case;
    # texts with the same min-hash are likely copies and count once.
    texts: dict[bytes, set[int]] = {}
    for bag, label in zip(bags, y):
        if label and bag:
            sign = min(map(zlib.crc32, bag))
            for unit in bag - clean:
                texts.setdefault(unit, set()).add(sign)
    signs = set().union(*texts.values()) if texts else ()
    often = {u: len(s) for u, s in texts.items() if len(s) >= max(5, 0.01 * len(signs))}
    for _ in range(2):
        worst: dict[bytes, int] = {}
        for bag, label in zip(bags, y):
            if label and bag - clean:
                some = sorted(bag - clean)
                unit = some[int(np.argmax(apply_table(table, some)))]
                worst[unit] = worst.get(unit, 0) + 1
        worst = {u: max(worst.get(u, 0), often.get(u, 0)) for u in worst.keys() | often.keys()}
        if not worst or not clean_list:
            return np.zeros(1 << 18), NONE
        pos = sorted(worst, key=lambda u: (-worst[u], u))
        ranked = np.argsort(-apply_table(table, clean_list), kind="stable")
        hard = [clean_list[k] for k in ranked[:4000]]
        rest = [clean_list[k] for k in rng.permutation(len(clean_list))[:4000]]
        neg = sorted({*hard, *rest})
        half = landmarks * 2 // 3
        top = half * 2 // 3
        marks = pos[:top] + [pos[k] for k in np.unique(np.linspace(top, len(pos) - 1, half - top).astype(int)) if top <= k < len(pos)] + hard[: landmarks - half]
        # Only codes that some landmark has: a few thousand columns.
        own = [counts(u) for u in marks]
        codes = np.unique(np.concatenate([c for c, _ in own]))
        phi = np.zeros((len(own), codes.size))
        for row, (c, v) in zip(phi, own):
            row[np.searchsorted(codes, c)] = v
        gram = phi @ phi.T
        val, vec = np.linalg.eigh(gram)
        ok = val > 1e-6 * val[-1]
        white = vec[:, ok] / np.sqrt(val[ok])
        both = [*pos, *neg]
        k = np.concatenate([_gram(both[at : at + UNITS], codes, phi) for at in range(0, len(both), UNITS)])
        t = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[np.minimum([worst[u] for u in pos], 20) * (0.3 * len(neg) / max(1, sum(min(v, 20) for v in worst.values()))), np.ones(len(neg))]
        w = _svm(k @ white, t, weight)
        table, bias = dense(codes, (white @ w[:-1]) @ phi), w[-1]
    return table, bias


def _logistic(x: np.ndarray, y: np.ndarray, prior: float | None = None) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit with smoothed targets.

    ``prior``: the share of ones that rows are weighted to; none: as they are.
    """
    share = y.mean()
    weight = np.ones(len(y)) if prior is None or not 0 < share < 1 else np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        e = weight * (p - t)
        g = np.array([(e * x).sum() + 1e-3 * a, e.sum()])
        q = weight * p * (1 - p) + 1e-9
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def fit(sample, landmarks: int = LANDMARKS, seed: int = 5, prior: float | None = None) -> dict:
    """The model from ``(doc_id, text bytes, label)`` rows; deterministic.

    Two thirds of the texts (by crc32 of the text) train the SVM, the others the
    logistic curve, weighted to ``prior``, the share of toxic texts (none: the sample's).
    Without texts of both classes the model scores every text as the share of toxic
    labels (0 without labels).
    """
    rows = sorted(sample)
    shared: dict[bytes, bytes] = {}  # equal units of all texts are one object
    bags = [{shared.setdefault(u, u) for u in units(t or b"")} for _, t, _ in rows]
    y = np.array([label for _, _, label in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        p = float(y.mean()) if y.size else 0.0
        return {"table": np.zeros(1 << 18, dtype=np.float32), "bias": 0.0, "a": 0.0, "b": float(np.log((p + 1e-6) / (1 - p + 1e-6)))}
    part = np.array([zlib.crc32(t or b"") % 3 != 0 for _, t, _ in rows])
    if min(len(set(y[part].tolist())), len(set(y[~part].tolist()))) < 2:
        part = np.ones(len(rows), dtype=bool)
    pick = lambda on: [b for b, k in zip(bags, on) if k]
    table, bias = _train_units(pick(part), y[part], landmarks, np.random.default_rng(seed))
    model = {"table": table.astype(np.float32), "bias": float(bias)}
    rest = ~part if not part.all() else part
    x = np.array([_worst(model, b) for b in pick(rest)])
    model["a"], model["b"] = _logistic(x, y[rest], prior)
    return model


def _worst(model: dict, bag: set[bytes]) -> float:
    some = sorted(bag)
    return max(NONE, float(apply_table(model["table"], some).max()) + model["bias"]) if some else NONE


def fit_table(docs: DataFrame, labels: DataFrame, learn, per_class: int = PER_CLASS) -> dict:
    """Fit on at most ``2 * per_class`` labelled texts, picked by hash of doc_id.

    The share of toxic labels, which the threshold depends on, is counted over all of them.
    """
    ids = sample_labels(labels, "toxic", learn, per_class)
    rows = docs.where("doc_id is not null").select("doc_id", text_bytes()).join(ids, "doc_id")
    # A doc_id that repeats counts once, with its first text.
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return fit([(r.doc_id, bytes(r.text), r.label) for r in rows.toLocalIterator()], prior=label_share(labels, "toxic", learn))


def score(docs: DataFrame, model: dict, columns=("doc_id",)) -> DataFrame:
    """``columns`` of docs and ``score`` (0 to 1) of each whole text; null is empty.

    Rows are scored one by one, so repeated rows and ids score alike; an empty table
    gives an empty one.

    Each distinct unit of a batch is scored once. No shuffle; the model is 1 MB.
    """
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], text_bytes())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            texts, out = batch.column(len(columns)).to_pylist(), []
            for at in range(0, len(texts), 500):
                bags = [units(t) for t in texts[at : at + 500]]
                new = sorted(set().union(*bags) - known.keys())
                if len(known) + len(new) > CACHE:
                    known = {}
                    new = sorted(set().union(*bags))
                known.update(zip(new, (apply_table(model["table"], new) + model["bias"]).tolist()))
                get = known.__getitem__
                out += [max(map(get, b), default=NONE) for b in bags]
            x = np.maximum(np.array(out, dtype=np.float64), NONE)
            p = 1 / (1 + np.exp(-np.clip(model["a"] * x + model["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(columns))], pa.array(p)], [*(f"c{k}" for k in range(len(columns))), "score"])

    schema = ", ".join([*(f"c{k} {rows.schema[k].dataType.simpleString()}" for k in range(len(columns))), "score double"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "score")


def held_out():
    return F.pmod(id_crc(), F.lit(5)) == 0


def op5_toxicity_ssk(spark, sf_dir: str) -> DataFrame:
    """Contract query: toxicity score of every document; fits on rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_table(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
