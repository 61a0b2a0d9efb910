"""Document quality by gated-attention multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is encoded from its own
statistics and hashed word endings by a small tanh layer; gated attention weighs the
passages of a text, and a logistic unit scores the weighted mean. Labels are known for
whole texts only; attention and encoder are learned from them together, by Adam.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, sample_labels, text_bytes
from .textstats import span_hashes, word_spans

PASSAGE = 64
HIDDEN = 24
ATTENTION = 12
ENDINGS = 16
#: Labelled texts of each class the model is fitted on, at most.
PER_CLASS = 2500
EPOCHS = 30
#: Bytes of text encoded at a time; a longer text is encoded alone, but whole.
BATCH_BYTES = 4_000_000

#: Classes of bytes that are counted: upper case, digits, three sets of marks, table marks, beyond ASCII.
_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*", b"|<>{}[]=_~^\\/@+")
_BYTE = np.zeros(256, dtype=np.int8)
for _k, _chars in enumerate(_GROUPS):
    _BYTE[list(_chars)] = _k + 1
_BYTE[128:] = len(_GROUPS) + 1
FEATURES = len(_GROUPS) + 1 + 9 + ENDINGS


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages in order, and each text's number of passages (1 at least)."""
    buffer, start, end, text = word_spans(texts)
    words = np.bincount(text, minlength=len(texts))
    first = np.cumsum(words) - words
    passages = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(passages) - passages
    own = base[text] + (np.arange(start.size) - first[text]) // PASSAGE
    n = int(passages.sum())
    out = np.zeros((n, FEATURES), dtype=np.float64)
    if not start.size:
        return out, passages
    length = end - start
    per = np.bincount(own, minlength=n).astype(np.float64)
    some = np.maximum(per, 1)
    chars = np.maximum(np.bincount(own, length, minlength=n), 1)
    kind = _BYTE[buffer]
    groups = len(_GROUPS) + 1
    for g in range(groups):
        at = np.flatnonzero(kind == g + 1)
        w = np.searchsorted(start, at, side="right") - 1
        out[:, g] = np.sqrt(np.bincount(own[w], minlength=n) / chars)
    h = span_hashes(buffer, start, end)
    order = np.lexsort((h, own))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])]
    repeat = np.r_[False, (h[1:] == h[:-1]) & (own[1:] == own[:-1])]
    lines = np.searchsorted(start, np.flatnonzero(buffer == 10), side="left") - 1
    lines = lines[lines >= 0]
    k = groups
    out[:, k] = np.bincount(own[order][new], minlength=n) / some
    out[:, k + 1] = np.sqrt(np.bincount(own, repeat, minlength=n) / some)
    out[:, k + 2] = np.log1p(chars / some)
    out[:, k + 3] = np.sqrt(np.bincount(own, length == 1, minlength=n) / some)
    out[:, k + 4] = np.sqrt(np.bincount(own, length > 20, minlength=n) / some)
    out[:, k + 5] = np.log1p(per) / np.log1p(PASSAGE)
    out[:, k + 6] = np.sqrt(np.bincount(own[lines], minlength=n) / some)
    out[:, k + 7] = np.log1p(words[np.repeat(np.arange(len(texts)), passages)]) / 6
    last = buffer[end - 1]
    out[:, k + 8] = np.sqrt(np.bincount(own, kind[end - 1] > 2, minlength=n) / some)
    tail = (last.astype(np.int64) * 31 + buffer[np.maximum(end - 2, start)]) % ENDINGS
    ends = np.bincount(own * ENDINGS + tail, minlength=n * ENDINGS).reshape(n, ENDINGS)
    out[:, k + 9 :] = np.sqrt(ends / some[:, None])
    return out, passages


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(model: dict, x: np.ndarray, passages: np.ndarray) -> dict:
    """Encoded passages, attention weights and document logits."""
    start = np.cumsum(passages) - passages
    h = np.tanh(((x - model["mean"]) / model["std"]) @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (v * u) @ model["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), passages))
    a = e / np.repeat(np.add.reduceat(e, start), passages)
    z = np.add.reduceat(h * a[:, None], start)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "logit": z @ model["c"] + model["d"][0]}


def _gradients(model, x, passages, y, weight, ridge=1e-4) -> dict:
    f = forward(model, x, passages)
    g = (_sigmoid(f["logit"]) - y) * weight / weight.sum()
    text = np.repeat(np.arange(passages.size), passages)
    h, v, u, a = f["h"], f["v"], f["u"], f["a"]
    dz = g[:, None] * model["c"]
    dh = dz[text] * a[:, None]
    da = (dz[text] * h).sum(axis=1)
    start = np.cumsum(passages) - passages
    de = a * (da - np.repeat(np.add.reduceat(a * da, start), passages))
    dv, du = de[:, None] * model["w"] * u * (1 - v * v), de[:, None] * model["w"] * v * u * (1 - u)
    dh = (dh + dv @ model["V"].T + du @ model["U"].T) * (1 - h * h)
    grads = {
        "W": ((x - model["mean"]) / model["std"]).T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()]),
    }
    return {k: grad + ridge * model[k] for k, grad in grads.items()}


def fit(sample, prior: float | None = None, epochs: int = EPOCHS, seed: int = 9) -> dict:
    """The model from ``(doc_id, text bytes, label)`` rows; deterministic.

    ``prior``: the share of label 1 among all labelled rows; the sample's classes are
    weighed to it. Without texts of both classes every text scores the prior.
    """
    rows = sorted((i, bytes(t or b""), y) for i, t, y in sample)
    y = np.array([r[2] for r in rows], dtype=np.float64)
    share = float(y.mean()) if y.size else 0.5
    prior = share if prior is None else prior
    rng = np.random.default_rng(seed)
    init = lambda a, b: rng.normal(size=(a, b)) / np.sqrt(a)
    model = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
    model |= {"mean": np.zeros(FEATURES), "std": np.ones(FEATURES)}
    if not 0 < share < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        model["c"][:], model["d"][0] = 0, np.log(p / (1 - p))
        return model
    bags = [encode([r[1]])[0] for r in rows]
    every = np.concatenate(bags)
    model["mean"], model["std"] = every.mean(axis=0), every.std(axis=0) + 1e-3
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    names = ("W", "b", "V", "U", "w", "c", "d")
    m, s, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            x = np.concatenate([bags[i] for i in some])
            grads = _gradients(model, x, np.array([len(bags[i]) for i in some]), y[some], weight[some])
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                model[k] = model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_table(docs: DataFrame, labels: DataFrame, learn, per_class: int = PER_CLASS) -> dict:
    """Fit on at most ``2 * per_class`` labelled texts, picked by hash of doc_id.

    Rows without id or label are left out; an id that repeats counts once. The share
    of good labels, which sets the score's level, is counted over all of them.
    """
    ids = sample_labels(labels, "quality", learn, per_class)
    rows = docs.where("doc_id is not null").select("doc_id", text_bytes()).join(ids, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    prior = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn).agg(F.avg("quality")).first()[0]
    return fit([(r.doc_id, r.text, r.label) for r in rows.toLocalIterator()], prior)


def score(docs: DataFrame, model: dict, columns=("doc_id",)) -> DataFrame:
    """``columns`` of docs and ``score`` (0 to 1) of each whole text; null is empty.

    An empty text is one passage without words. No shuffle; the model is a few KB.
    """
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], text_bytes())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts, at, out = batch.column(len(columns)).to_pylist(), 0, []
            while at < len(texts):
                size, stop = len(texts[at]), at + 1
                while stop < len(texts) and size + len(texts[stop]) <= BATCH_BYTES:
                    size, stop = size + len(texts[stop]), stop + 1
                out.append(_sigmoid(forward(model, *encode(texts[at:stop]))["logit"]))
                at = stop
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(columns))], pa.array(p)], [*(f"c{k}" for k in range(len(columns))), "score"])

    schema = ", ".join([*(f"c{k} {rows.schema[k].dataType.simpleString()}" for k in range(len(columns))), "score double"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "score")


def held_out():
    return F.pmod(id_crc(), F.lit(4)) == 2


def op9_attention_mil(spark, sf_dir: str) -> DataFrame:
    """Contract query: quality score of every document; fits on rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_table(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
