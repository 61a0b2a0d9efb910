"""Language-model scores by a hierarchical Pitman-Yor model over words.

Restaurants: a word's context is the word before it, hashed to one of CONTEXTS context
restaurants (frequent words mostly have one of their own, rare ones share). All share
one parent, the word restaurant, whose base is uniform over the words seen in training
and one more that stands for any other. A dish's customers in a context restaurant are
its counts there; its tables there are its customers in the parent.

Seating is sampled by blocked Gibbs: all customers of one dish in one restaurant are
seated again given the other totals, by drawing the number of tables t of c customers
from its conditional, which is proportional to S(c, t) a^t with generalised Stirling
numbers S and a = (strength + discount * tables) * P_parent(word). Dishes with more
than EXACT customers are seated in order of arrival, in blocks that grow with the
number seated. Totals of restaurants are exchanged between sweeps; the last SAMPLES
sweeps have exact totals of their own, so the predictive of each is a distribution,
and the probabilities they give are averaged.

Tokens are shuffled once, as packed blocks keyed by word, and every sweep and the
scoring read the same shuffle files. Words that would fill much of a partition are
dealt out by context, and pairs of context and word that would by batch of documents;
both lists have at most 4 entries a partition.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, id_crc, mix64, parts, text_bytes
from .textstats import span_hashes, word_spans

CONTEXTS = 1 << 16
SAMPLES = 3
STRENGTH = 1.0
EXACT = 48
#: Tokens packed into one set of blocks; at most 2**15 documents of one batch.
BATCH_TOKENS = 3_000_000
BATCH_BYTES = 4_000_000
END = np.uint64(1)
#: First byte of a block: documents of a batch, or rows of tokens or sums.
_ABOUT, _ROWS = b"d", b"r"


# Tokens -------------------------------------------------------------------------------


def tokens(texts: list[bytes]):
    """Word hash, context and text number of every token, the ends included, in order."""
    out = []
    at = 0
    while at < len(texts):
        size, stop = len(texts[at]), at + 1
        while stop < len(texts) and size + len(texts[stop]) <= BATCH_BYTES:
            size, stop = size + len(texts[stop]), stop + 1
        buffer, start, end, text = word_spans([t.translate(LOWER_AZ) for t in texts[at:stop]])
        h = np.maximum(span_hashes(buffer, start, end), np.uint64(2))
        n = stop - at
        place = np.searchsorted(text, np.arange(n), side="right")
        w = np.insert(h, place, END)
        own = np.insert(text, place, np.arange(n))
        before = np.r_[END, w[:-1]]
        k = (1 + (mix64(before) >> np.uint64(20)) % np.uint64(CONTEXTS - 1)).astype(np.uint16)
        k[before == END] = 0
        out.append((w, k, own + at))
        at = stop
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64)]


def _batches(batches):
    """(texts, ids, held) of up to BATCH_TOKENS tokens, by a bound on bytes."""
    for batch in batches:
        ids, held, texts = (batch.column(k).to_pylist() for k in range(3))
        at = 0
        while at < len(texts):
            size, stop = len(texts[at]), at + 1
            while stop < len(texts) and size + len(texts[stop]) <= 5 * BATCH_TOKENS and stop - at < 1 << 15:
                size, stop = size + len(texts[stop]), stop + 1
            yield texts[at:stop], ids[at:stop], held[at:stop]
            at = stop


def _pair(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix64(mix64(w) + k.astype(np.uint64))


def hot(docs: DataFrame, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and pairs of word and context, with over 1/(4 partitions) of all tokens.

    Every batch reports those with such a share of its own tokens; a word or pair that
    has it overall has it in some batch. Decides only how rows are dealt out.
    """

    def run(batches):
        for texts, _, _ in _batches(batches):
            w, k, _ = tokens(texts)
            rows = [("", 0, w.size)]
            for kind, x in (("w", w), ("p", _pair(w, k))):
                u, n = np.unique(x, return_counts=True)
                on = n > w.size / (4 * partitions)
                rows += [(kind, int(a), int(b)) for a, b in zip(u[on].view(np.int64), n[on])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["kind", "key", "n"])

    found = docs.mapInArrow(run, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("kind") == "", F.col("n")))
    n = found.agg(total).first()[0] or 0
    rows = found.where(F.col("kind") != "").where(F.col("n") > n / (4 * partitions)).collect()
    pick = lambda kind: np.array(sorted(r.key for r in rows if r.kind == kind), dtype=np.int64).view(np.uint64)
    return np.sort(pick("w")), np.sort(pick("p"))


def _isin(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not some.size:
        return np.zeros(x.size, dtype=bool)
    return some[np.minimum(np.searchsorted(some, x), some.size - 1)] == x


def packed(docs: DataFrame, partitions: int, words: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """``(p, batch, block)``: each batch's tokens cut by partition, and its documents.

    A block holds distinct (word, context, document) triples in order with counts of
    at most 255 (more are repeated): words with their number of rows, contexts,
    documents (bit 15: held out), counts.
    """

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for number, (texts, ids, held) in enumerate(_batches(batches)):
            batch = task + number
            w, k, doc = tokens(texts)
            per = np.bincount(doc, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array([number * 7919 % partitions], pa.int32()), pa.array([batch]), pa.array([_ABOUT + pickle.dumps((ids, held, per))], pa.binary())], ["p", "batch", "block"])
            held = np.array(held, dtype=bool)
            u, wi = np.unique(w, return_inverse=True)
            key = (wi.astype(np.uint64) << np.uint64(32)) | (k.astype(np.uint64) << np.uint64(16)) | (held[doc].astype(np.uint64) << np.uint64(15)) | doc.astype(np.uint64)
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[first, key.size])
            key = np.repeat(key[first], -(-count // 255))
            if count.max(initial=0) > 255:
                pieces = -(-count // 255)
                at = np.arange(key.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                count = np.minimum(np.repeat(count, pieces) - 255 * at, 255)
            wi, k = (key >> np.uint64(32)).astype(np.int64), (key >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)
            doc, count = (key & np.uint64(0xFFFF)).astype(np.uint16), count.astype(np.uint8)
            p = (mix64(u) % np.uint64(partitions)).astype(np.uint16 if partitions < 1 << 16 else np.uint32)[wi]
            on = np.flatnonzero(_isin(u, words)[wi] | bool(pairs.size))
            if on.size:
                pair = _pair(u[wi[on]], k[on])
                far = _isin(u[wi[on]], words)
                p[on[far]] = pair[far] % np.uint64(partitions)
                p[on[_isin(pair, pairs)]] = int(mix64(np.array([batch], dtype=np.uint64))[0] % np.uint64(partitions))
            order = np.argsort(p, kind="stable")
            wi, k, doc, count, p = wi[order], k[order], doc[order], count[order], p[order]
            borders = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
            for a, b in zip(borders[:-1], borders[1:]):
                own = wi[a:b]
                new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                head = np.array([new.size, b - a], dtype=np.uint32)
                block = _ROWS + b"".join(x.tobytes() for x in (head, u[own[new]], np.diff(np.r_[new, b - a]).astype(np.uint32), k[a:b], doc[a:b], count[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array([int(p[a])], pa.int32()), pa.array([batch]), pa.array([block], pa.binary())], ["p", "batch", "block"])

    return docs.mapInArrow(run, "p int, batch long, block binary")


# Seating ------------------------------------------------------------------------------


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) of generalised Stirling numbers, c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + out[c, t] if c else np.full(1, -np.inf)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def seat(c: np.ndarray, a: np.ndarray, table: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A draw of the number of tables for ``c`` customers; ``a`` weighs a new table."""
    t = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(np.minimum(c, EXACT + 1).astype(np.uint8), kind="stable")
    ends = np.searchsorted(np.minimum(c, EXACT + 1)[order], np.arange(EXACT + 2), side="right")
    for n in range(2, EXACT + 1):
        own = order[ends[n - 1] : ends[n]]
        for at in range(0, own.size, 100_000):
            some = own[at : at + 100_000]
            x = table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(a[some])[:, None]
            x = np.cumsum(np.exp(x - x.max(axis=1, keepdims=True)), axis=1)
            t[some] = 1 + (x < rng.random(some.size)[:, None] * x[:, -1:]).sum(axis=1)
    big = order[ends[EXACT] :]
    if big.size:
        total, weight = c[big], a[big]
        seated, tables = np.ones(big.size, dtype=np.int64), np.ones(big.size, dtype=np.int64)
        while True:
            block = np.minimum(np.maximum(1, seated // 8), total - seated)
            if not block.any():
                break
            new = rng.binomial(block, weight / (weight + seated - discount * tables))
            seated, tables = seated + block, tables + new
        t[big] = tables
    return t


class Part:
    """The pairs and tokens of one partition."""

    def __init__(self, blocks, words: np.ndarray, pairs: np.ndarray):
        w, k, doc, count, self.batches, self.docs = [], [], [], [], [], []
        for batch, block in blocks:
            if block[:1] == _ABOUT:
                self.docs.append((batch, block))
                continue
            n, m = np.frombuffer(block, np.uint32, 2, 1)
            n, m = int(n), int(m)
            own = np.frombuffer(block, np.uint64, n, 9)
            w.append(np.repeat(own, np.frombuffer(block, np.uint32, n, 9 + 8 * n)))
            at = 9 + 12 * n
            k.append(np.frombuffer(block, np.uint16, m, at))
            doc.append(np.frombuffer(block, np.uint16, m, at + 2 * m))
            count.append(np.frombuffer(block, np.uint8, m, at + 4 * m))
            self.batches.append((batch, m))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        w, k, self.doc, self.count = cat(w, np.uint64), cat(k, np.uint16), cat(doc, np.uint16), cat(count, np.uint8)
        self.held = (self.doc >> 15).astype(bool)
        self.doc = self.doc & 0x7FFF
        self.word, wi = np.unique(w, return_inverse=True)
        key = (wi.astype(np.uint64) << np.uint64(16)) | k
        pair, self.of = np.unique(key, return_inverse=True)
        self.w, self.k = (pair >> np.uint64(16)).astype(np.int64), (pair & np.uint64(0xFFFF)).astype(np.int64)
        self.c = np.bincount(self.of, np.where(self.held, 0, self.count), minlength=pair.size).astype(np.int64)
        # What is hot has its totals elsewhere: of a pair all, of a word those of its pairs' sums.
        name = _pair(self.word[self.w], self.k.astype(np.uint16)) if pairs.size else np.zeros(0, np.uint64)
        self.hot_pair = np.flatnonzero(_isin(name, pairs)) if pairs.size else np.zeros(0, np.int64)
        self.hot_pair_at = np.searchsorted(pairs, name[self.hot_pair])
        self.hot_word = np.flatnonzero(_isin(self.word, words))
        self.hot_word_at = np.searchsorted(words, self.word[self.hot_word])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of a pair's values over each word."""
        return np.bincount(self.w, x, minlength=self.word.size).astype(np.int64)


def _added(a: dict, b: dict) -> dict:
    """Totals of two partitions; what names a hot pair is the same wherever it is known."""
    return {k: np.maximum(a[k], b[k]) if k.startswith("name_") else a[k] + b[k] for k in a}


def _counted(part: Part, n_words: int, n_pairs: int) -> dict:
    """Training counts of one partition: totals and what is hot."""
    hot_c = np.zeros(n_pairs, np.int64)
    np.add.at(hot_c, part.hot_pair_at, part.c[part.hot_pair])
    hot_k = np.zeros(n_pairs, np.int64)
    hot_k[part.hot_pair_at] = part.k[part.hot_pair] + 1
    hot_wp = np.zeros(n_pairs, np.uint64)
    hot_wp[part.hot_pair_at] = part.word[part.w[part.hot_pair]]
    cold = np.ones(part.c.size, dtype=bool)
    cold[part.hot_pair] = False
    word = part.sums(np.where(cold, part.c, 0))
    hot_w = np.zeros(n_words, np.int64)
    np.add.at(hot_w, part.hot_word_at, word[part.hot_word])
    own = np.ones(word.size, dtype=bool)
    own[part.hot_word] = False
    c, w = part.c[cold], word[own]
    return {
        "context": np.bincount(part.k, part.c, minlength=CONTEXTS).astype(np.int64), "tokens": np.array([part.c.sum()]), "kinds": np.array([(w > 0).sum()]),
        "pairs": np.bincount(np.minimum(c, 3), minlength=4), "words": np.bincount(np.minimum(w, 3), minlength=4),
        "hot_c": hot_c, "hot_w": hot_w, "name_k": hot_k, "name_w": hot_wp,
    }


class Model:
    """Counts and totals all partitions share; small: CONTEXTS, and the hot lists."""

    def __init__(self, counts: dict, words: np.ndarray, pairs: np.ndarray, samples: int):
        self.words, self.pairs, self.samples = words, pairs, samples
        self.context = counts["context"].astype(np.float64)
        self.hot_c, self.tokens = counts["hot_c"], int(counts["tokens"][0])
        self.hot_k = counts["name_k"] - 1
        # A hot pair's word is hot as well, as it has all the tokens of the pair.
        self.hot_pw = np.searchsorted(words, counts["name_w"])
        self.hot_w = counts["hot_w"].copy()
        np.add.at(self.hot_w, self.hot_pw, self.hot_c)
        self.kinds = int(counts["kinds"][0]) + int((self.hot_w > 0).sum())
        rate = lambda n: min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2]))) if n[1] and n[2] else 0.5
        self.discount, self.discount1 = rate(counts["pairs"]), rate(counts["words"])
        distinct = counts["pairs"][1:].sum() + (self.hot_c > 0).sum()
        # To begin with: as many tables as pairs, spread like customers.
        self.tables = [np.minimum(self.context, self.context * distinct / max(1, self.tokens) + 1)] * (samples + 1)
        self.parent, self.top = [max(1.0, float(distinct))] * (samples + 1), [max(1.0, float(self.kinds))] * (samples + 1)
        self.hot_t = np.minimum(self.hot_c, 1)[None].repeat(samples + 1, axis=0)
        self.hot_wt = np.maximum(1, self.hot_w // 4)[None].repeat(samples + 1, axis=0)
        self.hot_tau = np.minimum(self.hot_w, 1)[None].repeat(samples + 1, axis=0)

    def lifted(self, customers, tau, s: int):
        """P_parent(word) of sample s for words with such customers and tables in the parent."""
        base = (STRENGTH + self.discount1 * self.top[s]) / (self.kinds + 1)
        return (customers - self.discount1 * tau + base) / (STRENGTH + self.parent[s])

    def seatings(self, part: Part, seed: int):
        """Yield (s, t, customers, tau) of each sample after a first sweep: the same on every call.

        Draws are conditioned on this model's totals; those of sample 0.
        """
        m = self
        rng = np.random.default_rng([seed, 2])
        table, table1 = stirling(m.discount), stirling(m.discount1)
        cold = np.ones(part.c.size, dtype=bool)
        cold[part.hot_pair] = False
        c = np.where(cold, part.c, 0)
        word = part.sums(c)
        word[part.hot_word] = self.hot_w[part.hot_word_at]
        base = (STRENGTH + m.discount1 * m.top[0]) / (m.kinds + 1)
        up = (word + base) / (self.tokens + STRENGTH + m.discount1 * m.top[0])
        some = np.flatnonzero(c)
        for s in range(m.samples + 1):
            t = np.zeros(c.size, dtype=np.int64)
            a = (STRENGTH + m.discount * m.tables[0][part.k[some]]) * up[part.w[some]]
            t[some] = seat(c[some], a, table, m.discount, rng)
            customers = part.sums(t)
            # Customers of hot words are counted over all partitions; until then, the last known.
            customers_all = customers.copy()
            customers_all[part.hot_word] = m.hot_wt[0][part.hot_word_at]
            tau = seat(customers_all, np.full(customers.size, base), table1, m.discount1, rng)
            up = np.maximum(m.lifted(customers_all, tau, 0), 1e-300)
            yield s, t, customers, tau


def _sampled(part: Part, model: Model, seed: int) -> dict:
    """Totals of each sample over one partition."""
    n = model.samples + 1
    out = {"tables": np.zeros((n, CONTEXTS), np.int64), "parent": np.zeros(n, np.int64), "top": np.zeros(n, np.int64), "hot_wt": np.zeros((n, model.words.size), np.int64)}
    for s, t, customers, tau in model.seatings(part, seed):
        out["tables"][s] = np.bincount(part.k, t, minlength=CONTEXTS)
        out["parent"][s] = t.sum()
        np.add.at(out["hot_wt"][s], part.hot_word_at, customers[part.hot_word])
        tau = tau.copy()
        tau[part.hot_word] = 0
        out["top"][s] = tau.sum()
    return out


def _settled(model: Model, out: dict) -> Model:
    """The model with the totals of each sample, what is hot seated here."""
    new = Model.__new__(Model)
    new.__dict__ = dict(model.__dict__)
    rng = np.random.default_rng(1)
    tables = out["tables"].astype(np.float64)
    parent, top = out["parent"].astype(np.float64), out["top"].astype(np.float64)
    new.hot_t, new.hot_wt, new.hot_tau = np.zeros_like(model.hot_t), out["hot_wt"].copy(), np.zeros_like(model.hot_tau)
    base = (STRENGTH + model.discount1 * model.top[0]) / (model.kinds + 1)
    for s in range(model.samples + 1):
        if model.pairs.size:
            up = np.maximum(model.lifted(model.hot_wt[0], model.hot_tau[0], 0), 1e-300)[model.hot_pw]
            new.hot_t[s] = seat(model.hot_c, (STRENGTH + model.discount * model.tables[0][model.hot_k]) * up, stirling(model.discount), model.discount, rng)
            np.add.at(tables[s], model.hot_k, new.hot_t[s])
            np.add.at(new.hot_wt[s], model.hot_pw, new.hot_t[s])
            parent[s] += new.hot_t[s].sum()
        new.hot_tau[s] = seat(new.hot_wt[s], np.full(model.words.size, base), stirling(model.discount1), model.discount1, rng)
        top[s] += new.hot_tau[s].sum()
    new.tables, new.parent, new.top = list(tables), list(parent), list(top)
    return new


def _scored(part: Part, seed: int, drawn: Model, model: Model):
    """Yield (batch, block) of sums for each batch's documents, and the batches' documents.

    ``drawn`` is the model the seatings are drawn under, ``model`` has their totals.
    """
    yield from part.docs
    if not part.of.size:
        return
    word = part.sums(part.c)
    word[part.hot_word] = model.hot_w[part.hot_word_at]
    c = part.c.astype(np.float64)
    c[part.hot_pair] = model.hot_c[part.hot_pair_at]
    total = np.zeros(c.size)
    for s, t, customers, tau in drawn.seatings(part, seed):
        if s == 0:
            continue
        t[part.hot_pair] = model.hot_t[s][part.hot_pair_at]
        customers[part.hot_word] = model.hot_wt[s][part.hot_word_at]
        tau = tau.copy()
        tau[part.hot_word] = model.hot_tau[s][part.hot_word_at]
        up = model.lifted(customers, tau, s)[part.w]
        more = STRENGTH + model.discount * model.tables[s][part.k]
        total += (c - model.discount * t + more * up) / (STRENGTH + model.context[part.k])
    score = np.log10(total / model.samples)
    base = np.log10((word + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))[part.w]
    known = (word > 0)[part.w]
    at = 0
    for batch, m in part.batches:
        some = slice(at, at + m)
        at += m
        doc, of, n = part.doc[some].astype(np.int64), part.of[some], part.count[some].astype(np.float64)
        docs = np.flatnonzero(np.bincount(doc))
        add = lambda x: np.bincount(doc, x * n)[docs]  # noqa: B023, E731
        yield batch, _ROWS + b"".join([docs.astype(np.uint16).tobytes(), add(known[of]).astype(np.uint32).tobytes(), add(base[of]).tobytes(), add(score[of]).tobytes()])


def score(docs: DataFrame, held: Column, samples: int = SAMPLES, ident: str = "doc_id") -> DataFrame:
    """Scores of every whole text under the model learned from rows where ``held`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    perplexity (10 ** (-score / n_tokens)). Null texts are empty and have one token,
    the end. Without training rows every token has probability 1 under both models'
    limits: one word, the unknown one. Repeated rows and null ids are scored like
    others; the id passes through.
    """
    n = parts(docs)
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), text_bytes())
    words, pairs = hot(rows, n)
    blocks = packed(rows, n, words, pairs).rdd.map(lambda r: (r[0], (r[1], bytes(r[2])))).partitionBy(n, lambda p: p)
    sc = docs.sparkSession.sparkContext
    lists = sc.broadcast((words, pairs))

    def over(work, *shared):
        shared = [sc.broadcast(x) for x in shared]

        def run(index, rows):
            part = Part((b for _, b in rows), *lists.value)
            return work(part, index, *[x.value for x in shared])

        return blocks.mapPartitionsWithIndex(run)

    counts = over(lambda part, _: [_counted(part, lists.value[0].size, lists.value[1].size)]).treeReduce(_added)
    first = Model(counts, words, pairs, samples)
    drawn = _settled(first, over(lambda part, seed, m: [_sampled(part, m, seed)], first).treeReduce(_added))
    # Later draws are conditioned on the totals of the first sweeps' last sample.
    for name in ("tables", "parent", "top", "hot_wt", "hot_t", "hot_tau"):
        setattr(drawn, name, [getattr(drawn, name)[-1]] * (samples + 1) if isinstance(getattr(drawn, name), list) else getattr(drawn, name)[-1:].repeat(samples + 1, axis=0))
    final = _settled(drawn, over(lambda part, seed, m: [_sampled(part, m, seed)], drawn).treeReduce(_added))
    sums = over(lambda part, seed, m, f: _scored(part, seed, m, f), drawn, final)
    table = docs.sparkSession.createDataFrame(sums.map(lambda x: (x[0], bytearray(x[1]))), "batch long, block binary")
    tokens_seen = final.tokens

    def gather(batches):
        about, found = {}, {}
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, block = block[:1], block[1:]
                if kind == _ABOUT:
                    about[number] = pickle.loads(block)
                    continue
                m = len(block) // 22
                known, base, got = found.setdefault(number, tuple(np.zeros(1 << 15) for _ in range(3)))
                at = np.frombuffer(block, np.uint16, m)
                known[at] += np.frombuffer(block[2 * m : 6 * m], np.uint32)
                base[at] += np.frombuffer(block[6 * m : 14 * m], np.float64)
                got[at] += np.frombuffer(block[14 * m :], np.float64)
        for number, (ids, held_out, per) in about.items():
            size = len(ids)
            known, base, got = (x[:size] for x in found.pop(number))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(per, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(size, tokens_seen, np.int64)), pa.array(base), pa.array(got), pa.array(10.0 ** np.minimum(300, -got / per))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return table.repartition(n, "batch").mapInArrow(gather, schema)


def held_out():
    return F.pmod(id_crc(), F.lit(10)) == 0


def op2_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Contract query: scores of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, held_out())
