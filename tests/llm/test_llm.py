"""The ten corpus operators on small tables: brute force, round trips, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, embedding, linededup, mil, mixing, pitmanyor, rules, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, null ids and sources, repeated rows, a long text, odd characters.
ODD = [
    (1, "The cat sat on the mat by the door\nThe cat sat on the mat by the door", "en", "a", 1), (2, "", "en", "a", 0), (3, None, None, None, None), (4, "The Cat sat  on the mat by the door", "en", "b", 2),
    (None, "no id here at all", "en", "b", 1), (5, "x " * 60_000, "en", "", 3), (6, "  \n\t \n", "en", "b", 1), (6, "  \n\t \n", "en", "b", 1), (7, "İstanbul     ΑΒΓ é́ 😀😀 <|endoftext|> it's 1234   end", "xx", "a", 9), (2, "same id other text", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(n=160, seed=0):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "the", "of", "and", "Light", "dark"]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(words, size=rng.integers(3, 14))) for _ in range(rng.integers(1, 6))]
        if i % 5 == 0 and out:
            lines += out[int(rng.integers(len(out)))][1].split("\n")[:2]
        out.append((i, "\n".join(lines), "en", f"s{i % 5}", 0))
    return out


def near_lines(a, b):
    code = {w: k for k, w in enumerate({*a, *b})}
    a, b = (np.array([code[w] for w in x]) for x in (a, b))
    # within_edits is held against the whole distance table below.
    return linededup.within_edits(a, b, 0 if min(len(a), len(b)) < 4 else max(1, min(len(a), len(b)) // 24))


def removed_by_loop(rows):
    """Line numbers to drop of each row, by comparing every line with all lines before it."""
    seen, want = [], {}
    for i, text, *_ in rows:
        for k, line in enumerate(text.split("\n")):
            if w := WORD.findall(line):
                if any(w == s or abs(len(w) - len(s)) <= max(len(w), len(s)) // 24 + 1 and near_lines(w, s) for s in seen):
                    want.setdefault((i, text), []).append(k)
                seen.append(w)
    return want


def removed(frame):
    texts = {(r.doc_id, r.row): r.text for r in frame.select("doc_id", "text", F.xxhash64("text").alias("row")).collect()}
    return {(r.doc_id, texts[r.doc_id, r.row]): r.lines for r in linededup.removals(frame).collect()}


def test_line_dedup_by_brute_force(spark):
    short = ["one", "one two", "one two three", "one two four", "one two three four", "one two three five", "one two three", "one two three four five", "two three four", "one  two\tthree four"]
    rows = corpus() + [(1000 + k, t, "en", "s", 0) for k, t in enumerate(short)]
    got = removed(spark.createDataFrame(rows, SCHEMA))
    assert got == removed_by_loop(rows) and got


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(5, "first line that is shared by both\nsomething else entirely different here", "en", "s", 0), (5, "unique line nobody else has ever seen\nfirst line that is shared by both", "en", "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    # Of the rows of an id the one whose text has the smaller hash is the earlier.
    order = [r.text for r in frame.orderBy("doc_id", F.xxhash64("text")).collect()]
    assert removed(frame) == removed_by_loop([(5, t) for t in order])
    assert sorted(len(r.text.split("\n")) for r in linededup.dedup_lines(frame).collect()) == [1, 2]


def test_shared_keys_across_batches(spark):
    rng = np.random.default_rng(17)
    rows = [(int(h), int(k)) for h, k in zip(rng.integers(0, 4, 400), rng.integers(0, 90, 400))] + [(7, 200)] * 50 + [(8, 200), (9, 300)] + [(9, 300)] * 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.hash, r.key) for r in linededup.shared_keys(spark.createDataFrame(rows, "hash long, key long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    owners = {k: {h for h, x in rows if x == k} for _, k in rows}
    assert got == sorted((h, k) for k, hs in owners.items() if len(hs) > 1 for h in hs)


def test_line_dedup_verifies_pairs(spark):
    """Were every line to collide with every other, only pairs within the bound would be dropped."""
    docs = spark.createDataFrame([(1, "a b c d e\nv w x y z\na b c d f")], "doc_id long, text string")
    lines = linededup.line_table(docs)
    words = linededup.line_words(docs, lines.select("hash", F.struct("doc_id", "row", "line").alias("at"))).cache()
    every = words.select("hash").crossJoin(words.select(F.col("hash").alias("other"))).where("hash <> other")
    by = {r.hash: r.line for r in words.collect()}
    assert sorted(by[r.hash] for r in linededup._verified(every, words).collect()) == [0, 2]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pairs_are_compared_many_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    a, b = [], []
    for _ in range(1500):
        x = rng.integers(0, 30, rng.integers(1, 30) if rng.random() < 0.5 else rng.integers(48, 200)).tolist()
        y = list(x)
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(len(y) + 1))
            y[at : at + int(rng.integers(2))] = [int(rng.integers(99))] * int(rng.integers(2))
        a.append(x), b.append(y or [1])
    (u, at, n), (v, to, m) = ((np.concatenate([np.array(x, dtype=np.int64) for x in c]), *(np.array(z) for z in (np.cumsum([0, *map(len, c)])[:-1], list(map(len, c))))) for c in (a, b))
    distance = np.array([edit_distance(x, y) for x, y in zip(a, b)])
    assert all(linededup._edits(np.array(x), np.array(y)) == d for x, y, d in zip(a, b, distance))
    right = np.flatnonzero(distance <= linededup.edit_bound(np.minimum(n, m))).tolist()
    for words in (linededup.WORDS, 500):
        monkeypatch.setattr(linededup, "WORDS", words)
        assert linededup.near_pairs(u, at, n, v, to, m).tolist() == right
    assert 300 < len(right) < 1400 and not linededup.near_pairs(u, at[:0], n[:0], v, to[:0], m[:0]).size
    # Lines of one word changed each are told without a step a pair.
    monkeypatch.setattr(linededup, "within_edits", None)
    short = np.flatnonzero(np.minimum(n, m) < 48)
    assert linededup.near_pairs(u, at[short], n[short], v, to[short], m[short]).tolist() == np.flatnonzero(np.isin(short, right)).tolist()


def test_keys_are_exchanged_in_packs(spark, monkeypatch):
    rng = np.random.default_rng(18)
    lists = [(h, rng.choice(400, size=rng.integers(0, 9), replace=False).tolist()) for h in range(300)] + [(h, [1000]) for h in range(300)] * 2 + [(h, [2000 + h]) for h in range(300)]
    pairs = sorted({(h, k) for h, ks in lists for k in ks})
    many = Counter(k for _, k in pairs)
    frame = spark.createDataFrame(lists, "hash long, keys array<long>").repartition(3)
    got = linededup.shared_keys(frame)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    right = [x for x in pairs if many[x[1]] > 1]
    assert sorted(map(tuple, got.collect())) == right
    # A bucket beyond what is held loses nothing.
    for name, value in (("HELD", 4), ("PACK", 2), ("PACKED", 50), ("BUCKETS", 1)):
        monkeypatch.setattr(linededup, name, value)
    assert sorted(set(map(tuple, linededup.shared_keys(frame).collect()))) == right


def test_long_lines_within_a_growing_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (rng.integers(3, size=rng.integers(0, 9)) for _ in range(2))
        assert all(linededup.within_edits(a, b, k) == (edit_distance(a, b) <= k) for k in range(5))
    words, lines = [f"w{k}" for k in range(60)], []
    for size in (47, 48, 49, 71, 72, 150, 300):
        base = [str(w) for w in rng.choice(words, size=size)]
        lines.append(base)
        for edits in (1, 2, 3, size // 24, size // 24 + 1, size // 24 + 2):
            line = list(base)
            # Evenly spaced edits leave the shortest stretches.
            for k, p in enumerate(sorted(((np.arange(edits) + 1) * size // (edits + 1)).tolist(), reverse=True)):
                line[p : p + 1] = [["new"], [], [line[p], "more"]][(k + edits) % 3]
            lines.append(line)
    lines += [["x"] * 100, ["x"] * 103, ["x"] * 110]
    rows = [(k, " ".join(line), "en", "s", 0) for k, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = removed_by_loop(rows)
    assert removed(frame) == want and len(want) > 20
    # Pieces of a few lines and one partner at first lead to the same.
    monkeypatch.setattr(linededup, "CHUNK", 4)
    monkeypatch.setattr(linededup, "LIKELY", 1)
    monkeypatch.setattr(linededup._piece_pairs, "__defaults__", (4,))
    near = [[*lines[3][:p], f"y{p}", *lines[3][p + 1 :]] for p in range(0, 49, 3)]
    crowd = rows + [(500 + k, " ".join(line), "en", "s", 0) for k, line in enumerate(near)]
    assert removed(spark.createDataFrame(crowd, SCHEMA)) == removed_by_loop(crowd)


def test_line_dedup_odd(odd, none):
    out = linededup.dedup_lines(odd.withColumn("lines", F.lit(1)))
    assert out.columns == [*odd.columns, "lines"] and out.count() == len(ODD)
    text = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert text[1, 1] == "The cat sat on the mat by the door" and text[3, None] is None
    assert linededup.dedup_lines(none).count() == 0


def test_pitman_yor_base_and_distribution(spark):
    rows = corpus(120)
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    got = {r.doc_id: r for r in pitmanyor.score(docs, pitmanyor.held_out()).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows}
    tok = {i: [*WORD.findall(t.translate(AZ)), None] for i, t, *_ in rows}
    c = Counter(w for i, ws in tok.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-9 * abs(base) and r.score < 0
    # One-word held-out texts: the probabilities of all first words, the unknown one included, sum to one.
    words = sorted(w for w in c if w)
    probe = [(1000 + k, w, None, None, None) for k, w in enumerate([*words, "neverseen"])]
    both = spark.createDataFrame(rows + probe, SCHEMA).select("doc_id", "text")
    flag = (F.col("doc_id") >= 1000) | pitmanyor.held_out()
    more = spark.createDataFrame([(5000, "", None, None, None)], SCHEMA).select("doc_id", "text")
    s = {r.doc_id: r.score for r in pitmanyor.score(both.union(more), flag | (F.col("doc_id") == 5000)).collect()}
    assert all(x < 0 for x in s.values())


def test_pitman_yor_is_normalised():
    """Over all words, probabilities in each context sum to one for each sample."""
    rng = np.random.default_rng(3)
    w = rng.integers(2, 12, size=400).astype(np.uint64)
    k = rng.integers(0, 3, size=400).astype(np.uint16)
    order = np.lexsort((k, w))
    w, k = w[order], k[order]
    u, first, n = np.unique(w, return_index=True, return_counts=True)
    block = b"r" + b"".join(x.tobytes() for x in (np.array([u.size, w.size], np.uint32), u, n.astype(np.uint32), k, np.arange(w.size).astype(np.uint16), np.ones(w.size, np.uint8)))
    none = np.zeros(0, np.uint64)
    part = pitmanyor.Part([(0, block)], none, none)
    model = pitmanyor.Model(pitmanyor._counted(part, 0, 0), none, none, 2)
    final = pitmanyor._settled(model, pitmanyor._sampled(part, model, 7))
    for s, t, customers, tau in model.seatings(part, 7):
        for ctx in range(3):
            c = np.zeros(part.word.size)
            own = part.k == ctx
            c[part.w[own]] = part.c[own] - final.discount * t[own]
            more = pitmanyor.STRENGTH + final.discount * final.tables[s][ctx]
            p = (c + more * final.lifted(customers, tau, s)) / (pitmanyor.STRENGTH + final.context[ctx])
            unknown = more * final.lifted(0, 0, s) / (pitmanyor.STRENGTH + final.context[ctx])
            assert abs(p.sum() + unknown - 1) < 1e-9 and (p > 0).all()


def test_seating_draws_follow_stirling():
    d, a, n = 0.5, 0.7, 6
    table = pitmanyor.stirling(d)
    want = np.exp(table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(a))
    draws = pitmanyor.seat(np.full(40_000, n), np.full(40_000, a), table, d, np.random.default_rng(0))
    got = np.bincount(draws, minlength=n + 1)[1:] / draws.size
    assert np.abs(got - want / want.sum()).max() < 0.01
    big = pitmanyor.seat(np.full(50, 10_000), np.full(50, a), table, d, np.random.default_rng(0))
    assert (big >= 1).all() and (big <= 10_000).all()


def test_pitman_yor_odd(odd, none, spark):
    got = pitmanyor.score(odd.withColumn("score", F.lit(1)), F.lit(False)).collect()
    assert len(got) == len(ODD) and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert pitmanyor.score(none, F.lit(False)).count() == 0
    assert pitmanyor.score(odd, F.lit(True)).where("train_tokens <> 0").count() == 0


def test_rule_counts_by_brute_force(spark, odd):
    rows = corpus(60) + ODD
    texts = [t or "" for _, t, *_ in rows]
    counts, _ = rules.statistics(texts, rules.WordHashes())
    for t, got in zip(texts, counts.tolist()):
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert got == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]
    out = rules.judge(odd.withColumn("kept", F.lit(1)), None).collect()
    assert len(out) == len(ODD) and all(r.base_failed and not r.kept for r in out if not r.n_words)


def noisy(n, seed):
    rng = np.random.default_rng(seed)
    clean = [" ".join(rng.choice(["river", "stone", "cloud", "over", "under", "light", "green", "walk", "house"], size=80)) + "." for _ in range(n)]
    junk = [" ".join(w + "&&&" for w in rng.choice(["xk", "qz", "river", "pp"], size=80)) for _ in range(n // 4)]
    return [(i, t, int(t in clean)) for i, t in enumerate(clean + junk)]


def test_isolation_forest_separates():
    sample = noisy(300, 1)
    model = rules.fit(sample)
    test = noisy(100, 2)
    stats = rules.statistics([t for _, t, _ in test], rules.WordHashes())[1]
    kept = rules.mean_depth(model, stats) >= model["threshold"]
    y = np.array([k for *_, k in test], dtype=bool)
    assert kept[y].mean() > 0.97 and kept[~y].mean() < 0.05
    assert rules.fit([(1, "a", 1)]) is None


def test_isolation_forest_fits_all_labelled_rows(spark, monkeypatch):
    # Above 3000 labelled texts of a class; in memory and on the table the same rows count.
    sample = noisy(8000, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in sample], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in sample], "doc_id long, quality int")
    y = np.array([k for *_, k in sample])
    part = np.array([zlib.crc32(t.encode()) % 2 == 0 for _, t, _ in sample])
    stats = rules.statistics([t for _, t, _ in sample], rules.WordHashes())[1]
    seen = {}
    own = {name: getattr(rules, name) for name in ("grow", "_spans", "_threshold")}
    for name, f in own.items():
        monkeypatch.setattr(rules, name, lambda *a, name=name, f=f: seen.setdefault(name, a) and f(*a))
    model = rules.fit_table(rules.measure(docs), labels)
    stat, code, rows = seen["_spans"]
    assert rows[stat == 0].sum() == part.sum()
    assert np.allclose(own["_spans"](stat, code, rows), np.ptp(np.quantile(stats[part], (0.01, 0.99), axis=0, method="inverted_cdf"), axis=0), rtol=0.01, atol=0.01)
    depth, good, bad = seen["_threshold"]
    assert good.sum() == (~part & (y == 1)).sum() and bad.sum() == (~part & (y == 0)).sum()
    found, n = np.unique(rules.mean_depth(model, stats[~part]), return_counts=True)
    assert dict(zip(depth.tolist(), (good + bad).tolist())) == dict(zip(found.tolist(), n.tolist()))
    draws, grown = seen["grow"][0], {tuple(x) for x in stats[part & (y == 1)].tolist()}
    drawn = {tuple(x) for d in draws for x in d.tolist()}
    assert all(len(d) == rules.SUBSAMPLE for d in draws) and drawn <= grown and len(drawn) > 0.99 * len(grown)
    again = rules.fit_table(rules.measure(docs.orderBy(F.desc("doc_id")).repartition(7)), labels)
    assert again["threshold"] == model["threshold"] and np.array_equal(again["cut"], model["cut"])
    kept = {r.doc_id: r.kept for r in rules.judge(docs, model).collect()}
    assert np.mean([kept[i] == bool(k) for i, _, k in sample]) > 0.95
    assert rules.fit_table(rules.measure(docs), labels.where("quality = 1")) is None


def test_mil_learns_and_scores_odd(odd, none):
    model = mil.fit([(i, t.encode(), y) for i, t, y in noisy(120, 1)], epochs=10)
    test = noisy(60, 2)
    p = mil._sigmoid(mil.forward(model, *mil.encode([t.encode() for _, t, _ in test]))["logit"])
    assert (((p >= 0.5) == np.array([y for *_, y in test])).mean()) > 0.97
    assert all(0 <= r.score <= 1 for r in mil.score(odd, model).collect()) and mil.score(none, model).count() == 0
    only = mil.fit([(1, b"x", 1)], prior=0.9)
    assert abs(mil._sigmoid(mil.forward(only, *mil.encode([b""]))["logit"])[0] - 0.9) < 1e-9


def test_mil_gradients():
    rng = np.random.default_rng(0)
    model = mil.fit([(i, t.encode(), y) for i, t, y in noisy(12, 1)], epochs=1)
    x, n = mil.encode([t.encode() * 3 for _, t, _ in noisy(8, 3)])
    y, w = rng.integers(0, 2, n.size).astype(float), np.ones(n.size)

    def loss(m):
        z = mil.forward(m, x, n)["logit"]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads = mil._gradients(model, x, n, y, w, ridge=0.0)
    for k in ("W", "V", "U", "w", "c", "b"):
        at = tuple(rng.integers(0, s) for s in model[k].shape)
        up, down = ({**model, k: model[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grads[k][at]) < 1e-6


def test_sharding(spark, tmp_path, odd):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"), small=1000, target=30_000, fanout=3)
    assert table.version() == 0
    for k in range(7):
        table.append(spark.range(k * 300, k * 300 + 300).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).coalesce(2))
        table.compact()
    before = table.version()
    table.compact(final=True)
    shards = table.manifest()["shards"]
    assert table.read().count() == 2100 and table.read().distinct().count() == 2100 and sum(s["rows"] for s in shards) == 2100
    assert len([s for s in shards if s["bytes"] < table.target // 2]) <= 1
    assert table.read(before).count() == 2100
    table.vacuum()
    assert table.read().count() == 2100 and not table.commit(table.manifest(), table.version() - 1)
    for wrong in (spark.range(1), spark.range(1).select(F.col("id").cast("int"), F.lit("x").alias("x"))):
        with pytest.raises(ValueError):
            table.append(wrong)
    other = sharding.ShardedTable(spark, str(tmp_path / "odd"))
    other.append(odd.limit(0))
    assert other.read().count() == 0
    other.append(odd)
    assert other.read().count() == len(ODD) and other.read().where("text is null").count() == 1


def test_vacuum_between_write_and_commit(spark, tmp_path):
    """Shards that another writer has written and not committed yet survive a vacuum."""
    one, two = (sharding.ShardedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.append(spark.range(10))
    made = two._write(spark.range(10, 20))[""]
    one.append(spark.range(20, 30))
    one.compact(final=True)
    one.vacuum()
    two._add(made, spark.range(1).schema)
    two._unmark(made)
    one.vacuum()
    assert sorted(r.id for r in one.read().collect()) == list(range(30))
    dead = two._write(spark.range(5))[""]
    one.vacuum(pending_hours=-1)
    assert not (tmp_path / "t" / dead[0]["path"]).exists() and one.read().count() == 30
    each = sharding.ShardedTable(spark, str(tmp_path / "each"))
    assert each.append_each(spark.range(30).withColumn("k", F.col("id") % 3), "k") == [1, 2, 3]
    assert [each.read(v).count() for v in (1, 2, 3)] == [10, 20, 30] and each.read().columns == ["id"]


def test_sharded_documents_come_back(spark, tmp_path):
    rows = corpus(40) + ODD
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op4_size_tiered(spark, str(tmp_path)).collect()
    number = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % 4
    want = sorted((str(i), number(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.arrival, r.text_sha256) for r in got) == want
    shards = {r.shard: r.shard_rows for r in got}
    assert all(sum(r.shard == k for r in got) == n for k, n in shards.items())


def test_toxicity(odd, none):
    rng = np.random.default_rng(4)
    words = ["river", "stone", "cloud", "over", "under", "light", "green", "walk", "house", "morning"]
    bad = ["blorgface", "snarkwit", "zonkhead"]

    def spelled(w):
        return [w, w[0] + "*" + w[1:], "".join(c + "." for c in w), w[:4] + "x" + w[4:]][rng.integers(4)]

    def texts(n):
        out = []
        for i in range(n):
            t = list(rng.choice(words, size=30))
            if i % 3 == 0:
                t[int(rng.integers(30))] = spelled(bad[int(rng.integers(3))])
            out.append((i, " ".join(t).encode(), int(i % 3 == 0)))
        return out

    model = toxicity.fit(texts(400))
    test = texts(150)
    x = np.array([toxicity._worst(model, toxicity.units(t)) for _, t, _ in test])
    p = 1 / (1 + np.exp(-(model["a"] * x + model["b"])))
    assert ((p >= 0.5) == np.array([y for *_, y in test])).mean() > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(none, model).count() == 0
    assert toxicity.fit([])["b"] < 0


def gapped_kernel(a, b):
    """Shared three-character subsequences by a plain loop over places."""

    def phi(unit):
        out = Counter()
        c = toxicity._CLASS[list(b"\x01" + unit + b"\x02")].tolist()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    if c[i] and c[j] and c[k]:
                        out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    length = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / length if length else 0.0


def test_toxicity_kernel_against_loops():
    rng = np.random.default_rng(8)
    some = [bytes(rng.choice(list(b"abcab*1\xc3\xa9"), size=rng.integers(1, 12))) for _ in range(40)] + [b"aaaaaa", b"mississippi", b"!!!!", b"a"]
    for a in some:
        got = toxicity.apply_table(toxicity.dense(*toxicity.counts(a)), some)
        assert np.allclose(got, [gapped_kernel(a, b) for b in some], atol=1e-12)
        own = got[some.index(a)]
        assert abs(own - 1) < 1e-9 or not toxicity.counts(a)[0].size
    assert not toxicity.counts(b"!!!!")[0].size


def test_toxicity_calibration_ignores_the_cap(spark, monkeypatch):
    rng = np.random.default_rng(0)
    y = (np.arange(20_000) % 10 == 0).astype(int)
    x = rng.normal(size=y.size) + 1.5 * y
    capped = np.r_[np.flatnonzero(y == 1), np.flatnonzero(y == 0)[:2000]]
    (a, b), (c, d) = toxicity._logistic(x, y), toxicity._logistic(x[capped], y[capped], y.mean())
    assert abs(b / a - d / c) < 0.15
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, prior=None: seen.append((len(sample), prior)))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int")
    toxicity.fit_table(docs, labels, F.lit(True), per_class=20)
    assert seen == [(40, 0.1)]


def test_bpe_matches_library(odd, none, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary())
    tok.no_padding()
    tok.no_truncation()
    rows = ODD + corpus(30) + [(9, "a  b\n\n c　d\x1c e \x85 f'll don't 12ab\r\n", "en", "a", 1), (10, "é" * 3000 + "ß!?…" * 50, "de", "a", 1)]
    got = bpe.encode(spark.createDataFrame(rows, SCHEMA), columns=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
    assert bpe.encode(none).count() == 0


def test_bpe_automaton_names_the_tokens_that_end_at_a_node(monkeypatch):
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(bpe.vocabulary()), bpe.load(bpe.vocabulary())
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeinrstlo"), size=rng.integers(1, 30))) for _ in range(300)] + [" interoperability", "zażółć", "日本語", "x" * 200, " " + "\u0142" * 40]
    for word in words:
        raw, state = word.encode(), 0
        for end in range(1, len(raw) + 1):
            state = own._step(state, raw[end - 1])
            # Longest first; a walk looks at no other tokens.
            assert [t for t, _ in own.ends[state]] == [own.rank[raw[a:end]] for a in range(end) if raw[a:end] in own.rank]
    texts = [" ".join(words), "don't it's" + words[0] + "'s", "a  b" + words[1], " ", "a ", " a", "\n b", "no_1 x2 3y"]
    for limit in (bpe.STEPS, 0):
        monkeypatch.setattr(bpe, "STEPS", limit)
        own.forget()
        got = own.encode_batch(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def fingerprint_py(text):
    w = WORD.findall((text or "").translate(AZ))
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark, odd, none):
    rng = np.random.default_rng(5)
    rows = corpus(60) + [(100 + i, " ".join(f"w{j}" for j in range(200 + i % 3)), "en", "a", 0) for i in range(40)]
    fps = [fingerprint_py(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r for r in simhash.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (i, *_) in enumerate(rows):
        assert got[i].fp & (1 << 64) - 1 == fps[k] and got[i].component_id == rows[find(k)][0]
    kept = simhash.keep_one(odd.withColumn("fp", F.lit(1)))
    assert kept.columns == [*odd.columns, "fp"]
    assert simhash.keep_one(none).count() == 0 and simhash.groups(none).count() == 0
    # Random fingerprints: every pair within the bound is found, whatever the chunking.
    base = rng.integers(0, 1 << 63, size=300, dtype=np.uint64)
    near = base[:200].copy()
    for k in range(200):
        for b in rng.choice(64, size=rng.integers(0, 5), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    x = np.unique(np.r_[base, near])
    x = x[np.argsort(simhash.gray_rank(x))]
    pairs = {tuple(sorted((int(x[i]), int(x[j])))) for a, b in simhash.near_pairs(np.zeros(x.size, int), x) for i, j in zip(a, b)}
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(x) for b in x[:i] if bin(int(a) ^ int(b)).count("1") <= 3}
    assert pairs == want


def test_simhash_keys_of_every_width(spark):
    """The same components whatever the number of blocks, and more blocks for more fingerprints."""
    rng = np.random.default_rng(15)
    x = [int(v) for v in rng.integers(0, 1 << 63, size=120, dtype=np.uint64)]
    for k in range(120):
        x.append(x[int(rng.integers(len(x)))] ^ sum(1 << int(b) for b in rng.choice(64, size=1 + k % 5, replace=False)))
    x = sorted(set(x))
    want = simhash.settle(len(x), *(np.array(c, dtype=np.int64) for c in zip(*[(i, j) for i in range(len(x)) for j in range(i) if (x[i] ^ x[j]).bit_count() <= 3])))
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp long").cache()
    place = {v: k for k, v in enumerate(x)}
    for blocks in (4, 5, 6):
        pairs = [(place[r.u % (1 << 64)], place[r.v % (1 << 64)]) for r in simhash.links(frame, blocks=blocks).collect()]
        assert (simhash.settle(len(x), *(np.array(c, dtype=np.int64) for c in zip(*pairs))) == want).all()
    assert [simhash.blocks_for(n) for n in (10, 1 << 21, 1 << 24, 1 << 40)] == [4, 4, 5, 6]


def test_keep_one_tells_rows_apart(spark):
    long_text = " ".join(f"w{k}" for k in range(300))
    rows = [(1, long_text, "en", "a", 0), (1, "another text entirely that nobody repeats", "en", "a", 0), (2, long_text, "en", "a", 0), (None, long_text, "en", "a", 0), (None, "nobody has this one either", "en", "a", 0), (None, "only here twice", "en", "a", 0), (None, "only here twice", "en", "b", 0), (7, None, "en", "a", 0), (8, "", "en", "a", 0), (7, None, "en", "a", 0)]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA).withColumn("again", F.lit(1)))
                   .collect()), key=str)
    assert kept == sorted([(1, long_text), (1, rows[1][1]), (None, rows[4][1]), (None, "only here twice"), (7, None)], key=str)


def vectors(rng, dim=16):
    base = rng.normal(size=(30, dim))
    rows = []
    for i in range(240):
        v = base[i % 30] + 0.06 * rng.normal(size=dim) * (i % 4)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(500 + i, base[0].astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(900, None, 0), (901, [0.0] * dim, 0), (902, [float("nan")] * dim, 0), (903, base[0].astype(np.float32).tolist(), None), (904, [1.0, 2.0], 0), (905, [2.0, 4.0], 0), (906, [], 1), (907, [None] * dim, 1)]
    return rows


@pytest.mark.parametrize("chunk", [1024, 16])
def test_embedding_by_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(embedding, "CHUNK", chunk)
    monkeypatch.setattr(embedding.links, "__defaults__", (embedding.COSINE, embedding.TABLES, chunk))
    rows = vectors(np.random.default_rng(6))
    ok = [k for k, (_, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0
    for a in ok:
        for b in ok:
            (i, v, y), (j, w, z) = rows[a], rows[b]
            if i < j and y == z and len(v) == len(w):
                v, w = np.array(v, np.float64), np.array(w, np.float64)
                if v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98:
                    total += 1
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.98 * 2 * total and all(got[i].n_links <= n for i, n in links.items())
    assert all(got[i].component_id == find(i) and got[i].kept == (find(i) == i) for i in root)
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [16, 64, 256, 768])
def test_cross_polytope_finds_the_hardest_pairs(dim):
    """Random pairs at cosine 0.98 exactly: a pair is a candidate if one's stored key is the other's stored key or probe."""
    rng, n, tables = np.random.default_rng(dim), 1500, embedding.TABLES
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n, dim)))
    z = rng.normal(size=(n, dim))
    y = embedding.COSINE * x + math.sqrt(1 - embedding.COSINE**2) * unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    assert np.allclose((x * y).sum(axis=1), embedding.COSINE)
    a, b = (embedding.bucket_keys(v, np.zeros(n, np.uint64)).reshape(n, -1) for v in (x, y))
    found = [bool((set(p[:tables]) & set(q)) or (set(p) & set(q[:tables]))) for p, q in zip(a.tolist(), b.tolist())]
    assert np.mean(found) >= 0.99


def test_mixing(spark, odd, none):
    rows = corpus(150)
    docs = spark.createDataFrame(rows, SCHEMA)
    m = F.col("__mix")
    got = mixing.with_copies(docs).select("doc_id", "source", m["size"].alias("size"), m["source_size"].alias("ss"), m["target"].alias("target"), m["copies"].alias("copies")).toPandas()
    size = got.groupby("source")["size"].sum()
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size.index))}
    target, full = {}, set()
    while True:
        left = size.sum() - sum(3 * size[s] for s in full)
        free = [s for s in size.index if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3.0 * size[s] for s in full}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in size.index:
        one = got[got.source == s]
        assert abs(one.target.iloc[0] - target[s]) < 1e-6 and one.ss.iloc[0] == size[s] and one.copies.max() <= 3
        assert abs((one["size"] * one.copies).sum() - target[s]) < 0.35 * target[s]
    assert mixing.emit(docs).count() == got.copies.sum() and mixing.emit(docs).columns == docs.columns
    out = mixing.with_copies(odd.withColumn("copies", F.lit(1)))
    assert out.count() == len(ODD) and mixing.emit(none).count() == 0
    clash = mixing.emit(odd.withColumn("__mix", F.lit(1)).withColumn("mix_size", F.lit(2)).withColumn("c0", F.lit(3)))
    assert clash.columns == [*odd.columns, "__mix", "mix_size", "c0"] and {(r["__mix"], r.mix_size, r.c0) for r in clash.collect()} == {(1, 2, 3)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(80)
    spark.createDataFrame(rows + ODD, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and {"doc_id", "n_tokens"} <= set(got.columns)
