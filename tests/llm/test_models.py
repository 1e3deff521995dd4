"""Classifiers by held-out accuracy, mixing by its targets, training order by round trip, the pipeline by its stages."""

import collections
import math
import os
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparsella.llm import features, fm, mixing, nbsvm
from sparsella.llm import training_order as order
from sparsella.llm.common import trim

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 6))) for _ in range(30)]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if toxic:
            w[r.randrange(30)] = r.choice(["idiot", "scum", "clown"])
        rows.append((i, " ".join(x + "###" if bad else x for x in w), "en", "s", None))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "some words here", None, None, None), (5, rows[5][1], "other", None, None)]
    labels += [(5, None, None), (None, 1, 1)]
    schema = "doc_id long, text string, lang string, score string, features string"
    return spark.createDataFrame(rows, schema).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out_accuracy(labelled, which):
    docs, labels = labelled
    score = nbsvm.quality_scores if which == "quality" else fm.toxicity_scores
    got = score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    truth = {r.doc_id: r[which] for r in labels.where(f"{which} is not null").collect()}
    held = got[got.held_out & got.doc_id.isin(list(truth))]
    assert len(held) > 100 and (held.predicted == held.doc_id.map(truth)).mean() > 0.97
    assert got[got.doc_id == 5].score.nunique() == 1
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_filter_keeps_columns(labelled):
    docs, labels = labelled
    kept = nbsvm.accepted(docs, labels)
    assert kept.columns == docs.columns and 600 < kept.count() < 720


def test_interactions_are_learned():
    """Terms that are harmless alone and harmful together: only the product of factors can tell."""
    r = np.random.default_rng(0)
    x = r.random((1500, 4)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(int) ^ (~x[:, 0] & ~x[:, 1] & False)
    y = (x[:, 0] == x[:, 1]).astype(int)  # no weight of a single term helps
    doc, term = np.nonzero(x)
    bias, w, v = fm.train(y, doc, term, 4, passes=60)
    out, _ = fm.outputs(doc, term, len(y), bias, w, v)
    assert ((out > 0) == y).mean() > 0.95


def test_neutral_partner_gets_factors():
    """Term 0 is toxic only beside term 1, which is as common in clean rows as in toxic ones; term 2 is toxic alone."""
    r = np.random.default_rng(1)
    x = r.random((4000, 30)) < 0.3
    kind = np.arange(4000) % 10
    x[:, 0], x[:, 2], x[:, 1] = kind < 2, kind == 2, (kind == 0) | (kind > 2) & (r.random(4000) < 4 / 7)
    y = ((kind == 0) | (kind == 2)).astype(int)
    row, term = np.nonzero(x)
    assert fm.deviating(y, row, term, 5)[:3].tolist() == [True, False, True]
    got = fm.chosen(y, np.cumsum([0, *np.bincount(row, minlength=len(x))]), term, 5)
    assert {0, 1, 2} <= set(got.tolist()) and len(got) <= 5
    assert len(fm.chosen(np.zeros(4000, int), np.cumsum([0, *np.bincount(row, minlength=len(x))]), term, 5)) == 0


def test_hinge_weights_reach_the_optimum():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 20, 6)) for _ in range(60)]
    y = np.array([int(3 in x) for x in rows])
    ends, features, scale = np.cumsum([0, *map(len, rows)]), np.concatenate(rows), np.ones(20)
    w = nbsvm.hinge_weights(y, ends, features, scale, passes=400)
    loss = lambda w: (w @ w) / 2 + sum((len(y) / (2 * (y == c).sum())) * max(0, 1 - (1 if c else -1) * (w[x].sum() / np.sqrt(len(x)) + w[-1])) for x, c in zip(rows, y, strict=True))
    best = loss(w)
    assert all(loss(w + d) >= best - 1e-3 for d in r.normal(0, 0.05, (200, 21)))


def test_mixing_weights():
    shares = np.array([0.6, 0.3, 0.1])
    t = mixing.exponent_for(shares, most_passes=2.0)
    assert mixing.passes(shares, mixing.weights(shares, t)).max() == pytest.approx(2.0, abs=1e-6)
    t = mixing.exponent_for(shares, target_entropy=1.0)
    assert mixing.entropy(mixing.weights(shares, t)) == pytest.approx(1.0, abs=1e-6)
    assert mixing.exponent_for(np.array([1.0]), most_passes=3.0) == 0.0
    with pytest.raises(ValueError):
        mixing.exponent_for(shares)


def test_mixture(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), "big" if i % 3 else ("mid" if i % 2 else None), i, i) for i in range(900)]
    rows += [(0, None, "big", 7, 7), (None, "x", "mid", 8, 8), (4, rows[4][1], rows[4][2], 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, pass int, block int").cache()
    for how in ({}, {"budget": 700}, {"target_entropy": 0.9, "most_passes": None}):
        got = mixing.mixed_rows(docs, block_tokens=300, **how).select("doc.*", "tokens", "source_budget", "position").toPandas()
        for _, part in got.groupby("source", dropna=False):
            assert part.source_budget.iloc[0] <= part.tokens.sum() < part.source_budget.iloc[0] + 10
        if not how:
            seen = collections.Counter(got.doc_id.fillna(-1))
            assert set(seen) == {i if i is not None else -1 for i, *_ in rows} and max(c for i, c in seen.items() if i not in (0, 4)) <= 2
    assert mixing.mixture(docs).columns == docs.columns
    assert mixing.mixture(docs.limit(0)).count() == 0


def chained(*values):
    """Spark's xxhash64 of values in turn; integers are of eight bytes unless given as (value, bytes)."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v[0].to_bytes(v[1], "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True))
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("how", [{}, {"budget": 700}, {"target_entropy": 0.9}])
def test_mixture_against_plain_lists(spark, how):
    """Every row, pass, block and position, computed source by source in lists. Ties and repeated rows are there."""
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(300)]
    rows += [(0, None, "big"), (None, "x", "mid"), (4, rows[4][1], rows[4][2]), (4, rows[4][1], rows[4][2])]
    tokens = lambda t: max(1, len((t or "").split()))
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += tokens(t)
    n = sum(total.values())
    shares = np.array([total[s] / n for s in total])
    exponent = mixing.exponent_for(shares, how.get("target_entropy"), None if "target_entropy" in how else mixing.MOST_PASSES)
    w = dict(zip(total, mixing.weights(shares, exponent), strict=True))
    most = how.get("budget") or max(total[s] / w[s] for s in total)
    want = []
    for s in total:
        budget = math.floor(most * w[s] + 0.5) if "budget" in how else math.floor(max(most * w[s], total[s]) + 1e-6)
        blocks, held = math.ceil(total[s] / 100), collections.defaultdict(list)
        for i, t, own in rows:
            if own == s:
                mark = chained(i, t, (17, 4))
                held[mark % blocks].append((mark, i, t))
        before = 0
        for p in range(math.ceil(budget / total[s])):
            for b in sorted(held, key=lambda b: (chained(s, (p, 4), b, (17, 4)), b)):
                size = sum(tokens(t) for _, _, t in held[b])
                shift = {m: chained(m, (p, 4), (17, 4)) for m, _, _ in held[b]}
                if before < budget < before + size:
                    at = before
                    for m, i, t in sorted(held[b], key=lambda x: (shift[x[0]], x[1] is not None, x[1] or 0, x[2] or "")):
                        if at < budget:
                            want.append((i, s, tokens(t), budget, p, b, round(at / budget, 9)))
                        at += tokens(t)
                elif before + size <= budget:
                    want += [(i, s, tokens(t), budget, p, b, round((before + size * (shift[m] / 2**64 + 0.5)) / budget, 9)) for m, i, t in held[b]]
                before += size
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mixed_rows(docs, block_tokens=100, **({"most_passes": None} if "target_entropy" in how else {}), **how).select("doc.doc_id", "doc.source", "tokens", "source_budget", "pass", "block", "position")
    assert collections.Counter((*x[:6], round(x.position, 9)) for x in got.collect()) == collections.Counter(want)


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 64, 1000, 4097):
        f = order.Feistel(n, 99)
        x = f(np.arange(n))
        assert sorted(x.tolist()) == list(range(n)) and np.array_equal(f(x, back=True), np.arange(n))


@pytest.mark.skipif(not os.path.exists(order.VOCABULARY), reason="no vocabulary here")
def test_training_order_round_trip(spark, tmp_path):
    texts = ["one two", "", None, "a  b   c", " lead", "x\n\ny z\t!", "don't 123 é😀", "long " * 700, "one two"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (0, "one two", 1)], "doc_id long, text string, slot int").repartition(3)
    tokenizer = order.Tokenizer()
    assert all(tokenizer(t) == tokenizer.whole(t) for t in texts if t)
    got = order.materialised(docs, length=16, shard_rows=8).cache()
    rows = got.orderBy("sequence").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(len(r.tokens) == 32 for r in rows)
    stream = np.concatenate([np.frombuffer(r.tokens, np.uint16)[: r.n_tokens] for r in rows])
    parts = [tokenizer.coding.decode(p.tolist()) for p in np.split(stream, np.flatnonzero(stream == order.END) + 1) for p in [p[p != order.END]] if True]
    assert collections.Counter(parts[:-1]) == collections.Counter([t or "" for t in texts] + ["no id", "one two"])
    where = (tmp_path / "shards").as_uri()
    assert sum(r.rows for r in order.write_shards(got, where).collect()) == len(rows)
    by_slot = [np.frombuffer(r.tokens, np.uint16).tolist() for r in sorted(rows, key=lambda r: r.slot)]
    assert [x.tolist() for x in order.read_slots(where, 0, len(rows), 16, 8)] == by_slot
    assert [x.tolist() for x in order.read_slots(where, 5, 6, 16, 8)] == by_slot[5:11]
    assert order.materialised(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(order.VOCABULARY), reason="no vocabulary here")
def test_training_order_against_plain_integers(spark, monkeypatch):
    """Stream, sequences and slots by a plain loop; several groups of documents, nulls, repeated rows."""
    monkeypatch.setattr(order, "GROUP_BYTES", 200)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "x y"]) for _ in range(r.randint(0, 12)))) for i in range(40)] + [(None, "no id"), (3, "more of three"), (3, "more of three"), (7, None)]
    length, key, tokenizer = 16, 77, order.Tokenizer()
    groups = max(1, math.ceil(sum(len((t or "").encode()) for _, t in rows) / 200))
    mask = (1 << 64) - 1

    def spread(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    number = lambda i: order.NONE if i is None else i
    coded = [(spread(int(number(i))) % groups, number(i), tokenizer.whole(t or "") + np.uint16(order.END).tobytes(), i) for i, t in rows]
    stream, owner = [], []
    for *_, tokens, i in sorted(coded, key=lambda x: x[:3]):
        ids = np.frombuffer(tokens, np.uint16).tolist()
        stream += ids
        owner += [i] * 0 + [(len(owner), i)] * len(ids)
    n = -(-len(stream) // length)
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [spread((k * 0x9E3779B97F4A7C15 & mask) ^ key) for k in range(1, 5)]

    def slot(x):
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for k in keys:
                left, right = right, left ^ (spread(right ^ k) & ((1 << half) - 1))
            x = left << half | right
            if x < n:
                return x

    want = {}
    for q in range(n):
        own = stream[q * length : (q + 1) * length]
        want[q] = (slot(q), len(own), own + [order.END] * (length - len(own)), [i for _, i in dict.fromkeys(owner[q * length : (q + 1) * length])])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = order.materialised(docs, key=key, length=length, shard_rows=4)
    parts = [[x.slot for x in p] for p in got.select("slot").rdd.glom().collect()]
    flat = [x for p in parts for x in p]
    assert flat == sorted(flat) == list(range(n))  # ranges of slots, in order
    assert all(p[0] % 4 == 0 for p in parts if p)  # of whole shards
    assert {x.sequence: (x.slot, x.n_tokens, np.frombuffer(x.tokens, np.uint16).tolist(), x.doc_ids) for x in got.collect()} == want


def test_scores_by_plain_sums():
    """The machine's output is bias + weights + every pair's inner product; features are the distinct terms of a text."""
    r = np.random.default_rng(3)
    w, v = r.normal(size=9), r.normal(size=(9, 4))
    texts = [sorted(set(r.integers(0, 9, 5).tolist())) for _ in range(20)]
    doc, term = np.repeat(np.arange(20), list(map(len, texts))), np.concatenate(texts)
    got, _ = fm.outputs(doc, term, 20, 0.3, w, v)
    assert np.allclose(got, [0.3 + sum(w[i] for i in t) + sum(v[i] @ v[j] for i in t for j in t if i < j) for t in texts])
    lines = ["One two, TWO three-one", "", "é e\u0301 x", "a" * 700_000 + " b", "two"]
    data, offsets = np.frombuffer("".join(lines).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in lines)])
    d, f = features.term_features(data, offsets, 40)
    split = [set(re.findall(rb"[0-9a-z\x80-\xff]+", x.encode().lower())) for x in lines]
    assert np.bincount(d, minlength=5).tolist() == list(map(len, split))
    own = [set(f[d == i].tolist()) for i in range(5)]
    assert all((len(own[i] & own[j])) == len(split[i] & split[j]) for i in range(5) for j in range(5))


def test_margins_by_plain_sums():
    """Naive Bayes log ratios from counted n-grams, and margins of unit-length scaled rows."""
    y, rows = np.array([1, 0, 1]), [[0, 2], [1, 2], [0]]
    ends, flat = np.cumsum([0, 2, 2, 1]), np.array([0, 2, 1, 2, 0])
    p, q = np.array([3, 1, 2, 1]), np.array([1, 2, 2, 1])
    scale = nbsvm.log_ratios(y, ends, flat, 2)
    assert np.allclose(scale, np.log(p / p.sum()) - np.log(q / q.sum()))
    w = np.array([0.5, -1.0, 2.0, 0.1, 0.7])
    want = [sum(scale[i] * w[i] for i in x) / np.sqrt(sum(scale[i] ** 2 for i in x)) + 0.7 for x in rows]
    assert np.allclose(nbsvm.margins(w, scale, np.repeat([0, 1, 2], [2, 2, 1]), flat, 3), want)


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="memory can't be read here")
def test_the_fit_leaves_the_driver_no_memory(monkeypatch):
    """Of a fit on 13 MB of features nearly nothing stays with the process, and the class counts take little beside them."""
    r = np.random.default_rng(1)
    sizes, y = r.integers(200, 1500, 4000), r.integers(0, 2, 4000)

    def sample(*_):
        parts = [np.frombuffer(r.integers(0, 1 << nbsvm.BITS, n).astype(np.int32).tobytes(), np.int32) for n in sizes.tolist()]
        return y, np.cumsum([0, *sizes]), np.concatenate(parts)

    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    monkeypatch.setattr(nbsvm, "labelled", sample)
    trim()
    before = held()
    score = nbsvm.fit(None, None)
    assert held() - before < 20  # 44 MB stayed before it was given back
    assert len(score(np.array([0, 0]), np.array([3, 9]), 1)) == 1
    _, ends, flat = sample()
    tracemalloc.start()
    nbsvm.log_ratios(y, ends, flat, nbsvm.BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(flat)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not there")
def test_pipeline(spark):
    """All five stages, on documents with nulls, repeated rows and a clashing column; then on an empty table."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit(1)).withColumn("slot", F.lit("x"))
    docs = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.where("doc_id = 8").withColumn("source", F.lit(None).cast("string")))
    docs = docs.union(docs.where("doc_id = 9").withColumn("text", F.lit(None).cast("string")))
    empty = docs.limit(0)
    columns, stages = docs.columns, pipeline.STAGES
    kept = stages[0][1](spark, docs, SF).cache()
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    single = stages[1][1](spark, kept, SF).cache()
    assert single.columns == columns and single.count() <= kept.select("text").distinct().count()
    texts = lambda df: {x.text for x in df.select("text").distinct().collect()}
    shingles = lambda t: set(zip(*[(t or "").lower().split()[i:] for i in range(5)], strict=False)) or {tuple((t or "").lower().split())}
    gone = [shingles(t) for t in texts(kept) - texts(single)]
    held = [shingles(t) for t in texts(kept)]
    assert all(any(x is not y and len(x & y) >= 0.8 * len(x | y) for y in held) for x in gone)
    clean = stages[2][1](spark, single, SF).cache()
    assert clean.columns == columns and 0 < clean.count() <= single.count()
    mixed = stages[3][1](spark, clean, SF).cache()
    assert mixed.columns == columns and texts(mixed) == texts(clean)
    last = stages[4][1](spark, mixed, SF).cache()
    assert last.agg(F.sum("n_tokens")).first()[0] >= mixed.count() and {i for x in last.collect() for i in x.doc_ids} == {x.doc_id for x in mixed.collect()}
    for i, (_, stage) in enumerate(stages):
        assert stage(spark, empty, SF).count() == 0
        assert i == 4 or stage(spark, empty, SF).columns == columns
