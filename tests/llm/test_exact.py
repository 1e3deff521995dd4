"""Operators against brute force on a small table of hard cases: nulls, empty and long texts, copies, ties, repeated rows, clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparsella.llm import cdc, common, debruijn, decontaminate, disclosure, longmatch, mixing, neardup, rindex, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, chunk int"


def word(r):
    return "".join(r.choice(["th", "er", "on", "é", "ou", "nd", "ß", "in"]) for _ in range(r.randint(1, 3)))


def texts():
    r = random.Random(4)
    many = lambda n: " ".join(word(r) for _ in range(n))
    passage, base = many(90), many(120)
    out = [None, "", " \t\n ", "one", "one two", "One TWO", "😀" * 7, "same same " * 60, many(30), many(30)]
    out += [base, base, base.replace(base.split()[60], "changed", 1), base.upper(), many(20) + " " + passage + " " + many(9), passage + "\n" + many(50), many(3000) + " " + passage]
    out += ["a" * 2000, "ab" * 700, "mail me: a.b@c.de, c_x@y.zz! or +49 (30) 1234-5678. 10.0.0.255 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 @ x@y"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1, 2, 3) for i, t in enumerate(texts())]
    rows += [(3, "one", "xx", None, 0, 1, 2, 3), (None, texts()[10], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (10, texts()[10], "again", "s", 0, 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def blank_split(t):
    return [w for w in re.split("[ \t-\r]+", t or "") if w]


def counted(df):
    return collections.Counter(map(tuple, df.collect()))


def test_repeated_words(docs, rows, spark):
    least = {}
    for i, t in rows:
        w = blank_split(t)
        for j in range(len(w) - 12):
            if i is not None:
                q = tuple(w[j : j + 13])
                least[q] = min(least.get(q, i), i)
    want = collections.Counter()
    for i, t in rows:
        w = blank_split(t)
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and least[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    for size in (1 << 22, 500):
        assert counted(debruijn.drop_repeated_words(docs, chunk_bytes=size).drop("kept")) == want
    assert debruijn.drop_repeated_words(docs.limit(0)).count() == 0


def test_colliding_edges_are_not_removed(docs, spark):
    """A path that its source does not hold is dropped."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    base = spark.createDataFrame([(0, debruijn.pack_docs(np.array([1, 2]), [a.encode(), b.encode()]))], "chunk int, docs binary")
    claim = b"2 0 13 " + b" ".join(b.encode().split()[:13])
    found = spark.createDataFrame([(0, debruijn.pack_docs(np.array([1]), [claim]))], "chunk int, paths binary")
    assert debruijn.unconfirmed(base, found, 13, 1).count() == 1


def test_long_matches(docs, rows):
    n = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 39):
            n[b[j : j + 40]] += 1
    want = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 39):
            if n[b[j : j + 40]] > 1:
                gone[j : j + 40] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    for size, hot, index_bytes in ((1 << 22, longmatch.HOT, 1 << 21), (700, longmatch.HOT, 300), (700, 0, 300), (700, 2, 300)):
        assert counted(longmatch.drop_long_matches(docs, 40, 20, chunk_bytes=size, hot=hot, index_bytes=index_bytes).drop("kept")) == want
    assert longmatch.drop_long_matches(docs.limit(0)).count() == 0


def test_run_index():
    """Suffix order, runs and matching statistics against a plain sort and plain comparisons."""
    r = random.Random(1)
    for _ in range(60):
        letters = [bytes([r.choice([0, 1, 65, 66, 200, 255])]) for _ in range(r.choice([1, 2, 3, 200]))]
        base = b"".join(r.choice(letters) for _ in range(60))
        texts = [base[(a := r.randint(0, 50)) : a + r.randint(0, 60)] + b"".join(r.choice(letters) for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 8))]
        index = rindex.RunIndex(texts)
        rest = [(t[j:], i) for i, t in enumerate(texts) for j in range(len(t))]
        assert index.order.tolist() == sorted(range(len(rest)), key=lambda p: ([c + 1 for c in rest[p][0]] + [0], rest[p][1]))
        before = [None if p in index.starts[:-1] and len(rest[p][0]) == len(texts[rest[p][1]]) else index.data[p - 1] for p in index.order.tolist()]
        assert index.heads.tolist() == [i for i, x in enumerate(before) if not i or x is None or x != before[i - 1]]
        shared = lambda x, y: next((n for n, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
        assert index.matching_statistics().tolist() == [max((shared(x, y) for q, (y, _) in enumerate(rest) if q != p), default=0) for p, (x, _) in enumerate(rest)]


def brute_fp(t, k=3):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows):
    fps = [brute_fp(t) for _, t in rows]
    own = [i if i is not None else 1 << 62 for i, _ in rows]
    comp = list(own)
    for _ in range(len(rows)):
        comp = [min(comp[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in range(len(rows))]
    got = counted(simhash.near_components(docs).select("doc_id", "fp", "component_id"))
    assert got == collections.Counter((i, f - (1 << 64) if f >> 63 else f, c if c < 1 << 62 else None) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_a_nameless_row_links_its_neighbours(spark):
    """Three texts whose fingerprints differ by two bits each; the middle one has no doc_id."""
    rows = spark.createDataFrame([(0, 5, 0b0000), (1, None, 0b0011), (2, 9, 0b1111), (3, None, 1 << 40 | 1 << 41 | 1 << 42)], "n int, doc_id long, fp long")
    nodes = rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(simhash.NAMELESS) + F.shiftrightunsigned(F.xxhash64("fp"), 2)).alias("node"))
    found = {x.node: x.component for x in common.components(simhash.near_links(nodes)).collect()}
    assert found[9] == 5 and found[5] == 5 and len(found) == 3


def test_bucket_search_is_exact_either_way(monkeypatch):
    r = np.random.default_rng(0)
    fps = np.unique(np.concatenate([np.uint64(1) << r.integers(0, 26, 200).astype(np.uint64) ^ np.uint64(1) << r.integers(0, 26, 200).astype(np.uint64), r.integers(0, 1 << 26, 100).astype(np.uint64)]))

    def parts(links):
        group = list(range(len(fps)))
        for a, b in links:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
        return len(set(group))

    want = parts([(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2])
    assert parts(simhash.near_in_bucket(fps, 2)) == want
    monkeypatch.setattr(simhash, "WIDE", 10)
    assert parts(simhash.near_in_bucket(fps, 2, (1 << 26) - 1)) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)}


def test_what_components_store_on_their_way_is_deleted(spark):
    import os

    at = common.shared_dir(spark)
    before, spent = set(os.listdir(at)), []
    found = common.settled(lambda: common.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")), "first", spent)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1)]
    assert {x.split("-")[0] for x in set(os.listdir(at)) - before} == {"first"}
    assert common.settled(lambda: found.where("node > 1"), "second", spent).count() == 2
    assert {x.split("-")[0] for x in set(os.listdir(at)) - before} == {"second"}


def test_hot_keys_are_split(spark):
    """A third of all rows with one key: the join splits them over tasks."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 9_973).cast("long").alias("bucket"), F.xxhash64("id").alias("set_id"), F.xxhash64("id", F.lit(1)).alias("fp")).repartition(8)
        sized = neardup._sized(rows)
        assert sized.where("bucket = 7").agg(F.count("*"), F.min("n"), F.max("n")).first()[0] > 13_000
        sized.collect()
        assert "skew=true" in sized._jdf.queryExecution().executedPlan().toString()
        star = spark.range(1, 40_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        assert common.components(star).where("component = 0").count() == 40_001
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_near_duplicates_keep_one_of_each(docs, rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    link = lambda a, b: a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if link(sets[i], sets[j])) for i in range(len(rows))]
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {min((i is None, i or 0) for (i, _), g in zip(rows, group, strict=True) if g == x) for x in set(group)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(want)
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_fingerprints(docs, rows):
    got = cdc.fingerprints(docs, range_bytes=3000).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = cdc.chunk_sets([t.encode(), new.encode(), after.encode()])
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest(), cdc.written(a), cdc.written(b), cdc.near(a, b), cdc.near(a, c))] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert cdc.fingerprints(docs.limit(0)).count() == 0
    text = " ".join(map(str, range(3000))).encode()
    a, b = cdc.chunk_sets([text, b"shift" + text])
    assert cdc.near(a, b) > 0.97 and np.array_equal(cdc.read_back(cdc.written(a)), a)


def base_findings(x):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m)) <= 15]
    return sorted((k, m.start(), m.end()) for k, m in out)


HARD = ["a@b.c_x@y.zz", "x@y@z.com", "a@b..c a@b.c.", "1.2.3.4.5", "01.002.0003.255", "+1 +1234567 89 +(", "4111 1111  1111 1111", "4111111111111111 5", "😀 a@b.c", "9" * 400, "+49" + " " * 50 + "1234567", "a@" * 50, "4111-1111-1111-1111-", "+1-800-555-0199-22"]


def test_personal_data_by_patterns(spark, docs, rows):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    got = counted(disclosure.personal_data(docs.select("doc_id", "text").union(more)).drop("spans"))
    want = collections.Counter()
    for i, t in [*rows, *((1000 + i, t) for i, t in enumerate(HARD))]:
        found = base_findings(t or "")
        line = ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for k, a, b in found)
        want[(i, *(sum(k == x for x, _, _ in found) for k in range(4)), hashlib.sha256(line.encode()).hexdigest())] += 1
    assert got == want


def test_terms_that_reveal_an_entity(spark):
    r = random.Random(1)
    rows = [(i, " ".join(word(r) + "x" for _ in range(40))) for i in range(200)]
    for i in (3, 60, 120, 180):
        w = rows[i][1].split()
        rows[i] = (i, " ".join([*w[:20], "Zanzibarian", "boss@corp.example", *w[20:]]))
    rows[199] = (199, rows[199][1] + " zanzibarian")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in disclosure.personal_data(df).collect()}
    assert [i for i, s in got.items() if "term" in s] and {i for i, s in got.items() if s} == {3, 60, 120, 180, 199}
    t = rows[199][1].index("zanzibarian")
    assert got[199] == f"term:{t}:{t + 11}"
    clean = {x.doc_id: x.text for x in disclosure.sanitised(df).collect()}
    assert "zanzibarian" not in clean[199] and "[email]" in clean[3] and clean[0] == rows[0][1]


def test_leaks(spark, docs):
    r = random.Random(9)
    items = [(i, " ".join(word(r) + word(r) for _ in range(n))) for i, n in enumerate((15, 30, 59, 3))] + [(4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[1][1].split()
    planted = [(500, "x y " + items[0][1].upper() + " z"), (501, "q, " + ", ".join([*w[:29], "other"]) + "."), (502, " ".join([*w[:10], "new", *w[11:20]])), (503, items[2][1]), (504, items[3][1] + " and more"), (None, items[2][1] + " tail")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.leaks(table, bench).collect()}

    def words(t):
        return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]

    def bag(x):
        return collections.Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4)))

    want = {}
    for i, t in [(x.doc_id, x.text) for x in table.collect()]:
        for j, y in items:
            b, d = words(y), words(t)
            if b and d:
                best = max(sum((bag(d[k : k + len(b)]) & bag(b)).values()) / sum((bag(d[k : k + len(b)]) | bag(b)).values()) for k in range(max(1, len(d) - len(b) + 1)))
                if best >= 0.8:
                    want[i, j] = pytest.approx(max(best, want.get((i, j), 0)) if (i, j) not in want else best)
    assert got == want and len(got) >= 4
    kept = decontaminate.without_leaks(table, bench)
    assert kept.count() == table.count() - len({i for i, _ in got})
    assert decontaminate.leaks(table.limit(0), bench).count() == 0 and decontaminate.leaks(table, bench.limit(0)).count() == 0


CLASHING = ["row", "row_of", "of", "leaked_key", "span_key", "span_list", "key", "doc", "found", "at", "pass", "block", "position", "mix_n", "chunk", "fp", "a.b"]


def test_extra_columns_survive(docs, spark):
    bench = spark.createDataFrame([(1, "nothing like it in any of these documents")], "item_id long, text string")
    wide = docs.select("doc_id", "text", "source", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    rows = sorted(map(str, wide.collect()))
    assert decontaminate.without_leaks(wide, bench).columns == wide.columns
    assert sorted(map(str, decontaminate.without_leaks(wide, bench).collect())) == rows
    clean = disclosure.sanitised(wide)
    assert clean.columns == wide.columns and clean.count() == len(rows) and clean.where(F.col("`a.b`") == CLASHING.index("a.b")).count() == len(rows)
    assert mixing.mixture(wide).columns == wide.columns and mixing.mixture(wide).distinct().count() == wide.distinct().count()
    kept = neardup.one_of_each(wide)
    assert kept.columns == wide.columns and {str(x) for x in kept.collect()} <= set(rows)
    for query in (simhash.near_components, longmatch.drop_long_matches, debruijn.drop_repeated_words, cdc.fingerprints, disclosure.personal_data):
        assert query(wide).count() == len(rows)
    assert docs.where(F.col("doc_id").isNull()).count() == 2


def test_repeated_rows_change_no_disclosure(spark):
    r = random.Random(5)
    rows = [(i, " ".join(word(r) + "x" for _ in range(40)) + (f" Keyword{i % 3} u{i}@host.example" if i % 20 == 0 else "")) for i in range(200)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    terms = [sorted((x.term, round(x.disclosure, 6) > 0.6) for x in disclosure.disclosing_terms(t, disclosure.base_findings(t)).collect()) for t in (once, once.union(once).union(once))]
    assert {x for x, _ in terms[0]} <= {x for x, _ in terms[1]} and ("keyword", True) in terms[0] and not {"host", "example"} & {x for x, _ in terms[0]}
    pmi = [{x.term: x.disclosure for x in disclosure.disclosing_terms(t, disclosure.base_findings(t)).collect()} for t in (once, once.union(once))]
    assert all(pmi[1][t] >= pmi[0][t] - 1e-9 for t in pmi[0])  # only the discount of small counts shrinks


def test_chunks_follow_their_rule(docs, rows):
    """Content-defined chunks, cut one byte at a time, and likeness from the chunks' bytes themselves."""
    gear = [int(x) for x in cdc._GEAR]

    def chunks(data):
        out, start = [], 0
        while start < len(data):
            cut = len(data)
            for end in range(start + cdc.LEAST, len(data)):
                h = sum(gear[data[end - 1 - k]] << k for k in range(min(32, end))) & 0xFFFFFFFF
                bits = cdc.STRICT if end < start + cdc.NORMAL else cdc.LOOSE
                if h >> 16 & ((1 << bits) - 1) == 0 or end == start + cdc.MOST:
                    cut = end
                    break
            out.append(data[start:cut])
            start = cut
        return set(out)

    def share(a, b):
        return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)

    order = sorted(((i, (t or "").encode()) for i, t in rows if t is None or len(t) < 3000), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    small = docs.where("text is null or length(text) < 3000")
    got = {}
    for x in cdc.fingerprints(small).collect():
        got.setdefault((x.doc_id, x.fingerprint), []).append(x)
    lengths = lambda fp: sorted(int(v) & 0xFFFF for v in cdc.read_back(fp))
    want = collections.Counter()
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        text, other = t.decode(), u.decode()
        new = (text[: len(text) - len(text) // 2] + other[: len(text) // 2]).encode()
        want[(i, len(text), tuple(sorted(map(len, chunks(t)))), tuple(sorted(map(len, chunks(new)))), round(share(chunks(t), chunks(new)), 9), round(share(chunks(t), chunks(u)), 9))] += 1
    have = collections.Counter((x.doc_id, x.n_chars, tuple(lengths(x.fingerprint)), tuple(lengths(x.edited_fingerprint)), round(x.near_edited, 9), round(x.near_next, 9)) for v in got.values() for x in v)
    assert have == want


def template_texts(others, pairs, share):
    """Texts of 104 words that share their first words; of each pair, the second has the first's last words changed (Jaccard 0.82)."""
    r = random.Random(11)
    fresh = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    template = fresh(share + 4)
    out = [template + fresh(100 - share) for _ in range(others + pairs)]
    out += [x[:-10] + fresh(10) for x in out[:pairs]]
    return [" ".join(x) for x in out]


def grouped(spark, texts):
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    parts = collections.defaultdict(set)
    for x in found:
        parts[x.group].add(x.doc_id)
    return {frozenset(x) for x in parts.values()}


def test_near_duplicates_among_texts_of_one_template(spark):
    """A pair is found although unlike texts with nearer SimHashes stand between its members."""
    want = {frozenset({i, 340 + i}) for i in range(40)} | {frozenset({i}) for i in range(40, 340)}
    assert grouped(spark, template_texts(300, 40, 74)) == want


def test_near_duplicates_in_an_oversized_bucket(spark, monkeypatch):
    """A bucket above BUCKET loses no pair, in tiles of several rows a side."""
    monkeypatch.setattr(neardup, "BUCKET", 16)
    monkeypatch.setattr(neardup, "TILE_ROWS", 50, raising=False)
    want = {frozenset({i, 220 + i}) for i in range(20)} | {frozenset({i}) for i in range(20, 220)}
    assert grouped(spark, template_texts(200, 20, 86)) == want


def test_near_duplicates_with_repeated_lines(spark):
    """Repeats change neither the sets nor what is found: a line once, and the same line 30 times."""
    r = random.Random(12)
    fresh = lambda n: " ".join(f"w{r.getrandbits(40)}" for _ in range(n))
    texts = []
    for _ in range(20):
        body, line = fresh(100), fresh(9)
        texts += [f"{body} {line}", " ".join([body] + [line] * 30)]
    assert grouped(spark, texts) == {frozenset({i, i + 1}) for i in range(0, 40, 2)}
    # One SimHash for a class of equal sets.
    same = spark.createDataFrame([(0, "a b c d e a b c d e"), (1, "a b c d e a b c d e a b c d e a b c d e")], "doc_id long, text string")
    assert len({(x.set_id, x.fp) for x in neardup.sketches(same).collect()}) == 1


def test_leaks_with_their_halves_swapped(spark):
    """A window between the diagonals of its parts is made, as the SQL makes it."""
    fresh = lambda c, n: [f"{c}{i}x" for i in range(n)]
    item = fresh("i", 60)
    table = [(1, fresh("a", 60) + item[30:] + item[:30] + fresh("b", 60)), (2, fresh("c", 33) + item[20:40] + fresh("d", 90)), (3, item[30:] + item[:30]), (4, item[1:])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in table], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {x.doc_id: (x.similarity, x.start_word) for x in decontaminate.leaks(docs, bench).collect()}
    assert got == {1: (pytest.approx(52 / 60), 60), 3: (pytest.approx(52 / 60), 0), 4: (pytest.approx(55 / 56), 0)}
