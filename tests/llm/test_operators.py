"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables
and further columns whose names clash with those that the operators use inside."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixforge.llm import bpe, chat, common, components, knn_voronoi, line_dedup, mixing, quality, secret_scan, simhash, suffix_dedup, vectors, vptree
from helixforge.llm.common import bitmap, marked, ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n int, line string, size long, fp long, bytes int, hit string, bucket int, shard int"


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, source) with columns that clash."""
    ready(spark)
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, 7, "x", 7, 7, 7, "x", 7, 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(rng, n, vocabulary=30):
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


# --- 1 and 5: search ---


def rows_of_vectors(spark, seed, n=400, dim=6, hot=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:hot] = x[0]  # a hot group of equal vectors, and so ties
    rows = [(int(i), [float(v) for v in x[i]], "c") for i in range(n)]
    rows += [(3, rows[3][1], "again"), (n + 1, None, "c"), (n + 2, [1.0, None] + [0.0] * (dim - 2), "c"), (n + 3, [float("nan")] * dim, "c"), (None, rows[5][1], "c")]
    rows += [(n + 10, [0.0] * dim, "c"), (n + 20, [float("inf")] + [0.0] * (dim - 1), "c"), (n + 30, [2.0] * (dim - 2), "short")]
    ready(spark)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string").withColumns({c: F.lit("x") for c in ("v", "d", "g", "block", "n2", "rank", "score")}), rows


def brute(rows, every, k, scale, zero):
    own = {}
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [np.float64(np.float32(x)) for x in v]
        own[i] = [np.floor(x * scale) for x in v] if scale else v
    if not zero:
        own = {i: v for i, v in own.items() if any(v)}
    out = {}
    for q in own:
        if q % every == 0:
            scored = sorted(((-float(sum(a * b for a, b in zip(own[q], own[i]))), i) for i in own if i != q))[:k]
            out |= {(q, r): (i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_voronoi_search_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(knn_voronoi, "PIECE", 64)
    monkeypatch.setattr(knn_voronoi, "PART", 3)
    df, rows = rows_of_vectors(spark, seed)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn_voronoi.search(df, F.col("vec_id") % 10 == 0, 5).collect()}
    assert got == {k: (i, int(s)) for k, (i, s) in brute(rows, 10, 5, 256.0, True).items()}


def test_rings_hold_all_neighbours_and_spare_some():
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([rng.normal(size=(200, 8)) * 9 + c for c in (rng.normal(size=(6, 8)) * 300)]))
    m2 = float((x * x).sum(1).max())
    space = knn_voronoi.Space(x[::200], m2)
    d = space.data(x)
    cell = d.argmin(1)
    near = [np.sort(d[cell == j, j])[:6] for j in range(6)]
    q = x[5:200:20]
    low, high = knn_voronoi.rings(space, q, near, 5)
    sent = (d[np.arange(len(x)), cell] >= low[cell]) & (d[np.arange(len(x)), cell] <= high[cell])
    s = q @ x.T
    best = np.argsort(-s, axis=1)[:, :5]
    assert sent[best].all() and sent.mean() < 0.9


def in_order(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += float(x) * float(y)
    return s


def brute_in_order(rows, every, k):
    """The nearest by sums taken component by component, as the contract's measure is computed here."""
    own = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = [np.float64(np.float32(x)) for x in v]
    return {(q, r): (i, -s) for q in own if q % every == 0 for r, (s, i) in enumerate(sorted((-in_order(own[q], own[i]), i) for i in own if i != q)[:k], 1)}


@pytest.mark.parametrize("shard,leaf,spare", [(120, 20, 16), (30, 4, 1), (8192, 96, 16)])
def test_vantage_point_trees_are_exact_at_factor_one_and_close_at_the_default(spark, monkeypatch, shard, leaf, spare):
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "SPARE", spare)
    monkeypatch.setattr(vptree.build, "__defaults__", (leaf, 3))
    df, rows = rows_of_vectors(spark, 4)
    want = brute_in_order(rows, 20, 20)
    exact = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 20, 1.0).collect()}
    assert exact == want  # ids and scores to the last bit, with 60 equal vectors
    loose = defaultdict(list)
    own = {(i, j): s for (i, _), (j, s) in want.items()}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        loose[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert own.get((r.query_id, r.vec_id), r.score) == r.score
    for found in loose.values():
        assert sorted(found) == [(n, i, s) for n, (s, i) in enumerate(sorted(((s, i) for _, i, s in found), key=lambda x: (-x[0], x[1])), 1)]
    truth = defaultdict(set)
    for (q, _), (i, _) in want.items():
        truth[q].add(i)
    assert np.mean([len({i for _, i, _ in loose[q]} & truth[q]) / len(truth[q]) for q in truth]) >= 0.9


def test_equal_vectors_and_scores_that_differ_in_the_last_bit(spark, monkeypatch):
    """Equal vectors, and permuted ones whose products differ by rounding only, over several shards and leaves."""
    monkeypatch.setattr(vptree, "SHARD", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[100:400] = x[100]
    x[400:600] = np.concatenate([rng.permuted(np.abs(x[50]))[None] for _ in range(200)])
    x[0], x[20] = 1.0, x[100]
    rows = [(int(i), [float(v) for v in x[i]], "c") for i in range(len(x))]
    ready(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    for factor in (1.0, 1.25, 2.0):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 20, factor).collect()}
        want = brute_in_order(rows, 20, 20)
        if factor == 1.0:
            assert got == want
        else:  # equal vectors are found together, smaller ids first
            of = defaultdict(list)
            for (q, _), (i, _) in sorted(got.items()):
                if 100 <= i < 400 and not 100 <= q < 400 and q != 20:
                    of[q].append(i)
            assert of and all(v == list(range(100, 100 + len(v))) for v in of.values())
            assert np.mean([got[k][0] == want[k][0] for k in want]) > 0.8


def test_exact_search_equals_sql(spark):
    import duckdb

    table = "/root/testdata/sf0.01/embeddings.parquet"
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(spark.read.parquet(table), F.col("vec_id") % 20 == 0, 20, 1.0).collect())
    sql = f"""
        with own as (
            select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from '{table}'
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        scored as (
            select q.vec_id as query_id, d.vec_id,
                list_reduce(list_prepend(0.0::double, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])), lambda a, b: a + b) as score
            from own q join own d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20 order by all"""
    assert got == [tuple(r) for r in duckdb.sql(sql).fetchall()]


def test_pruning_visits_less_with_a_larger_factor():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.3 for c in centres])
    m2 = float((x * x).sum(1).max())
    order, nodes, bounds = vptree.build(x, m2)
    assert sorted(order) == list(range(len(x)))
    want = np.argsort(-(x[:10] @ x.T), axis=1)
    of, found = vptree.search(x[:10], x[order], nodes, bounds, m2, 10, 1.0)
    assert all(set(want[i, :10]) <= set(order[found[of == i]]) for i in range(10))


def test_searches_of_empty_tables(spark):
    df, _ = rows_of_vectors(spark, 6)
    assert knn_voronoi.search(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0
    assert knn_voronoi.search(df.where("vec_id = 10"), F.col("vec_id") % 10 == 0, 5).count() == 0
    with pytest.raises(OverflowError):
        knn_voronoi.search(spark.createDataFrame([(0, [1e9]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 1)


def test_best_takes_ties_by_id():
    rng = np.random.default_rng(7)
    s = rng.integers(0, 4, (50, 90)).astype(float)
    ids = rng.permutation(90)
    got = vectors.best(s, ids, 5)
    for r in range(50):
        want = sorted(range(90), key=lambda j: (-s[r, j], ids[j]))[:5]
        assert got[r].tolist() == want


# --- 2: fingerprints ---


def brute_fingerprint(t, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "É Ü x", "a b", "A  b\x0bc\x1cd", words(rng, 50), "x " * 5000] + [words(rng, rng.randrange(1, 40)) for _ in range(30)]
    df = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert simhash.fingerprints(df.limit(0)).count() == 0


def closure(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("most", [1024, 3])
def test_near_fingerprints_link_through_small_and_large_runs(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    ready(spark)
    rng = random.Random(most)
    fps = [rng.getrandbits(64) for _ in range(40)] + [0, 1, 3, 7, 2**64 - 1, 2**63]
    for f in fps[:12]:
        g = f
        for _ in range(rng.randrange(1, 25)):
            g ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                g ^= 1 << rng.randrange(64)
            fps.append(g)
    fps += [fps[5]] * 20
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(i * 3 + 1, s) for i, s in enumerate(signed)] + [(1, signed[0])], "doc_id long, fp long")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = {i * 3 + 1: c * 3 + 1 for i, c in closure(near, range(len(fps))).items()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == want


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(2)
    base = [words(rng, 60, 500) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i % 4]) for i in range(30)] + [(0, base[0]), (0, base[0]), (7, base[7]), (500, None), (501, ""), (None, "own " + words(rng, 30, 500))]
    df = documents(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, *range(12), 500]
    assert simhash.keep_one(df.limit(0)).count() == 0
    bare = simhash.keep_one(df.select("text", "doc_id"))
    assert bare.columns == ["text", "doc_id"] and bare.count() == 14


@pytest.mark.parametrize("hot", [4096, 2])
def test_copies_and_large_components_get_their_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "FEW", 1 if hot < 100 else 1024)
    rng = random.Random(3)
    base = words(rng, 300, 500).split(" ")
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 300, 5)]
    rows = [(i, near[i % len(near)]) for i in range(150)] + [(1000 + i, words(rng, 40, 500)) for i in range(30)] + [(2000, None)]
    marked = simhash.fingerprints(documents(spark, rows)).collect()
    fp = {r.doc_id: r.fp for r in marked}
    want, left = {}, set(fp)
    for d in sorted(fp):
        if d in left:
            group, queue = {d}, [d]
            while queue:
                x = queue.pop()
                more = {y for y in left - group if bin((fp[x] ^ fp[y]) & (2**64 - 1)).count("1") <= 2}
                group |= more
                queue += more
            left -= group
            want |= dict.fromkeys(group, d)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(simhash.fingerprints(documents(spark, rows))).collect()}
    assert got == want


def test_components_of_paths_stars_and_loops(spark):
    ready(spark)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, 300 + i) for i in range(40)] + [(5, 5)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a, b in edges] + [(b, a) for a, b in edges[:10]], "a long, b long")
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in components.components(df).collect()} == closure([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(df.limit(0)).count() == 0


# --- 3: lines ---


def edit(rng, s):
    i, kind = rng.randint(0, len(s)), rng.choice("idr")
    return s[:i] + rng.choice("abé") + s[i:] if kind == "i" else s[:i] + s[i + 1 :] if kind == "d" else s[:i] + rng.choice("abé") + s[i + 1 :]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < 5:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(rows):
    occ, out = [], defaultdict(list)
    for d, t in dict.fromkeys(rows):
        occ += [(-1 if d is None else d, n, s, (d, t)) for n, s in enumerate((t or "").split("\n")) if s.strip(" \t\r\x0b\x0c")]
    occ.sort(key=lambda x: x[:2])
    for i, (_, n, s, key) in enumerate(occ):
        if any(m == s or near(m, s) for _, _, m, _ in occ[:i]):
            out[key].append(n)
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_lines_go_if_an_earlier_one_is_equal_or_one_edit_away(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "FEW", 1 if hot < 100 else 1024)
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.choice([3, 4, 5, 6, 20, 300, 700, 1500]))) for _ in range(30)]
    rows = []
    for d in range(45):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                s = edit(rng, s)
            lines.append(s)
        rows.append((d, "\n".join(lines)))
    rows += [(None, "abcde\nzzzzzz"), (None, None), (5, rows[5][1]), (100, ""), (101, " \n\t\n"), (102, "\n" * 50)] + [(200 + i, "the hot line\nown " + str(i) * 9) for i in range(40)]
    df = documents(spark, rows)
    gone = line_dedup.removed(df)
    want = brute_lines(rows)
    got = Counter((r.doc_id, r.n_lines, r.removed) for r in line_dedup.report(df, gone).collect())
    assert got == Counter((d, len((t or "").split("\n")), ",".join(str(n + 1) for n in want[d, t])) for d, t in rows)
    cut = line_dedup.apply(df, gone)
    assert cut.schema == df.schema
    left = Counter((r.doc_id, r.text) for r in cut.collect())
    assert left == Counter((d, None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if n not in want[d, t])) for d, t in rows)
    assert line_dedup.removed(df.limit(0)).count() == 0


# --- 4: quality ---


def labelled_texts(seed, n=700):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = words(rng, rng.randrange(5, 80), 200)
        if not good:
            t = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " $$$ "), lambda t: " ".join(x for w in t.split()[:6] for x in [w] * 9)])(t)
        rows.append((i, t))
        labels.append((i, int(good), 0, "x"))
    return rows, labels


def test_quality_is_learned_without_the_held_out_rows(spark):
    rows, labels = labelled_texts(1)
    odd = [(10_000, None), (10_001, ""), (None, "w1 w2"), (3, rows[3][1])]
    df = documents(spark, rows + odd)
    l = spark.createDataFrame(labels + [(5, None, 0, "x"), (None, 1, 0, "x"), (7, labels[7][1], 0, "x")], "doc_id long, quality int, toxic int, text string")
    net = quality.train(df, l)
    out = {r.doc_id: (r.score, r.o) for r in quality.score(df, net).withColumn("o", quality.held_out(F.col("doc_id"))).collect()}
    truth = {i: q for i, q, _, _ in labels}
    held = [i for i in truth if out[i][1]]
    assert all(out[i][1] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth) and not out[None][1]
    assert np.mean([(out[i][0] >= 0.7) == truth[i] for i in held]) > 0.93
    assert all(0 <= s <= 1 for s, _ in out.values())
    # labels of held-out rows change nothing
    flipped = l.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(df, quality.train(df, flipped)).collect()}
    assert all(abs(again[i] - out[i][0]) < 1e-9 for i in truth)
    # what is read from slots is what is read from texts
    slots = quality.slotted(df)
    by_slots = sorted((str(r.doc_id), r.score) for r in quality.score(slots, quality.train(slots, l)).collect())
    by_texts = sorted((str(r.doc_id), r.score) for r in quality.score(df, net).collect())
    assert [d for d, _ in by_slots] == [d for d, _ in by_texts] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(by_slots, by_texts))
    kept = quality.accept(df, net)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {i for i, (s, _) in out.items() if s >= 0.7}


def test_quality_without_labels_or_rows(spark):
    df = documents(spark, [(i, f"a b {i}") for i in range(9)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.train(df, none)
    assert {round(r.score, 6) for r in quality.score(df, net).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score(df, quality.train(df, ones)).collect())
    assert quality.score(df.limit(0), quality.train(df.limit(0), none)).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-3 * x[:, 0]))
    y = (rng.random(4000) < p).astype(int)
    net = quality.fit(x[:3000], y[:3000], np.zeros((1, 1)))
    got = net.probabilities(x[3000:])
    for low in (0.1, 0.4, 0.7):
        some = (got >= low) & (got < low + 0.2)
        assert abs(got[some].mean() - y[3000:][some].mean()) < 0.12


# --- 6: mixing ---


def brute_targets(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[f] for f in free) for s in free} if free else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def mixed_rows(rng, n=3000):
    rows = [(i, words(rng, rng.randrange(0, 40)), rng.choice(["a", "b", "b", "b", "ä", "z", None])) for i in range(n)]
    return rows + [(i, "tiny", "few") for i in range(n, n + 3)] + [(n + 10, None, "empty"), (n + 11, "", "empty"), (n + 12, " \t ", "a"), (None, "x y", "a"), (3, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("group", [20_000, 50])
def test_mix_meets_its_targets(spark, group, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = mixed_rows(random.Random(1))
    df = documents(spark, rows)
    sizes = mixing.sized(df)
    out = mixing.report(sizes, mixing.mix(sizes)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, count(t)) for d, t, _ in rows)
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += count(t)
    want = brute_targets(by)
    source = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    unit = Counter()
    for d, t, s in rows:
        unit[d, s] += count(t)
    largest = {s: max(n for (_, x), n in unit.items() if x == s) for s in by}
    assert all(abs(taken[s] - want[s]) < max(1, largest[s]) for s in by), (dict(taken), want)
    again = mixing.report(sizes, mixing.mix(mixing.sized(df.repartition(5)))).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    copies = Counter(r.doc_id for r in mixing.apply(df, mixing.mix(sizes)).collect())
    n_rows = Counter(d for d, _, _ in rows)
    assert all(copies[r.doc_id] * r.size == r.taken * n_rows[r.doc_id] for r in out if r.size)
    assert mixing.apply(df, mixing.mix(sizes)).schema == df.schema
    none = mixing.sized(df.limit(0))
    assert mixing.report(none, mixing.mix(none)).count() == 0


def test_pivotal_rounding_keeps_expectations():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 50, 30).astype(float)
    total = np.zeros(30)
    for _ in range(4000):
        f = mixing._pivot(np.full(30, 0.37), size, rng.random(30))
        assert abs((f * size).sum() - 0.37 * size.sum()) < 1e-6 and ((f == 0) | (f == 1)).sum() >= 29
        total += f
    assert np.abs(total / 4000 - 0.37).max() < 0.05


# --- 7: bytes and pairs ---


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(open(path, "rb").read())
    return path, codec, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_codec_equals_the_library(vocabulary):
    _, codec, theirs = vocabulary
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "É", "1", "²", "٣", "!", "　", "\x1c", "\x85", "漢", "😀", "́", "ab c", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", "a" * 5000, " " * 3000, "'" * 100, "abc" * 2000]
    texts += [f"a{chr(c)}1{chr(c)}b {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    ids, offsets = codec.encode(texts)
    for t, i, o in zip(texts, ids, offsets):
        assert i.tolist() == theirs.encode_ordinary(t), t
        assert codec.decode(i) == t.encode()
        assert codec.decode_slices(i, o) == [(a, t[a:b].encode()) for a, b in zip(sorted(set(o.tolist())), [*sorted(set(o.tolist()))[1:], len(t)])]
        assert len(o) == len(i) and all(codec.decode(i[o == a]) == t[a:b].encode() for a, b in zip(sorted(set(o.tolist())), [*sorted(set(o.tolist()))[1:], len(t)]))


def test_bpe_over_a_table(spark, vocabulary):
    path, codec, theirs = vocabulary
    rows = [(0, None), (1, ""), (None, "it's x"), (2, "word " * 60_000), (2, "a"), (3, "ÉÉ 12")]
    df = documents(spark, rows)
    got = Counter(map(tuple, bpe.round_trip(df, path).collect()))
    want = Counter()
    for d, t in rows:
        i = np.array(theirs.encode_ordinary(t or ""), "<u4")
        want[d, len(i), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(bpe.slices([t or ""])[0])] += 1
    assert got == want
    encoded = bpe.encode(df, path)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(encoded, path).collect()) == Counter((d, (t or "").encode()) for d, t in rows)
    assert bpe.round_trip(df.limit(0), path).count() == 0 and bpe.encode(df.limit(0), path).count() == 0


# --- 8: secrets ---

ASSIGN = re.compile(secret_scan.ASSIGN, re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    texts = [None, "", "password: token: abcdefgh", "TOKEN='" + key(12) + "' é api_key = \"" + key(9), "secret=abc", "AKIA" + "A1" * 9, "AKIAAKIA" + "Z" * 12, "x" + "ab12" * 8 + "g", "apikey:=abcdefg"]
    texts += [words(rng, 20) + " token = " + key(20) + " " + words(rng, 9) + " " + "".join(rng.choice("0123456789abcdef") for _ in range(30)) for _ in range(30)]
    spoken = lambda: "".join(rng.choice(["con", "fi", "gu", "ra", "tion", "in", "ter", "na", "al", "ly", "ment", "er", "re", "_of_"]) for _ in range(rng.randrange(4, 9)))
    texts += ["internationalization configuration_of_everything " + " ".join(spoken() for _ in range(30)) for _ in range(30)] + ["stray " + key(40) + " end", "pässword token=" + "x" * 30_000, "token=abcdef " * 300]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "token=abcdefgh")]
    df = documents(spark, rows)
    spanned = secret_scan.spans(df)
    ratios = secret_scan.train(secret_scan.labelled_samples(df, spanned))
    by = defaultdict(list)
    for r in secret_scan.report(secret_scan.scan(spanned, ratios)).collect():
        by[r.doc_id].append(r)
    for d, t in rows:
        want = base_spans(t or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        for r in by[d]:
            assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (d, text, r.spans)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
            assert [x for x in r.spans.split(",") if x and not x.startswith("markov")] == [x for x in text.split(",") if x]
    stray = next(i for i, t in enumerate(texts) if t and t.startswith("stray"))
    assert by[stray][0].spans == "markov:6:46"
    assert not any("markov" in r.spans for i, t in enumerate(texts) if t and t.startswith("international") for r in by[i])
    assert all(len(r.spans.split(",")) == 300 for r in by[texts.index("token=abcdef " * 300)])
    assert len(by[3]) == 2 and secret_scan.train(spark.createDataFrame([("abc", True)], "token string, random boolean")) == [0.0] * secret_scan.SIDE**2
    assert secret_scan.report(secret_scan.scan(secret_scan.spans(df.limit(0)), ratios)).count() == 0


def test_base_rules_equal_sql(spark):
    import duckdb

    table = "/root/testdata/sf0.01/documents.parquet"
    base = F.col("base")
    found = secret_scan.spans(spark.read.parquet(table)).select("doc_id", *[F.size(F.filter(base, lambda x: x["k"] == k)).alias(f"n{k}") for k in range(3)], F.transform(base, lambda x: x["s"]).alias("s"))
    got = sorted((r.doc_id, r.n0, r.n1, r.n2, sorted(r.s)) for r in found.collect())
    sql = r"""
        select doc_id, len(a), len(b), len(c), list_sort(a || b || c) from (
            select doc_id,
                list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0),
                    lambda m: length(regexp_extract(m, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6) as a,
                list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+', 0), lambda m: length(m) >= 20) as b,
                list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+', 0), lambda m: length(m) >= 24) as c
            from '%s') order by doc_id""" % table
    assert got == [(*r[:4], sorted(r[4])) for r in duckdb.sql(sql).fetchall()]
    assert sum(sum(r[1:4]) for r in got) > 10


def test_models_tell_secrets_from_ordinary_tokens(spark):
    """Precision and recall on planted tokens, none of which is in a base span."""
    rng = random.Random(8)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    secrets = [of(alnum, rng.randrange(16, 64)) for _ in range(60)] + [of(alnum + "+/", 40) for _ in range(60)] + [of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32) for _ in range(40)]
    secrets += [of(alnum[:26] + "0123456789", rng.randrange(20, 40)) for _ in range(40)] + [of(alnum + "_-", 43) for _ in range(40)]
    syllables = ["con", "fi", "gu", "ra", "tion", "in", "ter", "na", "al", "ly", "ment", "er", "re", "ver", "ung", "keit", "el", "os", "ado", "que"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    ordinary = [of("0123456789", rng.randrange(16, 30)) for _ in range(60)] + ["_".join(word() for _ in range(6)) for _ in range(60)] + ["".join(word().title() for _ in range(8)) for _ in range(60)]
    ordinary += ["/usr/" + "/".join(word() for _ in range(6)) for _ in range(60)] + [f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}-{rng.randrange(10, 60)}" for _ in range(60)]
    ordinary += ["-".join(word() for _ in range(6)) for _ in range(60)] + ["_".join(word() for _ in range(6)).upper() for _ in range(30)] + ["".join(word() for _ in range(9)).upper() for _ in range(30)] + [c * n for c in "=-_/+" for n in (16, 40, 80)] + ["".join(word() for _ in range(9)) for _ in range(60)]
    ordinary = [t for t in ordinary if len(t) >= 16 and not re.search(r"[0-9a-f]{24,}", t)]
    secrets = [t for t in secrets if not re.search(r"[0-9a-f]{24,}", t)]
    prose = [" ".join(word() for _ in range(60)) for _ in range(200)]
    rows = [(i, f"{word()} {t} {word()}") for i, t in enumerate(secrets + ordinary)] + [(10_000 + i, t) for i, t in enumerate(prose)]
    df = documents(spark, rows)
    training = documents(spark, [(i, t) for i, t in enumerate(prose)])
    ratios = secret_scan.train(secret_scan.labelled_samples(training, secret_scan.spans(training)))
    found = {r.doc_id for r in secret_scan.report(secret_scan.scan(secret_scan.spans(df), ratios)).collect() if r.spans}
    hits = sum(i in found for i in range(len(secrets)))
    assert hits / len(secrets) >= 0.95, hits / len(secrets)
    assert hits / len(found) >= 0.95, [rows[i][1] for i in found if i >= len(secrets)][:20]


def test_tokens_beside_base_spans_and_texts_of_many_tokens(spark):
    rng = random.Random(6)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+") for _ in range(40))
    access = "AKIA" + "Q7" * 8
    many = " ".join("é" + "".join(rng.choice("klmnopqrst") for _ in range(17)) + (" token=abcdefg" if i % 4 == 0 else "") for i in range(32_000))
    df = documents(spark, [(1, f"{access}/{key}"), (2, many), (3, "password=short tail" + "z" * 20)])
    by = {r.doc_id: r for r in secret_scan.spans(df).collect()}
    assert [(x["start"], x["end"], x["s"]) for x in by[1].tokens] == [(20, 61, "/" + key)]
    assert [(x["start"], x["end"], x["s"]) for x in by[2].tokens] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"[k-t]{17}", many)]
    assert [(x["start"], x["end"]) for x in by[2].base] == [m.span() for m in re.finditer(r"token=abcdefg", many)]
    assert [x["s"] for x in by[3].tokens] == ["tail" + "z" * 20]


# --- 9: chat ---


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a\\", "\\<|", "<\\|", "<\\n|", "", None, "<|", "x\n<|im_end|>\n", "<\\<|"]
    rows = []
    for c in range(12):
        rows += [(c, t, ["user", "assistant", "system", None, "as\nx<|"][(t + c) % 5] if c < 8 else "user", said[(t * 3 + c) % len(said)]) for t in range(c)]
    rows += [(1, 0, "assistant", "again")] * 2 + [(None, 1, "assistant", "n"), (50, None, "user", "first"), (50, 2, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("t", "turns", "example", "formatted", "n")})
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat.expand(df).collect()
    assert sum(e.loss_start is not None for e in examples) == sum(r == "assistant" for _, _, r, _ in rows)
    assert all(e.formatted.endswith(chat.CLOSE) and (e.loss_end is None or e.loss_end == len(e.formatted) - len(chat.CLOSE)) for e in examples)
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


# --- 10: repeated passages ---


def brute_repeats(rows, length=100):
    docs = sorted({(-(2**63) if d is None else d, t or "") for d, t in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for d, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        n = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out[d, t] = (len(b), int(gone.sum()), n, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("most,shard,size", [(8_192, 1 << 16, 8_192), (3, 900, 32), (3, 200, 8)])
def test_repeated_passages_go(spark, monkeypatch, most, shard, size):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "BIN", size)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_000 if size < 100 else 1 << 19)
    rng = random.Random(most)
    base = ["".join(rng.choice("abé") for _ in range(500)) for _ in range(4)]
    rows = []
    for d in range(40):
        t = ""
        for _ in range(rng.randrange(4)):
            i = rng.randrange(350)
            t += rng.choice(base)[i : i + rng.randrange(20, 260)] + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))
        rows.append((d * 2, t))
    hot = "".join(rng.choice("stuv") for _ in range(150))
    rows += [(200 + i, "".join(rng.choice("klm") for _ in range(50)) + hot + "".join(rng.choice("klm") for _ in range(50))) for i in range(30)]
    rows += [(400, "x" * 700), (401, "xy" * 400), (402, None), (403, ""), (404, "é" * 49), (None, hot), (5, rows[3][1]), (200, rows[40][1]), (405, rows[3][1] + rows[3][1])]
    df = documents(spark, rows)
    got = Counter(map(tuple, suffix_dedup.report(df, suffix_dedup.spans(df)).collect()))
    want = brute_repeats(rows)
    assert got == Counter((d, *want[-(2**63) if d is None else d, t or ""]) for d, t in rows)
    assert suffix_dedup.report(df.limit(0), suffix_dedup.spans(df.limit(0))).count() == 0


@pytest.mark.parametrize("shard", [1, 7, 60])
def test_merge_finds_the_intervals_of_equal_strings(shard):
    rng = random.Random(shard)
    texts = [bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randrange(6, 40))) for _ in range(60)]
    texts += [texts[3], texts[3][2:], b"a" * 30, b"a" * 30, b"\xff" * 9]
    merge = suffix_dedup.Merge([suffix_dedup.transform(texts[i : i + shard]) for i in range(0, len(texts), shard)])
    size = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(size) - size
    at = [(i, k, n) for i, t in enumerate(texts) for k in range(len(t) - 5) for n in {6, len(t) - k}]
    every = [texts[i][k : k + n] for i, k, n in at]
    found, of = merge.refine(np.array([first[i] + k + n for i, k, n in at]), np.array([n for _, _, n in at]))
    count = Counter(every)
    assert sorted(found.tolist()) == [i for i, w in enumerate(every) if count[w] > 1]
    assert all((every[x] == every[y]) == (a == b) for x, y, a, b in zip(found, found[1:], of, of[1:]))
    assert len(set(of.tolist())) == sum(n > 1 for n in count.values())


def test_transform_is_that_of_the_sorted_suffixes():
    texts = [b"banana", b"bandana", b"cabana", b"\xff\xfe\xff\xfe\xff\xfe\xff\xfe\xff\xfe"]
    shard = suffix_dedup.transform(texts)
    every = sorted((s[k:], i, k) for i, s in enumerate(texts) for k in range(len(s) + 1))
    order = {(i, k): n for n, (_, i, k) in enumerate(every)}
    # equal suffixes may stand in any order; the byte before the first sentinel of all is the last sentinel
    assert [x[0] for x in every] == [sorted(x[0] for x in every)[n] for n in range(len(every))]
    first = np.cumsum([0] + [len(s) + 1 for s in texts])
    by = {int(shard.rank[first[i] + k]): (i, k) for i, k in order}
    assert [texts[by[n][0]][by[n][1] :] for n in range(len(every))] == [x[0] for x in every]
    for n, (i, k) in by.items():
        assert shard.before[n] == (texts[i][k - 1] + 1 if k else 0)
        assert not k or by[int(shard.longer[n])] == (i, k - 1)


# --- shared ---


def test_bitmap_loses_no_key(spark):
    ready(spark)
    keys = spark.range(500).select((F.col("id") * 7919 - 1000).alias("k"))
    every = spark.range(5000).select((F.col("id") - 1000).alias("k"))
    out = marked(every, F.xxhash64("k"), bitmap(keys, F.xxhash64("k")))
    wanted = {r.k for r in keys.collect()}
    rows = out.collect()
    assert all(r.hit for r in rows if r.k in wanted) and sum(r.hit for r in rows) < 600
    assert not any(r.hit for r in marked(every, F.xxhash64("k"), bitmap(keys.limit(0), F.xxhash64("k"))).collect())
