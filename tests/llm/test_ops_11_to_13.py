"""Operators 11 to 13 on small tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from llm import manifest, ranks, registry, sharding, whitening


def near(a, b, most=1e-9):
    return abs(a - b) <= most * max(1.0, abs(a), abs(b))


VECTORS = [
    (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (3, [1.0, 2.0, -0.001]), (4, [3.0, 0.0, 0.0]), (5, [-1.5, 0.7, 0.3]), (6, None), (7, [1.0, None, 2.0]),
    (8, [float("nan"), 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1.0]), (11, []), (None, [0.1, 0.2, 0.3]), (1, [0.5, -0.25, 1.0]), (12, [0.0, 0.0, 0.0]), (13, [1e30, 0.0, 0.0]),
]


def brute_whitening(rows, top=4):
    """(n, S, eigenvalues, vectors) of the distinct vectors of (id, x), by the covariance."""
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    mean = fit.mean(axis=0)
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return len(fit), fit.sum(axis=0), e[::-1], v.T[::-1], mean


def check_whitening(got, rows, top=4):
    n, s, e, v, mean = brute_whitening(rows)
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert set(by) == set(range(1, min(top, len(e)) + 1)) and all(len(b) == len(rows) for b in by.values())
    for k, found in by.items():
        sign = {}
        want = defaultdict(list)
        for i, x in rows:
            want[i].append((sum((n * a - int(b)) ** 2 for a, b in zip(x, s)), (np.array(x, float) - mean) @ v[k - 1] / math.sqrt(e[k - 1])))
        have = defaultdict(list)
        for r in found:
            have[r.vec_id].append((r.deviation, r.whitened))
            assert r.n == n and near(r.explained, e[k - 1] / e.sum()) and r.identity_error < 1e-9
        flat = [(a, b) for i in want for a, b in zip(sorted(want[i]), sorted(have[i])) if len({d for d, _ in want[i]}) == len(want[i]) or True]
        turn = 1 if sum(a[1] * b[1] for a, b in flat) > 0 else -1
        assert all(a[0] == b[0] and near(a[1], turn * b[1], 1e-7) for a, b in flat), sign


def test_whitening(spark):
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in VECTORS], "vec_id long, embedding array<double>, n int, x string")
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in VECTORS if v and len(v) == 3 and all(c is not None and math.isfinite(c) and abs(c) < 1e15 for c in v)]
    check_whitening(whitening.whiten(df).collect(), rows)
    for none in (df.limit(0), df.filter("vec_id IN (6, 7, 8)"), df.filter("vec_id IN (1, 2)")):
        assert whitening.whiten(none).collect() == [] and whitening.whiten(none).columns == whitening.whiten(df).columns
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0, 0.0, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_whitening_over_many_partitions_with_hot_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 12)) * np.logspace(2, -1, 12) @ np.linalg.qr(rng.standard_normal((12, 12)))[0] + 1000
    x[:300] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(40)
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in enumerate(x)]
    check_whitening(whitening.whiten(df).collect(), rows)


def test_jacobi_keeps_the_digits_of_small_deviations():
    """Columns of very different size: the smallest singular value comes out to nearly all digits, which the covariance would lose."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((40, 6)))[0]
    sizes = np.array([1e12, 1e8, 1e3, 1.0, 1e-4, 1e-9])
    found, v = whitening.jacobi(q * sizes)
    assert np.allclose(found / sizes, 1, rtol=1e-12) and np.allclose(v @ v.T, np.eye(6), atol=1e-13)
    a = rng.standard_normal((50, 7))
    found, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(found, np.linalg.svd(a, compute_uv=False), rtol=1e-13)
    assert np.allclose(np.abs(np.einsum("ij,ij->i", v, np.linalg.svd(a)[2])), 1, atol=1e-12)


def test_exact_deviation():
    rng = random.Random(1)
    for most in (1 << 10, 1 << 30, 1 << 40, 1 << 61):
        x = np.array([[rng.randrange(-most, most) for _ in range(5)] for _ in range(7)], np.int64)
        sums = [sum(c) for c in x.T.tolist()]
        want = [sum((7 * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
        assert whitening.exact_deviation(whitening.scaled_out(x, 7, sums)) == [w if w < 2**63 else None for w in want]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, siblings of each leaf, level by level) of a list of hashes."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, p in enumerate(at):
            run = runs[p // 8]
            paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
        nodes, at = [h(*r) for r in runs], [p // 8 for p in at]
    return nodes[0], paths


def brute_manifest(docs):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for d, text, lang, source, n in docs:
        claim = lower(text) if text is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else text
        by[lang].append(((d is not None, d or 0), leaf(d, source, lang, n, text), leaf(d, source, lang, n, claim), d))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([m[1] for m in sorted(by[x], key=lambda m: m[:2])]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for i, x in enumerate(langs):
        for m, path in zip(sorted(by[x], key=lambda m: m[:2]), trees[x][1]):
            folded, proof = m[2], ""
            for left, right in path + tops[i]:
                folded, proof = h(*left, folded, *right), proof + "".join(left + right)
            out.append((m[3], m[1], trees[x][0], root, h(proof), folded, folded == root))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [1, 700, 4700])
def test_manifest(spark, n):
    rng = random.Random(n)
    docs = [(i, rng.choice(["Some Text", "low", "É ß A", "", None]), rng.choice(["en", "en", "en", "de", None, "é", ""]), rng.choice(["s", None]), rng.choice([3, None])) for i in range(n)]
    if n > 9:
        docs += [(None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (5, "Twice", "en", "s", 1), docs[7], (3, "B " * 20000, "xx", None, 4)]
    if n == 4700:
        docs = [(d, t, "en" if x != "é" else x, s, c) for d, t, x, s, c in docs]
    df = spark.createDataFrame([(*d, "clash", 0) for d in docs], DOCS + ", leaf string, row int").repartition(7)
    got = manifest.proofs(manifest.manifest(df, {"text": manifest.tampered_text()})).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(docs)))
    assert n == 1 or {r.verified for r in got} == {True, False}


def test_manifest_of_many_languages_and_none(spark):
    docs = [(i, "T", f"l{i:03d}", "s", 1) for i in range(100)]
    made = manifest.manifest(spark.createDataFrame(docs, DOCS))
    assert sorted(map(repr, map(tuple, manifest.proofs(made).collect()))) == sorted(repr((*r[:5], r[3], True)) for r in brute_manifest(docs))
    none = manifest.manifest(spark.createDataFrame([], DOCS))
    assert none.root is None and manifest.proofs(none).collect() == []


def brute_cuts(sizes, shards):
    def filled(capacity):
        ends, used = [], 0
        for i, s in enumerate(sizes):
            if used + s > capacity or not ends:
                ends.append(i)
                used = 0
            used += s
        return ends

    return next(c for c in range(max(sizes), sum(sizes) + 1) if len(filled(c)) <= shards)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sharding(spark, seed):
    rng = random.Random(seed)
    docs = [(rng.randrange(400), rng.choice(["é" * rng.randrange(90), f"t{rng.randrange(60)}", "hot text " * 3, None, ""])) for _ in range(600)] + [(None, "x"), (None, "x"), (1, "y " * 30000 if seed == 1 else "y")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, shard string, slot int").repartition(9)
    got = sharding.assign(df, 5 if seed == 2 else 16).collect()
    assert sorted(repr((r.doc_id, r.size, r.text_crc32, r.digest)) for r in got) == sorted(repr((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), h(t or ""))) for d, t in docs)
    groups, where = defaultdict(int), defaultdict(set)
    for r in got:
        groups[r.digest] += r.size
        where[r.digest].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    order = sorted(groups)
    assert [min(where[d]) for d in order] == sorted(min(where[d]) for d in order)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert max(sum(r.size for r in s) for s in shards.values()) == brute_cuts([groups[d] for d in order], 5 if seed == 2 else 16)
    for s in shards.values():
        s.sort(key=lambda r: r.slot)
        assert [r.slot for r in s] == list(range(len(s)))
        assert [(r.digest, r.doc_id is not None, r.doc_id or 0) for r in s] == sorted((r.digest, r.doc_id is not None, r.doc_id or 0) for r in s)


def test_sharding_of_few_groups_and_none(spark):
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "doc_id long, text string")
    got = sharding.assign(few).collect()
    assert len({r.shard for r in got}) == 2 and max(r.shard for r in got) <= 1
    assert sharding.assign(few.limit(0)).collect() == [] and {r.shard for r in sharding.assign(few, 1).collect()} == {0}


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 40}", "k") for i in range(200)], "doc_id long, text string, shard string")
    cuts = sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r[0] for r in back.select("__shard").distinct().collect()} == {0, 1, 2, 3} and back.drop("__shard").columns == df.columns
    sizes = [r[0] for r in back.groupBy("__shard").agg({"text": "count"}).collect()]
    assert len(cuts.digests) == 3 and len(sizes) == 4


def test_ranked(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "hot", "hot", None]), rng.randrange(30), i) for i in range(500)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, o int, row long").repartition(11), ["g"], ["o", "row"]).collect()
    for g in ("a", "hot", None):
        mine = sorted((o, i) for x, o, i in rows if x == g)
        assert [(r.o, r.row) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == mine and {r.group_rows for r in got if r.g == g} == {len(mine)}


@pytest.mark.parametrize("name", ["op12_manifest", "op13_sharding"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(registry.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_op11_on_the_given_vectors(spark):
    got = registry.QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check_whitening(got, [(r.vec_id, [math.floor(256 * c) for c in r.embedding]) for r in vectors])
