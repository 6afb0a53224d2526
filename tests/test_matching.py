"""Matching against brute force: every pair scored, in plain Python."""

import random

import pytest

from grantlens import vocab
from grantlens.functions.similarity import ratio_of, token_set_of, token_sort_of
from grantlens.functions.text import core_tokens, normalized, with_alias
from grantlens.operators import entity_match, nearest_text
from grantlens.operators.entity_match import match_entities, token_set_pairs
from grantlens.operators.matching import fuzzy_pairs, match_targets
from grantlens.plans import alignment
from grantlens.queries import QUERIES
from grantlens.queries.core import target_list, written_targets
from grantlens.sources import testbed
from grantlens.operators.similar_pairs import chunks, grams, salted_join, sharing_chunks, similar_pairs
from pyspark.sql import functions as F

WORDS = "hope river grace valley north south family smith jones harbor light youth community global trust fund legacy".split()


def spoiled(rng, name):
    kind = rng.randrange(10)
    words = name.split()
    if kind == 0:
        at = rng.randrange(len(name))
        return name[:at] + rng.choice("abcxyz") * rng.randrange(2) + name[at + 1 :]
    if kind == 1:
        rng.shuffle(words)
    elif kind == 2:
        words += rng.sample(WORDS, 3)
    elif kind == 3:
        words = words[: max(1, len(words) - 1)]
    elif kind == 4:
        return f"The {name}, Inc. dba other"
    elif kind == 5:
        words[-1] = "zzzz" + words[-1][:2]
    elif kind == 6:  # a misspelt token that sorts to another place
        i = max(range(len(words)), key=lambda i: len(words[i]))
        words[i] = rng.choice("az") + words[i][1:]
    elif kind == 7:
        at = rng.randrange(len(words))
        words[at : at + 2] = ["".join(words[at : at + 2])]
    elif kind == 8:
        words[rng.randrange(len(words))] += "s"
        rng.shuffle(words)
    return " ".join(words)


def first_near(scored, city, state):
    """The first of the nearest, given in order of score, then ein."""
    scored = sorted(scored, key=lambda x: (-x[1], x[0]["ein"]))
    pool = [x for x in scored if x[0]["state"].lower().strip() == state] or scored
    return ([x for x in pool if x[0]["city"].lower().strip() == city] or pool)[0]


def brute(name, city, state, norm, core, entities):
    city, state = (city or "").lower().strip(), (state or "").lower().strip()
    passes = [(1, lambda e: 100 if e["norm"] == norm else 0, 100), (3, lambda e: ratio_of(norm, e["norm"]), 90), (4, lambda e: token_sort_of(norm, e["norm"]), 90), (5, lambda e: token_set_of(norm, e["norm"]), 95)]
    for number, score, least in passes:
        hits = [(e, s) for e in entities if (s := score(e)) >= least]
        if hits:
            e, s = first_near(hits, city, state)
            return e["ein"], s, number
    hits = [(e, token_set_of(norm, e["norm"])) for e in entities if len(core) >= 4 and " ".join(e["norm"].split()[:2]) == core]
    if hits:
        e, s = first_near(hits, city, state)
        if s >= 80:
            return e["ein"], s, 6
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_entity_match(spark, seed):
    rng = random.Random(seed)
    places = ["Austin", " boston ", "", None, "Reno"]
    entities = [(f"{i:09d}", " ".join(rng.sample(WORDS, rng.randrange(1, 5))), rng.choice(places), rng.choice(["TX", "ma", "NV", None])) for i in range(150)]
    names = sorted({(spoiled(rng, rng.choice(entities)[1]), rng.choice(["austin", "Boston", "", None]), rng.choice(["tx", "MA", None])) for _ in range(250)}, key=repr)
    names += [("Foundation", "", ""), ("", "", ""), (None, "x", "y"), (rng.choice(list(vocab.ALIASES)), "", "")]
    df = spark.createDataFrame(names, "name string, city string, state string")
    to = spark.createDataFrame(entities, "ein string, name string, city string, state string")
    norms = {(r.name, r.city, r.state): (r.norm, r.core) for r in df.select("*", normalized(with_alias(F.col("name"))).alias("norm"), core_tokens(F.col("name"), 2).alias("core")).collect()}
    known = [dict(ein=r.ein, norm=r.norm, city=r.city or "", state=r.state or "") for r in to.withColumn("norm", normalized(F.col("name"))).collect()]
    want = {}
    for n, c, s in names:
        norm, core = norms[n, c, s]
        if hit := brute(n, c, s, norm, core, known):
            want[n, c or "", s or ""] = hit
    matched, report = match_entities(df, to)
    got = {(r.name, r.city, r.state): (r.ein, r.score, r["pass"]) for r in matched.collect()}
    assert len({p for *_, p in want.values()}) >= 4
    assert got == want
    missed = {(n, c or "", s or "") for n, c, s in names} - set(want)
    best = {}
    for n, c, t in missed:
        norm = next(v for (a, b, d), (v, _) in norms.items() if (a, b or "", d or "") == (n, c, t))
        score, ein = min((-ratio_of(norm, e["norm"]), e["ein"]) for e in known)
        best[n, c, t] = (dict((e[0], e[1]) for e in entities)[ein] if score else "", -score)
    assert {(r.name, r.city, r.state): (r.best_candidate, r.best_score) for r in report.collect()} == best
    empty = match_entities(df, to.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == len({(n, c or "", s or "") for n, c, s in names}) and match_entities(df.limit(0), to)[0].count() == 0


def brute_targets(spark, names):
    """name: (target, score) of those that reach 90, every target scored."""
    df = spark.createDataFrame([(n,) for n in names], "name string")
    norms = {r.name: r.norm for r in df.withColumn("norm", normalized(with_alias(F.col("name")))).collect()}
    listed = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(vocab.TARGETS)], "i int, t string").withColumn("n", normalized(F.col("t"))).orderBy("i").collect()]
    want = {}
    for n in names:
        if norms[n]:
            scores = [100 if norms[n] == t else max(ratio_of(norms[n], t), token_sort_of(norms[n], t), token_set_of(norms[n], t)) for t in listed]
            exact = [i for i, t in enumerate(listed) if t == norms[n]]
            best = exact[0] if exact else scores.index(max(scores))
            if scores[best] >= 90:
                want[n] = (vocab.TARGETS[best], scores[best])
    return want


def test_match_targets(spark):
    rng = random.Random(3)
    names = sorted({spoiled(rng, rng.choice(vocab.TARGETS)) for _ in range(200)} | {"CRU", "Cru Inc", "the", "map intl"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = brute_targets(spark, names)
    got = match_targets(df, spark.createDataFrame(list(enumerate(vocab.TARGETS)), "ordinal int, canonical string"))
    assert {r.name: (r.canonical, r.score) for r in got.collect()} == want and len(want) > 50


def test_matched_grantee_points(spark):
    """Grants to targets as written, scored target by target and giver by giver in plain Python."""
    grants = written_targets(testbed.grants(spark, "/root/testdata/sf0.001")).select("id", "ein", "grantee_name", "amount", "tax_year")
    rows = grants.orderBy("id").collect()
    target = {n: t for n, (t, _) in brute_targets(spark, sorted({r.grantee_name for r in rows})).items()}
    by_ein = {}
    # ids may repeat: of one id the names decide
    for r in sorted(rows, key=lambda r: (r.id, target.get(r.grantee_name, ""))):
        if r.grantee_name in target:
            best = by_ein.setdefault(r.ein, {})
            t = target[r.grantee_name]
            best[t] = max(best.get(t, 0), r.amount * (1.2 if r.tax_year >= 1997 else 1.0))
    steps = [12, 8, 6, 4]
    want = {e: (min(sum(steps[:len(b)]) + 2 * max(len(b) - 4, 0) + min(2 * sum(m > 25000 for m in b.values()), 5), 35), "; ".join(b), len(b)) for e, b in by_ein.items()}
    got = QUERIES["matched_grantee_points"](spark, "/root/testdata/sf0.001").collect()
    assert {r.ein: (r.grantee_points, r.grantee_matches, r.grantee_match_count) for r in got} == want and len(got) == len(want) > 20
    assert len({r.grantee_match_count for r in got}) > 2
    none = alignment.matched_grants(grants.limit(0), target_list(spark))
    assert none.count() == 0


def test_fuzzy_pairs(spark):
    rng = random.Random(4)
    right = sorted({" ".join(rng.sample(WORDS[:14], rng.randrange(1, 5))) for _ in range(120)})
    left = sorted({spoiled(rng, rng.choice(right)) for _ in range(150)})
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    norm = {r.t: r.n for r in one(left + right, "t").withColumn("n", normalized(F.col("t"))).collect()}
    want = {}
    for a in left:
        exact = [b for b in right if norm[a] == norm[b]]
        scored = [(-100, min(exact))] if exact else sorted((-max(ratio_of(norm[a], norm[b]), token_sort_of(norm[a], norm[b])), b) for b in right)
        if scored[0][0] <= -90:
            want[a] = (scored[0][1], -scored[0][0])
    assert {r.name: (r.candidate, r.score) for r in fuzzy_pairs(one(left, "name"), one(right, "candidate")).collect()} == want and len(want) > 30


def brute_ratio(a, b):
    """By the table of common subsequences."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return round(200 * row[-1] / (len(a) + len(b))) if a or b else 100


def test_similarities():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(12))) for _ in "12")
        assert ratio_of(a, b) == brute_ratio(a, b)
        x, y = set(a.split()), set(b.split())
        if x and y:
            both, p, q = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
            want = 100 if both and not (p and q) else max(brute_ratio(f"{both} {p}".strip(), f"{both} {q}".strip()), *((brute_ratio(both, f"{both} {o}") for o in (p, q)) if both else (0,)))
            assert token_set_of(a, b) == want


LONG = "international northern presbyterian mission fellowship outreach education westminster evangelical".split()


def misspelt(rng, name):
    """One to three letters put in, left out or replaced, sometimes a space, and tokens in another order."""
    for _ in range(rng.randrange(1, 4)):
        at = rng.randrange(len(name))
        name = name[:at] + rng.choice(["", "q", "e", " "]) + name[at + rng.randrange(2) :]
    words = name.split()
    if rng.random() < 0.5:
        rng.shuffle(words)
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_token_set_pairs_are_all_there(spark, seed):
    rng = random.Random(seed)
    right = sorted({" ".join(rng.choices(WORDS + LONG, k=rng.randrange(1, 8))) for _ in range(150)})
    left = sorted({misspelt(rng, rng.choice(right)) for _ in range(200)} | set(rng.sample(right, 9)) - {""})
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {(r.norm, r.to_norm) for r in token_set_pairs(one(left, "norm"), one(right, "to_norm")).collect()}
    want = {(a, b) for a in left for b in right if token_set_of(a, b) >= 95}
    assert want <= got and len(want) > 60
    far = {(a, b) for a, b in want if token_sort_of(a, b) < 90 and not (set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split()))}
    assert far, "no pair tests what sorting hides"


@pytest.mark.parametrize("least", [0.7, 0.8, 0.895, 0.945])
def test_similar_pairs_are_all_there(spark, least):
    rng = random.Random(int(least * 1000))
    right = sorted({" ".join(rng.choices(WORDS + LONG, k=rng.randrange(1, 7))) for _ in range(120)} | {"a", "ab", "abc"})
    left = sorted({misspelt(rng, rng.choice(right)) for _ in range(150)} | {"a", "b", "bc"} - {""})
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {(r.a, r.b) for r in similar_pairs(one(left, "a"), one(right, "b"), "a", "b", least).collect()}
    within = lambda a, b: brute_common(a, b) * 2 >= least * (len(a) + len(b)) - 1e-9
    assert {(a, b) for a in left for b in right if abs(len(a) - len(b)) <= (1 - least) * (len(a) + len(b)) + 1e-9 and within(a, b)} <= got


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_keys_grow_with_length_only(spark):
    """A 75-letter text has 18 chunks to look up and 75 grams, a 33-letter one 8 and 33; candidates stay few."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n)).strip().ljust(n, "x")
    for n, most in ((33, 8), (75, 18)):
        df = spark.createDataFrame([(text(n),)], "t string").select(F.array("t").alias("tokens"))
        r = df.select(F.size(grams(F.col("tokens"), 4)).alias("g"), F.size(chunks(F.col("tokens"), 4)).alias("c")).first()
        assert r.g <= n and r.c <= most + 1
    names = sorted({" ".join(rng.choices(WORDS + LONG, k=4)) for _ in range(600)})
    left, right = (spark.createDataFrame([(x,) for x in names], f"{c} string").withColumn("tokens", F.array(c)) for c in "ab")
    assert sharing_chunks(left, right, "a", "b", 0.895, False).count() < 0.5 * len(names) ** 2


def test_salted_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(90)], "key string, i int")
    right = spark.createDataFrame([("hot" if i % 2 else f"k{i % 5}", i) for i in range(70)], "key string, j int")
    want = sorted(map(tuple, left.join(right, "key").collect()))
    for most in (1, 7, 1000):
        assert sorted(map(tuple, salted_join(left, right, "key", most).select("key", "i", "j").collect())) == want


def test_nearest_texts(spark, monkeypatch):
    monkeypatch.setattr(nearest_text, "BLOCK", 60)
    monkeypatch.setattr(nearest_text, "QUERIES", 40)
    rng = random.Random(6)
    texts = sorted({" ".join(rng.choices(WORDS + LONG, k=rng.randrange(1, 9))) for _ in range(300)} | {"", "é ü"})
    queries = sorted({misspelt(rng, rng.choice(texts[1:])) for _ in range(100)} | {"", "q", "é", "w" * 70, "x y " * 30, "zz top"})
    got = nearest_text.nearest_texts(spark.createDataFrame([(q,) for q in queries + queries[:9]] + [(None,)], "query string"), spark.createDataFrame([(t, f"{i:04d}") for i, t in enumerate(texts)], "text string, rank string"))
    rows = {r["query"]: (-r.score, r.text) for r in got.collect()}
    assert rows == {q: min((-ratio_of(q, t), t) for t in texts) for q in queries}
    assert nearest_text.nearest_texts(spark.createDataFrame([("a",)], "query string"), spark.createDataFrame([], "text string, rank string")).collect() == []


def test_nearest_entity_of_one_name(spark, tmp_path):
    """So many entities of one name that all pairs would be 400 million; places may be null."""
    n = 20000
    place = lambda k, many, c: None if k % 11 == 3 else f"{c}{k % many}"
    rows = [(k, "hot ring", place(k, 97, "Brand#"), place(k // 3, 53, "T")) for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: r.ein for r in QUERIES["nearest_entity"](spark, str(tmp_path)).collect()}
    first, best = {}, {}
    for k, _, brand, kind in rows:
        first.setdefault((brand, kind), k)
    for k, _, brand, kind in rows:
        state = "elsewhere" if k % 7 == 0 else brand
        if (state, kind) not in best:
            same = lambda x, y: 2 if x is None or y is None else int(x != y)
            best[state, kind] = min((same(state, b), same(kind, t), e) for (b, t), e in first.items())[2]
    assert got == {k: f"{best['elsewhere' if k % 7 == 0 else b, t]:09d}" for k, _, b, t in rows}


def test_entities_of_one_name_are_not_paired(spark, monkeypatch):
    """What the nearest is chosen from grows with texts and rows, not with their product."""
    seen, real = [], entity_match.best_near

    def counted(*frames, **more):
        seen.extend(f.count() for f in frames if hasattr(f, "count"))
        return real(*frames, **more)

    monkeypatch.setattr(entity_match, "best_near", counted)
    names = spark.createDataFrame([(n, f"c{i}", "") for n in ("Hope River Fund", "Hopes River", "River Hope", "Hope River Grace") for i in range(100)], "name string, city string, state string")
    to = spark.createDataFrame([(f"{i:09d}", "Hope River", f"C{i % 90}", "") for i in range(900)], "ein string, name string, city string, state string")
    matched = entity_match.match_entities(names, to)[0].collect()
    assert {(r.city, r.ein) for r in matched} == {(f"c{i}", f"{i if i < 90 else 0:09d}") for i in range(100)} and len(matched) == 400
    assert seen and max(seen) <= 1300


def test_target_names_are_made_distinct_first(spark):
    """Normal forms are made of staged distinct names: no filter on them can move below the distinct."""
    names = spark.range(1000).select(F.concat(F.lit("Cru "), (F.col("id") % 3).cast("string")).alias("name"))
    found = match_targets(names, target_list(spark))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
