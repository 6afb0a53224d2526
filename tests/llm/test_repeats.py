"""Operators 6 and 8 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm import repeats
from llm.substring_dedup import locate, passages, remove_phrases
from llm.suffix_dedup import LogIndex, levels, remove_known, remove_repeats


def brute(seqs, width):
    n = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = bytearray(len(s))
        for i in range(len(s) - width + 1):
            if n[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(gone)
    return out


def corpus(rng, n=60):
    words = ["w%d" % i for i in range(40)] + ["é x", "the", "aaaa"]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(70) for _ in range(4)]
    docs = []
    for i in range(n):
        t = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            at = rng.randrange(0, len(t) + 1)
            t[at:at] = p[a : a + rng.randrange(25, 70)]
        docs.append(rng.choice([" ", "  ", "\n", "\t "]).join(t))
    docs += [docs[3], docs[5] + " tail", "", None, " \n ", "z" * 900, "ab" * 300, " ".join(["la"] * 90)]
    return [(i, d) for i, d in enumerate(docs)] + [(3, docs[3]), (None, docs[7])]


@pytest.mark.parametrize("shard_runs", [2000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, shard_runs, seed):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k1", "text as spans")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])

    seqs = [(t or "").encode().split() for _, t in rows]
    want = sorted(((i, len(s), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for (i, _), s, g in zip(rows, seqs, brute(seqs, 35))), key=key)
    got = remove_phrases(df, shard_runs=shard_runs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == want
    assert any(r[2] for r in want)

    seqs = [(t or "").encode() for _, t in rows]
    spans = lambda g: sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
    want = sorted(((i, len(s), sum(g), spans(g), hashlib.sha256(bytes(w for w, x in zip(s, g) if not x)).hexdigest()) for (i, _), s, g in zip(rows, seqs, brute(seqs, 200))), key=key)
    got = remove_repeats(df, shard_runs=shard_runs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == want
    assert any(r[2] for r in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_phrases(df).count() == 0
    assert remove_repeats(df).count() == 0


def test_the_automaton_gives_the_answer():
    bodies = [b"a b c d e", b"x b c d y", b"q b c d e"]
    keys, per = repeats.window_keys(bodies, "words", 3)
    none = np.zeros(len(keys), bool)
    assert passages(keys, per, none) == [(1, 1), (2, 2)]  # b c d at one place, c d e likewise: not every b c d goes with a c d e
    assert sorted(map(sorted, locate(bodies, keys, per, none, width=3))) == [[(1, 1)], [(1, 1), (2, 2)], [(1, 1), (2, 2)]]
    assert locate(bodies[:1], *repeats.window_keys(bodies[:1], "words", 3), none[:3], width=3) == [[]]
    assert locate(bodies[:1], *repeats.window_keys(bodies[:1], "words", 3), np.array([True, False, False]), width=3) == [[(0, 0)]]


def test_without_the_automaton_places_are_missing():
    """What is compiled is known from one place each; the automaton finds exactly all recurring windows."""
    rng = random.Random(4)
    lost = 0
    for _ in range(40):
        words = [[rng.choice("abc") for _ in range(rng.randrange(5, 40))] for _ in range(6)]
        bodies = [" ".join(w).encode() for w in words]
        keys, per = repeats.window_keys(bodies, "words", 5)
        none, want = np.zeros(len(keys), bool), brute(words, 5)
        covered = [bytearray(len(w)) for w in words]
        for c, found in zip(covered, locate(bodies, keys, per, none, width=5)):
            for a, b in found:
                c[a : b + 5] = b"\1" * (b + 5 - a)
        assert covered == want
        only, hit = [bytearray(len(w)) for w in words], none.copy()
        for a, b in passages(keys, per, none):
            hit[a : b + 1] = True
        for c, found in zip(only, repeats.spans_of(hit, per)):
            for a, b in found:
                c[a : b + 5] = b"\1" * (b + 5 - a)
        lost += only != want
    assert lost > 20


def test_levels_fall_geometrically():
    rng = np.random.default_rng(1)
    keys = rng.integers(97, 100, size=(3000, 6)).astype(np.uint8).view("S6").ravel()
    hit, index = np.zeros(len(keys), bool), LogIndex()
    for a in range(0, len(keys), 100):
        ids = np.arange(a, a + 100)
        index.add(keys[ids], ids, hit)
        sizes = [len(k) for k, _ in index.levels]
        assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:])) and all((np.sort(k) == k).all() for k, _ in index.levels)
    n = Counter(keys.tolist())
    assert hit.tolist() == [n[k] > 1 for k in keys.tolist()]


def test_long_rows_in_slices(spark, monkeypatch):
    """Texts cut into slices, as very long ones are, give the same answer."""
    rng = random.Random(3)
    rows = corpus(rng, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = [(t or "").encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    whole, _ = repeats.word_units(data, offsets)
    want = sorted(map(repr, remove_repeats(df).collect()))
    monkeypatch.setattr(repeats, "CHUNK", 50)
    assert (repeats.word_units(data, offsets)[0] == whole).all()
    u, sizes = data[:900], np.array([900])
    windows = [x for *_, first, last, _, _ in repeats._runs_of(u, sizes, 200, 40) for a, b in zip(first, last) for x in range(a, b + 1)]
    assert sorted(windows) == list(range(701))
    assert want == sorted(map(repr, remove_repeats(df).collect()))


def test_batches_against_a_family_of_levels(spark):
    """Each batch against all before it; levels fall geometrically; a batch that comes again changes nothing."""
    rows = corpus(random.Random(4), 40)
    raw = [(t or "").encode() for _, t in rows]
    parts = [list(range(i, len(rows), 4)) for i in range(4)]
    index, before = "family_under_test", []
    for n, part in enumerate(parts):
        df = spark.createDataFrame([rows[i] for i in part], "doc_id long, text string")
        seqs = [raw[i] for i in part]
        want = sorted((len(s), sum(g), hashlib.sha256(bytes(w for w, x in zip(s, g) if not x)).hexdigest()) for s, g in zip(seqs, brute(seqs + before, 200)))
        for _ in range(2 if n == 2 else 1):
            got = remove_known(df, index, f"b{n}").select("n_bytes", "n_removed", "kept_sha256").collect()
            assert sorted(map(tuple, got)) == want
        before += seqs
        sizes = [spark.table(t).count() for t in levels(spark, index)]
        assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:]))
        assert sum(spark.table(t).select("batch").distinct().count() for t in levels(spark, index)) == n + 1
    for t in levels(spark, index):
        spark.sql(f"DROP TABLE {t}")
