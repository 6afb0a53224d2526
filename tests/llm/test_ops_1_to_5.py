"""Operators 1 to 5 on small tables, against brute force and the tokenizers' own libraries."""

import hashlib
import os
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm import exact_dedup, mixing, packing, token_counts, url_filter

ROWS = [
    (1, "a b", "x", "extra"), (2, "a  b ", "x", None), (3, "ab", None, "e"), (4, None, "y", "e"), (5, " \n", "y", "e"),
    (6, "", None, "e"), (7, "é\x0b!", "z", "e"), (7, "é\x0b!", "z", "e"), (None, "é!", "z", "e"), (8, "w " * 5000, "x", "e"), (9, " a b", "x", "e"),
]
SCHEMA = "doc_id long, text string, source string, size string"


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), d is None, d))
    assert len(got) == len(ROWS)
    for g, members in groups.items():
        mine = [r for r in got if r.text_sha256 == g]
        assert [r.keep_id for r in mine] == [min(members)[2]] * len(members)
        assert {r.group_size for r in mine} == {len(members)} and sum(r.kept for r in mine) == 1
        assert [r.doc_id for r in mine if r.kept] == [min(members)[2]]


def test_exact_dedup_of_extreme_ids(spark):
    rows = [(-(2**63), "a"), (2**63 - 1, "a"), (None, "a"), (0, "b"), (-(2**63), "b c")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.kept) for r in got) == sorted([(False, -(2**63), -(2**63), True), (False, 2**63 - 1, -(2**63), False), (True, 0, -(2**63), False), (False, 0, 0, True), (False, -(2**63), -(2**63), True)])


def test_exact_dedup_appends_to_the_index(spark):
    index = exact_dedup.create_index(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    n = exact_dedup.append_new(df, index).filter("kept").count()
    again = exact_dedup.append_new(df.unionAll(spark.createDataFrame([(99, "brand new", "q", "")], SCHEMA)), index)
    assert [r.doc_id for r in again.filter("kept").collect()] == [99]
    assert spark.table(index).count() == n + 1
    assert exact_dedup.append_new(df.limit(0), index).count() == 0


def test_a_batch_that_comes_again(spark):
    """After a failure the same batch appends nothing, and its rows stay; so after compaction."""
    index = exact_dedup.create_index(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    first = exact_dedup.append_new(df.limit(5), index, "b1").drop("row").collect()
    n = spark.table(index).count()
    again = exact_dedup.append_new(df.limit(5), index, "b1").drop("row").collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and any(r.kept for r in first) and spark.table(index).count() == n
    index = exact_dedup.compact(spark, index)
    assert sorted(map(repr, exact_dedup.append_new(df.limit(5), index, "b1").drop("row").collect())) == sorted(map(repr, first))
    assert spark.table(index).count() == n and exact_dedup.append_new(df.limit(5), index, "b2").filter("kept").count() == 0


def test_a_compact_index_is_not_sorted_anew(spark):
    index = exact_dedup.create_index(spark)
    exact_dedup.append_new(spark.createDataFrame(ROWS, SCHEMA), index)
    index = exact_dedup.compact(spark, index)
    with exact_dedup._sorted_buckets(spark):
        held = spark.table(index).select("digest").hint("merge")
        plan = held.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "Exchange" not in plan


def test_exact_dedup_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_without_copies(spark):
    got = exact_dedup.without_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "source", "size"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 5, 7, 8, 9]


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 300, None: 50}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    assert got == pytest.approx(target)


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice("abcd"), "") for i in range(4000)] + [(-1, None, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken, target = defaultdict(int), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 1 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    out = mixing.emit(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_emit_takes_each_row_for_itself(spark):
    """Documents that share a doc_id, or have none, take the copies of their own source."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), f"{i} " + "w " * rng.randrange(1, 30), rng.choice("abcd"), "") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(df).collect()
    copies, got = defaultdict(int), defaultdict(int)
    for r in mixed:
        copies[r.doc_id, r.source] += r.copies
    sources = {t: (d, s) for d, t, s, _ in rows}
    for r in mixing.emit(df).collect():
        got[sources[r.text]] += 1
    assert got == {k: v for k, v in copies.items() if v}
    # not all documents without an id fare alike
    assert any(len({r.copies for r in mixed if r.doc_id is None and r.source == s}) > 1 for s in "abcd")


ODD = ["", "  a", "\n", "   ", "a" * 500, " " * 77, "日本語 テスト", "퟿ é", "▁▁ a", "<s> </s><0x0A>", "\x00a", "🙂🙂 x", "aaab" * 40, "10 000", "\t\t\tx", "<|endoftext|> x", "İI ſ é \x1c\x1d .\x1f!", "x'll'S don't", "    ", "A" * 3000]


def odd_texts(seed):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("ab ▁\n.-=_the<>0 1é日'\t") for _ in range(rng.randrange(80))) for _ in range(800)]


def test_token_counts(spark):
    import sentencepiece

    texts = odd_texts(1)
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(None, None, "", "")]
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA), limit=50).collect()}
    want = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model()).encode(texts)
    for i, (t, w) in enumerate(zip(texts, want)):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(w), len(t.encode()), len(w) > 50), repr(t)
    assert (got[None].n_tokens, got[None].n_bytes) == (0, 0)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    texts = odd_texts(2) + ["lorem ipsum " * 3000]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(-1, None, "", "")]
    ids = {i: np.array(e.ids + [1], "<u4") for (i, *_), e in zip(rows, Tokenizer.from_file(packing.default_tokenizer()).encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False))}
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), capacity=capacity, with_ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.ids == piece.tolist()
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert sorted(docs[i])[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(docs[i]), [*sorted(docs[i])[1:], (len(x), 0)]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
        total = s[-1][0] + s[-1][1]
        assert total <= capacity and total & (total - 1) == 0
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_over_many_partitions(spark):
    """What the partitions have left over is packed together."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 900), "", "") for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(60)).collect()
    lengths = defaultdict(int)
    for r in got:
        lengths[r.sequence_id] += r.length
    short = [n for n in lengths.values() if n < 2048]
    assert len(short) <= 11 and sum(lengths.values()) == sum(len(t.split()) + 1 for _, t, *_ in rows)


def test_long_texts_are_encoded_in_slices(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = ["", " ", "word", "  a\n", "x" * 500, "".join(rng.choice(["été ", "a", "\u00a0", " ", "\n\n", "long" * 30, "<s>", "\x1c"]) for _ in range(600)) + "\t"]
    plain, ids = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer())
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(packing, "CHUNK", size)
        assert all(ids.encode_long(t.encode()).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)


def test_words_are_looked_up_once_a_chunk(monkeypatch):
    """Python sees the distinct words of a chunk only; Arrow splits at the same six characters as before."""
    from tokenizers import Tokenizer

    texts = ["", " ", " \t lead", "trail \r\n", "a b " * 5000, "a\x0bb\x0cc\x1cd\x1fe\x85f\u00a0g\u2003h\x00i", "é e\u0301 \u0301 ’s 's", "<|endoftext|>a <| endoftext|>", "x" * 3000, "B a"]
    seen, plain, ids = [], Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer())
    codes = packing.Numbering.codes
    monkeypatch.setattr(packing.Numbering, "codes", lambda self, keys: codes(self, [k for k in keys if not seen.append(k)]))
    for column in (pa.array(["out", *texts, "out"]).slice(1, len(texts)), pa.array(texts, pa.large_string()), pa.array(texts[:0], pa.string())):
        flat, sizes = ids.encode(column)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts[: len(column)]]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])
    assert len(seen) == 2 * len({w for t in texts for w in re.split(r"[ \t-\r]+", t)})
    # bytes that are no UTF-8 are replaced
    flat, _ = ids.encode(pa.array([b"a \xff\xfe b\xc3 \xa9"], pa.binary()).view(pa.string()))
    assert flat.tolist() == plain.encode("a \ufffd\ufffd b\ufffd \ufffd", add_special_tokens=False).ids


def test_words_that_hold_the_word_between(monkeypatch):
    from tokenizers import Tokenizer

    plain, ids = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer())
    words = ["a", "\x01", "b\x01", "\x01\x01c", "", "It's", "\x01"]
    want = [plain.encode(w, add_special_tokens=False).ids for w in words]
    for between in ("\x01", "a", "two parts", ""):
        ids.between = plain.encode(between, add_special_tokens=False).ids
        monkeypatch.setattr(packing, "BETWEEN", between)
        for some in (words, words[:1], [w for w in words if "\x01" not in w]):
            sizes, flat = ids._ids_of(some)
            mine = [x for w, x in zip(words, want) if w in some]
            assert sizes.tolist() == [len(x) for x in mine] and flat.tolist() == sum(mine, [])


def test_a_worker_encodes_in_one_thread(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "")  # so that it is as before afterwards
    monkeypatch.delenv("TOKENIZERS_PARALLELISM")
    packing.word_ids.cache_clear()
    packing.word_ids(packing.default_tokenizer(), 10)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    packing.word_ids.cache_clear()
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    packing.word_ids(packing.default_tokenizer(), 10)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "true"


def test_models_that_normalise_are_refused():
    class Changed:
        def __init__(self, change):
            self.normalize = lambda t: "▁" + change(t).replace(" ", "▁")

    assert token_counts._normalised(Changed(lambda t: t)) is None
    assert token_counts._normalised(Changed(str.strip)) == " a"
    assert all(token_counts._normalised(Changed(f)) is not None for f in (str.lower, lambda t: unicodedata.normalize("NFC", t), lambda t: t.replace("  ", " "), lambda t: t.replace("\uff21", "A")))


def test_fill_is_closest():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))]
        pool = packing.Pool()
        for n in lengths:
            pool.add(n, n)
        took = pool.fill(100)
        rest = sorted(lengths)
        top = rest.pop()
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums}
        assert sum(took) == top + max(s for s in sums if s <= 100 - top) and top in took
        assert sorted(took + [n for k, v in pool.by_length.items() for n in v]) == sorted(lengths)


def test_url_filter(spark, monkeypatch):
    rng = random.Random(4)
    rules = [(rng.choice(["allow", "block"]), h, p) for h in ("com", "a.com", "b.a.com", "net", "xa.com", "x") for p in rng.sample(["/", "/en/", "/en/q", "/fr", "/é/"], 3)]
    urls = [None, "", "no host", "://", "http://", "http://com", "http://COM/", "http://xa.com/en/?q=/fr", "http://a.com#/en/", "HTTP://u.B.a.Com/en/q/2://x/", "http://.com/", "http://É.com/é/x\n/y", "http://a.com:80/en/"]
    urls += [f"http://{rng.choice(['', 'www.', 'b.', 'x'])}{rng.choice(['com', 'a.com', 'net', 'org', 'x'])}{rng.choice(['', '/', '/en/', '/en/q/1', '/fr?x', '/é/#1'])}" for _ in range(150)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, key string")
    want = {}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, *(max(fit)[2:] if fit else (None, "allow")))
    for options in ({}, {"broadcast_rules": 0}, {"max_blocks": 1}):
        got = url_filter.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string"), **options).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want and len(got) == len(urls)
    # few rules are hot, all, or none
    for share in (3, 10**6, 1):
        monkeypatch.setattr(url_filter, "HOT_RULES", share)
        got = url_filter.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string"), broadcast_rules=0).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want and len(got) == len(urls)
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark), broadcast_rules=0).count() == 0
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).count() == 0
