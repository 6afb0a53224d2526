"""MinHash near-dedup (operator 9): order MinHash sketches, verified by banded alignment.

Order MinHash: of the k-mers of a document, each labelled with its number of
occurrence, the few with the smallest hashes are taken and put in the order of the text;
two texts agree in a sketch with a probability that falls with their edit
distance, not only with what their sets of k-mers have in common.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import gram_hashes, mix
from .common import by_bytes, flat_bytes, one_row_each, releasing, staged, text_of
from .graph import components
from .repeats import word_units

#: Words of a shingle and the similarity (1 - edit distance / words of the longer text) of a link.
SHINGLE, SIMILARITY = 2, 0.8
#: Sketches, and k-mers in each. With a fifth of the words replaced, scattered, texts share 0.64 / 1.36 of their shingles: they miss
#: all with a chance of about (1 - 0.47 ** 3) ** 48, half a hundredth; with 0.15 replaced below 1e-4.
SKETCHES, ORDERED = 48, 3
#: Order of comparing only: who is not similar to a leader meets further leaders in finer buckets, those of one more sketch, so far on, so often.
FURTHER, DEPTH = (1, 3), 8
#: Nodes and bytes of words in one block of a bucket (on average); bins of the counts that bound a pair's edits.
BLOCK, BLOCK_BYTES, BINS = 1024, 4 << 20, 128
#: Longer texts are aligned by diagonals, shorter ones by bits.
BITS = 4096
CHUNK = 1 << 20


def sketches(units: np.ndarray, sizes: np.ndarray, shingle: int = SHINGLE, n: int = SKETCHES, ordered: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a shingle, their sketches as 64-bit keys, one column for each)."""
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(units))
    pos = np.flatnonzero(left >= shingle)
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros((0, n), np.uint64)
    gram = gram_hashes(units, (shingle,))[shingle][pos]
    row = np.repeat(np.arange(len(sizes)), sizes)[pos]
    # the number of occurrence inside the document
    order = np.lexsort((gram, row))
    new = np.append(True, (gram[order][1:] != gram[order][:-1]) | (row[order][1:] != row[order][:-1]))
    run = np.flatnonzero(new)
    occurrence = np.empty(len(pos), np.uint64)
    occurrence[order] = np.arange(len(pos)) - np.repeat(run, np.diff(np.append(run, len(pos))))
    label = mix(gram + occurrence * np.uint64(0x9E3779B97F4A7C15))
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    count = np.diff(np.append(starts, len(row)))
    keys = np.zeros((len(starts), n), np.uint64)
    none = np.uint64(2**64 - 1)
    for j in range(n):
        h = mix(label ^ np.uint64((j * 0x632BE59BD9B4E019 + 1) % 2**64))
        picks = np.full((len(starts), ordered), len(pos), np.int64)
        for i in range(ordered):
            low = np.minimum.reduceat(h, starts)
            at = np.flatnonzero(h == np.repeat(low, count))
            owner = np.searchsorted(starts, at, "right") - 1
            one = np.append(True, owner[1:] != owner[:-1])
            at, owner = at[one], owner[one]
            free = low[owner] != none
            picks[owner[free], i] = at[free]
            h[at] = none
        picks.sort(axis=1)
        key = np.full(len(starts), j + 1, np.uint64)
        for i in range(ordered):
            there = picks[:, i] < len(pos)
            key[there] = mix(key[there] * np.uint64(0xD1342543DE82EF95) + label[picks[there, i]])
        keys[:, j] = key
    return row[starts], keys


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edits (words put in, left out or replaced) from a to b, or limit + 1 if there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    return _by_bits(a.tolist(), b.tolist(), limit) if max(len(a), len(b)) <= BITS else _by_diagonals(a, b, limit)


def _by_bits(a: list[int], b: list[int], limit: int) -> int:
    """Columns of the table of edits as bit vectors: where an entry is one more, or one less, than the one above it."""
    if not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, edits, left = mask, 0, len(a), len(b)
    for w in b:
        equal = places.get(w, 0)
        across = ((equal & up) + up ^ up) | equal
        more, less = (down | ~(across | up)) & mask, up & across
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
        left -= 1
        # each word that is left takes off one at most
        if edits - left > limit:
            return limit + 1
        more, level = more << 1 | 1, equal | down
        up, down = (less << 1 | ~(level | more)) & mask, more & level & mask
    return min(edits, limit + 1)


def _by_diagonals(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The same, banded.

    After e edits the furthest point on each of the 2e + 1 diagonals is
    kept; how far equal words lead on from there is found on prefix hashes for
    all diagonals together.
    """
    n, m = len(a), len(b)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(max(n, m), 0x9E3779B97F4A7C15, np.uint64)))
        # prefix sums weighted by place: equal stretches agree once shifted to the same place
        pa_, pb = (np.append(np.uint64(0), np.cumsum(mix(x.astype(np.uint64)) * power[: len(x)])) for x in (a, b))

        def slide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            low, high = np.zeros(len(x), np.int64), np.minimum(n - x, m - y)
            step = 1 << max(int(high.max(initial=0)).bit_length() - 1, 0)
            # common case: the next words differ
            while step:
                to = low + step
                ok = to <= high
                to = np.where(ok, to, low)
                da, db = pa_[x + to] - pa_[x], pb[y + to] - pb[y]
                shift = y - x
                same = np.where(shift >= 0, da * power[np.maximum(shift, 0)] == db, da == db * power[np.maximum(-shift, 0)])
                low = np.where(ok & same, to, low)
                step >>= 1
            return low

        far = np.full(2 * limit + 3, -(10**9), np.int64)  # by diagonal y - x, at limit + 1 + it
        zero = limit + 1
        for e in range(limit + 1):
            lo, hi = zero - e, zero + e
            if e == 0:
                x = np.zeros(1, np.int64)
            else:
                x = np.maximum(far[lo : hi + 1] + 1, np.maximum(far[lo - 1 : hi], far[lo + 1 : hi + 2] + 1))
            diag = np.arange(lo, hi + 1) - zero
            x = np.minimum(x, np.minimum(n, m - diag))
            ok = (x >= 0) & (x + diag >= 0)
            new = np.full(len(x), -(10**9), np.int64)
            if ok.any():
                new[ok] = x[ok] + slide(x[ok], x[ok] + diag[ok])
            far[lo : hi + 1] = new
            end = m - n + zero
            if lo <= end <= hi and far[end] >= n:
                return e
    return limit + 1


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection as multisets."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum())


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence of distinct values."""
    ends, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        ends[k : k + 1], at[k : k + 1] = [v], [i]
        before.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _at_most(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of the alignment that keeps the leading and trailing words and the 3-grams that occur once in both, in order."""
    grams = [(x[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] for x in (a, b)]
    (ua, ia, na), (ub, ib, nb) = (np.unique(g, return_index=True, return_counts=True) for g in grams)
    _, i, j = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    x, y = ia[na == 1][i], ib[nb == 1][j]
    order = np.argsort(x)
    keep = _rising(y[order].tolist())
    # each gram keeps three words
    x, first = np.unique(np.concatenate([x[order][keep] + i for i in range(3)]), return_index=True)
    y = np.concatenate([y[order][keep] + i for i in range(3)])[first]
    if len(y):
        ok = (y == np.maximum.accumulate(y)) & (y == np.minimum.accumulate(y[::-1])[::-1]) & np.append(True, y[1:] != y[:-1])
        x, y = x[ok], y[ok]
    x, y = np.append(np.append(-1, x), len(a)), np.append(np.append(-1, y), len(b))
    return int((np.maximum(np.diff(x), np.diff(y)) - 1).sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most (1 - similarity) of the longer text's words.

    Bounds settle most pairs: an edit spoils at most q of the q-grams, and any
    alignment's edits are enough. The banded alignment decides the rest.
    """
    size = max(len(a), len(b))
    limit = int((1 - similarity) * size + 1e-9)
    if abs(len(a) - len(b)) > limit or size - _common(a, b) > limit:
        return False
    if min(len(a), len(b)) > 2:
        two = [x[:-1].astype(np.uint64) << np.uint64(32) | x[1:] for x in (a, b)]
        if size - 1 - _common(*two) > 2 * limit:
            return False
        if _at_most(a, b) <= limit:
            return True
    return edit_distance(a, b, limit) <= limit


def _sketch(shingle: int, n: int, ordered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column(2))
            for a, b in by_bytes(offsets, CHUNK):
                units, sizes = word_units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows, keys = sketches(units, sizes, shingle, n, ordered)
                ends = np.zeros(b - a + 1, np.int32)
                ends[rows + 1] = n
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sizes.astype(np.int64)), lists], names=["doc_id", "digest", "n_words", "sketch"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat_bytes(batch.column(1))
        units, sizes = word_units(data, offsets)
        ends = np.cumsum(sizes)
        parts = [units[e - s : e].astype(np.uint32).tobytes() for e, s in zip(ends, sizes)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["node", "words"])


def _led(similarity: float):
    """Which nodes of one block are similar to its leader, whose own row has no ``a``."""

    def run(table: pa.Table) -> pa.Table:
        node, words = table.column("a").to_pylist(), [np.frombuffer(w, np.uint32) for w in table.column("words").to_pylist()]
        first = words[node.index(None)]
        found = [n for n, w in zip(node, words) if n is not None and similar(w, first, similarity)]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([table.column("b")[0].as_py()] * len(found), pa.int64())})

    return run


def _stars(judged: DataFrame) -> DataFrame:
    """The same classes by fewer links: each node to its first leader, and that leader, once for all nodes, to their others.

    A node has at most as many leaders as sketches.
    """
    leaders = judged.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("bs"))
    others = leaders.select(F.col("bs")[0].alias("a"), F.explode(F.slice("bs", 2, F.size("bs"))).alias("b")).distinct()
    return leaders.select("a", F.col("bs")[0].alias("b")).unionByName(others)


def _by_leaders(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, leader b, n_words of a) that are similar.

    The nodes of a leader come in blocks of bounded size, and its words once to each block.
    """
    size = pairs.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / (2 * BLOCK)), F.ceil(4 * F.sum("n_words") / BLOCK_BYTES)).alias("blocks"))
    dealt = pairs.join(size.filter("blocks > 1"), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("blocks")), F.lit(0)).alias("salt"))
    members = dealt.join(words.withColumnRenamed("node", "a"), "a").select("b", "salt", "a", "words")
    leaders = dealt.select("b", "salt").distinct().join(words.withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "words")
    return members.unionByName(leaders).groupBy("b", "salt").applyInArrow(_led(similarity), "a long, b long")


def _within(similarity: float):
    """Links, between classes, of one block of a bucket, or between two, that join what is not joined yet."""

    def run(table: pa.Table) -> pa.Table:
        root, size = (table.column(c).to_numpy() for c in ("root", "n_words"))
        salt, guest, nth = (table.column(c).to_numpy() for c in ("salt", "guest", "nth"))
        one, other = table.column("one")[0].as_py(), table.column("other")[0].as_py()
        sketch = np.array(table.column("sketch").to_pylist(), np.int64)
        words = [np.frombuffer(w, np.uint32) for w in table.column("words").to_pylist()]
        with np.errstate(over="ignore"):
            bins = np.stack([np.bincount((w * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BINS.bit_length() - 1)), minlength=BINS) for w in words]).astype(np.int32)
        # classes that links found here have joined
        into: dict[int, int] = {}

        def top(r: int) -> int:
            while r in into:
                r = into[r]
            return r

        a, b = [], []
        for i in np.flatnonzero(salt == one):
            j = np.flatnonzero(salt == other)
            j = j[(j > i) if one == other else (j != i)]
            j = j[(root[j] != root[i]) & ~(guest[j] & guest[i])]
            longer = np.maximum(size[j], size[i])
            limit = ((1 - similarity) * longer + 1e-9).astype(np.int64)
            j, limit = (x[np.minimum(size[j], size[i]) >= longer - limit] for x in (j, limit))
            # a pair is compared in the first sketch that it shares
            fresh = ~(sketch[j, : nth[0]] == sketch[i, : nth[0]]).any(axis=1)
            j, limit = j[fresh], limit[fresh]
            # words that one text has more often than the other are edits; words that share a bin only hide some
            apart = bins[j] - bins[i]
            for k in j[(np.maximum(apart, 0).sum(axis=1) <= limit) & (np.maximum(-apart, 0).sum(axis=1) <= limit)]:
                x, y = top(int(root[i])), top(int(root[k]))
                if x != y and similar(words[i], words[k], similarity):
                    into[x] = y
                    a.append(root[i])
                    b.append(root[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _across(rows: DataFrame, roots: DataFrame, nodes: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links between the roots of nodes that share a bucket and are in different classes so far: every such pair is compared.

    Buckets are split by bands of length (a node is a guest in the band below its own,
    so that all pairs of fitting length meet once), and those into blocks that meet in pairs. The largest class of a
    band has blocks of its own, which meet those of the others only: what is linked already is not compared again, so
    that a large class with few strangers costs as many rows as it has nodes.
    """
    near = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    band = F.floor(F.log(F.col("n_words").cast("double")) / (math.log(1 / similarity) + 1e-6))
    own = near.select("key", "nth", "node", "root", "n_words", F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band - 1).alias("band"), F.lit(True).alias("guest")))).alias("at"))
    own = staged(own.select("key", "nth", "node", "root", "n_words", "at.band", "at.guest"), "bands")
    by_class = own.groupBy("key", "band", "root").agg(F.count("*").alias("n"), F.sum("n_words").alias("total"), F.min("guest").alias("guests"))
    largest = F.max(F.struct("n", "total", "root"))
    mixed = by_class.groupBy("key", "band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("guests").alias("guests"), largest.alias("main")).filter("classes > 1 and not guests")
    blocks = lambda n, total: F.greatest(F.ceil(n / BLOCK), F.ceil(4 * total / BLOCK_BYTES))
    mains = blocks(F.col("main.n"), F.col("main.total"))
    others = blocks(F.col("n") - F.col("main.n"), F.col("total") - F.col("main.total"))
    mixed = mixed.select("key", "band", F.col("main.root").alias("main"), mains.alias("mains"), others.alias("others"))
    # the main class is dealt to the blocks from 0 on, the others to those behind
    dealt, hashed = own.join(mixed, ["key", "band"]), F.xxhash64("node", "key")
    is_main = F.col("root") == F.col("main")
    dealt = dealt.withColumn("salt", F.when(is_main, F.pmod(hashed, F.col("mains"))).otherwise(F.col("mains") + F.pmod(hashed, F.col("others"))))
    met = dealt.withColumn("with", F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0).cast("long")), F.col("mains") + F.col("others") - 1)))
    met = met.withColumn("one", F.least("salt", "with")).withColumn("other", F.greatest("salt", "with")).drop("with", "main", "mains", "others")
    full = met.join(nodes.select("node", "sketch"), "node").join(words, "node")
    return staged(full.groupBy("key", "band", "one", "other").applyInArrow(_within(similarity), "a long, b long"), "across")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, n: int = SKETCHES, ordered: int = ORDERED, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id, class_size, kept, digest: which documents are near copies of each other.

    Equal texts are one node from the start. Nodes that agree in a sketch share a
    bucket. First every bucket elects a leader (who shares most buckets' places with others;
    ties by a hash), with which each other node is aligned, and those that are not
    similar to it go on to finer buckets. Then all pairs of a bucket that are not in
    one class yet are compared, so that no similar pair that shares a sketch stays apart. Classes are the
    connected components, whatever ``depth``, the rounds of leaders at most, which only sets the order of comparing; class_id is the smallest doc_id in them (null last), and that
    document is kept. Very long texts are compared whole; more columns are not used. Texts below ``shingle`` words, null ones too (as empty), are only
    near copies of equal texts; rows with equal doc_id and text are
    one document and fare alike; an empty table gives no rows.
    """
    digest = F.sha2(text_of().cast("binary"), 256)
    kind = dict(docs.dtypes)["doc_id"]
    flat = docs.select("doc_id", digest.alias("digest"), text_of().alias("text"))
    drawn = staged(flat.mapInArrow(releasing(_sketch(shingle, n, ordered)), f"doc_id {kind}, digest string, n_words long, sketch array<long>"), "sketches")
    nodes = drawn.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    rows = nodes.filter("size(sketch) > 0").select("node", "n_words", F.posexplode("sketch").alias("nth", "key"))

    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # the company a node keeps in all its buckets: who has most is nearest to the text that a group's copies came from
    rows = staged(rows.join(crowded, "key"), "crowded")
    company = rows.groupBy("node").agg(F.sum("n").alias("company"))
    rows, done = staged(rows.drop("n").join(company, "node"), "buckets"), 0
    coarse = rows.select("key", "nth", "node", "n_words")
    wanted = rows.select("node").distinct().join(nodes.select("node", "digest", "rep"), "node")
    here = (flat["digest"] == wanted["digest"]) & flat["doc_id"].eqNullSafe(wanted["rep"])
    words = staged(flat.join(wanted.select("node", "digest", "rep"), here).select("node", "text").mapInArrow(releasing(_words), "node long, words binary").dropDuplicates(["node"]), "words")

    links = docs.sparkSession.createDataFrame([], "a long, b long")
    while done < depth:
        order = F.struct((-F.col("company")).alias("o"), F.xxhash64("node").alias("h"), "node", "n_words")
        led = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("l")).filter("n > 1")
        led = staged(led.select("key", F.col("l.node").alias("leader"), F.col("l.n_words").alias("leader_words")), "led")
        if led.isEmpty():
            break
        met = staged(rows.join(led, "key"), "met")
        fit = F.least("n_words", "leader_words") >= similarity * F.greatest("n_words", "leader_words") - 1e-9
        pairs = met.filter(fit & (F.col("node") != F.col("leader"))).select(F.col("node").alias("a"), F.col("leader").alias("b"), "n_words").distinct()
        pairs = staged(pairs, "pairs")
        judged = staged(_by_leaders(pairs, words, similarity), "judged")
        links = links.unionByName(staged(_stars(judged), "stars"))
        linked = judged.select(F.col("a").alias("node"), F.col("b").alias("leader"))
        rest = met.filter(F.col("node") != F.col("leader")).join(linked, ["node", "leader"], "left_anti").select("key", "node", "n_words", "nth", "company")
        done += 1
        finer = rest.join(nodes.select("node", "sketch"), "node").withColumn("nth", F.explode(F.array(*((F.col("nth") + i) % n for i in FURTHER))))
        rest = finer.select(F.xxhash64("key", "nth", F.element_at("sketch", F.col("nth") + 1)).alias("key"), "node", "n_words", "nth", "company")
        rows = staged(rest, "rest")

    roots = components(links)
    further = components(_across(coarse, roots, nodes, words, similarity)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = nodes.select("node", "digest", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(further, "root", "left")
    # both staged, so that the sides of their join are plain exchanges and Spark can split a large class
    labelled = staged(rooted.withColumn("root", F.coalesce("top", "root")).drop("top"), "labelled")
    classes = labelled.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("rep").isNull(), "rep", "node")).getField("node").alias("first"))
    of = staged(labelled.join(staged(classes, "class_rows"), "root").select("digest", "class_id", "class_size", (F.col("node") == F.col("first")).alias("holds")), "classes")
    return drawn.select("doc_id", "digest").join(of, "digest").select("doc_id", "class_id", "class_size", (F.col("holds") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), "digest")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that near-dedup keeps, all columns as they were; cases as in ``near_duplicates``.

    Of rows that share text and doc_id, null too, one stays: that with the smallest hash of its columns.
    """
    kept = near_duplicates(docs, **options).filter("kept").groupBy("digest", "doc_id").agg((F.count("*") > 1).alias("__tied"))
    kept = staged(kept.withColumnsRenamed({"doc_id": "__kept_id", "digest": "__of"}), "kept")
    tagged = docs.select(F.struct(*docs.columns).alias("__row"), F.sha2(text_of().cast("binary"), 256).alias("__digest"), F.col("doc_id").alias("__id"))
    here = tagged.join(kept, (F.col("__digest") == F.col("__of")) & F.col("__id").eqNullSafe(F.col("__kept_id")))
    return one_row_each(here, ["__digest"], "__tied", "__row")
