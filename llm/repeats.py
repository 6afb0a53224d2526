"""Passages that occur more than once: the search shared by substring and suffix-array dedup.

A window (``width`` units of one document: words or bytes) is recurring if its
text also starts anywhere else. The search has four parts, each a Spark job
whose shuffled rows grow in proportion to the input:

1. every document is cut into runs of windows that own the same anchor (see
   ``anchors``); one small row for each run goes to a staged table;
2. runs whose anchor occurs once can hold no recurring window and go. Of the others each
   distinct run (anchor and fragment, two 64-bit hashes) is cut out of its document as text,
   and out of a second document if it occurs there too;
3. these texts meet in shards by anchor. There ``locate`` compares the windows as
   text and says which spans of each run recurring ones cover. A shard holds a
   bounded number of runs; an anchor with more is split over several shards, which exchange the
   128-bit fingerprints of their windows, each once a shard, in a second round;
4. the spans of each distinct run go to all documents that have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import gram_hashes, mix, owned_runs
from .common import Numbering, by_bytes, flat_bytes, releasing, staged, text_of, words_of

#: Runs that one shard holds; an anchor with more distinct runs is split.
SHARD_RUNS = 2000
#: Bytes of text worked on at a time (one document more at most).
CHUNK = 1 << 20

_RUNS = "k1 long, k2 long, anchor long, fragment long, first int, last int"
_FOUND = "anchor long, fragment long, spans array<struct<a:int,b:int>>"
_SIZED = "shard long, salt int, anchor long, fragment long, ways int, body binary"


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, np.diff(offsets)


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words of each text."""
    first, end, per_row = words_of(data, offsets)
    out = np.zeros(len(first), np.uint64)
    # in slices of words, so that a very long text takes few times its size
    for a, b in by_bytes(np.append(first, len(data)), CHUNK) if len(first) else ():
        start, size = first[a:b], end[a:b] - first[a:b]
        gap = np.diff(np.append(start, end[b - 1]))
        weights = np.cumprod(np.full(int(size.max()) + 1, 0x2545F4914F6CDD1D, np.uint64))
        at = np.arange(start[0], end[b - 1]) - np.repeat(start, gap)
        long = np.repeat(size, gap)
        value = (data[start[0] : end[b - 1]].astype(np.uint64) + np.uint64(1)) * weights[np.minimum(at, long)]
        value[at >= long] = 0
        out[a:b] = mix(np.add.reduceat(value, start - start[0]) + size.astype(np.uint64))
    return out, per_row


def _keyed(docs: DataFrame) -> DataFrame:
    """k1 and k2 tell documents apart; only equal rows share them, and those have equal answers."""
    t = text_of()
    return docs.select("doc_id", t.alias("text")).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "doc_id", "text"
    )


def _runs_of(u: np.ndarray, sizes: np.ndarray, width: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first, last, anchor, fragment) of all runs, positions within their row; a long row comes in slices.

    A run is cut where a slice ends. Both parts hold the same anchor, so that their windows are still compared.
    """
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(u))
    for at in range(0, max(len(u) - width + 1, 0), CHUNK):
        part = u[at : at + CHUNK + width - 1]
        first, last, anchor, fragment = owned_runs(part, np.minimum(left[at : at + len(part)], np.arange(len(part), 0, -1)), width, k)
        if len(first):
            first, last = first + at, last + at
            row = np.searchsorted(ends, first, "right")
            base = (ends - sizes)[row]
            yield row, first - base, last - base, anchor, fragment


def _cut(units, width: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column(2))
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            for a, b in by_bytes(offsets, CHUNK):
                u, sizes = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for row, first, last, anchor, fragment in _runs_of(u, sizes, width, k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (k1[a + row], k2[a + row], anchor.view(np.int64), fragment.view(np.int64), first.astype(np.int32), last.astype(np.int32))],
                        names=["k1", "k2", "anchor", "fragment", "first", "last"],
                    )

    return run


def _bodies(unit: str, width: int) -> Callable:
    """Cuts the text of the wanted runs out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = dict(shard=pa.int64(), salt=pa.int32(), anchor=pa.int64(), fragment=pa.int64(), ways=pa.int32(), body=pa.binary())
        for batch in batches:
            out: dict[str, list] = {n: [] for n in types}
            for text, runs in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                seq = raw.split() if unit == "words" else raw
                for r in runs.as_py():
                    piece = seq[r["first"] : r["last"] + width]
                    for n in ("shard", "salt", "anchor", "fragment", "ways"):
                        out[n].append(r[n])
                    out["body"].append(b" ".join(piece) if unit == "words" else piece)
            yield pa.RecordBatch.from_arrays([pa.array(v, types[n]) for n, v in out.items()], names=list(out))

    return run


def window_keys(bodies: list[bytes], unit: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the text of every window as a fixed-length byte string, number of windows of each body).

    For words the string is made of their numbers in a vocabulary of the given
    bodies. Trailing zeros, which numpy drops, can't make strings of one length equal.
    """
    if unit == "words":
        split = [b.split(b" ") for b in bodies]
        sizes = np.array([len(s) for s in split])
        number = Numbering()
        codes = np.array([number[w] for s in split for w in s]).astype(">u4")
        flat, step = codes.view(np.uint8), 4
    else:
        flat, step = np.frombuffer(b"".join(bodies), np.uint8), 1
        sizes = np.array([len(b) for b in bodies])
    per = sizes - width + 1
    begin = np.cumsum(sizes) - sizes
    start = np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(per.sum())
    view = np.lib.stride_tricks.sliding_window_view(flat, width * step)[start * step]
    return np.ascontiguousarray(view).view(f"S{width * step}").ravel(), per


def fingerprints(bodies: list[bytes], unit: str, width: int) -> np.ndarray:
    """A 128-bit fingerprint of every window, alike in every shard."""
    out = []
    for b in bodies:
        data = np.frombuffer(b, np.uint8)
        u, _ = (word_units if unit == "words" else byte_units)(data, np.array([0, len(data)]))
        n = len(u) - width + 1
        two = [gram_hashes(x, (width,))[width][:n] for x in (u, mix(u.astype(np.uint64) ^ np.uint64(0x632BE59BD9B4E019)))]
        out.append(np.stack(two, axis=1).view("S16").ravel())
    return np.concatenate(out) if out else np.zeros(0, "S16")


def spans_of(hit: np.ndarray, per: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each body the runs [a, b] of windows that were hit."""
    out, at = [], 0
    for n in per:
        h = np.flatnonzero(np.diff(np.concatenate([[0], hit[at : at + n].view(np.int8), [0]])))
        out.append([(int(a), int(b) - 1) for a, b in zip(h[::2], h[1::2])])
        at += n
    return out


def by_confirming(confirm: Callable) -> Callable:
    """``locate`` for a ``confirm(keys, per)`` that says of each window in its place whether it occurs twice in the shard."""

    def run(bodies: list[bytes], keys: np.ndarray, per: np.ndarray, known: np.ndarray) -> list[list[tuple[int, int]]]:
        return spans_of(confirm(keys, per) | known, per)

    return run


def find_runs(keyed: DataFrame, unit: str, width: int, k: int) -> DataFrame:
    """The runs of all documents, staged: k1, k2, anchor, fragment, first, last."""
    units = word_units if unit == "words" else byte_units
    return staged(keyed.select("k1", "k2", "text").mapInArrow(releasing(_cut(units, width, k)), _RUNS), "runs")


def run_texts(keyed: DataFrame, placed: DataFrame, unit: str, width: int) -> DataFrame:
    """shard, salt, anchor, fragment, ways, body: the text of runs (k1, k2, run)."""
    wanted = placed.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))
    # equal rows of documents share k1 and k2; one of them is enough
    texts = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    return texts.select("text", "runs").mapInArrow(releasing(_bodies(unit, width)), _SIZED)


def find_spans(docs: DataFrame, unit: str, width: int, k: int, locate: Callable, shard_runs: int = SHARD_RUNS, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans k1, k2, spans array<struct<a, b>>): units [a, b) of a document are covered.

    ``locate(bodies, keys, per, known)`` gets the texts of one shard, their windows and which of those are known to occur in
    another shard, and gives for each text the runs [a, b] of windows that are known or occur twice in the shard. Spans of one document may overlap. Null texts count as empty.
    ``held`` (anchor, fragment, body) are runs of other documents, which count as occurrences too.
    """
    keyed = _keyed(docs)
    runs = find_runs(keyed, unit, width, k)
    # staged, so that both sides of the join are plain exchanges and Spark can split a hot anchor
    seen = runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    if held is not None:
        seen = seen.union(held.select("anchor").join(runs.select("anchor").distinct(), "anchor", "left_semi")).distinct()
    seen = staged(seen, "seen")
    met = staged(runs.join(seen, "anchor"), "met")

    # one place of each distinct run, and a second one (perhaps of an equal row) of those that occur again
    at = F.struct("k1", "k2", "first", "last")
    distinct = staged(met.groupBy("anchor", "fragment").agg(F.count("*").alias("copies"), F.min(at).alias("one"), F.max(at).alias("other")), "distinct")
    every = distinct.select("anchor")
    if held is not None:
        held = staged(held.select("anchor", "fragment", "body").join(seen, "anchor", "left_semi"), "held")
        every = every.unionAll(held.select("anchor"))
    shards = max(1, -(-every.count() // shard_runs))
    hot = every.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > shard_runs)
    hot = staged(hot.select("anchor", F.ceil(F.col("n") / shard_runs).cast("int").alias("ways")), "hot")
    dealt = distinct.join(hot, "anchor", "left").withColumn("at", F.explode(F.when(F.col("copies") > 1, F.array("one", "other")).otherwise(F.array("one"))))
    shard = F.when(F.col("ways").isNull(), F.pmod("anchor", F.lit(shards))).otherwise(F.col("anchor")).alias("shard")
    salt = F.when(F.col("ways").isNull(), F.lit(-1)).otherwise(F.pmod("fragment", F.col("ways"))).cast("int").alias("salt")
    place = [shard, salt, "anchor", "fragment", F.coalesce("ways", F.lit(1)).alias("ways")]
    bodies = run_texts(keyed, dealt.select("at.k1", "at.k2", F.struct(*place, "at.first", "at.last").alias("run")), unit, width)
    if held is not None:
        bodies = bodies.unionByName(held.join(hot, "anchor", "left").select(*place, "body"))
    bodies = staged(bodies, "bodies")

    def answer(table: pa.Table) -> pa.Table:
        return judged(table, np.zeros(0, "S16"))

    def judged(table: pa.Table, also: np.ndarray) -> pa.Table:
        texts = table.column("body").to_pylist()
        keys, per = window_keys(texts, unit, width)
        known = np.isin(fingerprints(texts, unit, width), also) if len(also) else np.zeros(len(keys), bool)
        # of a run that came twice the first
        run, spans, done = list(zip(table.column("anchor").to_pylist(), table.column("fragment").to_pylist())), locate(texts, keys, per, known), {}
        for r, found in zip(run, spans):
            if found:
                done.setdefault(r, found)
        return pa.table({
            "anchor": pa.array([r[0] for r in done], pa.int64()), "fragment": pa.array([r[1] for r in done], pa.int64()),
            "spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in done.values()], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
        })

    def ask(table: pa.Table) -> pa.Table:
        """The distinct fingerprints of one shard's windows, dealt to ``ways`` by their value."""
        prints, ways = np.unique(fingerprints(table.column("body").to_pylist(), unit, width)), table.column("ways")[0].as_py()
        way = (prints.view(np.uint64).reshape(-1, 2)[:, 0] % np.uint64(ways)).astype(int)
        n = len(np.unique(way))
        anchor, salt = table.column("anchor")[0].as_py(), table.column("salt")[0].as_py()
        return pa.table({"anchor": pa.array([anchor] * n, pa.int64()), "way": pa.array(np.unique(way), pa.int32()), "salt": pa.array([salt] * n, pa.int32()), "prints": pa.array([prints[way == w].tobytes() for w in np.unique(way)], pa.binary())})

    def tell(table: pa.Table) -> pa.Table:
        """To each shard: those of its fingerprints that another shard has too."""
        sets = [np.frombuffer(p, "S16") for p in table.column("prints").to_pylist()]
        every, n = np.unique(np.concatenate(sets), return_counts=True)
        twice = every[n > 1]
        return pa.table({"anchor": table.column("anchor"), "salt": table.column("salt"), "prints": pa.array([s[np.isin(s, twice)].tobytes() for s in sets], pa.binary())})

    def with_told(table: pa.Table, told: pa.Table) -> pa.Table:
        return judged(table, np.concatenate([np.zeros(0, "S16"), *(np.frombuffer(p, "S16") for p in told.column("prints").to_pylist())]))

    found = bodies.filter("salt < 0").groupBy("shard").applyInArrow(answer, _FOUND)
    if not hot.isEmpty():
        split = bodies.filter("salt >= 0")
        told = split.groupBy("anchor", "salt").applyInArrow(ask, "anchor long, way int, salt int, prints binary").groupBy("anchor", "way").applyInArrow(tell, "anchor long, salt int, prints binary")
        found = found.unionByName(split.groupBy("anchor", "salt").cogroup(told.groupBy("anchor", "salt")).applyInArrow(with_told, _FOUND))

    # staged for the same reason as ``seen``
    spans = met.join(staged(found, "found"), ["anchor", "fragment"])
    spans = spans.select("k1", "k2", F.transform("spans", lambda s: F.struct((F.col("first") + s["a"]).alias("a"), (F.col("first") + s["b"] + width).alias("b"))).alias("s"))
    return keyed, spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted and joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
