"""Packing (operator 5): token sequences of fixed length, filled by minimum bin slack."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Numbering, by_bytes, flat_bytes, raw_texts, releasing, staged, text_of

CAPACITY = 2048
END_ID = 1
#: Tokens of cut-off ends that wait, so that a window has many lengths to choose from.
RESERVE = 64 * CAPACITY
#: Partitions whose last ends are packed together, and the first sequence id of that round.
GROUP, REST_IDS = 64, 1 << 61
#: Bytes of text tokenised together (one word more at most).
CHUNK = 1 << 21
#: Words encoded in one call, and the word between them there.
WORDS, BETWEEN = 1024, "\x01"
#: Distinct words that a Python worker remembers before it starts anew.
CACHE_WORDS = 1_500_000


_SPACE = re.compile(SPACE.encode())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts by a tokenizer that drops white space: each distinct word is encoded once.

    Words are split at ASCII white space only, which no token crosses; the ids of
    the known words lie one after another in one array.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.number = Numbering()
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text), of strings without nulls."""
        if len(self.number) > self.most:
            self._clear()
        known, number = len(self.number), self.number
        # Arrow finds the distinct words (an empty one before leading white space has no ids), so that Python looks up few
        lists = pc.ascii_split_whitespace(texts)
        found = lists.flatten().dictionary_encode()
        codes = number.codes(raw_texts(*flat_bytes(found.dictionary)))
        if len(number) > known:
            self._encode_words(list(islice(reversed(number), len(number) - known))[::-1])
        word = found.indices.to_numpy()
        size = (self.start[codes + 1] - self.start[codes])[word]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(self.start[codes][word] - (ends - size), size) + np.arange(total)]
        bound = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        return out, np.diff(np.append(0, ends)[bound])

    def _encode_words(self, words: list[bytes]) -> None:
        # in slices: an encoding holds far more than its ids
        found = [self._ids_of([w.decode("utf-8", "replace") for w in words[a : a + WORDS]]) for a in range(0, len(words), WORDS)]
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate([sizes for sizes, _ in found]))])
        self.ids = np.concatenate([self.ids, *(ids for _, ids in found)])

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all), in one call; where a word holds the id of BETWEEN too, one by one."""
        if len(self.between) == 1:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.between[0])
            if len(at) == len(words) - 1:
                return np.diff(at, prepend=-1, append=len(ids)) - 1, np.delete(ids, at)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)

    def encode_long(self, text: bytes) -> np.ndarray:
        """Ids of one text, encoded in slices of CHUNK bytes that end at white space."""
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + CHUNK)
            end = cut.start() if cut else len(text)
            out.append(self.encode(pa.array([text[at:end]], pa.binary()).view(pa.string()))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


@lru_cache(maxsize=1)
def word_ids(path: str, most: int) -> WordIds:
    """One for each Python worker, which encodes in one thread: Spark gives each task a core of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path, most)


class Pool:
    """Ends of documents that wait for a window, by length; ``fill`` takes the multiset with least slack."""

    def __init__(self) -> None:
        self.by_length: dict[int, list] = {}
        #: Its keys, rising.
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, length: int, item) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append(item)
        self.tokens += length

    def fill(self, capacity: int) -> list:
        """Takes the items whose lengths sum nearest to ``capacity``, the longest always among them.

        Bit s of ``reach`` says that some of the lengths seen so far sum to s. A
        length that occurs c times enters as groups of 1, 2, 4, ... copies; the
        counts are then read off backwards. It stops as soon as the sum is exact.
        """
        longest = self.lengths[-1]
        want = capacity - longest
        mask, reach, steps = (1 << want + 1) - 1, 1, []
        for length in reversed(self.lengths[: bisect_right(self.lengths, want)]):
            left = min(len(self.by_length[length]) - (length == longest), want // length)
            group = 1
            while left > 0:
                n = min(group, left)
                steps.append((length, n, reach))
                reach |= reach << n * length & mask
                left, group = left - n, group * 2
            if reach >> want & 1:
                break
        at = reach.bit_length() - 1
        counts = {longest: 1}
        for length, n, before in reversed(steps):
            if not before >> at & 1:
                counts[length] = counts.get(length, 0) + n
                at -= n * length
        out = []
        for length, n in counts.items():
            for _ in range(n):
                out.append(self.by_length[length].pop())
            if not self.by_length[length]:
                del self.by_length[length], self.lengths[bisect_left(self.lengths, length)]
            self.tokens -= n * length
        return out


class Sequences:
    """Pieces as rows: each belongs to one sequence, at an offset in it."""

    NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "loose")

    def __init__(self, kind: pa.DataType, first: int, with_ids: bool) -> None:
        self.kind, self.number, self.with_ids = kind, first, with_ids
        self.rows: dict[str, list] = {n: [] for n in self.NAMES}

    def _put(self, *values) -> None:
        for n, v in zip(self.NAMES, values):
            self.rows[n].append(v)

    def window(self, items: list) -> None:
        """One sequence of (document, its tokens, start, ids)."""
        offset = 0
        for doc, total, start, ids in items:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
            self._put(doc, start, len(ids), crc, total, self.number, offset, ids.astype(np.int32) if self.with_ids else None, None)
            offset += len(ids)
        self.number += 1

    def wait(self, item, group: int, place: int) -> None:
        """A piece that no sequence of this partition takes up exactly; its place keeps an order among them."""
        doc, total, start, ids = item
        self._put(doc, start, len(ids), None, total, self.number, place, ids.astype(np.int32), group)

    def flush(self) -> pa.RecordBatch:
        types = [self.kind, *[pa.int64()] * 6, pa.list_(pa.int32()), pa.int64()]
        arrays = [pa.array(self.rows[n], t) for n, t in zip(self.NAMES, types)]
        for v in self.rows.values():
            v.clear()
        return pa.RecordBatch.from_arrays(arrays, names=list(self.NAMES))


def _pack(path: str, capacity: int, end_id: int, with_ids: bool, cache_words: int):
    """First round: one partition by itself. What fills no sequence exactly is left for the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        pool, out = Pool(), None
        for batch in batches:
            out = out or Sequences(batch.schema.field(0).type, partition << 40, with_ids)
            text = batch.column(1)
            data, offsets = flat_bytes(text)
            docs = batch.column(0).to_pylist()
            for a, b in by_bytes(offsets, CHUNK):
                if offsets[b] - offsets[a] > CHUNK:  # one long text
                    flat = word_ids(path, cache_words).encode_long(data[offsets[a] : offsets[b]].tobytes())
                    sizes = np.array([len(flat)])
                else:
                    flat, sizes = word_ids(path, cache_words).encode(text.slice(a, b - a))
                at = 0
                for doc, n in zip(docs[a:b], sizes.tolist()):
                    ids = np.append(flat[at : at + n], np.uint32(end_id))
                    at += n
                    total = n + 1
                    for start in range(0, total - capacity + 1, capacity):
                        out.window([(doc, total, start, ids[start : start + capacity])])
                    rest = total % capacity
                    if rest:
                        pool.add(rest, (doc, total, total - rest, ids[total - rest :].copy()))
                while pool.tokens > RESERVE:
                    out.window(pool.fill(capacity))
                yield out.flush()
        place = 0
        while pool.tokens:
            items = pool.fill(capacity)
            if sum(len(i[3]) for i in items) == capacity:
                out.window(items)
            else:
                for item in items:
                    out.wait(item, partition // GROUP, place)
                    place += 1
        if out is not None:
            yield out.flush()

    return run


def _pack_rest(capacity: int, with_ids: bool):
    """Second round: what GROUP partitions have left over; the last sequences are cut to powers of two."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        out = Sequences(table.schema.field("doc_id").type, REST_IDS + (table.column("loose")[0].as_py() << 40), with_ids)
        pool = Pool()
        columns = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start"))
        for doc, total, start, ids in zip(*columns, table.column("ids")):
            pool.add(len(ids), (doc, total, start, ids.values.to_numpy().astype(np.uint32)))
        loose = []
        while pool.tokens:
            items = pool.fill(capacity)
            if sum(len(i[3]) for i in items) == capacity:
                out.window(items)
            else:
                loose += items
        left = sum(len(i[3]) for i in loose)
        sizes = [capacity] * (left // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if left % capacity >> k & 1]
        loose.reverse()
        for size in sizes:
            items, room = [], size
            while room:
                doc, total, start, ids = loose.pop()
                items.append((doc, total, start, ids[:room]))
                if len(ids) > room:
                    loose.append((doc, total, start + room, ids[room:]))
                room -= len(items[-1][3])
            out.window(items)
        return pa.Table.from_batches([out.flush()])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every partition is packed by itself in one pass, without a shuffle: a document
    fills whole sequences while it can; its end waits in a pool of bounded size,
    from which minimum bin slack fills sequences. The few ends that no sequence takes up
    exactly (less than RESERVE tokens a partition) meet those of GROUP partitions in a second round, whose last
    sequences are cut to be powers of two long. Null and empty texts have the one closing
    id; equal rows are packed each; documents with null ids too; more columns are not used;
    an empty table gives no rows; very long texts are encoded in slices that end at white space. Sequence ids rise by one within a partition.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, loose long"
    first = _pack(tokenizer or default_tokenizer(), capacity, end_id, with_ids, cache_words)
    pieces = staged(docs.select("doc_id", text_of().alias("text")).mapInArrow(releasing(first), schema), "pieces")
    rest = pieces.filter("loose IS NOT NULL").groupBy("loose").applyInArrow(_pack_rest(capacity, with_ids), schema)
    return pieces.filter("loose IS NULL").select(*names).unionAll(rest.select(*names))
