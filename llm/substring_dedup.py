"""Substring dedup (operator 6): repeated phrases, located by Aho-Corasick automata over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Numbering, by_bytes, flat_bytes, raw_texts, releasing
from .repeats import CHUNK, SHARD_RUNS, find_spans, merged

#: Words of a window, and of the grams that bring possible matches together.
WIDTH, GRAM = 35, 8


def passages(keys: np.ndarray, per: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """The recurring passages of a shard, each once: runs [a, b] of windows, numbered over all texts, at one place.

    A window recurs if it occurs twice or is known to occur in another shard. Two neighbours belong to one passage
    if each occurrence of one goes with one of the other; so a passage is whole wherever one of its windows is.
    """
    if not len(keys):
        return []
    _, first, back, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    wanted = n > 1
    wanted[back[known]] = True
    inner = np.ones(len(keys), bool)
    inner[np.cumsum(per) - 1] = False
    at = np.flatnonzero(inner)
    pair = back[at] * np.int64(len(n)) + back[at + 1]
    _, same, together = np.unique(pair, return_inverse=True, return_counts=True)
    joined = np.zeros(len(keys), bool)
    joined[at] = (together[same] == n[back[at]]) & (together[same] == n[back[at + 1]])
    places = np.sort(first[wanted])
    if not len(places):
        return []
    begins = np.append(True, (np.diff(places) > 1) | ~joined[places[:-1]])
    ends = np.append(begins[1:], True)
    return list(zip(places[begins].tolist(), places[ends].tolist()))


def locate(bodies: list[bytes], keys: np.ndarray, per: np.ndarray, known: np.ndarray, width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """Where the confirmed passages of a shard occur in its texts: runs [a, b] of windows of each text.

    Each passage, known from one place only, is compiled as a sequence of word numbers into one automaton, through
    which every text of the shard streams; all places come from what it finds.
    """
    number = Numbering()
    texts = [tuple(map(number.__getitem__, b.split(b" "))) for b in bodies]
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    begin = np.cumsum(per) - per
    for a, b in passages(keys, per, known):
        text = int(np.searchsorted(begin, a, "right")) - 1
        start = a - int(begin[text])
        auto.add_word(texts[text][start : start + b - a + width])
    if not len(auto):
        return [[] for _ in texts]
    auto.make_automaton()
    return [[(end + 1 - n, end + 1 - width) for end, n in auto.iter(text)] for text in texts]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
    for batch in batches:
        data, offsets = flat_bytes(batch.column(1))
        for a, b in by_bytes(offsets, CHUNK):
            part = batch.slice(a, b - a)
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "spans": []}
            for raw, found in zip(raw_texts(data, offsets[a : b + 1]), part.column(2)):
                w, cut = raw.split(), merged(found.as_py())
                kept = w if not cut else [x for s, e in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(w)]) for x in w[s:e]]
                text = b" ".join(kept)
                out["n_words"].append(len(w))
                out["n_removed"].append(len(w) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                out["kept"].append(text.decode("utf-8", "replace"))
                out["spans"].append([{"a": x, "b": y} for x, y in cut])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types))], names=["doc_id", *out])


def remove_phrases(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """Cuts every word covered by a window of ``width`` words that also starts anywhere else.

    docs: doc_id, text, and any more columns, which are not used. Passages are confirmed as
    text in shards; each shard compiles its passages into an automaton of bounded size and streams
    the candidate stretches of all documents through it, each distinct stretch once. Returns one
    row per document: doc_id, n_words, n_removed, kept_sha256, kept (words joined by
    one space) and spans (word positions). Null and empty texts have 0 words;
    texts shorter than ``width`` words are never cut; equal rows are copies of
    each other and both go; an empty table gives no rows; very long texts are searched whole, in slices.
    """
    keyed, spans = find_spans(docs, "words", width, gram, partial(locate, width=width), shard_runs)
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(releasing(_clean), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<a:int,b:int>>")
