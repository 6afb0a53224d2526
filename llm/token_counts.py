"""Token counts (operator 3): byte-pair merges applied to ragged arrays of whole batches at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, by_bytes, flat_bytes, text_of

LIMIT = 4096
#: Bytes of text whose pre-tokens are merged together (one document more at most).
CHUNK = 16 << 20
#: Pre-tokens that are merged side by side.
PRETOKENS = 1 << 20
_NONE = np.int32(2**31 - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _normalised(sp) -> str | None:
    """A text that the model changes by more than a space in front and its own sign for spaces; None if it leaves all as they are."""
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(every[a : a + 256]) for a in range(0, len(every), 256)]
    # white space at both ends and in runs; letters that would be composed
    for text in ["a", " a", "a ", " \t a  b\n\n c ", "e\u0301", "\u1100\u1161", *blocks]:
        if sp.normalize(text) != "▁" + text.replace(" ", "▁"):
            return text
    return None


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model makes of texts.

    The model must leave the text as it is but for a space put in front, and no
    piece may have a space after another character; pre-tokens are then runs of
    spaces with what follows up to the next space. Characters that occur in no
    piece, as the line feed, split too. A character without a piece counts as its bytes.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        changed = _normalised(sp)
        if changed is not None:
            raise ValueError(f"the model normalises texts: {changed!r}")
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        score = np.array([sp.get_score(i) for i in ids])
        bad = [p for p in pieces if re.search("[^▁]▁", p)]
        if bad:
            raise ValueError(f"a piece has a space inside: {bad[0]!r}")
        rank_of = dict(zip(pieces, (np.unique(-score, return_inverse=True)[1]).tolist()))
        self.symbol = {p: i for i, p in enumerate(pieces)}
        self.has_piece = len(pieces)
        for c in {c for p in pieces for c in p} - set(pieces):
            self.symbol[c] = len(self.symbol)
        if "\n" in self.symbol:
            raise ValueError("the line feed is part of a piece")
        pairs, risky = {}, set()
        for p in pieces:
            for i in range(1, len(p)):
                a, b = self.symbol.get(p[:i]), self.symbol.get(p[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank_of[p], self.symbol[p])
                    # merging what makes a part could be overtaken by this piece
                    risky |= {rank_of[x] for x in (p[:i], p[i:]) if len(x) > 1 and rank_of[x] >= rank_of[p]}
        # an open hash table: a pair lies at most ``probes`` places after its own
        self.bits = max(16, int(len(pairs)).bit_length() + 3)
        size, self.probes = 1 << self.bits, 0
        self.keys = np.full(size, -1, np.int64)
        self.ranks, self.made = np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        places = self._place(np.array(list(pairs), np.int64)).tolist()
        for (key, (rank, made)), at in zip(pairs.items(), places):
            n = 0
            while self.keys[at] >= 0:
                at, n = (at + 1) % size, n + 1
            self.keys[at], self.ranks[at], self.made[at] = key, rank, made
            self.probes = max(self.probes, n)
        self.risky = np.zeros(max(rank_of.values()) + 2, bool)
        self.risky[list(risky)] = True
        self.chars = np.full(0x110000, -1, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.chars[ord(c)] = i
        self.split = re.compile(r" +[^ \n]*|[^ \n]+")

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, _NONE if it makes no piece, and the piece it makes."""
        key = a.astype(np.int64) << 32 | b
        at = self._place(key)
        found = self.keys[at]
        rank, made = np.where(found == key, self.ranks[at], _NONE), self.made[at]
        todo = np.flatnonzero((found != key) & (found >= 0))
        at = at[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) % len(self.keys)
            found = self.keys[at]
            hit = found == key[todo]
            rank[todo[hit]], made[todo[hit]] = self.ranks[at[hit]], self.made[at[hit]]
            more = ~hit & (found >= 0)
            at, todo = at[more], todo[more]
        return rank, made

    def count_pretokens(self, words: list[str]) -> np.ndarray:
        """Pieces of each pre-token, all merged side by side.

        In every round each sequence merges its pair of lowest rank, wherever it
        occurs, from the left; where a merge could make a pair of no higher rank, only
        the leftmost is merged, so that the order is that of a priority queue.
        """
        total = np.zeros(len(words), np.int64)
        if not words:
            return total
        size = np.array([len(w) for w in words])
        point = np.frombuffer("".join(words).replace(" ", "▁").encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.chars[point]
        weight = np.where((sym >= 0) & (sym < self.has_piece), 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)).astype(np.int64)
        seq = np.repeat(np.arange(len(words)), size)

        def pair_ranks(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            r, m = self._look(sym[i], sym[i + 1])
            r[(seq[i] != seq[i + 1]) | (sym[i] < 0) | (sym[i + 1] < 0)] = _NONE
            return r, m

        rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], made[:-1] = pair_ranks(np.arange(len(sym) - 1))
        while len(sym):
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, starts)
            lens = np.diff(np.append(starts, len(sym)))
            live = best != _NONE
            if not live.all():
                sums = np.add.reduceat(weight, starts)
                total[seq[starts[~live]]] = sums[~live]
                keep = np.repeat(live, lens)
                sym, weight, seq, rank, made = (x[keep] for x in (sym, weight, seq, rank, made))
                best, lens = best[live], lens[live]
                if not len(sym):
                    break
                starts = np.cumsum(lens) - lens
            pick = np.flatnonzero(rank == np.repeat(best, lens))
            owner = np.repeat(np.arange(len(lens)), lens)[pick]
            first = np.append(True, owner[1:] != owner[:-1])
            # of overlapping pairs every second one, from the left; of risky ones the leftmost
            chain = np.append(True, pick[1:] != pick[:-1] + 1)
            begin = np.maximum.accumulate(np.where(chain, np.arange(len(pick)), 0))
            take = np.where(self.risky[best[owner]], first, (np.arange(len(pick)) - begin) % 2 == 0)
            at = pick[take]
            sym[at], weight[at] = made[at], 1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, weight, seq, rank, made = (x[keep] for x in (sym, weight, seq, rank, made))
            at = place[at]
            rank[at] = _NONE
            near = np.zeros(len(sym), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            near[-1] = False
            again = np.flatnonzero(near)
            rank[again], made[again] = pair_ranks(again)
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Pieces of each text.

        Pre-tokens are merged in slices of PRETOKENS, so that a very long text takes
        few times its own size.
        """
        total = np.array([t.count("\n") for t in texts], np.int64)
        found = ((i, w.group()) for i, t in enumerate(texts) if t for w in self.split.finditer(" " + t.replace("▁", " ")))
        while part := list(islice(found, PRETOKENS)):
            number = Numbering()
            codes = number.codes(w for _, w in part)
            each = self.count_pretokens(list(number))[codes]
            total += np.bincount(np.fromiter((i for i, _ in part), np.int64), each, len(texts)).astype(np.int64)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter for each Python worker and model."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document.

    Without begin and end tokens; special strings inside a text are ordinary text.
    Null and empty texts have 0 bytes and tokens; more columns are not used; equal
    rows are counted each, rows without a doc_id too; an empty table gives no rows; very long
    texts are counted whole, in slices.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat_bytes(batch.column(1))
            for a, b in by_bytes(offsets, CHUNK):
                part = batch.slice(a, b - a)
                n = counter(path).count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets[a : b + 1])), pa.array(n.astype(np.int64)), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
