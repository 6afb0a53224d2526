"""Quality classifier (operator 7): a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, flat_bytes, releasing, space_mask, text_of, words_of
from .repeats import word_units

#: Documents that the field is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_DOCS = 4000
#: Lines that these have together, at most: what the driver fits on is bounded by it. Of these one document may make one part in so many.
TRAIN_LINES, LONGEST = 200_000, 100
#: Lines whose features with their neighbours' are held at a time.
LINES = 1 << 14
STEPS, RATE, SHRINK = 200, 0.1, 1e-3
SEED = 11
CHUNK = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lengths in bytes, number of lines of each text).

    Lines end at line feeds; a text has one more lines than line feeds, so an empty
    text has one empty line.
    """
    docs = len(offsets) - 1
    buf = np.insert(data, offsets[1:], np.uint8(10))  # a line feed behind every text
    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    per = np.diff(np.append(0, np.searchsorted(ends, offsets[1:] + np.arange(docs), "right")))
    size = ends - starts
    upper, lower, wide, words, digit, plain, symbol, bang, bar, white, same, glued, capital, echo = _line_counts(buf, starts, ends).T
    letters = upper + lower + wide
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    f = np.stack([
        np.log1p(size), np.log1p(words), letters / n, upper / n, digit / n, plain / w, symbol / w, bang / w, bar / w, (size - white) / w, same / n, glued / w,
        capital / w, (letters == 0).astype(float), np.where(size > 0, buf[np.maximum(ends - 1, 0)] == ord("."), 0).astype(float), wide / n, echo / w,
    ], axis=1)
    return f, size, per


def _line_counts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What each line holds, a column for each kind, summed up in slices of about CHUNK bytes that end at white space.

    So a very long text, or line, takes few times its own size.
    """
    out, a, last = np.zeros((len(ends), 14)), 0, (-1, np.uint64(0))
    while a < len(buf):
        b = min(a + CHUNK, len(buf))
        while b < len(buf) and not space_mask(buf[b : b + 1])[0]:
            gap = np.flatnonzero(space_mask(buf[b : b + CHUNK]))
            b = b + int(gap[0]) if len(gap) else min(b + CHUNK, len(buf))
        x, before = buf[a:b], buf[a - 1] if a else np.uint8(10)
        i, j = np.searchsorted(ends, a), np.searchsorted(starts, b)
        low, high = np.maximum(starts[i:j], a) - a, np.minimum(ends[i:j], b) - a
        ahead = np.append(before, x[:-1])
        white, ahead_white = space_mask(x), space_mask(ahead)
        upper, lower, digit, wide = (x >= 65) & (x <= 90), (x >= 97) & (x <= 122), (x >= 48) & (x <= 57), x >= 128
        mark = ~(white | upper | lower | digit | wide)
        usual = np.isin(x, np.frombuffer(b".,;:'\"-()?", np.uint8))
        first = ahead_white & ~white
        bar = np.isin(x, np.frombuffer(b"|{}<>=/\\_[]", np.uint8))
        kinds = (upper, lower, wide, first, digit, mark & usual, mark & ~usual, x == ord("!"), bar, white, x == ahead, mark & ~ahead_white & ~usual, upper & first)
        for k, mask in enumerate(kinds):
            sums = np.append(np.int32(0), np.cumsum(mask, dtype=np.int32))
            out[i:j, k] += sums[high] - sums[low]
        # words equal to the word before them in the line
        begin, _, _ = words_of(x, np.array([0, len(x)]))
        if len(begin):
            unit, line = np.append(last[1], word_units(x, np.array([0, len(x)]))[0]), np.append(last[0], np.searchsorted(ends, begin + a))
            out[:, 13] += np.bincount(line[1:][(unit[1:] == unit[:-1]) & (line[1:] == line[:-1])], minlength=len(ends))
            last = line[-1], unit[-1]
        a = b
    return out


def with_neighbours(f: np.ndarray, size: np.ndarray, per: np.ndarray, a: int, b: int) -> np.ndarray:
    """Features of lines a to b with those of the lines before and after them in the text (zeros beyond it, with flags for both ends)."""
    last = np.cumsum(per) - 1
    doc_end = np.zeros(len(f) + 1, bool)
    doc_end[last] = True
    doc_end[-1] = True  # before the first line
    at = np.arange(a, b)
    starts, ends = doc_end[at - 1], doc_end[at]
    before, after = f[at - 1], f[np.minimum(at + 1, len(f) - 1)]
    before[starts] = 0
    after[ends] = 0
    repeated = ((np.abs(before - f[a:b]).sum(axis=1) < 1e-12) & (size[a:b] > 0)).astype(float)
    return np.column_stack([f[a:b], before, after, starts, ends, repeated, np.ones(b - a)])


@dataclass
class Field:
    """weights: log odds of a good line by feature; link: log potential of staying bad, turning good, turning bad, staying good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    link: np.ndarray

    def odds(self, f: np.ndarray, size: np.ndarray, per: np.ndarray) -> np.ndarray:
        parts = [with_neighbours(f, size, per, a, min(a + LINES, len(f))) for a in range(0, len(f), LINES)]
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights for x in parts])


def forward_backward(u: np.ndarray, per: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of good for each line, expected uses of the four links of each document, sum of log Z).

    u holds the log odds of all lines; all documents step on together.
    """
    order = np.argsort(-per, kind="stable")
    begin = (np.cumsum(per) - per)[order]
    size = per[order]
    longest = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]  # documents with more than t lines
    t_link = np.exp(link.reshape(2, 2))
    good = 1 / (1 + np.exp(-np.clip(u, -50, 50)))
    emit = np.stack([1 - good, good], axis=1)  # scaled potentials
    alpha, log_z = np.zeros((len(u), 2)), -np.log(np.maximum(1 - good, 1e-300)).sum()
    for t in range(longest):
        at = begin[: live[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ t_link) * emit[at]
        s = a.sum(axis=1, keepdims=True)
        log_z += np.log(s).sum()
        alpha[at] = a / s
    beta = np.ones((len(u), 2))
    use = np.zeros((len(per), 4))
    for t in range(longest - 2, -1, -1):
        n = live[t + 1]
        at = begin[:n] + t
        nxt = emit[at + 1] * beta[at + 1]
        both = alpha[at][:, :, None] * t_link[None] * nxt[:, None, :]
        use[order[:n]] += (both / both.sum(axis=(1, 2), keepdims=True)).reshape(n, 4)
        b = nxt @ t_link.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    m = alpha * beta
    return m[:, 1] / m.sum(axis=1), use, log_z


def fit(x: np.ndarray, per: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> Field:
    """Maximum likelihood by Adam; every line of a document bears the document's label."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[scale == 0], scale[scale == 0] = 0, 1
    field = Field(mean, scale, np.zeros(x.shape[1]), np.zeros(4))
    z = np.clip((x - mean) / scale, -8, 8)
    line = np.repeat(label, per).astype(float)
    stay = np.where(label == 1, 3, 0)
    seen = np.bincount(stay, np.maximum(per - 1, 0), minlength=4)
    n = len(per)
    # each document counts alike, whatever its number of lines
    weight = 1 / per
    by_line = np.repeat(weight, per)
    seen = np.bincount(stay, np.maximum(per - 1, 0) * weight, minlength=4)
    theta, m, v = np.zeros(len(field.weights) + 4), 0.0, 0.0
    for i in range(1, steps + 1):
        p, use, _ = forward_backward(z @ theta[:-4], per, theta[-4:])
        g = np.concatenate([z.T @ ((line - p) * by_line), seen - (use * weight[:, None]).sum(axis=0)]) / n - shrink * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    field.weights, field.link = theta[:-4], theta[-4:]
    return field


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat_bytes(batch.column(1))
        for i in range(len(batch)):
            f, size, per = line_features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            x = with_neighbours(f, size, per, 0, len(f)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([x.tobytes()], pa.binary()), pa.array([len(x)], pa.int64())], names=["quality", "x", "lines"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Field | None:
    """Fits the field on labelled documents that are not held out: ``most`` at most, with ``most_lines`` lines at most.

    They come in the order of a hash of their ids, without those that alone make over a hundredth of the lines; so a
    long document shuts out no other, and a hundred at least fit in. Those whose lines would pass the bound are left out. Null labels and documents without a label are not used; of several labels of a
    document the smallest counts. None if there is no document of either label.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(2 * most)
    text = text_of()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"), (F.regexp_count(text, F.lit("\n")) + 1).alias("lines")).join(F.broadcast(sample), "doc_id")
    # ids, hashes and counts only: the texts stay where they are
    order = F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.col("hash")
    first = rows.filter(F.col("lines") <= max(1, most_lines // LONGEST)).select("doc_id", "hash", "lines").distinct().orderBy(*order).limit(most)
    so_far = F.sum("lines").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("so_far", so_far).filter(F.col("so_far") <= most_lines).select("doc_id", "hash")
    found = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.first("quality").alias("quality"), F.first("text").alias("text"))
    got = found.select("quality", "text").mapInArrow(releasing(_featured), "quality int, x binary, lines long").collect()
    got.sort(key=lambda r: (r.lines, r.x))
    label = np.array([int(r.quality == 1) for r in got])
    if len(set(label.tolist())) < 2:
        return None
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(r.lines, -1) for r in got]).astype(np.float64)
    return fit(x, np.array([r.lines for r in got]), label)


def _scores(data: np.ndarray, offsets: np.ndarray, field: Field | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their scores, their numbers of lines), in bounded slices of rows."""
    for a, b in by_bytes(offsets, CHUNK):
        f, size, per = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        p = np.full(len(f), 0.5) if field is None else forward_backward(field.odds(f, size, per), per, field.link)[0]
        first = np.cumsum(per) - per
        yield a, b, np.add.reduceat(p * (size + 1), first) / np.add.reduceat(size + 1.0, first), per


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, n_lines of each document.

    The score is the mean of the lines' marginals weighted by their length (and one
    for the line feed). Null text is an empty text of one empty line, which has a
    score too; without a field every score is 0.5; equal rows are scored each, those without a
    doc_id too; more columns are not used; an empty table gives no rows; very long texts are scored whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, per in _scores(*flat_bytes(batch.column(1)), field):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.clip(s, 0.0, 1.0)), pa.array(per.astype(np.int64))], names=["doc_id", "score", "n_lines"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(releasing(run), f"doc_id {kind}, score double, n_lines long")


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines of every document; cases as in ``score``."""
    field = train(docs, labels, most)
    return score(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")


def good_only(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """The documents whose score is at least 0.5, all columns as they were, whatever their names; cases as in ``score``.

    Each row is judged for itself: equal rows stay or go together, and without a field all stay.
    """
    field = train(docs, labels, most)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            good = [s >= 0.5 for _, _, s, _ in _scores(*flat_bytes(text.fill_null("") if text.null_count else text), field)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(releasing(run), docs.schema)
