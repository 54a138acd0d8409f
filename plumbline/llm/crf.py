"""Line quality by a linear-chain conditional random field, and document quality from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, small, texts_of
from plumbline.llm.jaccard import word_hashes
from plumbline.llm.tokens import slices

#: Byte classes counted in every line.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?",
    "comma": b",;:", "bang": b"!", "bar": b"|", "markup": b"<>{}[]\\/=_", "symbol": b"#*$%&@^~+", "space": b" \t\r\x0b\x0c",
}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members)] = _k
FEATURES = len(CLASSES) + 1 + 6


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word, the length of each line, and the number of such lines of each text."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.nonzero(raw == 10)[0]
    begins = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum([len(r) + 1 for r in raws])
    owner = np.searchsorted(text_ends, begins, side="right")
    length = ends - begins
    hashes, word_begin = word_hashes(raw)
    first = np.searchsorted(word_begin, np.append(begins, len(raw)))
    n_words = np.diff(first)
    kept = n_words > 0
    if not kept.any():
        return np.empty((0, FEATURES)), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    line_of = np.repeat(np.arange(len(begins)), length + 1)
    counts = np.bincount(line_of * (len(CLASSES) + 1) + _CLASS[raw], minlength=len(begins) * (len(CLASSES) + 1)).reshape(len(begins), -1)
    counts[:, -1] -= 1  # the line end itself
    word_line = np.repeat(np.arange(len(begins)), n_words)
    # Words met earlier in the same line, and words equal to the one before.
    order = np.lexsort((hashes, word_line))
    again = np.zeros(len(hashes), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (word_line[order[1:]] == word_line[order[:-1]])
    after = np.zeros(len(hashes), bool)
    after[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    repeated, doubled = (np.bincount(word_line[x], minlength=len(begins)) for x in (again, after))
    letters = np.maximum(1, counts[:, 0] + counts[:, 1])
    words = np.maximum(1, n_words)
    shares = counts / np.maximum(1, length)[:, None]
    more = [np.log1p(length), np.log1p(n_words), length / words / 10, counts[:, 1] / letters, repeated / words, doubled / words]
    table = np.column_stack([shares, *more])[kept]
    return table, length[kept], np.bincount(owner[kept], minlength=len(texts))


def with_neighbours(lines: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and the line after; zeros beyond a text's ends."""
    n = len(lines)
    ends = np.cumsum(counts)
    starts = (ends - counts)[counts > 0]
    before, after = np.zeros_like(lines), np.zeros_like(lines)
    if n:
        before[1:], after[:-1] = lines[:-1], lines[1:]
        before[starts] = 0
        after[ends[counts > 0] - 1] = 0
    return np.hstack([lines, before, after])


def _padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with lines, longest first: their numbers, the first row of each, and how many still run at each step."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    starts = (np.cumsum(counts) - counts)[order]
    longest = int(counts.max(initial=0))
    running = np.searchsorted(-counts[order], -np.arange(longest), side="left")
    return order, starts, running


def forward_backward(unary: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal probability of a good line, of each pair of states (line before, line), and log partition per text.

    ``unary`` scores the state good of every line (bad scores 0); ``transition[i, j]`` scores state j after state i.
    Texts advance together, one line a step.
    """
    order, starts, running = _padded(unary, counts)
    n = len(unary)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    scores = np.column_stack([np.zeros(n), unary])
    for step, live in enumerate(running.tolist()):
        rows = starts[:live] + step
        if step == 0:
            alpha[rows] = scores[rows]
        else:
            alpha[rows] = scores[rows] + np.logaddexp(alpha[rows - 1, :1] + transition[0], alpha[rows - 1, 1:] + transition[1])
    for step in range(len(running) - 2, -1, -1):
        rows = starts[: running[step + 1]] + step
        onward = beta[rows + 1] + scores[rows + 1]
        beta[rows] = np.logaddexp(onward[:, :1] + transition[:, 0], onward[:, 1:] + transition[:, 1])
    total = np.zeros(len(counts))
    last = starts + counts[order] - 1
    total[order] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    each = np.repeat(total, counts)
    good = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - each))
    inner = np.ones(n, bool)
    inner[starts] = False
    rows = np.nonzero(inner)[0]
    pairs = np.zeros((n, 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pairs[rows, i, j] = np.exp(np.minimum(0, alpha[rows - 1, i] + transition[i, j] + scores[rows, j] + beta[rows, j] - each[rows]))
    return good, pairs, total


@dataclass(frozen=True)
class LineModel:
    """Weights of a fitted field; features are centred and scaled first."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    transition: tuple[tuple[float, float], tuple[float, float]]

    def score(self, texts: list[str]) -> np.ndarray:
        """Document quality: each line's marginal, weighted by its length. A text without words scores 0."""
        lines, length, counts = line_features(texts)
        if not len(lines):
            return np.zeros(len(texts))
        x = (with_neighbours(lines, counts) - np.array(self.mean)) / np.array(self.scale)
        unary = x @ np.array(self.weights[1:]) + self.weights[0]
        good, _, _ = forward_backward(unary, counts, np.array(self.transition))
        owner = np.repeat(np.arange(len(texts)), counts)
        weight = np.bincount(owner, weights=length, minlength=len(texts))
        return np.bincount(owner, weights=good * length, minlength=len(texts)) / np.maximum(1, weight)


def fit_lines(lines: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 250, ridge: float = 1e-3, rate: float = 0.1) -> LineModel:
    """Maximum conditional likelihood by full-batch Adam; every line of a document has the document's label."""
    x = with_neighbours(lines, counts)
    if not len(x):
        width = 3 * FEATURES
        return LineModel((0.0,) * width, (1.0,) * width, (0.0,) * (width + 1), ((0.0, 0.0), (0.0, 0.0)))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    y = np.repeat(labels, counts).astype(float)
    # A document counts once, whatever its number of lines; both labels weigh the same.
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels != 1).sum()))
    weight = np.repeat(share / np.maximum(1, counts), counts)
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    seen = np.zeros((len(x), 2, 2))
    for k in (0, 1):
        seen[:, k, k] = inner & (y == k)
    parameters, first, second = (np.zeros(x.shape[1] + 4) for _ in range(3))
    penalty = np.concatenate([[0.0], np.full(x.shape[1] - 1, ridge), np.full(4, 10 * ridge)])
    for t in range(1, steps + 1):
        good, pairs, _ = forward_backward(x @ parameters[:-4], counts, parameters[-4:].reshape(2, 2))
        pull = np.tensordot(weight, seen - pairs, 1)
        gradient = np.append(x.T @ (weight * (y - good)), pull.ravel()) - penalty * parameters
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        parameters = parameters + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    transition = parameters[-4:].reshape(2, 2)
    return LineModel(tuple(mean), tuple(scale), tuple(parameters[:-4]), tuple(map(tuple, transition.tolist())))


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the key as text falls into the fold that is kept from training."""
    return F.crc32(key.cast("string").cast("binary")) % folds == fold


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", documents: int = 4_000, lines: int = 200_000,
) -> LineModel:
    """A model from at most ``documents`` labelled rows of at most ``lines`` lines in all, none of them held out.

    Rows are taken in the order of a hash of their key, so the sample is the same at every run; both bounds are
    parameters, and a text that does not fit into the lines left is passed over, not those behind it. Whole texts are
    used. Labels other than 0 and 1 are ignored; without labels every score is 1/2.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    # Bounded by the parameter, so it may be broadcast.
    sample = known.orderBy(F.xxhash64("k"), "k", "y").limit(documents)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch.column(0))
            for a, b in slices(texts, 2_000_000):
                table, _, counts = line_features(texts[a:b])
                ends = np.cumsum(counts)
                packed = [table[e - c : e].astype(np.float32).tobytes() for e, c in zip(ends, counts, strict=True)]
                columns = [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "y", "n", "x"])

    found = rows.select("t", F.xxhash64("k").alias("h"), "y").mapInArrow(run, "h long, y int, n long, x binary")
    found = materialise(found.where(F.col("n") <= lines), "lines")
    # Bounded twice: `documents` rows, and those whose lines fit.
    fits, left = [], lines
    for h, y, n in sorted(map(tuple, found.select("h", "y", "n").collect())):
        if n <= left:
            fits.append((h, y, n))
            left -= n
    if fits:
        sizes = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(fits)), "h long, y int, n long"))
        taken = sorted(found.join(sizes, ["h", "y", "n"]).collect(), key=lambda r: (r["h"], r["y"], r["x"]))
    else:
        taken = []
    counts = np.array([r["n"] for r in taken], np.int64)
    table = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in taken]).astype(float) if taken else np.empty((0, FEATURES))
    return fit_lines(table, counts, np.array([r["y"] for r in taken], np.int64))


def score(docs: DataFrame, model: LineModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row, from its whole text alone. A null, empty or blank text scores 0; repeated rows each score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, 2_000_000):
                scores = np.clip(model.score(texts[a:b]), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores)], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double")
    return found.select(F.col("k").alias(key), "score")
