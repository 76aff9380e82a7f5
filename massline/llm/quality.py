"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that the field is fitted on, at most: those whose ids hash lowest, of up to MOST_LINES
#: lines each and LINES in all.
SAMPLE, MOST_LINES, LINES = 1500, 500, 200_000
#: From here on a document counts as good.
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 120, 0.15, 0.02
#: Share of a labelled text, by length, that its lines' hidden labels must agree with in the mean: good texts, bad texts.
AGREE = (0.95, 0.7)

# Byte classes. 0 other, 1 lower or non-ASCII, 2 upper, 3 digit, 4 space, 5 stop, 6 mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = 6
_CLASS[10] = 7

N_OWN = 11


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts -> (lines of each, length of each line in bytes, own features of each line). A line feed ends a line."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lines = np.array([d.count(b"\n") + 1 for d in data], np.int64)
    joined = b"\n".join(data) + b"\n"
    kind = _CLASS[np.frombuffer(joined, np.uint8)]
    ends = np.flatnonzero(kind == 7)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    share = np.stack([np.add.reduceat(kind == c, starts, dtype=np.int64) for c in (1, 2, 3, 5, 6)], 1) / np.maximum(size, 1)[:, None]
    n, same, distinct = (np.empty(len(size)) for _ in range(3))
    for i, line in enumerate(joined[:-1].split(b"\n")):
        w = line.split()
        n[i], distinct[i], same[i] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
    words = np.maximum(n, 1)
    own = np.column_stack([np.log1p(size), share[:, 0], share[:, 1], share[:, 2], share[:, 3], np.minimum(share[:, 4] * 3, 1), share[:, 4] > 0.05, np.minimum(size / words, 30) / 10, distinct / words, same / words, n == 0])
    return lines, size, own


def with_neighbours(lines: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond the text), and flags for first and last."""
    first = np.cumsum(lines) - lines
    last = np.cumsum(lines) - 1
    before, after = np.vstack([np.zeros((1, own.shape[1])), own[:-1]]), np.vstack([own[1:], np.zeros((1, own.shape[1]))])
    before[first], after[last] = 0, 0
    at = np.zeros((len(own), 3))
    at[first, 0], at[last, 1], at[:, 2] = 1, 1, 1
    return np.hstack([own, before, after, at])


class Chains:
    """Texts' lines laid out by position, longest text first, so that all chains take a step at once."""

    def __init__(self, lines: np.ndarray):
        self.order = np.argsort(-lines, kind="stable")
        first = (np.cumsum(lines) - lines)[self.order]
        by_size = lines[self.order]
        self.steps = [first[: np.searchsorted(-by_size, -t, side="left")] + t for t in range(int(by_size[0]) if len(by_size) else 0)]

    def marginals(self, score: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-odds of good for each line alone, and transition weights -> P(good) of each line, expected transitions."""
        local = np.stack([1 / (1 + np.exp(np.clip(score, -40, 40))), 1 / (1 + np.exp(-np.clip(score, -40, 40)))], 1)
        a = np.exp(trans)
        alpha, beta, scale = np.empty_like(local), np.ones_like(local), np.ones(len(local))
        for t, at in enumerate(self.steps):
            x = local[at] * (alpha[self.steps[t - 1][: len(at)]] @ a if t else 1.0)
            scale[at] = x.sum(1)
            alpha[at] = x / scale[at, None]
        expected = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            back = self.steps[t - 1][: len(at)]
            m = local[at] * beta[at] / scale[at, None]
            beta[back] = m @ a.T
            if pairs:
                expected += np.einsum("di,dj->ij", alpha[back], m) * a
        return (alpha * beta)[:, 1], expected


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, not below 1, and intercept of P(y) along x, by Newton's steps with a light ridge."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        h = p * (1 - p) + 1e-9
        g = np.array([(x * (y - p)).sum() - 0.05 * a, (y - p).sum() - 0.05 * c])
        m = np.array([[(h * x * x).sum() + 0.05, (h * x).sum()], [(h * x).sum(), h.sum() + 0.05]])
        move = np.clip(np.linalg.solve(m, g), -2, 2)
        a, c = max(1.0, a + move[0]), c + move[1]
    return a, c


class Field:
    """Weights of a line's features, transition weights, and the calibration of a text's share of good lines."""

    def __init__(self, mean, std, weights, trans, slope=1.0, shift=0.0):
        self.mean, self.std, self.weights, self.trans, self.slope, self.shift = mean, std, weights, trans, slope, shift

    def shares(self, lines: np.ndarray, size: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length-weighted mean over lines of P(good), length) of each text."""
        x = with_neighbours(lines, (own - self.mean) / self.std)
        good, _ = Chains(lines).marginals(x @ self.weights, self.trans)
        first = np.cumsum(lines) - lines
        total = np.add.reduceat(size, first)
        return np.add.reduceat(good * size, first) / np.maximum(total, 1), total

    def scores(self, texts: list[str]) -> np.ndarray:
        share, total = self.shares(*line_features(texts))
        return np.where(total > 0, 1 / (1 + np.exp(-np.clip(self.slope * share + self.shift, -30, 30))), 0.0)


def fit(lines: np.ndarray, own: np.ndarray, label: np.ndarray) -> Field:
    """The field from texts' labels alone: which lines of a text are good or bad stays hidden.

    A generalised EM. Given a text's label, its lines' labels are those of the field under the constraint that, by
    length, a share of them agrees with it in the mean; one multiplier a text, raised while the share falls short,
    enforces that. So a bad text may hold good lines, and transitions between the two are seen. Each step moves the
    weights by the difference of these marginals and transitions and the field's own. At last the texts' shares of good
    lines are calibrated against their labels.
    """
    mean, std = own.mean(0), own.std(0) + 1e-6
    x = with_neighbours(lines, (own - mean) / std)
    first, of = np.cumsum(lines) - lines, np.repeat(np.arange(len(lines)), lines)
    size = np.expm1(own[:, 0])
    part = size / np.maximum(np.add.reduceat(size, first), 1)[of]
    # Each text weighs the same, however many lines it has, and so does each class.
    each = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    weight = (each / lines)[of]
    toward, need = np.where(label == 1, 1.0, -1.0), np.where(label == 1, *AGREE)
    pull = part * lines[of] * toward[of]
    chains = Chains(lines)
    w, trans, force = np.zeros(x.shape[1]), np.zeros((2, 2)), np.full(len(lines), 2.0)
    m1, m2 = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for step in range(1, STEPS + 1):
        score = x @ w
        p, expected = chains.marginals(score, trans, True)
        q, seen = chains.marginals(score + force[of] * pull, trans, True)
        good = np.add.reduceat(q * part, first)
        force = np.clip(force + 2 * (need - np.where(label == 1, good, 1 - good)), 0, 12)
        g = np.concatenate([x.T @ ((q - p) * weight) - RIDGE * w, ((seen - expected) / len(x)).ravel() - RIDGE * trans.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    field = Field(mean, std, w, trans)
    share, _ = field.shares(lines, size, own)
    field.slope, field.shift = logistic(share, label.astype(float))
    return field


def held_out(doc_id):
    """Never learned from: one in five by a checksum of the id, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the labelled training rows; conflicting labels go to the larger share, ties to 1."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))


def sample_ids(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` of the training rows of each class."""
    rows = training(labels, column)
    of = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return of(0).unionAll(of(1))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b for whole in batches for b in common.slices(whole, 1)):
        lines, _, own = line_features(batch.column(1).to_pylist())
        cuts = np.concatenate([[0], np.cumsum(lines)])
        keep = np.flatnonzero(lines <= MOST_LINES)
        rows = [own[cuts[i] : cuts[i + 1]].astype("<f4").tobytes() for i in keep]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(2).take(pa.array(keep)), pa.array(rows, pa.binary())], names=["doc_id", "label", "own"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field | float:
    """The field, or the share of good labels where one class is missing (0.5 without any label)."""
    ids = sample_ids(labels, "quality", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").mapInArrow(_extract, "doc_id long, label int, own binary")
    parts, label, total = [], [], 0
    # At most 2 * most rows, and so many lines; the order makes the choice the same in every run.
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "own").toLocalIterator():
        own = np.frombuffer(r["own"], "<f4").reshape(-1, N_OWN).astype(float)
        if total + len(own) > LINES:
            break
        parts.append(own)
        label.append(r["label"])
        total += len(own)
    if len(set(label)) < 2:
        return float(np.mean(label)) if label else 0.5
    return fit(np.array([len(p) for p in parts]), np.vstack(parts), np.array(label))


def score(docs: DataFrame, field: Field | float) -> DataFrame:
    """docs -> its columns plus score: the length-weighted mean over lines of P(good), calibrated. Null and empty texts score 0.

    A column of docs called score is replaced. Rows are independent of each other; repeated rows score alike.
    """
    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, at):
                texts = part.column(at).to_pylist()
                s = field.scores(texts) if isinstance(field, Field) else np.array([field if t else 0.0 for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(s, 0, 1))], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, f"{kinds}, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
