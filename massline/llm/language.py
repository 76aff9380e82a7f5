"""Languages of a document as a mixture: expectation-maximisation over n-gram likelihoods, chosen by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import held_out

#: Documents of each language that the n-gram tables are fitted on, about, where it has more: those whose ids hash lowest.
SAMPLE = 8_000
#: Tables of hashed n-grams of bytes; a unit of the mixture is a run of so many of them.
BITS, N, UNIT = 16, 4, 64
STEPS = 10
SMOOTH = 0.5

_LETTER = regex.compile(r"\p{L}")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, lower-cased and set in spaces, and how many each has."""
    data = [b"  %s  " % (t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) - N + 1 for d in data])
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    # Runs over the joint of two texts are left out below.
    h = (b[: -N + 1] << 24) | (b[1 : -N + 2] << 16) | (b[2 : -N + 3] << 8) | b[3:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    keep = np.ones(len(h), bool)
    ends = np.cumsum(sizes + N - 1)[:-1]
    for k in range(1, N):
        keep[ends - k] = False
    return h[keep], sizes


def mixture(loglik: np.ndarray, units: np.ndarray, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per-unit log-likelihoods (units x languages) and the units of each text -> proportions, log-likelihood of each text.

    open_ tells which languages each text may use.
    """
    first = np.cumsum(units) - units
    of = np.repeat(np.arange(len(units)), units)
    top = loglik.max(1, keepdims=True)
    lik = np.exp(np.maximum(loglik - top, -60))
    share = np.ones((len(units), loglik.shape[1])) if open_ is None else open_.astype(float)
    share /= share.sum(1, keepdims=True)
    for _ in range(STEPS):
        joint = lik * share[of]
        joint /= joint.sum(1, keepdims=True) + 1e-300
        share = np.add.reduceat(joint, first, axis=0) / units[:, None]
    total = np.add.reduceat(np.log((lik * share[of]).sum(1) + 1e-300) + top[:, 0], first)
    return share, total


class Languages:
    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    def proportions(self, texts: list[str]) -> np.ndarray:
        """Share of each language in each text, zero for those that the penalised likelihood leaves out."""
        h, sizes = grams(texts)
        units = -(-sizes // UNIT)
        first = np.concatenate([np.arange(a, a + n, UNIT) for a, n in zip(np.cumsum(sizes) - sizes, sizes)])
        loglik = np.stack([np.add.reduceat(row[h], first, dtype=np.float64) for row in self.table], 1)
        share, _ = mixture(loglik, units)
        ranks = np.argsort(np.argsort(-share, 1, kind="stable"), 1)
        # No set can explain a text better than each unit's own best language does.
        bound = np.add.reduceat(loglik.max(1), np.cumsum(units) - units)
        best, chosen = np.full(len(texts), -np.inf), share
        for n in range(1, len(self.names) + 1):
            cost = (n - 1) * (np.log(units + 1) + 2.0)
            open_ = np.flatnonzero(bound - cost > best)
            if not len(open_):
                break
            rows = np.isin(np.repeat(np.arange(len(units)), units), open_)
            part, total = mixture(loglik[rows], units[open_], ranks[open_] < n)
            total = total - cost[open_]
            better = total > best[open_]
            best[open_[better]] = total[better]
            chosen[open_[better]] = part[better]
        return chosen


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in (b for whole in batches for b in common.slices(whole, 0)):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h, _ = grams([text])
            seen.setdefault(lang, np.zeros(1 << BITS, np.int64))[:] += np.bincount(h, minlength=1 << BITS)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v.astype("<i8").tobytes() for v in seen.values()])], names=["lang", "n"])


def train(docs: DataFrame, most: int = SAMPLE) -> Languages | None:
    """Tables of log-probabilities for each language of the training rows; None without any.

    A language's documents are counted first, so that each has its own share of the bounded sample, rare ones all of it.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), most / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = rows.join(share, "lang").where(place < F.col("share"))
    parts = rows.select("text", "lang").repartition(8).mapInArrow(_count, "lang string, n binary").toLocalIterator()
    sums: dict[str, np.ndarray] = {}
    for r in parts:
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["n"], "<i8")
    if not sums:
        return None
    names = sorted(sums)
    n = np.stack([sums[k] for k in names]) + SMOOTH
    return Languages(names, np.log(n / n.sum(1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: Languages | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, languages (the set with its shares, by share).

    The set may hold any number of the learned languages: sets grow by the languages' order of share for as long as a
    larger one could still win. lang_pred has the largest share, and score is that share. Without a text, a letter in it
    or a model: und, 0. Repeated rows are treated alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1):
                texts = batch.column(1).to_pylist()
                pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                some = [k for k, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
                if some:
                    share = model.proportions([texts[k] for k in some])
                    for k, p in zip(some, share):
                        order = [j for j in np.argsort(-p, kind="stable") if p[j] > 0]
                        pred[k], score[k] = model.names[order[0]], float(min(1.0, p[order[0]]))
                        sets[k] = [{"lang": model.names[j], "share": float(p[j])} for j in order]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang string, share double>>".replace("lang string, share double", "lang:string,share:double"))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
