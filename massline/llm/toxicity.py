"""Toxicity by weak supervision: a label model over lexicon and pattern voters, and a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import held_out, sample_ids, training

#: Labelled documents of each class that voters, label model and classifier are fitted on, at most.
SAMPLE = 6000
#: Least precision of a mined pattern, and how unlikely its count among toxic documents must be by chance (as -log).
PRECISION, SURPRISE = 0.8, math.log(1e9)
#: Prefix lengths that patterns are mined from, besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
REMEMBERED = 300_000
#: Rounds of EM, the information (in nats) that two voters must share within a class to be linked, and steps of the classifier.
ROUNDS, LINKED = 30, 0.002
STEPS, RATE, RIDGE = 300, 0.2, 1e-3

# Words of insult in four languages, that need no mining.
INSULTS = frozenset(
    """idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb jerk imbecile vermin filth fool cretin dimwit
    halfwit coward creep pig rat maggot parasite freak idiote imbécile crétin abruti ordure salaud débile minable pourriture
    raclure dummkopf trottel vollidiot abschaum versager arschloch schwachkopf ungeziefer estúpido imbécil basura escoria payaso
    asqueroso miserable inútil cretino""".split()
)
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Voters that are always there; every mined pattern is one more.
FIXED = ("insults", "address", "shouting")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [f"={word}", *[f"{word[:n]}" for n in PREFIXES if len(word) >= n]]


class _Hits(dict):
    """Word -> the mined patterns that it shows, remembered in bounded number."""

    def __init__(self, mined: dict):
        self.mined = mined

    def __missing__(self, word: str) -> tuple:
        out = tuple(f for f in features(word) if f in self.mined)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


_ADDRESS = re.compile(r"\b(?:you|your|du|tu|vous|usted)\W+(?:\w+\W+){0,2}(?:" + "|".join(sorted(INSULTS)) + r")\b")


def fixed_votes(text: str | None, words: set[str]) -> list[bool]:
    """Votes of the fixed lexicon and of the two pattern voters."""
    text, named = text or "", bool(words & INSULTS)
    return [named, named and bool(_ADDRESS.search(text.lower())), len(text) > 20 and text.count("!") * 8 > len(text)]


def counts(words: set[str], hits: _Hits) -> dict[str, int]:
    """Distinct words of a text that show each mined pattern."""
    return Counter(f for w in words for f in hits[w])


def levels(words: set[str], hits: _Hits) -> list[float]:
    """Whether any word shows a pattern, how many do, and how many per hundred."""
    n = sum(1 for w in words if hits[w])
    return [float(n > 0), math.log1p(n), math.log1p(100 * n / (len(words) + 10))]


class LabelModel:
    """A generative model of the hidden label and the votes, fitted by EM on votes and, for half of its counts, on labels.

    Its parameters are the share of toxic documents, each voter's chance of voting in either class (its accuracy), and,
    where voters agree more within a class than independence allows, the chance given another voter's vote (their
    correlation): links form the tree of the largest conditional mutual information, so that a family of patterns that
    always come together counts about once. A voter that doesn't vote abstains, which is taken to tell nothing: lexicons
    of different languages never vote together, and their silence is no sign of a clean text. That is said by a voter of
    its own, for texts in which all others abstain. Labels choose the voters and calibrate their chances, as the start
    of EM and as half of what each round counts; a text's own label is no part of its posterior.
    """

    def __init__(self, prior: float, parent: np.ndarray, chance: np.ndarray):
        #: chance[y, j, vote of the parent, vote]; without a parent both rows are the same.
        self.prior, self.parent, self.chance = prior, parent, chance

    @staticmethod
    def maximised(v: np.ndarray, p: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> LabelModel:
        """The parameters that fit votes best, given each row's chance of being toxic."""
        chance = np.empty((2, v.shape[1], 2, 2))
        for y, q in enumerate((1 - p, p)):
            q = q * weight
            total = q.sum()
            one = (q @ v + 0.5 / len(v)) / (total + 1 / len(v))
            chance[y, :, :, 1] = one[:, None]
            for j in np.flatnonzero(parent >= 0):
                a = v[:, parent[j]]
                for on in (0, 1):
                    r = q * (a == on)
                    # A light pull to the voter's chance without its parent.
                    chance[y, j, on, 1] = (r @ v[:, j] + one[j] * 2 / len(v)) / (r.sum() + 2 / len(v))
        chance[..., 1] = np.clip(chance[..., 1], 1e-6, 1 - 1e-6)
        chance[..., 0] = 1 - chance[..., 1]
        return LabelModel(float(np.clip((p * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)), parent, chance)

    @staticmethod
    def linked(v: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Parent of each voter in the tree of the largest mutual information given the label, or -1."""
        n = v.shape[1]
        info = np.zeros((n, n))
        for q in (1 - p, p):
            q = q * weight / weight.sum()
            share = q.sum()
            both = (v * q[:, None]).T @ v
            on = q @ v
            for x, y in ((1, 1), (1, 0), (0, 1), (0, 0)):
                joint = both if (x, y) == (1, 1) else on[:, None] - both if (x, y) == (1, 0) else on[None, :] - both if (x, y) == (0, 1) else share - on[:, None] - on[None, :] + both
                a, b = (on if x else share - on)[:, None], (on if y else share - on)[None, :]
                joint = np.maximum(joint, 1e-15)
                info += joint * np.log(joint * share / np.maximum(a * b, 1e-30))
        parent, best, link = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1)
        left = np.ones(n, bool)
        for _ in range(n):
            # Prim's way: the voter outside that shares most with one inside, or a new root where none shares enough.
            at = int(np.argmax(np.where(left, best, -np.inf))) if (best[left] > LINKED).any() else int(np.flatnonzero(left)[0])
            parent[at], left[at] = (link[at] if best[at] > LINKED else -1), False
            closer = left & (info[at] > best)
            best[closer], link[closer] = info[at][closer], at
        return parent

    @classmethod
    def fit(cls, v: np.ndarray, calibrated: np.ndarray, weight: np.ndarray) -> LabelModel:
        """v: rows x voters of 0 and 1, the last one speaking where all others abstain, and linked with none; calibrated: what labels say of the rows, to start from; weight of each row."""
        v = v.astype(float)
        alone = np.full(v.shape[1], -1)
        model = cls.maximised(v, calibrated, weight, alone)
        twice, half = np.vstack([v, v]), np.concatenate([weight, weight]) / 2
        for i in range(ROUNDS):
            p = model.posterior(v)
            if i in (0, 3):
                alone = np.append(cls.linked(v[:, :-1], p, weight), -1)
            # What labels say of the voters counts as much as what they say of each other, or EM would drift away.
            model = cls.maximised(twice, np.concatenate([p, calibrated]), half, alone)
        return model

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.log(self.chance[1]) - np.log(self.chance[0])
        z = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        votes = v.astype(int)
        for j, a in enumerate(self.parent):
            z += votes[:, j] * odds[j][votes[:, a] if a >= 0 else 0, 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Toxicity:
    """Linear scores: a weight for each mined pattern and each fixed insult, by words that show it, and for the levels."""

    def __init__(self, weights: dict[str, float], bias: float, by_level: list[float]):
        self.weights, self.bias, self.by_level = weights, bias, by_level

    def scorer(self):
        hits = _Hits(self.weights)
        weights = self.weights

        def score(text: str | None) -> float:
            words = words_of(text)
            z = self.bias + sum(weights[f] * math.log1p(n) for f, n in counts(words, hits).items()) + sum(a * b for a, b in zip(self.by_level, levels(words, hits)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> pattern, documents of either class that show it, added up as far as memory goes."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = [*seen[1], *(k for k in seen[0] if k not in seen[1])]
        columns = [pa.array(keys, pa.string()), *[pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0)]]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

    for batch in (b for whole in batches for b in common.slices(whole, 0)):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[label].update({f for w in words_of(text) for f in features(w)})
        if len(seen[0]) + len(seen[1]) > REMEMBERED:
            yield out()
    yield out()


def _represent(mined: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(mined)
        for batch in (b for whole in batches for b in common.slices(whole, 0)):
            v, found, times, level = [], [], [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                v.append(fixed_votes(text, words))
                by = sorted(counts(words, hits).items())
                found.append([f for f, _ in by])
                times.append([n for _, n in by])
                level.append(levels(words, hits))
            columns = [batch.column(1), pa.array(v, pa.list_(pa.bool_())), pa.array(found, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())), pa.array(level, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "votes", "found", "times", "level"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Toxicity:
    """Voters are chosen on labelled training rows, the label model fits their votes, the classifier its posteriors.

    Patterns are all those that are precise enough and whose count among toxic documents chance can't explain: however
    many pass, none is left out. Without labels of both classes only the fixed lexicon speaks.
    """
    plain = Toxicity({f"={w}": 0.0 for w in INSULTS}, -3.0, [6.0, 0.0, 0.0])
    ids = sample_ids(labels, "toxic", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label").repartition(8)
    count = dict(ids.groupBy("label").count().collect())
    if not count.get(1) or not count.get(0):
        return plain
    # The classes' shares among the training labels; one clean document more is assumed.
    toxic_share = training(labels, "toxic").agg(F.avg("label")).first()[0]
    k, clean = F.col("toxic"), (F.col("clean") + 1) / F.lit(count[0] + 1)
    chance = count[1] * clean
    surprise = k * F.log(k / chance) - k + chance
    share = k / F.lit(count[1]) * toxic_share
    precise = share / (share + clean * (1 - toxic_share))
    shown = rows.mapInArrow(_mine, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0")
    kept = shown.where((k > chance) & (surprise >= SURPRISE) & (precise >= PRECISION)).select("feature", precise.alias("p")).collect()
    mined = {r["feature"]: r["p"] for r in kept} | {f"={w}": 1.0 for w in INSULTS}
    made = rows.mapInArrow(_represent(mined), "label int, votes array<boolean>, found array<string>, times array<long>, level array<double>")
    got = sorted((r["votes"], r["found"], r["times"], r["level"], r["label"]) for r in made.toLocalIterator())
    label = np.array([g[4] for g in got])
    # The sample's classes count as they do among the labels.
    weight = np.where(label == 1, toxic_share / label.mean(), (1 - toxic_share) / (1 - label.mean())) / len(got)
    voter = {f: i + len(FIXED) for i, f in enumerate(sorted(mined))}
    v = np.zeros((len(got), len(FIXED) + len(voter) + 1), np.uint8)
    for row, g in zip(v, got):
        row[: len(FIXED)] = g[0]
        row[[voter[f] for f in g[1]]] = 1
        row[-1] = not row.any()
    v = v[:, np.append(v[:, :-1].any(0), True)]
    target = LabelModel.fit(v, label.astype(float), weight).posterior(v) if v.shape[1] > 1 else label.astype(float)
    names = sorted(mined)
    where = {f: i for i, f in enumerate(names)}
    doc = np.concatenate([np.full(len(g[1]), i) for i, g in enumerate(got)]).astype(int)
    col = np.array([where[f] for g in got for f in g[1]], int)
    val = np.log1p(np.array([n for g in got for n in g[2]], float))
    level = np.array([g[3] for g in got])
    w, k = np.zeros(len(names)), 1 + level.shape[1]
    side, c = np.column_stack([np.ones(len(got)), level]), np.zeros(k)
    m1, m2 = np.zeros(len(names) + k), np.zeros(len(names) + k)
    for step in range(1, STEPS + 1):
        z = side @ c + np.bincount(doc, w[col] * val, len(got))
        e = (target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * weight
        g = np.concatenate([np.bincount(col, e[doc] * val, len(names)) - RIDGE / len(names) * w, side.T @ e])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, c = w + move[:-k], c + move[-k:]
    return Toxicity(dict(zip(names, w.tolist())), float(c[0]), c[1:].tolist())


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score. Null and empty texts score as texts without any pattern do; repeated rows alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in (b for whole in batches for b in common.slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
