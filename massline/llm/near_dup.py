"""Near-duplicate groups by bottom-k sketches: inverted lists of retained values, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Values kept of each document's shingle hashes.
K = 32
#: A pair at the threshold is lost with a chance of at most exp(-RISK).
RISK = 20.0
REMEMBERED = 200_000
#: What is left of a group is compared in blocks of so many texts or shingles, with so many columns at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 600, 300_000, 4096


def least_share(num: int, den: int, k: int = K) -> int:
    """Values of the bottom k of a union that a pair at the threshold shares, but for a chance of exp(-RISK).

    Each value of a union's sketch is shared with the probability of the Jaccard similarity t, so the count's lower
    tail falls as exp(-k KL(c/k, t)).
    """
    t = num / den

    def risk(c: int) -> float:
        p = c / k
        return k * ((p * math.log(p / t) if p else 0.0) + (1 - p) * math.log((1 - p) / (1 - t)))

    return max((c for c in range(1, int(t * k)) if risk(c - 1) >= RISK), default=1)


class _Words(dict):
    """Word -> 64-bit hash, remembered in bounded number."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    """Lower-casing and splitting bytes touches A-Z and the six ASCII white-space characters alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, known: _Words) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; fewer words than the width make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    acc = np.full(n, np.uint64(len(words)) if len(words) < width else np.uint64(width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(words))):
            acc = (acc ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def shingle_set(words: list[bytes], width: int) -> frozenset:
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(width))))


def n_shingles(words: list[bytes], width: int) -> int:
    """Size of the set of shingles, by exact word numbers rather than hashes."""
    if len(words) < width:
        return min(1, len(words))
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n, code, span = len(words) - width + 1, np.zeros(len(words) - width + 1, np.int64), 1
    for i in range(width):
        if span * len(known) >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            span = n
        code, span = code * len(known) + number[i : i + n], span * len(known)
    return len(np.unique(code))


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in (b for whole in batches for b in common.slices(whole, 2)):
            n, key, sketch = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                n.append(n_shingles(words, width))
                key.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                sketch.append(shingle_hashes(words, width, known)[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "content", "sketch"])

    return run


_NONE = np.iinfo(np.uint64).max


def padded(sketches: list[np.ndarray], k: int) -> np.ndarray:
    out = np.full((len(sketches), k), _NONE)
    for row, x in zip(out, sketches):
        row[: len(x)] = x
    return out


def estimates(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the sketch of the union that two sketches share, and that sketch's size, for one against each other."""
    k = len(one)
    both = np.sort(np.hstack([np.broadcast_to(one, others.shape), others]), 1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
    rank = np.cumsum(~again & (both != _NONE), 1)
    return (again & (rank <= k)).sum(1), np.minimum(rank[:, -1], k)


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            u = queue.pop()
            for v in np.flatnonzero(linked[u] & ~seen).tolist():
                seen[v] = True
                out.append((u, v))
                queue.append(v)
    return out


def _cell(width: int, num: int, den: int, k: int, share: int):
    """Texts of two blocks of a group, or of one -> links that span what is linked among different components.

    Pairs must pass the estimate; intersections of all that do are counted at once by products of incidence matrices,
    and the links that the result needs are confirmed on the sets themselves.
    """

    def run(key, cell):
        rows = sorted(cell.select(["cid", "component", "block", "text"]).to_pylist(), key=lambda r: r["cid"])
        component, block = (np.array([r[c] for r in rows]) for c in ("component", "block"))
        one_block = key[1].as_py() == key[2].as_py()
        known = _Words()
        words = [words_of(r["text"]) for r in rows]
        hashes = [shingle_hashes(w, width, known) for w in words]
        sketch = padded([h[:k] for h in hashes], k)
        open_ = np.zeros((len(rows), len(rows)), bool)
        for i in range(len(rows) - 1):
            at = i + 1 + np.flatnonzero((component[i + 1 :] != component[i]) & (one_block | (block[i + 1 :] != block[i])))
            if len(at):
                hit, size = estimates(sketch[i], sketch[at])
                open_[i, at] = hit * k >= size * share
        open_ |= open_.T
        use = np.flatnonzero(open_.any(1))
        out: tuple = ([], [])
        if len(use):
            n = np.array([len(hashes[i]) for i in use])
            _, column, count = np.unique(np.concatenate([hashes[i] for i in use]), return_inverse=True, return_counts=True)
            # Columns of shingles that one text alone has add nothing to an intersection.
            place = np.cumsum(count > 1) - 1
            keep = count[column] > 1
            row, column = np.repeat(np.arange(len(use)), n)[keep], place[column[keep]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros((len(use), len(use)), np.float64)
            for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
                dense = np.zeros((len(use), COLUMNS), np.float32)
                dense[row[at], column[at] - lo] = 1
                both += dense @ dense.T
            both = np.rint(both).astype(np.int64)
            linked = (den * both >= num * (n[:, None] + n[None, :] - both)) & open_[np.ix_(use, use)]
            sets: dict[int, frozenset] = {}
            while True:
                tree = _tree(linked)
                for i in {i for e in tree for i in e}.difference(sets):
                    sets[i] = shingle_set(words[use[i]], width)
                wrong = [(i, j) for i, j in tree if not similar(sets[i], sets[j], num, den)]
                if not wrong:
                    break
                for i, j in wrong:
                    linked[i, j] = linked[j, i] = False
            for i, j in tree:
                out[0].append(rows[use[i]]["cid"])
                out[1].append(rows[use[j]]["cid"])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def similar(x: frozenset, y: frozenset, num: int, den: int) -> bool:
    both = len(x & y)
    return den * both >= num * (len(x) + len(y) - both)


def _verify(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, frozenset()]
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(1), batch.column(3))):
                if a[i] != last[0]:
                    last = [a[i], shingle_set(words_of(x.as_py()), width)]
                if similar(last[1], shingle_set(words_of(y.as_py()), width), num, den):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def groups(docs: DataFrame, scratch: common.Scratch, width: int = 5, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """docs (doc_id, text) -> a row per row: doc_id, n_shingles, component_id, kept, th, group.

    Words are what ASCII white space separates, with A-Z in lower case; documents are linked when den * |intersection|
    >= num * |union| of their sets of distinct word shingles. component_id is the smallest doc_id that links reach.

    Equal word sequences become one class first, by a 128-bit cryptographic digest; classes have numbers of their own,
    so that rows which share a doc_id are told apart. Each class keeps the k smallest of one hash of its shingles. A
    linked pair shares at least c of the values it keeps, so, with values ordered from rare to frequent, the two must
    meet within the first k - c + 1: only these enter the inverted lists, and values that one class alone has fill those
    places without entering any. First every list links its members to the one whose values are the most common (the
    middle of a family of copies); these pairs must pass the estimate from the sketch of the union, then the exact test
    on the sets. Two members of a list share its middle, so all pairs that are left lie within the groups around one
    middle. A group whose members are in one component by now is done. Of the others, whatever their size, those outside
    the group's largest component are cut into blocks and meet all the rest, block by block, in cells: the estimate
    again, then the exact test, giving the links that span what is linked and never the pairs.

    Texts without words have n_shingles 0 and link with nothing. A row with a null doc_id is given a null component
    and is kept. Of two rows that share a doc_id each has the component of its own text. th is a hash of the text, and
    group a number of the component, null for rows without words or without a doc_id. Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text"))
    sig = scratch.save(src.mapInArrow(_sketch(width, k), "doc_id long, th long, n_shingles long, content binary, sketch array<long>"))
    share = least_share(num, den, k)
    classes = sig.where("content is not null and doc_id is not null").groupBy("content").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    # Written once: the numbers are as good as fixed.
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()))
    posted = classes.select("cid", F.explode("sketch").alias("value"))
    common_values = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(common_values, "value").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("vs"))
    listed = shared.join(classes.select("cid", "at", "size", F.size("sketch").alias("m"), "sketch"), "cid")
    # c scales with the sketch: values are all there where a set has fewer than k.
    need = F.ceil(F.col("m") * share / F.lit(k)).cast("int")
    alone = F.col("m") - F.size("vs")
    places = F.col("m") - need + 1 - alone
    weight = F.aggregate("vs", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    listed = scratch.save(listed.where(places > 0).select("cid", "at", "size", "sketch", weight.alias("weight"), F.slice(F.col("vs"), F.lit(1), places).alias("vs")))
    lists = listed.select("cid", "weight", F.explode("vs.value").alias("value"))
    texts = scratch.save(src.join(listed.select("at.doc_id", "at.th", "cid"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("cid", "text"))
    sketches = listed.select("cid", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        """(a, b) -> the pairs that pass the estimate and the exact test."""
        one = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"))
        two = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
        # Sketches ascend as unsigned numbers; flipping the sign bit makes that the order of signed ones.
        flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63))))
        union = F.slice(F.array_sort(flip(F.array_union("sa", "sb"))), 1, k)
        hit = F.size(F.array_intersect(flip(F.array_intersect("sa", "sb")), union))
        near = pairs.join(one, "a").join(two, "b").where(hit * k >= F.size(union) * share).select("a", "b")
        left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
        full = near.join(left, "a").join(right, "b").select("a", "ta", "b", "tb")
        return full.mapInArrow(_verify(width, num, den), "a long, b long")

    middle = lists.groupBy("value").agg(F.max(F.struct("weight", (-F.col("cid")).alias("low"))).alias("top"), F.count("*").alias("n")).where("n > 1")
    spokes = lists.join(middle.select("value", (-F.col("top.low")).alias("a")), "value").where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    spokes = scratch.save(spokes)
    links = scratch.save(linked(spokes))
    found = common.connected_components(scratch, links).withColumnRenamed("node", "cid")
    found = scratch.save(listed.select("cid", "size").join(found, "cid", "left").select("cid", "size", F.coalesce("component", "cid").alias("component")))
    # All that share a list with a pair's other end have the list's middle in common: groups by middle hold every pair.
    group = spokes.select(F.col("a").alias("grp"), F.col("b").alias("cid")).unionAll(spokes.select("a", "a").distinct().toDF("grp", "cid"))
    group = scratch.save(group.join(found, "cid"))
    parts = group.groupBy("grp", "component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = lambda n, total: F.ceil(F.greatest(n / BLOCK, total / BLOCK_SHINGLES)).cast("int")
    span = parts.groupBy("grp").agg(F.max(F.struct("n", "component", "total")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("total").alias("total")).where("parts > 1")
    span = span.select("grp", F.col("top.component").alias("main"), blocks(F.col("n") - F.col("top.n"), F.col("total") - F.col("top.total")).alias("outer"), blocks(F.col("top.n"), F.col("top.total")).alias("inner"))
    # Cells (i, j): i and j are blocks outside the largest component with i <= j, or j is one of its blocks, numbered after those.
    still = group.join(span, "grp").withColumn("in", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64("cid"), F.when(F.col("in"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    still = still.withColumn("block", block + F.when(F.col("in"), F.col("outer")).otherwise(0))
    other = F.expr("explode(case when `in` then sequence(0, outer - 1) else sequence(0, outer + inner - 1) end)")
    cells = still.select("grp", "cid", "component", "block", other.alias("other"))
    cells = cells.select("grp", "cid", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cells = cells.join(texts, "cid").groupBy("grp", "i", "j").applyInArrow(_cell(width, num, den, k, share), "a long, b long")
    more = scratch.save(cells.unionAll(links))
    for gone in (texts, links, group, spokes):
        scratch.drop(gone)
    components = common.connected_components(scratch, more).select(F.col("node").alias("cid"), "component")
    placed = classes.select("cid", "content", "at.doc_id").join(components, "cid", "left").select("content", "doc_id", F.coalesce("component", "cid").alias("group"))
    lowest = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    placed = placed.drop("doc_id").join(lowest, "group")
    out = sig.select("doc_id", "th", "n_shingles", "content").join(placed, "content", "left")
    component = F.when(F.col("content").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "th", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "th", "group")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs, common.Scratch(spark, "near"), width=3, num=85, den=100).drop("th", "group")
