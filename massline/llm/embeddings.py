"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.93
#: Reference points, at least: a sample of the vectors whose ids hash lowest. Their number grows with the root of the
#: table, and so does what is broadcast: 5,800 vectors for a thousand million rows.
PIVOTS, PER_LIST = 64, 30
#: A vector is described by its nearest reference points, so many as are needed; candidates share at least SHARED of
#: them. The number is the first with which RECALL of the links of so many sampled vectors with the whole table are
#: candidates; where fewer than ENOUGH such links are found, of as many made pairs right at the least cosine, which are
#: the hardest to find.
LEAST_NEAREST, SHARED = 4, 2
RECALL, SAMPLE, ENOUGH = 0.999, 2000, 300
#: Vectors of a list that one cell compares with another such block.
BLOCK = 1500
SEED = 20240607


def n_pivots(rows: int) -> int:
    """Lists are as many as pairs of pivots, so that they keep their length while rows grow with the square of pivots."""
    return int(max(PIVOTS, (rows / PER_LIST) ** 0.5))


def _clean(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, vec = batch.column(1).to_pylist(), batch.column(2)
            raw, content = [], []
            for i in range(batch.num_rows):
                x = vec[i]
                data = None
                if label[i] is not None and x.is_valid and len(x.values) and not x.values.null_count:
                    v = np.asarray(x.values.to_numpy(zero_copy_only=False), kind)
                    if np.isfinite(v).all() and v.any():
                        data = v.tobytes()
                raw.append(data)
                content.append(None if data is None else hashlib.blake2b(f"{label[i]}|".encode() + data, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(content, pa.binary())], names=["vec_id", "label", "raw", "content"])

    return run


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square over- or underflows."""
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def nearest_pivots(u: np.ndarray, pivots: np.ndarray, most: int | None = None) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first, as many as asked for."""
    most = len(pivots) if most is None else min(most, len(pivots))
    out = [np.argsort(-(u[i : i + 500] @ pivots.T), 1, kind="stable")[:, :most] for i in range(0, len(u), 500)]
    return np.vstack(out) if out else np.empty((0, most), np.int64)


def needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least number of nearest pivots with which two rows share SHARED of them, from their whole orders."""
    rank = lambda o: np.argsort(o, 1, kind="stable")
    return np.sort(np.maximum(rank(x), rank(y)), 1)[:, SHARED - 1] + 1


def _links_of(queries: list[tuple], kind: str, pivots: dict[int, np.ndarray], least: float):
    """Rows (rep, label, raw) -> how many nearest pivots their links with the queries need: n, count."""
    groups: dict[tuple, list] = {}
    for rep, label, raw in queries:
        groups.setdefault((label, len(raw)), []).append((rep, raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        units = {k: (np.array([r for r, _ in g]), _unit([x for _, x in g], kind)) for k, g in groups.items()}
        for batch in batches:
            rows: dict[tuple, list] = {}
            for rep, label, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.setdefault((label, len(raw)), []).append((rep, raw))
            for k, part in rows.items():
                p = pivots.get(k[1] // np.dtype(kind).itemsize)
                if k not in units or p is None:
                    continue
                ids, q = units[k]
                u, mine = _unit([x for _, x in part], kind), np.array([r for r, _ in part])
                a, b = np.nonzero((u @ q.T >= least) & (mine[:, None] != ids[None, :]))
                for s in range(0, len(a), 2000):
                    n = needed(nearest_pivots(u[a[s : s + 2000]], p), nearest_pivots(q[b[s : s + 2000]], p))
                    for x, c in zip(*np.unique(n, return_counts=True)):
                        seen[int(x)] = seen.get(int(x), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["n", "count"])

    return run


def made_links(queries: list[tuple], kind: str, pivots: dict[int, np.ndarray], least: float) -> dict[int, int]:
    """As above, for each query and a made partner at exactly the least cosine, in a random direction."""
    seen: dict[int, int] = {}
    for dim, p in pivots.items():
        part = [raw for _, _, raw in queries if len(raw) == dim * np.dtype(kind).itemsize]
        if not part or dim < 2:
            continue
        u = _unit(part, kind)
        other = np.random.default_rng([SEED, dim, 1]).standard_normal(u.shape)
        other -= (other * u).sum(1)[:, None] * u
        other /= np.sqrt((other * other).sum(1))[:, None] + 1e-300
        n = needed(nearest_pivots(u, p), nearest_pivots(least * u + (1 - least * least) ** 0.5 * other, p))
        for x, c in zip(*np.unique(n, return_counts=True)):
            seen[int(x)] = seen.get(int(x), 0) + int(c)
    return seen


def enough_nearest(seen: dict[int, int], recall: float) -> tuple[int, float]:
    """The least number of nearest pivots that finds so large a share of the links, and that share."""
    total, upto = sum(seen.values()), 0
    for n in sorted(seen):
        upto += seen[n]
        if n >= LEAST_NEAREST and upto >= recall * total or upto == total:
            return max(n, LEAST_NEAREST), upto / total
    return LEAST_NEAREST, 1.0


def _describe(kind: str, pivots: dict[int, np.ndarray], count: int, nearest: int):
    """Vector -> its nearest pivots in order, and a list for each pair of them."""

    def of(dim: int) -> np.ndarray:
        if dim not in pivots:
            p = np.random.default_rng([SEED, dim]).standard_normal((count, dim))
            pivots[dim] = p / np.sqrt((p * p).sum(1))[:, None]
        return pivots[dim]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            near: list = [None] * len(raw)
            by_size: dict[int, list] = {}
            for i, r in enumerate(raw):
                by_size.setdefault(len(r), []).append(i)
            for size, at in by_size.items():
                order = nearest_pivots(_unit([raw[i] for i in at], kind), of(size // np.dtype(kind).itemsize), nearest)
                for i, row in zip(at, order):
                    near[i] = row
            keys = [[(int(a) << 32) + int(b) for a, b in combinations(sorted(n.tolist()), SHARED)] or [-1] for n in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n.astype("<i4").tobytes() for n in near], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "near", "keys"])

    return run


def _compare(kind: str, least: float):
    """One cell: two blocks of a list, or one with itself -> links of each vector that this list is the first to see, and a spanning forest."""

    def run(key, cell):
        rows = sorted(cell.select(["rep", "times", "near", "raw", "block"]).to_pylist(), key=lambda r: r["rep"])
        wanted = (key[1].as_py() >> 32, key[1].as_py() & 0xFFFFFFFF)
        i, j = key[2].as_py(), key[3].as_py()
        block = np.array([r["block"] for r in rows])
        ids = np.array([r["rep"] for r in rows])
        out = ([], [], [])
        dims = np.array([len(r["raw"]) for r in rows])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            if len(at) < 2:
                continue
            part = [rows[k] for k in at]
            u = _unit([r["raw"] for r in part], kind)
            hit = u @ u.T >= least
            if i != j:
                hit &= block[at][:, None] != block[at][None, :]
            np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            some = np.flatnonzero(hit.any(1))
            root = common.components_of(hit[np.ix_(some, some)])
            # The list of a pair's two lowest shared pivots counts it, the others skip it.
            a, b = np.nonzero(hit)
            near = np.stack([np.frombuffer(r["near"], "<i4") for r in part]).astype(np.int64)
            lowest = wanted[0] >= 0
            first = np.ones(len(a), bool)
            if lowest:
                for s in range(0, len(a), 100_000):
                    x, y = near[a[s : s + 100_000]], near[b[s : s + 100_000]]
                    shared = np.sort(np.where((x[:, :, None] == y[:, None, :]).any(2), x, 1 << 40), 1)[:, :2]
                    first[s : s + 100_000] = (shared[:, 0] == wanted[0]) & (shared[:, 1] == wanted[1])
            times = np.array([r["times"] for r in part], np.int64)
            links = np.bincount(a[first], times[b[first]], len(part)).astype(np.int64)
            where = np.full(len(part), -1)
            where[some] = at[some[root]]
            for k in np.flatnonzero((links > 0) | (where >= 0)):
                out[0].append(int(ids[at[k]]))
                out[1].append(int(links[k]))
                out[2].append(int(ids[where[k]]) if where[k] >= 0 else int(ids[at[k]]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["rep", "links", "root"])

    return run


def near(vectors: DataFrame, scratch: common.Scratch, least: float = LEAST) -> DataFrame:
    """vectors (vec_id, label, embedding) -> vec_id, n_links, component_id, kept, recall for each row.

    recall is the share of links that the index finds, as measured on the links of sampled vectors with all rows, or on
    made pairs where the table shows too few; the number of pivots compared is the least that reaches RECALL there.

    Equal vectors of a label become one, with a count. Each is described by the order of its nearest reference points;
    inverted lists are kept for pairs of reference points of a label, so that two vectors meet in a list exactly when
    they share two of their nearest, and the pair is counted in the list of the two lowest they share. A list is cut
    into blocks of some rows, and every two blocks make a cell, so that a cell is bounded however long the list is.
    Cells compare by cosine in double precision and give counts and a spanning forest, never the pairs.

    A null label, and a vector that is null, empty, zero, or has null or non-finite components, links with nothing, nor
    do vectors of different length. A null vec_id gives a null component and is kept. Extra columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    src = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), "embedding")
    clean = scratch.save(src.mapInArrow(_clean(kind), "vec_id long, label string, raw binary, content binary"))
    usable = clean.where("content is not null and vec_id is not null")
    reps = scratch.save(usable.groupBy("content").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("raw").alias("raw")))
    rows = reps.count()
    count = n_pivots(rows)
    sample = reps.orderBy(F.xxhash64("rep"), "content").limit(max(count, SAMPLE)).select("rep", "label", "raw").collect()
    pivots: dict[int, np.ndarray] = {}
    item = np.dtype(kind).itemsize
    for size in {len(r["raw"]) for r in sample[:count]}:
        found = [bytes(r["raw"]) for r in sample[:count] if len(r["raw"]) == size]
        p = _unit(found, kind)
        # Too few of this length: the rest are fixed random directions.
        more = np.random.default_rng([SEED, size // item]).standard_normal((max(0, PIVOTS - len(found)), size // item))
        pivots[size // item] = np.vstack([p, more / np.sqrt((more * more).sum(1))[:, None]])
    queries = [(r["rep"], r["label"], bytes(r["raw"])) for r in sample[-SAMPLE:]]
    met = reps.select("rep", "label", "raw").mapInArrow(_links_of(queries, kind, pivots, least), "n int, count long").groupBy("n").agg(F.sum("count")).collect()
    seen = {n: c for n, c in met}
    nearest, recall = enough_nearest(seen if sum(seen.values()) >= ENOUGH else made_links(queries, kind, pivots, least), RECALL)
    described = scratch.save(reps.select("rep", "raw").mapInArrow(_describe(kind, pivots, count, nearest), "rep long, near binary, keys array<long>"))
    listed = described.join(reps.select("rep", "label"), "rep").select("rep", "label", F.explode("keys").alias("list"))
    sizes = listed.groupBy("label", "list").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = listed.join(sizes, ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = placed.select("rep", "label", "list", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    cells = cells.select("rep", "label", "list", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = cells.join(described.select("rep", "near"), "rep").join(reps.select("rep", "times", "raw"), "rep")
    found = scratch.save(full.groupBy("label", "list", "i", "j").applyInArrow(_compare(kind, least), "rep long, links long, root long"))
    components = common.connected_components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = reps.join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("content", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = clean.select("vec_id", "content").join(placed, "content", "left")
    alone = F.col("content").isNull() | F.col("vec_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(float(recall)))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near(common.table(spark, sf_dir, "embeddings"), common.Scratch(spark, "vectors"))
