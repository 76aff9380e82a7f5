"""Document fingerprints: quartile digests of hashed byte triplets, and a bounded difference between them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of the triplet counts; each takes two bits of the digest.
BUCKETS = 128
#: Difference of two buckets by how many quartiles they are apart; three count for six, as opposite ends are telling.
APART = np.array([0, 1, 2, 6], np.int64)
#: A step of the length code is a factor of so much, and the most steps that count in a difference, at what each costs.
LENGTH_BASE, LENGTH_MOST, LENGTH_COST = 1.2, 20, 6
#: Rows of one range of ids, about; ranges at most, beyond which they grow (a task reads its range in order, so that its
#: memory doesn't); sampled rows for each range, that the ranges are cut at.
ROWS_PER_RANGE, MOST_RANGES, PER_RANGE = 5000, 20_000, 20

_PAIRS = np.array([[APART[abs(i - j)] for j in range(4)] for i in range(4)], np.int64)
#: Difference of two bytes of four quartiles each.
_BYTES = np.array([[sum(_PAIRS[(a >> s) & 3, (b >> s) & 3] for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.int64)


def digest(data: bytes) -> str:
    """Hex of a length code (1 byte) and a quartile (0 to 3) of each bucket of counts."""
    size = len(data)
    code = min(255, round(math.log(size + 1, LENGTH_BASE)))
    if size < 3:
        # Too short for a triplet: the bytes themselves choose the buckets.
        counts = np.bincount(np.frombuffer(data, np.uint8).astype(np.int64) * 2 % BUCKETS, minlength=BUCKETS)
    else:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        h = (b[:-2] * np.uint32(65599 * 65599 % 2**32)) ^ (b[1:-1] * np.uint32(65599)) ^ b[2:]
        counts = np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    cuts = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    q = (counts > cuts[0]).astype(np.uint8) + (counts > cuts[1]) + (counts > cuts[2])
    four = q.reshape(-1, 4)
    return f"{code:02x}" + (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at the largest difference, or where either is missing."""
    if a is None or b is None:
        return 0.0
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    far = _BYTES[np.frombuffer(x, np.uint8, offset=1), np.frombuffer(y, np.uint8, offset=1)].sum()
    far += LENGTH_COST * min(LENGTH_MOST, abs(x[0] - y[0]))
    return float(1 - far / (BUCKETS * APART[3] + LENGTH_COST * LENGTH_MOST))


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by as many first ones, or all, of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_LEAST = -(2**63)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) -> rows (grp, doc_id, th, text, guest) and the number of groups; a group in order holds every row's successor.

    Rows are cut into ranges of (id, hash of the text) by a bounded sample, so that one id with very many texts falls to
    many ranges; each range's first row is also sent, as a guest, to the range before it, and the first of all to the
    last range.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    key = F.coalesce(F.col("doc_id"), F.lit(_LEAST))
    n = docs.count()
    parts = min(MOST_RANGES, max(1, -(-n // ROWS_PER_RANGE)))
    pair = np.dtype([("id", "<i8"), ("th", "<i8")])
    cuts = np.empty(0, pair)
    if parts > 1:
        share = min(1.0, PER_RANGE * parts / n)
        some = docs.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 30)) < int(share * (1 << 30))).select(key.alias("id"), "th").collect()
        found = np.sort(np.array([tuple(r) for r in some], pair))
        cuts = np.unique(found[np.linspace(0, len(found) - 1, parts + 1).astype(int)[1:-1]]) if len(found) else cuts

    @F.pandas_udf("int")
    def place(ids: pd.Series, th: pd.Series) -> pd.Series:
        rows = np.empty(len(ids), pair)
        rows["id"], rows["th"] = ids, th
        return pd.Series(np.searchsorted(cuts, rows).astype(np.int32))

    placed = docs.withColumn("grp", place(key, F.col("th")) if len(cuts) else F.lit(0))
    firsts = placed.groupBy("grp").agg(F.min(F.struct(key.alias("id"), F.col("th"))).alias("f"))
    # One row per range, in the driver's hands: the ranges are as many as were cut.
    order = sorted((r["grp"], r["f"]["id"], r["f"]["th"]) for r in firsts.collect())
    if not order:
        return placed.withColumn("guest", F.lit(False)), 1
    hosts = [(*order[i], order[i - 1][0]) for i in range(len(order))]
    hosts = docs.sparkSession.createDataFrame(hosts, "g int, first long, first_th long, host int")
    joined = placed.join(F.broadcast(hosts), (F.col("grp") == F.col("g")) & (key == F.col("first")) & (F.col("th") == F.col("first_th")), "left")
    own = F.struct(F.col("grp").alias("grp"), F.lit(False).alias("guest"))
    dealt = F.when(F.col("host").isNotNull(), F.array(own, F.struct(F.col("host").alias("grp"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    return joined.select("doc_id", "th", "text", F.explode(dealt).alias("x")).select("x.grp", "doc_id", "th", "text", "x.guest"), order[-1][0] + 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (grp, guest, doc_id, text) -> one output row for each row that is no guest."""
    rows: list[tuple] = []
    prev = None

    def close(row, text, print_):
        doc, own, finger = row
        other = edited(own, text)
        data = other.encode("utf-8", "surrogatepass")
        then = digest(data)
        rows.append((doc, len(own), hashlib.sha256(data).hexdigest(), finger, then, likeness(finger, then), likeness(finger, print_)))

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        rows.clear()
        return batch

    guest_done = None
    for batch in (b for whole in batches for b in common.slices(whole, 2)):
        for grp, doc, text, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            if guest and guest_done == grp:
                continue
            text = text.as_py() or ""
            finger = digest(text.encode("utf-8", "surrogatepass"))
            if prev is not None:
                close(prev, text, finger)
            prev = None if guest else (doc, text, finger)
            guest_done = grp if guest else None
            if len(rows) >= 1000:
                yield out()
    if rows:
        yield out()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> fingerprints of each text and of its edited text, and their likeness; see OUT.

    Null texts count as empty; a lone document follows itself; rows with a null id stand before all others and rows
    with equal ids follow each other by a hash of their text, then by it. An empty table gives an empty one. Texts move
    once, to their range.
    """
    rows, parts = with_next(docs.select(F.col("doc_id").cast("long"), "text"))
    dealt = rows.repartitionById(parts, F.col("grp")).sortWithinPartitions("grp", "guest", F.col("doc_id").asc_nulls_first(), "th", F.col("text").asc_nulls_first())
    return dealt.select("grp", "doc_id", "text", "guest").mapInArrow(_compare, OUT)


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
