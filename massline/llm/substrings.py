"""Removal of long repeated byte strings: anchors find where to look, a hash-compared suffix sort finds what repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 200
#: Bytes that an anchor's hash covers; a string of LENGTH bytes holds so many of them, and the least one is its anchor.
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Strings of an anchor are dealt out in groups by where they start; those of one group share LENGTH - GROUP + 1 bytes,
#: and a hash of these is the key by which pieces of contexts meet. A power of two.
GROUP = 64
#: Pieces of one key that meet in one task. Where more would, their groups are halved, so that keys cover more bytes.
MOST = 3000
#: Suffixes that are sorted at once, about.
CHUNK = 150_000

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64."""
    have = _POWERS[kind]
    while len(have) < n:
        b = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        have = np.concatenate([have, have * np.uint64(pow(b, len(have), 1 << 64))])
        _POWERS[kind] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power; differences, shifted to one power, are hashes of substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=out[1:])
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes -> (hash, position, first string, last string) of each anchor.

    Strings of LENGTH bytes starting from first to last have this anchor: the least hash of GRAM bytes among them,
    the leftmost at ties. Equal strings so have equal anchors at equal places, wherever they are.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    q = prefix_hashes(data)
    g = (q[GRAM:] - q[:-GRAM]) * _powers("down", len(data) - GRAM + 1)
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    full = np.full(-(-len(key) // SPAN) * SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(key)] = key
    rows = full.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & np.uint64(0xFFFFFFFF)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [n - 1]])
    at = least[first].astype(np.int64)
    return g[at], at, first, last


def repeated(texts: list[bytes], group: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Contexts -> for each of their strings of LENGTH bytes, whether another context of its group has it too.

    Context i has ``count[i]`` strings and its anchor at ``offset[i]``; only strings at one place relative to the anchor
    can be equal. They are sorted by a bottom-up mergesort, in which all merges of a round run at once: an element's
    rank in the other run is found by binary search, and two suffixes are compared by binary search for the length of
    their common extension on prefix hashes. Equal neighbours are then confirmed byte by byte.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    q, total = prefix_hashes(raw), len(raw)
    up = _powers("up", total + 1)[::-1]
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    item = np.repeat(np.arange(len(texts)), count)
    local = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    start = base[item] + local
    bucket = group[item] * 4096 + (local - offset[item] + 2048)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([edge, [len(bucket)]]))
    lo_of, len_of = np.repeat(edge, size), np.repeat(size, size)

    def common_extension(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
        qx, qy, ux, uy = q[x], q[y], up[x], up[y]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (q[x + mid] - qx) * ux == (q[y + mid] - qy) * uy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = common_extension(x, y)
        at = np.minimum(n, LENGTH - 1)
        return np.where(n >= LENGTH, or_equal, raw[x + at] < raw[y + at])

    width = 1
    while width < (len_of.max() if len(len_of) else 0):
        active = np.flatnonzero(len_of > width)
        t = active - lo_of[active]
        pair = t // (2 * width) * (2 * width)
        right = t - pair >= width
        begin, mid, end = lo_of[active] + pair, np.minimum(pair + width, len_of[active]) + lo_of[active], np.minimum(pair + 2 * width, len_of[active]) + lo_of[active]
        lo, hi = np.where(right, begin, mid), np.where(right, mid, end)
        other = lo.copy()
        mine = start[order[active]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            m = (lo[open_] + hi[open_]) >> 1
            # Elements of the left run go first among equals.
            below = less(start[order[m]], mine[open_], right[open_])
            lo[open_] = np.where(below, m + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], m)
        rank = begin + (t - pair - np.where(right, width, 0)) + (lo - other)
        moved = order.copy()
        moved[rank] = order[active]
        order = moved
        width *= 2
    near = np.flatnonzero(bucket[1:] == bucket[:-1])
    a, b = start[order[near]], start[order[near + 1]]
    same = common_extension(a, b) >= LENGTH
    near, a, b = near[same], a[same], b[same]
    word = np.lib.stride_tricks.sliding_window_view(raw, 8)
    ok = np.ones(len(a), bool)
    for k in range(0, LENGTH, 8):
        ok &= (word[a + k] == word[b + k]).all(1)
    out = np.zeros(len(item), bool)
    out[order[near[ok]]] = True
    out[order[near[ok] + 1]] = True
    return out


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """All anchors of a batch of (id, th, text)."""
    parts: dict[str, list] = {k: [] for k in ("anchor", "d1", "d2", "id", "th", "first", "off", "n")}
    ids, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for i, text in enumerate(batch.column(2)):
        data = _bytes(text)
        g, at, first, last = anchors(np.frombuffer(data, np.uint8))
        if not len(g):
            continue
        digests = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + LENGTH).tolist())])
        d = np.frombuffer(digests, "<i8").reshape(-1, 2)
        for k, v in zip(parts, (g.view(np.int64), d[:, 0], d[:, 1], np.full(len(g), ids[i]), np.full(len(g), th[i]), first, at - first, last - first + 1)):
            parts[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in parts.items()}


def _batch(columns: dict[str, np.ndarray], kinds: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32()}
    named = [x.split() for x in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k]).cast(types[t]) for k, t in named], names=[k for k, _ in named])


CLASS = "anchor long, d1 long, d2 long, times int, id long, th long, first int, off int, n int"
MEMBER = "d1 long, d2 long, id long, th long, first int, n int"
SPANS = "id long, th long, start int, end int"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their contexts' digests, equal ones of a batch as one with a count."""
    for whole in batches:
        for part in common.slices(whole, 2):
            rows = _rows(part)
            order = np.lexsort((rows["d2"], rows["d1"]))
            d1, d2 = rows["d1"][order], rows["d2"][order]
            head = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])) if len(d1) else np.empty(0, np.int64)
            out = {k: v[order][head] for k, v in rows.items()}
            out["times"] = np.diff(np.concatenate([head, [len(d1)]]))
            yield _batch(out, CLASS)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in common.slices(whole, 2):
            yield _batch(_rows(part), MEMBER)


def split(ctx: bytes, place: int, n: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(key, place, strings, bytes) of the pieces of a context whose first of n strings starts at a place.

    A place is the distance from the leftmost start that holds the anchor. The strings of a group of ``width`` places
    share bytes, whichever of them a context has; a key is a hash of these, so equal strings meet under equal keys.
    """
    for group in range(place // width, (place + n - 1) // width + 1):
        low, high = max(place, group * width), min(place + n - 1, group * width + width - 1)
        shared = ctx[min(group * width + width, SPAN) - 1 - place : group * width + LENGTH - place]
        yield xxhash.xxh3_64_intdigest(shared, group) - (1 << 63), low, high - low + 1, ctx[low - place : high - place + LENGTH]


PIECE = "key long, place int, many boolean, id long, th long, first int, n int, ctx binary"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in PIECE.split(", ")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, text, list of contexts) -> the pieces of each context."""
    for whole in batches:
        for batch in common.slices(whole, 2):
            ids, th, all_, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), []
            for i, text in enumerate(batch.column(2)):
                data = _bytes(text)
                for c in all_[i]:
                    place = SPAN - 1 - c["off"]
                    for key, low, n, ctx in split(data[c["first"] : c["first"] + c["n"] - 1 + LENGTH], place, c["n"], GROUP):
                        out.append((key, low, c["times"] > 1, ids[i], th[i], c["first"] + low - place, n, ctx))
            yield _piece_batch(out)


def _halve(width: int):
    """Pieces -> their pieces by groups of the given width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(key, low, r["many"], r["id"], r["th"], r["first"] + low - r["place"], n, ctx) for key, low, n, ctx in split(r["ctx"], r["place"], r["n"], width)]
            yield _piece_batch(out)

    return run


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their keys -> runs of strings that another piece of the key has."""
    held: list[dict] = []

    def flush(rows: list[dict]) -> pa.RecordBatch:
        count = np.array([r["n"] for r in rows], np.int64)
        _, group = np.unique(np.array([r["key"] for r in rows], np.int64), return_inverse=True)
        hit = repeated([r["ctx"] for r in rows], group, -np.array([r["place"] for r in rows], np.int64), count)
        out: tuple = ([], [], [], [])
        begin = np.cumsum(count) - count
        for i, r in enumerate(rows):
            # What has an equal one as a whole is covered anyway.
            part = hit[begin[i] : begin[i] + count[i]]
            if r["many"] or not part.any():
                continue
            step = np.diff(np.concatenate([[0], part.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
                for k, v in zip(out, (r["id"], r["th"], r["first"] + a, r["first"] + b - 1 + LENGTH)):
                    k.append(v)
        return _batch({k: np.array(v, np.int64) for k, v in zip(("id", "th", "start", "end"), out)}, SPANS)

    held_n = 0
    for batch in batches:
        for r in batch.to_pylist():
            if held_n >= CHUNK and r["key"] != held[-1]["key"]:
                yield flush(held)
                held, held_n = [], 0
            held.append(r)
            held_n += r["n"]
    if held:
        yield flush(held)


def _ends(pieces: DataFrame, scratch: common.Scratch) -> list[DataFrame]:
    """Pieces -> tables of spans (id, th, start, end) of strings that another piece of their key has.

    Keys with up to MOST pieces are suffix-sorted, each in one task. Larger ones are cut finer: equal pieces become one,
    compared byte by byte by the aggregation itself, and are repeated as wholes; one of each kind goes on, under the
    keys of groups half as wide. At a width of one a piece is a single string, so this ends.
    """
    out, width = [], GROUP
    while True:
        sizes = pieces.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        met = pieces.join(sizes, "key")
        dealt = met.where(F.col("c") <= MOST).drop("c").repartition("key").sortWithinPartitions("key")
        out.append(dealt.mapInArrow(_sorted_runs, SPANS))
        if (sizes.agg(F.max("c")).first()[0] or 0) <= MOST:
            return out
        hot = scratch.save(met.where(F.col("c") > MOST).drop("c"))
        same = ["key", "place", "n", "ctx"]
        kinds = scratch.save(hot.groupBy(same).agg(F.count("*").alias("c"), F.max("many").alias("many"), F.min(F.struct("id", "th", "first")).alias("at")))
        whole = hot.join(kinds.where("c > 1").select(same), same)
        out.append(whole.select("id", "th", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("end")))
        if width == 1:
            return out
        width //= 2
        one = kinds.select("key", "place", (F.col("many") | (F.col("c") > 1)).alias("many"), "at.id", "at.th", "at.first", "n", "ctx")
        pieces = scratch.save(one.mapInArrow(_halve(width), PIECE))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals, ascending; touching ones make one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (src: id, th, text for each row; spans: id, th, list of covered intervals).

    1. Every text's strings of 200 bytes fall to anchors, one for each 85 bytes or so; an anchor's context is all bytes
       of its strings. Contexts are counted by a 128-bit cryptographic digest, after equal ones of a batch were added up.
    2. All strings of a context that occurs twice are repeated, so its bytes are covered.
    3. Anchors with different contexts, at the ends of repeats, go on: one row of each context fetches its bytes, which
       fall to pieces by the places of their strings, and the pieces that share a key are suffix-sorted together.
    """
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"), "text")
    raw = src.mapInArrow(_classes, CLASS).repartition("anchor")
    counted = raw.groupBy("anchor", "d1", "d2").agg(F.sum("times").alias("times"), F.first(F.struct("id", "th", "first", "off", "n")).alias("at"))
    kinds = counted.withColumn("m", F.count("*").over(Window.partitionBy("anchor")))
    classes = scratch.save(kinds.where("times > 1 or m > 1").select("d1", "d2", "times", "m", "at.*"))
    twice = classes.where("times > 1").select("d1", "d2")
    members = src.mapInArrow(_members, MEMBER).join(twice, ["d1", "d2"]).select("id", "th", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("end"))
    wanted = classes.where("m > 1").groupBy("id", "th").agg(F.collect_list(F.struct("times", "first", "off", "n")).alias("all"))
    # Rows that repeat an id and a text have the same contexts; one of them is enough here.
    texts = src.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "all")
    spans = members
    for more in _ends(scratch.save(texts.mapInArrow(_pieces, PIECE)), scratch):
        spans = spans.unionAll(more.select("id", "th", "start", "end"))
    return src, spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chain.from_iterable(common.slices(b, 1) for b in batches):
        ids, spans, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), ([], [], [], [], [])
        for i, text in enumerate(batch.column(1)):
            data = _bytes(text)
            runs = merged([(s["start"], s["end"]) for s in spans[i] or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            for k, v in zip(out, (ids[i], len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest())):
                k.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    A byte goes when a string of 200 bytes that covers it starts anywhere else in the table too, its own text included.
    Null texts count as empty; a null doc_id comes back null; rows that repeat an id and a text repeat each other.
    """
    src, spans = find(docs, scratch)
    out = src.join(spans, ["id", "th"], "left").select("id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return remove(common.table(spark, sf_dir, "documents"), common.Scratch(spark, "strings"))
