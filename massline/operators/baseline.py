"""Boundaries of conversations and the random baseline on them, a conversation at a time on compact arrays.

A turn travels as a string with one letter for each of its items, never as words. A draw takes the gaps of a window
whose hashes come first; MD5 of all gaps and draws of a window is worked out at once on vectors of 32-bit words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "¶"
WORD, STOP, COMMA, MARK = (ord(c) for c in "w.,n")
BOUNDARIES = "struct<n:int,ref:array<int>,turns:array<int>,hyp:array<int>>"
#: Hashes of a step, whose vectors fit a core's cache; cells of draws times words that are held at once; rows of a batch.
STEP, CELLS, ROWS = 1 << 15, 1 << 22, 1 << 18


def coded(text: Column) -> Column:
    """A letter for each item of a text: w a word, . or , one that ends so, n a line break; null without words."""
    items = F.filter(F.split(F.regexp_replace(text, "\n", f" {LINE} "), r"\s+"), lambda x: x != "")
    letters = F.array_join(F.transform(items, lambda x: F.when(x == LINE, "n").when(x.endswith("."), ".").when(x.endswith(","), ",").otherwise("w")), "")
    return F.when(letters.rlike("[^n]"), letters)


def boundaries(conversations: DataFrame) -> DataFrame:
    """conv_id, n, ref, turns, hyp: what ``transcripts.arrays`` makes of the token table, from one row of letters a turn.

    Rows are dealt out by number, as the planner would gather them into few tasks by their size.
    """
    rows = conversations.select("conv_id", F.struct("turn", "role", coded(F.col("text")).alias("items")).alias("x")).where("x.items is not null")
    rows = rows.repartition(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    x = F.sort_array(F.collect_list("x"))
    # What tells turns apart: equal numbers, in order, get equal ranks.
    each = rows.groupBy("conv_id").agg(x.alias("x")).select("conv_id", F.col("x.turn").cast("array<string>").alias("turn"), F.col("x.role").cast("array<string>").alias("role"), F.col("x.items").alias("items"))
    return each.select("conv_id", F.arrow_udf(_boundaries, BOUNDARIES)("turn", "role", "items").alias("b")).select("conv_id", "b.*")


def assembled(turn: list, role: list, items: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, ref, turns, hyp of the rows of a conversation, which are in order of their turn."""
    rank = np.cumsum([i > 0 and t != turn[i - 1] for i, t in enumerate(turn)])
    tid = np.cumsum([i > 0 and (r is None or r != role[i - 1]) for i, r in enumerate(role)])
    sizes = [len(x) for x in items]
    code = np.frombuffer("".join(items).encode("ascii"), np.uint8)
    row = np.repeat(np.arange(len(items)), sizes)
    line = np.zeros(len(code), bool)
    line[1:] = (code[:-1] == MARK) & (row[:-1] == row[1:])
    word = code != MARK
    at = np.flatnonzero(word)
    if len(rank) > rank[-1] + 1:
        # Rows that share a turn's number take turns item by item.
        begins = np.cumsum([0, *sizes[:-1]])
        at = at[np.lexsort((row[at], at - begins[row[at]], rank[row[at]]))]
    code, line, row = code[at], line[at], row[at]
    n, pos, tid, rank = len(at), np.arange(1, len(at) + 1, dtype=np.int32), tid[row], rank[row]
    first, last = np.zeros(tid.max() + 1, np.int32), np.zeros(tid.max() + 1, np.int32)
    np.maximum.at(last, tid, pos)
    first[:] = n + 1
    np.minimum.at(first, tid, pos)
    ends = np.append(rank[1:] != rank[:-1], True)
    comma = np.append(False, code[:-1] == COMMA)
    ref, cue = (code == STOP) | ends, (pos > first[tid]) & (line | comma)
    return n, pos[ref & (pos < n)], np.sort(last[last < n]), pos[cue] - 1


def _boundaries(turn: pa.Array, role: pa.Array, items: pa.Array) -> pa.Array:
    found = [assembled(t.as_py(), r.as_py(), x.as_py()) for t, r, x in zip(turn, role, items)]
    lists = [_lists([x[i] for x in found]) for i in (1, 2, 3)]
    return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int32()), *lists], ["n", "ref", "turns", "hyp"])


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0)]).astype(np.int32)))


# MD5 (RFC 1321): constants and turns of its 64 steps.
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WHICH = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_words(words: list, shape: tuple[int, int]) -> np.ndarray:
    """First 32 bits of the MD5 of messages of one block, to be compared as their hex digits are.

    words: the 16 words of the block, each a number or an array that fits the shape. The first word of the digest is
    whole after 61 of the 64 steps.
    """
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        w = words[_WHICH[i]]
        np.add(t, a, out=t)
        if isinstance(w, np.ndarray):
            np.add(t, w, out=t)
            w = 0
        np.add(t, np.uint32((_K[i] + w) & 0xFFFFFFFF), out=t)
        np.left_shift(t, np.uint32(_TURN[i]), out=u)
        np.right_shift(t, np.uint32(32 - _TURN[i]), out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(b, np.uint32(_START[0]), out=b)
    return b.byteswap(inplace=True)


def keys(prefix: str, draws: range, gaps: np.ndarray) -> np.ndarray:
    """First 32 bits of MD5("prefix draw|gap") of each draw and gap; all draws have equally many digits."""
    heads = [f"{prefix}{d}|".encode() for d in draws]
    size = len(heads[0])
    tails = gaps.astype(f"U{len(str(gaps.max()))}").astype(np.bytes_)
    lengths = np.char.str_len(tails)
    if size + int(lengths.max()) > 55:
        out = np.empty((len(heads), len(gaps)), np.uint32)
        for i, h in enumerate(heads):
            begun = hashlib.md5(h)
            for j, t in enumerate(tails.tolist()):
                whole = begun.copy()
                whole.update(t)
                out[i, j] = int.from_bytes(whole.digest()[:4], "big")
        return out
    head = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(len(heads), 16)
    shift, width = size % 4, tails.dtype.itemsize
    tail = np.zeros((len(gaps), 16), np.uint8)
    tail[:, shift : shift + width] = tails.view(np.uint8).reshape(len(gaps), width)
    tail[np.arange(len(gaps)), shift + lengths] = 0x80
    tail = tail.view("<u4")
    words: list = []
    for j in range(14):
        col, k = head[:, j], j - size // 4
        part = tail[:, k] if 0 <= k < 4 else None
        same = int(col[0]) if (col == col[0]).all() else None
        if part is None or not part.any():
            words.append(same if same is not None else np.ascontiguousarray(col)[:, None])
        elif same is not None:
            words.append((part | np.uint32(same))[None, :])
        else:
            words.append(col[:, None] | part[None, :])
    return first_words([*words, ((lengths + size) * 8).astype(np.uint32)[None, :], 0], (len(heads), len(gaps)))


def least(key: np.ndarray, k: int, whole) -> np.ndarray:
    """Which k of each row's keys come first; whole(row, column) settles those that agree in their first bits."""
    if k in (0, key.shape[1]):
        return np.full(key.shape, k > 0)
    edge = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
    out = key <= edge
    for r in np.flatnonzero(out.sum(1) != k):
        tied = np.flatnonzero(key[r] == edge[r])
        out[r, sorted(tied, key=lambda c: whole(r, c))[k - int((key[r] < edge[r]).sum()) :]] = False
    return out


def drawn(conv_id: str | None, n: int, ref: np.ndarray, turns: np.ndarray, draws: int, seed: int, core: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first draw, flags of draws times n gaps from 0) in blocks of draws; nothing where no gap can be drawn.

    For each window, as many gaps as the reference has inside turns, by hash order; the last gap of a window and those
    that end a turn can't be drawn.
    """
    free = np.ones(n, bool)
    free[::core] = False
    free[turns] = False
    is_ref = np.zeros(n, bool)
    is_ref[ref] = True
    gaps = np.flatnonzero(free)
    if not len(gaps):
        return
    prefix = f"{seed}|" if conv_id is None else f"{seed}|{conv_id}|"
    cuts = np.flatnonzero(np.diff(gaps // core, prepend=-1, append=-1))
    wins = [(lo, hi, int(is_ref[gaps[lo:hi]].sum())) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    most = max(1, CELLS // n)
    at = 0
    while at < draws:
        # Up to the next number of draws with a digit more.
        block = range(at, min(draws, at + most, 10 ** len(str(at))))
        flags = np.zeros((len(block), n), bool)
        i = 0
        while i < len(wins):
            # Windows are hashed together as far as a step goes, and draws one by one where a window fills it.
            j = i + 1
            while j < len(wins) and (wins[j][1] - wins[i][0]) * len(block) <= STEP:
                j += 1
            some = gaps[wins[i][0] : wins[j - 1][1]]
            d = max(1, STEP // len(some))
            if any(k for _, _, k in wins[i:j]):
                for s in range(0, len(block), d):
                    part = block[s : s + d]
                    key = keys(prefix, part, some)
                    for lo, hi, k in wins[i:j]:
                        mine = gaps[lo:hi]
                        off = lo - wins[i][0]
                        flags[s : s + d, mine] = least(key[:, off : off + hi - lo], k, lambda r, c: (hashlib.md5(f"{prefix}{part[r]}|{mine[c]}".encode()).hexdigest(), mine[c]))  # noqa: B023
            i = j
        yield at, flags
        at = block.stop


def window(n_ref: int, n: int) -> int:
    """As ``segments.window_size``."""
    return max(int(np.rint(n / (n_ref + 1) / 2)), 2)


METRICS = ("f1", "window_diff", "boundary_similarity")
STATS = "struct<" + ",".join(f"{m}_{k}:double" for m in METRICS for k in ("mean", "lo", "hi")) + ">"
SCORED = f"struct<draws:bigint,within_turn:{STATS},all_boundaries:{STATS}>"


def measured(conv_id: str | None, n: int, ref: np.ndarray, turns: np.ndarray, draws: int, seed: int, core: int, full: bool) -> dict | None:
    """Mean, least and greatest of the metrics of all draws, in both scopes; only F1 within turns where not full.

    What a draw has beyond the reference, and the other way round, is the same in both scopes, as turns are on both sides.
    """
    inner = np.zeros(n, bool)
    inner[ref] = True
    inner[turns] = False
    n_in, both = int(inner.sum()), len(np.union1d(ref, turns))
    scopes = {"within_turn": (n_in, 0), "all_boundaries": (both, len(turns))} if full else {"within_turn": (n_in, 0)}
    got: dict = {s: {m: [] for m in METRICS} for s in scopes}
    for _, flags in drawn(conv_id, n, ref, turns, draws, seed, core):
        hyp, tp = flags.sum(1), (flags & inner).sum(1)
        if full:
            diff = flags.view(np.int8) - inner.view(np.int8)
            upto = np.cumsum(diff, axis=1, dtype=np.int32)
            # Neighbours of both sides pair from the left: every other link of a run of links makes a pair.
            row, col = np.nonzero((diff[:, 1:] + diff[:, :-1] == 0) & (diff[:, 1:] != 0))
            link = row * n + col
            fresh = np.append(True, link[1:] != link[:-1] + 1) if len(link) else np.zeros(0, bool)
            nth = np.arange(len(link)) - np.maximum.accumulate(np.where(fresh, np.arange(len(link)), 0))
            pairs = np.bincount(row[nth % 2 == 0], minlength=len(flags))
            odd = hyp + n_in - 2 * tp
        for s, (r, more) in scopes.items():
            h, t = hyp + more, tp + more
            p = np.divide(t, h, out=np.full(len(h), float(r == 0)), where=h > 0)
            q = t / r if r else (h == 0).astype(float)
            got[s]["f1"] += np.divide(2 * p * q, p + q, out=np.zeros(len(h)), where=p + q > 0).tolist()
            if full:
                k = window(r, n)
                if n > k:
                    got[s]["window_diff"] += ((upto[:, k:] != upto[:, : n - k]).sum(1) / (n - k)).tolist()
                extra = odd - 2 * pairs
                total = extra + pairs + t
                got[s]["boundary_similarity"] += np.divide(total - extra - pairs * 0.5, total, out=np.ones(len(h)), where=(total > 0) & (n > 1)).tolist()
    if not got["within_turn"]["f1"]:
        return None
    stats = lambda m, x: {f"{m}_mean": float(np.add.accumulate(x)[-1]) / len(x), f"{m}_lo": min(x), f"{m}_hi": max(x)} if x else {}
    return {"draws": draws, **{s: {k: v for m in METRICS for k, v in stats(m, x[m]).items()} for s, x in got.items()}}


def _ints(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(np.int64)


def scored(conv: DataFrame, draws: int, seed: int, core: int, full: bool = False) -> DataFrame:
    """Adds random to rows of ``boundaries``: how many draws, and their metrics by scope; null where nothing can be drawn."""
    kinds = T._parse_datatype_string(SCORED)

    def run(conv_id: pa.Array, n: pa.Array, ref: pa.Array, turns: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([measured(c.as_py(), k.as_py(), _ints(r), _ints(t), draws, seed, core, full) for c, k, r, t in zip(conv_id, n, ref, turns)], to_arrow_type(kinds))

    # Not held for deterministic, as the planner works out all draws once more for a filter on them.
    return conv.withColumn("random", F.arrow_udf(run, kinds).asNondeterministic()(F.col("conv_id").cast("string"), "n", "ref", "turns"))


def draws_of(conv: DataFrame, draws: int, seed: int, core: int) -> DataFrame:
    """conv_id, draw, b: a row for each boundary drawn, in batches of bounded size."""
    kind = T.StructType([conv.schema["conv_id"], T.StructField("draw", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, held, rows = x.column("conv_id"), [], 0

            def batch(held: list) -> pa.RecordBatch:
                of = np.concatenate([np.full(len(b), i, np.int64) for i, _, b in held])
                return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(np.concatenate([d for _, d, _ in held])), pa.array(np.concatenate([b for _, _, b in held]))], ["conv_id", "draw", "b"])  # noqa: B023

            for i, (c, n, ref, turns) in enumerate(zip(x.column("_key"), x.column("n"), x.column("ref"), x.column("turns"))):
                for first, flags in drawn(c.as_py(), n.as_py(), _ints(ref), _ints(turns), draws, seed, core):
                    d, b = np.nonzero(flags)
                    held.append((i, d + first, b))
                    rows += len(b)
                    if rows >= ROWS:
                        yield batch(held)
                        held, rows = [], 0
            if held:
                yield batch(held)

    return conv.select("conv_id", F.col("conv_id").cast("string").alias("_key"), "n", "ref", "turns").mapInArrow(run, kind)
