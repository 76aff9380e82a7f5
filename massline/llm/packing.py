"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
#: Windows that stay open in a partition.
OPEN = 32
#: Partitions whose last windows meet in one task of a merge.
FAN_IN = 256
#: Characters of a text that are encoded at once, up to the next gap between words.
CHUNK = 1 << 20
GAP = re.compile(r" (?=\S)")
#: White space in a row that the fast encoder takes; beyond a million it would fail.
RUN = 200_000
END = 0

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ROW = PIECE + ", ids binary"


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer file.

    A text is cut at the file's added tokens, as its tokenizer does, and the rest goes to a byte-pair encoder over the
    file's own vocabulary, at once: invented and rare words are so many that looking ids up word by word costs more.
    The file's pattern always begins a piece at a space that a visible character follows, so long texts are cut there.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        model = json.loads(self.slow.to_str())
        self.added = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.cut = re.compile("(" + ("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)") + ")")
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(back[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in self.added}
        # Fixed value: the pattern of byte-level tokenizers, 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+,
        # in a form that gives the same pieces without stepping back.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        probe = "It's 12 o'clock,  naïve\tÉtés\n\n  über 3.5% <|endoftext|> \U0001f600 end "
        # Tokens that take white space or only whole words are left to the file's tokenizer, and so is all if the probe differs.
        self.whole = any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in model["added_tokens"])
        self.whole = self.whole or self.ids(probe).tolist() != [*self.slow.encode(probe, add_special_tokens=False).ids, END]

    def _encode(self, text: str) -> list[int]:
        if len(text) > RUN and max((m.end() - m.start() for m in re.finditer(r"\s+", text)), default=0) > RUN:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        if self.whole:
            return np.array([*self.slow.encode(text, add_special_tokens=False).ids, END], dtype="<u4")
        found = array("I")
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:  # every second one is an added token
                found.append(self.added[part])
                continue
            at = 0
            while len(part) - at > CHUNK and (gap := GAP.search(part, at + CHUNK)):
                found.extend(self._encode(part[at : gap.start()]))
                at = gap.start()
            found.extend(self._encode(part[at:]))
        found.append(END)
        return np.array(found, dtype="<u4")


@lru_cache(maxsize=1)
def _encoder(path: str, changed: int) -> Encoder:
    """A worker's own, kept from task to task; ``changed`` is the file's time."""
    return Encoder(path)


class Packer:
    """Best fit into a fixed number of open windows; the fullest is topped up with a cut piece when none fits."""

    def __init__(self, base: int, size: int = WINDOW, most: int = OPEN):
        self.base, self.size, self.most, self.count = base, size, most, 0
        self.windows: list[tuple[int, list]] = []  # fill, pieces; kept by ascending fill
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.count, at, None))
            at += len(ids)
        self.count += 1

    def _put(self, fill: int, pieces: list) -> None:
        if fill == self.size:
            self._emit(pieces)
        else:
            at = next((i for i, w in enumerate(self.windows) if w[0] > fill), len(self.windows))
            self.windows.insert(at, (fill, pieces))

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self._emit([(doc, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            best = next((i for i in range(len(self.windows) - 1, -1, -1) if self.windows[i][0] + len(ids) <= self.size), None)
            if best is None and len(self.windows) < self.most:
                self._put(len(ids), [(doc, start, total, ids)])
                return
            if best is not None:
                fill, pieces = self.windows.pop(best)
                self._put(fill + len(ids), [*pieces, (doc, start, total, ids)])
                return
            fill, pieces = self.windows.pop()
            head = self.size - fill
            self._emit([*pieces, (doc, start, total, ids[:head])])
            start, ids = start + head, ids[head:]

    def merge(self) -> None:
        """Pour the emptiest windows into the fullest until at most one is left that isn't full."""
        while len(self.windows) > 1:
            fill, pieces = self.windows.pop()
            while fill < self.size and self.windows:
                low, others = self.windows.pop(0)
                doc, start, total, ids = others.pop()
                head = min(self.size - fill, len(ids))
                pieces.append((doc, start, total, ids[:head]))
                fill += head
                if head < len(ids):
                    others.append((doc, start + head, total, ids[head:]))
                if low > head:
                    self._put(low - head, others)
            self._put(fill, pieces)

    def last(self) -> None:
        """The one window left, as sequences whose lengths are powers of two: they need no padding."""
        for fill, pieces in self.windows:
            while fill:
                size, part, at = 1 << (fill.bit_length() - 1), [], 0
                while at < size:
                    doc, start, total, ids = pieces.pop(0)
                    head = min(size - at, len(ids))
                    part.append((doc, start, total, ids[:head]))
                    at += head
                    if head < len(ids):
                        pieces.insert(0, (doc, start + head, total, ids[head:]))
                self._emit(part)
                fill -= size
        self.windows = []

    def open_rows(self) -> list[tuple]:
        return [(doc, start, len(ids), 0, total, None, i, ids.tobytes()) for _, pieces in self.windows for i, (doc, start, total, ids) in enumerate(pieces)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = [x.split()[0] for x in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _merge(base: int, end: bool, window: int, most: int):
    def merge(key, table):
        packer = Packer(base + (key[0].as_py() << 32), window, most)
        for r in sorted(table.to_pylist(), key=lambda r: (r["grp"], r["offset"], r["start"])):
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], dtype="<u4"))
        packer.merge()
        if end:
            packer.last()
        out = pa.Table.from_batches([_batch(packer.rows + packer.open_rows())])
        return out.append_column("grp", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))

    return merge


def pack(docs: DataFrame, path: str, scratch: common.Scratch, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition of the input packs its documents as they come, each with an end id, and keeps a bounded number of
    open windows; a document longer than a window leaves full windows and a rest, and when no open window takes a rest,
    the fullest is filled with a cut of it and emitted. At its end a partition pours its open windows together, so that
    one that isn't full is left of each; these meet, up to 256 at a time, in as many merges as that takes. What is left
    of all becomes sequences whose lengths are powers of two. So nothing is padded. Both kinds of rows are written to
    the shared folder once, since a partition read anew must not pack otherwise.

    A null or empty text is its end id alone. Repeated rows are packed each; a null doc_id stays null.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = _encoder(path, os.stat(path).st_mtime_ns), Packer(TaskContext.get().partitionId() << 32, window, most)
        for batch in (b for whole in batches for b in common.slices(whole, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "")
                packer.add(doc, 0, len(ids), ids)
                if len(packer.rows) >= 4096:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.merge()
        packer.rows += packer.open_rows()
        if packer.rows:
            yield _batch(packer.rows)

    src = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    named = src.mapInArrow(first, ROW)
    part = F.spark_partition_id().cast("long").alias("grp")
    done = scratch.save(named.select("*", part))
    finished, level = [done.where("sequence_id is not null")], 1
    left = done.where("sequence_id is null")
    while True:
        top = left.agg(F.max("grp")).first()[0]
        if top is None:
            break
        end = top < FAN_IN
        met = left.withColumn("to", F.floor(F.col("grp") / FAN_IN).cast("long")).groupBy("to")
        met = scratch.save(met.applyInArrow(_merge(level << 56, end, window, most), ROW + ", grp long"))
        finished.append(met.where("sequence_id is not null"))
        if end:
            break
        left, level = met.where("sequence_id is null"), level + 1
    out = finished[0]
    for x in finished[1:]:
        out = out.unionAll(x)
    return out.select(*[x.split()[0] for x in PIECE.split(", ")])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), default_path(), common.Scratch(spark, "pack"))
