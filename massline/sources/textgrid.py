"""Time-aligned annotation files (TextGrid, long and short): a row per file, tier and item, each with its extent."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: level is file, tier, item or error; a point is an item whose xmin and xmax are its time.
SCHEMA = "path string, level string, tier_idx int, cls string, tier string, item_idx int, xmin double, xmax double, label string, encoding string, error string"

# Byte-order marks with the name and codec of each.
MARKS = {b"\xef\xbb\xbf": ("utf-8-sig", "utf-8-sig"), b"\xfe\xff": ("utf-16-be-bom", "utf-16"), b"\xff\xfe": ("utf-16-le-bom", "utf-16")}

# What a file holds, in order. Long files write names and bracketed numbers between the values, which are skipped.
FILE = (("kind", "text"), ("object", "text"), ("xmin", "number"), ("xmax", "number"), ("tiers", "flag"))
TIER = (("cls", "text"), ("tier", "text"), ("xmin", "number"), ("xmax", "number"), ("size", "count"))
ITEMS = {"IntervalTier": (("xmin", "number"), ("xmax", "number"), ("label", "text")), "TextTier": (("xmin", "number"), ("label", "text"))}
KINDS, OBJECT = ("ooTextFile", "ooTextFile short"), "TextGrid"

_VALUE = re.compile(r'\[[\s\d]*\]|"(?P<text>(?:[^"]|"")*)"|(?P<flag><exists>|<absent>)|(?P<number>-?(?:\d+\.?|\.\d)\d*(?:[eE][+-]?\d+)?)')
_READ = {"text": lambda v: v.replace('""', '"'), "number": float, "flag": str}


def decode(raw: bytes) -> tuple[str, str]:
    """Text with plain line ends, and the name of its encoding: by byte-order mark, else ASCII, else strict UTF-8."""
    name, codec = next((found for mark, found in MARKS.items() if raw.startswith(mark)), (None, None))
    if name is None:
        if 0 in raw:
            raise ValueError("zero bytes without a byte-order mark")
        name = codec = "ascii" if raw.isascii() else "utf-8"
    return "\n".join(re.split("\r\n|\r", raw.decode(codec))), name


class Values:
    """The values of a file, read record by record as a layout asks for them."""

    def __init__(self, text: str):
        self.found = (m for m in _VALUE.finditer(text) if m.lastgroup)

    def record(self, layout: tuple) -> dict:
        out = {}
        for (name, kind), m in zip(layout, self.found):
            if m.lastgroup != ("number" if kind == "count" else kind):
                raise ValueError(f"{name} at {m.start()} should be a {kind}, not {m[0][:40]}")
            out[name] = _READ[m.lastgroup](m[m.lastgroup])
        if len(out) < len(layout):
            raise ValueError(f"the file ends before {layout[len(out)][0]}")
        return out


def parse(text: str) -> Iterator[dict]:
    """Rows of the file, its tiers and their items; anything missing, unknown or left over is a ValueError."""
    values = Values(text)
    head = values.record(FILE)
    if head["kind"] not in KINDS or head["object"] != OBJECT:
        raise ValueError("not a TextGrid")
    yield {"level": "file", "xmin": head["xmin"], "xmax": head["xmax"]}
    tiers = int(values.record((("size", "count"),))["size"]) if head["tiers"] == "<exists>" else 0
    for t in range(tiers):
        tier = values.record(TIER)
        layout = ITEMS.get(tier["cls"])
        if layout is None:
            raise ValueError(f"unknown class {tier['cls']}")
        of = {"tier_idx": t, "cls": tier["cls"], "tier": tier["tier"]}
        yield {"level": "tier", **of, "xmin": tier["xmin"], "xmax": tier["xmax"]}
        for i in range(int(tier["size"])):
            item = values.record(layout)
            yield {"level": "item", **of, "item_idx": i, "xmax": item["xmin"], **item}
    if tiers or head["tiers"] == "<exists>":
        left = sum(1 for _ in values.found)
        if left:
            raise ValueError(f"{left} values follow the last tier")


def rows_of(path: str, raw: bytes) -> list[dict]:
    """Rows of one file; one row with the error alone if it can't be read."""
    try:
        text, encoding = decode(raw)
        return [{"path": path, "encoding": encoding, **r} for r in parse(text)]
    except ValueError as e:
        return [{"path": path, "level": "error", "error": str(e)[:200]}]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path that Spark's own readers open, on any store: bytes by binaryFile, parsed where they are."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist(rows_of(p, c), schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.TextGrid").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def tier(grids: DataFrame, name: str) -> DataFrame:
    """Items of the one tier of that name in each file; a file with none or several of them is an error when it is read."""
    n = F.count_if((F.col("level") == "tier") & (F.col("tier") == name)).over(Window.partitionBy("path"))
    rows = grids.withColumn("_n", n).where("level = 'file' or level = 'item'")
    rows = rows.withColumn("_n", F.when(F.col("_n") == 1, F.lit(1)).otherwise(F.raise_error(F.concat(F.col("_n"), F.lit(f" tiers named {name} in "), F.col("path")))))
    return rows.where((F.col("_n") == 1) & (F.col("level") == "item") & (F.col("tier") == name)).drop("_n")
