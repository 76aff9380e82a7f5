"""Timed transcripts: start, end, speaker and text per line, with fragments that & joins."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bytes that no transcription means, and apostrophes that count as the plain one.
STRAY = {0x00: "NUL", 0x7F: "DEL"}
CURLY = str.maketrans({"\u2019": "'", "\u2018": "'"})

HEAD = r"^\s*(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s*(.*)$"


def decode(raw: bytes, codec: str) -> tuple[list[str], list[tuple[int, str]]]:
    """Lines of a file, whatever ends them, and the stray bytes that were taken out: line and name of each.

    Strict: a byte that the codec doesn't know is an error and never replaced.
    """
    strays = [(raw.count(b"\n", 0, m.start()) + 1, STRAY[m[0][0]]) for m in re.finditer(b"[\0\x7f]", raw)]
    text = raw.translate(None, bytes(STRAY)).decode(codec).translate(CURLY)
    return re.split("\r\n|\r|\n", text), strays


def lines(spark: SparkSession, path: str, codecs: dict[str, str] | None = None, default: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """(file, doc, no, line of every file under the path; file, doc, no, byte of every stray byte).

    codecs gives the encoding of a document, by its file's name without the ending, where it isn't the default.
    """

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = file.rsplit("/", 1)[-1].split(".", 1)[0]
                try:
                    found, strays = decode(raw, (codecs or {}).get(doc, default))
                except UnicodeDecodeError as e:
                    raise ValueError(f"{file}: {e}") from None
                rows = [(file, doc, i, line, None) for i, line in enumerate(found, 1)] + [(file, doc, i, None, name) for i, name in strays]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["file", "doc", "no", "line", "byte"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, doc string, no int, line string, byte string")
    return files.where("byte is null").drop("byte"), files.where("byte is not null").drop("line")


def _named(places: Iterable[tuple[str, int]]):
    """Whether a line is one of the named places (document, line)."""
    keys = [f"{doc}:{no}" for doc, no in places]
    return F.concat_ws(":", "doc", F.col("no").cast("string")).isin(keys) if keys else F.lit(False)


def fields(rows: DataFrame, speakerless: Iterable[tuple[str, int]] = ()) -> DataFrame:
    """Adds start, end, speaker, text, reason to (file, doc, no, line).

    With a tab, the speaker is what stands before the first one and the text the only part behind it that isn't blank;
    without, a leading NAME: is the speaker. Lines named in ``speakerless`` have no speaker, and their tabs are strays
    between the parts of one text. reason tells why a line is left out.
    """
    rest = F.regexp_extract("line", r"^\s*[\d.]+[ \t]+[\d.]+[ \t]?([\s\S]*)$", 1)
    parts = F.split(rest, "\t")
    tabbed = F.size(parts) > 1
    body = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: F.trim(x) != "")
    name = F.regexp_extract(rest, r"^\s*(>?[A-Z][A-Z0-9_ /]*):\s*", 1)
    speaker = F.when(tabbed, F.regexp_replace(F.trim(F.element_at(parts, 1)), ":$", "")).otherwise(name)
    text = F.when(tabbed, F.trim(F.try_element_at(body, F.lit(1)))).otherwise(F.trim(F.regexp_replace(rest, r"^\s*>?[A-Z][A-Z0-9_ /]*:\s*", "")))
    number = lambda i: F.regexp_extract("line", HEAD, i).try_cast("double")
    out = rows.where(F.trim("line") != "").select("*", number(1).alias("start"), number(2).alias("end"), F.nullif(speaker, F.lit("")).alias("said"), F.coalesce(text, F.lit("")).alias("text"), F.when(tabbed, F.size(body)).otherwise(1).alias("n"))
    joined = F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), " ")
    bare = _named(speakerless)
    out = out.withColumns({"said": F.when(~bare, F.col("said")), "text": F.when(bare, joined).otherwise(F.col("text")), "n": F.when(bare, F.lit(1)).otherwise(F.col("n"))})
    early = F.when(F.col("line").contains("\\"), "backslash_fused").when(F.col("start").isNull(), "no_times").when(F.col("n") > 1, "ambiguous_fields").when(F.col("said").startswith("$"), "dubois_dollar_note")
    return out.withColumn("reason", early).drop("n")


def read(spark: SparkSession, path: str, codecs: dict[str, str] | None = None, apart: Iterable[tuple[str, int]] = (), speakerless: Iterable[tuple[str, int]] = ()) -> tuple[DataFrame, DataFrame]:
    """(units, excluded): units file, unit, speaker, start, end, text, merged_from; excluded file, no, reason, line.

    A line without a speaker has the one before it, also when that was a non-participant (>NAME), whose lines are left
    out. A text that ends in & goes on in the speaker's next line that begins with &; the unit stands where its first
    fragment does. An & that nothing answers is left out with a reason. Lines named in ``apart`` (document, line) are
    units of their own in spite of their &, which goes; see ``fields`` and ``lines`` for the other two parameters.
    """
    w = Window.partitionBy("file").orderBy("no")
    rows = fields(lines(spark, path, codecs)[0], speakerless)
    lone = _named(apart)
    rows = rows.withColumn("speaker", F.last(F.when(F.col("reason").isNull(), F.col("said")), ignorenulls=True).over(w))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("speaker").startswith(">"), "non_participant_speaker")))
    good = rows.where("reason is null").withColumns({"opens": F.col("text").startswith("&") & ~lone, "goes_on": F.col("text").endswith("&") & ~lone})
    by = Window.partitionBy("file", "speaker").orderBy("no")
    good = good.withColumns({"held": F.coalesce(F.lag("goes_on").over(by), F.lit(False)), "next": F.coalesce(F.lead("opens").over(by), F.lit(False))})
    good = good.withColumn("bad", (F.col("opens") != F.col("held")) | (F.col("goes_on") != F.col("next")))
    excluded = rows.where("reason is not null").select("file", "no", "reason", "line").unionByName(good.where("bad").select("file", "no", F.lit("unanswered_fragment").alias("reason"), "line"))
    good = good.where("not bad").withColumn("frag", F.sum(F.when(F.col("opens"), 0).otherwise(1)).over(by))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("text"), "^&", ""), "&$", ""))
    g = good.groupBy("file", "speaker", "frag").agg(F.min("no").alias("no"), F.min_by("start", "no").alias("start"), F.max_by("end", "no").alias("end"), F.array_sort(F.collect_list(F.struct("no", bare.alias("t")))).alias("x"), F.count("*").cast("int").alias("merged_from"))
    units = g.select("file", F.row_number().over(w).alias("unit"), "speaker", "start", "end", F.array_join(F.transform("x", lambda p: p["t"]), " ").alias("text"), "merged_from")
    return units, excluded
