"""Records of delimited text whose quoted values hold line ends, read in parts.

Whether a split starts inside a quoted value is the parity of the quotes before it. A first scan counts the quotes of each
split; a running sum over the splits of a file, one small row each, gives every split its start. A second scan cuts each
split's lines into records by itself. A record that crosses a border of splits leaves one fragment on each side; fragments
of one record are joined in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmill.session import materialize

_SPLIT = ["file", "block"]
# What a piece of text is: a whole record, the end of one that began in an earlier split, the beginning of one that goes on in
# a later split, a split that lies inside one record.
WHOLE, END, BEGINNING, INSIDE = 0, 1, 2, 3
_OUT = "record string, file string, block bigint, kind int, first boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their split. A split's lines come in order, and ``at`` grows with them."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def split_starts(lines: DataFrame, quote: str = '"', escape: str = '"') -> DataFrame:
    """``file, block, inside, open``: whether a quoted value is open at the start and at the end of each split."""
    text = F.col("value")
    if escape != quote:
        text = F.regexp_replace(text, f"{_quoted(escape)}.", "")
    marks = F.char_length(text) - F.char_length(F.replace(text, F.lit(quote), F.lit("")))
    counts = lines.groupBy(*_SPLIT).agg(F.sum(marks).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return counts.select(*_SPLIT, (ahead % 2 == 1).alias("inside"), ((ahead + F.col("_n")) % 2 == 1).alias("open"))


def _quoted(char: str) -> str:
    return "\\" + char if not char.isalnum() else char


def _cutter(quote: str, escape: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function that cuts the lines of splits into records, or (not ``whole``) into the fragments at their borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, last, pending, inside, begun, first = None, -1, [], False, False, False
        out: list[tuple] = []

        def close() -> None:
            """The split is over; lines that wait for the end of their record go on in the next one."""
            if split is not None and pending and not whole:
                out.append(("\n".join(pending), *split, INSIDE if begun else BEGINNING, first))

        for batch in batches:
            files, blocks, ats, lines, starts = (batch.column(i) for i in range(5))
            block, at = blocks.to_numpy(), ats.to_numpy()
            if len(block) and ((np.diff(at) <= 0).any() or at[0] <= last):
                raise RuntimeError("lines of a split came out of order")
            last = int(at[-1]) if len(at) else last
            text = pc.replace_substring_regex(lines, f"{_quoted(escape)}.", "") if escape != quote else lines
            marks = pc.count_substring(text, quote).to_numpy(zero_copy_only=False)
            codes = files.dictionary_encode()
            code, names = codes.indices.to_numpy(), codes.dictionary
            turns = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
            singles = []
            for low, high in zip([0, *turns], [*turns, len(block)]):
                if low == high:
                    continue
                here = (names[int(code[low])].as_py(), int(block[low]))
                if here != split:
                    close()
                    split, pending, inside = here, [], bool(starts[int(low)].as_py())
                    begun, first = inside, here[1] == 0
                state = (int(inside) + np.cumsum(marks[low:high])) % 2
                inside = bool(state[-1])
                ends = np.flatnonzero(state == 0) + low
                if not len(ends):
                    pending += lines.slice(low, high - low).to_pylist()
                    continue
                # The first record may have begun in an earlier batch or split.
                head = pending + lines.slice(low, ends[0] - low + 1).to_pylist()
                if whole != begun:
                    out.append(("\n".join(head), *split, END if begun else WHOLE, first))
                begun = first = False
                begins = ends[:-1] + 1
                if whole and len(begins):
                    short = begins == ends[1:]
                    singles.append((begins[short], split))
                    for s, e in zip(begins[~short], ends[1:][~short]):
                        out.append(("\n".join(lines.slice(s, e - s + 1).to_pylist()), *split, WHOLE, False))
                pending = lines.slice(ends[-1] + 1, high - ends[-1] - 1).to_pylist()
            for places, (file, start) in singles:
                n = len(places)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [lines.take(pa.array(places)), pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([WHOLE] * n, pa.int32()), pa.array([False] * n)],
                        names=["record", "file", "block", "kind", "first"])
            if out:
                yield _batch(out)
                out.clear()
        close()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["record", "file", "block", "kind", "first"])


def read_records(spark: SparkSession, path: str, quote: str = '"', escape: str = '"') -> DataFrame:
    """``record, first``: every record as one text with its line ends, ``first`` for the first one of each file.

    Files are read in parts of ``spark.sql.files.maxPartitionBytes``, three times: quotes per split (counted when this is called),
    whole records, and fragments where a split starts inside a value. Only rows of one split are held at a time, and of them
    only the lines of the current record.

    Quotes must be balanced: a quote inside an unquoted value, which some writers leave as it is, would turn the parity.
    A file with an odd number of quotes fails the read. Text is UTF-8; a byte order mark and a CR before a record's
    line end are dropped, blank records outside quotes are left out, files without rows give none.
    """
    lines = _lines(spark, path)
    starts = materialize(split_starts(lines, quote, escape), "splits")
    last = starts.groupBy("file").agg(F.max_by("open", "block").alias("open"))
    broken = [r.file for r in last.where("open").select("file").limit(3).collect()]
    if broken:
        raise ValueError(f"unbalanced quotes in {sorted(broken)}")
    # At most one short row per split; the lines keep their order.
    odd = starts.where("inside").select(F.xxhash64("file").alias("_file"), F.col("block").alias("_block"), "inside")
    place = (F.xxhash64("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    placed = lines.join(F.broadcast(odd), place, "left").select(*_SPLIT, "at", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    out = placed.mapInArrow(_cutter(quote, escape, True), _OUT).select("record", "first")
    if not odd.isEmpty():
        crossed = placed.mapInArrow(_cutter(quote, escape, False), _OUT)
        order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
        chained = crossed.withColumn("_chain", F.sum((F.col("kind") == BEGINNING).cast("long")).over(order))
        parts = F.array_sort(F.collect_list(F.struct("block", "kind", "record")))
        joined = chained.groupBy("file", "_chain").agg(parts.alias("_parts"), F.bool_or("first").alias("first"))
        out = out.union(joined.select(F.array_join(F.transform("_parts", lambda p: p["record"]), "\n").alias("record"), "first"))
    clean = F.regexp_replace("record", r"\r\z", "")
    return out.select(F.when(F.col("first"), F.regexp_replace(clean, "\\A\ufeff", "")).otherwise(clean).alias("record"), "first").where("record != '' OR first")
