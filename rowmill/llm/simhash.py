"""SimHash near-duplicates by segment popcounts.

A fingerprint's bit counts per segment are a point in a small grid. Flipping a bit moves the point by one step, so the
Manhattan distance of two points never exceeds the Hamming distance of their fingerprints. Points within two steps share
a grid point within one step of both, which makes the range join an equality join; the bits then decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm import words as W
from rowmill.llm.components import components
from rowmill.session import materialize

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 16  # of 4 bits; counts 0 to 4, one hex digit each
# Grid points with more fingerprints than this go through exact bit flips instead of pairs.
CROWD = 32
_BLOCK = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; 0 for a text without words.

    Words are lower-cased in A-Z. A text of fewer words than a shingle is one shingle.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    start, end = W.bounds(data)
    if not len(start):
        return 0
    joined = b" ".join(raw.split(None))
    length = end - start
    last = np.cumsum(length + 1) - 1
    first = last - length
    size = min(size, len(first))
    begins, ends = first[: len(first) - size + 1].tolist(), last[size - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), _BLOCK):
        spans = zip(begins[at : at + _BLOCK], ends[at : at + _BLOCK])
        values = np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(begins), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """All columns of ``df`` but the text, and the fingerprint as a signed 64-bit number."""
    rest = [c for c in df.columns if c not in (text, name)]
    source = df.select(*[f"`{c}`" for c in rest], f"`{text}`")
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(len(rest))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(values)], names=[*rest, name])

    return source.mapInArrow(run, schema)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grid_point(fp: Column) -> Column:
    """Bit counts of the 16 segments, plus one, as the hex digits of a 64-bit number."""
    def counts(half: Column) -> Column:
        pairs = half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftright(pairs, 2).bitwiseAND(F.lit(0x33333333)) + F.lit(0x11111111)

    low = F.lit(0xFFFFFFFF)
    return F.shiftleft(counts(F.shiftright(fp, 32).bitwiseAND(low)), 32) + counts(fp.bitwiseAND(low))


def near_points(point: Column) -> Column:
    """The grid point and all points one step away."""
    steps = [F.lit(1 << 4 * i).cast("bigint") for i in range(SEGMENTS)]
    return F.array(point, *[point + s for s in steps], *[point - s for s in steps])


def near_bits(fp: Column) -> Column:
    """The fingerprint and all fingerprints with one bit flipped."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("bigint")) for i in range(64)])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a, b`` that connect all distinct ``_fp`` at most two bits apart; no pair is further apart.

    Sparse grid points give every pair. Fingerprints at crowded points meet under their one-bit flips: all that share
    one are within two bits of each other, at most 65 of them, and are linked to the smallest. That is as exact, in rows
    linear in the number of fingerprints, but gives fewer links than there are pairs.
    """
    placed = prints.select("_fp", F.explode(near_points(grid_point(F.col("_fp")))).alias("_at"))
    sizes = placed.groupBy(F.col("_at").alias("_met")).count().where(F.col("count") > 1)
    # Up to 33 cells per fingerprint, which the size estimate of the exploded side does not see: no broadcast.
    met = placed.join(sizes.hint("merge"), F.col("_at") == F.col("_met")).select("_fp", "_at", "count")
    met = materialize(met, "cells")
    groups = met.where(F.col("count") <= crowd).groupBy("_at").agg(F.sort_array(F.collect_list("_fp")).alias("fps"))
    first = groups.select("fps", F.posexplode("fps").alias("_i", "a"))
    pairs = first.select("a", F.explode(F.slice("fps", F.col("_i") + 2, F.size("fps"))).alias("b"))
    sparse = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    crowded = met.where(F.col("count") > crowd).select("_fp").distinct()
    flips = crowded.select("_fp", F.explode(near_bits(F.col("_fp"))).alias("_flip"))
    stars = flips.groupBy("_flip").agg(F.collect_list("_fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where(F.col("a") != F.col("b"))
    return sparse.union(stars).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``key, fingerprint, component_id`` per row; component_id is the smallest key reachable over links.

    NULL and empty texts have the fingerprint zero and link like any other. Rows with a NULL key keep their fingerprint
    and get the component of their group's smallest key. Equal texts share a fingerprint, so copies never form pairs.
    """
    rows = materialize(fingerprints(df.select(F.col(key), F.col(text)), text), "prints")
    least = rows.groupBy("_fp").agg(F.min(key).alias("_least"))
    least = materialize(least, "distinct-prints")
    found = components(links(least.select("_fp"), crowd))
    grouped = least.join(found.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    roots = grouped.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_print = grouped.select("_fp", "root").join(roots, "root").select("_fp", "component_id")
    # Stored rows have a smaller size in files than in memory, and both sides grow with the documents: no broadcast.
    return rows.join(by_print.hint("merge"), "_fp").select(key, hex_digits(F.col("_fp")).alias("fingerprint"), "component_id")
