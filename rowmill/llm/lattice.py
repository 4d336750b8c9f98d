"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected at random onto blocks of eight dimensions, and each block is decoded to its nearest point of
the E8 lattice. A vector is filed under its own points in several tables and looks into the cells of the nearest
neighbouring lattice points. Pairs that meet are screened by a 64-bit sketch of signs, then verified by their cosine.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm import words as W
from rowmill.llm.components import components
from rowmill.session import materialize

COSINE = 0.9
# One setting for every size. At 64 dimensions 0.009 % of all pairs of random vectors meet, and more than 9 of 10 pairs
# whose cosine is 0.900 to 0.905 do. A larger spread of the projections against the lattice, or more blocks, means fewer
# chance meetings and less recall per table.
TABLES = 20
# Cells a vector looks into per table and block, its own included.
PROBES = 6
SCALE = 0.7
BLOCKS = 2
# Differing signs up to which a pair is verified. At a cosine of 0.9 the mean is 9.2 of 64, with a deviation of 2.8.
SKETCH_DISTANCE = 22


def _e8_steps() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


STEPS = _e8_steps()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst place the other way."""
    whole = np.rint(x)
    rest = x - whole
    worst = np.abs(rest).argmax(axis=1)
    rows = np.arange(len(x))
    other = np.where(rest[rows, worst] >= 0, 1.0, -1.0)
    whole[rows, worst] += np.where(whole.sum(axis=1) % 2 != 0, other, 0.0)
    return whole


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: even integer points, or those moved by a half in every place."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _point_hash(points: np.ndarray, table: int, block: int) -> np.ndarray:
    """Hash of lattice points, whose coordinates are halves."""
    out = np.full(points.shape[:-1], (table << 8) + block + 1, np.uint64)
    doubled = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    for i in range(8):
        out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + doubled[..., i])
    return out


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketch) of unit vectors: keys[vector, table, probe], probe 0 the vector's own cell."""
    n, dim = unit.shape
    rng = np.random.Generator(np.random.PCG64([dim, 8]))
    signs = rng.standard_normal((dim, 64))
    sketch = np.packbits(unit @ signs >= 0, axis=1, bitorder="little").view("<u8")[:, 0]
    keys = np.zeros((n, tables, 1 + (probes - 1) * blocks), np.uint64)
    for t in range(tables):
        own, near = [], []
        for b in range(blocks):
            x = unit @ (rng.standard_normal((dim, 8)) * scale)
            centre = decode(x)
            # |x - centre - step|^2 orders like -2 (x - centre) . step + |step|^2, and all steps are equally long.
            order = np.argpartition(-(x - centre) @ STEPS.T, probes - 2, axis=1)[:, : probes - 1]
            own.append(_point_hash(centre, t, b))
            near.append(_point_hash(centre[:, None, :] + STEPS[order], t, b))
        total = np.add.reduce(own)
        keys[:, t, 0] = total
        for b in range(blocks):
            at = 1 + b * (probes - 1)
            keys[:, t, at : at + probes - 1] = (total - own[b])[:, None] + near[b]
    return W.mix(keys + np.uint64(dim)), sketch


def _usable(v: Column) -> Column:
    """A vector that has a direction: no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _file(vectors: DataFrame, tables: int, probes: int, scale: float, blocks: int) -> DataFrame:
    """``rep, sketch, cell, away`` for every cell a vector looks into; ``away`` is false for its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 1000):
                batch = big.slice(at, 1000)
                sizes = np.array([len(v) for v in batch.column(1)])
                for dim in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == dim))
                    x = np.array(part.column(1).flatten(), np.float64).reshape(-1, dim)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    keys, sketch = cells(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes, scale, blocks)
                    each = keys.shape[1] * keys.shape[2]
                    away = np.tile(np.arange(keys.shape[2]) > 0, len(x) * tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array(part.column(0)), each)), pa.array(np.repeat(sketch.view(np.int64), each)), pa.array(keys.reshape(-1).view(np.int64)), pa.array(away)],
                        names=["rep", "sketch", "cell", "away"],
                    )

    return vectors.mapInArrow(run, "rep bigint, sketch bigint, cell bigint, away boolean")


def _verify(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs ``a, b`` whose vectors have a cosine of at least ``cosine``, in double precision."""
    left = pairs.join(vectors.select(F.col("rep").alias("a"), F.col("_v").alias("_x")), "a")
    both = left.join(vectors.select(F.col("rep").alias("b"), F.col("_v").alias("_y")), "b")
    both = both.where(F.size("_x") == F.size("_y")).select("a", "b", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            sizes = np.array([len(v) for v in batch.column(2)])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(at))
                x, y = (np.array(part.column(i).flatten(), np.float64).reshape(-1, dim) for i in (2, 3))
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                dot = np.einsum("ij,ij->i", x, y)
                keep[at] = dot / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, tables: int = TABLES,
                 probes: int = PROBES, scale: float = SCALE, blocks: int = BLOCKS) -> DataFrame:
    """``key, n_links, component_id, kept`` for every distinct (key, vector).

    Vectors that are null, all zero, or hold null or non-finite components link with nothing, as do rows with a NULL key
    (component NULL, not kept) and vectors of different lengths. Equal vectors are compared once, so that copies form
    no pairs but all count as links.
    """
    rows = df.select(F.col(key).cast("bigint").alias("_k"), F.col(vector).alias("_v")).distinct()
    rows = rows.withColumn("_ok", _usable(F.col("_v")) & F.col("_k").isNotNull())
    good = rows.where("_ok")
    vectors = materialize(good.groupBy("_v").agg(F.min("_k").alias("rep"), F.count("*").alias("copies")), "vectors")
    filed = materialize(_file(vectors.select("rep", "_v"), tables, probes, scale, blocks), "cells")
    own = filed.where(~F.col("away")).select(F.col("rep").alias("b"), F.col("sketch").alias("_s"), "cell")
    met = filed.join(own, "cell").where(
        ((F.col("away") & (F.col("rep") != F.col("b"))) | (F.col("rep") < F.col("b")))
        & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("_s"))) <= SKETCH_DISTANCE)
    )
    pairs = met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    links = materialize(_verify(pairs, vectors.select("rep", "_v"), cosine), "links")
    found = components(links)
    ends = links.select("a", "b").union(links.select("b", "a"))
    copies = vectors.select(F.col("rep").alias("b"), "copies")
    counted = ends.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("_others"))
    groups = (
        vectors.join(counted, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("_v", (F.coalesce("_others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    linked = good.join(groups, "_v").select("_k", "n_links", "component_id")
    alone = rows.where(~F.col("_ok")).select("_k", F.lit(0).cast("bigint").alias("n_links"), F.col("_k").alias("component_id"))
    return linked.union(alone).select(F.col("_k").alias(key), "n_links", "component_id", F.coalesce(F.col("_k") == F.col("component_id"), F.lit(False)).alias("kept"))
