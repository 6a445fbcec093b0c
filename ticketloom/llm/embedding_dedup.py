"""Embedding near-dedup (operator 1): an exact metric range join.

Unit vectors are compared by distance: cosine >= t is the same as distance <= r = sqrt(2 - 2t).

1. Equal vectors of a label become one row with a count, before anything is joined.
2. Pivots are chosen from a sample of bounded size. A vector's home is the cell of its nearest pivot p.
   It is copied to the cell of a pivot q if a vector within r of it may live there: by the triangle
   inequality that needs |x - q| <= radius of q's cell + r, and the border between p and q, which in a
   Euclidean space lies (|x - q|^2 - |x - p|^2) / (2 |p - q|) away, must be within r.
3. Cells join on their own. All partners of a vector are in its home cell, so its links are counted
   there, once. A cell of many rows is cut into slices, and each pair of slices is a task of its own
   with at most ``2 * SLICE`` rows.
4. A task returns a count per vector and a tree of links per group, never its pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component link with
nothing, as do rows with a null label or id; vectors of different lengths do not link; equal rows
are separate vectors that link; a null id keeps its row, with a null component; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .common import share_below
from .graph import components

THRESHOLD = 0.98
SAMPLE = 4096
ROWS_PER_PIVOT = 512
MOST_PIVOTS = 256
SLICE = 2048
_CHUNK = 1 << 16
_SLACK = 1e-9


def _valid(vector: Column, label: Column, key: Column) -> Column:
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    return key.isNotNull() & label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _units(data: list, width: int) -> np.ndarray:
    vectors = np.frombuffer(b"".join(data), dtype="<f8").reshape(-1, width)
    # Scaled first, so that neither tiny nor huge components leave the range of doubles.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.asarray(v.values, dtype="<f8").tobytes() for v in batch.column("vector")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "label", "id", "copies")), pa.array(data, pa.binary())],
                                         names=["h1", "h2", "label", "id", "copies", "data"])


def _pivots(reps: DataFrame, largest: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: vectors of the sample that are not near one another."""
    count = int(np.clip(-(-largest // ROWS_PER_PIVOT), 1, MOST_PIVOTS))
    drawn = reps.filter(share_below(F.col("h1"), 2 * SAMPLE, reps.count()))
    sample = drawn.orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE).select("data").collect()
    by_width: dict[int, list] = {}
    for row in sample:
        by_width.setdefault(len(row["data"]) // 8, []).append(bytes(row["data"]))
    chosen = {}
    for width, data in by_width.items():
        units, far = _units(data, width), []
        for unit in units:
            if all(np.linalg.norm(unit - other) > 0.4 for other in far):
                far.append(unit)
                if len(far) == count:
                    break
        chosen[width] = np.array(far)
    return chosen


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def _cells(reps: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """A row per rep and cell it stands in: ``home`` for the one it lives in."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)
    numbers = ["h1", "h2", "label", "id", "copies"]

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        farthest: dict[tuple[int, int], float] = {}
        for batch in batches:
            for width, rows in _by_width(batch):
                if width in shared.value:
                    d = _distances(_units([batch.column("data")[i].as_py() for i in rows], width), shared.value[width])
                    for cell, value in zip(d.argmin(axis=1), d.min(axis=1)):
                        farthest[width, int(cell)] = max(farthest.get((width, int(cell)), 0.0), float(value))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in farthest], pa.int32()), pa.array([c for _, c in farthest], pa.int32()),
                                          pa.array(list(farthest.values()), pa.float64())], names=["width", "cell", "radius"])

    found = reps.select("data").mapInArrow(radii, "width int, cell int, radius double").groupBy("width", "cell").agg(F.max("radius").alias("radius"))
    radius = reps.sparkSession.sparkContext.broadcast({(r["width"], r["cell"]): r["radius"] for r in found.collect()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in _by_width(batch):
                points = shared.value.get(width)
                if points is None:
                    at, cells, homes = rows, np.zeros(len(rows), np.int32), np.ones(len(rows), bool)
                else:
                    d = _distances(_units([batch.column("data")[i].as_py() for i in rows], width), points)
                    home = d.argmin(axis=1)
                    between = np.maximum(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * points @ points.T))[home], 1e-12)
                    border = (d ** 2 - d[np.arange(len(rows)), home][:, None] ** 2) / (2 * between)
                    reaches = np.array([radius.value.get((width, q), -1.0) for q in range(len(points))]) + reach
                    inside = (border <= reach + _SLACK) & (d <= reaches[None] + _SLACK)
                    inside[np.arange(len(rows)), home] = True
                    which, cells = np.nonzero(inside)
                    at, homes = np.asarray(rows)[which], cells == home[which]
                out = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(out.column(c) for c in numbers), out.column("data"), pa.array(np.full(len(at), width), pa.int32()),
                     pa.array(cells, pa.int32()), pa.array(homes)], names=[*numbers, "data", "width", "cell", "home"])

    fields = [*reps.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("cell", T.IntegerType()),
              T.StructField("home", T.BooleanType())]
    return reps.mapInArrow(place, T.StructType(fields))


def _by_width(batch: pa.RecordBatch) -> list[tuple[int, list[int]]]:
    widths: dict[int, list[int]] = {}
    for i, data in enumerate(batch.column("data")):
        widths.setdefault(len(data.as_buffer()) // 8, []).append(i)
    return list(widths.items())


def _join_slices(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of slices: how many vectors each home vector links to, and a tree per group."""
    table = table.combine_chunks()
    get = {c: table.column(c).to_numpy() for c in ("h1", "h2", "id", "copies")}
    left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("as_home", "as_member"))
    width = table.column("width")[0].as_py()
    units = _units(table.column("data").to_pylist(), width)
    links, a, b = np.zeros(len(left), np.int64), [], []
    step = max(1, _CHUNK * 8 // max(1, len(right)))
    for start in range(0, len(left), step):
        rows = left[start:start + step]
        i, j = np.nonzero(units[rows] @ units[right].T >= threshold)
        i, j = rows[i], right[j]
        other = (get["h1"][i] != get["h1"][j]) | (get["h2"][i] != get["h2"][j])
        i, j = i[other], j[other]
        np.add.at(links, np.searchsorted(left, i), get["copies"][j])
        a.append(i)
        b.append(j)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    root = _local_roots(a, b, get["id"])
    ids = np.concatenate((get["id"][left], get["id"][a], get["id"][b]))
    roots = np.concatenate((get["id"][left], root[a], root[b]))
    counts = np.concatenate((links, np.zeros(2 * len(a), np.int64)))
    h1, h2 = (np.concatenate((get[c][left], get[c][a], get[c][b])) for c in ("h1", "h2"))
    _, first = np.unique(np.stack((h1, h2, roots, counts > 0), axis=1), axis=0, return_index=True)
    keep = np.union1d(np.arange(len(left)), first)
    return pa.table({"h1": h1[keep], "h2": h2[keep], "id": ids[keep], "root": roots[keep], "links": counts[keep]})


def _local_roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id each row reaches over the links (a, b)."""
    root = ids.copy()
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, root[a])
        if np.array_equal(before, root):
            break
    return root


def near_duplicates(df: DataFrame, key: str, vector: str, label: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, ``n_links``, ``component_id`` and ``kept``, a row per row."""
    reach = float(np.sqrt(2.0 - 2.0 * threshold)) + 1e-7
    numbers = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = df.select(F.col(key).alias("_id"), F.col(label).alias("_label"), numbers.alias("_vector")).select(
        "_id", "_vector", F.col("_label"), _valid(F.col("_vector"), F.col("_label"), F.col("_id")).alias("_valid"))
    rows = rows.withColumns({"_h1": F.when(F.col("_valid"), F.xxhash64("_label", "_vector")),
                             "_h2": F.when(F.col("_valid"), F.xxhash64(F.lit("second"), "_label", "_vector"))})
    distinct = rows.filter("_valid").groupBy(F.col("_h1").alias("h1"), F.col("_h2").alias("h2")).agg(
        F.first("_label").alias("label"), F.min("_id").cast("bigint").alias("id"), F.count(F.lit(1)).alias("copies"),
        F.first("_vector").alias("vector"))
    label_type, long = df.schema[label].dataType, T.LongType()
    schema = T.StructType([T.StructField("h1", long), T.StructField("h2", long), T.StructField("label", label_type),
                           T.StructField("id", long), T.StructField("copies", long), T.StructField("data", T.BinaryType())])
    reps = stored(distinct.mapInArrow(_to_bytes, schema), "vectors")
    largest = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    placed = stored(_cells(reps, _pivots(reps, largest), reach), "cells")

    cell = ["label", "width", "cell"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices"))
    sliced = placed.join(sizes, cell).withColumn("_own", F.pmod("h1", F.col("_slices")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_slices") - 1)
    as_member = F.transform(others, lambda i: F.struct(i.alias("i"), F.col("_own").alias("j")))
    as_home = F.transform(others, lambda j: F.struct(F.col("_own").alias("i"), j.alias("j")))
    tasks = sliced.withColumn("_at", F.explode(F.array_distinct(F.concat(as_member, F.when(F.col("home"), as_home).otherwise(
        F.array().cast("array<struct<i:int,j:int>>"))))))
    tasks = tasks.select(*cell, "h1", "h2", "id", "copies", "data", F.col("_at.i").alias("i"), F.col("_at.j").alias("j"),
                         (F.col("home") & (F.col("_at.i") == F.col("_own"))).alias("as_home"),
                         (F.col("_at.j") == F.col("_own")).alias("as_member"))
    joined = stored(tasks.groupBy(*cell, "i", "j").applyInArrow(
        lambda table: _join_slices(table, threshold), "h1 long, h2 long, id long, root long, links long"), "links")

    counted = joined.groupBy("h1", "h2").agg(F.sum("links").alias("_links"), F.min("id").alias("_rep"))
    linked = components(joined.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
    copies = reps.select("h1", "h2", "copies")
    known = counted.join(copies, ["h1", "h2"]).join(linked, F.col("_rep") == F.col("node"), "left").select(
        "h1", "h2", (F.col("_links") + F.col("copies") - 1).alias("_n"), F.coalesce("component", "_rep").alias("_component"))
    own = F.col("_id").cast("bigint")
    result = rows.join(known, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left")
    return result.select(F.col("_id").alias(key), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"),
                         F.coalesce("_component", own).alias("component_id"),
                         own.eqNullSafe(F.coalesce("_component", own)).alias("kept"))
