"""Embedding near-duplicates by an exact metric range join.

Cosine at least t between unit vectors is distance at most e = sqrt(2 - 2t).  Pivots, a bounded
sample of the vectors, partition the space: each vector is at home in the cell of its nearest
pivot.  It also visits every cell where a partner could be at home: by the triangle inequality its
distance to that pivot is at most the cell's radius plus e, and its distance to the plane between
that pivot and its own nearest is at most e.  Cells join independently, visitors against homes, so
a pair is counted once from each side and none is lost.  A full cell is dealt into chunks of
``chunk_rows`` homes, each visited alike, so no cell grows with the data.

Bit-identical vectors are one class, compared once and counted with its size.  A task counts links
and emits, per linked vector, one edge to the smallest member of its local component, never pairs.
Single precision only screens; a link whose cosine is near the threshold is decided in double.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do vectors of different lengths with each other; a null vec_id links with nothing and
has a null component; repeated rows are vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, record
from siltwork.llm.components import components

_ROWS = 1024
_SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, whatever their magnitude."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


class Cells:
    """The pivots, and after the first pass each cell's radius and number of chunks."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.radius = np.zeros(len(pivots))
        self.chunks = np.ones(len(pivots), np.int64)
        gaps = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2) if len(pivots) <= 256 else np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        self.gaps = np.maximum(gaps, 1e-12)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (x @ self.pivots.T)))

    def visits(self, distance: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """Mask of the cells that each vector must visit."""
        own = distance[np.arange(len(home)), home][:, None]
        plane = (distance**2 - own**2) / (2 * self.gaps[home])
        near = (distance <= self.radius + reach + _SLACK) & ((plane <= reach + _SLACK) | (self.gaps[home] <= 1e-6))
        near[np.arange(len(home)), home] = True
        return near & (self.chunks > 0)


def _local_roots(mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each row's and column's component in the bipartite graph of the mask."""
    big = np.iinfo(np.int64).max
    row, col = rows.copy(), cols.copy()
    while True:
        new_row = np.minimum(row, np.where(mask, col, big).min(1))
        new_col = np.minimum(col, np.where(mask, new_row[:, None], big).min(0))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


class _Group:
    """One chunk of a cell: its homes, against which visitors stream."""

    def __init__(self, least: float):
        self.least, self.homes, self.ids, self.size = least, [], [], []
        self.ready = None

    def add(self, x, ids, size):
        self.homes.append(x)
        self.ids.append(ids)
        self.size.append(size)

    def visit(self, x: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> list[tuple]:
        if self.ready is None:
            if not self.homes:
                return []
            homes = np.concatenate(self.homes)
            self.ready = homes, homes.astype(np.float32).T.copy(), np.concatenate(self.ids), np.concatenate(self.size)
        homes, narrow, home_ids, sizes = self.ready
        margin, out = 4e-7 * homes.shape[1] + 1e-6, []
        for k in range(0, len(x), _ROWS):
            part, part_ids, part_keys = x[k : k + _ROWS], ids[k : k + _ROWS], keys[k : k + _ROWS]
            cosine = part.astype(np.float32) @ narrow
            mask = cosine >= self.least - margin
            rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
            if not len(rows):
                continue
            sub, near = mask[np.ix_(rows, cols)], cosine[np.ix_(rows, cols)]
            r, c = np.nonzero(sub & (near < self.least + margin))
            for j in range(0, len(r), 65_536):
                rj, cj = r[j : j + 65_536], c[j : j + 65_536]
                sub[rj, cj] = np.einsum("ij,ij->i", part[rows[rj]], homes[cols[cj]]) >= self.least
            row_root, col_root = _local_roots(sub, part_ids[rows], home_ids[cols])
            links = sub @ sizes[cols]
            some = links > 0
            out.append((part_ids[rows][some], part_keys[rows][some], links[some], row_root[some]))
            moved = col_root < home_ids[cols]
            out.append((home_ids[cols][moved], np.zeros(int(moved.sum()), np.int64), np.zeros(int(moved.sum()), np.int64), col_root[moved]))
        return out


def _links_of(classes: DataFrame, dim: int, least: float, max_pivots: int, chunk_rows: int) -> DataFrame:
    """(rep, key, links, root) rows of all classes of one length, several per class."""
    spark = classes.sparkSession
    n = classes.count()
    wanted = min(max_pivots, max(1, n // chunk_rows))
    chosen = classes.orderBy(F.xxhash64("rep", "key"), "rep", "key").limit(wanted).select("embedding").toArrow()
    cells = Cells(_matrix(chosen.column(0), dim))
    first = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("radius", pa.float64())])
        for batch in batches:
            d = first.value.distances(_matrix(batch.column(0), dim))
            home = d.argmin(1)
            yield record(schema, {"cell": home.astype(np.int32), "radius": d[np.arange(len(home)), home]})

    stats = classes.select("embedding").mapInArrow(assign, "cell int, radius double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).collect()
    cells.chunks = np.zeros(len(cells.pivots), np.int64)
    for row in stats:
        cells.radius[row.cell], cells.chunks[row.cell] = row.radius, math.ceil(row.n / chunk_rows)
    base = np.concatenate([[0], np.cumsum(cells.chunks)])
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    shared = spark.sparkContext.broadcast(cells)
    schema = pa.schema([("g", pa.int64()), ("role", pa.int32()), ("rep", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("embedding", classes_type(classes))])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                x = _matrix(batch.column(3), dim)
                d = cells.distances(x)
                home = d.argmin(1)
                keys = batch.column(1).to_numpy()
                chunk = (keys.astype(np.uint64) % cells.chunks[home].astype(np.uint64)).astype(np.int64)
                row, cell = np.nonzero(cells.visits(d, home, reach))
                times = cells.chunks[cell]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                g = np.concatenate([base[home] + chunk, np.repeat(base[cell], times) + offset])
                take = pa.array(np.concatenate([np.arange(len(home)), np.repeat(row, times)]))
                role = np.concatenate([np.zeros(len(home), np.int32), np.ones(int(times.sum()), np.int32)])
                for j in range(0, len(g), 16_384):
                    at = take.slice(j, 16_384)
                    yield pa.RecordBatch.from_arrays([pa.array(g[j : j + 16_384]), pa.array(role[j : j + 16_384]), *(batch.column(i).take(at) for i in range(4))], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = pa.schema([("rep", pa.int64()), ("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        now, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _matrix(batch.column(5), dim)
            ids, keys, sizes = (batch.column(i).to_numpy() for i in (2, 3, 4))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (role[1:] != role[:-1])) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)]):
                if g[a] != now:
                    now, group = g[a], _Group(least)
                if role[a] == 0:
                    group.add(x[a:b], ids[a:b], sizes[a:b])
                else:
                    found += group.visit(x[a:b], ids[a:b], keys[a:b])
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                yield record(out_schema, dict(zip(("rep", "key", "links", "root"), columns)))

    dealt = classes.select("rep", "key", "size", "embedding").mapInArrow(replicate, f"g long, role int, rep long, key long, size long, embedding {classes.schema['embedding'].dataType.simpleString()}")
    return dealt.repartition("g").sortWithinPartitions("g", "role").mapInArrow(join, "rep long, key long, links long, root long")


def classes_type(classes: DataFrame) -> pa.DataType:
    return pa.list_(pa.float32() if "float" in classes.schema["embedding"].dataType.simpleString() else pa.float64())


def near_vectors(vectors: DataFrame, *, least: float = 0.9, max_pivots: int = 1024, chunk_rows: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    embedding = F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    # the key tells classes apart that share an id, and deals them evenly to chunks
    classes = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")).withColumn("key", F.xxhash64("embedding", "rep"))
    classes = scratch.save("classes", classes.select("rep", "key", "size", "embedding"))
    found = None
    for dim in sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect()):
        part = _links_of(classes.where(F.size("embedding") == dim), dim, least, max_pivots, chunk_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.save("links", found)
    counts = found.where("links > 0").groupBy("rep", "key").agg(F.sum("links").alias("n"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).where("u <> v"), scratch)
    known = classes.join(counts, ["rep", "key"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = scratch.save("known", known.select("embedding", (F.coalesce("n", "size") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    plain = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where(usable).join(known, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    both = linked.unionByName(plain)
    return both.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
