"""Near-duplicate embeddings by collision counting on sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, materialise, small


@dataclass(frozen=True)
class ProjectionParams:
    """cosine: least similarity of a link; recall: share of pairs at just that similarity that share a cell of some table; kept: share of these whose count passes."""

    cosine: float = 0.95
    recall: float = 0.997
    kept: float = 0.9995
    projections: int = 24
    #: Strangers that a cell holds on average.
    strangers: float = 32.0
    #: Cells of more rows are dealt out in tiles of pairs of blocks, each of about so many rows.
    block: int = 8000
    seed: int = 17

    def plan(self, n: int) -> Plan:
        same = 1 - math.acos(self.cosine) / math.pi  # chance that a random plane leaves a pair at the line on one side
        planes = min(30, max(1, math.ceil(math.log2(max(2.0, n / self.strangers)))))
        tables = max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - same**planes)))
        far = math.sqrt(2 - 2 * self.cosine)  # a pair at the line differs by a normal deviate of this width on each projection
        width = 2.0 * far
        hit = math.erf(2.0 / math.sqrt(2))
        need, tail = self.projections, hit**self.projections
        while tail < self.kept and need > 0:  # the largest count that a pair at the line reaches so often
            need -= 1
            tail += math.comb(self.projections, need) * hit**need * (1 - hit) ** (self.projections - need)
        return Plan(planes, tables, 3.5 * far, width, need)


@dataclass(frozen=True)
class Plan:
    """planes a cell, tables, half-width of the sweep on a table's sorted projection, half-width of a window, collisions needed."""

    planes: int
    tables: int
    sweep: float
    width: float
    need: int


#: A place on a projection is kept in steps of 1/20 (a window then reaches one step further, so that rounding loses no collision).
STEP = 0.05


def _directions(count: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((count, dim))


def _usable(col: str):
    """Whether a vector takes part: not null, not empty, all components finite numbers, not all zero."""
    big = F.lit(float("inf"))
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & fine & F.exists(col, lambda x: x != 0), F.lit(False))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their magnitude."""
    most = np.abs(raw).max(1, keepdims=True)
    x = raw / most
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(distinct: DataFrame, plan: Plan, p: ProjectionParams) -> DataFrame:
    """A slim row per vector and table: (t, cell, pos, id, code); id is the vector's row number, pos its place on the table's own projection; code holds its sides of all tables'
    planes, a bit each, and its places on the further projections, a byte each. The vector itself stays behind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for dim in sorted({len(x) for x in lists}):
                at = np.array([i for i, x in enumerate(lists) if len(x) == dim])
                for part in np.array_split(at, max(1, len(at) * plan.tables // 50_000)):
                    x = _unit(np.array([lists[i] for i in part], np.float64))
                    signs = x @ _directions(plan.planes * plan.tables, dim, p.seed).T > 0
                    keys = (signs.reshape(len(part), plan.tables, plan.planes) * (1 << np.arange(plan.planes))).sum(2).astype(np.int64)
                    pos = (x @ _directions(plan.tables, dim, p.seed + 1).T).astype(np.float32)
                    places = np.clip(np.rint(x @ _directions(p.projections, dim, p.seed + 2).T / STEP), -127, 127).astype(np.int8)
                    code = np.concatenate((np.packbits(signs, axis=1), places.view(np.uint8)), axis=1)
                    packed = [c.tobytes() for c in code]
                    each = np.repeat(np.arange(len(part)), plan.tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(plan.tables), len(part)), pa.int32()), pa.array(keys.ravel() + (dim << 32), pa.int64()), pa.array(pos.ravel(), pa.float32()), pa.array(ids[part][each], pa.int64()), pa.array([packed[i] for i in each], pa.binary())],
                        ["t", "cell", "pos", "id", "code"],
                    )

    return distinct.select("row", "v").mapInArrow(work, "t int, cell long, pos float, id long, code binary")


def _collisions(plan: Plan, p: ProjectionParams, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row numbers i, j) of rows sorted by (t, cell, tile, pos) that pass the collision count.

    They lie within the sweep of their table's sorted projection, collide in enough query-centred windows of the other projections and share no cell of an
    earlier table (each pair counts once). In a tile of two blocks only pairs of different blocks are looked at.
    """
    t, cell, tile, pos, ids, block = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("t", "cell", "tile", "pos", "id", "block"))
    split = table.column("split").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    n = len(t)
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])))
    bits = plan.planes * plan.tables
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, -1)
    places = code[:, (bits + 7) // 8 :].view(np.int8).astype(np.int16)
    sides = np.unpackbits(code[:, : (bits + 7) // 8], axis=1, count=bits).reshape(n, plan.tables, plan.planes)
    keys = (sides * (1 << np.arange(plan.planes))).sum(2).astype(np.int32)
    place = (np.cumsum(new) - 1) * 64.0 + np.clip(pos.astype(np.float64), -16, 16)
    reach = math.ceil(plan.width / STEP) + 1
    ahead = np.searchsorted(place, place + plan.sweep, side="right") - np.arange(n) - 1
    ends = np.cumsum(ahead)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 400_000, side="right")))
        i = np.repeat(np.arange(first, last), ahead[first:last])
        if len(i):
            j = np.arange(len(i)) - np.repeat(ends[first:last] - ahead[first:last], ahead[first:last]) + (ends[first - 1] if first else 0) + i + 1
            ok = (ids[i] != ids[j]) & (~split[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            count = np.zeros(len(i), np.int8)
            for k in range(p.projections):  # a pair that can't reach the count any more drops out
                count += np.abs(places[i, k] - places[j, k]) <= reach
                if k in (3, 7, 15):
                    ok = count >= plan.need - (p.projections - 1 - k)
                    i, j, count = i[ok], j[ok], count[ok]
            ok = count >= plan.need
            i, j = i[ok], j[ok]
            ok = ~((keys[i] == keys[j]) & (np.arange(plan.tables)[None, :] < t[i][:, None])).any(1)
            if ok.any():
                yield i[ok], j[ok]
        first = last


def _by_tile(batches: Iterator[pa.RecordBatch], rows: int = 30_000) -> Iterator[pa.Table]:
    """Tables of about so many rows, cut between tiles, from batches sorted by (t, cell, tile)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            t, cell, tile = (table.column(c).to_numpy() for c in ("t", "cell", "tile"))
            edge = np.flatnonzero((t[1:] != t[:-1]) | (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1]))
            if len(edge):
                cut = int(edge[-1]) + 1
                yield table.slice(0, cut).combine_chunks()
                held = table.slice(cut).combine_chunks().to_batches()
                n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


_SLIM = ["t", "cell", "tile", "pos", "id", "code", "block", "split"]


def _colliding(every: DataFrame, plan: Plan, p: ProjectionParams) -> DataFrame:
    """The slim rows that have a partner in their tile: what no window count brings together with another row drops out before any vector moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_tile(batches):
            paired = np.zeros(table.num_rows, bool)
            for i, j in _collisions(plan, p, table):
                paired[i] = paired[j] = True
            yield from table.filter(pa.array(paired)).select(_SLIM).to_batches()

    dealt = every.select(*_SLIM).repartition("t", "cell", "tile").sortWithinPartitions("t", "cell", "tile", "pos", "id")
    return dealt.mapInArrow(work, ", ".join(f"{c} {k}" for c, k in every.select(*_SLIM).dtypes))


def _verified(rows: DataFrame, plan: Plan, p: ProjectionParams) -> DataFrame:
    """Rows (id, links, root) of slim rows with n and v: how many rows each links with, and the least row number that its links reach in its task.

    Pairs are counted where they are found and never leave the task: a spanning set of edges stands for them.
    """

    def run(table: pa.Table) -> pa.RecordBatch:
        ids, n, cell = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "n", "cell"))
        links, root, vectors = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros((0, 0))
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        dims = cell >> 32
        where, units = np.zeros(len(ids), np.int64), {}
        lists = table.column("v").combine_chunks()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            where[at] = np.arange(len(at))
            units[int(dim)] = _unit(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(dim)))
        for i, j in _collisions(plan, p, table):
            for dim in np.unique(dims[i]):
                own = dims[i] == dim
                a, b = i[own], j[own]
                vectors = units[int(dim)]
                for k in range(0, len(a), 50_000):
                    x, y = a[k : k + 50_000], b[k : k + 50_000]
                    ok = np.einsum("ij,ij->i", vectors[where[x]], vectors[where[y]]) >= p.cosine
                    x, y = x[ok], y[ok]
                    np.add.at(links, x, n[y])
                    np.add.at(links, y, n[x])
                    far = root[x] != root[y]
                    if far.any():
                        edges.append((x[far], y[far]))
                        root = _joined(root, *edges[-1])
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[linked], links[linked], ids[root[linked]])], ["id", "links", "root"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_tile(batches):
            yield run(table)

    dealt = rows.select(*_SLIM, "n", "v").repartition("t", "cell", "tile").sortWithinPartitions("t", "cell", "tile", "pos", "id")
    return dealt.mapInArrow(work, "id long, links long, root long")


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row number reached by each row, after further edges."""
    root = root.copy()
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def near_embeddings(vectors: DataFrame, params: ProjectionParams = ProjectionParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of vectors.

    Equal vectors are one vector with a number from the start. Each table cuts space by random planes into cells that hold few strangers, whatever the
    number of vectors, and sorts the rows of a cell along a projection of its own. Rows inside the sweep whose query-centred windows collide on enough of
    the further projections (the count is calibrated to the recall) are candidates. Up to there only slim rows move: a place, an id and some bytes of code
    for each table. Vectors are joined to the rows that have a candidate, and each candidate pair is verified in double precision where it is found.
    Cells with many rows are dealt out as tiles of pairs of blocks, so no cell is gathered in one task, no pair is dropped and no row is made for a pair.
    n_links counts linked rows, copies included. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do
    vectors of other lengths. Ids must be whole numbers (they are cast to long); rows that repeat an id count as links of one another if their vectors
    link. An empty table gives an empty one; further columns are left behind, whatever their names.
    """
    bound_batches(vectors.sparkSession)
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).withColumn("fine", _usable("v"))
    own = own.select("id", "v", "fine", F.when(F.col("fine"), F.xxhash64("v")).alias("h1"), F.when(F.col("fine"), F.hash("v", F.lit(1))).alias("h2"))
    distinct = own.filter("fine").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min_by("v", "id").alias("v"))
    distinct = materialise(distinct.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers are fixed once written; ids may repeat
    plan = params.plan(distinct.count())
    cells = materialise(_cells(distinct, plan, params), "cells")
    sizes = cells.groupBy("t", "cell").agg(F.count("*").alias("size")).filter(F.col("size") > params.block)
    large = materialise(sizes.withColumn("blocks", F.ceil(F.col("size") / params.block).cast("int")), "large", light=True)
    placed = cells.join(small(large.select("t", "cell", "blocks")), ["t", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a tile of two blocks leaves the pairs inside each block to that block's own tile
    dealt = dealt.withColumn("tile", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).withColumn("split", F.col("block") != F.col("other"))
    hits = materialise(_colliding(dealt, plan, params), "hits")
    found = materialise(_verified(hits.join(distinct.select(F.col("row").alias("id"), "n", "v"), "id"), plan, params), "links")
    counted = found.groupBy(F.col("id").alias("row")).agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "row")
    of = materialise(distinct.select("h1", "h2", "row", "least", "n").join(counted, "row", "left").join(group, "row", "left").withColumn("component", F.coalesce("component", "row")), "of", light=True)
    heads = of.groupBy("component").agg(F.min("least").alias("head"))
    of = of.join(heads, "component").select("h1", "h2", "n", "links", "head")
    out = own.select("id", "h1", "h2").join(of, ["h1", "h2"], "left")
    n_links = F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), F.coalesce("head", "id").alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))
