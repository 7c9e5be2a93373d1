"""The k most similar vectors for every vector, by collision-counting hashing.

Vectors are split into cells by anchors (centroids of a bounded sample), so that no task sees all vectors; a vector
answers in its home cell and asks in every cell whose anchor is about as near. Within a cell, each of ``PROJECTIONS``
random directions gives one sorted array of projections. A query opens a window around its own projection in each
array; a vector whose position lies in at least ``THRESHOLD`` of the windows is verified by its cosine. Windows grow
by virtual rehashing (the same arrays, windows ``GROWTH`` times as wide) until the k-th verified vector is so near
that any nearer one would have collided often enough, or the windows hold the whole cell.

One array over all vectors would make every query scan a fixed share of the collection, which is quadratic; the
cells bound that share by the size of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.skew import fragment_replicate_join, pack
from loomgraph.runtime import cut, parallelism, small

#: Vectors that an anchor is planned for. By default, more than ``MOST_ANCHORS`` are not fitted; cells then hold more vectors,
#: and are divided into more units, but are searched all the same.
PER_ANCHOR, MOST_ANCHORS = 32, 65_536
#: Anchors are fitted on so many different vectors each, chosen by a hash of the vector: 262,144 planned, and 524,288 at most
#: (134 MB of 64 values).
SAMPLED = 4
#: Vectors of the sample by which the queries of each cell are estimated.
ESTIMATED = 50_000
#: Anchors nearer to each other than this share a cell, however many vectors it is planned for.
ALIKE = 0.8
#: Coarse anchors whose fine ones are looked at, and cells that a vector asks in: those with an anchor whose cosine
#: is less than ``MARGIN`` below the best.
COARSE, PROBES, MARGIN = 6, 5, 0.15
#: A cell planned to hold more vectors is a square of units, each with so many vectors and so many queries; so is one whose work
#: is more than a ``SHARES``-th of a task's, down to units of ``LEAST`` vectors. A row costs as much as ``ROW`` comparisons.
BLOCK, LEAST, SHARES, ROW = 20_000, 512, 2, 300
#: Rows planned for a task at most.
TASK_ROWS = 200_000
#: Rows that the router sends at once, about.
SENT = 100_000
PROJECTIONS, THRESHOLD = 16, 10
#: Half the width of the first windows, in standard deviations of a projection, and how windows grow.
FIRST_WIDTH, GROWTH = 0.5, 1.6
#: Windows this wide, in standard deviations of a projection or of the cell's, if that is less, hold most of a cell; queries
#: not yet done then verify all of it, by a matrix product.
WHOLE = 1.0
#: Windows of half-width w find a vector at distance w / SURE with near certainty (each projection with probability 0.87).
SURE = 1.5


def usable(c: Column, dim: int) -> Column:
    """Whether an embedding has ``dim`` finite values that aren't all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(c) == dim) & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0), F.lit(False))


def pack_id(c: Column) -> Column:
    """An id as bytes: a lower-case UUID as its 16, any other text behind a byte that no 16-byte result begins with."""
    uuid = c.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(uuid, F.unhex(F.replace(c, F.lit("-"), F.lit("")))).otherwise(F.concat(F.unhex(F.lit("00" * 17)), F.encode(c, "utf-8")))


def unpack_id(c: Column) -> Column:
    h = F.lower(F.hex(c))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(c) == 16, F.concat_ws("-", *parts)).otherwise(F.decode(F.substring(c, 18, 2**31 - 1), "utf-8"))


def _nearest_anchor(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ anchors.T, axis=1) for i in range(0, len(x), 4096)])


def fit_anchors(sample: np.ndarray, anchors: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors by a few rounds of k-means under cosine; the first ``anchors`` rows start them."""
    at = sample[:anchors].copy()
    for _ in range(rounds if len(sample) > anchors else 0):
        nearest = _nearest_anchor(sample, at)
        order = np.argsort(nearest, kind="stable")
        found, start = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], start, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        at[found] = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), at[found])
    return at


class Cells:
    """Two levels of anchors and the cells that they stand for, fitted on a sample of which each row stands for ``weight``."""

    def __init__(self, sample: np.ndarray, anchors: int, weight: float):
        self.coarse = fit_anchors(sample, max(1, min(round(anchors**0.5), len(sample))))
        nearest = _nearest_anchor(sample, self.coarse)
        fine, cell, load, leaders, self.bounds = [], [], [], [], [0]
        for c in range(len(self.coarse)):
            mine = sample[nearest == c]
            if len(mine):
                at = fit_anchors(mine, max(1, round(len(mine) * anchors / len(sample))))
                here = np.bincount(_nearest_anchor(mine, at), minlength=len(at)) * weight
                alike = at @ at.T
                of = np.full(len(at), -1)
                for i in np.argsort(-here, kind="stable"):
                    if of[i] < 0:
                        near = np.flatnonzero((alike[i] >= ALIKE) & (of < 0))
                        of[near] = len(load)
                        of[i] = len(load)
                        load.append(here[of == len(load)].sum())
                        leaders.append(at[i])
                fine.append(at)
                cell.append(of)
            self.bounds.append(self.bounds[-1] + (len(fine[-1]) if len(mine) else 0))
        self.fine, self.cell, self.load = np.concatenate(fine), np.concatenate(cell), np.array(load)
        self._merge(np.array(leaders))

    def _merge(self, leaders: np.ndarray) -> None:
        """Let the cells of one dense cloud, which the coarse anchors divided, be one; a vector of it then asks in all of it."""
        large = np.flatnonzero(self.load >= max(8 * PER_ANCHOR, self.load.sum() / 16_384))
        to, free = np.arange(len(self.load)), np.ones(len(self.load), bool)
        for c in large[np.argsort(-self.load[large], kind="stable")]:
            if free[c]:
                near = np.flatnonzero(free & (leaders @ leaders[c] >= ALIKE))
                free[near], free[c] = False, False
                to[near] = c
        load = np.zeros(len(to))
        np.add.at(load, to, self.load)
        kept = np.flatnonzero(load > 0)
        number = np.zeros(len(to), np.int64)
        number[kept] = np.arange(len(kept))
        self.cell, self.load = number[to[self.cell]], load[kept]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its home cell, and ``PROBES`` columns of cells to ask in, -1 where there is none, the home first."""
        n = len(x)
        near = x @ self.coarse.T
        take = min(COARSE, near.shape[1])
        top = np.argpartition(-near, take - 1, axis=1)[:, :take]
        anchor, sim = np.full((n, take * PROBES), -1), np.full((n, take * PROBES), -np.inf, np.float32)
        rows, slot = np.repeat(np.arange(n), take), np.tile(np.arange(take), n)
        order = np.argsort(top.ravel(), kind="stable")
        found, start = np.unique(top.ravel()[order], return_index=True)
        for c, a, z in zip(found, start, np.append(start[1:], len(order))):
            lo, hi = self.bounds[c], self.bounds[c + 1]
            if lo == hi:
                continue
            r, k = rows[order[a:z]], slot[order[a:z]]
            s = x[r] @ self.fine[lo:hi].T
            m = min(PROBES, hi - lo)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            columns = k[:, None] * PROBES + np.arange(m)
            anchor[r[:, None], columns] = best + lo
            sim[r[:, None], columns] = np.take_along_axis(s, best, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        sim, cell = np.take_along_axis(sim, order, axis=1), self.cell[np.take_along_axis(anchor, order, axis=1)]
        wanted = sim >= sim[:, :1] - MARGIN
        for j in range(1, cell.shape[1]):  # each cell once
            wanted[:, j] &= ~(cell[:, :j] == cell[:, j : j + 1]).any(axis=1)
        wanted &= np.cumsum(wanted, axis=1) <= PROBES
        return cell[:, 0], np.where(wanted, cell, -1)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray, dtype: type) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(dtype)


def plan_units(answers: np.ndarray, asks: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The sides of the cells' squares, and the task of each unit, for cells with so many vectors and queries each.

    Work is the number of comparisons. A cell with more than its share is divided until no unit has more, so that the
    longest task doesn't grow with a dense cloud; units are bin-packed to tasks, the largest first.
    """
    work = answers * asks + ROW * (answers + asks)
    share = max(1.0, work.sum() / (tasks * SHARES))
    by_work = np.minimum(np.ceil(np.sqrt(work / share)), np.ceil(np.maximum(answers, asks) / LEAST))
    sides = np.maximum(1, np.maximum(by_work, np.ceil(np.maximum(answers, asks) / BLOCK))).astype(np.int64)
    units = np.repeat(work / (sides * sides), sides * sides)
    return sides, np.array(pack([int(w) + 1 for w in units], tasks), np.int32)


def _router(cells: Cells, sides: np.ndarray, dim: int, task_of: np.ndarray | None = None):
    """Sends each vector to its cells.

    A cell planned to hold too much is a square of units, ``side`` by ``side``: as data a vector goes to one row of
    its home cell's square, as query to one column of the square of each of its cells, so that every query meets
    every vector of a cell in exactly one unit and no unit holds more than a block of either.
    """
    first = np.concatenate([[0], np.cumsum(sides * sides)])
    task_of = np.zeros(first[-1], np.int32) if task_of is None else task_of

    def send(b: pa.RecordBatch, home: np.ndarray, asked: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        row, j = np.nonzero(asked >= 0)
        cell = asked[row, j]
        row, cell, i = _times(row, cell, sides[cell])
        side = sides[cell]
        unit = first[cell] + i * side + (h[row] // side) % side
        answers = (cell == home[row]) & (i == h[row] % side)
        # data of a square goes to the other units of its row as well
        drow, dcell, di = _times(np.arange(len(home)), home, sides[home])
        dside = sides[dcell]
        other = di != (h[drow] // dside) % dside
        drow, dunit = drow[other], (first[dcell] + (h[drow] % dside) * dside + di)[other]
        taken = b.select(["id", "embedding"]).take(pa.array(np.concatenate([row, drow])))
        units = np.concatenate([unit, dunit])
        columns = [pa.array(x) for x in (task_of[units], units.astype(np.int32), np.concatenate([answers, np.ones(len(drow), bool)]), np.concatenate([np.ones(len(row), bool), np.zeros(len(drow), bool)]))]
        return pa.RecordBatch.from_arrays([*columns, *taken.columns], ["task", "cell", "answers", "asks", "id", "embedding"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            home, asked = cells.of(_unit(_matrix(b["embedding"], dim), np.float32))
            n, h = len(home), b["h"].to_numpy()
            step = max(1, SENT // (2 * int(np.where(asked >= 0, sides[asked], 0).sum(axis=1).max())))
            for s in range(0, n, step):
                yield send(b.slice(s, step), home[s : s + step], asked[s : s + step], h[s : s + step])

    return route


def _times(row: np.ndarray, cell: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row and cell repeated, with the number of the repetition."""
    ends = np.cumsum(times)
    return np.repeat(row, times), np.repeat(cell, times), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)


def _collisions(x: np.ndarray, answers: np.ndarray, asks: np.ndarray, k: int, directions: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a cell's unit vectors that asks: positions (-1: none) and cosines of the k most similar rows that answer.

    Candidates come from collision counts in query-centred windows; cosines of all that are verified are in double
    precision. With ``exact``, or where a cell holds hardly more than k, all of it is compared.
    """
    data = np.flatnonzero(answers)
    n, m = len(x), len(data)
    out, cos = np.full((n, k), -1), np.full((n, k), -np.inf)
    if m == 0:
        return out, cos
    proj = (x @ directions).astype(np.float32)
    of = proj[data]
    arrays = np.sort(of, axis=0)
    order = np.argsort(of, axis=0, kind="stable")
    place = np.empty((m, of.shape[1]), np.int32)
    np.put_along_axis(place, order, np.arange(m, dtype=np.int32)[:, None], axis=0)
    place = np.ascontiguousarray(place.T).astype(np.uint16 if m < 2**16 else np.uint32)
    single, sd = x.astype(np.float32), 1 / np.sqrt(x.shape[1])
    most = WHOLE * min(1.0, of.std(axis=0).mean() / sd)
    pending, width = np.flatnonzero(asks), FIRST_WIDTH
    while len(pending):
        whole = exact or width > most or m <= 4 * k
        rest = []
        step = max(1, 1_000_000 // m)
        for i in range(0, len(pending), step):
            q = pending[i : i + step]
            if whole:
                c = single[q] @ single[data].T
                c[q[:, None] == data[None, :]] = -2
                take = min(m, k + 8)
                di = np.argpartition(-c, take - 1, axis=1)[:, :take]
                qi, di = np.repeat(np.arange(len(q)), take), di.ravel()
                kept = c[qi, di] > -1.5
                qi, di = qi[kept], di[kept]
            else:
                count = np.zeros((len(q), m), np.uint8)
                for j in range(of.shape[1]):
                    lo = np.searchsorted(arrays[:, j], proj[q, j] - width * sd, "left").astype(place.dtype)
                    hi = np.searchsorted(arrays[:, j], proj[q, j] + width * sd, "right").astype(place.dtype)
                    # one unsigned comparison: a position before the window wraps round to a large number
                    count += (place[j][None, :] - lo[:, None]) < (hi - lo)[:, None]
                qi, di = np.nonzero(count >= THRESHOLD)
                apart = q[qi] != data[di]
                qi, di = qi[apart], di[apart]
                c = np.empty(len(qi), np.float32)
                for a in range(0, len(qi), 100_000):
                    s = slice(a, a + 100_000)
                    c[s] = np.einsum("ij,ij->i", single[q[qi[s]]], single[data[di[s]]])
                # only those near the k best in single precision are compared in double
                by = np.lexsort((-c, qi))
                kept = by[np.arange(len(by)) - np.searchsorted(qi[by], qi[by], "left") < k + 8]
                qi, di = qi[kept], di[kept]
            c = np.einsum("ij,ij->i", x[q[qi]], x[data[di]])
            by = np.lexsort((data[di], -c, qi))
            qs, cs, ds = qi[by], c[by], data[di][by]
            rank = np.arange(len(qs)) - np.searchsorted(qs, qs, "left")
            keep = rank < k
            kq, kr = q[qs[keep]], rank[keep]
            out[q], cos[q] = -1, -np.inf
            out[kq, kr], cos[kq, kr] = ds[keep], cs[keep]
            if not whole:
                # the k-th found is at this distance; a nearer vector's projections differ by less, in each direction
                far = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(cos[q, k - 1], -1)))
                rest.append(q[(far * SURE > width) | (out[q, k - 1] < 0)])
        pending = np.concatenate(rest) if rest else pending[:0]
        width *= GROWTH
    return out, cos


def _asker(k: int, dim: int, seed: int, exact: bool):
    """Runs the cells of a partition that is sorted by cell; gives ids and cosines of each query's best in the cell."""
    directions = np.random.default_rng(seed).standard_normal((dim, PROJECTIONS)) / np.sqrt(dim)

    def run(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = _unit(_matrix(t["embedding"], dim), np.float64)
        ids = t["id"].combine_chunks() if isinstance(t["id"], pa.ChunkedArray) else t["id"]
        # rows in the order of ids, so that ties go to the smaller id
        by = pc.array_sort_indices(ids).to_numpy()
        ids, x = ids.take(pa.array(by)), x[by]
        answers, asks = (t[c].to_numpy(zero_copy_only=False)[by] for c in ("answers", "asks"))
        near, cos = _collisions(x, answers, asks, k, directions, exact)
        ids_out, near, cos = ids.filter(pa.array(asks)), near[asks], cos[asks]
        there = near >= 0
        n = there.sum(axis=1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (ids.take(pa.array(near[there])), pa.array(cos[there]))]
        return pa.RecordBatch.from_arrays([ids_out, *lists], ["id", "near", "cos"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            cells = b["cell"].to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
            for a, z in zip(ends, ends[1:]):
                if a == z:
                    continue
                part = b.slice(a, z - a)
                if held and held[0]["cell"][0] != part["cell"][0]:
                    yield run(held)
                    held = []
                held.append(part)
        if held:
            yield run(held)

    return ask


def _at(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a table of one row a key: broadcast if that is small, else in shards, as one key may have most rows."""
    return rows.join(F.broadcast(found), keys) if small(found, 50_000) else fragment_replicate_join(rows, found, keys, by=["id"])


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, seed: int = 20240601, exact: bool = False, most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """(id, near, cos): for every usable vector, the ids of the k others with the highest cosine, best first.

    A vector without ``dim`` finite values, or all zero, neither asks nor answers; null ids are left out. Rows
    repeated under one id with the same vector count once. Equal vectors are ranked by id: of each group of copies
    only the first k + 1 take part in the search, and the others get the first k of the group, which are their
    nearest. With fewer than k other vectors the lists are shorter; an empty table gives no rows. Ties go to the
    smaller id within a cell. Cosines are in double precision. Further columns are ignored.

    With ``exact``, all vectors are one cell, whose units compare every vector with every other: the work grows with the
    square of their number, and nothing is missed. ``most_anchors`` bounds what is fitted at the driver, ``SAMPLED``
    vectors an anchor (twice as many at most).
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("name"), F.col(vector_col).cast("array<float>").alias("embedding")).filter(F.col("name").isNotNull() & usable(F.col("embedding"), dim))
    vectors = source.select(pack_id(F.col("name")).alias("id"), "embedding", F.xxhash64("embedding").alias("h"))
    rows = max(1, df.count())
    anchors = 1 if exact else min(most_anchors, max(1, rows // PER_ANCHOR))
    share = min(1.0, max(4096, SAMPLED * anchors) / rows)
    # copies share a hash and count once, so that the sample has about as many rows as planned; the same ones in every run
    chosen = vectors.filter(F.pmod("h", F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)).select("h", "embedding").dropDuplicates(["h"])
    picked = chosen.orderBy("h").limit(2 * max(4096, SAMPLED * anchors)).select("embedding").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "id string, near array<string>, cos array<double>")
    sample = _unit(_matrix(picked["embedding"], dim), np.float32)
    sample = sample[np.random.default_rng(seed).permutation(len(sample))]
    cells = Cells(sample, min(anchors, len(sample)), rows / len(sample))
    asked = cells.of(sample[:ESTIMATED])[1]
    asks = np.bincount(asked[asked >= 0], minlength=len(cells.load)) * (rows / min(len(sample), ESTIMATED))
    tasks = max(parallelism(spark), int(np.ceil(asks.sum() / TASK_ROWS)))
    sides, task_of = plan_units(cells.load, np.maximum(asks, cells.load), tasks)

    copies = W.partitionBy("h", "embedding").orderBy("id")
    kept = vectors.withColumn("r", F.dense_rank().over(copies)).filter(F.col("r") <= k + 1).groupBy("h", "embedding", "id").agg(F.first("r").alias("r"))
    schema = "task int, cell int, answers boolean, asks boolean, id binary, embedding array<float>"
    routed = kept.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(2**31)).alias("h")).mapInArrow(_router(cells, sides, dim, task_of), schema)
    asked = routed.repartitionById(tasks, "task").sortWithinPartitions("cell").mapInArrow(_asker(k, dim, seed, exact), "id binary, near array<binary>, cos array<double>")
    scored = F.transform(F.arrays_zip("near", "cos"), lambda x: F.struct((-x["cos"]).alias("d"), x["near"].alias("near")))
    merged = asked.select("id", scored.alias("s")).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, k).alias("s"))
    found = merged.select("id", F.transform("s", lambda x: x["near"]).alias("near"), F.transform("s", lambda x: -x["d"]).alias("cos"))

    # vectors with more copies than take part: their groups are found by a hash, map-side combined
    hot = cut(vectors.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).select("h"))
    if hot.take(1):
        some = _at(vectors, hot, ["h"])
        firsts = cut(some.withColumn("r", F.dense_rank().over(copies)).filter(F.col("r") <= k + 1).groupBy("h", "embedding").agg(F.array_sort(F.collect_set("id")).alias("ids")))
        more = _at(some, firsts, ["h", "embedding"]).filter(~F.array_contains("ids", F.col("id")))
        rest = more.select("id", F.slice("ids", 1, k).alias("near"), F.array_repeat(F.lit(1.0), k).alias("cos")).distinct()
        found = found.unionByName(rest)
    return found.select(unpack_id(F.col("id")).alias("id"), F.transform("near", unpack_id).alias("near"), "cos")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b): each pair of ids once, the smaller first, of which at least one is among the other's nearest."""
    p = found.select(F.col("id"), F.explode("near").alias("n"))
    return p.select(F.least("id", "n").alias("id_a"), F.greatest("id", "n").alias("id_b")).distinct()
