"""Exact nearest neighbours without all pairs: S lies in cells, and R is measured only where neighbours can be.

The cells are the leaves of a k-d tree over a sample of S. Each row of R is first measured against the cell that it
lies in, whose k-th distance bounds the true one, and then against every other cell that is no farther than that bound.
The sample only shapes the cells: all rows of S are in them, and no cell that may hold a neighbour is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from nearfold.sources.tables import materialize

#: Rows of S in a cell, about; rows of the sample at most; rows of R for which a cell's rows are copied once more.
CELL_ROWS, SAMPLE_ROWS, VISITS = 1 << 12, 1 << 20, 1 << 16
#: Pairs measured, pairs of a row and a cell found, and copies made at a time, about.
PAIRS = 1 << 20


class Tree:
    """Inner nodes send points with a coordinate below ``cut`` to their first child, others to the one after it.

    ``cell`` numbers the leaves. Each has at least k rows of the sample, if the sample has so many.
    """

    def __init__(self, sample: np.ndarray, k: int, least: int) -> None:
        self.axis, self.cut, self.child, self.cell, self.cells = [-1], [0], [0], [0], 0
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            split = self._split(rows, k) if len(rows) > least else None
            if split is None:
                self.cell[node], self.cells = self.cells, self.cells + 1
                continue
            self.axis[node], self.cut[node] = split
            self.child[node] = len(self.axis)
            for own, new in ((self.axis, -1), (self.cut, 0), (self.child, 0), (self.cell, 0)):
                own += [new, new]
            below = rows[:, split[0]] < split[1]
            todo += [(self.child[node], rows[below]), (self.child[node] + 1, rows[~below])]
        self.axis, self.child, self.cell = (np.array(x, np.int32) for x in (self.axis, self.child, self.cell))
        self.cut = np.array(self.cut, np.int64)

    @staticmethod
    def _split(rows: np.ndarray, k: int) -> tuple[int, int] | None:
        """The widest axis that can be cut into parts of at least a quarter, else the evenest cut, if it leaves k rows on both sides."""
        best, found = k - 1, None
        for axis in np.argsort(-(rows.max(axis=0) - rows.min(axis=0)), kind="stable"):
            x = np.sort(rows[:, axis])
            middle = x[len(x) // 2]
            for at in (np.searchsorted(x, middle), np.searchsorted(x, middle, side="right")):
                if best < (fewer := min(at, len(x) - at)):
                    best, found = fewer, (int(axis), int(x[at]))
            if best >= max(k, len(x) // 4):
                break
        return found

    def own(self, points: np.ndarray) -> np.ndarray:
        """The cell that each point lies in."""
        node = np.zeros(len(points), np.int32)
        going = np.flatnonzero(self.axis[node] >= 0)
        while len(going):
            at = node[going]
            node[going] = self.child[at] + (points[going, self.axis[at]] >= self.cut[at])
            going = going[self.axis[node[going]] >= 0]
        return self.cell[node]

    def within(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell whose squared distance from the row's point is its bound at most."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int32)
        off, d2 = np.zeros_like(points), np.zeros(len(points), np.int64)  # of the node's region, by axis and in all
        rows, cells = [], []
        while len(row):
            leaf = self.axis[node] < 0
            rows.append(row[leaf])
            cells.append(self.cell[node[leaf]])
            row, node, off, d2 = (x[~leaf] for x in (row, node, off, d2))
            axis, each = self.axis[node], np.arange(len(row))
            past = points[row, axis] - self.cut[node]
            near = self.child[node] + (past >= 0)
            away = np.where(past >= 0, past + 1, -past)
            far, far_off = self.child[node] + (past < 0), off.copy()
            far_d2 = d2 + away * away - off[each, axis] ** 2
            far_off[each, axis] = away
            met = far_d2 <= bound[row]
            row, node = np.concatenate((row, row[met])), np.concatenate((near, far[met]))
            off, d2 = np.concatenate((off, far_off[met])), np.concatenate((d2, far_d2[met]))
        return np.concatenate(rows or [row]), np.concatenate(cells or [node])


def matrix(coords: pa.Array, dimension: int) -> np.ndarray:
    return coords.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def measured(r: np.ndarray, s: np.ndarray, k: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of R, row of S, squared distance): the k nearest of each row, those within its bound; ties to earlier rows of S."""
    d2 = np.zeros((len(r), len(s)), np.int64)
    for a in range(r.shape[1]):
        apart = s[:, a] - r[:, a, None]
        apart *= apart
        d2 += apart
    if bound is None:
        bound = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(s) > k else d2.max(axis=1, initial=0)
    row, at = np.nonzero(d2 <= bound[:, None])
    found = d2[row, at]
    order = np.lexsort((at, found, row))
    row, at, found = row[order], at[order], found[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep], found[keep]


def first_copies(points: np.ndarray, k: int) -> np.ndarray:
    """Rows, in their order, without those of which k equal ones came before."""
    order = np.lexsort(points.T)
    new = np.ones(len(points), bool)
    new[1:] = (points[order][1:] != points[order][:-1]).any(axis=1)
    at = np.arange(len(points))
    return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])


def _by_cell(batches: Iterator[pa.RecordBatch], k: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(rows of R, their row, found d2, found sid): rows come by cell, S before R and by sid, so ties go to the smaller one."""
    place, points, ids, most = None, [], [], 0

    def shrink() -> None:
        nonlocal points, ids, most
        all_points, all_ids = np.concatenate(points), pa.concat_arrays(ids)
        kept = first_copies(all_points, k)
        points, ids = [all_points[kept]], [all_ids.take(pa.array(kept))]
        most = 2 * len(kept) + 4 * CELL_ROWS

    for b in batches:
        at, is_r, coords = b.column("place").to_numpy(), b.column("is_r").to_numpy(zero_copy_only=False), matrix(b.column("coords"), dimension)
        starts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (is_r[1:] != is_r[:-1])))) if len(at) else []
        for begin, end in zip(starts, [*starts[1:], len(at)]):
            if at[begin] != place:
                place, points, ids, most = at[begin], [], [], 4 * CELL_ROWS
            if not is_r[begin]:
                points.append(coords[begin:end])
                ids.append(b.column("sid").slice(begin, end - begin))
                if sum(map(len, points)) > most:
                    shrink()
                continue
            if len(points) > 1:
                shrink()
            if not points:
                continue
            step = max(1, PAIRS // len(points[0]))
            for low in range(begin, end, step):
                own = b.slice(low, min(step, end - low))
                bound = own.column("bound")
                row, s_row, d2 = measured(coords[low : low + own.num_rows], points[0], k, None if bound.null_count else bound.to_numpy())
                yield own, row, d2, ids[0].take(pa.array(s_row))


def exact(points: DataFrame, k: int, dimension: int) -> DataFrame:
    """(rid, sid, d2): of each row of R at least its k nearest of S, every pair once.

    ``points`` (rid, sid, coords), read several times: rows of S have a null rid and those of R a null sid, ``is_r`` tells.
    Coordinates are complete, and no squared distance exceeds a BIGINT.
    """
    spark, kind = points.sparkSession, dict(points.dtypes)
    r_kind, s_kind = kind["rid"], kind["sid"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = points.filter("NOT is_r").select("sid", "coords")
    n = s.count()
    share = max(1, min(64, n >> 14), n // SAMPLE_ROWS)
    drawn = s.filter(F.pmod(F.xxhash64("sid", "coords"), F.lit(share)) == 0).select("coords").toArrow()
    sample = matrix(drawn.column("coords").combine_chunks(), dimension) if drawn.num_rows else np.zeros((0, dimension), np.int64)
    tree = Tree(sample, k, max(CELL_ROWS, 8 * k) // share)
    visitors = points.filter("is_r").select("rid", "coords", F.lit(None).cast("bigint").alias("bound"))
    columns = StructType.fromDDL(f"place int, is_r boolean, rid {r_kind}, sid {s_kind}, coords array<bigint>, bound bigint")
    laid_as = to_arrow_schema(columns)

    def met(visitors: DataFrame, found: str, rows: Callable, cells_of: Callable) -> DataFrame:
        """What ``rows`` makes of the pairs measured. A cell with many visitors has its rows copied, so that no task has them all."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(tree.cells, np.int64)
            for b in batches:
                for _, cell in cells_of(b):
                    count += np.bincount(cell, minlength=tree.cells)
            cell = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(count[cell])], ["cell", "n"])

        visits = visitors.mapInArrow(counted, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        copies = np.zeros(tree.cells, np.int64)  # none where nothing is measured
        copies[visits.column("cell").to_numpy()] = -(-visits.column("n").to_numpy() // VISITS)
        first = np.cumsum(copies) - copies

        def of_s(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, step = tree.own(matrix(b.column("coords"), dimension)), max(1, PAIRS // max(1, copies.max()))
                for k in range(0, len(cell), step):
                    row = k + np.repeat(np.arange(len(cell[k : k + step])), copies[cell[k : k + step]])
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    yield dealt(b, row, first[cell[row]] + nth, "sid")

        def of_r(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, cell in cells_of(b):
                    yield dealt(b, row, first[cell] + row % copies[cell], "rid")

        def dealt(b: pa.RecordBatch, row: np.ndarray, place: np.ndarray, key: str) -> pa.RecordBatch:
            t = b.take(pa.array(row))
            own = {"place": pa.array(place, pa.int32()), "is_r": pa.array(np.full(len(row), key == "rid"))} | {c: t.column(c) for c in t.schema.names}
            return pa.RecordBatch.from_arrays([own.get(x.name, pa.nulls(len(row), x.type)) for x in laid_as], schema=laid_as)

        both = s.mapInArrow(of_s, columns).unionByName(visitors.mapInArrow(of_r, columns))
        laid = both.repartition(parts, "place").sortWithinPartitions("place", "is_r", "sid")
        return laid.mapInArrow(lambda it: (rows(*x) for x in _by_cell(it, k, dimension)), found)

    def with_bound(own: pa.RecordBatch, row: np.ndarray, d2: np.ndarray, sid: pa.Array) -> pa.RecordBatch:
        ends = np.searchsorted(row, np.arange(own.num_rows), side="right")
        begins = np.concatenate(([0], ends[:-1]))
        bound = np.where(ends - begins < k, np.iinfo(np.int64).max, d2[ends - 1])
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        return pa.RecordBatch.from_arrays([own.column("rid"), own.column("coords"), pa.array(bound), pa.ListArray.from_arrays(offsets, sid), pa.ListArray.from_arrays(offsets, pa.array(d2))], ["rid", "coords", "bound", "sids", "d2s"])

    def edges(own: pa.RecordBatch, row: np.ndarray, d2: np.ndarray, sid: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own.column("rid").take(pa.array(row)), sid, pa.array(d2)], ["rid", "sid", "d2"])

    def own_cell(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(b.num_rows), tree.own(matrix(b.column("coords"), dimension))

    def other_cells(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, bound, step = matrix(b.column("coords"), dimension), b.column("bound").to_numpy(), max(1, PAIRS // tree.cells)
        for k in range(0, len(at), step):
            row, cell = tree.within(at[k : k + step], bound[k : k + step])
            other = cell != tree.own(at[k : k + step])[row]
            yield k + row[other], cell[other]

    near = materialize(met(visitors, f"rid {r_kind}, coords array<bigint>, bound bigint, sids array<{s_kind}>, d2s array<bigint>", with_bound, own_cell))
    first_found = near.select("rid", F.explode(F.arrays_zip("sids", "d2s")).alias("x")).select("rid", F.col("x.sids").alias("sid"), F.col("x.d2s").alias("d2"))
    if tree.cells == 1:
        return first_found
    return first_found.unionByName(met(near.select("rid", "coords", "bound"), f"rid {r_kind}, sid {s_kind}, d2 bigint", edges, other_cells))
