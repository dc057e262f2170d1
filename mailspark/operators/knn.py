"""G10m: exact k nearest neighbours over a tree of boxes.

Training rows become distinct points with (count, positives), test rows
distinct points.  A bounded sample of the training points is halved again and
again across its widest column until about ``PART`` points fall to a part;
every training point goes to the part on its side of all borders, and a part's
box holds all of its points.

1. The part on a test point's own side of the borders gives the distance
   within which the ``k`` neighbours must lie.
2. A test point then meets every other part whose box is within this distance,
   found from the root of the tree downwards; most meet one or two.

Meetings are cogroups of a part's points with the test points that meet it.
Where more than ``QUERIES`` do, the part is repeated for each ``QUERIES`` of
them; parts that nobody meets are not moved.  Points tied at the k-th distance
share the remaining weight.  At most ``PART`` points need no index: they go
with the tasks and every test row is scored where it is.  The table of parts has fewer rows than the
sample; beyond ``PART * SAMPLE / LEAST`` points, 8 * 10 ** 6, parts grow with the points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mailspark.session import checkpoint_dir

PART, QUERIES = 1024, 16_384
#: sampled points that place the borders, and those that a part has at least
SAMPLE, LEAST = 1 << 17, 16
#: distances held at a time by a task
CELLS = 1 << 18


def scaler(train: DataFrame, cols: list[str]):
    """G3m: rows -> rows scaled with population mean/std of the training rows."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias("m_" + c) for c in cols],
                    *[F.stddev_pop(F.col(c).cast("double")).alias("s_" + c) for c in cols]).first()

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(row["m_" + c] or 0.0))
                               / F.lit(row["s_" + c] or 1.0) for c in cols})
    return apply


def scaled(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    apply = scaler(train, cols)
    return apply(train), apply(test)


def complete(cols: list[str]):
    """Whether no column is null.  For columns as they are read: over many
    derived columns the planner's constraints would double with each."""
    return F.forall(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull())


def _matrix(batch: pa.RecordBatch | pa.Table, cols: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
                                       else batch.column(c).to_numpy(), dtype=np.float64) for c in cols])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        square += (x[:, c][:, None] - y[:, c]) ** 2
    return np.sqrt(square)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; a column in which all of ``y`` agree is one number a row of ``x``."""
    square, same = np.zeros((len(x), len(y))), (y == y[0]).all(axis=0)
    for c in np.flatnonzero(~same):
        d = x[:, c][:, None] - y[:, c]
        d *= d
        square += d
    square += ((x[:, same] - y[0, same]) ** 2).sum(axis=1)[:, None]
    return square


def part_neighbours(cols: list[str], k: int, cells: int = CELLS):
    """Cogrouped step (test points, points of one part): a row per test point
    with the counts at its nearest distances of the part, up to the k-th nearest
    point and its ties and no farther than ``_r``, and the new ``_r``, within
    which ``k`` neighbours lie."""
    schema = pa.schema([("_qid", pa.int64()), ("_r", pa.float64()), ("_d", pa.list_(pa.float64())),
                        ("_n", pa.list_(pa.int64())), ("_pos", pa.list_(pa.int64()))])

    def run(key, queries: pa.Table, points: pa.Table) -> pa.Table:
        if not len(queries) or not len(points):
            return schema.empty_table()
        t = _matrix(points, cols)
        cnt, pos = points.column("_cnt").to_numpy(), points.column("_pos").to_numpy()
        step, last, out = max(1, cells // len(points)), min(k, len(points)) - 1, []
        for at in range(0, len(queries), step):
            part = queries.slice(at, step)
            square, reach = _squares(_matrix(part, cols), t), part.column("_r").to_numpy()
            cut = np.sqrt(np.partition(square, last, axis=1)[:, last])
            # a little wider: the rounded distances decide
            row, col = np.nonzero(square <= (np.minimum(cut, reach) + 1e-8)[:, None] ** 2)
            # rounded to 1e-9 so that exact ties are not split by float noise
            near = np.round(np.sqrt(square[row, col]), 9)
            keep = near <= np.round(cut, 9)[row]
            row, col, near = row[keep], col[keep], near[keep]
            if not len(row):
                continue
            order = np.lexsort((near, row))
            row, col, near = row[order], col[order], near[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (near[1:] != near[:-1])]))
            row, near, n, p = row[first], near[first], np.add.reduceat(cnt[col], first), np.add.reduceat(pos[col], first)
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            of, before = row[start], np.concatenate([[0], np.cumsum(n)])
            enough = np.where(before[1:] - np.repeat(before[start], np.diff([*start, len(row)])) >= k, near + 1e-6, np.inf)
            ends = np.append(start, len(row)).astype(np.int32)
            out.append(pa.table([part.column("_qid").to_numpy()[of], np.minimum(np.minimum.reduceat(enough, start), reach[of]),
                                 *[pa.ListArray.from_arrays(ends, v) for v in (near, n, p)]], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def share_of(points: np.ndarray, cnt: np.ndarray, pos: np.ndarray, k: int, cells: int = CELLS):
    """x -> class share of the ``k`` nearest of a few points; NaN where x has a null."""
    def run(x: np.ndarray) -> np.ndarray:
        out, step = np.full(len(x), np.nan), max(1, cells // len(points))
        for a in range(0, len(x), step):
            d = np.round(_distances(x[a:a + step], points), 9)
            order = np.argsort(d, axis=1, kind="stable")
            seen = np.cumsum(cnt[order], axis=1)
            last = np.minimum((seen < k).sum(axis=1), len(points) - 1)
            cut = np.take_along_axis(d, np.take_along_axis(order, last[:, None], 1), 1)
            near, tied = d < cut, d == cut
            n_near, n_tied = near @ cnt, tied @ cnt
            take = np.minimum(n_tied, k - n_near)
            with np.errstate(invalid="ignore"):
                out[a:a + step] = (near @ pos + take * (tied @ pos) / n_tied) / (n_near + take)
        return out
    return run


class Index:
    """A tree of borders: node -> column, border and its two children, or a part; and a box per node."""

    def __init__(self, sample: np.ndarray, least: float):
        self.column, self.border, self.child, todo = [], [], [], [sample]
        # nodes are numbered as they are met, so children come after their parent
        for node in todo:
            column, border = self._halved(node, math.ceil(least / 16)) if len(node) >= 2 * least else (-1, 0.0)
            self.column.append(column)
            self.border.append(border)
            self.child.append(len(todo))
            if column >= 0:
                below = node[:, column] < border
                todo += [node[below], node[~below]]
        self.column, self.border, self.child = (np.array(v) for v in (self.column, self.border, self.child))

    @staticmethod
    def _halved(x: np.ndarray, fewest: int) -> tuple[int, float]:
        """The widest column with a border that leaves ``fewest`` points on either side, and the border
        nearest to the middle; no column where there is none.  A test point beside very few
        points would have to look far for its neighbours."""
        with np.errstate(invalid="ignore"):
            spread = x.max(axis=0) - x.min(axis=0)
        for c in np.argsort(-spread, kind="stable"):
            if 0 < spread[c] < math.inf:
                v = np.sort(x[:, c])
                starts = np.flatnonzero(v[1:] > v[:-1]) + 1
                starts = starts[(starts >= fewest) & (starts <= len(v) - fewest)]
                if len(starts):
                    return int(c), float(v[starts[np.abs(starts - len(v) / 2).argmin()]])
        return -1, 0.0

    def part_of(self, x: np.ndarray) -> np.ndarray:
        """The part (its node) on each point's side of the borders."""
        at = np.zeros(len(x), dtype=np.int64)
        while len(down := np.flatnonzero(self.column[at] >= 0)):
            node = at[down]
            at[down] = self.child[node] + ~(x[down, self.column[node]] < self.border[node])
        return at

    def keep(self, boxes: list) -> None:
        """Takes the boxes of the parts, (part, least values, greatest values); a node's box holds its children's."""
        width = len(boxes[0][1])
        self.low, self.high = np.full((len(self.column), width), np.inf), np.full((len(self.column), width), -np.inf)
        for part, low, high in boxes:
            self.low[part], self.high[part] = low, high
        self.parts = len(boxes)
        for node in np.flatnonzero(self.column >= 0)[::-1]:
            two = slice(self.child[node], self.child[node] + 2)
            self.low[node], self.high[node] = self.low[two].min(axis=0), self.high[two].max(axis=0)

    def within(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, part) for every part whose box is within ``r`` of a point."""
        point, node, found = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), []
        while len(point):
            off = np.maximum(np.maximum(self.low[node] - x[point], x[point] - self.high[node]), 0.0)
            near = (off * off).sum(axis=1) <= r[point] ** 2
            # an empty part has no box
            near &= self.low[node, 0] <= self.high[node, 0]
            point, node = point[near], node[near]
            end = self.column[node] < 0
            found.append((point[end], node[end]))
            point, node = point[~end], self.child[node[~end]]
            point, node = np.concatenate([point, point]), np.concatenate([node, node + 1])
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (point, node)


def build_index(points: DataFrame, n_points: int, cols: list[str], part: int) -> tuple[DataFrame, Index]:
    """``points`` with ``_part``, and the index."""
    most = min(n_points, SAMPLE)
    drawn = points.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < math.ceil(most / n_points * (1 << 20)))
    sample = np.column_stack([c.to_numpy() for c in drawn.select(*cols).toArrow().columns])
    # parts of the sample stand for ``part`` points each
    index = Index(sample, max(part * most / n_points, LEAST if most < n_points else 1) / 2)
    placed = points.withColumn("_part", _part_of(index, cols))
    table = placed.groupBy("_part").agg(F.array(*[F.min(c) for c in cols]).alias("low"), F.array(*[F.max(c) for c in cols]).alias("high")).collect()
    index.keep([tuple(r) for r in table])
    return placed, index


def _part_of(index: Index, cols: list[str]):
    """Arrow UDF: the part on a point's side of the borders."""
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array(index.part_of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])))
    return F.arrow_udf(run, "bigint")(*[F.col(c) for c in cols])


def _met_parts(index: Index, cols: list[str], step: int = 4096):
    """Arrow UDF: the parts within ``_r`` of a point, but for its own."""
    def run(reach: pa.Array, *columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        r, out = reach.to_numpy(zero_copy_only=False), []
        for a in range(0, len(x), step):
            rows = x[a:a + step]
            point, part = index.within(rows, r[a:a + step])
            other = part != index.part_of(rows)[point]
            point, part = point[other], part[other]
            ends = np.searchsorted(np.sort(point), np.arange(len(rows) + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(ends, part[np.argsort(point, kind="stable")]))
        return pa.concat_arrays(out) if out else pa.array([], type=pa.list_(pa.int64()))
    return F.arrow_udf(run, "array<bigint>")(F.col("_r"), *[F.col(c) for c in cols])


def knn_predict(train: DataFrame, test: DataFrame, cols: list[str], k: int = 5, report: dict | None = None,
                part: int | None = None, queries: int | None = None) -> DataFrame:
    """Test rows with ``prediction`` / ``y_prob``, null where a feature is null
    or there are no training rows.  ``report`` gets the number of parts and the
    mean share of them that a test point meets."""
    part, queries = part or PART, queries or QUERIES
    checkpoint_dir(train.sparkSession)
    apply = scaler(train, cols)
    tr, te = apply(train.where(complete(cols))), apply(test)
    # numbered once: the ids must not change when a lost task runs again
    pts = tr.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("_cnt"), F.sum(F.col("label").cast("long")).alias("_pos")) \
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    n_points = pts.count()
    if not n_points:
        none = F.lit(None).cast("double")
        return te.withColumn("y_prob", none).withColumn("prediction", none)
    if n_points <= part:
        few = pts.select(*cols, "_cnt", "_pos").collect()
        table = np.array([list(r) for r in few], dtype=np.float64)
        score = share_of(table[:, :-2], table[:, -2], table[:, -1], k)

        def run(*columns: pa.Array) -> pa.Array:
            return pa.array(score(np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])))
        if report is not None:
            report |= {"parts": 1, "share_met": 1.0}
        out = te.withColumn("y_prob", F.nanvl(F.arrow_udf(run, "double")(*[F.col(c) for c in cols]), F.lit(None).cast("double")))
        return out.withColumn("prediction", (F.col("y_prob") > 0.5).cast("double"))
    whole = F.when(complete(cols), F.array(*[F.col(c) for c in cols]))
    qs = apply(test.where(complete(cols))).select(whole.alias("_x"), *cols).dropDuplicates(["_x"]) \
        .withColumn("_qid", F.monotonically_increasing_id()).checkpoint()
    points, index = build_index(pts, n_points, cols, part)

    def meet(pairs: DataFrame) -> DataFrame:
        """(_qid, _r, _d, _n, _pos) of the test points and parts ``pairs(_qid, cols, _r, _part)``."""
        # one row per part
        salts = pairs.groupBy("_part").agg(F.ceil(F.count("*") / queries).cast("int").alias("_salts")).checkpoint()
        left = pairs.join(F.broadcast(salts), "_part").withColumn(
            "_salt", F.pmod(F.xxhash64("_qid"), F.col("_salts")).cast("int")).drop("_salts")
        copies = salts.select(F.col("_part").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        right = points.join(F.broadcast(copies), F.col("_part") == F.col("_p")).drop("_p")
        return left.groupBy("_part", "_salt").cogroup(right.groupBy("_part", "_salt")).applyInArrow(
            part_neighbours(cols, k), "_qid long, _r double, _d array<double>, _n array<long>, _pos array<long>")

    points_of = qs.drop("_x")
    home = meet(points_of.withColumn("_r", F.lit(math.inf)).withColumn("_part", _part_of(index, cols))).checkpoint()
    met = points_of.join(home.select("_qid", "_r"), "_qid", "left").withColumn("_r", F.coalesce("_r", F.lit(math.inf))) \
        .withColumn("_part", F.explode(_met_parts(index, cols))).checkpoint()
    if report is not None:
        report |= {"parts": index.parts, "share_met": (1 + met.count() / max(qs.count(), 1)) / index.parts}
    wq = Window.partitionBy("_qid").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    near = home.unionByName(meet(met)).select("_qid", F.inline(F.arrays_zip("_d", "_n", "_pos")))
    g = near.groupBy("_qid", "_d").agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos")).withColumn("_cum", F.sum("_n").over(wq))
    take = F.least(F.col("_n"), F.greatest(F.lit(k) - (F.col("_cum") - F.col("_n")), F.lit(0)))
    share = g.groupBy("_qid").agg((F.sum(take * F.col("_pos") / F.col("_n")) / F.sum(take)).alias("y_prob"))
    res = qs.select("_qid", "_x").join(share, "_qid").select("_x", "y_prob")
    # scaled values only match the points they were taken from; zero and minus zero are one
    out = te.withColumn("_x", whole).join(res, "_x", "left").drop("_x")
    return out.withColumn("prediction", (F.col("y_prob") > 0.5).cast("double"))
