"""Cosines between two sets of vectors: all of them block by block, or those above a bound by cells that lie near enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType, FloatType

from tidemark.operators.graph import cut

#: Rows of either side that a task holds at once, about.
BLOCK_ROWS = 2_048
#: Bytes of vectors that the cells' centres are chosen from, cells for each block of rows (small ones lie farther apart), and cells at most.
SAMPLE_BYTES, CELLS_PER_BLOCK, MOST_CELLS = 32 << 20, 4, 4_096
#: Rows and bytes of vectors that are packed in one row, rows of a partition of these, and cosines that a task holds at once.
PACK_ROWS, PACK_BYTES, PART_ROWS, SLICE = 2_048, 1 << 20, 8_192, 1 << 20
#: Cells are used if a sample of vectors meets less than this share of all pairs and is copied less often.
MOST_MET, MOST_COPIES, PROBES = 0.25, 8, 1_024
#: Angles are compared with so much room, far above the error of an arc cosine.
ROOM = 1e-6


def blocks_of(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // BLOCK_ROWS))


def matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values padded to one width, lengths, norms) of arrays; a null vector has length -1."""
    size = np.array([-1 if v is None else len(v) for v in vectors], np.int64)
    out = np.zeros((len(size), max(0, size.max(initial=0))))
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, : len(v)] = v
    return out, size, np.sqrt((out * out).sum(1))


def exact(p: tuple, i: np.ndarray, q: tuple, j: np.ndarray) -> np.ndarray:
    """Cosines of rows ``i`` of one matrix with rows ``j`` of another, summed row by row, so that equal vectors have equal cosines; NaN for a null."""
    (p, p_size, p_norm), (q, q_size, q_norm) = p, q
    width, scale = min(p.shape[1], q.shape[1]), p_norm[i] * q_norm[j]
    real = (p_size[i] == q_size[j]) & (scale > 0)
    sim = np.divide((q[j, :width] * p[i, :width]).sum(1), scale, out=np.zeros(len(scale)), where=real)
    sim[(q_size[j] < 0) | (p_size[i] < 0)] = np.nan
    return sim


@pandas_udf(DoubleType())
def cosine_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """The cosine of each two vectors as ``cosines`` has it; null for a null vector."""
    at = np.arange(len(a))
    sim = exact(matrix(a), at, matrix(b), at)
    return pd.Series(np.where(np.isnan(sim), None, sim.astype(object)))


def meet(left: DataFrame, right: DataFrame, schema: str, cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``cell`` of every block of ``left`` (a, v, ...) with every block of ``right`` (b, v, ...), as one table.

    Both sides are dealt to blocks of a bounded number of rows by a hash of the id, and each pair of blocks is one group, so neither side is
    ever broadcast or held whole.
    """
    n, m = blocks_of(left), blocks_of(right)
    one = left.select("*", F.pmod(F.xxhash64("a"), F.lit(n)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    two = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.pmod(F.xxhash64("b"), F.lit(m)).cast("int").alias("j"))
    return one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInPandas(cell, schema)


def doubles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.col("v").cast("array<double>"))


def pairs_above(x: pd.DataFrame, y: pd.DataFrame, least: float, more: list[str]) -> pd.DataFrame:
    """Rows of a block pair with a cosine of at least ``least``: one product of both blocks, then exact sums for what is near or above."""
    p, q = matrix(x["v"]), matrix(y["v"])
    width = min(p[0].shape[1], q[0].shape[1])
    close = p[0][:, :width] @ q[0][:, :width].T >= (least - 1e-9) * p[2][:, None] * q[2][None, :]
    i, j = np.nonzero(close & (p[1] >= 0)[:, None] & (q[1] >= 0)[None, :])
    sim = exact(p, i, q, j)
    i, j, sim = i[sim >= least], j[sim >= least], sim[sim >= least]
    return y[["b", *more]].iloc[j].assign(a=x["a"].to_numpy()[i], sim=sim)[["a", "b", "sim", *more]]


def packed(rows: DataFrame) -> DataFrame:
    """Rows (block, size, ids, vs) that hold many vectors of ``rows`` (an id, v) of one length each, written once; null and zero vectors are left out."""
    single = isinstance(rows.schema["v"].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    key = next(c for c in rows.columns if c != "v")
    known = rows.select(F.col(key).cast("long").alias("id"), F.col("v") if single else F.col("v").cast("array<double>").alias("v"))
    schema = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("vs", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        block = TaskContext.get().partitionId() << 32

        def out(size: int, ids: np.ndarray, vs: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, size, ids.tobytes(), vs.tobytes()), schema.types, strict=True)], schema=schema)

        for batch in batches:  # a filter of Spark's on computed vectors could move into the joins that they come from
            batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                vs = flat[starts[at][:, None] + np.arange(size)]
                real = (vs != 0).any(1)
                old = held.pop(size, (np.zeros(0, np.int64), np.zeros((0, size), kind)))
                mine, vs = np.concatenate([old[0], ids[at][real]]), np.concatenate([old[1], vs[real]])
                most = max(64, min(PACK_ROWS, PACK_BYTES // (size * vs.itemsize)))
                while len(mine) >= most:
                    yield out(size, mine[:most], vs[:most])
                    mine, vs = mine[most:], vs[most:]
                held[size] = mine, vs
        for size, (mine, vs) in held.items():
            if len(mine):
                yield out(size, mine, vs)

    parts = max(1, -(-known.count() // PART_ROWS))
    return cut(known.repartition(parts).mapInArrow(pack, "block long, size int, ids binary, vs binary"))


def block_pairs(left: DataFrame, right: DataFrame, least: float, once: bool = False) -> DataFrame:
    """Rows (a, b, sim) of ``left`` (a, v) and ``right`` (b, v) with a cosine of at least ``least`` above 0, all pairs of packed rows compared.

    Vectors are packed and written once, and partitions of both sides are read together; no row is copied for each block that it meets. Products
    of unit vectors in single precision leave what can reach ``least`` by their error bound, and exact sums decide. A task holds two packs and
    at most ``SLICE`` products. With ``once`` both sides are the same rows, and only pairs with a < b come out, each pack met once.
    """
    kinds = [np.float32 if isinstance(x.schema["v"].dataType.elementType, FloatType) else np.float64 for x in (left, right)]
    one = packed(left.select("a", "v"))
    two = one if once else packed(right.select("b", "v"))
    one, two = one.toDF("i", "x_size", "x_ids", "x"), two.toDF("j", "y_size", "y_ids", "y")
    meets = (F.col("x_size") <= F.col("y_size")) & (F.col("x_size") >= F.col("y_size"))
    both = one.hint("shuffle_replicate_nl").join(two, meets & (F.col("i") <= F.col("j")) if once else meets)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])

    def read(row: dict, side: str, kind: type) -> tuple:
        vs = np.frombuffer(row[side], kind).reshape(-1, row[f"{side}_size"]).astype(float)
        norms = np.sqrt((vs * vs).sum(1))
        with np.errstate(all="ignore"):
            unit = (vs / norms[:, None]).astype(np.float32)
        return np.frombuffer(row[f"{side}_ids"], np.int64), (vs, np.full(len(vs), vs.shape[1]), norms), unit

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, found, n = None, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("i", "j", "y_size", "y_ids", "y")}
                if row["i"] != last:
                    last, x = row["i"], read({c: batch.column(c)[k].as_py() for c in ("x_size", "x_ids", "x")}, "x", kinds[0])
                (a, p, u), (b, q, w) = x, read(row, "y", kinds[1])
                room = (row["y_size"] + 8) * 1.2e-7
                for s in range(0, len(a), step := max(1, SLICE // len(b))):
                    i, j = np.nonzero(u[s : s + step] @ w.T >= least - room)
                    i += s
                    if once and row["i"] == row["j"]:
                        i, j = i[a[i] < b[j]], j[a[i] < b[j]]
                    for t in range(0, len(i), 16_384):
                        f, g = i[t : t + 16_384], j[t : t + 16_384]
                        sim = exact(p, f, q, g)
                        ok = sim >= least
                        one, two = a[f[ok]], b[g[ok]]
                        found.append((np.minimum(one, two), np.maximum(one, two), sim[ok]) if once else (one, two, sim[ok]))
                        n += len(one)
                        if n >= 131_072:
                            yield out()
                            found, n = [], 0
        if found:
            yield out()

    return both.mapInArrow(cell, "a long, b long, sim double")


def parts_well(left: DataFrame, right: DataFrame, least: float) -> bool:
    """Whether ``PROBES`` vectors of ``left`` reach few cells of a tree of centres, by the rows and radii of the bounded sample of ``right`` that it is made of."""
    tree, unit, _ = fitted(right)
    if tree is None or not len(unit):
        return False
    cell, nodes, angles = tree.homes(unit)
    tree.radii = np.full(len(tree.centres), -10.0)
    np.maximum.at(tree.radii, np.concatenate([np.array(n, int) for n in nodes]), np.concatenate([np.array(a, float) for a in angles]))
    rows, size, norm = matrix(left.select("v", "a").orderBy(F.xxhash64("a"), "a").limit(PROBES).toPandas()["v"])
    at = np.flatnonzero((size == unit.shape[1]) & (norm > 0))
    if not len(at):
        return False
    met = tree.reached(rows[at] / norm[at, None], float(np.arccos(min(1.0, least))))
    held = np.bincount(cell, minlength=len(tree.centres)) / len(unit)
    return sum(map(len, met)) / len(at) <= MOST_COPIES and sum(held[m].sum() for m in met) / len(at) <= MOST_MET


def cosines(left: DataFrame, right: DataFrame, least: float | None = None, once: bool = False) -> DataFrame:
    """Rows (a, b, sim, and the further columns of ``right``) of ``left`` (a long, v) and ``right`` (b long, v, ...).

    sim is the cosine in double precision: 0 for a zero vector or unequal lengths, null for a null vector. Without ``least`` every pair comes
    out, from ``meet``. With it, what is below it or null is left out; if the vectors part well, only those meet whose cells are near enough
    (``dealt``), else all do (``block_pairs``). With ``once`` both sides are the same rows, and pairs have a < b.
    """
    more = [f for f in right.schema.fields if f.name not in ("b", "v")]
    if least is not None and least > 0 and not more and not parts_well(left, right, least):
        return block_pairs(left, right, least, once)
    if once:
        return cosines(left, right, least).where("a < b")
    names = [f.name for f in more]
    schema = ", ".join(["a long", "b long", "sim double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in more)])
    left, right = doubles(left.select("a", "v")), doubles(right)
    if least is not None and least > 0:
        one, two, _ = dealt(left, right, least)
        return one.groupBy("cell", "i", "j").cogroup(two.groupBy("cell", "i", "j")).applyInPandas(lambda x, y: pairs_above(x, y, least, names), schema)
    if least is not None:
        return meet(left, right, schema, lambda x, y: pairs_above(x, y, least, names))

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q = matrix(x["v"]), matrix(y["v"])
        i, j = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
        sim = np.concatenate([np.zeros(0), *(exact(p, np.full(len(y), k), q, np.arange(len(y))) for k in range(len(x)))])
        out = y[["b", *names]].iloc[j].assign(a=x["a"].to_numpy()[i], sim=np.where(np.isnan(sim), None, sim.astype(object)) if np.isnan(sim).any() else sim)
        return out[["a", "b", "sim", *names]]

    return meet(left, right, schema, cell)


class Cells:
    """A tree of cells of the unit sphere: every inner node has two centres, and a vector lies on the side of the nearer.

    ``centres`` (nodes by entries), ``children`` (nodes by 2, -1 for a leaf) and, when ``radii`` are known, the largest angle between a node's
    centre and a vector below it. A leaf is a cell; node 0 is the whole sphere.
    """

    def __init__(self, sample: np.ndarray, cells: int):
        self.centres, self.children = [np.zeros(sample.shape[1])], [[-1, -1]]
        self.radii: np.ndarray | None = None
        open_ = [(0, sample)]
        while open_ and len(self.centres) < 2 * cells - 1:
            node, rows = open_.pop(0)  # breadth first, so that cells are of like size
            if len(rows) >= 2 and (halves := self._halve(rows)):
                self.children[node] = [len(self.centres), len(self.centres) + 1]
                for centre, part in halves:
                    open_.append((len(self.centres), part))
                    self.centres.append(centre)
                    self.children.append([-1, -1])
            open_.sort(key=lambda x: -len(x[1]))
        self.centres, self.children = np.array(self.centres), np.array(self.children)

    @staticmethod
    def _halve(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Two centres that are far apart, moved twice to the means of what is nearest; none if all rows point one way."""
        one = rows[(rows @ rows[0]).argmin()]
        two = rows[(rows @ one).argmin()]
        if one @ two > 1 - 1e-12:
            return None
        for _ in range(3):
            first = rows @ one >= rows @ two
            if first.all() or not first.any():
                return None
            halves = [(one, rows[first]), (two, rows[~first])]
            means = [part.sum(0) for _, part in halves]
            norms = [np.sqrt(m @ m) for m in means]
            if min(norms) < 1e-9:
                break
            one, two = means[0] / norms[0], means[1] / norms[1]
        return halves

    def homes(self, unit: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """The cell of each unit vector, and the nodes on the way to it with the angle to each one's centre."""
        cell = np.zeros(len(unit), np.int64)
        nodes, angles = [[] for _ in unit], [[] for _ in unit]
        open_ = [(0, np.arange(len(unit)))]
        while open_:
            node, at = open_.pop()
            one, two = self.children[node]
            if one < 0 or not len(at):
                cell[at] = node
                continue
            near = unit[at] @ self.centres[[one, two]].T
            side = (near[:, 0] < near[:, 1]).astype(int)
            for k, child in enumerate((one, two)):
                part = at[side == k]
                for i, angle in zip(part.tolist(), np.arccos(np.clip(near[side == k, k], -1, 1)).tolist(), strict=True):
                    nodes[i].append(int(child))
                    angles[i].append(angle)
                open_.append((child, part))
        return cell, nodes, angles

    def reached(self, unit: np.ndarray, angle: float) -> list[list[int]]:
        """The cells that can hold a vector within ``angle`` of each unit vector.

        By the triangle inequality a node is too far if its centre is farther than its radius and ``angle``, and if the other centre is nearer
        by more than twice ``angle``: a vector within ``angle`` would lie on the other side.
        """
        out: list[list[int]] = [[] for _ in unit]
        open_ = [(0, np.arange(len(unit)))]
        while open_:
            node, at = open_.pop()
            one, two = self.children[node]
            if not len(at):
                continue
            if one < 0:
                for i in at.tolist():
                    out[i].append(int(node))
                continue
            far = np.arccos(np.clip(unit[at] @ self.centres[[one, two]].T, -1, 1))
            for k, child in enumerate((one, two)):
                ok = (far[:, k] - self.radii[child] <= angle + ROOM) & (far[:, k] - far[:, 1 - k] <= 2 * angle + ROOM)
                open_.append((child, at[ok]))
        return out


def fitted(right: DataFrame) -> tuple[Cells | None, np.ndarray, int]:
    """A tree of cells from a bounded sample of ``right`` (b, v), none for a few rows; the unit vectors of the sample; and the most common length."""
    sizes = right.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width, total = (sizes["n"], right.count()) if sizes else (0, 0)
    if total <= BLOCK_ROWS:
        return None, np.zeros((0, width)), width
    rows, size, norms = matrix(right.select("v", "b").orderBy(F.xxhash64("b"), "b").limit(max(2, SAMPLE_BYTES // (8 * max(1, width)))).toPandas()["v"])
    kept = np.flatnonzero((size == width) & (norms > 0))
    unit = rows[kept, :width] / norms[kept, None]
    return Cells(unit, min(MOST_CELLS, CELLS_PER_BLOCK * -(-total // BLOCK_ROWS))), unit, width


def dealt(left: DataFrame, right: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides with (cell, i, j), so that rows with a cosine of at least ``least`` above 0 meet in one group; and the rows of either side per cell.

    Centres come from a bounded sample of ``right``; every row of it lies in one cell, and the cells' true radii are found over all rows.
    A row of ``left`` goes to the cells that can hold a vector at an angle of arccos(``least``), so cells that are too far never meet, and a
    row is copied as often as its own neighbourhood has cells, not as the table has. A cell with more rows than a task should hold is cut
    into blocks of ``BLOCK_ROWS``. Vectors of different lengths have cells of their own, as null and zero vectors have, which cannot reach
    ``least``. How much is pruned is up to the data: clusters part well, while vectors spread evenly over many dimensions are nearly all in
    reach of each other.
    """
    angle, session = float(np.arccos(min(1.0, least))), left.sparkSession
    tree, _, width = fitted(right)
    own = "a long, v array<double>"

    def usable(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, the places of vectors of the common length that are not zero, and norms."""
        rows, size, norm = matrix(vectors)
        return rows[:, :width], np.flatnonzero((size == width) & (norm > 0)), norm

    theirs = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in right.schema.fields)
    if tree is not None:
        shared = session.sparkContext.broadcast(tree)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for y in batches:
                cell, nodes, angles = np.full(len(y), 0), [[] for _ in range(len(y))], [[] for _ in range(len(y))]
                rows, at, norms = usable(y["v"])
                if len(at):
                    found, n, a = shared.value.homes(rows[at] / norms[at, None])
                    cell[at] = found
                    for k, i in enumerate(at.tolist()):
                        nodes[i], angles[i] = n[k], a[k]
                yield y.assign(cell=cell, nodes=nodes, angles=angles)

        placed = cut(right.mapInPandas(place, f"{theirs}, cell long, nodes array<int>, angles array<double>"))
        far = placed.select(F.explode(F.arrays_zip("nodes", "angles")).alias("z")).groupBy("z.nodes").agg(F.max("z.angles").alias("r"))
        radii = np.full(len(tree.centres), -10.0)  # nothing reaches a node without rows
        for r in far.collect():  # two rows per cell at most
            radii[r.nodes] = r.r
        tree.radii = radii
        ready = session.sparkContext.broadcast(tree)

        def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                goals = [[0]] * len(x)
                rows, at, norms = usable(x["v"])
                if len(at):
                    for k, found in zip(at.tolist(), ready.value.reached(rows[at] / norms[at, None], angle), strict=True):
                        goals[k] = found
                yield x.assign(goals=goals)

        gone = left.mapInPandas(reach, f"{own}, goals array<long>").withColumn("cell", F.explode("goals")).drop("goals")
        two = placed.drop("nodes", "angles")
    else:
        gone, two = left.withColumn("cell", F.lit(0).cast("long")), right.withColumn("cell", F.lit(0).cast("long"))
    # Node 0 is no cell of its own once it is halved: there the rows of other lengths meet, told apart by their length.
    tell: Column = F.when((F.col("cell") == 0) & (F.size("v") != width), -F.size("v").cast("long")).otherwise(F.col("cell"))
    one, two = cut(gone.withColumn("cell", tell)), two.withColumn("cell", tell)
    per = one.groupBy("cell").agg(F.count("*").alias("lefts")).join(two.groupBy("cell").agg(F.count("*").alias("rights")), "cell")
    per = cut(per)
    parts = per.select("cell", F.ceil(F.col("lefts") / BLOCK_ROWS).cast("int").alias("n"), F.ceil(F.col("rights") / BLOCK_ROWS).cast("int").alias("m"))
    one, two = one.join(parts, "cell"), two.join(parts, "cell")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = one.withColumn("i", F.pmod(F.xxhash64("a"), F.col("n")).cast("int")).withColumn("j", span("m")).drop("n", "m")
    two = two.withColumn("j", F.pmod(F.xxhash64("b"), F.col("m")).cast("int")).withColumn("i", span("n")).drop("n", "m")
    return one, two, per


def share_met(left: DataFrame, right: DataFrame, least: float) -> float:
    """Of all pairs of ``left`` and ``right``, the share whose cells ``dealt`` brings together."""
    per = dealt(doubles(left.select("a", "v")), doubles(right), least)[2]
    met = per.agg(F.sum(F.col("lefts") * F.col("rights"))).first()[0] or 0
    return met / max(1, left.count() * right.count())
