"""Causal sets: points of a spacetime region, the order between them, links, path counts, the K matrix and fields."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions.frames import cut, parts, spread
from tessera.plans import trace

from . import elementwise, products
from .array import Matrix, session

#: Points in a block of the pair join.
BLOCK = 2048
#: Points whose packed relation is sent to every task of compute_k: 56 MB at this size.
PACKED = 30_000
#: Tasks of paths for each that the files of the points need: a point has several edges.
PER_POINT = 3


class Spacetime:
    """A region: its dimension, volume, points and order. Users may write their own with these methods."""

    def dimension(self) -> int:
        raise NotImplementedError

    def volume(self) -> float:
        raise NotImplementedError

    def extents(self) -> list[float]:
        """Upper ends of the coordinates, which begin at 0."""
        raise NotImplementedError

    def precedes(self, a, b) -> Column:
        """Whether a point precedes another; ``a`` and ``b`` give a coordinate's column by its number."""
        raise NotImplementedError

    def points(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        """id, c0, c1, ...: uniform coordinates that are hashes of id, axis and seed, the same under any partitioning."""
        cols = [(F.shiftrightunsigned(F.xxhash64("id", F.lit(k), F.lit(seed)), 11).cast("double") * F.lit(2.0**-53 * e)).alias(f"c{k}") for k, e in enumerate(self.extents())]
        return spark.range(n).select("id", *cols)

    def transform_coordinates(self, coords):
        return coords

    def get_boundary(self) -> list[np.ndarray]:
        return []


class MinkowskiDiamond(Spacetime):
    """A causal diamond in light-cone coordinates between 0 and 1."""

    def __init__(self, dimension: int = 2):
        self._d = dimension

    def dimension(self):
        return self._d

    def volume(self):
        return 1.0

    def extents(self):
        return [1.0] * self._d

    def precedes(self, a, b):
        out = a(0) < b(0)
        for k in range(1, self._d):
            out = out & (a(k) < b(k))
        return out

    def transform_coordinates(self, coords):
        """(u, v) to (t, x) in two dimensions."""
        coords = np.asarray(coords)
        if self._d != 2:
            return coords
        return np.column_stack((coords[:, 0] + coords[:, 1], coords[:, 1] - coords[:, 0])) / math.sqrt(2)

    def get_boundary(self):
        return [self.transform_coordinates(_rectangle(1.0, 1.0))] if self._d == 2 else []


class MinkowskiCylinder(Spacetime):
    """Time of a height, and space that closes at a circumference."""

    def __init__(self, dimension: int, height: float, circumference: float):
        if dimension != 2:
            raise ValueError("a cylinder has two dimensions")
        self.height, self.circumference = height, circumference

    def dimension(self):
        return 2

    def volume(self):
        return self.height * self.circumference

    def extents(self):
        return [self.height, self.circumference]

    def precedes(self, a, b):
        dx = F.abs(b(1) - a(1))
        return (a(0) < b(0)) & (b(0) - a(0) > F.least(dx, F.lit(self.circumference) - dx))

    def transform_coordinates(self, coords):
        """(t, x) to (t, X, Y) on the cylinder in space."""
        coords = np.asarray(coords)
        r = self.circumference / (2 * math.pi)
        return np.column_stack((coords[:, 0], r * np.cos(coords[:, 1] / r), r * np.sin(coords[:, 1] / r)))

    def get_boundary(self):
        x = np.linspace(0, self.circumference, 100)
        return [self.transform_coordinates(np.column_stack((np.full(100, t), x))) for t in (0.0, self.height)]


class MinkowskiBox(Spacetime):
    """A box of a time extent and equal space extents."""

    def __init__(self, dimension: int, time_extent: float, space_extent: float):
        self._d, self.time_extent, self.space_extent = dimension, time_extent, space_extent

    def dimension(self):
        return self._d

    def volume(self):
        return self.time_extent * self.space_extent ** (self._d - 1)

    def extents(self):
        return [self.time_extent] + [self.space_extent] * (self._d - 1)

    def precedes(self, a, b):
        dt = b(0) - a(0)
        dx = F.lit(0.0)
        for k in range(1, self._d):
            dx = dx + (b(k) - a(k)) * (b(k) - a(k))
        return (dt > 0) & (dt * dt > dx)

    def get_boundary(self):
        return [_rectangle(self.time_extent, self.space_extent)] if self._d == 2 else []


def _rectangle(a: float, b: float) -> np.ndarray:
    return np.array([(0.0, 0.0), (a, 0.0), (a, b), (0.0, b), (0.0, 0.0)])


def relation(points: DataFrame, precedes, order: str = "index", block: int = BLOCK, within: str | None = None) -> DataFrame:
    """Edges i, j of all pairs in order.

    Points are dealt to blocks of ids; a block meets every later block once, as an
    equi-join on the pair of blocks, so the pairs spread over all tasks without
    a cartesian product or a broadcast side. ``order`` "index" keeps pairs whose
    ids ascend, as a sprinkling without sorting does; "time" keeps all. ``within``
    names a column whose values are causal sets of their own; it is kept. A set has
    as many blocks as its points fill, dealt by hash of the id, and each block meets
    each, so a set of at most ``block`` points is one key and a large one many.
    Points whose ``within`` is null are in no set.
    """
    if order not in ("index", "time"):
        raise ValueError("order is 'index' or 'time'")
    cols = [c for c in points.columns if c not in ("id", within)]
    left = {"i": "id", **{f"a_{c}": c for c in cols}}
    right = {"j": "id", **{f"b_{c}": c for c in cols}}
    if within:
        large = points.groupBy(within).count().filter(F.col("count") > block).select(within, F.ceil(F.col("count") / block).alias("_blocks"))
        dealt = points.join(large, within, "left").withColumn("_last", F.coalesce("_blocks", F.lit(1)) - 1).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_last") + 1))
    else:
        n_blocks = points.agg(F.floor(F.max("id") / block).alias("b")).first()["b"]
        dealt = points.withColumn("_last", F.lit(n_blocks or 0).cast("bigint")).withColumn("_own", F.floor(F.col("id") / block))
    zero, by_id = F.lit(0).cast("bigint"), order == "index" and not within
    own_key = [within] if within else []
    left = dealt.select(*own_key, *[F.col(c).alias(n) for n, c in left.items()], F.col("_own").alias("p"), F.explode(F.sequence(F.col("_own") if by_id else zero, F.col("_last"))).alias("q"))
    right = dealt.select(*own_key, *[F.col(c).alias(n) for n, c in right.items()], F.col("_own").alias("q"), F.explode(F.sequence(zero, F.col("_own") if by_id else F.col("_last"))).alias("p"))
    keep = F.col("i") < F.col("j") if order == "index" else F.col("i") != F.col("j")
    pred = precedes(lambda k: F.col(f"a_c{k}"), lambda k: F.col(f"b_c{k}"))
    return left.join(right, [*own_key, "p", "q"]).filter(keep & pred).select(*own_key, "i", "j")


def path_counts(edges: DataFrame) -> DataFrame:
    """i, j, v: paths of two steps."""
    return _steps(edges, PER_POINT * parts(edges)).groupBy("i", "j").agg(F.count("*").alias("v"))


def _steps(edges: DataFrame, tasks: int) -> DataFrame:
    """i, j of every path of two steps; in large tables dealt by i and j, as a task would else hold the pairs of ever more paths."""
    first, second = edges.select("i", F.col("j").alias("k")), edges.select(F.col("i").alias("k"), "j")
    both = spread(first, ["k"], tasks=tasks).join(spread(second, ["k"], tasks=tasks), "k")
    return spread(both.select("i", "j"), ["i", "j"], tasks=tasks)


def links(edges: DataFrame) -> DataFrame:
    """Edges that no path of two steps replaces (the Hasse diagram)."""
    tasks = PER_POINT * parts(edges)
    return spread(edges, ["i", "j"], tasks=tasks).join(_steps(edges, tasks).distinct(), ["i", "j"], "left_anti")


def compute_k(c: Matrix, a: float, method: str | None = None) -> Matrix:
    """K = C (a I + C)^-1 of a strictly upper C.

    "columns" solves columns apart, each task with the packed relation; "series"
    adds (-1)^p C^(p+1) / a^(p+1) until a power vanishes, in joins only, which
    has no limit of size. By default the first up to PACKED points.
    """
    n = c.shape[0]
    if c.shape[1] != n:
        raise ValueError("a square matrix is needed")
    if a == 0:
        raise ValueError("a is not 0")
    edges = c.df.filter("i < j")
    method = method or ("columns" if n <= PACKED else "series")
    trace.note("compute_k", method)
    if method == "series":
        power, total, sign = edges.select("i", "j", F.lit(1.0 / a).alias("v")), None, 1.0
        step = edges.select(F.col("i").alias("k"), "j")
        while not power.isEmpty():
            term = power.withColumn("v", F.col("v") * sign)
            total = term if total is None else total.unionByName(term)
            power = cut(power.select("i", F.col("j").alias("k"), "v").join(step, "k").groupBy("i", "j").agg((F.sum("v") / a).alias("v")))
            sign = -sign
        if total is None:
            return Matrix(edges.select("i", "j", F.lit(0.0).alias("v")), n, n, "float64", "triangular", {"has_zero_diagonal": True})
        return Matrix(total.groupBy("i", "j").agg(F.sum("v").alias("v")), n, n, "float64", "triangular", {"has_zero_diagonal": True})
    if n > PACKED:
        raise ValueError(f"columns take at most {PACKED} points")
    packed = np.zeros((n, -(-n // 8)), dtype=np.uint8)
    for part in edges.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("js")).toLocalIterator():  # one row at a time; bounded by PACKED
        row = np.zeros(n, dtype=bool)
        row[part["js"]] = True
        packed[part["i"]] = np.packbits(row)
    shared = c.spark.sparkContext.broadcast(packed)

    def columns(batches):
        for batch in batches:
            js = batch["id"].to_numpy()
            top = int(js.max())
            k = np.zeros((top + 1, len(js)))
            for i in range(top - 1, -1, -1):
                row = np.unpackbits(shared.value[i], count=n)
                m = np.flatnonzero(row[: top + 1])
                k[i] = (row[js] - k[m].sum(axis=0)) / a
                k[i, js <= i] = 0.0
            i, col = np.nonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(js[col]), pa.array(k[i, col])], names=["i", "j", "v"])

    tasks = max(1, min(c.spark.sparkContext.defaultParallelism * 4, n // 16))
    df = c.spark.range(n).repartition(tasks).mapInArrow(columns, "i bigint, j bigint, v double")
    return Matrix(df, n, n, "float64", "triangular", {"has_zero_diagonal": True})


class CausalSet:
    """Points sprinkled into a spacetime and their relation, or a given relation."""

    def __init__(self, n: int | None = None, density: float | None = None, spacetime: Spacetime | None = None, seed=None, matrix: Matrix | None = None, order: str = "index", spark: SparkSession | None = None):
        self.spacetime = spacetime or MinkowskiDiamond(2)
        self.seed = _seed(seed)
        if n is None and matrix is not None:
            n = matrix.shape[0]
        if n is None:
            if density is None:
                raise ValueError("n or density is needed")
            n = int(np.random.default_rng(self.seed).poisson(density * self.spacetime.volume()))
        if matrix is not None and matrix.shape != (n, n):
            raise ValueError(f"a relation of {matrix.shape} does not fit n={n}")
        self._n, self.order, self.spark, self._given = int(n), order, spark or session(), matrix is not None
        if matrix is None:
            edges = relation(self.points(), self.spacetime.precedes, order) if self._n else self.spark.createDataFrame([], "i bigint, j bigint")
            matrix = Matrix(edges.withColumn("v", F.lit(True)), n, n, "bit", "causal" if order == "index" else "dense")
        self.causal_matrix = matrix

    def points(self) -> DataFrame:
        return self.spacetime.points(self.spark, self._n, self.seed)

    @property
    def C(self) -> Matrix:
        return self.causal_matrix

    @property
    def n(self) -> int:
        return self._n

    N = n

    @property
    def density(self) -> float:
        return self._n / self.spacetime.volume()

    rho = density

    def __len__(self):
        return self._n

    def __repr__(self):
        return f"CausalSet(n={self._n}, spacetime={type(self.spacetime).__name__})"

    def coordinates(self, indices=None, force: bool = False) -> np.ndarray:
        """Coordinates of points by id, in the order asked; they are made anew from the seed."""
        if self._given:
            raise ValueError("a given relation has no coordinates")
        count = self._n if indices is None else len(indices)
        if count > 100_000 and not force:
            raise UserWarning(f"{count} points; pass force=True")
        points = self.points()
        if indices is None:
            rows = points.orderBy("id").toArrow()
        else:
            ids = [int(k) for k in indices]
            if any(not 0 <= k < self._n for k in ids):
                raise IndexError("no such point")
            want = self.spark.createDataFrame(pa.table({"place": pa.array(range(len(ids)), type=pa.int64()), "id": pa.array(ids, type=pa.int64())}))
            rows = points.join(F.broadcast(want), "id").orderBy("place").toArrow()
        return np.stack([rows[f"c{k}"].to_numpy() for k in range(self.spacetime.dimension())], axis=1)

    def links(self) -> Matrix:
        return Matrix(links(self.C.df.select("i", "j")).withColumn("v", F.lit(True)), self._n, self._n, "bit", self.C.structure)

    def path_counts(self) -> Matrix:
        return products.matmul(self.C, self.C)

    def compute_k(self, a: float) -> Matrix:
        return compute_k(self.C, a)

    def save(self, path: str) -> None:
        from tessera.sources.storage import save

        save(self, path)

    @staticmethod
    def load(path: str) -> "CausalSet":
        from tessera.sources.storage import load

        out = load(path)
        if not isinstance(out, CausalSet):
            raise ValueError("no causal set")
        return out


def _seed(seed) -> int:
    if seed is None:
        return random.SystemRandom().getrandbits(62)
    return random.Random(seed).getrandbits(62) if isinstance(seed, str) else int(seed)


def causet(n=None, density=None, spacetime=None, seed=None, matrix=None, **how) -> CausalSet:
    return CausalSet(n, density, spacetime, seed, matrix, **how)


def sprinkle(spacetime: Spacetime, n: int, seed: int, spark: SparkSession | None = None) -> Matrix:
    """The relation of sprinkled points."""
    return CausalSet(n, spacetime=spacetime, seed=seed, spark=spark).C


class Field:
    def __init__(self, causet: CausalSet):
        self.causet = causet

    def propagator(self, *args):
        raise NotImplementedError


class ScalarField(Field):
    """A free scalar field of a mass on a causal set."""

    def __init__(self, causet: CausalSet, mass: float = 0.0):
        super().__init__(causet)
        self.mass = mass
        self._made: dict[tuple, Matrix] = {}

    def coefficients(self) -> tuple[float, float]:
        """a and b of the hop-and-stop sum, for Minkowski regions of two and four dimensions."""
        st, rho = self.causet.spacetime, self.causet.density
        if not isinstance(st, (MinkowskiDiamond, MinkowskiCylinder, MinkowskiBox)):
            raise NotImplementedError("Minkowski regions only; pass a and b")
        if st.dimension() == 2:
            return 0.5, -(self.mass**2) / rho
        if st.dimension() == 4:
            return math.sqrt(rho) / (2 * math.pi * math.sqrt(6)), -(self.mass**2) / rho
        raise NotImplementedError("two or four dimensions; pass a and b")

    def propagator(self, a: float | None = None, b: float | None = None) -> Matrix:
        """Retarded propagator: a C without mass, else -1/b times K of -1/(a b)."""
        if (a, b) not in self._made:
            x, y = self.coefficients() if a is None or b is None else (a, b)
            x, y = (x if a is None else a), (y if b is None else b)
            c = self.causet.C
            if abs(y) < 1e-15:
                out = Matrix(c.df.withColumn("v", F.lit(float(x))), *c.shape, "float64", "triangular", {"has_zero_diagonal": True})
            else:
                out = elementwise.scale(compute_k(c, -1.0 / (x * y)), -1.0 / y)
            self._made[a, b] = out
        return self._made[a, b]

    compute_retarded_propagator = propagator

    def pauli_jordan(self) -> Matrix:
        """i (K - K^T), Hermitian."""
        k = self.propagator()
        df = k.df.unionByName(k.df.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v")))
        return Matrix(df.withColumn("v", D.pair(F.lit(0.0), F.col("v"))), *k.shape, "complex_float64", "dense", {"is_hermitian": True})


def embedding_sample(c: CausalSet, most: int = 50_000, seed: int = 42) -> np.ndarray:
    """Coordinates for a plot, of all points or of a hashed sample."""
    n = len(c)
    if n <= most:
        ids = None
    else:
        ids = np.sort(np.random.default_rng(seed).choice(n, most, replace=False))
    return c.spacetime.transform_coordinates(c.coordinates(ids, force=True))


def hasse_plot_data(c: CausalSet, most: int = 500) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Coordinates and links for a plot of at most ``most`` points."""
    if len(c) > most:
        raise ValueError(f"a plot takes at most {most} points")
    return embedding_sample(c), sorted((r["i"], r["j"]) for r in c.links().df.select("i", "j").collect())


def heatmap_data(c: CausalSet, most: int = 2000) -> np.ndarray:
    """The relation as an array for a plot of at most ``most`` points."""
    from tessera.sources.storage import to_numpy

    if len(c) > most:
        raise ValueError(f"a plot takes at most {most} points")
    return to_numpy(c.C)
