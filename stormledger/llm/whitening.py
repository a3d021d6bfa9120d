"""Whitening of embeddings on their leading principal components.

The components are found by Chebyshev-filtered subspace iteration; the covariance is never formed.
A pass sends the block Q to the tasks, each sums Yᵀ(YQ) over its centred rows Y, and Spark adds the
sums by row, so that what reaches the driver is one d x b matrix, whatever the number of rows. A
round is

* Rayleigh-Ritz on the orthonormal block, with the residuals of the wanted vectors,
* a Chebyshev polynomial of the covariance, by its recurrence, one pass a degree, that damps the
  spectrum from 0 to the smallest Ritz value of the block and raises what lies above,
* QR of the filtered block.

In every round the last columns are drawn anew. The wanted vectors are certified when their
residuals reach rounding in a round after which the fresh directions, filtered as well, have brought
nothing larger. A spectrum too flat for the block doubles it; a block of all d dimensions needs
no filter, one Rayleigh-Ritz step is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.session import WorkTables

COMPONENTS, BLOCK_PER_COMPONENT, FRESH = 8, 6, 4
SCALE, SHIFT = 1024, 100_000
RESIDUAL, ZERO = 1e-13, 1e-11  # relative to the largest eigenvalue
DEGREES, SPREAD, MANY_PASSES = (4, 12), 1e7, 60
LARGEST = float(1 << 42)  # entries from here on count as not finite: they do not fit the whole numbers
ROWS = 4096
SEED = 20_231


@dataclass
class Fit:
    """What the fit list gives: n, the sums per dimension, components as columns, eigenvalues, trace."""

    n: int
    sums: object
    largest: int
    vectors: object = None
    values: object = None
    trace: float = 0.0

    def whole(self, x):
        """n * x - S per entry, as whole numbers."""
        import numpy as np

        if 2 * self.n * self.largest < 1 << 62:
            return self.n * x - self.sums
        return self.n * x.astype(object) - np.array([int(s) for s in self.sums], object)

    def centred(self, x):
        import numpy as np

        return self.whole(x).astype(np.float64) / self.n

    def deviation(self, x):
        """The rows' sums of squares of whole(x), exact; None where one does not fit 64 bits."""
        import numpy as np

        whole = self.whole(x)
        if len(whole) and whole.dtype != object and x.shape[1] * int(np.abs(whole).max()) ** 2 >= 1 << 63:
            whole = whole.astype(object)
        return [v if v < 1 << 63 else None for v in (whole * whole).sum(axis=1).tolist()]


def _pieces(batches: Iterator, column: str, dims: int) -> Iterator:
    """(batch, x): at most ROWS rows and their vectors as whole numbers."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(part.schema.get_field_index(column)).flatten()
            c = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            yield part, np.floor(SCALE * c).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, dims: int, shape: tuple[int, int], dtype: str, add: Callable) -> object:
    """The sum over all vectors of add(x), a matrix of this shape."""
    import numpy as np

    height, width = shape
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for _, x in _pieces(batches, "vector", dims):
            total = add(x) if total is None else total + add(x)
        if total is not None:
            columns = [pa.array(np.ascontiguousarray(total[:, k])) for k in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), *columns], ["r", *names])

    parts = rows.select("vector").mapInArrow(run, f"r int, {', '.join(f'{c} {dtype}' for c in names)}")
    found = parts.groupBy("r").agg(*[F.sum(c).alias(c) for c in names]).orderBy("r").collect()
    return np.array([r[1:] for r in found])


def _passes(rows: DataFrame, dims: int, fit: Fit) -> Callable:
    """Q to (covariance times Q, variances)."""
    import numpy as np

    def apply(q):
        def add(x):
            y = fit.centred(x)
            return np.hstack([y.T @ (y @ q), (y * y).sum(axis=0)[:, None]])

        found = _summed(rows, dims, (dims, q.shape[1] + 1), "double", add) / fit.n
        return found[:, :-1], found[:, -1]

    return apply


def _growth(value: float, top: float) -> float:
    """By how much a degree raises an eigenvalue above [0, top] against those within."""
    x = max(1.0, 2 * value / top - 1)
    return x + (x * x - 1) ** 0.5


def leading(apply: Callable, dims: int, wanted: int):
    """(eigenvalues, eigenvectors as columns, trace) of the operator behind `apply`, the largest first."""
    import math

    import numpy as np

    rng = np.random.default_rng(SEED)
    width = min(dims, BLOCK_PER_COMPONENT * wanted)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    filtered = False
    while True:
        aq, variances = apply(q)
        small = q.T @ aq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        residual = np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max()
        exact = q.shape[1] == dims
        if exact or values[0] <= 0 or filtered and residual <= RESIDUAL * values[0]:
            keep = values[:wanted] > ZERO * max(values[0], 0)
            vectors = q[:, :wanted][:, keep]
            sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1
            return values[:wanted][keep], vectors * sign, variances.sum()
        top = max(values[-1], 1e-6 * values[0])
        per_degree = _growth(values[min(wanted, len(values)) - 1], top)
        need = math.log(max(2.0, residual / (RESIDUAL * values[0]))) / max(math.log(per_degree), 1e-9)
        if need > MANY_PASSES:
            more = min(dims, 2 * q.shape[1]) - q.shape[1]
            q, filtered = np.linalg.qr(np.hstack([q, rng.standard_normal((dims, more))]))[0], False
            continue
        spread = math.log(SPREAD) / max(math.log(_growth(values[0], top) / per_degree), 1e-9)
        degree = int(min(max(DEGREES[0], min(need + 1, spread)), DEGREES[1]))
        # Fresh columns go through the whole filter, so the first step's product is made for them too.
        q = q.copy()
        q[:, -FRESH:] = rng.standard_normal((dims, FRESH)) / math.sqrt(dims)
        centre = half = top / 2
        scale = sigma = half / (values[0] - centre)
        last, now = q, (apply(q)[0] - centre * q) * (scale / half)
        for _ in range(degree - 1):
            onward = 1 / (2 / scale - sigma)
            last, now = now, (apply(now)[0] - centre * now) * (2 * onward / half) - sigma * onward * last
            sigma = onward
        q, filtered = np.linalg.qr(now)[0], True


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors become whole numbers, floor(1024 c) + 100000. Rows take part whose vector is not null,
    has no null or non-finite entry and is of the commonest length (ties: the longest); entries of
    2^42 or more count as not finite. There are as many components as the covariance has
    eigenvalues above rounding, `components` at most; so one vector, or equal ones, give no rows,
    as does an empty table. Equal eigenvalues have any orthonormal vectors of their space. Repeated
    rows and null keys count as rows. deviation is null where it exceeds 64 bits. Other columns are
    left out.
    """
    import numpy as np

    spark = df.sparkSession
    work = WorkTables(spark, "whitening")
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    given = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    valid = work.save(given.filter(F.col("vector").isNotNull() & finite))  # NaN is larger than any number
    lengths = valid.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.filter("dims > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    schema = T.StructType([
        T.StructField(key, given.schema["key"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    if common is None:
        return spark.createDataFrame([], schema)
    dims, n = common["dims"], common["n"]
    rows = valid.filter(F.size("vector") == dims)
    sums = _summed(rows, dims, (dims, 1), "bigint", lambda x: x.sum(axis=0, dtype=np.int64)[:, None])[:, 0]
    bound = rows.select(F.max(F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double")))))).first()[0]
    fit = Fit(n, sums, int(bound * SCALE) + SHIFT + 1)
    fit.values, fit.vectors, fit.trace = leading(_passes(rows, dims, fit), dims, min(components, dims))
    made = len(fit.values)
    if not made:
        return spark.createDataFrame([], schema)
    onto = fit.vectors / np.sqrt(fit.values)
    mean = _summed(rows, dims, (made, 1), "double", lambda x: (fit.centred(x) @ onto).sum(axis=0)[:, None])[:, 0] / n

    def squares(x):
        w = fit.centred(x) @ onto - mean
        return w.T @ w

    error = float(np.abs(_summed(rows, dims, (made, made), "double", squares) / n - np.eye(made)).max())
    explained = (fit.values / fit.trace).tolist()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, x in _pieces(batches, "vector", dims):
            rows_of = np.repeat(np.arange(len(x)), made)
            deviation = pa.array(fit.deviation(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("key")).take(pa.array(rows_of)),
                pa.array(np.tile(np.arange(1, made + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows_of), n, np.int64)), deviation.take(pa.array(rows_of)),
                pa.array((fit.centred(x) @ onto).reshape(-1)), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows_of), error)),
            ], schema.names)

    return rows.mapInArrow(run, schema)
