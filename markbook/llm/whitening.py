"""Whitening of embeddings by a covariance over distinct vectors, weighted by their copies or by one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import joined_back, settled

#: entries become integers: floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: an entry must fit a long after scaling
LARGEST = 2.0**56


def whole_numbers(vector: Column) -> Column:
    """The integer vector x of an embedding."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + F.lit(SHIFT).cast("bigint"))


def usable(vector: Column) -> Column:
    """Neither null nor with entries that are null, not finite or too large for a long."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST)
    return F.coalesce(vector.isNotNull() & F.forall(vector, fits), F.lit(False))


@dataclass
class Fit:
    """One fit list: weight n, sums S per dimension; unit eigenvectors by falling eigenvalue, and the share each explains.

    ``axes`` and ``values`` are those of components that vary; ``explained`` has an entry for every component.
    """

    n: int
    sums: list[int]
    axes: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: list[float | None] | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in 64 bits where that is safe, else as Python's integers."""
        if self.n * max(int(np.abs(x).max(initial=0)), 1) >= 1 << 61:
            x = x.astype(object)
        return x * self.n - np.array(self.sums, x.dtype)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int]:
        """The sum of squared deviations of each vector, exactly."""
        found = self.deviations(x)
        if x.shape[1] * float(np.abs(found).max(initial=0)) ** 2 >= 2.0**62:
            found = found.astype(object)
        return (found * found).sum(1).tolist()

    def solve(self, covariance: np.ndarray, components: int) -> None:
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][:components]
        # an eigenvalue within the rounding of the largest is none
        real = order[values[order] > max(values.max(), 0) * len(values) * np.finfo(float).eps]
        self.axes, self.values, trace = axes[:, real], values[real], float(np.trace(covariance))
        self.explained = [float(v / trace) for v in self.values] if trace > 0 else []
        self.explained += [0.0 if trace > 0 else None] * (len(order) - len(self.explained))


def _matrices(batch: pa.RecordBatch, vectors: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, rows, matrix): the vectors of a batch, those of each fit list d together."""
    lists = batch.column("d").to_numpy()
    for d in np.unique(lists):
        rows = np.flatnonzero(lists == d)
        yield int(d), rows, batch.column(vectors).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _weights(batch: pa.RecordBatch, weighted: bool) -> np.ndarray:
    return batch.column("copies").to_numpy() if weighted else np.ones(batch.num_rows, np.int64)


def _sums(table: DataFrame, vectors: str, weighted: bool) -> dict[int, tuple[int, list]]:
    """{d: (weight, sums per dimension)}. Integers are summed exactly."""
    whole = dict(table.dtypes)[vectors] == "array<bigint>"
    number, kind = ("decimal(38,0)", pa.decimal128(38)) if whole else ("double", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        sums: dict[int, list] = {}
        for batch in batches:
            copies = _weights(batch, weighted)
            for d, rows, x in _matrices(batch, vectors):
                w = copies[rows]
                if whole and float(np.abs(x).max(initial=0)) * float(w.sum()) >= 2.0**61:
                    x = x.astype(object)
                new = [int(w.sum()), *(w @ x).tolist()]
                sums[d] = [a + b for a, b in zip(sums[d], new, strict=True)] if d in sums else new
        rows = [(d, i, Decimal(v) if whole else float(v)) for d, s in sums.items() for i, v in enumerate(s)]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        types = (pa.int32(), pa.int32(), kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["d", "i", "v"])

    parts = table.select("d", "copies", vectors).mapInArrow(run, f"d int, i int, v {number}")
    found: dict[int, dict] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.d, {})[r.i] = r.v
    cast = int if whole else float
    return {d: (int(v[0]), [cast(v[i]) for i in range(1, len(v))]) for d, v in found.items()}


def _covariance(table: DataFrame, vectors: str, weighted: bool, centre, weight: dict[int, int]) -> dict[int, np.ndarray]:
    """{d: covariance}: weighted products of centred vectors, one matrix product per batch, summed over tasks.

    ``centre(d, x)`` centres a matrix of vectors. Half a matrix of each task is shuffled, and half a matrix collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            copies = _weights(batch, weighted)
            for d, rows, x in _matrices(batch, vectors):
                c = centre(d, x)
                sums[d] = sums.get(d, 0) + (c * copies[rows, None]).T @ c
        for d, total in sums.items():
            i, j = (t.astype(np.int32) for t in np.triu_indices(len(total)))
            columns = [np.full(len(i), d, np.int32), i, j, total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "i", "j", "v"])

    parts = table.select("d", "copies", vectors).mapInArrow(run, "d int, i int, j int, v double")
    entries = parts.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    d, i, j, v = (entries.column(c).to_numpy() for c in ("d", "i", "j", "v"))
    found: dict[int, np.ndarray] = {}
    for one in np.unique(d).tolist():
        mine = d == one
        full = found[one] = np.zeros((int(j[mine].max()) + 1,) * 2)
        full[i[mine], j[mine]] = full[j[mine], i[mine]] = v[mine] / weight[one]
    return found


def _projected(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(key, copies, d, deviation, z): each distinct vector whitened, z with the components that vary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            deviation, z = [None] * batch.num_rows, [None] * batch.num_rows
            for d, rows, x in _matrices(batch, "x"):
                fit = fits[d]
                projected = (fit.centred(x) @ fit.axes / np.sqrt(fit.values)).tolist()
                for row, square, values in zip(rows.tolist(), fit.squares(x), projected, strict=True):
                    deviation[row], z[row] = Decimal(square), values
            arrays = [pa.array(deviation, pa.decimal128(38)), pa.array(z, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "copies", "d")], *arrays], ["key", "copies", "d", "deviation", "z"])

    schema = "key binary, copies long, d int, deviation decimal(38,0), z array<double>"
    return distinct.select("key", "copies", "d", "x").mapInArrow(run, schema)


def whitened(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "one"
) -> DataFrame:
    """One row per usable vector and component up to ``components``: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Entries become integers x. Equal vectors x are grouped, which each task does before the shuffle; each is a row of the fit
    list, with weight one or (``weights="copies"``) as often as it occurs. Weight n and sums S are exact integers. The
    covariance of x is a sum of matrix products of centred vectors, (n x - S) / n, so nothing large cancels; half a matrix
    leaves a task. Its eigenvectors are found on the driver, which holds one matrix of the vectors' length. Each distinct
    vector is whitened once and returns to its rows by digest (`joined_back`: no row of a very frequent vector is shuffled).

    ``deviation`` is the exact sum of (n x - S)² as decimal(38, 0). ``identity_error`` is the largest absolute entry of the
    covariance of the whitened vectors, over the fit list and centred again, minus the identity.

    Vectors that are null or hold entries that are null, not finite or not below 2^56 give no rows. Vectors of different
    lengths are fit lists of their own; those of length 0 have no component and no rows. A component without variance (copies
    of one vector only, fewer vectors than dimensions) keeps its rows, with whitened null and no part in identity_error, which
    is null if no component varies. Rows with a null or repeated id are rows of their own. No vectors give no rows. Other
    columns are not read.
    """
    if weights not in ("one", "copies"):
        raise ValueError(f"weights: one or copies, not {weights}")
    weighted = weights == "copies"
    rows = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0))
    rows = rows.select(F.col(id).cast("bigint").alias("vec_id"), whole_numbers(F.col(vector)).alias("x"))
    digest = F.unhex(F.sha2(F.array_join(F.transform("x", lambda c: c.cast("string")), ","), 256))
    keyed = settled(rows.select("vec_id", digest.alias("key"), "x"), "whitening-rows")
    distinct = keyed.groupBy("key", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("x"))
    distinct = settled(distinct, "whitening-distinct")

    fits = {d: Fit(n, s) for d, (n, s) in _sums(distinct, "x", weighted).items()}
    weight = {d: f.n for d, f in fits.items()}
    for d, covariance in _covariance(distinct, "x", weighted, lambda d, x: fits[d].centred(x), weight).items():
        fits[d].solve(covariance, components)
    done = settled(_projected(distinct, fits), "whitening-vectors")
    varied = done.where(F.size("z") > 0)
    means = {d: np.array(s) / n for d, (n, s) in _sums(varied, "z", weighted).items()}
    errors = {d: float(np.abs(c - np.eye(len(c))).max()) for d, c in _covariance(varied, "z", weighted, lambda d, z: z - means[d], weight).items()}

    schema = "d int, n long, explained array<double>, identity_error double"
    known = keyed.sparkSession.createDataFrame([(d, f.n, f.explained, errors.get(d)) for d, f in fits.items()], schema)
    found = joined_back(keyed.select("vec_id", "key"), done, "key", "copies").join(F.broadcast(known), "d")
    found = found.select("vec_id", "n", "deviation", "z", "identity_error", F.posexplode("explained").alias("i", "explained"))
    whole = (F.col("i") + 1).alias("component")
    return found.select("vec_id", whole, "n", "deviation", F.get("z", F.col("i")).alias("whitened"), "explained", "identity_error")
