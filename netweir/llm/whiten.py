"""Whitening of embeddings by a block Jacobi-Davidson method on their covariance, which is never formed.

Vectors become whole numbers, are packed into blocks and written once.  All that the solver asks of them is the product of the
covariance with a few columns: each task centres its blocks, multiplies, and gives back one small matrix; these are added in
rounds, so the driver holds a bounded number of them.  A product with m columns is one job.

The solver keeps an orthonormal basis W and V W.  Rayleigh-Ritz on it gives the leading pairs; pairs whose residual is at the
level of double precision are locked, for the others the projected correction equations (I - QQ')(V - eI)(I - QQ') t = -r are
solved by some steps of MINRES, all columns side by side with one product a step, and the basis is extended by the t's.  It
ends when all pairs asked for are locked.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, pieces, tidy

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries in a block, and bytes of blocks in a task.
BLOCK, TASK_BYTES = 1 << 18, 16 << 20
#: Bytes of tasks' results that the driver adds up itself.
DRIVER_BYTES = 32 << 20
#: A residual of so many units of the largest eigenvalue's last place, times the root of the dimension, is double precision.
UNITS = 16
MINRES_STEPS, MOST_ROUNDS = 8, 200


def packed(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def unpacked(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def usable(df: DataFrame, vector: str, dimension: int | None = None) -> DataFrame:
    """The rows whose vector has entries, all of them finite, and, if given, the dimension."""
    v = F.col(vector)
    d = df.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))))
    return d if dimension is None else d.filter(F.size(v) == dimension)


def whole(column: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * c) of a list column, a row for each vector."""
    if column.null_count:
        raise ValueError("vectors must not be null here")
    c = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(c) and np.abs(c).max() >= 2.0**62:
        raise ValueError(f"an entry is too large for whole numbers of {SCALE} parts")
    return c.astype(np.int64).reshape(-1, d)


class Vectors:
    """Vectors of d whole numbers in blocks that lie in the shared folder, their number n and their sums."""

    def __init__(self, df: DataFrame, vector: str, d: int, rows: int):
        self.d, self.n = d, rows
        per = max(1, BLOCK // d)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = whole(b.column(0), d)
                for i in range(0, len(y), per):
                    part = y[i : i + per]
                    small = np.abs(part).max() < 2**31
                    yield pa.RecordBatch.from_arrays([pa.array([packed(part.astype(np.int32) if small else part)], pa.binary())], ["block"])

        bounded(df.sparkSession)
        tasks = pieces(8 * d * rows, TASK_BYTES)
        self.blocks = cut(df.select(vector).mapInArrow(tidy(pack), "block binary").repartition(tasks))
        self.sums = self.total(lambda y: y.sum(0, dtype=np.int64).reshape(1, -1).astype(object), (1, d)).reshape(-1)

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``of(block)`` over all blocks.  Whole numbers come as objects and go by text, so none overflows."""

        def added(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            out = None
            for x in arrays:
                out = x if out is None else out + x
            if out is not None:
                data = ",".join(map(str, out.reshape(-1))).encode() if out.dtype == object else packed(out)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([out.dtype == object])], ["sum", "exact"])

        def read(data: bytes, exact: bool) -> np.ndarray:
            return np.array(list(map(int, data.decode().split(","))), object).reshape(shape) if exact else unpacked(data)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return added(of(unpacked(x).astype(np.int64)) for b in batches for x in b.column(0).to_pylist())

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return added(read(x, e) for b in batches for x, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

        sums = self.blocks.mapInArrow(first, "sum binary, exact boolean")
        parts, each = pieces(8 * self.d * self.n, TASK_BYTES), 8 * shape[0] * shape[1] + 200
        while parts * each > DRIVER_BYTES and parts > 32:
            parts = -(-parts // 32)
            sums = sums.repartition(parts).mapInArrow(again, "sum binary, exact boolean")
        got = [read(r["sum"], r["exact"]) for r in sums.collect()]
        return sum(got[1:], got[0]) if got else np.zeros(shape)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n in doubles, of whole numbers: (n x - S) is exact before it is divided."""
        n, sums = self.n, self.sums
        if max((abs(int(s)) for s in sums), default=0) < 2**62 // 2:
            exact = np.array([int(s) for s in sums], np.int64)
            return lambda y: (n * y - exact) / n if np.abs(y).max(initial=0) < 2**61 // n else (y.astype(object) * n - sums).astype(np.float64) / n
        return lambda y: ((y.astype(object) * n - sums) / n).astype(np.float64)

    def product(self, u: np.ndarray) -> np.ndarray:
        """V u for a few columns u: one job over the blocks."""
        centre, n = self.centred(), self.n
        return self.total(lambda y: (c := centre(y)).T @ (c @ u), u.shape) / n

    def trace(self) -> float:
        centre = self.centred()
        return float(self.total(lambda y: np.array([[np.square(centre(y)).sum()]]), (1, 1))[0, 0]) / self.n

    def covariance(self, project: np.ndarray) -> np.ndarray:
        """The covariance of the projected vectors, whose means are taken off before multiplying."""
        centre, n, k = self.centred(), self.n, project.shape[1]
        mean = self.total(lambda y: (centre(y) @ project).sum(0, keepdims=True), (1, k)) / n
        return self.total(lambda y: (z := centre(y) @ project - mean).T @ z, (k, k)) / n


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns that span what ``new`` has beyond ``against``, twice orthogonalised; what depends on others is left out."""
    q = np.hstack([x for x in against if x.shape[1]] or [np.zeros((len(new), 0))])
    for _ in range(2):
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        new = new - q @ (q.T @ new)
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10]
    return new


def minres(product: Callable[[np.ndarray], np.ndarray], values: np.ndarray, q: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(V - values I)(I - QQ') t = b, column by column, by MINRES; one product a step.

    ``b`` is orthogonal to Q.  Columns that have broken down, being solved, stay as they are.
    """
    off = lambda x: x - q @ (q.T @ x)
    apply = lambda x: off(product(x) - x * values)
    b = off(b)
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v, before = np.where(live, b / np.where(live, beta, 1), 0), np.zeros_like(b)
    x, d, d_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    phi, beta_in = beta.copy(), np.zeros_like(beta)
    cs, sn, cs0, sn0 = -np.ones_like(beta), np.zeros_like(beta), -np.ones_like(beta), np.zeros_like(beta)
    first = True
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = off(p - alpha * v - beta_in * before)
        out = np.linalg.norm(p, axis=0)
        # the rotations of the two steps before act on the new column of the tridiagonal matrix
        if first:
            epsilon, delta_bar = np.zeros_like(beta), np.zeros_like(beta)
            delta, gamma_bar = np.zeros_like(beta), alpha
            first = False
        else:
            epsilon, delta_bar = sn0 * beta_in, -cs0 * beta_in
            delta, gamma_bar = cs * delta_bar + sn * alpha, sn * delta_bar - cs * alpha
        gamma = np.hypot(gamma_bar, out)
        good = live & (gamma > 1e-300)
        safe = np.where(good, gamma, 1)
        cs0, sn0 = cs, sn
        cs, sn = np.where(good, gamma_bar / safe, cs), np.where(good, out / safe, sn)
        step = np.where(good, (v - epsilon * d_before - delta * d) / safe, 0)
        x = x + np.where(good, cs * phi, 0) * step
        phi = np.where(good, sn * phi, phi)
        d_before, d = d, step
        live = good & (out > 1e-14 * beta)
        if not live.any():
            break
        before, v, beta_in = v, np.where(live, p / np.where(live, out, 1), 0), out
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest eigenvalues, falling, and their unit vectors, of a symmetric matrix without negative ones."""
    most = min(most, d)
    w = orthonormal(np.random.default_rng(seed).normal(size=(d, min(d, most + 4))))
    aw = product(w)
    q, aq, top = np.zeros((d, 0)), np.zeros((d, 0)), 0.0
    for _ in range(MOST_ROUNDS):
        want = most - q.shape[1]
        h = w.T @ aw
        values, s = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, u, au = values[order], w @ s[:, order], aw @ s[:, order]
        top = max(top, values[0])
        tolerance = UNITS * np.finfo(float).eps * np.sqrt(d) * top
        r = au - u * values
        r = r - q @ (q.T @ r)
        ready = np.linalg.norm(r[:, :want], axis=0) <= tolerance
        # locked in order: a pair is only as good as those above it are
        lock = int(np.argmin(ready)) if not ready.all() else len(ready)
        q, aq = np.hstack((q, u[:, :lock])), np.hstack((aq, au[:, :lock]))
        if q.shape[1] >= most or q.shape[1] + u.shape[1] - lock == 0:
            break
        u, au, r, values = u[:, lock:], au[:, lock:], r[:, lock:], values[lock:]
        todo = most - q.shape[1]
        if u.shape[1] + q.shape[1] >= d:  # the basis is all there is: V u is made anew, as sums of products have lost digits
            w, aw = u, product(u)
            if ready.size and np.linalg.norm(r[:, :todo], axis=0).max() <= 64 * tolerance:
                q, aq = np.hstack((q, u[:, :todo])), np.hstack((aq, aw[:, :todo]))
                break
            continue
        t = minres(product, values[:todo], np.hstack((q, u[:, :todo])), -r[:, :todo], MINRES_STEPS)
        keep = u.shape[1] if u.shape[1] <= 3 * most else min(u.shape[1], 2 * most)
        t = orthonormal(t, q, u[:, :keep])[:, : d - q.shape[1] - keep]
        w, aw = np.hstack((u[:, :keep], t)), np.hstack((au[:, :keep], product(t)))
    else:
        raise RuntimeError(f"no {most} eigenpairs in {MOST_ROUNDS} rounds")
    h = q.T @ aq
    values, s = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values)
    return values[order], q @ s[:, order]


def whitened(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(id_col, n, deviation, whitened array, explained array, identity_error): a row for each vector that is kept.

    Vectors that are null, empty, or hold null or non-finite entries are left out; so are those whose number of entries is not
    the commonest one (of equally common ones the greatest).  Components are unit eigenvectors of the covariance, by falling
    eigenvalue; those of no variance, as where all vectors are equal or fewer vectors than components, have no whitened value
    and are left out, so the arrays may be empty.  ``deviation`` is exact, null where a long can't hold it.  Null and repeated
    ids are rows like others.  An empty table gives an empty one.  Other columns are not looked at.
    """
    spark = df.sparkSession
    own = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    kind = own.schema["id"].dataType.simpleString()
    sizes = usable(own, "v").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if not sizes:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, n = sizes[0]["d"], sizes[0]["n"]
    rows = usable(own, "v", d)
    vectors = Vectors(rows, "v", d, n)
    trace = vectors.trace()
    values, u = leading(vectors.product, d, most) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    some = values > 1e-12 * trace
    values, u = values[some], u[:, some]
    project = u / np.sqrt(values)
    error = float(np.abs(vectors.covariance(project) - np.eye(len(values))).max(initial=0)) if len(values) else 0.0
    centre, sums, explained = vectors.centred(), vectors.sums, (values / trace).tolist() if trace > 0 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = whole(b.column(1), d)
            z = centre(y) @ project
            k, m = z.shape[1], len(y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * m + 1, k) if k else np.zeros(m + 1, int), pa.int32()), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(m, n)), deviations(y, n, sums), lists, pa.array([explained] * m, pa.list_(pa.float64())), pa.array(np.full(m, error))], ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def deviations(y: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n x - S)^2 for each vector, exact; null beyond a long."""
    most = n * int(np.abs(y).max(initial=0)) + max(abs(int(s)) for s in sums)
    if most * most * y.shape[1] < 2**63:
        z = n * y - np.array([int(s) for s in sums], np.int64)
        return pa.array((z * z).sum(1))
    z = y.astype(object) * n - sums
    return pa.array([s if s < 2**63 else None for s in (z * z).sum(1)], pa.int64())


def components(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    one = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "x")
    w = whitened(df, id_col, vector, most).select(id_col, "n", "deviation", "identity_error", one)
    return w.select(id_col, (F.col("k") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
