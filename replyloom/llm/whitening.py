"""Whitening of embeddings by their leading principal components.

The covariance is summed over all vectors in tasks; only the d x d matrix comes to the driver. There its leading
eigenvalues are found interval by interval: a quadrature of shifted solves along a circle around an interval filters
a small subspace, Rayleigh-Ritz takes the eigenpairs out of it, and the inertia of the shifted matrix at both ends of the
interval says how many there must be. All rows are then projected where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
#: Entries of this size and more have no exact integer; vectors that hold one take no part.
LARGEST = float(1 << 52)


# --- eigenpairs of a symmetric matrix --------------------------------------------------------------


def eigenvalues_above(matrix: np.ndarray, shift: float, block: int = 48) -> int:
    """How many eigenvalues are larger than ``shift``: positive pivots of a symmetric elimination.

    Inertia does not change under congruence, so the matrix is eliminated block by block; a pivot that
    vanishes is moved by a rounding error.
    """
    work = matrix - shift * np.eye(len(matrix))
    smallest = np.finfo(float).eps * max(np.abs(matrix).max(), abs(shift), np.finfo(float).tiny)
    positive = 0
    for start in range(0, len(work), block):
        stop = min(start + block, len(work))
        for k in range(start, stop):
            pivot = work[k, k]
            if abs(pivot) < smallest:
                pivot = work[k, k] = -smallest
            positive += pivot > 0
            column = work[k + 1:, k].copy()
            # within the block at once, beyond it when the block is through
            inside = stop - k - 1
            work[k + 1:, k + 1:stop] -= np.outer(column, column[:inside] / pivot)
            work[k + 1:, k] = column
        if stop < len(work):
            lower = work[stop:, start:stop]
            work[stop:, stop:] -= (lower / np.diag(work)[start:stop]) @ lower.T
    return int(positive)


def place_of(matrix: np.ndarray, rank: int, low: float, high: float, tolerance: float) -> tuple[float, float]:
    """Bounds of the eigenvalue with ``rank`` (1: the largest) between ``low`` and ``high``, by bisection."""
    while high - low > tolerance * abs(high):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if eigenvalues_above(matrix, middle) >= rank:
            low = middle
        else:
            high = middle
    return low, high


def intervals(matrix: np.ndarray, count: int) -> list[tuple[float, float, int]]:
    """Intervals, from the top, that hold the ``count`` largest positive eigenvalues, and how many each holds.

    Ends lie in gaps of the spectrum, and no interval reaches over more than a factor of eight, so that its
    circle tells apart what lies inside. Eigenvalues within rounding of zero are left out.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    floor = top * len(matrix) * np.finfo(float).eps * 8
    positive = eigenvalues_above(matrix, floor)
    wanted = min(count, positive)
    found: list[tuple[float, float, int]] = []
    taken, high = 0, top
    while taken < wanted:
        first = place_of(matrix, taken + 1, floor, high, 1e-3)[1]
        lowest = max(floor, first / 8)
        if eigenvalues_above(matrix, lowest) > wanted:
            lowest = place_of(matrix, wanted, floor, high, 1e-9)[0]
        low, inside = widest_gap(matrix, lowest, floor, high)
        found.append((low, high, inside - taken))
        taken, high = inside, low
    return found


def widest_gap(matrix: np.ndarray, lowest: float, floor: float, high: float, tries: int = 6) -> tuple[float, int]:
    """An end at or below ``lowest`` in a wide gap between neighbouring eigenvalues, and how many lie above it."""
    best = None
    upper = lowest
    for _ in range(tries):
        inside = eigenvalues_above(matrix, upper)
        if inside == len(matrix):
            below = floor
        else:
            below = place_of(matrix, inside + 1, min(floor, -high), upper, 1e-9)[1]
        below = max(below, floor)
        above = place_of(matrix, inside, below, high, 1e-9)[0]
        gap = (above - below) / abs(above)
        if best is None or gap > best[0]:
            best = (gap, (above + below) / 2, inside)
        if gap > 1e-2 or below <= floor:
            break
        upper = below * (1 - 1e-8)
        if upper <= floor:
            break
    return best[1], best[2]


def in_interval(matrix: np.ndarray, low: float, high: float, inside: int, nodes: int = 16, rounds: int = 40):
    """Eigenvalues between ``low`` and ``high``, of which there are ``inside``, and their vectors, by contour integration."""
    size = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, weight = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (1 - x)
    places = centre + radius * np.exp(1j * angle)
    weights = weight / 2 * radius * np.exp(1j * angle)
    shifted = [z * np.eye(size) - matrix for z in places]
    scale = np.abs(matrix).sum(axis=1).max()
    width = min(size, inside + max(4, inside // 2))
    source = np.random.default_rng(0)
    subspace = source.standard_normal((size, width))
    before = np.inf
    for _ in range(rounds):
        if subspace.shape[1] < size:
            filtered = sum((w * np.linalg.solve(a, subspace)).real for w, a in zip(weights, shifted))
        else:
            filtered = subspace
        basis, triangle = np.linalg.qr(filtered)
        strength = np.abs(np.diag(triangle))
        basis = basis[:, strength > strength.max() * 1e-15]
        values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ turned
        held = (values > low) & (values < high)
        worst = np.linalg.norm(matrix @ vectors[:, held] - vectors[:, held] * values[held], axis=0).max(initial=0.0)
        if held.sum() == inside and (worst <= 4e-15 * scale or worst <= 1e-12 * scale and worst > before / 4):
            return values[held], vectors[:, held]
        if held.sum() != inside and worst > before / 4:
            # the subspace has stopped to improve and still misses some: widen it
            width = min(size, width * 2)
        before = worst
        missing = width - vectors.shape[1]
        subspace = np.hstack([vectors, source.standard_normal((size, missing))]) if missing > 0 else vectors
    raise RuntimeError(f"{inside} eigenvalues lie between {low} and {high}, but not all were found")


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest positive eigenvalues, falling, and unit eigenvectors as columns; fewer at lower rank."""
    if not len(matrix) or not np.abs(matrix).max() > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    parts = [in_interval(matrix, low, high, inside) for low, high, inside in intervals(matrix, count)]
    basis = np.linalg.qr(np.hstack([v for _, v in parts]))[0]
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(values)[::-1][:count]
    return values[order], (basis @ turned)[:, order]


# --- sums over all vectors ---------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector")
    )
    fine = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False)))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    return rows


def matrix_of(batch) -> np.ndarray:
    """The vectors of a batch as integers, a row each."""
    column = batch["vector"]
    flat = column.flatten().to_numpy(zero_copy_only=False)
    values = np.floor(flat * 1024.0)
    return values.astype(np.int64).reshape(batch.num_rows, -1) + 100_000


def sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches):
        import decimal

        import pyarrow as pa

        n, total = 0, [0] * size
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch)
                n += len(x)
                if int(np.abs(x).max()) * len(x) >= 1 << 62:
                    x = x.astype(object)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        if n:
            with decimal.localcontext(prec=38):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
                     pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0))],
                    names=["place", "n", "total"],
                )

    found = (
        rows.mapInArrow(run, "place int, n long, total decimal(38,0)")
        .groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    )
    by_place = {r["place"]: r for r in found}
    return (by_place[0]["n"], [int(by_place[i]["total"]) for i in range(size)]) if found else (0, [])


def gram(rows: DataFrame, width: int, make: Callable) -> np.ndarray:
    """Sum over all rows of the outer product of what ``make`` gives for a batch, a row of ``width`` each.

    Each task gives a matrix, row by row; rows are summed as they stream by, each in one task.
    """

    def multiply(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        seen = False
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total += part.T @ part
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["place", "line"]
            )

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, line in zip(batch["place"].to_pylist(), batch["line"].to_pylist()):
                line = np.frombuffer(line)
                sums[place] = sums[place] + line if place in sums else line
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["place", "line"]
        )

    schema = "place int, line binary"
    out = np.zeros((width, width))
    for row in rows.mapInArrow(multiply, schema).repartition("place").mapInArrow(add, schema).collect():
        out[row["place"]] = np.frombuffer(row["line"])
    return (out + out.T) / 2


# --- the operator --------------------------------------------------------------------------------------


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    An entry c becomes x = floor(1024 c) + 100000. Covariances are those of all vectors that take part, divided
    by their number ``n``. Components are unit eigenvectors of the covariance V of the x, numbered from 1 by
    falling eigenvalue e; ``whitened`` is the centred vector projected on the component, over the root of e;
    ``explained`` is e / trace(V). With S the sums of the x, ``deviation`` is the exact sum of (n x - S)^2, null
    where 64 bits don't hold it. ``identity_error`` is the largest entry, without sign, of the covariance
    of ``whitened`` minus the identity.

    Null and empty vectors and those that hold a null, a non-finite entry or one of 2^52 and more take no part; neither do
    vectors of another length than most have (of equally frequent lengths, the larger counts). Null ids and
    repeated rows are kept, each row counts. Of equal eigenvalues any basis is taken. Components without variance are
    left out, so one vector alone, equal vectors, and an empty table give no row. Other columns are left out,
    whatever their names. Jobs run while the plan is built; the driver holds matrices of d x d only.
    """
    rows = usable(vectors)
    common = (
        rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("size")).first()
    )
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], WHITENED)
    size = common["size"]
    rows = rows.filter(F.size("vector") == size)
    n, total = sums(rows, size)
    mean = np.array([t / n for t in total])
    covariance = gram(rows, size, lambda batch: matrix_of(batch) - mean) / n
    values, basis = leading_components(covariance, components)
    found = len(values)
    if not found:
        return spark.createDataFrame([], WHITENED)
    project = basis / np.sqrt(values)
    explained = values / np.trace(covariance)

    def augmented(batch):
        whitened = (matrix_of(batch) - mean) @ project
        return np.hstack([np.ones((len(whitened), 1)), whitened])

    moments = gram(rows, found + 1, augmented) / n
    spread = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])
    error = float(np.abs(spread - np.eye(found)).max())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch)
            whitened = (x - mean) @ project
            far = [exact_deviation(row, n, total) for row in x] if not fits(x, n, total) else (
                ((x * n - np.array(total, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            )
            rows_, times = len(x), np.arange(len(x)).repeat(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows_)),
                    pa.array(np.full(rows_ * found, n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(times)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, rows_)),
                    pa.array(np.full(rows_ * found, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, WHITENED)


def fits(x: np.ndarray, n: int, total: list[int]) -> bool:
    """Whether deviations and all that leads to them surely stay below 2^63."""
    largest = max(int(x.max()), -int(x.min()))
    if largest * n >= 1 << 62 or max(map(abs, total)) >= 1 << 62:
        return False
    away = np.abs(x * n - np.array(total, dtype=np.int64)).max()
    return int(away) ** 2 * x.shape[1] < 1 << 63


def exact_deviation(row: np.ndarray, n: int, total: list[int]) -> int | None:
    found = sum((n * x - t) ** 2 for x, t in zip(row.tolist(), total))
    return found if found < 1 << 63 else None
