"""Embedding whitening by shifted CholeskyQR.

Entries become integers, floor(256 c). The fit list is each distinct integer
vector once; its size and the sums of its dimensions are exact. With the
centred fit list as a tall matrix A, every pass over it multiplies rows by
their transposes per task, adds these small matrices up by row in Spark, and
takes the Cholesky factor in the driver:

* the first pass factors A'A plus a shift, which keeps the factor from breaking
  down when A is ill-conditioned or lacks rank;
* each later pass solves its rows against the factors so far, one triangular
  solve after the other, and factors what is then almost the identity, until it
  is the identity to rounding.

The product of the factors is the R of A = QR; its singular values and right
singular vectors are those of A, so the covariance itself is never decomposed,
and small eigenvalues keep their digits. A last pass measures how far the
covariance of the whitened fit list is from the identity.

What reaches the driver is a few numbers per pair of dimensions. A vector that
a third of all rows share is one row of the fit list after partial aggregation.

Defined cases: rows whose vector is null or holds null or non-finite entries
are dropped. Vectors of different widths are whitened apart, each width with a
fit list of its own. Components without variance (fewer dimensions or distinct
vectors than components, constant vectors) have no rows, so a row whose width
has none is not returned, nor is the empty vector. ``deviation`` is null where it
exceeds 64 bits. Ids may be null and repeat; each row gives its own rows. Of
eigenvalues that tie any orthogonal basis may come out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import load, materialise

COMPONENTS = 4
SCALE = 256
#: A factor is good when its Gram matrix is the identity to this; at most so many passes.
GOOD, PASSES = 1e-12, 6
#: Singular values below this part of the largest are no variance.
LEAST = 1e-12
#: Rows multiplied at once.
ROWS = 8_192

OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with a vector of finite entries."""
    entries = F.col(embedding).cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return vectors.where(entries.isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")).alias("x"),
    )


def _by_width(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, matrix) of an Arrow list column, in slices of bounded size."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        for a in range(0, len(rows), ROWS):
            some = rows[a : a + ROWS]
            yield width, some, flat[starts[some][:, None] + np.arange(width)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums, exact: as 64-bit integers where these hold it, else as Python's."""
    top = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if top < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor, column by column."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _summed(fit: DataFrame, make, kind: str) -> dict[int, np.ndarray]:
    """Per width the sum over all tasks of the matrices that *make(width, x)* gives for slices.

    A task adds up its own slices; rows of these matrices are added in Spark, so
    the driver gets one matrix per width, however many tasks there are.
    """

    def run(tables: Iterator):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for part in tables:
            for width, _, x in _by_width(part.column("x")):
                made = make(width, x)
                if made is not None:
                    held[width] = held[width] + made if width in held else made
        for width, matrix in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(matrix), width, np.int32)),
                    pa.array(np.arange(len(matrix), dtype=np.int32)),
                    pa.array([row.astype(kind).tobytes() for row in matrix], pa.binary()),
                ],
                names=["width", "row", "v"],
            )

    def add(group):
        import pyarrow as pa

        total = sum(np.frombuffer(v, kind) for v in group.column("v").to_pylist())
        return pa.table({
            "width": group.column("width").slice(0, 1), "row": group.column("row").slice(0, 1),
            "v": pa.array([total.tobytes()], pa.binary()),
        })

    schema = "width int, row int, v binary"
    parts = fit.select("x").mapInArrow(run, schema)
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.groupBy("width", "row").applyInArrow(add, schema).collect():
        found.setdefault(r["width"], {})[r["row"]] = np.frombuffer(r["v"], kind)
    return {w: np.array([rows[i] for i in range(len(rows))]) for w, rows in found.items()}


def _totals(width: int, x: np.ndarray) -> np.ndarray:
    """Number of rows, and per dimension the sums of the upper and lower 32 bits."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return np.vstack([np.full(width, len(x)), high.sum(0), low.sum(0)])


class _Fit:
    """What is known of the fit list of one width."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.factors: list[np.ndarray] = []
        self.done = False
        self.trace = 0.0
        self.vectors = np.empty((0, len(sums)))
        self.values = np.empty(0)
        self.error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _deviations(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def factor(self, gram: np.ndarray) -> None:
        """Take the next factor from the Gram matrix of the rows as solved so far."""
        d = len(gram)
        gram = (gram + gram.T) / 2
        unit = np.finfo(float).eps / 2
        if not self.factors:
            self.trace = float(np.trace(gram))
            if self.trace <= 0:
                self.done = True
                return
            # the shift of the first pass; see the sizes in the analysis of shifted CholeskyQR
            shift = 11 * (self.n * d + d * (d + 1)) * unit * self.trace
        elif np.abs(gram - np.eye(d)).max() <= GOOD * d:
            self.done = True
            return
        else:
            shift = 0.0
        while True:
            try:
                lower = np.linalg.cholesky(gram + shift * np.eye(d))
                break
            except np.linalg.LinAlgError:
                # the list lacks rank: directions without rows get a small factor each pass
                shift = max(10 * shift, 10 * d * unit * float(np.trace(gram)))
        self.factors.append(lower.T)

    def decompose(self, components: int) -> None:
        if not self.factors:
            return
        r = self.factors[0]
        for factor in self.factors[1:]:
            r = factor @ r
        _, size, vectors = np.linalg.svd(r)
        held = [i for i in range(min(components, len(size))) if size[i] > LEAST * size[0]]
        # one sign for all rows: the largest entry is positive
        v = vectors[held]
        v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
        self.vectors, self.values = v, size[held] ** 2 / self.n


def fitted(x: DataFrame, components: int = COMPONENTS) -> dict[int, _Fit]:
    """Components, eigenvalues and identity error of the distinct vectors, by width."""
    fit = materialise(x.where(F.size("x") > 0).select("x").distinct(), "fit")
    found = {
        width: _Fit(
            int(rows[0][0]), [(int(h) << 32) + int(low) for h, low in zip(rows[1], rows[2])]
        )
        for width, rows in _summed(fit, _totals, "<i8").items()
    }

    def passed(make) -> dict[int, np.ndarray]:
        return _summed(fit, make, "<f8")

    def gram(width, x):
        state = found[width]
        if state.done:
            return None
        rows = _solved(state.centred(x), state.factors)
        return rows.T @ rows

    for _ in range(PASSES):
        if all(state.done for state in found.values()):
            break
        for width, matrix in passed(gram).items():
            found[width].factor(matrix)
    for state in found.values():
        state.decompose(components)

    def covariance(width, x):
        state = found[width]
        if not len(state.values):
            return None
        rows = state.whitened(x)
        return rows.T @ rows

    for width, matrix in passed(covariance).items():
        found[width].error = float(np.abs(matrix / found[width].n - np.eye(len(matrix))).max())
    return found


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per vector and component, with the columns of ``OUT``."""
    x = integers(vectors, vec_id, embedding)
    # goes along with the function: a few numbers per dimension and component
    fits = fitted(x, components)
    for fit in fits.values():
        fit.factors = []

    def run(tables: Iterator):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for part in tables:
            for width, rows, some in _by_width(part.column("x")):
                fit = fits[width]
                k = len(fit.values)
                if not k:
                    continue
                y = _deviations(some, fit.n, fit.sums)
                if y.dtype == object or int(np.abs(y).max()) ** 2 * width >= 1 << 62:
                    y = y.astype(object)
                off = [v if -1 < v < 1 << 63 else None for v in (y * y).sum(1).tolist()]
                ids = part.column("vec_id").take(pa.array(rows))
                again = pa.array(np.repeat(np.arange(len(rows)), k))
                columns = [
                    ids.take(again), np.tile(np.arange(1, k + 1), len(rows)), np.full(len(rows) * k, fit.n),
                    pa.array(off, pa.int64()).take(again), fit.whitened(some).ravel(),
                    np.tile(fit.values * fit.n / fit.trace, len(rows)), np.full(len(rows) * k, fit.error),
                ]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)],
                    names=names,
                )

    return x.mapInArrow(run, OUT)


def op13_shifted_choleskyqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
