"""Whitening of embeddings by shifted CholeskyQR (Fukaya et al., 2020).

1. Kept rows are written once as whole numbers. One pass sums them exactly; centred rows are (n x - S) / n, from exact integers, so no large
   offset meets a product.
2. A Gram pass adds up Q'Q over all rows, Q being the centred rows solved through the triangles found so far. The Cholesky factor of the Gram matrix,
   shifted by a few rounding errors in the first pass and where it is not definite, is the next triangle. Passes go on until Q is orthogonal.
3. The triangles multiply to R, with R'R = n V. The singular value decomposition of R gives components and eigenvalues e = s^2 / n
   without squaring the condition number.
4. One more pass measures the covariance of whitened rows; the last writes them.

Every pass reads the stored rows once, batch by batch. A task gives one matrix of d x d numbers; matrices are added by groups of FAN_IN until one
group is left for the driver, so what a task or the driver holds is bounded by d, not by rows or tasks.

Edges: vectors that are null or hold null, NaN or infinite entries, and only those, take no part; missing entries of shorter vectors count as 0; a null id is
an id; repeated rows count each; eigenvalues up to 1e-12 of the largest are rank defects and give no component, so equal rows, one row or
an empty table give no result rows; 64-fold entries beyond a long are cut to it; a deviation beyond a long is null; extra columns are not
read. The contract's offset of 1000000 cancels in all results (x - S/n, n x - S) and is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import table
from cardwatch.runtime import stored

SCALE = 64
#: matrices added in one task or on the driver, rows of a product, passes at most, and how far from orthogonal is near enough
FAN_IN, ROWS, PASSES, NEAR = 16, 8192, 6, 1e-13
#: an eigenvalue of no more than this share of the largest is a rank defect
DEFECT = 1e-12
#: sums are taken in two limbs of this many bits, so that they are exact
LIMB = 31


def whole_entries(vector: Column) -> Column:
    """floor(64 c) of every entry as long; null where the vector takes no part."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    put = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    return F.when(vector.isNotNull() & ~bad, put)


def matrix(column, width: int):
    """(rows, width) of an Arrow list column; missing entries are 0."""
    import numpy as np

    starts = np.asarray(column.offsets)
    values, sizes = np.asarray(column.values)[starts[0]:starts[-1]], np.diff(starts)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(starts[:-1] - starts[0], sizes)] = values
    return out


def blocks(batches: Iterator, width: int) -> Iterator:
    """(part of a batch, its matrix) with at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, matrix(part.column("x"), width)


def added(rows: DataFrame, one: Callable, width: int, shape: tuple[int, ...], dtype: str):
    """Sum over all rows of one(matrix of a block), an array of ``shape``."""
    import numpy as np
    from pyspark import TaskContext

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(shape, dtype)
        for _, x in blocks(batches, width):
            total += one(x)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sum"])

    def again(batches):
        import numpy as np
        import pyarrow as pa

        group, total = None, np.zeros(shape, dtype)
        for batch in batches:
            for task, sum_ in zip(batch.column("task").to_pylist(), batch.column("sum").to_pylist(), strict=True):
                if group is not None and task // FAN_IN != group:
                    yield pa.record_batch([pa.array([group], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sum"])
                    total = np.zeros(shape, dtype)
                group = task // FAN_IN
                total += np.frombuffer(sum_, dtype).reshape(shape)
        if group is not None:
            yield pa.record_batch([pa.array([group], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sum"])

    parts = stored(rows.select("x").mapInArrow(partial, "task long, sum binary"), "whitening-sums")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        groups = -(-tasks // FAN_IN)
        dealt = parts.repartition(groups, F.expr(f"task div {FAN_IN}")).sortWithinPartitions("task")
        parts, tasks = stored(dealt.mapInArrow(again, "task long, sum binary"), "whitening-sums"), groups
    total = np.zeros(shape, dtype)
    for row in parts.orderBy("task").collect():
        total += np.frombuffer(row["sum"], dtype).reshape(shape)
    return total


def deviations(x, n: int, sums: list[int]):
    """n x - S, exact: as long where that is wide enough, else as Python integers."""
    import numpy as np

    top = max(map(abs, sums), default=0)
    if len(x) and n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + top >= 1 << 62:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def solved(x, triangle):
    """x R^-1 for an upper triangle R, column by column."""
    import numpy as np

    q = np.empty_like(x)
    for j in range(x.shape[1]):
        q[:, j] = (x[:, j] - q[:, :j] @ triangle[:j, j]) / triangle[j, j]
    return q


class Whitening:
    """What the passes over the rows x (array of long) find: n, sums, components (d, k), eigenvalues, trace, identity_error."""

    def __init__(self, rows: DataFrame, *, most: int = 32):
        import numpy as np

        self.n, self.width = (v or 0 for v in rows.agg(F.count("*"), F.max(F.size("x"))).first())
        n, width = self.n, self.width
        self.sums, self.components, self.eigenvalues, self.trace, self.identity_error = [], np.zeros((width, 0)), np.zeros(0), 0.0, 0.0
        if not n or not width:
            return
        low = (1 << LIMB) - 1
        limbs = added(rows, lambda x: np.array([(x >> LIMB).sum(axis=0), (x & low).sum(axis=0)]), width, (2, width), "int64")
        self.sums = [(int(a) << LIMB) + int(b) for a, b in limbs.T]
        factor = self.factored(rows)
        if factor is None:
            return
        _, found, turned = np.linalg.svd(factor)
        eigenvalues = found ** 2 / n
        kept = eigenvalues > DEFECT * eigenvalues[0]
        eigenvalues, components = eigenvalues[kept][:most], turned[kept][:most].T
        side = np.sign(components[np.argmax(np.abs(components), axis=0), np.arange(components.shape[1])])
        self.eigenvalues, self.components = eigenvalues, components * side
        self.identity_error = self.measured(rows)

    def centred(self) -> Callable:
        n, sums = self.n, self.sums
        return lambda x: deviations(x, n, sums).astype(float) / n

    def factored(self, rows: DataFrame):
        """The upper triangle R of the centred rows; None if all rows are equal."""
        import numpy as np

        width, triangles, centred = self.width, [], self.centred()
        size = np.finfo(float).eps * (self.n * width + width * (width + 1))
        for step in range(PASSES):
            def gram(x, triangles=tuple(triangles)):
                q = centred(x)
                for triangle in triangles:
                    q = solved(q, triangle)
                return q.T @ q

            total = added(rows, gram, width, (width, width), "float64")
            if step == 0:
                self.trace = float(np.trace(total)) / self.n
            elif np.abs(total - np.eye(width)).max() <= NEAR * width:
                break
            if not total.any():
                return None
            norm = np.linalg.norm(total, 2)
            shift = 11 * size * norm if step == 0 else 0.0
            while True:
                try:
                    triangles.append(np.linalg.cholesky(total + shift * np.eye(width)).T)
                    break
                except np.linalg.LinAlgError:  # not definite to rounding: rows do not span all dimensions
                    shift = max(10 * shift, np.finfo(float).eps * width * norm)
        factor = np.eye(width)
        for triangle in triangles:
            factor = triangle @ factor
        return factor

    def projection(self):
        import numpy as np

        return self.components / np.sqrt(self.eigenvalues)

    def measured(self, rows: DataFrame) -> float:
        """Largest entry of whitened rows' covariance minus the identity; their mean is found beside the products and is all but 0."""
        import numpy as np

        centred, projection, k = self.centred(), self.projection(), len(self.eigenvalues)

        def moments(x):
            w = centred(x) @ projection
            return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

        total = added(rows, moments, self.width, (k + 1, k), "float64") / self.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component; rows hold vec_id and x."""
    n, sums, width, k = model.n, model.sums, model.width, len(model.eigenvalues)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    projection, explained, error = model.projection(), model.eigenvalues / model.trace, model.identity_error

    def project(batches):
        import numpy as np
        import pyarrow as pa

        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for part, x in blocks(batches, width):
            apart = deviations(x, n, sums)
            if apart.dtype == object or int(np.abs(apart).max(initial=0)) ** 2 * width >= 1 << 63:
                squares = [s if s < 1 << 63 else None for s in (apart.astype(object) ** 2).sum(axis=1)]
            else:
                squares = (apart ** 2).sum(axis=1)
            rows_of = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch([
                part.column("vec_id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n, np.int64)), pa.array(squares, pa.int64()).take(pa.array(rows_of)),
                pa.array((apart.astype(float) / n @ projection).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ], names)

    return rows.select("vec_id", "x").mapInArrow(project, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on the 32 strongest components of their own covariance, scaled to unit variance."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole_entries(F.col("embedding")).alias("x")).where(F.col("x").isNotNull())
    rows = stored(rows, "whitening-rows")
    return whitened(rows, Whitening(rows))
