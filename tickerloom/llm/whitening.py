"""Whitening of embeddings by a bidiagonal qd solver.

The fit list is each distinct vector once. Its centred rows are reduced by QR, block by block: a task keeps one
triangle R for all its rows, and the triangles of the tasks are stacked and reduced again until one is left
(``FAN_IN`` at a time, on executors). R has the size of the dimensions squared whatever the rows are. On it
the driver runs Householder bidiagonalisation, finds the singular values to high relative accuracy by the
differential qd algorithm with shifts (dqds), and recovers the right vectors by twisted factorisations of B'B minus
the eigenvalue; vectors of a cluster are made orthogonal. Rows are then projected map-side.

Entries are the longs ``floor(64 * c) + 1000000``. Rows whose vector is null, or holds null or non-finite entries, drop
out, and so do empty ones. If lengths differ, the length of most rows is taken (of equals the larger one) and
the others drop out. Directions without variance (below ``RANK`` times the largest eigenvalue) are no
components: a fit list of one vector, or of none, gives no rows. Equal eigenvalues leave their directions open within
their plane; all rows get the same ones. Repeated rows get a result each. ``deviation`` is exact; one beyond a long is null.
Further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import landed, then_give_back

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows of one QR block, and triangles stacked by one task.
BLOCK, FAN_IN = 4096, 32
#: Share of the largest eigenvalue below which a direction has no variance.
RANK = 1e-12
#: Relative gap below which neighbours form a cluster.
GAP = 1e-3


# ---- the solver: d x d, on the driver ---------------------------------------------

def householder(x):
    """(v, beta, alpha) with (1 - beta v v') x = alpha e1."""
    v = x.astype(float).copy()
    size = np.linalg.norm(v)
    if size == 0:
        return v, 0.0, 0.0
    alpha = -np.copysign(size, v[0])
    v[0] -= alpha
    return v, 2.0 / (v @ v), alpha


def bidiagonalise(r):
    """(diagonal, upper diagonal, V) with U' r V upper bidiagonal."""
    d = r.shape[1]
    a = np.vstack([r, np.zeros((max(0, d - len(r)), d))]).astype(float)
    right = np.eye(d)
    for k in range(d):
        v, beta, alpha = householder(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        a[k, k], a[k + 1:, k] = alpha, 0
        if k < d - 2:
            v, beta, alpha = householder(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ v, v)
            a[k, k + 1], a[k, k + 2:] = alpha, 0
            right[:, k + 1:] -= beta * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(q, e):
    """Squared singular values, falling, of a bidiagonal matrix with squared entries q and e."""
    q, e, found = list(map(float, q)), list(map(float, e)), []
    eps = np.finfo(float).eps
    # parts: blocks of q and e between zeros of e, each with the sum of its shifts
    parts = [(q, e, 0.0)]
    while parts:
        q, e, shift = parts.pop()
        if len(q) == 1:
            found.append(q[0] + shift)
            continue
        cut = [i for i, x in enumerate(e) if x <= eps * eps * (shift + min(q[i], q[i + 1])) or x < 1e-290]
        if cut:
            i = cut[-1]
            parts += [(q[:i + 1], e[:i], shift), (q[i + 1:], e[i + 1:], shift)]
            continue
        if q[-1] > 2 * q[0]:  # graded upwards: qd on the flipped matrix
            q, e = q[::-1], e[::-1]
        # a shift beyond the least eigenvalue makes the transform fail; then a smaller one is tried
        tried, low = 0, _shift(q, e)
        while True:
            s = low if tried < 3 else 0.0
            nq, ne, ok = _dqds_step(q, e, s)
            if ok:
                break
            low, tried = low / 4, tried + 1
            if s == 0.0:
                raise ArithmeticError("the qd transform without a shift cannot fail on finite input")
        shift += s
        small = eps * (shift + nq[-1])
        if ne[-1] <= eps * small or ne[-1] <= eps * eps * shift:
            found.append(nq[-1] + shift)
            nq, ne = nq[:-1], ne[:-1]
        parts.append((nq, ne, shift))
    return np.array(sorted((max(x, 0.0) for x in found), reverse=True))


def _shift(q, e):
    """A shift near the least eigenvalue: the least pivot of a pass without a shift, and the edge once it has converged."""
    d = least = q[0]
    for i in range(len(e)):
        x = d + e[i]
        d = d * (q[i + 1] / x) if x else 0.0
        least = min(least, d)
    edge = q[-1] - (e[-1] * q[-1]) ** 0.5 if e[-1] < q[-1] else 0.0
    return min(least, edge) * (1 - 1e-9) if edge > 0 else least / (4 * len(q))


def _dqds_step(q, e, s):
    d, nq, ne = q[0] - s, [], []
    for i in range(len(e)):
        if d < 0 or d != d:
            return None, None, False
        x = d + e[i]
        nq.append(x)
        t = q[i + 1] / x if x > 0 else 0.0
        ne.append(e[i] * t)
        d = d * t - s
    if d < 0 or d != d:
        return None, None, False
    return nq + [d], ne, True


def twisted(a, b, value):
    """Unit vector z with (B'B - value) z = gamma e_k, at the twist k of least gamma; B has entries a and, above, b."""
    n = len(a)
    diag = a * a
    diag[1:] += b * b
    off = a[:-1] * b
    least = np.finfo(float).eps * diag.max() * 1e-4
    up, lo = np.zeros(n - 1), np.zeros(n - 1)
    # stationary qd down: B'B is its own LDL' with pivots a^2 and multipliers b/a
    s, plus = -value, np.zeros(n)
    for i in range(n):
        plus[i] = a[i] * a[i] + s
        if i < n - 1:
            pivot = plus[i] if abs(plus[i]) > least else np.copysign(least, plus[i] or 1.0)
            up[i] = off[i] / pivot
            s = up[i] * b[i] / a[i] * s - value if a[i] != 0 else diag[i + 1] - off[i] * up[i] - value - a[i + 1] ** 2
    # progressive qd up
    p, minus = np.zeros(n), np.zeros(n)
    p[-1] = a[-1] * a[-1] - value
    for i in range(n - 2, -1, -1):
        minus[i + 1] = b[i] * b[i] + p[i + 1]
        pivot = minus[i + 1] if abs(minus[i + 1]) > least else np.copysign(least, minus[i + 1] or 1.0)
        lo[i] = off[i] / pivot
        p[i] = p[i + 1] * (a[i] * a[i] / pivot) - value
    s = plus - a * a
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -lo[i] * z[i]
    return z / np.linalg.norm(z)


def principal(r, components=COMPONENTS):
    """(squared singular values, their right vectors as columns) of the largest singular values of R."""
    scale = np.abs(r).max(initial=0.0)
    if not scale:
        return np.zeros(0), np.zeros((r.shape[1], 0))
    a, b, right = bidiagonalise(r / scale)
    values = dqds(a * a, b * b)
    values = values[values > RANK * values[0]][:components]
    dense = np.zeros((len(a), len(values)))
    bid = np.diag(a) + np.diag(b, 1)
    start = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > GAP * values[j - 1]:
            start = j
        z = twisted(a, b, value)
        if start < j or (j + 1 < len(values) and value - values[j + 1] <= GAP * value):
            # close neighbours: twisted vectors agree too much; take one out of the others and solve again
            z = _apart(bid, value, dense[:, start:j], z, j)
        dense[:, j] = z
    vectors = right @ dense
    return values * scale * scale, vectors


def _apart(bid, value, others, z, seed):
    """Inverse iteration against the vectors found in the cluster."""
    n = len(z)
    t = bid.T @ bid - value * (1 + 4e-16) * np.eye(n)
    t[np.diag_indices(n)] += np.finfo(float).eps * np.abs(t).max()
    for turn in range(6):
        z = z - others @ (others.T @ z)
        z = z - others @ (others.T @ z)
        if np.linalg.norm(z) < 1e-3:
            z = np.random.default_rng(seed + 97 * turn).standard_normal(n)
            z = z - others @ (others.T @ z)
        z = np.linalg.solve(t, z / np.linalg.norm(z))
        z = z / np.linalg.norm(z)
    z = z - others @ (others.T @ z)
    z = z - others @ (others.T @ z)
    return z / np.linalg.norm(z)


# ---- rows ---------------------------------------------------------------------------

def scaled(vec):
    """The longs of a vector column."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)


def usable(df, vec="embedding"):
    """Rows whose vector has entries, all of them finite, and the length of most rows."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    fine = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad))
    most = fine.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (fine.filter(F.size(vec) == most.d), most.d) if most else (fine, 0)


def _matrix(column):
    """A batch's list column as a matrix."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _centred(x, n, sums):
    """x - S/n: exact integers first, one division."""
    top = np.abs(x - sums // n).max(initial=0)
    if n * (float(top) + 1) < 2.0**62:
        return ((x - sums // n) * n - sums % n) / float(n)
    return (x - sums // n).astype(float) - (sums % n) / float(n)


def _sums(batches):
    n, total = 0, None
    for b in batches:
        m = _matrix(b.column(0))
        if len(m):
            n, total = n + len(m), m.sum(0) if total is None else total + m.sum(0)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64()), pa.array([n] * len(total), pa.int64())], ["dim", "total", "rows"])


def _triangle(blocks, d):
    r = np.zeros((0, d))
    for m in blocks:
        r = np.linalg.qr(np.vstack([r, m]), mode="r")
    return r


def triangle(fit, n, sums):
    """R of the centred fit list (columns: x), by tasks, then by stacks of triangles."""
    d = len(sums)

    def one(batches):
        from pyspark import TaskContext

        r = _triangle((_centred(m[low:low + BLOCK], n, sums) for b in batches for m in [_matrix(b.column(0))] for low in range(0, len(m), BLOCK)), d)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["at", "r"])

    def stack(key, table):
        # in the order of the tasks, so the result is the same however they were scheduled
        rows = sorted(zip(table.column("at").to_pylist(), table.column("r").to_pylist()))
        r = _triangle((np.frombuffer(raw).reshape(-1, d) for _, raw in rows), d)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = landed(fit.select("x").mapInArrow(lambda b: then_give_back(one(b)), "at long, r binary"), "qr")
    tasks = (level.agg(F.max("at")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        level = level.groupBy(F.floor(F.col("at") / FAN_IN).alias("to")).applyInArrow(stack, "at long, r binary")
        tasks = -(-tasks // FAN_IN)
    rows = sorted((x.at, bytes(x.r)) for x in level.collect())  # at most FAN_IN triangles of d x d
    return _triangle((np.frombuffer(raw).reshape(-1, d) for _, raw in rows), d)


def _covariance(fit, n, sums, weights):
    """Covariance of the whitened fit list, summed by Spark from the tasks' blocks."""
    k = weights.shape[1]

    def one(batches):
        total = np.zeros((k, k))
        for b in batches:
            w = _centred(_matrix(b.column(0)), n, sums) @ weights
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel(), pa.float64())], ["at", "total"])

    rows = fit.select("x").mapInArrow(one, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(k * k)
    for r in rows:
        out[r["at"]] = r.total
    return out.reshape(k, k) / n


def fitted(df, vec="embedding", components=COMPONENTS):
    """(usable rows, n, S, weights, explained shares, identity error); weights whiten centred rows."""
    fine, d = usable(df, vec)
    if not d:
        return fine, 0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0
    fit = landed(fine.select(scaled(F.col(vec)).alias("x")).distinct(), "whitening-fit")
    totals = fit.mapInArrow(_sums, "dim int, total long, rows long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect()
    n, sums = totals[0].rows, np.zeros(d, np.int64)
    for r in totals:
        sums[r.dim] = r.total
    r = triangle(fit, n, sums)
    values, vectors = principal(r, components)
    if not len(values):
        return fine, n, sums, np.zeros((d, 0)), np.zeros(0), 0.0
    weights = vectors * np.sqrt(n / values)
    error = float(np.abs(_covariance(fit, n, sums, weights) - np.eye(len(values))).max())
    return fine, n, sums, weights, values / (r * r).sum(), error


def _deviations(x, n, sums):
    """Exact sums of (n x - S)^2; None beyond a long."""
    far = float(np.abs(x - sums // n).max(initial=0)) + 1
    if (n * far) ** 2 * x.shape[1] < 2.0**62:
        y = (x - sums // n) * n - sums % n
        return (y * y).sum(1).tolist()
    s = list(map(int, sums))
    exact = (sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x)
    return [v if v < 2**63 else None for v in exact]


def whiten(df, vec="embedding", key="vec_id", components=COMPONENTS):
    """Per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = df.schema[key].dataType.simpleString()
    fine, n, sums, weights, explained, error = fitted(df, vec, components)
    k = len(explained)
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches):
        for b in batches:
            if not k:
                return
            x = _matrix(b.column(1))
            rows = len(x)
            w = _centred(x, n, sums) @ weights
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()),
                pa.array(_deviations(x, n, sums), pa.int64()).take(at), pa.array(w.ravel(), pa.float64()),
                pa.array(np.tile(explained, rows), pa.float64()), pa.array(np.full(rows * k, error), pa.float64())],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fine.select(F.col(key), scaled(F.col(vec)).alias("x")).mapInArrow(run, schema)
