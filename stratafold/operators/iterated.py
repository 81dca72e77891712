"""Large positive definite systems of covariances, solved to rounding by conjugate gradients over the executors.

No matrix is kept: each turn computes every covariance again in tiles, a task for some blocks of rows, and all columns share
them. The preconditioner factors the inverse with a few nearest earlier points of each, from a coarse to a fine order, so a
dozen turns or so are enough. The system is that of all points; only the number of turns depends on the neighbours taken.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from stratafold.model import Variogram

#: Earlier points of each in the preconditioner, nearest points of a target's first guess.
NEAREST, GUESS = 60, 400
#: Rows and columns of a tile of covariances, rows of a block, tasks of a turn, columns up to which each covariance is computed once for both of its rows.
TILE, BLOCK, TASKS, NARROW = (64, 1024), 2048, 24, 8
#: Bytes of the columns that are solved at once.
WIDE = 64 << 20
#: Turns at most, turns without gain that end them, the residual aimed at and the largest one accepted, of the largest number on the right; share of the top that is left to a target's variance.
TURNS, STILL, AIM, ACCEPTED, LEFT = 80, 10, 1e-12, 1e-6, 1e-7


def tile(model: Variogram | None, top: float, values: Callable, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """top - curve(gap) of two tables of places; without a model the curve is the gap."""
    h = a[:, None, 0] - b[None, :, 0]
    h *= h
    for i in range(1, a.shape[1]):
        g = a[:, None, i] - b[None, :, i]
        g *= g
        h += g
    np.sqrt(h, out=h)
    if model is None:
        return np.subtract(top, h, out=h)
    if model.kind not in ("exponential", "spherical", "linear"):
        return np.subtract(top, values(model, h))
    own = h == 0 if model.nugget and not h.all() else None
    rest = top - model.nugget
    if model.kind == "exponential":
        h *= -1 / model.range
        np.exp(h, out=h)
        h *= model.sill
        h += rest - model.sill
    elif model.kind == "linear":
        h *= -model.sill
        h += rest
    else:
        h *= 1 / model.range
        np.minimum(h, 1, out=h)
        g = h * h
        g -= 3
        g *= h
        g *= 0.5 * model.sill
        h = np.add(g, rest, out=g)
    if own is not None:
        h[own] = top
    return h


class Kernel:
    """Covariances of a table of places, in tiles."""

    def __init__(self, model: Variogram | None, top: float, values: Callable) -> None:
        self.model, self.top, self.values = model, top, values

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tile(self.model, self.top, self.values, a, b)

    def times(self, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Covariances of a and b times columns v of b."""
        out = np.zeros((len(a), v.shape[1]))
        for i in range(0, len(a), TILE[0]):
            for j in range(0, len(b), TILE[1]):
                out[i : i + TILE[0]] += self(a[i : i + TILE[0]], b[j : j + TILE[1]]) @ v[j : j + TILE[1]]
        return out


def ordered(places: np.ndarray, seed: int = 0) -> np.ndarray:
    """Points from coarse to fine: in each turn one of each cell that has none yet, cells halved from turn to turn."""
    rng = np.random.default_rng(seed)
    low, span = places.min(0), float(np.ptp(places, axis=0).max()) or 1.0
    left, done = rng.permutation(len(places)), np.zeros(0, np.int64)
    for level in range(24):
        cell = ((places - low) * (2.0**level / (span * (1 + 1e-9)))).astype(np.int64)
        key = cell[:, 0]
        for i in range(1, places.shape[1]):
            key = np.unique(key, return_inverse=True)[1] * (1 << 25) + cell[:, i]
        free = left[~np.isin(key[left], key[done])]
        new = rng.permutation(free[np.unique(key[free], return_index=True)[1]])
        done, left = np.concatenate([done, new]), left[~np.isin(left, new)]
        if not len(left):
            break
    return np.concatenate([done, left])


def _earlier(places: np.ndarray, start: int, end: int, k: int) -> np.ndarray:
    """The k nearest of the points before each of a slice of them, all of which have k earlier ones."""
    out = np.empty((end - start, k), np.int64)
    for i in range(start, end, 8):
        own = np.arange(i, min(i + 8, end))
        far = sum((places[own, None, c] - places[None, : own[-1], c]) ** 2 for c in range(places.shape[1]))
        far[own[:, None] <= np.arange(own[-1])] = np.inf
        # as many of every sixteenth point bound the distance of the nearest ones
        some = far[:, ::16]
        bound = np.partition(some, k - 1, axis=1)[:, k - 1] if some.shape[1] > k else np.full(len(own), np.inf)
        for r in range(len(own)):
            near = np.flatnonzero(far[r] <= bound[r])
            out[i - start + r] = near[np.argpartition(far[r, near], k - 1)[:k]]
    return out


def _conditioned(kernel: Kernel, places: np.ndarray, added: float, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest earlier points of each of a slice, their weights and what is left of the variance; NaN where the system is not positive definite."""
    index, weights, rest = np.zeros((end - start, NEAREST), np.int32), np.zeros((end - start, NEAREST)), np.full(end - start, kernel.top + added)
    first = max(start, NEAREST)
    sets = [(np.array([i]), np.arange(i)[None]) for i in range(max(start, 1), min(end, NEAREST))]
    if first < end:
        near = _earlier(places, first, end, NEAREST)
        sets += [(np.arange(i, min(i + 512, end)), near[i - first : i - first + 512]) for i in range(first, end, 512)]
    for own, near in sets:
        k = near.shape[1]
        at = np.concatenate([places[near], places[own][:, None]], axis=1)
        cov = np.stack([kernel(x, x) for x in at])
        cov[:, np.arange(k), np.arange(k)] += added
        try:
            w = np.linalg.solve(cov[:, :k, :k], cov[:, :k, k:])[:, :, 0]
            left = kernel.top + added - (w * cov[:, :k, k]).sum(1)
        except np.linalg.LinAlgError:
            w, left = np.zeros(near.shape), np.full(len(own), np.nan)
        index[own - start, :k], weights[own - start, :k], rest[own - start] = near, w, left
    return index, weights, rest


class System:
    """Covariances of all points plus ``added`` on the diagonal. Raises LinAlgError where that is seen not to be positive definite."""

    def __init__(self, spark: SparkSession, places: np.ndarray, kernel: Kernel, added: float) -> None:
        self.spark, self.kernel, self.added, self.n = spark, kernel, added, len(places)
        self.order = ordered(places)
        self.places = places[self.order]
        self.shared = spark.sparkContext.broadcast(self.places)
        shared, n = self.shared, self.n
        # later points look at more earlier ones
        edges = np.unique(np.round(n * np.sqrt(np.linspace(0, 1, 2 * TASKS + 1))).astype(int))

        def part(k: int) -> list[np.ndarray]:
            return list(_conditioned(kernel, shared.value, added, int(edges[k]), int(edges[k + 1])))

        found = self._run(part, len(edges) - 1, (np.int32, np.float64, np.float64))
        self.index, self.weights, self.rest = (np.concatenate([found[k][c] for k in range(len(edges) - 1)]) for c in range(3))
        self.index, self.weights = self.index.reshape(n, NEAREST), self.weights.reshape(n, NEAREST)
        if not (self.rest > 0).all():
            self.close()
            raise np.linalg.LinAlgError("not positive definite")

    def close(self) -> None:
        self.shared.unpersist()

    def _run(self, part: Callable[[int], list[np.ndarray]], tasks: int, kinds) -> dict[int, list[np.ndarray]]:
        """The arrays of each task, flat."""

        def rows(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in part(k))], ["k", *(f"c{i}" for i in range(len(kinds)))])

        schema = "k long" + "".join(f", c{i} binary" for i in range(len(kinds)))
        table = self.spark.range(0, tasks, 1, tasks).mapInArrow(rows, schema).toArrow()
        return {k: [np.frombuffer(table.column(1 + c)[r].as_buffer(), t) for c, t in enumerate(kinds)] for r, k in enumerate(table.column("k").to_pylist())}

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix times columns."""
        n, kernel, shared = self.n, self.kernel, self.shared
        sent = self.spark.sparkContext.broadcast(v)
        width, blocks = v.shape[1], -(-n // BLOCK)
        tasks = min(TASKS, blocks)

        def wide(k: int) -> list[np.ndarray]:
            at = slice(n * k // tasks, n * (k + 1) // tasks)
            return [kernel.times(shared.value[at], shared.value, sent.value)]

        def narrow(k: int) -> list[np.ndarray]:
            p, v, out = shared.value, sent.value, np.zeros((n, width))
            for i in range(k, blocks, tasks):
                # each two blocks meet once: a block with itself and with the following half of the ring
                for step in range(blocks // 2 + 1):
                    if 2 * step == blocks and i >= step:
                        continue
                    j = (i + step) % blocks
                    for r in range(i * BLOCK, min((i + 1) * BLOCK, n), TILE[0]):
                        row = slice(r, min(r + TILE[0], (i + 1) * BLOCK, n))
                        for c in range(j * BLOCK, min((j + 1) * BLOCK, n), TILE[1]):
                            col = slice(c, min(c + TILE[1], (j + 1) * BLOCK, n))
                            t = kernel(p[row], p[col])
                            out[row] += t @ v[col]
                            if step:
                                out[col] += t.T @ v[row]
            return [out]

        found = self._run(narrow if width <= NARROW else wide, tasks, (np.float64,))
        parts = [found[k][0].reshape(-1, width) for k in range(tasks)]
        sent.destroy()
        return (sum(parts) if width <= NARROW else np.concatenate(parts)) + self.added * v

    def nearly(self, v: np.ndarray) -> np.ndarray:
        """The preconditioner times columns."""
        out, flat = np.empty_like(v), self.index.ravel()
        for c in range(v.shape[1]):
            u = (v[:, c] - np.einsum("ij,ij->i", self.weights, v[:, c][self.index])) / self.rest
            out[:, c] = u - np.bincount(flat, weights=(self.weights * u[:, None]).ravel(), minlength=self.n)
        return out

    def solve(self, right: np.ndarray) -> np.ndarray:
        """Columns of the solution, in the order of the points given. Raises LinAlgError where the residual does not get small."""
        b = right[self.order]
        scale = np.abs(b).max(0) + 1e-300
        x, r = np.zeros_like(b), b.copy()
        z = self.nearly(r)
        p, rz = z.copy(), (r * z).sum(0)
        best, kept, still = np.ones(len(scale)), x.copy(), 0
        for _ in range(TURNS):
            a = self.times(p)
            bent = (p * a).sum(0)
            if (bent[rz > 0] <= 0).any():
                raise np.linalg.LinAlgError("not positive definite")
            step = np.divide(rz, bent, out=np.zeros_like(rz), where=bent > 0)
            x += step * p
            r -= step * a
            now = np.abs(r).max(0) / scale
            better = now < best
            kept[:, better], best, still = x[:, better], np.minimum(now, best), 0 if better.any() else still + 1
            if (best <= AIM).all() or still >= STILL:
                break
            z = self.nearly(r)
            new = (r * z).sum(0)
            p = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p
            rz = new
        # what was carried along and what is left of the right side differ by rounding
        if not (np.abs(b - self.times(kept)).max(0) <= ACCEPTED * scale).all():
            raise np.linalg.LinAlgError("no solution")
        out = np.empty_like(kept)
        out[self.order] = kept
        return out

    def squares(self, targets: np.ndarray) -> np.ndarray:
        """k' A⁻¹ k of the covariances k of each target. Each begins with its nearest points; the error is that of the solution squared."""
        out, wide = np.zeros(len(targets)), max(1, WIDE // (8 * self.n))
        for i in range(0, len(targets), wide):
            out[i : i + wide] = self._squares(targets[i : i + wide])
        return out

    def _squares(self, targets: np.ndarray) -> np.ndarray:
        kernel, n, added, shared = self.kernel, self.n, self.added, self.shared
        tasks = min(TASKS, len(targets))

        def begun(k: int) -> list[np.ndarray]:
            places, rests, totals = shared.value, [], []
            for t in targets[k::tasks]:
                gap = ((places - t) ** 2).sum(1)
                near = np.array([gap.argmin()]) if not gap.all() else np.argpartition(gap, GUESS)[:GUESS] if n > GUESS else np.arange(n)
                x = np.linalg.solve(kernel(places[near], places[near]) + added * np.eye(len(near)), kernel(places[near], t[None]))
                covered = kernel.times(places, t[None], np.ones((1, 1)))[:, 0]
                rest = covered - kernel.times(places, places[near], x)[:, 0]
                rest[near] -= added * x[:, 0]
                rests.append(rest)
                totals.append(x[:, 0] @ (covered[near] + rest[near]))
            return [np.stack(rests), np.array(totals)]

        r, total = np.empty((n, len(targets))), np.zeros(len(targets))
        for k, (rests, totals) in self._run(begun, tasks, (np.float64, np.float64)).items():
            r[:, k::tasks], total[k::tasks] = rests.reshape(-1, n).T, totals
        p = self.nearly(r)
        rz, at = (r * p).sum(0), np.arange(len(targets))
        for _ in range(TURNS):
            # what a target has left is about its last term
            own = rz > LEFT * kernel.top
            total[at[~own]] += rz[~own]
            p, r, rz, at = p[:, own], r[:, own], rz[own], at[own]
            if not len(at):
                return total
            a = self.times(p)
            step = rz / (p * a).sum(0)
            if (step <= 0).any():
                raise np.linalg.LinAlgError("not positive definite")
            total[at] += step * rz
            r -= step * a
            a = self.nearly(r)
            new = (r * a).sum(0)
            p *= new / rz
            p += a
            rz = new
        raise np.linalg.LinAlgError("no solution")
