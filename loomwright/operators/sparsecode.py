"""Sparse dictionary learning on daily profiles: minimise |Y - [X1|X2] B|^2 + lam_b RW(X2) + lam_c |B2|_1.

Rows of a table are the columns of Y. X1 is fixed and its coefficients are free; X2 is learned and its coefficients are
sparse; RW is the squared (L2) or absolute (L1) first difference of X2's columns from zero. The coefficient step is
independent for each row and runs in Arrow batches; the dictionary step needs two sums over all rows, of sizes m2 x m2
and d x m2, and runs on the driver. Every round's coefficients are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import durable


@dataclass(frozen=True)
class Search:
    """Line search and stopping of FISTA."""

    step: float = 1.0
    grow: float = 1.5
    rounds: int = 5
    tries: int = 50
    tolerance: float = 1e-4
    momentum: bool = True


def fista(smooth: Callable, rough: Callable, shrink: Callable, start: np.ndarray, search: Search = Search()) -> np.ndarray:
    """Minimise smooth + rough for each row of start on its own.

    smooth(x) gives values and gradients by row, rough(x) values, shrink(x, L) the proximal step; L holds one step size
    for each row and only grows. A step is taken if it lies below its quadratic bound and the bound below the present
    value; after too many tries the row goes back to its last point. What is returned is the extrapolated point.
    """
    x = prev = y = np.array(start, float)
    n = len(x)
    scale, t, last, live = np.full(n, search.step), 1.0, np.full(n, np.inf), np.ones(n, bool)
    for k in range(search.rounds):
        if not live.any():
            break
        f, g = smooth(y)
        now = f + rough(y)
        open_, new = live.copy(), x.copy()
        for tried in range(search.tries + 1):
            p = shrink(y - g / scale[:, None], scale)
            move = p - y
            fp, hp = smooth(p)[0], rough(p)
            bound = f + (g * move).sum(1) + scale / 2 * (move**2).sum(1) + hp
            good = open_ & (fp + hp <= bound) & (bound < now)
            new[good] = p[good]
            open_ &= ~good
            if not open_.any():
                break
            if tried == search.tries:
                new[open_] = prev[open_]
            else:
                scale[open_] *= search.grow
        x = np.where(live[:, None], new, x)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = x + (1 - t) / after * (prev - x) if search.momentum else x
        y = np.where(live[:, None], ahead, y)
        t, prev = after, np.where(live[:, None], x, prev)
        if k > 1:
            live = live & (np.abs(now - last) > search.tolerance)
        last = now
    return y


def soft(x: np.ndarray, by) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def between(x: np.ndarray, low: np.ndarray, high: np.ndarray, by: float) -> np.ndarray:
    """Least of (z - x)^2 / 2 + by / 2 (|z - low| + |z - high|): free inside [low, high], pulled by ``by`` outside."""
    return np.where(x > high, np.maximum(x - by, high), np.where(x < low, np.minimum(x + by, low), x))


def shrink_walk(x: np.ndarray, by: float, sweeps: int = 3) -> np.ndarray:
    """Proximal step of the absolute random walk: element by element, each against its neighbours as they are now."""
    z = x.copy()
    for _ in range(sweeps):
        before = z.sum()
        for j in range(len(z)):
            left = z[j - 1] if j else np.zeros(z.shape[1])
            if j + 1 < len(z):
                z[j] = between(x[j], np.minimum(left, z[j + 1]), np.maximum(left, z[j + 1]), 2 * by)
            else:
                z[j] = between(x[j], left, left, by)
        if z.sum() == before:
            break
    return z


def walk_matrix(d: int, weight: float) -> np.ndarray:
    """weight times the matrix whose quadratic form is the squared random walk from zero."""
    steps = np.eye(d) - np.eye(d, k=-1)
    return weight * steps.T @ steps


def sylvester(e: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """X with E X + X F = G for symmetric E and F, in their eigenbases."""
    a, u = np.linalg.eigh(e)
    b, v = np.linalg.eigh(f)
    return u @ ((u.T @ g @ v) / (a[:, None] + b)) @ v.T


@dataclass(frozen=True)
class Coder:
    """The dictionary and its weights; penalty: "L2" or "L1"."""

    x1: np.ndarray
    x2: np.ndarray
    lam_b: float = 2.0
    lam_c: float = 2.0
    penalty: str = "L2"
    search: Search = field(default_factory=Search)

    @property
    def x(self) -> np.ndarray:
        return np.hstack([self.x1, self.x2])

    def encode_rows(self, y: np.ndarray, beta: np.ndarray, passes: int = 1) -> np.ndarray:
        """Coefficients (n x m) of rows y (n x d), from beta on."""
        x, m1, lam = self.x, self.x1.shape[1], self.lam_c

        def smooth(b):
            r = b @ x.T - y
            return (r**2).sum(1), 2 * r @ x

        def shrink(b, scale):
            return np.hstack([b[:, :m1], soft(b[:, m1:], (lam / scale)[:, None])])

        # the rows' own problems: residuals belong to rows, so a batch is one call
        for _ in range(passes):
            beta = fista(smooth, lambda b: lam * np.abs(b[:, m1:]).sum(1), shrink, beta, self.search)
        return beta

    def walk(self) -> float:
        steps = np.diff(self.x2, axis=0, prepend=0)
        return self.lam_b * float((steps**2 if self.penalty == "L2" else np.abs(steps)).sum())

    def update(self, f: np.ndarray, g: np.ndarray) -> Coder:
        """The dictionary step, from F = sum of b2 b2' and G = sum of (y - X1 b1) b2'."""
        if self.penalty == "L2":
            ridge = 1e-10 * (np.trace(f) / max(len(f), 1) + 1)
            return replace(self, x2=sylvester(walk_matrix(len(self.x2), self.lam_b), f + ridge * np.eye(len(f)), g))
        d, m2 = self.x2.shape

        def smooth(flat):
            z = flat.reshape(d, m2)
            return np.array([((z @ f) * z).sum() - 2 * (z * g).sum()]), (2 * (z @ f - g)).reshape(1, -1)

        def rough(flat):
            return np.array([self.lam_b * np.abs(np.diff(flat.reshape(d, m2), axis=0, prepend=0)).sum()])

        def shrink(flat, scale):
            return shrink_walk(flat.reshape(d, m2), self.lam_b / float(scale[0])).reshape(1, -1)

        return replace(self, x2=fista(smooth, rough, shrink, self.x2.reshape(1, -1), self.search).reshape(d, m2))


def start(rows: DataFrame, m: int, seed: int = 0, column: str = "y", **weights) -> Coder:
    """X1: the mean profile and ones; X2: seeded noise."""
    mean = rows.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v")).orderBy("pos").collect()
    profile = np.array([r["v"] for r in mean], float)
    x1 = np.column_stack([profile, np.ones(len(profile))])
    return Coder(x1, np.random.default_rng(seed).standard_normal((len(profile), m - 2)), **weights)


def encode(rows: DataFrame, coder: Coder, passes: int = 1) -> DataFrame:
    """(id, y, beta) of rows (id, y[, beta]); a missing beta starts at zero."""
    m, kind = coder.x.shape[1], rows.schema["id"].dataType.simpleString()
    held = rows if "beta" in rows.columns else rows.withColumn("beta", F.array_repeat(F.lit(0.0), m))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, beta = (np.asarray(batch.column(k).flatten(), np.float64).reshape(batch.num_rows, -1) for k in (1, 2))
            made = coder.encode_rows(y, beta, passes)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(made), pa.list_(pa.float64()))], names=["id", "y", "beta"])

    return held.select("id", F.col("y").cast("array<double>").alias("y"), "beta").mapInArrow(run, f"id {kind}, y array<double>, beta array<double>")


def sums(coded: DataFrame, coder: Coder) -> dict:
    """n, ca (squared residuals), cc (weighted sum of |b2|), n_open (|b2| above 1e-6), F and G, summed over all rows."""
    x, x1, m1 = coder.x, coder.x1, coder.x1.shape[1]
    d, m2 = coder.x2.shape

    def run(batches):
        total = np.zeros(4 + m2 * m2 + d * m2)
        for batch in batches:
            if batch.num_rows:
                y, b = (np.asarray(batch.column(k).flatten(), np.float64).reshape(batch.num_rows, -1) for k in (0, 1))
                b2, left = b[:, m1:], y - b[:, :m1] @ x1.T
                total += np.concatenate([[len(y), ((y - b @ x.T) ** 2).sum(), coder.lam_c * np.abs(b2).sum(), (np.abs(b2) > 1e-6).sum()], (b2.T @ b2).ravel(), (left.T @ b2).ravel()])
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    # partitions' sums meet in Spark: the driver gets one number for each place
    rows = coded.select("y", "beta").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    v = np.array([r["v"] for r in rows]) if rows else np.zeros(4 + m2 * m2 + d * m2)
    return {"n": int(v[0]), "ca": v[1], "cc": v[2], "n_open": int(v[3]), "f": v[4 : 4 + m2 * m2].reshape(m2, m2), "g": v[4 + m2 * m2 :].reshape(d, m2)}


def evaluate(coded: DataFrame, coder: Coder) -> dict:
    """The objective and its parts: ca, cb, cc, c, ca_by_n, the share of open coefficients and the number of live columns."""
    s = sums(coded, coder)
    cb = coder.walk()
    live = int((np.abs(coder.x2).sum(axis=0) > 1e-4).sum())
    return {"n": s["n"], "ca": s["ca"], "cb": cb, "cc": s["cc"], "c": s["ca"] + cb + s["cc"], "ca_by_n": s["ca"] / max(s["n"], 1), "open_share": s["n_open"] / max(s["n"] * coder.x2.shape[1], 1), "live_columns": live}


def shrink_columns(coded: DataFrame, coder: Coder, tolerance: float = 1e-8) -> tuple[DataFrame, Coder]:
    """Both without the zero columns of X2."""
    keep = np.abs(coder.x2).sum(axis=0) > tolerance
    if keep.all():
        return coded, coder
    m1 = coder.x1.shape[1]
    places = [*range(m1), *(m1 + np.flatnonzero(keep)).tolist()]
    return coded.withColumn("beta", F.array(*(F.get("beta", k) for k in places))), replace(coder, x2=coder.x2[:, keep])


def fit(rows: DataFrame, coder: Coder, k1: int = 10, k2: int = 500, check: int = 50, shrink_every: int = 10, most_std: float = 0.25, least_lost: int = 1) -> tuple[DataFrame, Coder]:
    """Alternate both steps: k1 rounds, then up to k2 while, at every check, the residual's deviation is above most_std or columns still get lost."""
    coded, live = rows, None
    for k in range(1, k1 + k2 + 1):
        coded = durable(encode(coded, coder), "coded")
        s = sums(coded, coder)
        if not s["n"]:
            return coded, coder
        coder = coder.update(s["f"], s["g"])
        if k % shrink_every == 0:
            coded, coder = shrink_columns(coded, coder, 1e-6 * len(coder.x2))
        if k > k1 and (k - k1) % check == 0:
            now = evaluate(coded, coder)
            lost = (live if live is not None else now["live_columns"] + least_lost) - now["live_columns"]
            live = now["live_columns"]
            if not (np.sqrt(now["ca_by_n"] / len(coder.x2)) > most_std or lost >= least_lost):
                break
    return coded, coder


def search_weights(train: DataFrame, test: DataFrame, coder: Coder, by_b: float, by_c: float, passes: int = 3, added: int = 0, seed: int = 0, most: int = 10, **how) -> tuple[Coder, float]:
    """Greedy search: raise lam_b or lam_c, keep the change that lowers the test residual most, until none does."""
    score = lambda c: evaluate(durable(encode(test, c, passes), "test"), c)["ca_by_n"]
    _, coder = fit(train, coder, **how)
    best = score(coder)
    for k in range(most):
        more = np.random.default_rng(seed + k).standard_normal((len(coder.x2), added))
        tried = [replace(coder, x2=np.hstack([coder.x2, more]), lam_b=coder.lam_b + b, lam_c=coder.lam_c + c) for b, c in ((by_b, 0.0), (0.0, by_c))]
        fitted = [fit(train, c, **how)[1] for c in tried]
        scores = [score(c) for c in fitted]
        if min(scores) >= best:
            break
        best, coder = min(scores), fitted[int(np.argmin(scores))]
    return coder, best
