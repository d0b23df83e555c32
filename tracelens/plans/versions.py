"""Nested cross-validation with label versions, not rows, dealt to tasks.

A table of runs is small: one row per run, a few numbers. It is packed once, and each task takes a block of label
versions through the whole cross-validation in numpy: draws, selection by ranks in every fold, standardising,
Newton's method for all versions of the block at once, out-of-fold scores and their AUC. One number per version comes back.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.draws import chosen


def known(function):
    """Results kept by arguments; unlike ``functools.lru_cache`` it can be pickled by value."""
    kept = {}

    def call(*key):
        if key not in kept:
            kept[key] = function(*key)
        return kept[key]

    return call


def _squares(z: np.ndarray) -> np.ndarray:
    """Products of every two columns, a row each."""
    return (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)


def fit_many(z: np.ndarray, y: np.ndarray, keep: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 60,
             tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """L2 logistic models on the columns of z (the first is the intercept, not penalised), one per row of y.

    ``keep`` (versions, columns) says which columns a model has. A step that lowers the likelihood is halved.
    Returns coefficients, log-likelihood and Hessian there, and whether the steps came to rest; where
    classes can be separated and nothing is penalised they don't.
    """
    versions, size = keep.shape
    ridge = penalty * keep
    ridge[:, 0] = 0
    parts = range(0, max(len(z), 1), max(1, AT_ONCE // size ** 2))
    squares = [_squares(z[i:i + parts.step]) for i in parts] if len(parts) == 1 else None  # of a long table they are made anew
    best = np.zeros((versions, size)) if start is None else start * keep
    step, trial = np.zeros_like(best), best.copy()
    goal, loglik, hess = np.full(versions, -np.inf), np.zeros(versions), np.zeros((versions, size, size))
    at_rest, todo = np.zeros(versions, bool), np.arange(versions)
    for _ in range(rounds):
        eta = trial[todo] @ z.T
        small = np.exp(-np.abs(eta))
        ll = (y[todo] * eta - np.maximum(eta, 0) - np.log1p(small)).sum(axis=1)
        value = ll - (ridge[todo] * trial[todo] ** 2).sum(axis=1) / 2
        good = value >= goal[todo] - 1e-12 * (1 + np.abs(value))
        bad, ok = todo[~good], todo[good]
        step[bad] /= 2
        gain = value[good] - goal[ok]
        best[ok], goal[ok], loglik[ok] = trial[ok], value[good], ll[good]
        prob = np.where(eta[good] >= 0, 1, small[good]) / (1 + small[good])
        g = (y[ok] - prob) @ z - ridge[ok] * best[ok]
        w = prob * (1 - prob)
        h = sum(w[:, i:i + parts.step] @ (squares[0] if squares else _squares(z[i:i + parts.step])) for i in parts).reshape(len(ok), size, size)
        hess[ok] = h
        k = keep[ok]
        full = h + ridge[ok][:, :, None] * np.eye(size)
        full = full * k[:, :, None] * k[:, None, :] + (1 - k + 1e-12)[:, :, None] * np.eye(size)
        step[ok] = np.linalg.solve(full, (g * k)[..., None])[..., 0]
        longest = np.abs(step[todo]).max(axis=1)
        rest = longest < tol
        stuck = np.zeros(len(todo), bool)
        stuck[good] = (gain < 1e-12 * (1 + np.abs(value[good]))) & (longest[good] > 1e-3)
        at_rest[todo[rest]] = True
        trial[todo] = best[todo] + step[todo]
        todo = todo[~rest & ~stuck]
        if not len(todo):
            break
    return best, loglik, hess, at_rest


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    a, b, x = df / 2, 0.5, df / (df + t * t)

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@known
def critical_rho(n: int, p: float) -> float:
    """The rank correlation of n pairs whose two-sided p is p."""
    df = n - 2
    if df <= 0:
        return math.inf
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid >= 1 or t_tail(mid * math.sqrt(df / (1 - mid * mid)), df) < p:
            high = mid
        else:
            low = mid
    return high


def mean_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, at, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[at]


def rank_auc(score: np.ndarray, y: np.ndarray) -> float | None:
    """AUC over the scores that are numbers; scores equal to 12 digits are ties."""
    here = ~np.isnan(score)
    y, ranks = y[here], mean_ranks(np.round(score[here], 12))
    pos = y.sum()
    return float((ranks[y > 0].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))) if 0 < pos < len(y) else None


def monomials(z: np.ndarray, degree: int) -> np.ndarray:
    """All products of ``degree`` columns of z, in the order of ``_places``."""
    out, last = z, np.arange(z.shape[1])
    for _ in range(degree - 1):
        parts = [(out[:, last <= j] * z[:, [j]], np.full((last <= j).sum(), j)) for j in range(z.shape[1])]
        out, last = np.concatenate([p for p, _ in parts], axis=1), np.concatenate([q for _, q in parts])
    return out


@known
def _places(size: int, degree: int) -> np.ndarray:
    """Where ``monomials`` has the product of each tuple of columns, as an array with ``degree`` axes."""
    rows = [(j,) for j in range(size)]
    for _ in range(degree - 1):
        rows = [(*r, j) for j in range(size) for r in rows if r[-1] <= j]
    at = {r: i for i, r in enumerate(rows)}
    return np.array([at[tuple(sorted(t))] for t in np.ndindex(*[size] * degree)]).reshape([size] * degree)


#: The fourth derivative of the logistic function is nowhere larger.
FOURTH = 0.128
#: What a coefficient may be off by, as in ``fit_many``; numbers (versions x rows, or rows x folds) worked on at once.
TOL, AT_ONCE = 1e-8, 1_000_000


class Table:
    """The packed runs, in order of their units."""

    def __init__(self, x: np.ndarray, y: np.ndarray, task: np.ndarray, strata: np.ndarray, first: np.ndarray, second: np.ndarray, select: np.ndarray | None):
        self.x, self.y, self.first, self.second, self.select = x, y.astype(np.int64), first, second, select
        self.folds = [np.flatnonzero(task == t) for t in np.unique(task)]
        self.strata = [np.flatnonzero(strata == s) for s in np.unique(strata)]
        self.fold_of = np.empty(len(y), np.int64)
        for f, own in enumerate(self.folds):
            self.fold_of[own] = f

    def labels(self, seed: int, versions: np.ndarray) -> np.ndarray:
        """(versions, runs): version 0 has the labels, version v the shuffle v - 1 within strata."""
        out = np.tile(self.y, (len(versions), 1))
        mixed = np.flatnonzero(versions > 0)
        for rows in self.strata:
            out[np.ix_(mixed, rows)] = chosen(seed, versions[mixed] - 1, self.first[rows], self.second[rows], int(self.y[rows].sum()))
        return out

    def selected(self, y: np.ndarray, rho: float, p: float, min_n: int) -> np.ndarray:
        """(versions, folds, features): those that go with the label in one focal stratum of the fold's training rows.

        A stratum is sorted once; ranks without a fold come from counts over its distinct values.
        """
        many, size = len(self.folds), self.x.shape[1]
        keep = np.zeros((len(y), many, size), bool)
        for s in np.unique(self.select[self.select >= 0]):
            rows = np.flatnonzero(self.select == s)
            own, fold = y[:, rows].astype(float), self.fold_of[rows]
            level = [np.unique(c, return_inverse=True)[1] for c in self.x[rows].T]
            step = max(1, AT_ONCE // (len(rows) * (size + 1)))
            for begin in range(0, many, step):
                at = range(begin, min(begin + step, many))
                ranks = np.zeros((len(rows), len(at), size + 1))
                for i, f in enumerate(at):
                    train = fold != f
                    ranks[:, i, size] = train
                    for j, v in enumerate(level):
                        count = np.bincount(v[train], minlength=v.max() + 1)
                        ranks[train, i, j] = (np.cumsum(count) - (count - 1) / 2)[v[train]]
                n, sr, srr = ranks[:, :, size].sum(axis=0)[:, None], ranks[:, :, :size].sum(axis=0), (ranks[:, :, :size] ** 2).sum(axis=0)
                sums = (own @ ranks.reshape(len(rows), -1)).reshape(len(y), len(at), size + 1)
                sy = sums[:, :, size:]
                vr, vy = n * srr - sr ** 2, n * sy - sy ** 2
                with np.errstate(all="ignore"):
                    value = np.abs((n * sums[:, :, :size] - sy * sr) / np.sqrt(vr * vy))
                least = np.array([critical_rho(int(k), p) for k in n[:, 0]])[:, None]
                keep[:, begin:begin + len(at)] |= (n >= min_n) & (vr > 1e-12 * n * srr) & (vy > 0) & (value > rho) & (value > least)
        keep[~keep.any(axis=2)] = True  # nothing passes: use all features
        return keep

    def scaled(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread of the features in these rows; a constant has spread 1."""
        mean, sd = self.x[train].mean(axis=0), self.x[train].std(axis=0)
        return mean, np.where(sd < 1e-10 * np.maximum(np.abs(mean), 1.0), 1.0, sd)

    def prepared(self) -> dict:
        """What does not depend on labels: the columns scaled over all rows, each fold's own scale, and sums for the remainder's bound."""
        if "_prepared" not in self.__dict__:
            n = len(self.y)
            mean, sd = self.scaled(np.ones(n, bool))
            z = np.column_stack((np.ones(n), (self.x - mean) / sd))
            scales = [self.scaled(self.fold_of != f) if len(own) < n else (mean, sd) for f, own in enumerate(self.folds)]
            far = np.stack([np.abs(z[own]).T @ monomials(z[own], 4) for own in self.folds])
            ratio = np.stack([s for _, s in scales]) / sd
            self._prepared = {"mean": mean, "sd": sd, "z": z, "scales": scales, "far": far.sum(axis=0) - far, "ratio": ratio}
        return self._prepared

    def near_fits(self, y: np.ndarray, keep: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients of every (version, fold), on the columns scaled over all rows, a bound of their error, and inverse Hessians.

        All folds of a version have nearly the same rows. One pass over the rows at a common point gives each task's part of the
        first four derivatives of the likelihood; a fold's are the total without its task, and its maximum follows from
        them. The fifth derivative bounds what is left out.
        """
        c = self.prepared()
        z, many, size = c["z"], len(self.folds), c["z"].shape[1]
        ridge = np.column_stack((np.zeros(many), penalty * c["ratio"] ** 2))
        k4, k3, k2 = _places(size, 4), _places(size, 3), _places(size, 2)
        gamma, error = np.zeros((len(y), many, size)), np.full((len(y), many), np.inf)
        curve = np.zeros((len(y), many, size, size))
        codes = keep @ (1 << np.arange(keep.shape[2]))
        for code in np.unique(codes):
            k = np.concatenate(([1.0], (code >> np.arange(keep.shape[2])) & 1))
            having = np.flatnonzero((codes == code).any(axis=1))
            step = max(1, AT_ONCE // len(z))
            for begin in range(0, len(having), step):
                vs = having[begin:begin + step]
                own = y[vs].astype(float)
                share = np.clip(own.mean(axis=1), 1e-6, 1 - 1e-6)
                start = np.zeros((len(vs), size))
                start[:, 0] = np.log(share / (1 - share))
                base, *_ = fit_many(z, own, np.tile(k, (len(vs), 1)), penalty, start, tol=1e-2)
                prob = 1 / (1 + np.exp(-np.clip(base @ z.T, -700, 700)))
                gap, w2 = own - prob, prob * (1 - prob)
                w3, w4 = w2 * (1 - 2 * prob), w2 * (1 - 6 * w2)
                sums = [np.empty((len(vs), many, m)) for m in (size, k2.max() + 1, k3.max() + 1, k4.max() + 1)]
                for f, rows in enumerate(self.folds):
                    for d, w in enumerate((gap, w2, w3, w4)):
                        sums[d][:, f] = w[:, rows] @ monomials(z[rows], d + 1)
                a, b, t3, t4 = (s.sum(axis=1, keepdims=True) - s for s in sums)
                b, t3, t4 = b[..., k2], t3[..., k3], t4[..., k4]
                delta, hold = np.zeros_like(a), (1 - k) * np.eye(size)
                for _ in range(8):
                    c4 = np.einsum("vfabcd,vfd->vfabc", t4, delta)
                    c43, c3 = np.einsum("vfabc,vfc->vfab", c4, delta), np.einsum("vfabc,vfc->vfab", t3, delta)
                    g = a - np.einsum("vfab,vfb->vfa", b + c3 / 2 + c43 / 6, delta) - ridge * (base[:, None] + delta)
                    j = (b + c3 + c43 / 2 + ridge[..., None] * np.eye(size)) * k[:, None] * k + hold + 1e-12 * np.eye(size)
                    with np.errstate(all="ignore"):
                        inverse = np.linalg.inv(j)
                        move = np.einsum("vfab,vfb->vfa", inverse, g * k)
                        delta = np.clip(np.nan_to_num(delta + move), -10, 10)
                    if np.abs(move).max() < TOL / 100:
                        break
                inverse = inverse * k[:, None] * k
                powers = np.einsum("vfa,vfb,vfc,vfd->vfabcd", delta, delta, delta, delta).reshape(len(vs), many, -1)
                quartic = np.stack([np.bincount(k4.ravel(), q, minlength=k4.max() + 1) for q in powers.reshape(-1, powers.shape[2])]).reshape(len(vs), many, -1)
                left = np.einsum("fam,vfm->vfa", c["far"], quartic) * FOURTH / 24
                off = (2 * np.einsum("vfab,vfb->vfa", np.abs(inverse), left) + np.abs(move)).max(axis=2)
                here = codes[vs] == code
                gamma[vs] = np.where(here[..., None], base[:, None] + delta, gamma[vs])
                error[vs] = np.where(here, np.where(np.isfinite(off), off, np.inf), error[vs])
                curve[vs] = np.where(here[..., None, None], inverse, curve[vs])
        return gamma, error, curve

    def rested(self, y: np.ndarray, gamma: np.ndarray, curve: np.ndarray, fold: int, penalty: float, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of one fold moved on by exact gradients until a step is below ``TOL``, and which of them came to rest."""
        c = self.prepared()
        z, ridge = c["z"], np.concatenate(([0.0], penalty * c["ratio"][fold] ** 2))
        gamma, rest, step = gamma.copy(), np.zeros(len(gamma), bool), max(1, AT_ONCE // len(z))
        for begin in range(0, len(gamma), step):
            at = np.arange(begin, min(begin + step, len(gamma)))
            for _ in range(rounds):
                gap = gamma[at] @ z.T
                np.negative(np.clip(gap, -700, 700, out=gap), out=gap)
                np.exp(gap, out=gap)
                gap += 1
                np.divide(-1, gap, out=gap)
                gap += y[at]
                gap[:, self.folds[fold]] = 0
                move = np.einsum("vab,vb->va", curve[at], gap @ z - ridge * gamma[at])
                rest[at] = still = np.abs(move).max(axis=1) < TOL
                gamma[at] += move
                at = at[~still & np.isfinite(move).all(axis=1) & (np.abs(move).max(axis=1) < 1)]
                if not len(at):
                    break
        return gamma, rest

    def scores(self, y: np.ndarray, penalty: float, rho: float, p: float, min_n: int) -> np.ndarray:
        """Out-of-fold scores; none where a training set has one class.

        Folds whose fit by ``near_fits`` may be off by more than ``TOL`` go on over their rows, those that find no rest so from the start.
        """
        out, n = np.full(y.shape, np.nan), len(self.y)
        shape = (len(y), len(self.folds), self.x.shape[1])
        keep = np.ones(shape, bool) if self.select is None else self.selected(y, rho, p, min_n)
        c = self.prepared()
        gamma, error, curve = self.near_fits(y, keep, penalty)
        total = y.sum(axis=1)
        for f, own in enumerate(self.folds):
            if len(own) == n:
                continue
            pos = total - y[:, own].sum(axis=1)
            both = np.flatnonzero((pos > 0) & (pos < n - len(own)))
            mean, sd = c["scales"][f]
            redo = both[error[both, f] > TOL]
            if len(redo):
                gamma[redo, f], rest = self.rested(y[redo], gamma[redo, f], curve[redo, f], f, penalty)
                redo = redo[~rest]
            if len(redo):
                train = self.fold_of != f
                z = np.column_stack((np.ones(n - len(own)), (self.x[train] - mean) / sd))
                columns = np.column_stack((np.ones(len(redo)), keep[redo, f]))
                beta, _, _, _ = fit_many(z, y[redo][:, train].astype(float), columns, penalty)
                gamma[redo, f, 1:] = beta[:, 1:] * c["sd"] / sd
                gamma[redo, f, 0] = beta[:, 0] - beta[:, 1:] @ ((mean - c["mean"]) / sd)
            out[np.ix_(both, own)] = 1 / (1 + np.exp(-np.clip(gamma[both, f] @ c["z"][own].T, -700, 700)))
        return out

    def aucs(self, seed: int, versions: np.ndarray, penalty: float, rho: float, p: float, min_n: int) -> list[float | None]:
        y = self.labels(seed, versions)
        return [rank_auc(s, own) for s, own in zip(self.scores(y, penalty, rho, p, min_n), y)]
