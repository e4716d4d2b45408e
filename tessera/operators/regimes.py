"""Regimes and change points: HMM, mixtures, rolling fingerprints with k-means, CUSUM, BOCPD, switching regression, agreement scores.

Fits run per series as grouped maps (one group is one symbol's history); candidates of an order selection are groups of their own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import frame, lag, mean, pair_corr, roll, std
from tessera.operators.recurrence import cusum
from tessera.sources.storage import written


#: Tasks that fits are dealt to: their rows are few, and by size Spark would put nearly all of them into one task.
FIT_TASKS = 128


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def _log_normal(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return -0.5 * ((x[:, None] - mu) / sd) ** 2 - np.log(sd) - 0.5 * math.log(2 * math.pi)


def forward_backward(start: np.ndarray, trans: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, c) of the scaled recursions over emissions b[t, state].

    A series is cut into about sqrt(n) blocks. The products of a block's step matrices, each row with its own scale, tell what enters
    the next block; then all blocks recur side by side, so the loops have some 3 sqrt(n) steps instead of 2 n."""
    n, k = b.shape
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    move = np.tile(np.eye(k), (blocks * size, 1, 1))  # the first row and those beyond the end leave all as it is
    move[1:n] = trans * b[1:, None, :]
    move = np.ascontiguousarray(move.reshape(blocks, size, k, k).swapaxes(0, 1))
    whole, logs = np.tile(np.eye(k), (blocks, 1, 1)), np.zeros((blocks, k))
    for j in range(size):
        whole = whole @ move[j]
        total = whole.sum(2) + 1e-300
        whole /= total[:, :, None]
        logs += np.log(total)
    cur, first = np.empty((blocks, k)), start * b[0]
    c0 = first.sum() + 1e-300
    enter = first / c0
    for i in range(blocks):
        cur[i] = enter
        w = np.log(enter + 1e-300) + logs[i]
        enter = np.exp(w - w.max()) @ whole[i]
        enter /= enter.sum()
    alpha, beta, c = np.empty((size, blocks, k)), np.empty((size, blocks, k)), np.empty((size, blocks))
    for j in range(size):
        cur = (cur[:, None, :] @ move[j])[:, 0]
        c[j] = cur.sum(1) + 1e-300
        cur = alpha[j] = cur / c[j][:, None]
    behind, leave, after = np.log(c).sum(0), np.ones(k), np.empty((blocks, k))
    for i in range(blocks - 1, -1, -1):
        after[i] = leave
        leave = np.exp(np.minimum(logs[i] - behind[i] + np.log(whole[i] @ leave + 1e-300), 690.0))
    for j in range(size - 1, -1, -1):
        beta[j] = after
        after = (move[j] @ after[:, :, None])[:, :, 0] / c[j][:, None]
    alpha, beta, c = (np.ascontiguousarray(x.swapaxes(0, 1)).reshape(blocks * size, *x.shape[2:])[:n] for x in (alpha, beta, c))
    c[0] = c0
    return alpha, beta, c


def fit_hmm(x: np.ndarray, k: int, rounds: int | None = None, tol: float = 1e-6) -> dict:
    """Baum-Welch of a univariate Gaussian HMM; states in order of their means.

    It goes on until a round adds less than `tol` to the log likelihood (which is bounded, as deviations are 1e-6 at least, so that it
    ends; a likelihood that is no number ends it too), or for `rounds` rounds, if they are given. Plain rounds take hundreds of ever
    smaller steps; after each, the squared extrapolation of the last two (Varadhan and Roland) is tried, and taken if it is likelier."""

    def em(mu: np.ndarray, sd: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, tuple]:
        """(log likelihood, posteriors, parameters after a round)."""
        emit = _log_normal(x, mu, sd)
        scale = emit.max(1)
        b = np.exp(emit - scale[:, None])
        alpha, beta, c = forward_backward(start, trans, b)
        post = alpha * beta
        post /= post.sum(1, keepdims=True)
        moves = trans * (alpha[:-1].T @ (b[1:] * beta[1:] / c[1:, None])) + 1e-9
        w = post.sum(0) + 1e-9
        mean = post.T @ x / w
        dev = np.sqrt((post * (x[:, None] - mean) ** 2).sum(0) / w) + 1e-6
        return float((np.log(c) + scale).sum()), post, (mean, dev, moves / moves.sum(1, keepdims=True), post[0])

    def further(most: float, *last: tuple) -> tuple[float, tuple]:
        """Where the steps between the last three parameters lead, at most `most` times as far: (times, parameters); once is the last ones."""
        z0, z1, z2 = (np.concatenate([mu / spread, sd / spread, trans.ravel()]) for mu, sd, trans, _ in last)
        step, bend = z1 - z0, z2 - 2 * z1 + z0
        by = min(max(1.0, math.sqrt((step @ step) / max(bend @ bend, 1e-300))), most)
        z = z0 + 2 * by * step + by * by * bend
        trans = np.maximum(z[2 * k :].reshape(k, k), 1e-9)
        return by, (z[:k] * spread, np.maximum(z[k : 2 * k] * spread, 1e-6), trans / trans.sum(1, keepdims=True), last[2][3])

    spread = x.std() + 1e-9
    trans = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
    at = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, spread), trans / trans.sum(1, keepdims=True), np.full(k, 1 / k)
    (ll, post, then), done, most = em(*at), 1, 4.0
    while rounds is None or done < rounds:
        before, (found, post_then, after) = ll, em(*then)
        at, then, last, ll, post, done = then, after, at, found, post_then, done + 1
        if not ll - before >= tol:
            break
        if rounds is None or done < rounds:
            by, tried = further(most, last, at, then)
            found, post_tried, after = em(*tried)
            done += 1
            if found > ll:
                at, then, ll, post = tried, after, found, post_tried
                most *= 4 if by == most else 1
            else:
                most = max(by / 2, 1.0)
    mu, sd, trans, start = at
    order = np.argsort(mu)
    mu, sd, trans, start, post = mu[order], sd[order], trans[np.ix_(order, order)], start[order], post[:, order]
    n_free = k * k + 2 * k - 1
    return {"k": k, "mu": mu, "sd": sd, "trans": trans, "start": start, "post": post, "ll": ll, "bic": -2 * ll + n_free * math.log(len(x)), "aic": -2 * ll + 2 * n_free}


def viterbi_path(x: np.ndarray, m: dict) -> np.ndarray:
    emit, lt = _log_normal(x, m["mu"], m["sd"]), np.log(m["trans"] + 1e-300)
    v, back = np.log(m["start"] + 1e-300) + emit[0], np.zeros((len(x), m["k"]), int)
    for t in range(1, len(x)):
        s = v[:, None] + lt
        back[t] = s.argmax(0)
        v = s.max(0) + emit[t]
    path = np.empty(len(x), int)
    path[-1] = v.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def hmm_order(x: DataFrame, orders: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(symbol, k, ll, bic, aic, mu, sd, trans) of every order; `best_order` picks by BIC."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fit_hmm(pdf.sort_values("i").x.to_numpy(float), int(pdf.k.iloc[0]))
        return pd.DataFrame([(pdf.symbol.iloc[0], m["k"], m["ll"], m["bic"], m["aic"], m["mu"].tolist(), m["sd"].tolist(), m["trans"].ravel().tolist())], columns=["symbol", "k", "ll", "bic", "aic", "mu", "sd", "trans"])

    dealt = x.withColumn("k", F.explode(F.array(*map(F.lit, orders))))
    return dealt.repartition(FIT_TASKS, "symbol", "k").groupBy("symbol", "k").applyInPandas(fit, "symbol string, k int, ll double, bic double, aic double, mu array<double>, sd array<double>, trans array<double>")


def best_order(fits: DataFrame) -> DataFrame:
    return fits.groupBy("symbol").agg(F.min_by("k", F.struct("bic", "k")).alias("k"), F.min("bic").alias("bic"))


def hmm_states(x: DataFrame, k: int = 3) -> DataFrame:
    """(symbol, i, state, posterior): Viterbi path and the largest posterior."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        v = pdf.x.to_numpy(float)
        m = fit_hmm(v, k)
        return pd.DataFrame({"symbol": pdf.symbol, "i": pdf.i, "state": viterbi_path(v, m), "posterior": m["post"].max(1)})

    return x.repartition(FIT_TASKS, "symbol").groupBy("symbol").applyInPandas(label, "symbol string, i int, state int, posterior double")


def mixture(x: DataFrame, k: int = 3, seed: int = 5) -> DataFrame:
    """(symbol, state, weight, mu, sd, ll) of a univariate Gaussian mixture by EM, states in order of their means."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("i").x.to_numpy(float)
        mu, sd, w = np.quantile(v, (np.arange(k) + 0.5) / k), np.full(k, v.std() + 1e-9), np.full(k, 1 / k)
        before = -np.inf
        for _ in range(200):
            joint = np.log(w) + _log_normal(v, mu, sd)
            norm = _log_sum(joint, 1)
            post, ll = np.exp(joint - norm[:, None]), float(norm.sum())
            if ll - before < 1e-6:
                break
            before, n = ll, post.sum(0) + 1e-9
            w, mu = n / n.sum(), post.T @ v / n
            sd = np.sqrt((post * (v[:, None] - mu) ** 2).sum(0) / n) + 1e-6
        o = np.argsort(mu)
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "state": range(k), "weight": w[o], "mu": mu[o], "sd": sd[o], "ll": ll})

    return x.groupBy("symbol").applyInPandas(fit, "symbol string, state int, weight double, mu double, sd double, ll double")


FINGERPRINT = ["fp_mean", "fp_std", "fp_skew", "fp_kurt", "fp_ac1", "fp_neg"]


def fingerprint(panel: DataFrame, w: int = 21) -> DataFrame:
    """Six statistics of the last w returns of each row (column x, ordered by symbol and date), NULL before they fill."""
    c = F.count("x").over(frame(w)).cast("double")
    s1, s2, s3, s4 = (F.sum(F.pow(F.col("x"), k)).over(frame(w)) for k in (1, 2, 3, 4))
    m = s1 / c
    m2, m3, m4 = s2 / c - m * m, s3 / c - 3 * m * s2 / c + 2 * m * m * m, s4 / c - 4 * m * s3 / c + 6 * m * m * s2 / c - 3 * m * m * m * m
    df = panel.withColumn("_lx", lag("x"))
    full = c == w
    return df.withColumns({
        "fp_mean": mean("x", w), "fp_std": roll(F.stddev_samp, "x", w), "fp_skew": F.when(full & (m2 > 1e-14), m3 / F.pow(m2, F.lit(1.5))), "fp_kurt": F.when(full & (m2 > 1e-14), m4 / (m2 * m2) - 3),
        "fp_ac1": F.when(full, F.coalesce(pair_corr("x", "_lx", w - 1), F.lit(0.0))), "fp_neg": mean((F.col("x") < 0).cast("double"), w),
    }).drop("_lx")


def rolling_regimes(panel: DataFrame, k: int = 3, w: int = 21, seed: int = 5) -> DataFrame:
    """Adds state: k-means of the standardised fingerprints over all rows; states in order of their mean deviation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = written(fingerprint(panel, w).dropna(subset=FINGERPRINT), "fingerprints")  # the scaler, k-means and the labels each read them
    vec = VectorAssembler(inputCols=FINGERPRINT, outputCol="_v").transform(rows)
    vec = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(vec).transform(vec)
    model = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="_c", maxIter=50).fit(vec)
    order = np.argsort([c[1] for c in model.clusterCenters()])  # k centres
    names = F.create_map(*(F.lit(int(x)) for pair_ in ((c, s) for s, c in enumerate(order)) for x in pair_))
    return model.transform(vec).withColumn("state", names[F.col("_c")]).drop("_v", "_z", "_c")


def silhouette(labelled: DataFrame, cols: list[str], state: str = "state", most: int = 500) -> DataFrame:
    """Mean silhouette of a sample of at most `most` rows (smallest hashes), Euclidean; the sample is compared with itself."""
    s = written(labelled.withColumn("_h", F.xxhash64("symbol", "date")).orderBy("_h", "symbol", "date").limit(most), "silhouette")  # read twice
    a = s.select("_h", F.col(state).alias("s"), F.array(*cols).alias("v"))
    b = a.select(F.col("_h").alias("h2"), F.col("s").alias("s2"), F.col("v").alias("v2"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "v2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    near = a.join(F.broadcast(b), F.col("_h") != F.col("h2")).groupBy("_h", "s", "s2").agg(F.avg(d).alias("d"))  # at most 500 rows
    per = near.groupBy("_h", "s").agg(F.max(F.when(F.col("s") == F.col("s2"), F.col("d"))).alias("a"), F.min(F.when(F.col("s") != F.col("s2"), F.col("d"))).alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)).alias("silhouette"))


def spells(labels: DataFrame, state: str = "state", order: str = "date") -> DataFrame:
    """(symbol, spell, state, first, last, n): contiguous runs of one state."""
    w = Window.partitionBy("symbol").orderBy(order)
    at = labels.withColumn("_c", (~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int")).withColumn("spell", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("symbol", "spell").agg(F.first(state).alias("state"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def transitions(labels: DataFrame, state: str = "state", order: str = "date") -> DataFrame:
    """(state, next, n, p) over all symbols."""
    w = Window.partitionBy("symbol").orderBy(order)
    moves = labels.select(F.col(state).alias("state"), F.lead(state).over(w).alias("next")).where("next is not null").groupBy("state", "next").agg(F.count(F.lit(1)).alias("n"))
    return moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def transition_entropy(moves: DataFrame) -> DataFrame:
    return moves.groupBy("state").agg((-F.sum(F.col("p") * F.log("p"))).alias("h")).agg(F.avg("h").alias("entropy"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency counts."""
    pairs = lambda c: c * (c - 1) / 2.0
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    s = cells.agg(F.sum(pairs(F.col("c"))).alias("ij"), F.sum("c").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("i"))
    cols = cells.groupBy(b).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("j"))
    one = s.join(F.broadcast(rows)).join(F.broadcast(cols))  # one row each
    want = F.col("i") * F.col("j") / pairs(F.col("n"))
    return one.select(F.when((F.col("i") + F.col("j")) / 2 == want, F.lit(1.0)).otherwise((F.col("ij") - want) / ((F.col("i") + F.col("j")) / 2 - want)).alias("ari"))


def cusum_changes(x: DataFrame, threshold: float = 5.0, drift: float = 0.0) -> DataFrame:
    """(symbol, i) of the change points; the reset makes it a recurrence."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        at = cusum(pdf.x.to_numpy(float), threshold, drift)
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "i": pdf.i.to_numpy()[at]}, columns=["symbol", "i"])

    return x.groupBy("symbol").applyInPandas(find, "symbol string, i int")


def segments(x: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds segment: change points so far."""
    marked = x.join(changes.withColumn("_c", F.lit(1)), ["symbol", "i"], "left")
    return marked.withColumn("segment", F.coalesce(F.sum("_c").over(Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_c")


class RunLengths:
    """Bayesian online change-point detection: Normal-inverse-gamma beliefs of every run length up to `most`.

    Run lengths whose posterior falls below `least` are given up, so what is held follows the mass, not the time since the last change."""

    def __init__(self, hazard: float = 1 / 100, most: int = 300, scale: float = 1e-4, least: float = 0.0):
        self.hazard, self.most, self.scale, self.least = hazard, most, scale, least
        self.r, self.p, self.mu, self.beta = np.zeros(1, int), np.ones(1), np.zeros(1), np.full(1, scale)
        self.known = np.empty((6, 0))

    def by_length(self) -> np.ndarray:
        """What follows from the run lengths alone: kappa, kappa + 1, (kappa + 1) / (alpha kappa), nu, the constant of the log density, its exponent."""
        top = int(self.r[-1]) + 1  # run lengths ascend
        if self.known.shape[1] < top:
            r = np.arange(2.0 * top)
            kappa, alpha = r + 1, 1 + r / 2
            nu = 2 * alpha
            const = [math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - math.log(v * math.pi) / 2 for v in nu]
            self.known = np.array([kappa, kappa + 1, (kappa + 1) / (alpha * kappa), nu, const, -(nu + 1) / 2])
        return self.known[:, :top] if len(self.r) == top else self.known.take(self.r, axis=1)

    def step(self, x: float) -> tuple[float, int]:
        """Probability of run length 0 and the most probable run length after seeing x."""
        kappa, above, widen, nu, const, power = self.by_length()
        var, off = self.beta * widen, np.square(x - self.mu)
        grown = self.p * np.exp(const - np.log(var) / 2 + power * np.log(1 + off / (nu * var)))
        n = len(grown) + 1
        p, mu, beta, r = np.empty(n), np.empty(n), np.empty(n), np.empty(n, int)
        p[0], mu[0], beta[0], r[0] = grown.sum() * self.hazard, 0.0, self.scale, 0
        p[1:] = grown * (1 - self.hazard)
        p /= max(p.sum(), 1e-300)
        mu[1:] = (kappa * self.mu + x) / above
        beta[1:] = self.beta + kappa * off / (2 * above)
        r[1:] = self.r + 1
        keep = p >= self.least
        if r[-1] >= self.most:
            keep &= r < self.most
        keep[0] = True
        if not keep.all():
            p, mu, beta, r = p[keep], mu[keep], beta[keep], r[keep]
            p /= p.sum()
        self.p, self.mu, self.beta, self.r = p, mu, beta, r
        return float(p[0]), int(r[p.argmax()])

    def steps(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `step` gives for each of the values, as two arrays."""
        p, r = np.empty(len(values)), np.empty(len(values), np.int32)
        for i, v in enumerate(values):
            p[i], r[i] = self.step(float(v))
        return p, r

    def beliefs(self) -> list[tuple]:
        """(r, p, mu, kappa, alpha, beta) of each run length that is held."""
        return list(zip(*(x.tolist() for x in (self.r, self.p, self.mu, self.r + 1.0, 1 + self.r / 2, self.beta)), strict=True))

    def restore(self, beliefs: list[tuple]) -> None:
        r, p, mu, _, _, beta = zip(*sorted(beliefs), strict=True)
        self.r, self.p, self.mu, self.beta = np.array(r, int), np.array(p, float), np.array(mu, float), np.array(beta, float)


def bocpd(x: DataFrame, hazard: float = 1 / 100, most: int = 300, scale: float = 1e-4, least: float = 0.0) -> DataFrame:
    """(symbol, i, cp_prob, run_length); a change shows as a fall of the run length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        runs = RunLengths(hazard, most, scale, least)
        p, r = runs.steps(pdf.x.to_numpy(float))
        return pd.DataFrame({"symbol": pdf.symbol, "i": pdf.i, "cp_prob": p, "run_length": r})

    return x.groupBy("symbol").applyInPandas(run, "symbol string, i int, cp_prob double, run_length int")


def switching_regression(rows: DataFrame, k: int = 2) -> DataFrame:
    """(symbol, state, intercept, slope, sd, weight): EM of y on f with a Markov state; states in order of slope. rows: (symbol, i, f, y)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        y, z = pdf.y.to_numpy(float), np.c_[np.ones(len(pdf)), pdf.f.to_numpy(float)]
        coef = np.linalg.solve(z.T @ z + 1e-8 * np.eye(2), z.T @ y)
        b = np.stack([coef * np.array([1, 0.5 + s]) for s in range(k)])
        sd, trans = np.full(k, (y - z @ coef).std() + 1e-9), np.full((k, k), 0.05 / max(k - 1, 1)) + np.eye(k) * (0.95 - 0.05 / max(k - 1, 1))
        for _ in range(100):
            e = (y[:, None] - z @ b.T) / sd
            like = np.exp(-0.5 * e * e + (0.5 * e * e).min(1, keepdims=True)) / sd
            fwd = np.empty_like(like)
            p = np.full(k, 1 / k)
            for t in range(len(y)):
                p = (p @ trans if t else p) * like[t]
                p = fwd[t] = p / max(p.sum(), 1e-300)
            post, moves = fwd.copy(), np.zeros((k, k))
            for t in range(len(y) - 2, -1, -1):
                joint = fwd[t][:, None] * trans * (post[t + 1] / np.maximum(fwd[t] @ trans, 1e-300))
                moves += joint
                post[t] = joint.sum(1)
            old = b.copy()
            trans = (moves + 1e-6) / (moves + 1e-6).sum(1, keepdims=True)
            for s in range(k):
                w = post[:, s]
                b[s] = np.linalg.solve((z * w[:, None]).T @ z + 1e-8 * np.eye(2), (z * w[:, None]).T @ y)
                sd[s] = math.sqrt((w * (y - z @ b[s]) ** 2).sum() / (w.sum() + 1e-9)) + 1e-6
            if np.abs(b - old).max() < 1e-8:
                break
        o = np.argsort(b[:, 1])
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "state": range(k), "intercept": b[o, 0], "slope": b[o, 1], "sd": sd[o], "weight": post.mean(0)[o]})

    return rows.groupBy("symbol").applyInPandas(fit, "symbol string, state int, intercept double, slope double, sd double, weight double")


def hmm_stability(x: DataFrame, k: int = 3, resamples: int = 8, block: int = 20, seed: int = 3) -> DataFrame:
    """(symbol, mean_ari, least_share): agreement of the path with those of models refitted on block-resampled series."""

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("i")
        v, one = pdf.x.to_numpy(float), pdf.one.to_numpy()
        sym, b = pdf.symbol.iloc[0], int(pdf.b.iloc[0])
        rng = np.random.default_rng([seed, zlib.crc32(sym.encode()), b])
        at = (rng.integers(len(v), size=(-(-len(v) // block), 1)) + np.arange(block)).ravel()[: len(v)] % len(v)
        two = viterbi_path(v, fit_hmm(v[at], k))
        cell = np.bincount(one * k + two, minlength=k * k).reshape(k, k).astype(float)
        pairs = lambda c: float((c * (c - 1) / 2).sum())
        i, j, n = pairs(cell.sum(1)), pairs(cell.sum(0)), len(v) * (len(v) - 1) / 2
        ari = (pairs(cell) - i * j / n) / ((i + j) / 2 - i * j / n) if (i + j) / 2 != i * j / n else 1.0
        return pd.DataFrame({"symbol": [sym], "ari": [ari], "share": [float(np.bincount(one, minlength=k).min() / len(v))]})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        v = pdf.x.to_numpy(float)
        return pd.DataFrame({"symbol": pdf.symbol, "i": pdf.i, "x": v, "one": viterbi_path(v, fit_hmm(v, k))})

    paths = x.repartition(FIT_TASKS, "symbol").groupBy("symbol").applyInPandas(label, "symbol string, i int, x double, one int")  # once, not for each resample
    dealt = paths.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return dealt.repartition(FIT_TASKS, "symbol", "b").groupBy("symbol", "b").applyInPandas(refit, "symbol string, ari double, share double").groupBy("symbol").agg(F.avg("ari").alias("mean_ari"), F.min("share").alias("least_share"))


def vol_state(panel: DataFrame) -> DataFrame:
    """(symbol, date, state): thirds of the 20-row deviation over each symbol's history; a deterministic labelling."""
    df = panel.withColumn("vol", std("r", 20)).where("vol is not null")
    cuts = df.groupBy("symbol").agg(F.percentile("vol", F.lit(1 / 3)).alias("_a"), F.percentile("vol", F.lit(2 / 3)).alias("_b"))
    return df.join(cuts, "symbol").select("symbol", "date", "r", "vol", F.when(F.col("vol") <= F.col("_a"), 0).when(F.col("vol") <= F.col("_b"), 1).otherwise(2).alias("state"))

