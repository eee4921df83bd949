"""Gaussian mixtures at scale: all models of a sweep advance together, one pass per EM step.

Tasks add up each model's sufficient statistics over their rows; only these sums are grouped and
brought to the driver, where the parameters (a few numbers per component) are updated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-6
Model = tuple[np.ndarray, np.ndarray, np.ndarray]  # weights (k), means (k, d), covariances (k, d, d)


def log_densities(x: np.ndarray, model: Model) -> np.ndarray:
    """log(weight * density) of each row under each component."""
    weights, means, covs = model
    d = x.shape[1]
    out = np.empty((len(x), len(weights)))
    for c in range(len(weights)):
        low = np.linalg.cholesky(covs[c])
        z = np.linalg.solve(low, (x - means[c]).T)
        out[:, c] = math.log(max(weights[c], 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + (z * z).sum(0)) - np.log(np.diag(low)).sum()
    return out


def _total(logs: np.ndarray) -> np.ndarray:
    top = logs.max(1)
    return top + np.log(np.exp(logs - top[:, None]).sum(1))


def sums(x: np.ndarray, model: Model) -> np.ndarray:
    """Log-likelihood and, per component, count, sum and sum of squares, as one vector."""
    logs = log_densities(x, model)
    total = _total(logs)
    r = np.exp(logs - total[:, None])
    parts = [np.array([total.sum()])]
    for c in range(r.shape[1]):
        weighted = x * r[:, c : c + 1]
        parts += [r[:, c].sum(keepdims=True), weighted.sum(0), (weighted.T @ x).ravel()]
    return np.concatenate(parts)


def update(vector: np.ndarray, k: int, d: int, n: int) -> tuple[float, Model]:
    """Log-likelihood of the old parameters and the new ones."""
    blocks = vector[1:].reshape(k, 1 + d + d * d)
    count = np.maximum(blocks[:, 0], 1e-10)
    means = blocks[:, 1 : 1 + d] / count[:, None]
    covs = blocks[:, 1 + d :].reshape(k, d, d) / count[:, None, None] - means[:, :, None] * means[:, None, :]
    return float(vector[0]), (count / n, means, covs + RIDGE * np.eye(d))


def n_parameters(k: int, d: int) -> int:
    return k - 1 + k * d + k * d * (d + 1) // 2


def _start(points: np.ndarray, spread: np.ndarray, k: int) -> Model:
    return np.full(k, 1 / k), points[:k], np.repeat(np.diag(spread + RIDGE)[None], k, 0)


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return batch.to_numpy(np.float64)


def gmm_sweep(df: DataFrame, features: list[str], ks: list[int], n_init: int = 15, iterations: int = 100, tolerance: float = 1e-4, seed: int = 42) -> dict[int, tuple[float, Model]]:
    """Best log-likelihood and model for each k below the number of rows; rows must have no nulls.

    Starts are rows in the order of a seeded hash, so they do not depend on partitioning.
    """
    raw = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    d = len(features)
    stats = raw.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(c) for c in features], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
    n, spread = stats["n"], np.array([stats[c] or 1.0 for c in features])
    # Second moments of centred values: far from zero, their differences would lose their digits.
    centre = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    x = raw.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip(features, centre, strict=True)]).cache()
    ks = [k for k in ks if k < n]
    if not ks:
        return {}
    picks = x.orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(max(ks) * n_init).collect()  # starts only
    points = np.array([list(p) for p in picks])
    models = {(k, r): _start(np.roll(points, -r * k, axis=0), spread, k) for k in ks for r in range(n_init if k > 1 else 1)}
    last = dict.fromkeys(models, -math.inf)
    best: dict[int, tuple[float, Model]] = {}
    open_ = set(models)
    for turn in range(iterations + 1):
        now = {m: models[m] for m in open_}
        shared = df.sparkSession.sparkContext.broadcast(now)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            totals = {}
            for batch in batches:
                rows = _matrix(batch)
                for m, model in shared.value.items():
                    got = sums(rows, model)
                    totals[m] = totals[m] + got if m in totals else got
            for (k, r), v in totals.items():
                yield pd.DataFrame({"k": k, "r": r, "pos": range(len(v)), "value": v})

        found = x.mapInPandas(count, "k int, r int, pos int, value double").groupBy("k", "r", "pos").agg(F.sum("value").alias("value")).collect()
        vectors = {m: np.zeros(1 + m[0] * (1 + d + d * d)) for m in open_}
        for row in found:
            vectors[row["k"], row["r"]][row["pos"]] = row["value"]
        for m in list(open_):
            ll, new = update(vectors[m], m[0], d, n)
            if m[0] not in best or ll > best[m[0]][0]:
                best[m[0]] = (ll, models[m])
            if abs(ll - last[m]) < tolerance * n or turn == iterations:
                open_.discard(m)
            last[m], models[m] = ll, new
        if not open_:
            break
    x.unpersist()
    return {k: (ll, (weights, means + centre, covs)) for k, (ll, (weights, means, covs)) in best.items()}


def sweep_table(df: DataFrame, best: dict[int, tuple[float, Model]], n: int, d: int) -> DataFrame:
    """(k, ll, bic, aic) of a sweep."""
    rows = [(k, ll, -2 * ll + n_parameters(k, d) * math.log(n), -2 * ll + 2 * n_parameters(k, d)) for k, (ll, _) in sorted(best.items())]
    return df.sparkSession.createDataFrame(rows, "k int, ll double, bic double, aic double")


def assign_clusters(df: DataFrame, features: list[str], models: dict[int, Model]) -> DataFrame:
    """Add labels: for each k (in order) the most likely component, renumbered by size, ties by old number."""
    shared = df.sparkSession.sparkContext.broadcast([models[k] for k in sorted(models)])
    schema = df.select("*", F.array(F.lit(0)).alias("labels")).schema

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(np.float64)
            found = np.stack([log_densities(x, m).argmax(1) for m in shared.value], 1).astype(np.int32) if len(batch) else np.zeros((0, 1))
            yield batch.assign(labels=list(found))

    raw = df.mapInPandas(label, schema).cache()
    counts = raw.select(F.posexplode("labels").alias("p", "c")).groupBy("p", "c").agg(F.count(F.lit(1)).alias("n")).collect()  # k * k rows
    maps = []
    for p, k in enumerate(sorted(models)):
        n = {r["c"]: r["n"] for r in counts if r["p"] == p}
        order = sorted(range(k), key=lambda c: (-n.get(c, 0), c))
        maps.append(F.array(*[F.lit(order.index(c)) for c in range(k)]))
    numbered = F.array(*[F.get(m, F.get("labels", F.lit(p))) for p, m in enumerate(maps)])
    return raw.withColumn("labels", numbered)


def sample(model: Model, n: int, rng: np.random.Generator) -> np.ndarray:
    weights, means, covs = model
    c = rng.choice(len(weights), n, p=weights / weights.sum())
    low = np.linalg.cholesky(covs)
    return means[c] + np.einsum("nij,nj->ni", low[c], rng.normal(size=(n, means.shape[1])))


#: Rows of a replicate that share a seed, and that are one unit of work.
SEED_ROWS, UNIT_ROWS = 1024, 65_536


def replicate_rows(model: Model, n: int, start: int, stop: int, seed: list[int]) -> np.ndarray:
    """Rows start to stop of a replicate of n rows; start is a multiple of SEED_ROWS."""
    parts = [sample(model, min(SEED_ROWS, n - a), np.random.default_rng([*seed, a // SEED_ROWS])) for a in range(start, min(stop, n), SEED_ROWS)]
    return np.concatenate(parts)


def bootstrap_lrt(df: DataFrame, best: dict[int, tuple[float, Model]], n: int, n_boot: int = 25, n_init: int = 5, seed: int = 7, iterations: int = 100, tolerance: float = 1e-4, unit_rows: int | None = None) -> DataFrame:
    """(k, observed, p): tests k - 1 against k components by the likelihood ratio.

    Each of n_boot replicates of a test is drawn from the smaller model, with as many rows as the data and
    seeds of its own, and both sizes are fitted from n_init starts. All fits of all replicates and tests
    advance together: a pass draws each unit of a replicate's rows where it is needed and adds up the
    statistics of the fits that are still open; only these sums come back. A replicate that is a single
    unit is iterated within its task; samples, starts and steps are the same either way. A fit that
    fails is left out, and so is a replicate without fits of both sizes.
    """
    spark = df.sparkSession
    ks = [k for k in sorted(best) if k - 1 in best]
    if not ks:
        return spark.createDataFrame([], "k int, observed double, p double")
    unit = max(SEED_ROWS, (unit_rows or UNIT_ROWS) // SEED_ROWS * SEED_ROWS)
    units, d = -(-n // unit), best[ks[0]][1][1].shape[1]
    shared = spark.sparkContext.broadcast({k: best[k - 1][1] for k in ks})
    turns = iterations if units == 1 else 1
    starts = {}
    for k in ks:
        for b in range(n_boot):
            head = replicate_rows(best[k - 1][1], n, 0, SEED_ROWS, [seed, k, b])
            for size in (k - 1, k):
                for r in range(n_init if size > 1 else 1):
                    order = np.random.default_rng([seed, k, b, size, r, 1 << 31]).permutation(len(head))
                    if len(head) > size:
                        starts[k, b, size, r] = _start(head[order[:size]], head.var(0), size)
    open_, last, done = dict(starts), dict.fromkeys(starts, -math.inf), {}

    def advance(vector: np.ndarray, size: int, before: float) -> tuple[float, Model, bool]:
        ll, model = update(vector, size, d, n)
        return ll, model, abs(ll - before) < tolerance * n

    while open_:
        now = spark.sparkContext.broadcast((open_, last))

        def work(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            models, before = now.value
            mine: dict[tuple[int, int], list] = {}
            for m in models:
                mine.setdefault(m[:2], []).append(m)
            for batch in batches:
                out = []
                for k, b, u in batch[["k", "b", "u"]].itertuples(index=False):
                    if (k, b) not in mine:
                        continue
                    x = replicate_rows(shared.value[k], n, u * unit, (u + 1) * unit, [seed, k, b])
                    for m in mine[k, b]:
                        model, ll = models[m], before[m]
                        try:
                            for turn in range(turns):
                                vector = sums(x, model)
                                if turns > 1:
                                    ll, model, closed = advance(vector, m[2], ll)
                                    if closed or turn == turns - 1:
                                        vector = np.array([ll])
                                        break
                        except np.linalg.LinAlgError:
                            vector = np.array([np.nan])
                        out.append((*m, vector.tolist()))
                yield pd.DataFrame(out, columns=["k", "b", "size", "r", "v"])

        def added(key, rows: pd.DataFrame) -> pd.DataFrame:
            parts = list(rows["v"])
            whole = [float("nan")] if any(len(p) != len(parts[0]) for p in parts) else np.sum([np.asarray(p) for p in parts], axis=0).tolist()
            return pd.DataFrame([(*map(int, key), whole)], columns=["k", "b", "size", "r", "v"])

        index = spark.range(len(ks) * n_boot * units, numPartitions=min(len(ks) * n_boot * units, 4 * spark.sparkContext.defaultParallelism))
        dealt = index.select(F.get(F.array(*[F.lit(k) for k in ks]), F.floor(F.col("id") / (n_boot * units)).cast("int")).alias("k"), (F.floor(F.col("id") / units) % n_boot).cast("int").alias("b"), (F.col("id") % units).alias("u"))
        sums_of = dealt.mapInPandas(work, "k int, b int, size int, r int, v array<double>")
        if units > 1:
            sums_of = sums_of.groupBy("k", "b", "size", "r").applyInPandas(added, "k int, b int, size int, r int, v array<double>")
        still = {}
        for row in sums_of.collect():  # a row for each open fit
            m, vector = (row["k"], row["b"], row["size"], row["r"]), np.asarray(row["v"])
            if np.isnan(vector).any():
                continue
            if turns > 1:
                done[m] = float(vector[0])
                continue
            ll, model, closed = advance(vector, m[2], last[m])
            last[m] = ll
            if closed:
                done[m] = ll
            else:
                still[m] = model
        iterations -= turns
        if iterations <= 0:
            done.update({m: last[m] for m in still})
            still = {}
        open_ = still
    rows = []
    for k in ks:
        observed = 2 * (best[k][0] - best[k - 1][0])
        fits = [[max((done[k, b, size, r] for r in range(n_init) if (k, b, size, r) in done), default=None) for size in (k - 1, k)] for b in range(n_boot)]
        null = [2 * (big - small) for small, big in fits if small is not None and big is not None]
        rows.append((k, float(observed), (1 + sum(x >= observed for x in null)) / (len(null) + 1)))
    return spark.createDataFrame(rows, "k int, observed double, p double")


def select_k(tests: DataFrame, alpha: float) -> int:
    """The last k in a row from 2 whose test is significant, or 1 (at most a row per k)."""
    p = {r["k"]: r["p"] for r in tests.collect()}
    k = 1
    while p.get(k + 1, 1.0) < alpha:
        k += 1
    return k


def run_clustering(df: DataFrame, features: list[str], max_k: int = 4, n_init: int = 3, alpha: float = 0.05, n_boot: int = 9, min_percent: float = 0.0, rounds: int = 5) -> DataFrame:
    """Sweep, tests, chosen k and labels; clusters under min_percent are left out and all is refitted.

    Adds labels, cluster (at the chosen k), k and excluded; left-out rows keep null labels. After
    the last round, or when all clusters are small, the last result stands.
    """
    left, out = df, None
    for turn in range(rounds):
        best = gmm_sweep(left, features, list(range(1, max_k + 1)), n_init)
        n = left.count()
        k = select_k(bootstrap_lrt(left, best, n, n_boot, 2), alpha)
        labelled = assign_clusters(left, features, {j: m for j, (_, m) in best.items()})
        labelled = labelled.withColumn("cluster", F.get("labels", F.lit(k - 1))).withColumn("k", F.lit(k)).withColumn("excluded", F.lit(False))
        sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}  # k rows
        small = [c for c, m in sizes.items() if 100 * m < min_percent * n]
        if not small or len(small) == len(sizes) or turn == rounds - 1:
            return labelled if out is None else labelled.unionByName(out)
        gone = labelled.where(F.col("cluster").isin(small)).withColumn("labels", F.lit(None).cast("array<int>")).withColumn("cluster", F.lit(None).cast("int")).withColumn("excluded", F.lit(True))
        out = gone if out is None else out.unionByName(gone)
        left = labelled.where(~F.col("cluster").isin(small)).select(df.columns)
    return out


def cluster_by_condition(df: DataFrame, condition: str, features: list[str], **settings) -> DataFrame:
    """One run per condition, pooled again; rows with a null condition are a condition of their own.

    Conditions are names that people give to recordings, and each is a run of its own.
    """
    out = None
    for v in sorted((r[0] for r in df.select(condition).distinct().collect()), key=lambda v: (v is not None, v)):
        one = run_clustering(df.where(F.col(condition).eqNullSafe(v)), features, **settings)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else run_clustering(df, features, **settings)
