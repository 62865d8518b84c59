"""One-class SVM with an RBF kernel, approximated by random Fourier features.

Features phi(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi) (Rahimi & Recht
2007), gamma = 1 / (features * var(X_train)) ("scale"). The nu-SVM of Schölkopf et al. (2001)
is then a least-norm problem: w is the shortest vector among all averages of phi in which no
row weighs more than 1 / (nu n), and rho is the nu-quantile of w . phi.

The average that lies furthest against w is the mean of the rows with the lowest scores, a
share nu of them. Each step finds it by one pass over the bounded chunks of an asset (counts
and feature sums by score bin around the last boundary, exact decimal sums across chunks),
adds it to the asset's few atoms, and takes the point of least norm in their hull. Steps end
when the duality gap w . (w - atom) is below ``ocsvm_gap`` |w|^2 for every asset. Models are
rows of a DataFrame; only the number of open ones reaches the driver. W and b are
regenerated from the seed inside each task. The score is -decision = rho - w . phi(x).

An asset whose training rows fit one chunk takes the same steps within one task, so only
larger assets need a pass of jobs per step, however many assets there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.operators.ensemble import FEATURE_SLOTS
from sonolith.operators.quantiles import quantile_table
from sonolith.options import Options
from sonolith.plans.sizing import broadcast_if_small
from sonolith.session import cut_lineage, write_table

PARTIAL_SCHEMA = "asset_key string, bin int, n long, low double, high double, s array<double>"
MODEL_SCHEMA = "asset_key string, w array<double>, atoms array<double>, lo double, hi double, gap double, norm double"
SCORE_SCHEMA = "asset_key string, row_id long, score double"


def _features(seed: int, asset_seed: int, gamma: float, dim: int, x: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng([seed, asset_seed & 0x7FFFFFFF, 7])
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(len(FEATURE_SLOTS), dim))
    b = rng.uniform(0.0, 2.0 * np.pi, size=dim)
    return np.sqrt(2.0 / dim) * np.cos(x @ w + b)


# bins of the score around the last boundary; bin 0 is all below, LAST all above
BINS = 48
LAST = BINS + 1


def bin_sums(phi: np.ndarray, m: dict) -> list[tuple]:
    """(bin, rows, least and greatest score, feature sums) by score bin (above the last bin only counts)."""
    score = phi @ np.asarray(m["w"], dtype=float)
    width = max((m["hi"] - m["lo"]) / BINS, 1e-300)
    at = np.clip(np.floor((score - m["lo"]) / width) + 1, 0, LAST).astype(int)
    out = []
    for k in np.unique(at):
        own = at == k
        out.append((int(k), int(own.sum()), float(score[own].min()), float(score[own].max()), phi[own].sum(axis=0) if k < LAST else np.zeros(phi.shape[1])))
    return out


def _phi(seed: int, dim: int, rows: pd.DataFrame) -> np.ndarray:
    r0 = rows.iloc[0]
    return _features(seed, int(r0["asset_seed"]), float(r0["gamma"]), dim, rows[FEATURE_SLOTS].to_numpy(dtype=float))


def _partial(seed: int, dim: int):
    """Per chunk: row counts and feature sums by score bin."""

    def fn(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or model.empty:
            return pd.DataFrame(columns=["asset_key", "bin", "n", "low", "high", "s"], dtype=object)
        rows = rows.sort_values("row_id", kind="stable")
        out = bin_sums(_phi(seed, dim, rows), model.iloc[0].to_dict())
        return pd.DataFrame([(rows["asset_key"].iloc[0], *b[:4], b[4].tolist()) for b in out], columns=["asset_key", "bin", "n", "low", "high", "s"])

    return fn


def least_norm(atoms: np.ndarray, rounds: int = 2000, tol: float = 1e-12) -> np.ndarray:
    """Convex weights of the point of least norm in the hull of a few atoms (pairwise steps)."""
    gram = atoms @ atoms.T
    beta = np.full(len(atoms), 1.0 / len(atoms))
    for _ in range(rounds):
        grad = gram @ beta
        to = int(grad.argmin())
        away = int(np.where(beta > 0, grad, -np.inf).argmax())
        slope = grad[away] - grad[to]
        if slope <= tol * max(float(beta @ grad), 1e-300):
            break
        curve = gram[to, to] + gram[away, away] - 2 * gram[to, away]
        step = min(beta[away], slope / curve if curve > 0 else beta[away])
        beta[to] += step
        beta[away] -= step
    return beta


def advance(m: dict, bins: list[tuple], nu: float, dim: int) -> dict:
    """New model of an asset from its binned sums: the tail of the lowest scores is the next atom."""
    m, bins = dict(m), sorted(bins, key=lambda b: b[0])
    w = np.asarray(m["w"], dtype=float)
    need = nu * sum(n for _, n, *_ in bins)
    tail, left, edge = np.zeros(dim), need, float(bins[-1][3])
    for k, n, _, high, total in bins:
        if left <= 0 or k == LAST:
            break
        part = min(1.0, left / n)  # of the boundary bin every row takes the same share
        tail += part * np.asarray(total, dtype=float)
        left -= part * n
        edge = high
    low, high = float(min(b[2] for b in bins)), float(max(b[3] for b in bins))
    spread = max(high - low, 1e-9)
    at = next(b[0] for b in bins if b[3] >= edge)
    if left > 1e-9 * need or at == 0 and len(bins) > 1 and m["lo"] > low:
        # the boundary lies outside the bins: look again over the whole range
        m.update(lo=low, hi=high + 1e-12)
        if left > 1e-9 * need:
            return m
    else:
        # closer around the boundary, but no closer than it has moved
        reach = max(4 * (m["hi"] - m["lo"]) / BINS, 2 * abs(edge - (m["hi"] + m["lo"]) / 2), 1e-12 * spread)
        m.update(lo=edge - reach, hi=edge + reach)
    atom = tail / need
    gap = float(w @ (w - atom))
    m["gap"] = max(gap, 0.0)
    m["norm"] = float(w @ w)
    atoms = np.vstack([np.asarray(m["atoms"], dtype=float).reshape(-1, dim), atom])
    beta = least_norm(atoms)
    atoms, beta = atoms[beta > 0], beta[beta > 0]
    m.update(w=(beta @ atoms).tolist(), atoms=atoms.reshape(-1).tolist())
    return m


def _update(nu: float, dim: int):
    """One step of an asset whose binned sums come from many chunks."""

    def fn(bins: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if bins.empty or model.empty:
            return pd.DataFrame(columns=model.columns, dtype=object)
        m = advance(model.iloc[0].to_dict(), list(bins[["bin", "n", "low", "high", "s"]].itertuples(index=False, name=None)), nu, dim)
        m.update(w=list(m["w"]), atoms=list(m["atoms"]))
        return pd.DataFrame([m])[list(model.columns)]

    return fn


def _fit(seed: int, nu: float, dim: int, most: float):
    """All steps of an asset whose training rows are one chunk."""

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id", kind="stable")
        phi = _phi(seed, dim, rows)
        mean = (phi.sum(axis=0) / len(phi)).tolist()
        m = {"asset_key": rows["asset_key"].iloc[0], "w": mean, "atoms": mean, "lo": -2.0, "hi": 2.0, "gap": float("inf"), "norm": 1.0}
        while m["gap"] > most * m["norm"]:
            m = advance(m, bin_sums(phi, m), nu, dim)
        return pd.DataFrame([m])

    return fn


def _score(seed: int, dim: int):
    def fn(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or model.empty:
            return pd.DataFrame({"asset_key": [], "row_id": [], "score": []})
        phi = _phi(seed, dim, rows)
        w = np.asarray(model["w"].iloc[0], dtype=float)
        return pd.DataFrame({"asset_key": rows["asset_key"].iloc[0], "row_id": rows["row_id"].to_numpy(), "score": phi @ w})

    return fn


def _chunked(rows: DataFrame, counts: DataFrame, chunk_rows: int, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows keyed by (asset_key, chunk) with bounded chunks, and the chunk-key table."""
    n_chunks = counts.select("asset_key", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(chunk_rows))).cast("long").alias("n_chunks"))
    n_chunks = broadcast_if_small(cut_lineage(n_chunks), max_rows)
    keyed = rows.join(n_chunks, "asset_key").withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.col("n_chunks"))).drop("n_chunks")
    keys = n_chunks.select("asset_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk"))
    return keyed, keys


def _cogroup(rows: DataFrame, model_rep: DataFrame, fn, schema: str) -> DataFrame:
    m = model_rep.select(*[F.col(c).alias(c) for c in model_rep.columns])
    return rows.groupBy("asset_key", "chunk").cogroup(m.groupBy("asset_key", "chunk")).applyInPandas(fn, schema)


def _fit_chunks(train: DataFrame, counts: DataFrame, opts: Options) -> DataFrame:
    """Models of the assets in ``counts``: one pass over the chunks of their training rows per step."""
    s3, scale = opts.stage3, opts.scale
    dim, nu, seed = s3.ocsvm_features, s3.clamped_nu, s3.random_state
    train, train_keys = _chunked(train, counts, scale.chunk_rows, scale.broadcast_max_rows)
    # hash-partitioned like the co-group needs; the checkpoint keeps that
    # partitioning, so no step re-shuffles the training rows
    train = cut_lineage(train.repartition("asset_key", "chunk"))

    def binned(model: DataFrame) -> DataFrame:
        """Exact sums (decimal) over the chunks, so that their order does not matter."""
        rep = train_keys.join(model.select("asset_key", "w", "lo", "hi"), "asset_key")
        parts = cut_lineage(_cogroup(train, rep, _partial(seed, dim), PARTIAL_SCHEMA))
        sums = parts.select("asset_key", "bin", F.posexplode("s").alias("i", "v")).groupBy("asset_key", "bin", "i").agg(F.sum(F.col("v").cast("decimal(38,15)")).cast("double").alias("v"))
        sums = sums.groupBy("asset_key", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))  # dim values
        counts = parts.groupBy("asset_key", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        return counts.join(sums, ["asset_key", "bin"])

    # start from all rows' mean: with w = 0 every score is 0 and falls into one bin
    zeros = F.array_repeat(F.lit(0.0), dim)
    whole = binned(counts.select("asset_key", zeros.alias("w"), F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi")))
    mean = whole.groupBy("asset_key").agg(F.sum("n").alias("n"), F.first("s").alias("s")).select("asset_key", F.transform("s", lambda v: v / F.col("n")).alias("w"))
    model = write_table(mean.select("asset_key", "w", F.col("w").alias("atoms"), F.lit(-2.0).alias("lo"), F.lit(2.0).alias("hi"), F.lit(float("inf")).alias("gap"), F.lit(1.0).alias("norm")), "ocsvm-model")
    while model.where(F.col("gap") > F.lit(s3.ocsvm_gap) * F.col("norm")).limit(1).count():
        open_ = F.col("gap") > F.lit(s3.ocsvm_gap) * F.col("norm")
        todo = model.where(open_)
        step = binned(todo).groupBy("asset_key").cogroup(todo.groupBy("asset_key")).applyInPandas(_update(nu, dim), MODEL_SCHEMA)
        model = write_table(step.unionByName(model.where(~open_)), "ocsvm-model")
    return model


def ocsvm_scores(df: DataFrame, plan: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """(keys, row_id, ocsvm) for every valid row."""
    keys = list(keys)
    s3 = opts.stage3
    dim, nu, seed = s3.ocsvm_features, s3.clamped_nu, s3.random_state
    mx = opts.scale.broadcast_max_rows
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys])
    p = plan.select(*keys, key.alias("asset_key"), F.xxhash64(key).alias("asset_seed"), "n_features")
    base = df.select(*keys, "row_id", "stage3_train", "stage3_valid", *FEATURE_SLOTS).join(broadcast_if_small(p, mx), keys, "inner")
    # gamma = 1 / (n_features * var(all training entries of the real features))
    real = [F.when(F.lit(i) < F.col("n_features"), F.col(f)) for i, f in enumerate(FEATURE_SLOTS)]
    sq = sum((F.coalesce(r * r, F.lit(0.0)) for r in real), F.lit(0.0))
    sm = sum((F.coalesce(r, F.lit(0.0)) for r in real), F.lit(0.0))
    g = base.where(F.col("stage3_train")).groupBy("asset_key").agg(
        F.sum(sq).alias("_sq"), F.sum(sm).alias("_sm"), F.sum(F.col("n_features")).alias("_cnt"),
        F.first("n_features").alias("_d"), F.count(F.lit(1)).alias("n"),
    )
    var = F.col("_sq") / F.col("_cnt") - (F.col("_sm") / F.col("_cnt")) ** 2
    g = cut_lineage(g.select("asset_key", "n", (F.lit(1.0) / (F.col("_d") * F.when(var > 0, var).otherwise(F.lit(1.0)))).alias("gamma")))
    base = base.join(broadcast_if_small(g.select("asset_key", "gamma"), mx), "asset_key", "inner")
    cols = ["asset_key", "asset_seed", "gamma", "row_id", *FEATURE_SLOTS]
    train = base.where(F.col("stage3_train")).select(*cols)
    one, many = (g.where(F.col("n") <= opts.scale.chunk_rows), g.where(F.col("n") > opts.scale.chunk_rows))
    within = train.join(broadcast_if_small(one.select("asset_key"), mx), "asset_key", "left_semi")
    model = write_table(within.groupBy("asset_key").applyInPandas(_fit(seed, nu, dim, s3.ocsvm_gap), MODEL_SCHEMA), "ocsvm-model")
    if not many.isEmpty():
        model = model.unionByName(_fit_chunks(train, many, opts))

    def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
        chunks, chunk_keys = _chunked(rows.select(*cols), counts, opts.scale.chunk_rows, mx)
        return _cogroup(chunks, chunk_keys.join(model.select("asset_key", "w"), "asset_key"), _score(seed, dim), SCORE_SCHEMA)

    counts_valid = base.where(F.col("stage3_valid")).groupBy("asset_key").agg(F.count(F.lit(1)).alias("n"))
    valid = write_table(scored(base.where(F.col("stage3_valid")), counts_valid), "ocsvm")
    in_training = base.where(F.col("stage3_train")).select("asset_key", "row_id")
    rho = quantile_table(valid.join(in_training, ["asset_key", "row_id"], "left_semi"), ["asset_key"], [("score", nu, "rho")], opts)
    out = valid.join(rho, "asset_key").join(p.select(*keys, "asset_key"), "asset_key", "inner")
    return out.select(*keys, "row_id", (F.col("rho") - F.col("score")).alias("ocsvm"))
