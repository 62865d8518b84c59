"""Properties of the Stage-2/3 models (random detectors cannot match bit for bit)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sonolith.operators.ensemble import FEATURE_SLOTS
from sonolith.options import Options, Stage3Options


def _frame(spark, n=600, seed=1, outliers=12):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, len(FEATURE_SLOTS)))
    x[:, :4] = rng.normal(size=(n, 4))
    x[:outliers, :4] += 7.0
    pdf = pd.DataFrame(x, columns=FEATURE_SLOTS)
    pdf.insert(0, "row_id", np.arange(n, dtype=np.int64))
    pdf.insert(0, "asset_id", "a")
    pdf["stage3_train"] = True
    pdf["stage3_valid"] = True
    plan = spark.createDataFrame([("a", n, n, 4)], "asset_id string, n_train long, n_valid long, n_features int")
    return spark.createDataFrame(pdf), plan


def test_iforest_pool_sampling_and_chunks(spark):
    """Small sub-samples force the hash-threshold pool, many trees per pool and
    several scoring chunks per asset."""
    from sonolith.operators.iforest import iforest_scores
    from sonolith.options import ScaleOptions

    df, plan = _frame(spark)
    opts = Options(stage3=Stage3Options(iforest_trees=30, iforest_max_samples=8), scale=ScaleOptions(chunk_rows=100))
    s = {r.row_id: r.iforest_s for r in iforest_scores(df, plan, opts).collect()}
    assert len(s) == 600
    out = np.array([s[i] for i in range(12)])
    inl = np.array([s[i] for i in range(12, 600)])
    assert np.median(out) > np.quantile(inl, 0.9)


def test_iforest_samples_are_independent(spark):
    """Every tree has m rows of its own, also where the pool is not much larger than m."""
    from sonolith.operators.iforest import tree_samples

    for n, trees in ((512, 200), (30_000, 40), (100, 5)):
        opts = Options(stage3=Stage3Options(iforest_trees=trees))
        m = min(256, n)
        rows = spark.range(n).select(F.lit("a").alias("asset_id"), F.col("id").alias("row_id"), *[F.lit(0.0).alias(f) for f in FEATURE_SLOTS])
        plan = spark.createDataFrame([("a", "a", m, n)], "asset_id string, asset_key string, m long, n_train long")
        pdf = tree_samples(rows, plan, opts, ["asset_id"]).select("tree", "row_id").toPandas()
        samples = {t: frozenset(g) for t, g in pdf.groupby("tree")["row_id"]}
        assert sorted(samples) == list(range(trees)) and all(len(x) == m for x in samples.values()) and len(pdf) == m * trees
        assert len(set(samples.values())) == (1 if n == m else trees)
        if n > m:  # two trees share m * m / n rows on average
            shared = np.mean([len(samples[t] & samples[t + 1]) for t in range(trees - 1)])
            assert abs(shared - m * m / n) < 0.1 * m * m / n + 2
            uses = pdf.groupby("row_id").size().reindex(range(n), fill_value=0)
            assert abs(uses.mean() - m * trees / n) < 1e-9 and uses.var() < 1.3 * m * trees / n


def test_iforest_ranks_planted_outliers(spark):
    from sonolith.operators.iforest import iforest_scores

    df, plan = _frame(spark)
    opts = Options(stage3=Stage3Options(iforest_trees=60))
    s = {r.row_id: r.iforest_s for r in iforest_scores(df, plan, opts).collect()}
    out = np.array([s[i] for i in range(12)])
    inl = np.array([s[i] for i in range(12, 600)])
    assert out.min() > np.quantile(inl, 0.95)
    assert all(0 < v <= 1 for v in s.values())
    again = {r.row_id: r.iforest_s for r in iforest_scores(df.repartition(3), plan, opts).collect()}
    assert again == s  # seeded: independent of partitioning


def _dense_ocsvm(phi, nu, steps=20_000):
    """Frank-Wolfe with exact steps over all rows."""
    n = len(phi)
    w = phi.mean(axis=0)
    for _ in range(steps):
        score = phi @ w
        order = np.argsort(score, kind="stable")
        weight = np.zeros(n)
        k = int(nu * n)
        weight[order[:k]] = 1.0 / (nu * n)
        if k < n:
            weight[order[k]] = 1.0 - weight.sum()
        atom = weight @ phi
        gap = w @ (w - atom)
        if gap <= 1e-7 * (w @ w):
            break
        w = w + min(1.0, gap / ((w - atom) @ (w - atom))) * (atom - w)
    return w


def test_ocsvm_against_a_dense_solver(spark):
    from pyspark.sql import functions as F

    from sonolith.operators.ocsvm import _features, ocsvm_scores
    from sonolith.options import ScaleOptions

    n, nu = 500, 0.1
    df, plan = _frame(spark, n=n)
    opts = Options(stage3=Stage3Options(one_class_nu=nu), scale=ScaleOptions(chunk_rows=128))
    s = {r.row_id: r.ocsvm for r in ocsvm_scores(df, plan, opts).collect()}
    got = np.array([s[i] for i in range(n)])
    x = df.orderBy("row_id").toPandas()[FEATURE_SLOTS].to_numpy()
    real = x[:, :4]
    asset_seed = spark.range(1).select(F.xxhash64(F.lit("a"))).first()[0]
    phi = _features(opts.stage3.random_state, asset_seed, 1.0 / (4 * real.var()), opts.stage3.ocsvm_features, x)
    w = _dense_ocsvm(phi, nu)
    want = -(phi @ w)
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(got), rank(want))[0, 1] >= 0.99
    top = max(1, n // 100)
    assert len(set(np.argsort(-got)[:top]) & set(np.argsort(-want)[:top])) >= 0.8 * top
    assert abs((got > 1e-12).mean() - nu) <= 1.5 / n


def test_ocsvm_steps_of_small_assets_stay_in_one_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sonolith.operators import ocsvm
    from sonolith.options import ScaleOptions

    df, plan = _frame(spark)
    names = F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("asset_id")
    df = df.drop("asset_id").select(names, "*").withColumn("f0", F.col("f0") + F.when(F.col("asset_id") == "b", F.sin("row_id")).otherwise(0.0))
    plan = plan.drop("asset_id").select(names, "*")
    written = []
    monkeypatch.setattr(ocsvm, "write_table", lambda d, name="table", f=ocsvm.write_table: (written.append(name), f(d, name))[1])
    got = {(r.asset_id, r.row_id): r.ocsvm for r in ocsvm.ocsvm_scores(df, plan, Options()).collect()}
    assert written.count("ocsvm-model") == 1  # no pass of jobs per step, however many assets
    one = df.where("asset_id = 'b'"), plan.where("asset_id = 'b'")
    chunks = {r.row_id: r.ocsvm for r in ocsvm.ocsvm_scores(*one, Options(scale=ScaleOptions(chunk_rows=128))).collect()}
    assert len(got) == 3 * len(chunks) and written.count("ocsvm-model") > 2
    assert all(abs(v - got["b", i]) < 1e-9 for i, v in chunks.items())  # many chunks take the same steps


def _plain_tree(x, node, depth, most, draws):
    """Path length of each row of a tree grown node by node."""
    from sonolith.operators.iforest import path_units

    lo, hi = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(4), np.zeros(4))
    varying = np.flatnonzero(hi > lo)
    if depth == most or not len(varying):
        return np.full(len(x), depth + float(path_units(len(x))))
    which, where = draws(node)
    f = int(varying[int(which * len(varying))])
    left = x[:, f] <= lo[f] + where * (hi[f] - lo[f])
    out = np.zeros(len(x))
    out[left], out[~left] = (_plain_tree(x[s], 2 * node + k, depth + 1, most, draws) for k, s in ((0, left), (1, ~left)))
    return out


def test_forest_grows_whole_trees_together(spark):
    from sonolith.operators.iforest import _node_draws, grow_trees, iforest_scores, path_sums

    rng = np.random.default_rng(3)
    x = rng.normal(size=(64, 4)).round(1)
    x[:20] = x[0]  # equal rows end in one leaf
    x[:, 3] = 1.0
    trees = np.array([2, 5, 9])
    out = grow_trees(np.tile(x, (3, 1)), np.repeat(trees, 64), 7, "a", 64)
    want = sum(_plain_tree(x, 1, 0, 6, lambda node, t=t: _node_draws(7, "a", t, node)) for t in trees.tolist())
    assert out.pop("roots") == 3 and (path_sums(x, 3, **out) == want).all()
    # draws are not spread out to a row per tree and ranked by a window
    df, plan = _frame(spark)
    assert "Window" not in iforest_scores(df, plan, Options())._jdf.queryExecution().toString()


def test_least_norm_point():
    from sonolith.operators.ocsvm import least_norm

    atoms = np.array([[2.0, 1.0], [2.0, -1.0], [5.0, 0.0]])
    assert np.allclose(least_norm(atoms) @ atoms, [2.0, 0.0], atol=1e-6)


def test_pca_matches_numpy_svd(spark):
    from pyspark.sql import functions as F

    from sonolith.operators.multivariate import pca_components

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    x = (x - x.mean(0)) / x.std(0)
    pdf = pd.DataFrame(x, columns=[f"z_c{i}" for i in range(4)])
    pdf.insert(0, "asset_id", "a")
    comps = pca_components(spark.createDataFrame(pdf), [f"c{i}" for i in range(4)], ["asset_id"]).first()
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    for c in (1, 2):
        got = np.array([comps[f"pc{c}_w{i}"] for i in range(4)])
        assert np.allclose(np.abs(got), np.abs(vt[c - 1]), atol=1e-8)
        assert got[np.argmax(np.abs(got))] > 0


def test_training_flag_share_near_contamination(spark):
    from pyspark.sql import functions as F

    from sonolith.operators.ensemble import combine, thresholds_and_norms

    df, _ = _frame(spark, outliers=0)
    rng = np.random.default_rng(2)
    scores = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(600), "u": rng.random(600)}))
    d = df.join(scores, "row_id").withColumns({f"stage3_{m}_score": F.col("u") for m in ("iforest", "lof", "ocsvm")})
    opts = Options()
    out = combine(d, thresholds_and_norms(d, ("iforest", "lof", "ocsvm"), opts), ("iforest", "lof", "ocsvm"), opts)
    share = out.where(F.col("stage3_lof_flag")).count() / 600
    assert abs(share - opts.stage3.clamped_contamination) <= 0.005
