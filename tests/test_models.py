"""Models: planted signals, brute-force twins and additivity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bankspark.ml import anomaly as A
from bankspark.ml import clusters as K
from bankspark.ml import metrics as M
from bankspark.ml import shap as H
from bankspark.ml import supervised as S
from bankspark.ml.dbscan import dbscan
from bankspark.ml.naive_bayes import NaiveBayes


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    label = (rng.uniform(size=1500) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1])))).astype(int)
    data = [(i, int(label[i]), *map(float, x[i]), "abc"[int(x[i, 0] > 0)]) for i in range(1500)]
    return spark.createDataFrame(data, "id BIGINT, label INT, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE, kind STRING").persist()


FEATURES = ["x0", "x1", "x2"]


def auc_of(df):
    return M.auc(df, "label", "predicted_prob").first()["auc"]


def test_boosting_finds_signal_and_shap_adds_up(planted):
    train, test = planted.filter("id < 1100"), planted.filter("id >= 1100")
    model = S.fit_boosting(train, FEATURES, "label", rounds=8)
    assert auc_of(S.predict(model, test, FEATURES)) > 0.8
    parts = H.shap_values(model, test, FEATURES, ["id"])
    prob = {r["id"]: r["predicted_prob"] for r in S.predict(model, test, FEATURES).collect()}
    for r in parts.collect():
        total = r["base_value"] + sum(r[f"shap_{f}"] for f in FEATURES)
        assert 1 / (1 + np.exp(-total)) == pytest.approx(prob[r["id"]], abs=1e-9)
    mean = {r["feature"]: r["mean_abs_shap"] for r in H.mean_absolute(H.shap_long(parts, FEATURES, ["id"])).collect()}
    assert mean["x0"] > mean["x2"] and mean["x1"] > mean["x2"]


def test_shap_pattern_values_match_definition():
    from itertools import permutations

    shares = np.array([0.3, 0.8, 0.5])
    table = H._pattern_values(shares)
    for pattern in range(8):
        met = [(pattern >> j) & 1 for j in range(3)]

        def worth(s):
            return np.prod([met[j] if j in s else shares[j] for j in range(3)])

        want = np.zeros(3)
        for order in permutations(range(3)):
            seen = set()
            for f in order:
                want[f] += (worth(seen | {f}) - worth(seen)) / 6
                seen = seen | {f}
        assert table[pattern] == pytest.approx(want)


def test_forest_importance_ranks_signal(planted):
    train, test = planted.filter("id < 1100"), planted.filter("id >= 1100")
    model = S.fit_forest(train, FEATURES, "label", trees=20, per_split="2")
    loss = {r["feature"]: r["accuracy_loss"] for r in S.permutation_importance(model, test, FEATURES, "label", "id").collect()}
    assert loss["x0"] > 0.05 and loss["x0"] > loss["x2"]


def test_logistic_recovers_coefficients(planted, spark):
    model, scales = S.fit_logistic(planted, FEATURES, "label")
    got = {r["term"]: r for r in S.coefficients(model, scales, FEATURES, spark).collect()}
    assert got["x0"]["conf_low"] < 2 < got["x0"]["conf_high"]
    assert got["x1"]["conf_low"] < -1.5 < got["x1"]["conf_high"]
    vif = S.variance_inflation(model, scales, planted, FEATURES, {f: [f] for f in FEATURES}).collect()
    assert all(0.9 < r["gvif"] < 1.6 for r in vif)
    ratio = {r["term"]: r["odds_ratio"] for r in S.odds_ratios(S.coefficients(model, scales, FEATURES, spark)).collect()}
    assert ratio["x0"] == pytest.approx(np.exp(got["x0"]["estimate"]))


def test_naive_bayes_beats_chance(planted):
    train, test = planted.filter("id < 1100"), planted.filter("id >= 1100")
    model = NaiveBayes.fit(train, "label", ["x1", "x2"], ["kind"])
    assert auc_of(model.predict(test)) > 0.8


@pytest.fixture(scope="module")
def outliers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    x[:10] += 9
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id BIGINT, a DOUBLE, b DOUBLE, c DOUBLE").persist()


def test_isolation_forest_ranks_outliers_first(outliers):
    forest = A.fit_isolation_forest(outliers, "id", ["a", "b", "c"], trees=50)
    assert forest.groupBy("tree").count().count() == 50
    top = A.isolation_scores(forest, outliers, ["a", "b", "c"]).orderBy(F.desc("iso_anomaly_score")).limit(20)
    assert {r["id"] for r in top.collect()} >= set(range(10))


def test_autoencoder_learns_and_flags_outliers(outliers):
    flat = outliers.select("id", "a", (F.col("a") * 2).alias("b"), F.when(F.col("id") < 10, -F.col("a")).otherwise(F.col("a")).alias("c"))
    from bankspark.operators.columns import standardise

    scaled = standardise(flat, ["a", "b", "c"])
    weights = A.fit_autoencoder(scaled, ["a", "b", "c"])
    errors = A.reconstruction_error(weights, scaled, ["a", "b", "c"])
    normal = errors.filter("id >= 10").agg(F.avg("ae_reconstruction_error")).first()[0]
    odd = errors.filter("id < 10").agg(F.avg("ae_reconstruction_error")).first()[0]
    assert normal < 0.3 and odd > 3 * normal


def test_kmeans_and_ward_recover_blobs(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]])
    data = [(i, *map(float, centres[i % 4] + rng.normal(size=2) * 0.5)) for i in range(400)]
    df = spark.createDataFrame(data, "id BIGINT, x DOUBLE, y DOUBLE").persist()
    model = K.fit_kmeans(df, ["x", "y"], starts=5)
    for labels, name in ((K.kmeans_labels(model, df, ["x", "y"]), "kmeans_cluster"), (K.ward_labels(df, ["x", "y"], leaves=40), "hc_cluster")):
        pairs = labels.select((F.col("id") % 4).alias("t"), name).distinct().collect()
        assert len(pairs) == 4 and {r[1] for r in pairs} == {1, 2, 3, 4}


def test_kmeans_starts_are_what_they_are_alone(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(80, 3)) + c for c in (0, 3, 6, 10)])
    df, columns = points_of(spark, x)
    model = K.fit_kmeans(df, columns, k=4, starts=5, seed=3)
    rows = df.select(F.array(*columns).alias("x"))
    costs = []
    for first in K._random_rows(rows, 4, 5, 3):
        assert len({tuple(c) for c in first}) == 4 and all((x == c).all(axis=1).any() for c in first)
        centres = first.copy()
        for _ in range(20):
            at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([x[at == j].mean(axis=0) if (at == j).any() else centres[j] for j in range(4)])
        costs.append(((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum())
    assert model.costs == pytest.approx(costs)
    got = K.kmeans_labels(model, df, columns).collect()
    order = np.array(sorted(map(tuple, model.centres)))
    assert all(r["kmeans_cluster"] == ((order - x[r["id"]]) ** 2).sum(axis=1).argmin() + 1 for r in got)
    assert K.fit_kmeans(df.limit(0), columns).costs == ()


def plain_ward(x, k):
    """Ward's method row by row: the cheapest of all merges each time."""
    groups = [[i] for i in range(len(x))]
    mean, size = [x[i] for i in range(len(x))], [1] * len(x)
    while len(groups) > k:
        m, n = np.array(mean), np.array(size)
        cost = ((m[:, None] - m[None]) ** 2).sum(axis=2) * (n[:, None] * n[None] / (n[:, None] + n[None]))
        np.fill_diagonal(cost, np.inf)
        a, b = sorted(np.unravel_index(cost.argmin(), cost.shape))
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        groups[a] += groups[b]
        for kept in (groups, mean, size):
            del kept[b]
    return {frozenset(g) for g in groups}


def points_of(spark, x):
    columns = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns)).repartition(5), columns


def test_ward_is_the_plain_method_where_every_row_is_a_leaf(spark):
    x = np.random.default_rng(8).normal(size=(150, 3))
    df, columns = points_of(spark, x)
    model = K.fit_ward(df, columns, k=5, leaves=150)
    found = {}
    for r in K.ward_predict(model, df, columns).collect():
        found.setdefault(r["hc_cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in found.values()} == plain_ward(x, 5) and set(found) == set(range(1, 6))
    assert model.within < 1e-9
    means = [x[sorted(found[k])].mean(axis=0).tolist() for k in sorted(found)]
    assert means == sorted(means)


def test_ward_cost_is_within_its_bound(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(2500, 2)) * s + c for s, c in ((1, 0), (0.5, 4), (2, 9), (0.2, -6))])
    df, columns = points_of(spark, x)
    model = K.fit_ward(df, columns, k=4, leaves=200)
    assert len(model.centres) <= 200
    label = {r["id"]: r["hc_cluster"] for r in K.ward_predict(model, df, columns).collect()}
    sse = lambda groups: sum(((x[g] - x[g].mean(axis=0)) ** 2).sum() for g in groups)
    own = sse([np.array([i for i in label if label[i] == k]) for k in range(1, 5)])
    assert own == pytest.approx(model.cost)
    plain = K._ward(x, np.ones(len(x)), 4)  # all rows as leaves
    assert np.sqrt(own) <= np.sqrt(sse([np.flatnonzero(plain == k) for k in range(4)])) + 2 * np.sqrt(model.within)


def test_logistic_scores_keep_rows_with_nulls(spark):
    from bankspark.ml import supervised as S

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    rows = [(i, float(a), float(b), float(rng.random() < 1 / (1 + np.exp(-a)))) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id INT, a DOUBLE, b DOUBLE, y DOUBLE")
    model, scales = S.fit_logistic(df, ["a", "b"], "y")
    odd = df.unionByName(spark.createDataFrame([(900, None, 1.0, 1.0), (901, 1.0, float("nan"), 0.0)], df.schema))
    got = {r["id"]: r["predicted_prob"] for r in S.predict_logistic(model, scales, odd, ["a", "b"]).collect()}
    assert len(got) == 302 and got[900] is None and got[901] is None and all(0 < got[i] < 1 for i in range(300))


def test_profile_intervals_equal_a_plain_search(spark):
    from bankspark.ml import profile_likelihood as PL

    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=(250, 2)), rng.random(250) < 0.3]).astype(float)
    y = (rng.random(250) < 1 / (1 + np.exp(-(x @ [1.5, -0.4, 0.8] - 1)))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0)], "a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")
    scales = {"a": 1.0, "b": 2.0, "c": 1.0}
    found = PL.profile(PL.design(df, scales, ["a", "b", "c"], "y"), np.zeros(4))
    full = np.column_stack([x / [1, 2, 1], np.ones(250)])

    def best(matrix, offset):
        beta = np.zeros(matrix.shape[1])
        for _ in range(60):
            eta = matrix @ beta + offset
            mu = 1 / (1 + np.exp(-eta))
            beta = beta + np.linalg.solve(matrix.T @ (matrix * (mu * (1 - mu))[:, None]), matrix.T @ (y - mu))
        eta = matrix @ beta + offset
        return (y * eta - np.logaddexp(0, eta)).sum(), beta

    top, beta = best(full, 0)
    assert found.top == pytest.approx(top) and found.best == pytest.approx(beta, abs=1e-6)
    for j in range(4):
        others = np.delete(full, j, axis=1)
        for k, sign in ((0, -1), (1, 1)):
            inside = lambda v: best(others, full[:, j] * (beta[j] + sign * v))[0] > top - PL.HALF_CHI_SQUARE  # noqa: B023, E731
            low, high = 0.0, 0.05
            while inside(high):
                low, high = high, 1.3 * high
            for _ in range(40):
                middle = (low + high) / 2
                low, high = (middle, high) if inside(middle) else (low, middle)
            assert found.points[j, k, j] == pytest.approx(beta[j] + sign * low, abs=1e-4)


def test_profile_of_separated_classes_has_no_bound(spark):
    from bankspark.ml import profile_likelihood as PL

    df = spark.createDataFrame([(float(i), float(i >= 10)) for i in range(20)], "a DOUBLE, y DOUBLE")
    found = PL.profile(PL.design(df, {"a": 5.0}, ["a"], "y"), np.zeros(2), steps=12)
    assert np.isnan(found.points).any()


def test_ward_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 1.0), (5, 9.0)], "id BIGINT, x DOUBLE")
    got = {r["id"]: r["hc_cluster"] for r in K.ward_labels(df, ["x"], k=4).collect()}
    assert got == {1: 1, 2: None, 3: None, 4: 1, 5: 2}
    assert K.ward_labels(df.limit(0), ["x"]).collect() == []


def brute_dbscan(x, eps, min_points):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_points
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    return core, label


@pytest.mark.parametrize("d, eps, fan, leaf", [(2, 0.5, 3, 4), (3, 0.6, 32, 256), (6, 1.1, 5, 8), (64, 4.3, 4, 16)])
def test_dbscan_equals_brute_force(spark, d, eps, fan, leaf):
    rng = np.random.default_rng(11)
    x = np.concatenate([
        rng.normal(size=(120, d)) * 0.4, rng.normal(size=(120, d)) * 0.3 + 3, rng.uniform(-4, 7, size=(60, d)),
        np.tile(rng.normal(size=(1, d)) + 6, (100, 1)),  # a hundred copies of one row
        rng.normal(size=(60, d)) * 0.01 * eps / d - 5,  # a crowded place: all rows within eps
    ])
    columns = [f"c{i}" for i in range(d)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    odd = [(len(x), *[None] * d), (len(x) + 1, *[float("nan")] * d), (len(x) + 2, *[float("inf")] * d)]
    df = spark.createDataFrame(rows + odd, "id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns))
    got = {r["id"]: r for r in dbscan(df, "id", columns, eps, 5, fan, leaf).collect()}
    core, label = brute_dbscan(x, eps, 5)
    assert core.any() and not core.all()
    assert [got[i]["core"] for i in range(len(x))] == list(core)
    assert not any(got[r[0]]["core"] or got[r[0]]["dbscan_cluster"] for r in odd) and len(got) == len(rows) + 3
    # clusters are numbered by their lowest row; a border row takes the lowest number in reach
    number = {v: k + 1 for k, v in enumerate(sorted(set(label[core])))}
    assert [got[i]["dbscan_cluster"] for i in range(len(x))] == [number.get(v, 0) for v in label]


def test_ball_pairs_decide_a_crowded_place(spark):
    from bankspark.ml.dbscan import comparison_report

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 8)) * 0.01, rng.uniform(-50, 50, size=(1000, 8))])
    columns = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns))
    report = comparison_report(df, "id", columns, eps=1.0, fan=8, leaf=32).first()
    assert report["points"] == 4000 and report["all_pairs"] == 4000 * 3999 // 2
    assert report["sure_pairs"] > 0 and report["compared_pairs"] < report["all_pairs"] / 15


def test_dbscan_of_noise_only(spark):
    df = spark.createDataFrame([(i, float(i * 10)) for i in range(12)], "id BIGINT, x DOUBLE")
    got = dbscan(df, "id", ["x"], 1.0, 3).collect()
    assert len(got) == 12 and not any(r["core"] or r["dbscan_cluster"] for r in got)


def test_dbscan_compares_only_what_is_not_yet_known(spark, monkeypatch):
    from bankspark.ml import dbscan as B

    rng = np.random.default_rng(2)
    # a crowd without surely near balls, chains that cross blocks, and rows on their own
    x = np.concatenate([
        rng.normal(size=(1200, 6)) * 0.5, np.arange(60)[:, None] * 0.2 + np.tile([20.0, 0, 0, 0, 0, 0], (60, 1)),
        rng.uniform(-40, 40, size=(60, 6)),
    ])
    monkeypatch.setattr(B, "BLOCK", 100)
    monkeypatch.setattr(B, "PROBES", 2)
    met, compared = [], B.Blocks.compared

    def spy(blocks, columns, work, out):
        met.append((work.__name__, blocks.own.count(), blocks.met.count()))
        return compared(blocks, columns, work, out)

    monkeypatch.setattr(B.Blocks, "compared", spy)
    columns = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns))
    got = {r["id"]: r for r in dbscan(df, "id", columns, 1.2, 5, 8, 32).collect()}
    core, label = brute_dbscan(x, 1.2, 5)
    number = {v: k + 1 for k, v in enumerate(sorted(set(label[core])))}
    assert [got[i]["core"] for i in range(len(x))] == list(core)
    assert [got[i]["dbscan_cluster"] for i in range(len(x))] == [number.get(v, 0) for v in label]
    assert [m[0] for m in met] == ["_weights", "_weights", "_together", "_touching", "_touching", "_lowest"]
    first, last = met[0], met[1]
    assert 0 < last[1] < first[1] / 2  # most rows know enough after a few blocks
    assert met[4][1] < core.sum() / 2  # only rows outside the largest cluster look for others


def test_autoencoder_reads_blocks_of_rows(spark):
    df = spark.range(40_000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    blocks = A._in_blocks(df.coalesce(1)).select(F.size("x").alias("n")).collect()
    assert sum(r["n"] for r in blocks) == 80_000 and len(blocks) <= 3
    whole = A._in_blocks(df.coalesce(1)).first()["x"]
    assert whole[:6] == [0.0, 0.0, 1.0, 1.0, 2.0, 2.0]


def test_large_tables_are_spread_over_tasks_of_bounded_rows(spark):
    from bankspark.session import spread

    df = spark.range(1000).withColumn("k", F.col("id") % 10).groupBy("id", "k").count()
    assert spread(df, 1000, "id", rows=1000) is df
    dealt = spread(df, 1000, "id", rows=100)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert dealt.count() == 1000 and len(sizes) == 10 and max(r["count"] for r in sizes) < 200


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "label INT, p DOUBLE")
    assert M.auc(df, "label", "p").first()["auc"] is None


def test_components_of_a_chain(spark):
    nodes = spark.range(60).select("id")
    edges = spark.range(59).filter("id <> 29").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = K.connected_components(nodes, edges).collect()
    assert {r["id"]: r["label"] for r in got} == {i: (0 if i < 30 else 30) for i in range(60)}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label INT, p DOUBLE")
    assert M.auc(df, "label", "p").first()["auc"] == 0.875
    ranks = {r["p"]: r["avg_rank"] for r in M.average_ranks(df, "p").collect()}
    assert ranks == {0.1: 1.0, 0.5: 2.5, 0.9: 4.0}


def test_positive_class_is_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9), (0, 0.2), (1, 0.9)], "label INT, p DOUBLE")
    r = M.confusion(df, "label", "p").first()
    assert r["sensitivity"] == pytest.approx(2 / 3, abs=1e-8) and r["specificity"] == 1.0


def test_scoring_keeps_rows_with_nulls(spark):
    from bankspark.ml import supervised as S

    data = [(i, float(i % 7), None if i % 5 == 0 else float(i % 3), i % 2) for i in range(50)]
    df = spark.createDataFrame(data, "id BIGINT, a DOUBLE, b DOUBLE, y INT")
    scored = S.predict(S.fit_tree(df, ["a", "b"], "y"), df, ["a", "b"])
    assert scored.count() == 50 and scored.filter("predicted_prob IS NULL AND predicted_class IS NULL").count() == 10
    labels = K.kmeans_labels(K.fit_kmeans(df, ["a", "b"], k=2, starts=2), df, ["a", "b"])
    assert labels.count() == 50 and labels.filter("kmeans_cluster IS NULL").count() == 10
    assert K.principal_components(df, "id", ["a", "b"], 1).filter("pc1 IS NULL").count() == 10
    assert K.ward_labels(df, ["a", "b"], k=2, leaves=5).filter("hc_cluster IS NULL").count() == 10


def test_ward_with_a_centre_per_row_is_wards_method(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id BIGINT, a DOUBLE, b DOUBLE")
    got = {r["id"]: r["hc_cluster"] for r in K.ward_labels(df, ["a", "b"], k=3, leaves=12).collect()}
    want = K._ward(x, np.ones(12), 3)
    pairs = {(got[i], int(want[i])) for i in range(12)}
    assert len(pairs) == 3


def test_isolation_score_of_noise_is_near_a_half(spark):
    rng = np.random.default_rng(1)
    for n in (60, 3000):
        df = spark.createDataFrame([(i, *map(float, rng.uniform(size=2))) for i in range(n)], "id BIGINT, a DOUBLE, b DOUBLE")
        forest = A.fit_isolation_forest(df, "id", ["a", "b"], trees=50)
        mean = A.isolation_scores(forest, df, ["a", "b"]).agg(F.avg("iso_anomaly_score")).first()[0]
        assert 0.42 < mean < 0.54


def test_autoencoder_does_not_depend_on_partitions(outliers):
    from bankspark.operators.columns import standardise

    scaled = standardise(outliers, ["a", "b", "c"])
    one = A.fit_autoencoder(scaled.coalesce(1), ["a", "b", "c"], steps=5)
    many = A.fit_autoencoder(scaled.repartition(8), ["a", "b", "c"], steps=5)
    assert np.abs(one - many).max() < 1e-6


def test_gram_matrix_has_every_pair(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (3.0, None, 4.0), (5.0, 6.0, 7.0)], "a double, b double, c double")
    got = {(r.i, r.j): r.total for r in S.gram_matrix(df, ["a", "b", "c"]).collect()}
    assert got == {(1, 1): 35.0, (1, 2): 32.0, (1, 3): 47.0, (2, 2): 40.0, (2, 3): 42.0, (3, 3): 65.0}


def test_random_rows_do_not_multiply_the_table(spark, monkeypatch):
    from bankspark.ml import clusters as K

    rows = spark.createDataFrame([([float(i % 37), float(i % 5)],) for i in range(400)], "x array<double>").persist()
    keyed = rows.distinct().select("x", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("start"))
    hashed = keyed.select("start", F.pmod(F.xxhash64("x"), F.lit(3)).alias("part"), F.xxhash64("x", F.lit(9), "start").alias("h"), "x")
    least = hashed.groupBy("start", "part").agg(F.min_by("x", "h").alias("x")).orderBy("start", "part").collect()
    expected = [[r["x"] for r in least if r["start"] == i] for i in range(6)]
    assert [len(e) for e in expected] == [3] * 6

    def refuse(*_):
        raise AssertionError("a row for each start")

    monkeypatch.setattr(F, "explode", refuse)
    assert K._random_rows(rows, 3, 6, 9).tolist() == expected
    assert len(K._random_rows(rows.limit(0), 3, 6, 9)) == 0


def test_models_are_compared_with_one_scoring(spark):
    from bankspark.plans.models import _compare

    scored_rows = spark.sparkContext.accumulator(0)

    def count(label):
        scored_rows.add(1)
        return 0.25 + 0.5 * label

    prob = F.udf(count, "double").asNondeterministic()
    df = spark.range(300).select((F.col("id") % 2).alias("label")).withColumn("predicted_prob", prob("label"))
    found = {r["model"]: r for r in _compare({"a": df, "b": df}, "label").collect()}
    assert scored_rows.value == 600 and sorted(found) == ["a", "b"]
    assert all(r["accuracy"] == r["auc"] == 1 for r in found.values())


def test_few_rows_are_not_left_in_many_partitions(spark):
    from bankspark.session import fewer_tasks

    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 1000, 1, 8 * cores).persist()
    few = fewer_tasks(df, 1000)
    assert few.rdd.getNumPartitions() == 2 * cores and few.count() == 1000
    assert fewer_tasks(df, 1000, 1000 // (3 * cores)).rdd.getNumPartitions() >= 3 * cores
    small = spark.range(0, 1000, 1, 2).persist()
    assert fewer_tasks(small, 1000).rdd.getNumPartitions() == 2
    df.unpersist()
    small.unpersist()


def test_campaign_rows_are_spread_after_the_split(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from bankspark.plans import models as P
    from bankspark.session import spread

    asked = spark.range(4000).select(
        F.col("id").alias("response_id"), (F.col("id") % 50).alias("customer_id"), (F.col("id") % 3 == 0).alias("responded")
    )
    named = [F.concat(F.lit(c), F.col("id") % 3).alias(c) for c in P._CATEGORICAL]
    customers = spark.range(49).select(F.col("id").alias("customer_id"), F.col("id").alias("age"), (F.col("id") * 10.0).alias("income"), *named)
    b = SimpleNamespace(spark=spark, folder=str(tmp_path), campaign_responses=asked, customers=customers)
    monkeypatch.setattr(P, "spread", lambda df, total, *columns: spread(df, total, *columns, rows=400))
    P.forget()
    kept = P.kept_campaign_rows(b)
    sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 600 and sum(sizes) == 49 * 80  # not two partitions, one per answer
    assert kept.exceptAll(P.campaign_rows(b)).isEmpty() and P.campaign_rows(b).exceptAll(kept).isEmpty()
    P.forget()


def test_density_clusters_broadcast_no_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, v)) for i, v in enumerate(np.concatenate([rng.normal(size=(150, 2)) * 0.2, rng.uniform(-4, 4, (50, 2))]))]
    df = spark.createDataFrame(rows, "id BIGINT, a DOUBLE, b DOUBLE").persist()
    found = dbscan(df, "id", ["a", "b"], 0.3, 5)
    assert len(found.collect()) == 200
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    by_key = [line for line in plan if "Join" in line and ("[pid#" in line or "array" in line or "[x#" in line or "knownfloatingpoint" in line)]
    assert by_key and not [line for line in by_key if "Broadcast" in line]
    df.unpersist()
