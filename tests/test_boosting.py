"""Second-order histogram boosting: a plain twin, missing values, gains, edge tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bankspark.ml import boosting as G
from bankspark.ml import shap as H
from bankspark.ml import supervised as S

FEATURES = ["x0", "x1", "x2"]
SCHEMA = "id BIGINT, label INT, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE"


def made_rows(n, seed=4):
    """Rows with nulls, NaN, ties, repeats and a column of few values; missing x1 tells the label."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x0, x1, x2 = rng.normal(), float(np.round(rng.normal(), 1)), float(rng.integers(0, 3))
        label = int(rng.uniform() < 1 / (1 + math.exp(-(2 * x0 - x1))))
        if i % 7 == 0:
            x1, label = None, 1
        if i % 11 == 0:
            x0 = float("nan")
        rows.append((i, label, x0, x1, x2))
    return rows + rows[:20]


def plain_fit(rows, cuts, rounds, depth, step=0.3, shrink=1.0, least=1.0):
    """Row by row, with lists: [tree], a tree is (feature, threshold, missing left, left, right) or a value."""

    def unknown(v):
        return v is None or v != v

    margins = [0.0] * len(rows)
    trees = []
    for _ in range(rounds):
        g, h = [], []
        for r, m in zip(rows, margins):
            p = 1 / (1 + float(np.exp(-m)))
            g.append(round((p - r[1]) * G.UNIT))
            h.append(round(p * (1 - p) * G.UNIT))

        def sums(members):
            return sum(g[i] for i in members), sum(h[i] for i in members)

        def score(s):
            return (s[0] / G.UNIT) * (s[0] / G.UNIT) / (s[1] / G.UNIT + shrink)

        def grow(members, level):
            best = None
            whole = score(sums(members))
            for f in range(len(cuts)) if level < depth else []:
                for c in cuts[f]:
                    for missing_left in (True, False):
                        left = [i for i in members if (missing_left if unknown(rows[i][2 + f]) else rows[i][2 + f] <= c)]
                        inside = set(left)
                        right = [i for i in members if i not in inside]
                        a, b = sums(left), sums(right)
                        if a[1] < least * G.UNIT or b[1] < least * G.UNIT:
                            continue
                        gain = score(a) + score(b) - whole
                        if gain > G.LEAST_GAIN and (best is None or gain > best[0]):
                            best = (gain, f, float(c), missing_left, left, right)
            if best is None:
                a = sums(members)
                value = -step * (a[0] / G.UNIT) / (a[1] / G.UNIT + shrink)
                for i in members:
                    margins[i] += value
                return value
            return (*best[1:4], grow(best[4], level + 1), grow(best[5], level + 1))

        trees.append(grow(list(range(len(rows))), 0))
    return trees, margins


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return (
        tree.feature[node], tree.threshold[node], tree.missing_left[node],
        nested(tree, tree.left[node]), nested(tree, tree.right[node]),
    )


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made_rows(260)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).persist()
    return rows, df, G.fit_boosted(df, FEATURES, "label", rounds=12, depth=3, bins=16)


def test_trees_equal_the_plain_twin(fitted):
    rows, df, model = fitted
    cuts = G.quantile_cuts(df, FEATURES, 16)
    assert [len(c) for c in cuts][2] == 2 and all((np.diff(c) > 0).all() for c in cuts)
    trees, margins = plain_fit(rows, cuts, 12, 3)  # 12 rounds: margins are written once in between
    assert [nested(t) for t in model.trees] == trees
    prob = {r["id"]: r["p"] for r in df.select("id", model.probability(df.sparkSession).alias("p")).collect()}
    for r, m in zip(rows, margins):
        assert prob[r[0]] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-12)


def test_result_does_not_depend_on_partitions(fitted, monkeypatch):
    _, df, model = fitted
    monkeypatch.setattr(G, "_ROWS_PER_TASK", 60)
    again = G.fit_boosted(df.repartition(3, "x2"), FEATURES, "label", rounds=12, depth=3, bins=16)
    assert [nested(t) for t in again.trees] == [nested(t) for t in model.trees]


def test_gains_add_up_to_the_reduction_of_loss(fitted):
    _, _, model = fitted
    for tree in model.trees:
        worth = [(v / 0.3) ** 2 * (c + 1) for v, c in zip(tree.value, tree.cover)]
        leaves = [i for i, f in enumerate(tree.feature) if f < 0]
        assert sum(tree.gain) == pytest.approx(sum(worth[i] for i in leaves) - worth[0], abs=1e-9)
    shares = dict(model.importance())
    assert sum(shares.values()) == pytest.approx(1) and shares["x0"] > shares["x2"]


def test_missing_values_learn_a_side_and_contributions_add_up(fitted, spark):
    _, df, model = fitted
    asked = spark.createDataFrame(
        [(1, 0, 0.0, None, 1.0), (2, 0, 0.0, 0.0, 1.0), (3, 0, None, None, None), (4, 0, float("inf"), float("-inf"), float("nan"))], SCHEMA
    )
    scored = {r["id"]: r for r in S.predict(model, asked, FEATURES).collect()}
    assert scored[1]["predicted_prob"] > scored[2]["predicted_prob"] + 0.1  # a missing x1 means label 1
    assert all(0 < r["predicted_prob"] < 1 and r["predicted_class"] in (0, 1) for r in scored.values()) and len(scored) == 4
    rows = asked.unionByName(df.withColumn("id", F.col("id") + 100).dropDuplicates(["id"]))
    prob = {r["id"]: r["predicted_prob"] for r in S.predict(model, rows, FEATURES).collect()}
    for r in H.shap_values(model, rows, FEATURES, ["id"]).collect():
        total = r["base_value"] + sum(r[f"shap_{f}"] for f in FEATURES)
        assert 1 / (1 + math.exp(-total)) == pytest.approx(prob[r["id"]], abs=1e-9)


def test_saved_model_is_the_same(fitted, spark, tmp_path):
    _, _, model = fitted
    model.save(spark, f"{tmp_path}/model")
    assert [nested(t) for t in G.Boosting.load(spark, f"{tmp_path}/model", FEATURES).trees] == [nested(t) for t in model.trees]


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = G.fit_boosted(empty, FEATURES, "label", rounds=2, depth=2)
    assert [nested(t) for t in model.trees] == [0.0, 0.0] and S.predict(model, empty, FEATURES).count() == 0
    # no label, no feature value, one class, a constant column, names that clash with the inner ones
    rows = [(i, 1 if i else None, 5.0, None, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id BIGINT, y INT, x DOUBLE, margin DOUBLE, slot DOUBLE")
    model = G.fit_boosted(df, ["x", "margin", "slot"], "y", rounds=3, depth=2)
    scored = S.predict(model, df, ["x", "margin", "slot"]).collect()
    assert len(scored) == 30 and all(r["predicted_prob"] > 0.5 and r["predicted_class"] == 1 for r in scored)
    assert {f for t in model.trees for f in t.feature} <= {-1, 2}
    assert G.fit_boosted(df, ["x"], "y", rounds=0).trees == ()


def test_rows_are_held_in_blocks(fitted):
    rows, df, _ = fitted
    cuts = G.quantile_cuts(df, FEATURES, 16)
    blocks = G._binned(df, FEATURES, "label", cuts, 16).collect()
    assert sum(b["n"] for b in blocks) == len(rows) and len(blocks) <= 5  # a record a partition here, not a row
    assert all(len(b["x"]) == 3 * b["n"] and len(b["y"]) == len(b["margin"]) == 8 * b["n"] for b in blocks)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_that_one_task_holds_need_no_job_for_each_level(fitted, spark):
    _, df, model = fitted
    again, jobs = jobs_of(spark, "one task", lambda: G.fit_boosted(df, FEATURES, "label", rounds=12, depth=3, bins=16))
    assert [nested(t) for t in again.trees] == [nested(t) for t in model.trees]
    assert jobs <= 12  # 36 levels


def test_many_tasks_give_the_trees_of_one(fitted, monkeypatch):
    _, df, model = fitted
    monkeypatch.setattr(G, "_ONE_TASK", 0)
    monkeypatch.setattr(G, "_ROWS_PER_TASK", 60)
    for sent in (G._SENT, 1):  # sums of each task, or of all tasks in one
        monkeypatch.setattr(G, "_SENT", sent)
        again = G.fit_boosted(df, FEATURES, "label", rounds=12, depth=3, bins=16)
        assert [nested(t) for t in again.trees] == [nested(t) for t in model.trees]


def test_equal_rows_are_kept_once_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(G, "_MOST_WEIGHT", 4)
    rows = [r for i, r in enumerate(made_rows(60)) for _ in range(1 + i % 11)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cuts = G.quantile_cuts(df, FEATURES, 16)
    layout = G._Layout.of(cuts, 16)
    blocks = G._distinct(G._binned(df, FEATURES, "label", cuts, 16), 3, layout).collect()
    weights = np.concatenate([np.frombuffer(b["w"]) for b in blocks])
    assert weights.sum() == len(rows) and weights.max() == 4 and len(weights) < len(rows) / 2
    model = G.fit_boosted(df, FEATURES, "label", rounds=4, depth=3, bins=16)
    assert [nested(t) for t in model.trees] == plain_fit(rows, cuts, 4, 3)[0]


def test_features_of_few_bins_share_a_column():
    rng = np.random.default_rng(5)
    cuts = [np.arange(c) + 0.5 for c in (1, 255, 1, 3, 0, 1, 1, 2)]
    layout = G._Layout.of(cuts, 256)
    bins = np.array([rng.integers(0, len(c) + 2, 500) for c in cuts])
    missing = bins == np.array(layout.radix)[:, None] - 1
    bins[missing] = 256
    x = layout.packed(bins)
    assert len(x) == 3 and x.max() <= 256
    tree = G.Tree()
    tree.add_leaf(0.0, 0.0)
    y, w, margin = rng.integers(0, 2, 500).astype(float), rng.integers(1, 4, 500).astype(float), rng.normal(size=500)
    sums = layout.sums(G._sums(iter([(x, y, w, margin)]), layout, tree, [0]))
    for f in range(len(cuts)):
        for k, d in enumerate(G.derivatives(margin, y)):
            assert (sums[0, f, :, k] == np.bincount(bins[f], d * w, 257)).all()
        digit = layout.digits(x, f, slice(None))
        assert (digit == np.where(missing[f], layout.radix[f] - 1, bins[f])).all()
