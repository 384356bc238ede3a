"""Hand-made frames for null, tie, edge and empty-group rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions import numbers as N
from bankspark.functions import text as X
from bankspark.operators import campaign as C
from bankspark.operators import cleaning as L
from bankspark.operators import customers as U
from bankspark.operators import fraud as D
from bankspark.operators import joins as J
from bankspark.operators import ranking as K
from bankspark.operators import reports as R
from bankspark.operators import sampling as S
from bankspark.operators.quantiles import exact_quantiles, running_totals
from bankspark.operators.ranges import digit_shifts, double_key, double_of, in_ranges, ordered_key, sum_before


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def tied_months(spark):
    data = [("A", m, 10.0) for m in (1, 2)] + [("A", 3, 5.0), ("A", 3, 5.0)]
    return spark.createDataFrame(
        [(loc, dt.datetime(2024, m, 5), amt) for loc, m, amt in data],
        "location STRING, transaction_date TIMESTAMP_NTZ, amount DOUBLE",
    )


def test_ties_take_latest_month_in_one_report_and_earliest_in_the_other(tied_months):
    latest = K.peak_and_least_months(tied_months).first()
    assert latest["peak_transaction_month"] == "2024-03"
    assert latest["least_transaction_month"] == "2024-02"
    assert latest["peak_amount_month"] == "2024-03"
    first = K.first_peak_months(tied_months).first()
    assert first["peak_amount_month"] == "2024-01"


def test_single_row_has_no_deviation(spark):
    tx = spark.createDataFrame([(1, 5.0)], "account_id BIGINT, amount DOUBLE")
    assert R.account_statistics(tx).first()["transaction_std_dev"] is None


def test_mode_skips_null_and_takes_lowest_on_ties(spark):
    data = [(1, None), (1, None), (1, None), (1, "b"), (1, "a"), (2, None)]
    df = spark.createDataFrame(data, "account_id BIGINT, type STRING")
    got = rows(D.group_modes(df, "account_id", {"type": "usual"}), "account_id")
    assert got == [(1, "a")]


def test_usual_hour_ties_are_numeric(spark):
    data = [(i, 7, dt.datetime(2024, 1, 1, h), 1.0, "Debit", "ATM", "m", "x") for i, h in enumerate([9, 10])]
    tx = spark.createDataFrame(
        data,
        "transaction_id BIGINT, account_id BIGINT, transaction_date TIMESTAMP_NTZ, amount DOUBLE, type STRING, "
        "channel STRING, merchant STRING, location STRING",
    )
    assert D.usual_patterns(tx).first()["usual_hour"] == 9


@pytest.mark.parametrize(
    "age, left, right",
    [(17, "0-18", None), (18, "19-25", None), (20, "19-25", None), (30, "26-35", "(20,30]"), (80, "65+", "(70,80]"),
     (100, None, None), (None, None, None)],
)
def test_bin_edges(spark, age, left, right):
    df = spark.createDataFrame([(age,)], "age INT")
    got = df.select(
        N.bin_left_closed(F.col("age"), V.AGE_EDGES, V.AGE_LABELS),
        N.bin_right_closed(F.col("age"), V.HEATMAP_AGE_EDGES, V.HEATMAP_AGE_LABELS),
    ).first()
    assert tuple(got) == (left, right)


def test_empty_age_group_has_a_row_without_rate(spark):
    customers = spark.createDataFrame([(1, 20), (2, 40)], "customer_id BIGINT, age INT")
    responses = spark.createDataFrame([(1, True), (1, False)], "customer_id BIGINT, responded BOOLEAN")
    band = N.bin_left_closed(F.col("age"), V.AGE_EDGES, V.AGE_LABELS)
    got = {r[0]: tuple(r)[1:] for r in C.response_rate_by_bands(customers, responses, band, V.AGE_LABELS, "g").collect()}
    assert got["0-18"] == (0, 0, 0, None)
    assert got["19-25"] == (1, 1, 2, 50.0)
    assert got["36-45"] == (1, 0, 1, 0.0)  # a customer without a response counts as a no


def test_yes_words(spark):
    df = spark.createDataFrame([(w,) for w in (" TRUE ", "Yes", "1", "no", None, "\tyes\n")], "w STRING")
    assert [r[0] for r in df.select(X.yes_flag(F.col("w"))).collect()] == [1, 1, 1, 0, 0, 1]


@pytest.fixture
def churn_tables(spark):
    customers = spark.createDataFrame([(i,) for i in range(1, 7)], "customer_id BIGINT")
    accounts = spark.createDataFrame(
        [(10, 1, "Closed"), (20, 2, "Closed"), (21, 2, "Active"), (30, 3, "Closed"), (40, 4, "Active"), (60, 6, "Closed")],
        "account_id BIGINT, customer_id BIGINT, status STRING",
    )
    tx = spark.createDataFrame(
        [(30, dt.datetime(2024, 1, 1)), (40, dt.datetime(2024, 1, 1)), (60, dt.datetime(2024, 10, 3))],
        "account_id BIGINT, transaction_date TIMESTAMP_NTZ",
    )
    return customers, tx, accounts


def test_churn_branches(churn_tables):
    got = {r["customer_id"]: r["churned"] for r in U.churn_labels(*churn_tables, "2025-01-01").collect()}
    # 1 idle+closed, 2 idle+some open, 3 old+closed, 4 old+open, 5 no account, 6 exactly 90 days
    assert got == {1: 1, 2: None, 3: 1, 4: 0, 5: 0, 6: 0}


def test_latest_score_keeps_ties(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    scores = spark.createDataFrame(
        [(1, 1, 500, d1, "High"), (2, 1, 650, d2, "Medium"), (3, 1, 710, d2, "Low"), (4, 2, 600, d1, "High")],
        "score_id BIGINT, customer_id BIGINT, score INT, date_recorded DATE, risk_level STRING",
    )
    assert [r[3] for r in rows(U.latest_scores(scores), "score_id")] == [2, 3, 4]
    assert rows(U.one_score_each(scores), "customer_id") == [(1, 710), (2, 600)]


def test_null_flag_makes_score_and_flag_null(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, None, 1)], "a INT, b INT, c INT")
    got = D.combine_flags(df, ["a", "b", "c"]).select("combined_anomaly_score", "fraud_flag").collect()
    assert [tuple(r) for r in got] == [(3, 1), (None, None)]


def test_quantiles_match_numpy(spark):
    import numpy as np

    values = np.round(np.random.default_rng(1).exponential(10, 999), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v DOUBLE")
    probs = [0.0, 0.2, 0.5, 0.99, 1.0]
    assert exact_quantiles(df, "v", probs) == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_quantiles_of_hot_and_few_values(spark):
    import numpy as np

    df = spark.range(20001).select((F.col("id") * 7919 % 20001).cast("double").alias("v"))
    df = df.union(spark.range(9000).select(F.lit(5.0).alias("v")))  # one value with a third of the rows
    few = spark.range(5000).select(((F.col("id") % 10) / 7 - 0.5).alias("v"))  # ten values, both signs
    probs = [0.001, 0.1, 0.31, 0.5, 0.999]
    for frame in (df, few):
        values = [r[0] for r in frame.collect()]
        assert exact_quantiles(frame, "v", probs) == pytest.approx(list(np.quantile(values, probs)))


def test_quantiles_of_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    values = [-inf, -1.5, -5e-324, -0.0, 0.0, 2.2e-308, 1.0, 1.7976931348623157e308, inf, inf, nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    ordered = values[:10]
    assert exact_quantiles(df, "v", [i / 9 for i in range(10)]) == ordered
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert exact_quantiles(df.filter("v IS NULL OR isnan(v)"), "v", [0.1, 0.5]) == [None, None]


def test_keys_keep_order_and_value(spark):
    import random
    import struct

    draw = random.Random(3)
    bits = [draw.getrandbits(64) for _ in range(3000)] + [0x000FFFFFFFFFFFFF, 0x0010000000000000, 0x7FEFFFFFFFFFFFFF, 1]
    values = [v for v in (struct.unpack("<d", struct.pack("<Q", b))[0] for b in bits) if v == v]
    values += [2.0**e for e in range(-1074, 1024)] + [2.0**e * (1 - 2**-53) for e in range(-1000, 1024)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", double_key(F.col("v")).alias("k"))
    for r in df.collect():
        size = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["k"] == (-size if r["v"] < 0 else size) and double_of(r["k"]) == r["v"]


def test_ties_and_shares_of_grouped_rows(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", None)], "k STRING, n INT")
    kept = {n: [r[0] for r in rows(K.top_with_ties(df, "n", n), "k")] for n in (1, 2, 3, 4, 5)}
    assert kept == {1: ["a"], 2: list("abc"), 3: list("abc"), 4: list("abcd"), 5: list("abcde")}
    assert rows(K.top_with_ties(df.filter("n IS NULL"), "n", 2), "k") == [("e", None)]
    assert K.top_with_ties(df.limit(0), "n", 2).count() == 0
    assert [r["s"] for r in K.with_share(df, "n", "s").orderBy("k").collect()] == [5 / 12 * 100, 25.0, 25.0, 1 / 12 * 100, None]


def test_quantile_flag_is_strict(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "v DOUBLE")
    assert sum(r["f"] for r in D.top_share_flag(df, "v", "f", 1.0).collect()) == 0


def test_running_totals_cross_ranges(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    got = running_totals(df, "v", ["n"], rows=7).orderBy("v").collect()
    assert [r["n_upto"] for r in got] == list(range(1, 1001))


def test_running_totals_in_groups_with_nulls(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 5), (None, None, 2), ("a", -3.0, 1), ("a", float("inf"), 4), ("a", None, 7), ("a", -2.5, 1)],
        "g STRING, v DOUBLE, n INT",
    )
    for most in (1, 100):
        got = {(r["g"], r["v"]): r["n_upto"] for r in running_totals(df, "v", ["n"], ["g"], rows=most).collect()}
        assert got == {
            (None, None): 2, (None, 1.0): 7, ("a", None): 7, ("a", -3.0): 8, ("a", -2.5): 9, ("a", float("inf")): 13,
        }
    assert running_totals(df.limit(0), "v", ["n"], ["g"]).count() == 0


def test_ranges_hold_a_stated_number_of_rows(spark):
    scores = spark.range(1_000_000).select(F.pow(F.lit(1.0) - F.col("id") / 1_000_000, 9).alias("v"), F.lit(1).alias("n"))
    keyed = scores.withColumn("k", ordered_key(scores, "v"))
    ranged, crowded = in_ranges(keyed, [], "k", {"n": F.sum("n")}, sum_before, 20_000, digit_shifts(0, 2**62))
    sizes = ranged.groupBy("_shift", "_node").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("_before_n").alias("b"))
    found = sizes.orderBy("low").collect()
    assert crowded is None and sum(r["c"] for r in found) == 1_000_000 and max(r["c"] for r in found) <= 20_000
    upto = 0
    for r in found:
        assert r["b"] == upto
        upto += r["c"]


def test_clean_is_idempotent_and_repairs(spark):
    raw = spark.createDataFrame(
        [(" city MART ", "sittwe"), (None, " bago"), ("Junction Square", None), ("Nobody", None), ("MPT Merchant", "PATHEIN")],
        "merchant STRING, location STRING",
    )
    once = L.clean_transactions(raw)
    assert [tuple(r) for r in once.collect()] == [
        ("City Mart", "Yangon"), ("Unknown", "Bago"), ("Junction Square", "Yangon"), ("Nobody", None),
        ("MPT Merchant", "Pathein"),
    ]
    assert L.clean_transactions(once).collect() == once.collect()


def test_null_keys_match_only_when_asked(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k STRING, v INT")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k STRING, w INT")
    assert rows(J.null_safe_join(a, b, "k", "inner"), "v") == [(None, 1, 10), ("x", 2, 20)]
    assert a.join(b, "k").count() == 1


def test_left_join_hot_equals_left_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k BIGINT, v STRING")
    b = spark.createDataFrame([(1, i) for i in range(50)] + [(3, 99)], "k BIGINT, w INT")
    got, want = J.left_join_hot(a, b, "k"), a.join(b, "k", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_split_is_a_partition_and_stable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    a = S.split_flag(df, "id", 0.8, 1, ["label"])
    b = S.split_flag(df.repartition(13), "id", 0.8, 1, ["label"])
    assert a.filter("is_train").groupBy("label").count().orderBy("label").collect() == [(0, 3600), (1, 400)]
    assert a.exceptAll(b).isEmpty() and a.count() == 5000


@pytest.mark.parametrize("share, round_up", [(0.0, False), (0.001, False), (0.5, True), (0.73, True), (1.0, False)])
def test_split_equals_plain_ranking(spark, share, round_up):
    from pyspark.sql import Window as W

    # ids that collide in the hash, a label that is null, a label with most of the rows
    df = spark.range(4000).select(
        (F.col("id") * 1000003 % 7000003 + F.col("id")).alias("id"),
        F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 4 == 0, "b").otherwise("a").alias("label"),
    )
    h = N.arithmetic_hash(F.col("id"), 5)
    rank = F.row_number().over(W.partitionBy("label").orderBy(h, "id"))
    size = F.count(F.lit(1)).over(W.partitionBy("label"))
    want = df.withColumn("is_train", rank <= (F.ceil if round_up else F.floor)(size * F.lit(share)))
    got = S.split_flag(df, "id", share, 5, ["label"], round_up)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hash_takes_any_bigint(spark):
    df = spark.createDataFrame([(2**62,), (-5,), (0,)], "id BIGINT")
    got = [r[0] for r in df.select(N.arithmetic_hash(F.col("id"), 7)).collect()]
    assert all(0 <= h < N.HASH_RANGE for h in got)


def test_time_since_last_equals_plain_lag(spark):
    from pyspark.sql import Window as W

    tx = spark.range(3000).select(
        F.col("id").alias("transaction_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("account_id"),
        F.timestamp_seconds(F.col("id") * 7919 % 400000).cast("timestamp_ntz").alias("transaction_date"),
    )
    w = W.partitionBy("account_id").orderBy("transaction_date", "transaction_id")
    plain = tx.withColumn("p", F.lag("transaction_date").over(w)).select(
        "transaction_id",
        ((F.unix_micros(F.col("transaction_date").cast("timestamp")) - F.unix_micros(F.col("p").cast("timestamp"))) / 3.6e9).alias("h"),
    )
    for most in (10, 100_000):  # many ranges, one range an hour
        got = D.time_since_last(tx, most).select("transaction_id", F.col("time_since_last").alias("h"))
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_time_since_last_of_one_busy_hour(spark):
    from pyspark.sql import Window as W

    # one account, all rows within an hour, a third of them at one instant
    micros = F.when(F.col("id") % 3 == 0, 1_800_000_000).otherwise(F.col("id") * 7919 % 3_600_000_000)
    tx = spark.range(6000).select(
        F.col("id").alias("transaction_id"), F.lit(None).cast("int").alias("account_id"),
        F.timestamp_micros(micros.cast("bigint")).cast("timestamp_ntz").alias("transaction_date"),
    ).unionByName(spark.sql("SELECT -1L AS transaction_id, CAST(NULL AS INT) AS account_id, CAST(NULL AS TIMESTAMP_NTZ) AS transaction_date"))
    at = F.unix_micros(F.col("transaction_date").cast("timestamp"))
    w = W.partitionBy("account_id").orderBy("transaction_date", "transaction_id")
    plain = tx.select("transaction_id", ((at - F.lag(at).over(w)) / 3.6e9).alias("h"))
    for most in (50, 100_000):
        out = D.time_since_last(tx, most)
        assert out.columns == [*tx.columns, "time_since_last"]
        got = out.select("transaction_id", F.col("time_since_last").alias("h"))
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_rejected_edges_of_city_box(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "location STRING")
    cities = spark.createDataFrame([("a", 10.0, 92.0), ("b", 9.99, 95.0), ("c", None, 95.0)], "location STRING, lat DOUBLE, lng DOUBLE")
    got = {r["location"]: r["inside"] for r in D.locate(df, cities).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_customer_labels_are_encoded_whole(spark):
    rows = spark.createDataFrame(
        [(1, "Male", None, "Clerk", "North"), (2, None, None, "Clerk", None), (3, "Male", None, "Smith", "South")],
        "id INT, gender STRING, marital_status STRING, occupation STRING, region STRING",
    ).withColumn("education_level", F.lit(None).cast("string"))
    out, names = C.encode_customers(rows)
    got = {r["id"]: r for r in out.collect()}
    assert [n for n in names if n.startswith(("occupation", "region"))] == ["occupation_clerk", "occupation_smith", "region_north", "region_south"]
    assert (got[1]["occupation_clerk"], got[3]["occupation_clerk"], got[3]["occupation_smith"]) == (1, 0, 1)
    assert (got[2]["region_north"], got[2]["region_south"]) == (0, 0) and len(got) == 3
    with pytest.raises(ValueError, match="more than 1 values"):
        C.levels_of(rows, "region", most=1)
    empty, names = C.encode_customers(rows.limit(0))
    assert empty.count() == 0 and not [n for n in names if n.startswith("region")]


def test_values_of_a_large_table_are_counted_in_bounded_tasks(spark, monkeypatch):
    from bankspark.operators import profile as P

    df = spark.range(4000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 3).cast("string").alias("s"),
        F.when(F.col("id") % 4 > 0, (F.col("id") % 500) / 8).alias("v"),
    )
    df = df.unionAll(df.limit(300))
    want = sorted(map(str, P.value_profile(df, "k", ["s", "v", "k"]).collect()))
    monkeypatch.setattr(P, "COUNTED_ROWS", 100)
    assert sorted(map(str, P.value_profile(df, "k", ["s", "v", "k"]).collect())) == want
    tasks = P.value_histogram(df, ["k", "s", "v"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 43 and max(r["count"] for r in tasks) < 300
