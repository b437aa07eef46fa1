"""Saving over itself, numbers beyond 2^53, trends by day and week, exact tails and other repaired cases."""

import datetime as dt
import itertools

import pytest
from pyspark.ml.clustering import KMeans

from tabulon import Dataset
from tabulon.errors import AnalysisError
from tabulon.operators import actions, charts, kpi
from tabulon.operators.multivariate import kmeans, vectors
from tabulon.operators.rank_tests import exact_u_two_sided, rank_sums
from tabulon.operators.select import sample_of_equals
from tabulon.sources.readers import read_csv


def test_save_over_the_loaded_folder_keeps_the_data(spark, tmp_path):
    path = str(tmp_path / "data")
    Dataset(spark.createDataFrame([(1, " a"), (2, "b ")], "id int, s string")).save(path)
    for step in range(25):  # more actions than one request may hold
        data = Dataset.load(spark, path).apply({"type": "trim_whitespace", "params": {}})
        data.save(path)
    again = Dataset.load(spark, path)
    assert len(again.actions) == 25
    assert sorted(map(tuple, again.df.collect())) == [(1, "a"), (2, "b")]


def test_long_numbers_stay(spark):
    df = spark.createDataFrame([("9007199254740993",), (" -12 ",), ("1e3",), ("x",), (None,), ("5.0",)], "v string")
    assert [r.v for r in actions.cast_type(df, "v", "int").collect()] == [9007199254740993, -12, 1000, None, None, 5]


def test_fillna_takes_what_fits(spark):
    df = spark.createDataFrame([(None, None, "1"), (2.0, "a", None), (4.0, "b", "3")], "n double, s string, t string")
    assert [tuple(r) for r in actions.fillna(df, strategy="zero").collect()] == [(0.0, None, "1"), (2.0, "a", None), (4.0, "b", "3")]
    assert [r.t for r in actions.fillna(df, ["t"], "mean").collect()] == ["1", "2.0", "3"]
    with pytest.raises(AnalysisError, match="unknown_strategy"):
        actions.fillna(df, strategy="guess")


def test_ties_of_deduplicate(spark):
    df = spark.createDataFrame([("k", 1, "b", 0), ("k", 1, "a", 0)], "k string, o int, v string, _place int")
    for rows in (df, df.orderBy("v")):
        assert [tuple(r) for r in actions.deduplicate(rows, ["k"], order_by=["o"]).collect()] == [("k", 1, "a", 0)]


def test_trend_looks_back_once(spark):
    days = [dt.date(1996, 2, 28), dt.date(1996, 2, 29), dt.date(1997, 2, 28), dt.date(1998, 2, 28)]
    df = spark.createDataFrame([(d, float(i + 1)) for i, d in enumerate(days)], "d date, v double")
    rows = {r.period: r.last_year for r in kpi.trend_change(df, "d", "v", "day").collect()}
    assert rows == {days[0]: None, days[1]: None, days[2]: 1.0, days[3]: 3.0}
    weeks = spark.createDataFrame([(dt.date(2023, 1, 4), 1.0), (dt.date(2024, 1, 3), 2.0)], "d date, v double")
    assert sorted(r.last_year or 0 for r in kpi.trend_change(weeks, "d", "v", "week").collect()) == [0, 1.0]
    with pytest.raises(AnalysisError, match="unknown_grain"):
        kpi.trend_change(df, "d", "v", "hourly")


def test_schema_and_missing_texts(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\nNA,1\nx,2\n")
    assert [r.a for r in read_csv(spark, str(tmp_path / "f.csv"), schema="a string, b int").collect()] == [None, "x"]


def test_all_box_columns(spark):
    df = spark.createDataFrame([tuple(float(i + j) for j in range(12)) for i in range(5)], [f"c{j}" for j in range(12)])
    assert charts.chart_boxplot(df, df.columns).count() == 12


def test_exact_tail_of_large_samples():
    below, above = exact_u_two_sided(0, 8, 31_249), exact_u_two_sided(0, 8, 31_251)
    assert below == pytest.approx(above, rel=1e-3) and below < 1e-30


def test_equal_rows_are_sampled_each_on_their_own(spark, lineitem):
    levels = lineitem.select("l_quantity").distinct().count()
    points = charts.chart_scatter(lineitem, "l_linenumber", "l_quantity", n=1000)
    assert points.count() == 1000 and points.select("y").distinct().count() == levels
    hot = spark.range(300_000).selectExpr("if(id % 3 = 0, 1, id) AS v")  # one value fills a third of the rows
    hits = sample_of_equals(hot, 3000).where("v = 1").count()
    assert 850 < hits < 1150
    assert sample_of_equals(hot.limit(10), 50).count() == 10


def test_ranks_of_many_groups_are_not_one_task(lineitem):
    plan = rank_sums(lineitem, "l_quantity", "l_orderkey")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "l_orderkey" not in window.splitlines()[0]  # the window holds distinct values only


def test_replay_resolves_no_action_twice(spark, lineitem):
    tracker, step = spark.sparkContext.statusTracker(), {"type": "winsorize", "params": {"columns": ["l_quantity"]}}

    def jobs(work):
        spark.sparkContext.setJobGroup(name := f"replay{next(numbers)}", name)
        done = work()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done, len(tracker.getJobIdsForGroup(name))

    numbers = itertools.count()
    data, costs = Dataset(lineitem), []
    for _ in range(3):
        data, cost = jobs(lambda: data.apply(step))
        costs.append(cost)
    assert costs[0] > 0 and max(costs) <= costs[0]
    back, cost = jobs(lambda: data.undo().undo().redo())
    assert jobs(lambda: back.df.columns)[1] == cost == 0


def test_unknown_measure(spark):
    with pytest.raises(AnalysisError, match="unknown_measure"):
        Dataset(spark.range(1).toDF("v")).set_column_meta("v", measure="guess")


def test_lockstep_kmeans_agrees_with_single_runs(spark):
    rows = [(float(i % 4) * 10 + (i * 37 % 11) / 10, float(i % 3) + (i * 53 % 7) / 5) for i in range(600)]
    fit = kmeans(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], 4)
    placed = fit.assignments().groupBy("cluster").agg({"*": "count", "x0": "avg", "x1": "avg"}).orderBy("cluster").collect()
    assert [r["count(1)"] for r in placed] == fit.size_list and fit.converged
    for r, centre in zip(placed, fit.centre_rows):
        assert [r["avg(x0)"], r["avg(x1)"]] == pytest.approx(centre, abs=0.02)
    single = KMeans(k=4, seed=3).fit(vectors(fit._rows)).summary.trainingCost
    assert fit.inertia <= single * 1.01
    same = kmeans(spark.createDataFrame([(1.0, 2.0)] * 12, "x double, y double"), ["x", "y"], 3)
    assert same.size_list == [12] and same.inertia == 0
