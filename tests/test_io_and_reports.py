import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon import AnalysisError, run_analysis, run_report
from tabulon.operators import actions, anomaly, kpi
from tabulon.plans.report import report_input, usable_jobs
from tabulon.sources.readers import csv_encoding, jdbc_url, read_csv, read_jdbc, read_json, with_row_id
from tabulon.sources.writers import read_json_document, write_csv


@pytest.mark.parametrize("encoding, expected", [("utf-8", "UTF-8"), ("gbk", "GB18030"), ("gb18030", "GB18030")])
def test_csv_encodings(spark, tmp_path, encoding, expected):
    path = tmp_path / "t.csv"
    path.write_bytes("城市,金额\n北京,1.5\n上海,NA\n".encode(encoding))
    assert csv_encoding(spark, str(path)) == expected
    df = read_csv(spark, str(path))
    assert df.columns == ["城市", "金额"]
    assert [tuple(r) for r in df.collect()] == [("北京", 1.5), ("上海", None)]


def test_csv_missing_texts_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,s,n\n1,"a ""b"", c",3\n2,N/A,null\n3,"line\nbreak",7\n')
    df = read_csv(spark, str(path), multi_line=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 'a "b", c', 3.0), (2, None, None), (3, "line\nbreak", 7.0)]


def test_csv_round_trip(spark, tmp_path, orders):
    write_csv(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), str(tmp_path / "o"))
    back = read_csv(spark, str(tmp_path / "o"), schema="o_orderkey long, o_orderstatus string, o_totalprice double")
    assert back.exceptAll(orders.select(*back.columns)).count() == 0 and back.count() == orders.count()
    assert with_row_id(back).select("_rid").distinct().count() == back.count()


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    (tmp_path / "l.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    expected = [(1, "x"), (2, None)]
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "a.json")).orderBy("a").collect()] == expected
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "l.json"), lines=True).orderBy("a").collect()] == expected


def test_jdbc_embedded_database(spark):
    """In-memory Derby inside this process: no server, no port."""
    url = "jdbc:derby:memory:tabulon;create=true"
    source = spark.range(100).select(F.col("id").cast("int").alias("ID"), (F.col("id") * 1.5).alias("V"))
    source.write.format("jdbc").option("url", url).option("dbtable", "T").option(
        "driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    df = read_jdbc(spark, url, "SELECT ID, V FROM T WHERE V > 30", driver=driver)
    assert df.count() == 79 and df.agg(F.min("V")).first()[0] == 31.5
    split = read_jdbc(spark, url, "SELECT ID, V FROM T", driver=driver, partition_column="ID", lower_bound=0,
                      upper_bound=100, num_partitions=4)
    assert split.rdd.getNumPartitions() == 4 and split.count() == 100
    with pytest.raises(AnalysisError, match="missing_bounds"):
        read_jdbc(spark, url, "SELECT ID FROM T", partition_column="ID")


def test_jdbc_urls():
    assert jdbc_url("mysql", "h", None, "d") == "jdbc:mysql://h:3306/d"
    assert jdbc_url("PostgreSQL", "h", 6000, "d") == "jdbc:postgresql://h:6000/d"
    assert jdbc_url("sqlite", database="/x.db") == "jdbc:sqlite:/x.db"
    with pytest.raises(AnalysisError):
        jdbc_url("other")


ALL_JOBS = {
    "overview": {}, "descriptive": {}, "frequency": {"column": "l_returnflag"},
    "crosstab": {"row": "l_returnflag", "col": "l_linestatus"},
    "group_summary": {"group_by": "l_returnflag", "metric": "l_tax", "agg": "median"},
    "normality": {"column": "l_quantity"}, "correlation": {"columns": ["l_tax", "l_quantity"]},
    "linear_regression": {"y": "l_extendedprice", "x": "l_quantity"},
    "pca": {"columns": ["l_tax", "l_quantity", "l_discount"]}, "kmeans": {"columns": ["l_tax", "l_quantity"], "k": 2},
    "ttest": {"y": "l_tax", "group_col": "l_returnflag"}, "anova": {"y": "l_tax", "group_col": "l_returnflag"},
    "chi_square": {"row": "l_returnflag", "col": "l_linestatus"},
    "nonparam": {"test": "kruskal", "y": "l_tax", "group_col": "l_returnflag"},
    "logistic_regression": {"y": "l_linestatus", "x": ["l_tax"]},
}


@pytest.mark.parametrize("name", ALL_JOBS)
def test_every_analysis_and_its_charts(lineitem, name):
    result = run_analysis(lineitem, name.upper() + " ", ALL_JOBS[name])
    assert result.title == name
    for table in result.tables.values():
        assert table.count() > 0
    for chart in result.charts.values():
        assert chart().count() > 0


@pytest.mark.parametrize("alias, params", [
    ("t_test", {"ttype": "one_sample", "y": "l_tax"}), ("t_test", {"ttype": "paired", "y": "l_tax", "y2": "l_discount"}),
    ("non_param", {"test": "mannwhitney", "y": "l_tax", "group_col": "l_linestatus"}),
    ("non_param", {"test": "friedman", "columns": ["l_tax", "l_discount", "l_quantity"]}),
    ("ols", {"y": "l_tax", "x": ["l_discount"]}), ("k_means", {"columns": ["l_tax", "l_discount"], "k": 99})])
def test_aliases(lineitem, alias, params):
    result = run_analysis(lineitem.limit(1000), alias, params)
    assert all(t.count() > 0 for t in result.tables.values()) and all(c().count() > 0 for c in result.charts.values())


def test_guard_codes(lineitem):
    for name, params, code in (
            ("frequency", {}, "missing_column"), ("crosstab", {"row": "l_tax"}, "missing_columns"),
            ("nonparam", {"test": "sign"}, "unsupported_test"), ("nope", {}, "unsupported_analysis"),
            ("ttest", {"y": "l_tax"}, "missing_group"), ("pca", {"columns": ["l_tax"]}, "need>=2_columns"),
            ("logit", {"y": "l_quantity", "x": ["l_tax"]}, "y_not_binary")):
        with pytest.raises(AnalysisError) as caught:
            run_analysis(lineitem, name, params)
        assert caught.value.code == code


def test_report_runs_on_and_writes(spark, lineitem, tmp_path):
    jobs = [{"analysis": "descriptive", "params": {"columns": ["l_tax"]}}, {"analysis": "frequency"}, "junk",
            {"analysis": "correlation", "params": {"columns": ["l_tax", "l_discount"]}}]
    lines = run_report(lineitem, jobs, str(tmp_path / "r")).collect()
    assert [(r.job, r.status) for r in lines] == [
        ("job1_descriptive", "done"), ("job2_frequency", "failed: missing_column"),
        ("job3_correlation", "done"), ("job3_correlation", "done")]
    manifest = read_json_document(spark, str(tmp_path / "r" / "manifest"))
    assert [j["status"] for j in manifest["jobs"]] == ["done", "failed", "done"]
    path = manifest["jobs"][0]["tables"][0]["path"]
    assert path.endswith("data/job1_descriptive_table_1.csv") and spark.read.csv(path, header=True).count() == 1
    assert [j["analysis"] for j in usable_jobs([])] == ["overview", "descriptive"]
    assert len(usable_jobs([{"analysis": "overview"}] * 30)) == 30
    small = report_input(lineitem, ["l_tax", "nope"], 100, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    assert small.columns == ["l_tax"] and small.count() == 100


def day(n):
    return dt.datetime(2024, 1, n)


def test_retention_and_new_users(spark):
    visits = [(1, 1), (1, 2), (1, 8), (2, 1), (2, 1), (3, 2), (None, 1)]
    df = spark.createDataFrame([(u, day(d)) for u, d in visits], "u int, t timestamp")
    got = {str(r.period)[-2:]: (r.users, r.returned_1, r.returned_7) for r in kpi.kpi_retention(df, "t", "u").collect()}
    assert got == {"01": (2, 1, 1), "02": (2, 0, 0), "08": (1, 0, 0)}
    got = {str(r.period)[-2:]: (r.new_users, r.returning_users) for r in kpi.trend_new_vs_returning(df, "t", "u").collect()}
    assert got == {"01": (2, 0), "02": (1, 1), "08": (0, 1)}


def test_ratios_of_nothing_are_missing(spark):
    df = spark.createDataFrame([(day(1), 0.0, 0.0, 0.0, 5.0)], "t timestamp, i double, c double, v double, s double")
    row = kpi.kpi_marketing(df, "t", "i", "c", "v", "s").first()
    assert (row.ctr, row.cvr, row.cpa, row.cost) == (None, None, None, 5.0)
    row = kpi.kpi_finance(df, "t", "i", "s", profit="c").first()
    assert (row.profit, row.margin) == (0.0, None)


def test_anomalies(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(100, 60.0), (101, -80.0), (102, None)],
                               "id int, v double")
    far = anomaly.anomaly_iqr(df, ["v"], ["id"], top_n=1).collect()
    assert [(r.column, r.id, r.value) for r in far] == [("v", 101, -80.0)]
    assert {r.id for r in anomaly.anomaly_zscore(df, "v").collect()} == {100, 101}
    rules = {r.rule: r.n_flagged for r in anomaly.anomaly_rules(df, {"amount": "v"}).collect()}
    assert rules == {"negative_amount": 1}
    assert anomaly.flagged_rows(df, {"amount": "v"}).first().rules == ["negative_amount"]
    assert anomaly.anomaly_zscore(df.where("id = 0"), "v").count() == 0
    row = anomaly.anomaly_long_tail(df, "v").first()
    assert row.n_outside == 2


def test_dau_spike(spark):
    rows = [(u, day(d)) for d in range(1, 21) for u in range(5)] + [(u, day(21)) for u in range(60)]
    df = spark.createDataFrame(rows, "u int, t timestamp")
    assert [str(r.period) for r in anomaly.anomaly_dau_spike(df, "t", "u").collect()] == ["2024-01-21"]
    assert anomaly.anomaly_dau_spike(df.where("t < '2024-01-02'"), "t", "u").count() == 0


def test_ten_jobs_read_the_table_once(spark, lineitem, monkeypatch, tmp_path):
    price, quantity, tax = "l_extendedprice", "l_quantity", "l_tax"
    jobs = [
        {"analysis": "ttest", "params": {"ttype": "one_sample", "y": price, "mu": 3.0}},
        {"analysis": "ttest", "params": {"ttype": "one_sample", "y": tax, "mu": 0.04}},
        {"analysis": "ttest", "params": {"ttype": "paired", "y": price, "y2": quantity}},
        {"analysis": "normality", "params": {"column": price, "method": "jarque_bera"}},
        {"analysis": "normality", "params": {"column": tax, "method": "normaltest"}},
        {"analysis": "normality", "params": {"column": quantity, "method": "auto"}},
        {"analysis": "correlation", "params": {"columns": [price, quantity, tax]}},
        {"analysis": "linear_regression", "params": {"y": price, "x": [quantity, tax]}},
        {"analysis": "linear_regression", "params": {"y": tax, "x": [quantity]}},
        {"analysis": "nonparam", "params": {"test": "friedman", "columns": [price, quantity, tax]}},
        {"analysis": "linear_regression", "params": {"y": "nope", "x": [quantity]}},
    ]
    read, plain = [], type(lineitem).agg

    def counted(self, *parts):
        read.append(self is lineitem)
        return plain(self, *parts)

    monkeypatch.setattr(type(lineitem), "agg", counted)
    lines = run_report(lineitem, jobs, str(tmp_path / "r")).collect()
    assert read == [True]
    assert [r.status for r in lines if r.status != "done"] == ["failed: missing_y"]
    monkeypatch.undo()
    alone = {i: run_analysis(lineitem, j["analysis"], j["params"]) for i, j in enumerate(jobs[:-1], start=1)}
    for i, result in alone.items():
        for k, (name, table) in enumerate(result.tables.items(), start=1):
            path = f"{tmp_path}/r/data/job{i}_{jobs[i - 1]['analysis']}_table_{k}.csv"
            again = spark.read.option("header", True).schema(table.schema).csv(path)
            assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
            (n,) = [r.n_rows for r in lines if r.job.startswith(f"job{i}_") and r.table == name]
            assert n == table.count()


def test_a_lost_cluster_ends_the_report(lineitem, monkeypatch):
    from tabulon.operators import describe

    def lost(*args, **kwargs):
        raise RuntimeError("no executor left")

    monkeypatch.setattr(describe, "frequency", lost)
    with pytest.raises(RuntimeError, match="no executor"):
        run_report(lineitem, [{"analysis": "frequency", "params": {"column": "l_returnflag"}}])


def test_cross_tables_of_any_width(spark):
    table = spark.range(6000).select((F.col("id") % 1500).alias("wide"), (F.col("id") % 4).alias("narrow"))
    found = run_analysis(table, "chi_square", {"row": "narrow", "col": "wide"}).tables
    assert found["crosstab"].columns == ["row", "col", "n"] and found["crosstab"].count() == 1500
    test = found["test"].first()
    assert test.dof == 3 * 1499 and test.n == 6000
    flags = actions.one_hot_encode(table, ["wide", "narrow"])
    assert len(flags.columns) == 1504


def test_csv_encoding_of_the_header_alone(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("城市,金额\na,1\n".encode("gbk"))
    assert read_csv(spark, str(path)).columns == ["城市", "金额"]


def test_csv_types_come_from_one_reading(spark, tmp_path, monkeypatch):
    path = tmp_path / "t.csv"
    path.write_text("a,long,big,x,day,at,flag,text,none,mark\n"
                    "1,9007199254740993,123456789012345678901234567890,1.5,2024-01-05,2024-01-05 10:00:00,true,1d,NA,ok\n"
                    "NA,NA,7,1e3,NA,2024-01-06T11:30:00,False,2,,\ufffd\n"
                    " 3 ,9007199254740995,NA,-2,2024-02-05,NA,NA,x,null,é\n", encoding="utf-8")
    read, plain = [], type(spark.range(1)).agg
    monkeypatch.setattr(type(spark.range(1)), "agg", lambda self, *parts: read.append(1) or plain(self, *parts))
    df = read_csv(spark, str(path))
    monkeypatch.undo()
    assert read == [1]
    assert [t for _, t in df.dtypes] == ["int", "bigint", "decimal(38,0)", "double", "date", "timestamp", "boolean", "string", "string", "string"]
    rows = df.orderBy("x").collect()
    assert [r.long for r in rows] == [9007199254740995, 9007199254740993, None]
    assert [r.a for r in rows] == [3, 1, None] and [r.flag for r in rows] == [None, True, False]
    assert rows[1].big == 123456789012345678901234567890 and [r.mark for r in rows] == ["é", "ok", "\ufffd"]
