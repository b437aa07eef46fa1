import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon import AnalysisError, Dataset
from tabulon.operators.actions import apply_action, apply_actions, validate_actions


def act(df, kind, **params):
    return apply_action(df, {"type": kind, "params": params})


def values(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", True), (2, None, "999", None), (3, 3.0, None, False), (4, 999.0, " b ", True)],
        "id int, n double, s string, b boolean")


def test_replace_missing_keeps_types_apart(mixed):
    assert values(act(mixed, "replace_missing", values=["999"]), "n") == [1.0, None, 3.0, None]
    assert values(act(mixed, "replace_missing", values=["999"]), "s") == ["a", "999", None, " b "]
    assert values(act(mixed, "replace_missing", values=["a", True]), "s") == [None, "999", None, " b "]
    assert values(act(mixed, "replace_missing", values=[True]), "b") == [None, None, False, None]
    df = mixed
    from tabulon.operators.actions import replace_missing
    assert values(replace_missing(df, ["s"], ["999"], match_text=True), "s") == ["a", None, None, " b "]


def test_dropna(mixed):
    assert values(act(mixed, "dropna_rows"), "id") == [1, 4]
    assert values(act(mixed, "dropna_rows", columns=["n", "b"], how="all"), "id") == [1, 3, 4]
    assert values(act(mixed, "dropna_rows", columns=["n"], how="odd"), "id") == [1, 3, 4]


def test_fillna(spark, mixed):
    assert values(act(mixed, "fillna", columns=["n"], strategy="zero"), "n") == [1.0, 0.0, 3.0, 999.0]
    assert values(act(mixed, "fillna", columns=["n"], strategy="median"), "n")[1] == 3.0
    assert values(act(mixed, "fillna", columns=["n"], strategy="mean"), "n")[1] == pytest.approx(1003 / 3)
    tied = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, s string")
    assert values(act(tied, "fillna", strategy="mode"), "s") == ["b", "a", "a"]
    none = tied.withColumn("s", F.lit(None).cast("string"))
    assert values(act(none, "fillna", columns=["s"], strategy="mode"), "s") == ["", "", ""]
    with pytest.raises(AnalysisError, match="missing_value"):
        act(mixed, "fillna", columns=["n"], strategy="value")
    with pytest.raises(AnalysisError, match="fill_type"):
        act(mixed, "fillna", columns=["n"], strategy="value", value="text")


def test_integer_column_takes_a_fractional_mean(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, k int")
    assert values(act(df, "fillna", columns=["k"], strategy="mean"), "k") == [1.0, 2.0, 1.5]


def test_casts(spark):
    df = spark.createDataFrame([(1, "1", "2024-03-01"), (2, "2.5", "2024/03/02"), (3, "x", "2024-03-03 10:00:00"),
                                (4, None, "soon")], "id int, x string, t string")
    assert values(act(df, "cast_type", column="x", to="float"), "x") == [1.0, 2.5, None, None]
    with pytest.raises(AnalysisError, match="not_integer"):
        act(df, "cast_type", column="x", to="int")
    assert [str(v) for v in values(act(df, "cast_type", column="t", to="datetime"), "t")] == [
        "2024-03-01 00:00:00", "2024-03-02 00:00:00", "2024-03-03 10:00:00", "None"]
    category = act(df, "cast_type", column="x", to="category")
    assert category.schema["x"].metadata == {"measure": "nominal"}
    assert values(act(category, "cast_type", column="x", to="string"), "x")[3] is None
    assert act(df, "cast_type", column="nope", to="int") is df


def test_standardize_and_constant_column(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(10)], "id int, x double, c double")
    row = act(df, "standardize", columns=["x", "c"]).agg(F.avg("x"), F.stddev_pop("x"), F.min("c"), F.max("c")).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1) and (row[2], row[3]) == (0.0, 0.0)
    assert act(df, "standardize") is df


def test_winsorize_clamps_bounds_and_keeps_nulls(spark):
    df = spark.createDataFrame([(i, float(i) if i else None) for i in range(101)], "id int, x double")
    got = values(act(df, "winsorize", columns=["x"], lower=0.1, upper=0.9), "x")
    assert got[0] is None and min(got[1:]) == pytest.approx(10.9) and max(got[1:]) == pytest.approx(90.1)
    wide = values(act(df, "winsorize", columns=["x"], lower=-3, upper=7), "x")
    assert wide[1:] == [float(i) for i in range(1, 101)]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b", 0), (2, "a", 1), (3, None, 2)], "id int, s string, z int")
    got = act(df, "one_hot_encode", columns=["s"])
    assert got.columns == ["id", "z", "s=a", "s=b"]
    assert [tuple(r)[2:] for r in got.orderBy("id").collect()] == [(False, True), (True, False), (False, False)]
    assert act(df, "one_hot_encode", columns=["s"], drop_first=True, prefix_sep="_").columns == ["id", "z", "s_b"]
    with pytest.raises(AnalysisError, match="too_many_levels"):
        act(df, "one_hot_encode", columns=["id"], max_levels=2)


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, None, 1), (5, None, 3)],
                               "rid int, k string, v int")
    keep = lambda how: sorted(r.rid for r in apply_action(
        df, {"type": "deduplicate", "params": {"subset": ["k"], "keep": how}}, order_by=["rid"]).collect())
    assert keep("first") == [1, 3, 4] and keep("last") == [2, 3, 5]
    assert act(df.drop("rid").union(df.drop("rid")), "deduplicate").count() == 5


def test_deduplicate_limits_hot_keys_before_the_shuffle(spark, lineitem):
    plan = act(lineitem, "deduplicate", subset=["l_returnflag"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_validation():
    with pytest.raises(AnalysisError, match="too_many_actions"):
        validate_actions([{"type": "deduplicate"}] * 21)
    for bad in ("x", [1], [{"type": "nope"}], [{"type": "fillna", "params": []}]):
        with pytest.raises(AnalysisError):
            validate_actions(bad)


STEPS = [
    {"type": "trim_whitespace", "params": {}},
    {"type": "fillna", "params": {"columns": ["n"], "strategy": "zero"}},
    {"type": "dropna_rows", "params": {"columns": ["s"]}},
    {"type": "rename_columns", "params": {"mapping": {"s": "text"}}},
    {"type": "drop_columns", "params": {"columns": ["b"]}},
]


def content(df):
    return df.columns, sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(moves=st.lists(st.sampled_from(["undo", "redo", 0, 2, 4, 9]), max_size=5))
def test_replay_equals_prefix(mixed, moves):
    data = Dataset(mixed).apply(*STEPS)
    cursor = len(STEPS)
    for move in moves:
        data = data.jump(move) if isinstance(move, int) else getattr(data, move)()
        cursor = move if isinstance(move, int) else cursor + (1 if move == "redo" else -1)
        cursor = max(0, min(cursor, len(STEPS)))
    assert data.history()["cursor"] == cursor
    assert content(data.df) == content(apply_actions(mixed, STEPS[:cursor]))


def test_new_action_drops_the_redo_tail(mixed):
    data = Dataset(mixed).apply(*STEPS).jump(1).apply({"type": "drop_columns", "params": {"columns": ["id"]}})
    assert data.history() == {"cursor": 2, "total": 2, "can_undo": True, "can_redo": False}
    assert data.redo().df.columns == ["n", "s", "b"]


def test_failed_action_leaves_the_dataset(mixed):
    data = Dataset(mixed)
    with pytest.raises(AnalysisError):
        data.apply({"type": "fillna", "params": {"columns": ["n"], "strategy": "value"}})
    assert data.history()["total"] == 0


def test_metadata_follows_renames(mixed):
    data = Dataset(mixed).apply(*STEPS[:4])
    data = data.set_column_meta("text", label="Text", measure="ORDINAL", missing_codes=["a"])
    assert data.meta["s"]["measure"] == "ordinal"
    assert data.df.schema["text"].metadata["label"] == "Text"
    assert data.jump(0).df.schema["s"].metadata["label"] == "Text"
    assert "s" not in data.column_meta() and data.column_meta()["text"]["label"] == "Text"
    assert "a" not in values(data.apply_missing_codes().df, "text")


def test_save_and_load(spark, mixed, tmp_path):
    data = Dataset(mixed, order_by=["id"]).apply(*STEPS).undo().set_column_meta("n", label="Number")
    data.save(str(tmp_path / "d"))
    back = Dataset.load(spark, str(tmp_path / "d"))
    assert back.history() == data.history() and back.meta == data.meta and back.order_by == ["id"]
    assert content(back.df) == content(data.df) and content(back.redo().df) == content(data.redo().df)


def test_transform(mixed):
    data = Dataset(mixed).apply(*STEPS)
    assert data.transform(lambda df: df) is data
    after = data.transform(lambda df: df.where("id > 1"))
    assert after.history()["total"] == 0 and after.df.count() == data.df.where("id > 1").count()


def test_saved_states_survive_breaks_and_load_without_reading_the_data(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, "ab"[i % 2]) for i in range(60)], "id int, x double, s string")
    steps = [{"type": "fillna", "params": {"columns": ["x"], "strategy": "median"}}, {"type": "winsorize", "params": {"columns": ["x"]}},
             {"type": "standardize", "params": {"columns": ["x"]}}, {"type": "one_hot_encode", "params": {"columns": ["s"]}}]
    data = Dataset(rows, order_by=["id"]).apply(*steps)
    expected = sorted(map(tuple, data.df.collect()))
    data.undo().save(path)
    data.save(path)
    assert len(list((tmp_path / "d" / "recipes").glob("number=*"))) == 1

    def broken(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as patch:  # a break before the new recipe is there, and one before the old one goes
        patch.setattr("tabulon.plans.dataset.write_json_document", broken)
        with pytest.raises(OSError):
            data.undo().save(path)
    assert sorted(map(tuple, Dataset.load(spark, path).df.collect())) == expected
    with monkeypatch.context() as patch:
        patch.setattr("tabulon.plans.dataset.delete_folder", broken)
        with pytest.raises(OSError):
            data.undo().save(path)
    loaded = Dataset.load(spark, path)
    assert loaded.cursor == 3

    spark.sparkContext.setJobGroup("replay", "")
    again = loaded.redo()
    three = loaded.df
    tracker = spark.sparkContext.statusTracker()
    assert not tracker.getJobIdsForGroup("replay")  # all numbers came from the recipe
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert three.count() == 60
    assert sorted(map(tuple, again.df.collect())) == expected
    changed = loaded.undo().apply({"type": "standardize", "params": {"columns": ["id"]}})
    assert changed.df.columns == ["id", "x", "s"] and abs(changed.df.agg({"id": "avg"}).first()[0]) < 1e-9
