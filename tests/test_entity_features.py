import io
from contextlib import redirect_stdout
from datetime import datetime, timezone

from pyspark.sql import functions as F

from talewind.operators import entity_features as module
from talewind.operators.entity_features import entity_features, wide, wide_features

ROWS = [("a", 1, 10, 5), ("a", 1, 30, None), ("a", 2, None, 7), ("b", 1, 5, 2), (None, 1, 5, 2), ("b", None, 5, 2)] + [("hot", i % 300, i, 1) for i in range(3000)]


def frame(spark, rows, amount="long"):
    return spark.createDataFrame(rows, f"entity string, kind int, ts_us long, amount {amount}").withColumn("n", F.lit("clash"))


def test_counts_recency_totals_and_defaults(spark):
    df = frame(spark, ROWS).repartition(5)
    got = {r.entity: r.features for r in entity_features(df).collect()}
    assert set(got) == {"a", "b", "hot"}
    assert (got["a"][1].n, got["a"][1].total, got["a"][2].latest, got["a"][2].total) == (2, 5, None, 7)
    assert got["a"][1].latest == datetime.fromtimestamp(30e-6, timezone.utc).replace(tzinfo=None)
    assert len(got["hot"]) == 300 and all(v.n == 10 and v.total == 10 for v in got["hot"].values())
    kinds = [1, 2, 999]
    w = {r.entity: r for r in wide_features(df, kinds).collect()}
    assert (w["a"].n_1, w["a"].n_999, w["b"].total_1, w["b"].latest_2) == (2, 0, 2, None)
    assert w == {r.entity: r for r in wide(entity_features(df), kinds).collect()}


def test_every_batch_size_gives_the_same_rows(spark, monkeypatch):
    want = {r.entity: r.features for r in entity_features(frame(spark, ROWS).repartition(5)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.entity: r.features for r in entity_features(frame(spark, ROWS).repartition(5)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_totals_beyond_38_digits_are_null(spark):
    most = "9" * 38
    rows = [("a", 1, 1, most), ("a", 1, 2, most), ("a", 2, 1, most), ("a", 3, 1, "1" + "0" * 38), ("a", 3, 1, "5"), ("a", 4, 1, "0" * 50 + "12"), ("a", 5, 1, "x"), ("a", 6, 1, "-7")]
    got = entity_features(frame(spark, rows, "string").repartition(3)).first().features
    assert {k: v.total and int(v.total) for k, v in got.items()} == {1: None, 2: int(most), 3: None, 4: 12, 5: None, 6: -7}
    assert got[1].n == 2 and wide_features(frame(spark, rows, "string"), [1, 2]).first().total_1 is None


def test_plan_streams_sorted_runs_behind_one_shuffle(spark):
    for df in (entity_features(frame(spark, ROWS)), wide_features(frame(spark, ROWS), [1])):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        nodes = [x.strip("+-:* 0123456789()").split(" ")[0] for x in out.getvalue().splitlines()]
        nodes = [x for x in nodes if x in ("Exchange", "Sort", "MapInArrow", "HashAggregate", "SortAggregate", "ObjectHashAggregate")]
        assert nodes == ["MapInArrow", "Sort", "Exchange", "MapInArrow"]  # from the result down


def test_empty(spark):
    assert entity_features(frame(spark, [])).count() == 0 and wide_features(frame(spark, []), [1]).count() == 0
    assert entity_features(frame(spark, [(None, 1, 1, 1)])).count() == 0 and module.partitions(spark) > 0
