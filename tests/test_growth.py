"""What keeps the work of a query in proportion to its rows."""

import datetime
import io
import random
from contextlib import redirect_stdout

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from microtide.operators import importance, news, regimes, windows

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_clock_sums_equal_plain_ones_and_frames_only_grow(spark):
    r = random.Random(3)
    rows = [(k, r.randint(0, 300), i, r.choice([None, 1, 5, -7])) for k in "ab" for i in range(150)]
    s = windows.Series(["k"], "ts")
    got = {(x.k, x.i): x.s for x in spark.createDataFrame(rows, "k string, ts long, i int, v long").select("k", "i", s.clock_sum(F.col("v"), 40).alias("s")).collect()}
    assert got == {(k, i): sum(v or 0 for q, u, _, v in rows if q == k and t - 39 <= u <= t) for k, t, i, _ in rows}
    assert "43199" not in plan(entry.queries()["interarrival_cv"](spark, SF))


def test_equal_prices_are_not_above_their_mean(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(f * 60 + i, at + datetime.timedelta(seconds=f), 1, f"s{f}", 0.01 * (1 + 37 * f), '{"k": 1}') for f in range(60) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.symbol, r.state, r["size"]) for r in entry.queries()["state_profile"](spark, str(tmp_path)).collect()}
    assert got == {(f"s{f}", "below", 60) for f in range(60)}


def test_a_depth_fit_reads_its_levels_once(spark):
    assert plan(entry.queries()["depth_decay_fit"](spark, SF)).count("zip_with(") == 1


def test_an_answer_is_parsed_once(spark):
    p = plan(entry.queries()["news_rollup"](spark, SF))
    assert p.count("from_json(") == 1
    raw = spark.createDataFrame([(1, '{"sentiment": 3, "symbols": ["A"]}'), (2, "no"), (3, '```json\n{"uncertainty": 0.5}\n```'), (4, None)], "i int, raw string")
    assert {r.i: (r.sentiment, r.uncertainty, r.symbols) for r in news.scored(raw, "raw", ["i"]).collect()} == {1: (1.0, 0.0, ["A"]), 3: (0.0, 0.5, [])}


def test_newton_steps_run_over_batches(spark):
    assert "ArrowEvalPython" in plan(entry.queries()["implied_vol_newton"](spark, SF))


def test_bisection_runs_over_batches(spark):
    df = entry.queries()["implied_vol"](spark, SF)
    assert "ArrowEvalPython" in plan(df)
    got = {tuple(x) for x in df.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    assert got == {(k, float(v)) for k, v in con.execute(entry.oracle_sql()["implied_vol"]).fetchall()} and got


def test_rounds_of_a_hidden_markov_fit_make_their_rows_once(spark):
    df = spark.range(200).select((F.col("id") % 4).alias("k"), "id", (F.randn(1) * F.when(F.col("id") > 100, 3).otherwise(1)).alias("x"))
    df, seen = counted(spark, df, "id")
    model = regimes.fit_hmm(df, ["k"], ["id"], "x", k=2, rounds=5)
    assert seen.value == 200 and model.sd[0] < model.sd[1]


def counted(spark, df, column):
    """``df`` and an accumulator of how often its rows are made."""
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    return df.mapInPandas(run, df.schema), seen


def test_models_of_importance_make_their_rows_once(spark):
    df = spark.range(400).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", (F.col("a") > 0.5).cast("double"))
    df, seen = counted(spark, df, "id")
    folds = [(F.col("id") % 2 == 0, F.col("id") % 2 == 1), (F.col("id") % 2 == 1, F.col("id") % 2 == 0)]
    got = {r.feature: r.sfi for r in importance.importance(df, ["a", "b"], "y", "id", folds, trees=2, depth=2).collect()}
    assert seen.value == 400 and got["a"] > 0.9
