"""Terms against brute containment, scores against a plain parser, and the read-through loader."""

import json
import os
import random
import re
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from microtide.functions import scalar
from microtide.operators import news
from microtide.sources.loader import ReadThrough


def words(text):
    return [w for w in re.split(r"[^\w&]+|_", (text or "").upper()) if w]


def test_terms_equal_brute_containment(spark):
    r = random.Random(1)
    v = ["tata", "steel", "reliance", "M&M", "nifty", "a", "b", "Bank", "of", "x1"]
    texts = [" ".join(r.choice(v) + r.choice(["", ",", ".", "-", "\n"]) for _ in range(r.randint(0, 30))) for _ in range(120)] + [None, "", "steel", "TATA STEEL tata"]
    terms = ["Tata Steel", "M&M", "bank of a", "Reliance", "a", "missing", "x1 x1", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {tuple(x) for x in news.matches(docs, "id", "text", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {(i, t) for i, x in enumerate(texts) for t in terms if t and f" {' '.join(words(t))} " in f" {' '.join(words(x))} "}
    assert got == want and len(want) > 50
    assert news.matches(docs, "id", "text", spark.createDataFrame([], "term string")).count() == 0
    assert {x.id for x in news.relevant(docs, "id", "text", spark.createDataFrame([("x1",)], "symbol string")).collect()} == {i for i, x in enumerate(texts) if {"X1", "NIFTY"} & set(words(x))}


def test_symbols_by_universe_and_prefix(spark):
    docs = spark.createDataFrame([(1, "Buy TCS today (NSE: INFY) and bse  wipro now"), (2, "nothing"), (3, None)], "id int, text string")
    got = {x.id: x.symbols for x in news.symbols(docs, "id", "text", spark.createDataFrame([("TCS",), ("BUY",)], "symbol string")).collect()}
    assert got == {1: ["BUY", "INFY", "TCS", "WIPRO"], 2: [], 3: []}


def test_answers_are_parsed_and_clamped(spark):
    good = {"sentiment": -3, "uncertainty": 0.4, "widen_factor": 9, "pause_minutes": 999, "mm_action": "PAUSE", "symbols": ["A"], "event_type": "deal"}
    cases = [json.dumps(good), "```json\n" + json.dumps(good) + "\n```", "```" + json.dumps({"mm_action": "HOLD"}) + "```", "{}", "no", None, "[1]", ""]
    got = [x.s for x in spark.createDataFrame(list(enumerate(cases)), "i int, raw string").orderBy("i").select(news.parsed_scores(F.col("raw")).alias("s")).collect()]
    assert got[0] == got[1] and (got[0].sentiment, got[0].widen_factor, got[0].pause_minutes, got[0].mm_action, got[0].symbols) == (-1.0, 5.0, 240, "PAUSE", ["A"])
    assert got[2] == got[3] and (got[3].sentiment, got[3].uncertainty, got[3].widen_factor, got[3].pause_minutes, got[3].mm_action, got[3].event_type) == (0.0, 0.0, 1.0, 0, "NORMAL", "noise")
    assert got[4:] == [None] * 4


def test_widening(spark):
    rows = [("AVOID", None, 5, 1.0, None, None, 999.0), ("PAUSE", None, 5, 1.3, 0, "LOW", 3.0), ("PAUSE", 6, 5, 1.0, None, None, 999.0), ("PAUSE", 5, 5, 1.0, 1, None, 2.0), ("NORMAL", 9, 5, 1.0, 3, "MEDIUM", 1.5), ("WIDEN", None, 5, 1.1, 9, "MEDIUM", 1.2), ("WIDEN", None, 5, 4.0, 0, "HIGH", 4.0)]
    df = spark.createDataFrame(rows, "a string, p int, n int, w double, d int, r string, want double")
    assert all(x.got == x.want for x in df.select("want", news.effective_widening(*[F.col(c) for c in "apnwdr"]).alias("got")).collect())


@pytest.fixture
def store(spark, tmp_path):
    remote, cache = str(tmp_path / "remote"), str(tmp_path / "cache")
    day = lambda n: spark.createDataFrame([(i, float(n + i)) for i in range(3)], "ts_sec long, close double")
    day(10).write.parquet(f"{remote}/A/2024-01-01")
    day(20).write.parquet(f"{remote}/B_2024-01-01.parquet")
    day(30).write.parquet(f"{remote}/C24JANFUT_2024-01-01.parquet")
    day(40).write.parquet(f"{remote}/C24FEBFUT_2024-01-01.parquet")
    os.makedirs(cache)
    return remote, cache


def test_second_read_touches_only_the_cache(spark, store):
    remote, cache = store
    wanted = [(s, "2024-01-01") for s in "ABCD"] + [("A", "2024-01-02")]
    loader = ReadThrough(spark, remote, cache)
    first = sorted(map(tuple, loader.load(wanted).select("symbol", "date", "ts_sec", "close").collect()))
    assert {x[0] for x in first} == {"A", "B", "C"} and len(first) == 9
    assert [x[3] for x in first if x[0] == "C"] == [30.0, 31.0, 32.0]  # the last by name
    assert loader.sync(wanted) == {"kept": 3, "filled": 0, "missing": 2}
    shutil.rmtree(remote)
    again = ReadThrough(spark, remote, cache)
    os.makedirs(remote)
    assert sorted(map(tuple, again.load(wanted).select("symbol", "date", "ts_sec", "close").collect())) == first
    assert sorted(map(tuple, again.status().collect())) == [(s, "2024-01-01") for s in "ABC"]
    assert again.load([("D", "2024-01-01")]) is None


def test_broken_fill_is_not_served(spark, store):
    remote, cache = store
    loader = ReadThrough(spark, remote, cache)
    os.makedirs(f"{cache}/_fill-dead")
    with open(f"{cache}/_fill-dead/part-0.parquet", "w") as f:
        f.write("half a file")
    assert not loader.is_cached("A", "2024-01-01")

    class Broken(Exception):
        pass

    class Files:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            if name == "rename":
                raise Broken
            return getattr(self.real, name)

    plain = loader._files
    loader._files = lambda text: Files(plain(text))
    with pytest.raises(Broken):
        loader.fill("A", "2024-01-01")
    loader._files = plain
    assert not loader.is_cached("A", "2024-01-01")
    assert loader.load([("A", "2024-01-01")]).count() == 3
    # A second writer that comes late leaves the first one's partition as it is.
    assert loader.fill("A", "2024-01-01") and loader.load([("A", "2024-01-01")]).count() == 3
    assert not [f for f in os.listdir(f"{cache}/symbol=A/date=2024-01-01") if f.startswith("_fill")]


def test_upper_case_is_one_character_for_one(spark):
    con = duckdb.connect()
    rows = [(i, f"a{c}b {c}") for i, c in enumerate([*scalar.ONE_UPPER, "ä", "ς", "i", "ẞ"])]
    want = dict(con.execute("SELECT unnest($1), upper(unnest($2))", [[i for i, _ in rows], [t for _, t in rows]]).fetchall())
    got = {r.i: r.u for r in spark.createDataFrame(rows, "i int, t string").select("i", scalar.simple_upper(F.col("t")).alias("u")).collect()}
    assert got == want


def test_terms_with_sharp_s_and_ligatures(spark):
    terms = spark.createDataFrame([("straße",), ("ﬁnance",), ("strasse",)], "term string")
    docs = spark.createDataFrame([(1, "Die Straße."), (2, "ﬁnance"), (3, "STRASSE finance"), (4, None)], "k int, t string")
    got = {(r.k, r.term) for r in news.matches(docs, "k", "t", terms).collect()}
    assert got == {(1, "straße"), (2, "ﬁnance"), (3, "strasse")}


def test_symbols_after_a_prefix_are_ascii_runs_of_the_text(spark):
    docs = spark.createDataFrame([(1, "nse: ﬁx"), (2, "NSE\x0bABC"), (3, "nse:\n\tabc Bse  xyzß")], "k int, t string")
    got = {r.k: r.s for r in docs.select("k", news.prefixed_symbols(F.col("t")).alias("s")).collect()}
    assert got == {1: [], 2: [], 3: ["ABC", "XYZ"]}
