"""Stages on tables with names they use inside, map columns and ids of any type; rollups that are compacted and broken off."""

import random
from decimal import Decimal

import pytest

from microtide.llm import decontaminate, jaccard, lm_score, mixing, quality, secrets, token_counts

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, __d long, __h long, __row string, __rows int, __gone boolean, __cuts string, __D_ string, n int, token string, cid long, rows int, tags map<string,int>"


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(20)
    rows = [(i, text(90)) for i in range(40)]
    rows += [(50, rows[0][1]), rows[1], rows[1], (51, f"{text(70)} {item} {text(9)}"), (52, text(60) + " password=abcdefabcdef1234"), (53, None), (54, "few")]
    rest = (5, 6, "row", 7, True, "cuts", "d", 8, "token", 9, 10)
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), *rest, {"a": i}) for i, t in rows], CLASHING)
    return docs, spark.createDataFrame([(1, item)], "item_id long, text string")


def test_stages_pass_clashing_names_and_maps_through(spark, clashing):
    docs, benchmark = clashing
    n = docs.count()
    stages = {
        "keep": (quality.keep, {53, 54}, 0),
        "distinct": (jaccard.distinct, {50}, 2),
        "clean": (lambda d: decontaminate.clean(d, benchmark), {51}, 0),
        "redact": (secrets.redact, set(), 0),
    }
    for name, (stage, gone, repeats) in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == n - len(gone) - repeats and not gone & {x.doc_id for x in rows}, name
        assert all((x.__d, x.__row, x.__gone, x.token, x.tags) == (5, "row", True, "token", {"a": x.doc_id}) for x in map(_plain, rows)), name
        empty = stage(docs.limit(0))
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert set(docs.columns) < set(mixing.emit(docs).columns)


def _plain(row):
    """A row whose names Python doesn't mangle."""
    class It:
        pass

    it = It()
    it.__dict__ = row.asDict()
    return it


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(12,0)", "string", "bigint"])
def test_scores_ids_of_any_type(spark, kind):
    rows = spark.createDataFrame([(i, f"some text of words {i} " * 3) for i in range(12)], "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    got = lm_score.score(rows)
    assert got.schema["doc_id"].dataType == rows.schema["doc_id"].dataType
    convert = {"string": str, "decimal(12,0)": Decimal}.get(kind, int)
    assert {x.doc_id for x in got.collect()} == {convert(i) for i in range(12)}


KEYED = "source string, lang string, tokenizer string, docs long, tokens long"


def tokens(rollup):
    return sum(r.tokens for r in rollup.totals().collect())


def test_rollup_keeps_totals_over_compactions(spark, tmp_path):
    delta = lambda n: spark.createDataFrame([("s", None, "w", 1, n)], KEYED)
    rollup = token_counts.Rollup(spark, f"{tmp_path}/r")
    assert rollup.apply("a", delta(1))
    rollup.compact("9")
    assert not rollup.apply("a", delta(1)) and tokens(rollup) == 1
    assert rollup.apply("b", delta(10))
    rollup.compact("10")  # less than "9" by name
    assert not rollup.apply("a", delta(1)) and not rollup.apply("b", delta(10)) and tokens(rollup) == 11
    rollup.compact("10")
    assert rollup.apply("c", delta(100)) and tokens(rollup) == 111
    rollup.compact("1")
    assert tokens(token_counts.Rollup(spark, f"{tmp_path}/r")) == 111


class Broken(Exception):
    pass


@pytest.mark.parametrize("at", range(6))
def test_rollup_survives_a_compaction_that_breaks_off(spark, tmp_path, at):
    """``at`` counts the steps that end: two writes, the mark, the deletion of each batch and of an old snapshot."""
    delta = lambda n: spark.createDataFrame([("s", "en", "w", 1, n)], KEYED)
    rollup = token_counts.Rollup(spark, f"{tmp_path}/r")
    rollup.apply("a", delta(1))
    rollup.compact("first")
    rollup.apply("b", delta(10))
    rollup.compact("second")
    for name, n in (("c", 100), ("d", 1000)):
        rollup.apply(name, delta(n))
    left = [at]

    def step():
        if not left[0]:
            raise Broken
        left[0] -= 1

    class Files:
        """The file system, with each of its steps counted."""

        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            if name in ("create", "delete"):
                step()
            return getattr(self.real, name)

    real = rollup._files
    rollup._files = Files(real)
    writes = type(delta(0).write)
    old = writes.parquet

    def parquet(self, path, *a, **b):
        step()
        return old(self, path, *a, **b)

    writes.parquet = parquet
    try:
        with pytest.raises(Broken):
            rollup.compact("third")
    finally:
        writes.parquet = old
    for again in (token_counts.Rollup(spark, f"{tmp_path}/r"),) * 2:
        assert tokens(again) == 1111
        assert not any(again.apply(b, delta(1)) for b in "abcd")
        again.compact("third")
        assert tokens(again) == 1111 and again.committed() == []
