"""Quality rules: base statistics per text, and robust multivariate outliers among them.

Native DataFrame functions only. The minimum covariance determinant (MCD) of each language and
source is found by concentration steps on a narrow table of transformed statistics: each step
is one aggregation over (group, start, distance bin), so that the moments of the h nearest rows
come out of the same pass that ranks them. Steps start from medians and quartiles and from
seeded subsets, go on until no determinant changes, and the start of least determinant is kept.
All moments are sums of integers: runs agree bit by bit. The same is done for all rows
together, and each group's estimate is drawn towards that one with the weight of PRIOR rows:
a group of any size is judged in the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microtide.llm.common import SPACES, free, lookup_join, materialize, release, table, words

SYMBOLS = "#*$%&|<>"
#: Transformed statistics, in units of 1/GRID, clipped to +-LIMIT units.
STATS = ("length", "word_length", "symbols", "dup_lines", "repeats")
GRID = 1000
LIMIT = 20 * GRID
#: Share of a group's rows that the estimate rests on, steps at most, and the relative change of a determinant that ends them.
H_SHARE = 0.75
STEPS = 10
STAND = 1e-2
#: Besides the diagonal start, as many starts from one row in SUBSET of each group.
SUBSETS, SUBSET = 2, 8
#: The estimate of all rows counts as much as so many rows of a group.
PRIOR = 30
#: Standard deviation added to each statistic's own: a group that (nearly) never varies doesn't
#: reject small change, such as one line said twice.
FLOORS = (0.6, 0.3, 0.15, 0.6, 0.6)
#: Squared distances above this are outliers: the 1 - 1e-7 quantile of chi-squared with 5 degrees.
CUTOFF = 42.3
#: Bins of squared distance per factor e.
BINS = 32
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _windows(w: Column) -> Column:
    """The three-word windows of an array of words: two hashes (96 bits) and the position."""
    window = lambda x, i: (x, F.get(w, i + 1), F.get(w, i + 2))
    all_of = F.transform(w, lambda x, i: F.struct(F.xxhash64(*window(x, i)).alias("a"), F.hash(*window(x, i)).alias("b"), i.alias("i")))
    return F.slice(all_of, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def base_stats(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns({
        "__w": words(F.col("text")),
        "__lines": lines,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    docs = docs.withColumns({
        "n_words": F.size("__w").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__win": _windows(F.col("__w")),
    }).drop("__w", "__lines")
    docs = docs.withColumn("__win", F.when(F.size(F.array_distinct(F.transform("__win", lambda s: s["a"]))) < F.size("__win"), F.sort_array("__win")))
    win = F.col("__win")
    same = lambda s, i: (s["a"] == F.get(win, i)["a"]) & (s["b"] == F.get(win, i)["b"])
    twice = F.filter(win, lambda s, i: F.coalesce(same(s, i + 1), F.lit(False)) | F.coalesce(same(s, i - 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    docs = docs.withColumn("n_repeat_words", F.when(win.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")).drop("__win")
    return docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _transformed() -> list[Column]:
    """The vector of a text with words, on the grid: logarithms and variance-stabilising roots."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    made = (
        F.log1p(n),
        4 * F.log(chars / n),
        4 * F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_symbols") / chars))),
        2 * F.log1p(F.col("n_dup_lines").cast("double")),
        4 * F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n))),
    )
    return [F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.round(x * GRID))).cast("long").alias(f"x{i}") for i, x in enumerate(made)]


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds l_ij, the factor L of cov = L L' (s_ij floored on the diagonal), and det, the logarithm of its determinant."""
    made = []
    for j in range(P):
        for i in range(j, P):
            rest = " - ".join([f"s{i}{j}" + f" + {(FLOORS[i] * GRID) ** 2}D" * (i == j)] + [f"l{i}{k} * l{j}{k}" for k in range(j)])
            made.append(f"sqrt(greatest({rest}, 1D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return df.selectExpr("*", *made, " + ".join(f"2 * ln(l{i}{i})" for i in range(P)) + " AS det")


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    made = [f"({' - '.join([f'x{i} - m{i}'] + [f'l{i}{j} * y{j}' for j in range(i)])}) / l{i}{i} AS y{i}" for i in range(P)]
    return df.selectExpr("*", *made, " + ".join(f"y{i} * y{i}" for i in range(P)) + " AS d2").drop(*[f"y{i}" for i in range(P)])


GROUP = ["g_lang", "g_source"]
#: The group of all rows; those of a language and source are marked by a leading "=".
EVERYONE = "*"


SUMS = [f"a{i}" for i in range(P)] + [f"b{i}{j}" for i, j in PAIRS]


def _moments(rows: DataFrame, by: list[str], *more: str) -> DataFrame:
    """c, and the sums a_i and b_ij of coordinates and their products."""
    x = [f"sum(x{i}) AS a{i}" for i in range(P)] + [f"sum(x{i} * x{j}) AS b{i}{j}" for i, j in PAIRS]
    return rows.groupBy(*by).agg(*map(F.expr, ["count(1) AS c", *x, *more]))


def _estimate(sums: DataFrame, by: list[str], scale: float) -> DataFrame:
    """Estimates from sums, which are added up as exact decimals; n (rows of the group) and was (the determinant before) are carried on."""
    got = sums.groupBy(*by).agg(*map(F.expr, ["first(n) AS n", "first(was) AS was", "double(sum(c)) AS c", *[f"double(sum(CAST({c} AS DECIMAL(38, 0)))) AS {c}" for c in SUMS]]))
    means = [f"a{i} / c AS m{i}" for i in range(P)]
    covs = [f"(b{i}{j} / c - (a{i} / c) * (a{j} / c)) * {scale!r}D AS s{i}{j}" for i, j in PAIRS]
    return _cholesky(got.selectExpr(*by, "n", "was", *means, *covs))


def _starts(vectors: DataFrame) -> DataFrame:
    """Estimates per group and start. Start 0: medians and squared normal-consistent interquartile ranges; others: seeded subsets.

    The exact percentiles count distinct grid values, of which a statistic has 40,001 at most.
    A group of which a subset has no row lacks that start.
    """
    got = materialize(vectors.groupBy(*GROUP).agg(*map(F.expr, ["count(1) AS n", *[f"percentile(x{i}, array(0.25, 0.5, 0.75)) AS q{i}" for i in range(P)]])))
    var = [f"pow((q{i}[2] - q{i}[0]) / 1.349, 2) AS s{i}{j}" if i == j else f"0D AS s{i}{j}" for i, j in PAIRS]
    first = _cholesky(got.selectExpr(*GROUP, "0 AS start", "n", "double(null) AS was", *[f"q{i}[1] AS m{i}" for i in range(P)], *var))
    drawn = F.filter(F.array(*[F.when(F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(SUBSET)) == 0, F.lit(k)) for k in range(1, SUBSETS + 1)]), lambda k: k.isNotNull())
    by = [*GROUP, "start"]
    some = _moments(vectors.withColumn("start", F.explode(drawn)), by).join(got.select(*GROUP, "n"), GROUP)
    return first.unionByName(_estimate(some.selectExpr("*", "double(null) AS was"), by, 1.0))


def _concentrate(vectors: DataFrame, now: DataFrame, h_share: float) -> DataFrame:
    """One concentration step: moments of the nearest rows, whole bins until h of them are in."""
    by = [*GROUP, "start"]
    before = now.drop("was", *[f"s{i}{j}" for i, j in PAIRS]).withColumnRenamed("det", "was")
    dealt = _distance(lookup_join(vectors.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(SUBSETS)))), before, by, ["doc_id"], "inner"))
    bins = _moments(dealt.selectExpr("*", f"int(floor(ln(d2 + 1e-6D) * {BINS})) AS bin"), [*by, "bin"], "first(n) AS n", "first(was) AS was")
    nearer = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("closer", F.coalesce(F.sum("c").over(nearer), F.lit(0))).where(F.col("closer") < F.ceil(F.col("n") * h_share))
    return _estimate(bins, by, _consistency(h_share))


def estimate(vectors: DataFrame, h_share: float = H_SHARE, steps: int = STEPS) -> DataFrame:
    """(g_lang, g_source, n, m_i, s_ij, l_ij, det) per group of ``vectors`` (doc_id, g_lang, g_source, x_i): the start of least determinant after its last step."""
    now = materialize(_starts(vectors))
    for _ in range(steps):
        last, now = now, materialize(_concentrate(vectors, now, h_share))
        release(last)
        moved = now.agg(F.max(F.abs(F.col("det") - F.col("was"))).alias("m")).first()["m"]
        if moved is None or moved <= STAND:
            break
    columns = [c for c in now.columns if c not in (*GROUP, "start", "was")]
    best = now.groupBy(*GROUP).agg(F.min_by(F.struct(*columns), F.struct("det", "start")).alias("e"))
    return best.select(*GROUP, "e.*")


def _shrunk(found: DataFrame, prior: float) -> DataFrame:
    """Every group's estimate and that of all rows, weighted by the group's rows and ``prior``."""
    found = materialize(found)
    whole = found.where(F.col("g_lang") == EVERYONE).first()
    factor = [f"l{i}{j}" for i, j in PAIRS]
    if whole is None:
        return found.select(*GROUP, *[f"m{i}" for i in range(P)], *factor)
    drawn = [f"(n * {c} + {prior} * {whole[c]!r}D) / (n + {prior}) AS {c}" for c in [f"m{i}" for i in range(P)] + [f"s{i}{j}" for i, j in PAIRS]]
    return _cholesky(found.where(F.col("g_lang") != EVERYONE).selectExpr(*GROUP, *drawn)).select(*GROUP, *[f"m{i}" for i in range(P)], *factor)


def _chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if x > 0 else 0.0


def _consistency(h: float) -> float:
    """Factor that makes the covariance of the nearest h consistent for normal rows: h / P(chi2_{p+2} <= q_h)."""
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, P) < h else (low, mid)
    return h / _chi2_cdf(low, P + 2)


def judge(docs: DataFrame, h_share: float = H_SHARE, steps: int = STEPS, prior: float = PRIOR, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, h (hash of text), statistics, base_failed, distance2 and kept, per row of ``docs``.

    Estimates rest on rows that pass the base rules; of these, those beyond ``cutoff`` of their
    language's and source's estimate aren't kept. distance2 is null for rows that fail the base
    rules. Null language or source is a value like others; null text has no words and fails; an
    empty table gives no rows. A repeated row counts as often as it is there.
    """
    base = base_stats(docs.select("doc_id", "text", F.col("lang").alias("g_lang"), F.col("source").alias("g_source")))
    ok = ~F.col("base_failed")
    base = base.select("doc_id", F.xxhash64("text", "g_lang", "g_source").alias("h"), *GROUP, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *[F.when(ok, x).alias(f"x{i}") for i, x in enumerate(_transformed())])
    base = materialize(base)
    marked = lambda c: F.concat(F.lit("="), F.coalesce(c, F.lit("")), F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")))
    base = base.withColumns({c: marked(c) for c in GROUP})
    x = [f"x{i}" for i in range(P)]
    both = F.explode(F.array(F.struct(*GROUP), F.struct(F.lit(EVERYONE).alias("g_lang"), F.lit(EVERYONE).alias("g_source"))))
    vectors = base.where(ok).select("doc_id", both.alias("g"), *x).select("doc_id", "g.*", *x)
    now = materialize(_shrunk(estimate(vectors, h_share, steps), prior))
    out = _distance(lookup_join(base, now, GROUP, ["doc_id"]))
    kept = ok & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return out.select("doc_id", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("d2", 6).alias("distance2"), kept.alias("kept"))


def keep(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rejected rows are found again by doc_id and the hash of text, language and source.
    """
    d, h = free(docs, "__d", "__h")
    gone = judge(docs, **settings).where(~F.col("kept")).select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text", "lang", "source") == F.col(h)), "left_anti")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("h")
