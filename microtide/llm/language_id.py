"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams and label counts come from all learning texts in one
pass. The weights are trained by follow-the-regularised-leader with elastic-net penalties on a
bounded sample (SAMPLE rows per language at the most, in expectation) in one task, and
calibrated by a temperature on a held-back tenth of it. Every text is scored as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microtide.llm.common import materialize, table

BITS = 14
DIM = 1 << BITS
ORDERS = (1, 2, 3)
#: Rows per language that the weights are trained on.
SAMPLE = 1000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 1e-4, 1e-4
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: itself lower-cased if it is a letter, else a space (built once per worker)."""
    if not _LETTER:
        made = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                made[i] = ord(low) if len(low) == 1 else i
        _LETTER.append(made)
    return _LETTER[0]


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of a text's letters, runs of others being one boundary; None without letters."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    if space.all():
        return None
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    counts = np.zeros(DIM, np.int64)
    h = np.zeros(len(c), np.uint64)
    for k in ORDERS:
        h = h[: len(c) - k + 1] * np.uint64(0x100000001B3) + c[k - 1 :] + np.uint64(k)
        mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        counts += np.bincount(mixed.astype(np.int64), minlength=DIM)
    return counts


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within a partition: rows per bucket (document frequency) and, as negative buckets, rows per language."""
    df, n, langs = np.zeros(DIM, np.int64), 0, {}
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            got = grams(text)
            if got is not None:
                df += got > 0
                n += 1
                langs[lang] = langs.get(lang, 0) + 1
    some = np.flatnonzero(df)
    if not n:
        return  # Arrow has no type for the columns of no rows
    yield pd.DataFrame({"lang": pd.Series([None] * len(some), dtype=object), "bucket": some.astype(np.int32), "c": df[some]})
    yield pd.DataFrame({"lang": list(langs), "bucket": np.full(len(langs), -1, np.int32), "c": np.array(list(langs.values()), np.int64)})


def _vectors(idf) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for lang, order, text in zip(frame["lang"], frame["order"], frame["text"], strict=True):
                got = grams(text)
                if got is not None:
                    x = _tfidf(got, idf.value)
                    at = np.flatnonzero(x)
                    rows.append((lang, order, at.astype(np.int32), x[at].astype(np.float32)))
            if rows:
                yield pd.DataFrame(rows, columns=["lang", "order", "at", "x"])

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (DIM, k): FTRL-proximal with per-coordinate rates, penalties L1 and L2."""
    z, n = np.zeros((DIM, k)), np.zeros((DIM, k))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - sigma * w
            n[at] = ns + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda u: -np.log(np.maximum(_softmax(logits / np.exp(u))[np.arange(len(y)), y], 1e-12)).mean()
    low, high = np.log(0.05), np.log(20.0)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _train(langs: list[str]) -> object:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        rows = [(np.asarray(at), np.asarray(x, np.float64), langs.index(lang)) for lang, at, x in zip(frame["lang"], frame["at"], frame["x"], strict=True)]
        back = [r for i, r in enumerate(rows) if i % 10 == 9]
        w = ftrl([r for i, r in enumerate(rows) if i % 10 != 9], len(langs))
        t = temperature(np.array([x @ w[at] for at, x, _ in back]), np.array([y for _, _, y in back], int))
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "t": [t]})

    return run


def _predict(model) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, w, t, langs = model.value
        for frame in frames:
            names, scores = [], []
            for text in frame["text"]:
                got = grams(text) if langs else None
                if got is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.flatnonzero(got)
                x = _tfidf(got[at], idf[at])
                p = _softmax((x @ w[at]) / t)
                best = int(p.argmax())
                names.append(langs[best])
                scores.append(float(p[best]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": names, "score": scores})

    return run


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of rows that are not held out. A text that is null or
    has no letter is "und" with score 0, and so is every text if nothing can be learned. A null
    doc_id is not held out; repeated rows are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = held_out(F.col("doc_id"))
    learn = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    stats = learn.select("lang", "text").mapInPandas(_frequencies, "lang string, bucket int, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()
    by_lang = stats[stats["bucket"] < 0].sort_values("lang")
    langs, total = list(by_lang["lang"]), int(by_lang["c"].sum())
    buckets = stats[stats["bucket"] >= 0]
    df = np.zeros(DIM)
    df[buckets["bucket"].to_numpy()] = buckets["c"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    if langs:
        rate = F.create_map(*[F.lit(v) for r in by_lang.itertuples() for v in (r.lang, float(sample) / r.c)])
        order = F.xxhash64("doc_id", "text")
        chosen = learn.where(F.pmod(order, F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)).select("lang", order.alias("order"), "text")
        vectors = chosen.mapInPandas(_vectors(spark.sparkContext.broadcast(idf)), "lang string, order long, at array<int>, x array<float>")
        fit = vectors.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(_train(langs), "w binary, t double").first()
        w, t = np.frombuffer(fit["w"], np.float32).reshape(DIM, len(langs)), fit["t"]
    else:
        w, t = np.zeros((DIM, 1), np.float32), 1.0
    model = spark.sparkContext.broadcast((idf, w, t, langs))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", held.alias("held_out"), "text").mapInPandas(_predict(model), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
