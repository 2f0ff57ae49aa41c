"""Secret scans: fixed patterns, and multipart credentials linked by an interval join within scopes.

Native DataFrame functions only. Positions come from splitting a text at a pattern and adding up
the lengths of pieces and matches, one running sum per document and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microtide.llm.common import free, table

# Base kinds, in the order of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Parts that count only together with a complementary one.
IDENT = r"""(?i:client|app|account|access|key|user|tenant)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{6,}"""
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
BREAK = r"\n[\x20\x09\x0D]*\n"

BASE = ("assign", "access", "hex")
#: kind -> (pattern, role, order among kinds)
KINDS = {
    "assign": (ASSIGN, "secret", 0),
    "access": (ACCESS, "identifier", 1),
    "hex": (HEX, "secret", 2),
    "ident": (IDENT, "identifier", 3),
    "opaque": (OPAQUE, "secret", 4),
    "endpoint": (ENDPOINT, "endpoint", 5),
    "break": (BREAK, "", 6),
}
#: Any text with a span matches this; others need no further work.
ANY = "|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, IDENT, ENDPOINT)) + r"|[A-Za-z0-9+/_=-]{24}"
COMPLEMENTS = {"identifier": ("secret",), "endpoint": ("secret",), "secret": ("identifier", "endpoint")}
#: Characters between two parts, at most, for them to be linked.
REACH = 200
MASK = "[SECRET]"


def _text_key() -> Column:
    return F.xxhash64("text")


def _parts(hits: DataFrame) -> DataFrame:
    """One row per match of any kind: doc_id, h, kind, start, end."""
    found = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.split("text", pattern, -1), F.length).alias("gaps"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"),
        )
        for kind, (pattern, _, _) in KINDS.items()
    ])
    rows = hits.select("doc_id", "h", F.explode(found).alias("f")).where(F.size("f.found") > 0)
    # The piece after the last match has no match: its null row goes.
    rows = rows.select("doc_id", "h", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("f.gaps").alias("gap"), F.col("f.found").alias("match"))).alias("pos", "z"))
    rows = rows.where("z.match is not null").withColumn("n", F.length("z.match"))
    so_far = Window.partitionBy("doc_id", "h", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("z.gap") + F.col("n")).over(so_far)).withColumn("start", F.col("end") - F.col("n"))
    text = F.col("z.match")
    whole = (
        F.when(F.col("kind") == "assign", F.length(F.regexp_extract(text, ASSIGN, 2)) >= 12)
        .when(F.col("kind") == "opaque", text.rlike("[0-9]") & text.rlike("[a-z]") & text.rlike("[A-Z]"))
        .otherwise(F.lit(True))
    )
    return rows.where(whole).select("doc_id", "h", "kind", "start", "end")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts with a complementary part at most ``reach`` characters away in the same scope.

    The distance is that of the intervals: from the end of the earlier part to the start of the
    later one, none if they overlap. Complements are first reduced to the least start and the
    greatest end per scope, role and bin of ``reach`` characters, in all bins that they span; a
    candidate meets the bins of its interval, widened by ``reach``. A bin is shorter than what a
    candidate reaches, so two complements that are both out of reach, one on either side, are in
    no bin together, and start and end may be of different parts.
    """
    role = F.create_map(*[F.lit(x) for k, (_, r, _) in KINDS.items() for x in (k, r)])
    parts = parts.where("kind != 'break'").withColumn("role", role[F.col("kind")])
    bins = lambda first, last: F.explode(F.sequence(F.floor(first / reach), F.floor(last / reach)))
    at = ["doc_id", "h", "scope", "bin"]
    sides = parts.withColumn("bin", bins(F.col("start"), F.col("end") - 1)).groupBy(*at, "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.where(~F.col("kind").isin(*BASE)).withColumnRenamed("role", "own")
    weak = weak.withColumn("bin", bins(F.col("start") - reach - 1, F.col("end") + reach))
    fits = F.lit(False)
    for own, others in COMPLEMENTS.items():
        fits = fits | ((F.col("own") == own) & F.col("role").isin(*others))
    near = (F.col("first") <= F.col("end") + reach) & (F.col("last") >= F.col("start") - reach)
    on = [weak[c].eqNullSafe(sides[c]) for c in at]
    return weak.join(sides, on, "inner").where(fits & near).select(weak["doc_id"], weak["h"], "kind", "start", "end").distinct()


def spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, h, kind, start, end) of all spans; h is the hash of the text.

    Texts that are equal and have the same doc_id are searched once.
    """
    hits = docs.select("doc_id", "text").where(F.col("text").rlike(ANY)).withColumn("h", _text_key()).dropDuplicates(["doc_id", "h"])
    parts = _parts(hits)
    doc = Window.partitionBy("doc_id", "h").orderBy("start")
    is_base = F.col("kind").isin(*BASE)
    parts = (
        parts.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(doc.rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("base_end", F.max(F.when(is_base, F.col("end"))).over(doc.rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("base_start", F.min(F.when(is_base, F.col("start"))).over(doc.rangeBetween(0, Window.unboundedFollowing)))
    )
    clear = (F.coalesce(F.col("base_end"), F.lit(-1)) <= F.col("start")) & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end")))
    parts = parts.where(is_base | clear).select("doc_id", "h", "kind", "start", "end", "scope")
    return parts.where(is_base).drop("scope").unionByName(_linked(parts, reach))


def _digest(only: tuple[str, ...]) -> Column:
    order = F.create_map(*[F.lit(x) for k, (_, _, n) in KINDS.items() for x in (k, n)])
    listed = F.sort_array(F.collect_list(F.when(F.col("kind").isin(*only), F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind"))))
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans and the digest of the empty string; repeated rows are
    reported each; an empty table gives no rows; only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    found = spans(docs, reach).groupBy("doc_id", "h").agg(*[count(k) for k in BASE], _digest(BASE).alias("base"), _digest(tuple(KINDS)).alias("spans"))
    keys = docs.select(F.col("doc_id").alias("d"), F.when(F.col("text").rlike(ANY), _text_key()).alias("th"))
    out = keys.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("h")), "left")
    zero = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select(F.col("d").alias("doc_id"), *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, reach: int = REACH, mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; where n_chars is a column, it follows the text.

    Texts without a span, nulls among them, pass as they are; all columns and rows are kept,
    repeated ones each; an empty table stays empty.
    """
    found = spans(docs, reach)
    before = Window.partitionBy("doc_id", "h").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0))).where(F.col("end") > F.col("done"))
    cut = F.struct(F.greatest("start", "done").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    d, h, k = free(docs, "__d", "__h", "__cuts")
    cuts = found.groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.sort_array(F.collect_list(cut)).alias(k))
    hit = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    some = docs.where(hit).join(cuts, F.col("doc_id").eqNullSafe(F.col(d)) & (_text_key() == F.col(h)), "left")
    c = F.col(k)
    ends = F.concat(F.array(F.lit(0)), F.transform(c, lambda s: s["end"]))
    kept = F.transform(c, lambda s, i: F.concat(F.substring(F.col("text"), F.get(ends, i) + 1, s["start"] - F.get(ends, i)), F.lit(mask)))
    rest = F.substring(F.col("text"), F.element_at(ends, -1) + 1, F.length("text"))
    some = some.withColumn("text", F.when(c.isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), rest)))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~hit).unionByName(some.select(*docs.columns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
