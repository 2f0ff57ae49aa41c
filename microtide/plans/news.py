"""Queries of terms in texts and of scored news."""

from __future__ import annotations

from pyspark.sql import functions as F

from microtide.operators import news
from microtide.plans.market import r
from microtide.plans.registry import query
from microtide.sources.tables import driver_table

#: The universe: the first two words of every benchmark item, and each item's first word.
UNIVERSE = r"""WITH b AS (SELECT list_filter(regexp_split_to_array(upper(text), '[^\p{L}\p{N}&]+'), lambda w: w <> '') AS w FROM benchmark),
  u AS (SELECT DISTINCT unnest([array_to_string(w[1:2], ' '), w[1]]) AS symbol FROM b WHERE len(w) >= 2),
  d AS (SELECT doc_id, text, ' ' || array_to_string(list_filter(regexp_split_to_array(upper(coalesce(text, '')), '[^\p{L}\p{N}&]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents),
  m AS (SELECT DISTINCT doc_id, symbol FROM d JOIN u ON contains(t, ' ' || symbol || ' '))"""


def universe(spark, d):
    w = news.term_words(F.col("text"))
    b = driver_table(spark, d, "benchmark").select(w.alias("w")).where(F.size("w") >= 2)
    return b.select(F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.get("w", F.lit(0)))).alias("symbol")).distinct()


@query(UNIVERSE + " SELECT doc_id, symbol AS term FROM m")
def term_matches(spark, d):
    return news.matches(driver_table(spark, d, "documents"), "doc_id", "text", universe(spark, d), "symbol")


@query(UNIVERSE + r""", p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text), 'NSE[:\s]+([A-Z]{2,10})', 1) || regexp_extract_all(upper(text), 'BSE[:\s]+([A-Z]{2,10})', 1)) AS symbol FROM d),
  a AS (SELECT doc_id, symbol FROM m UNION SELECT doc_id, symbol FROM p), s AS (SELECT doc_id, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM a GROUP BY 1)
  SELECT DISTINCT d.doc_id, coalesce(n, 0) AS n, coalesce(symbols, '') AS symbols FROM d LEFT JOIN s ON d.doc_id = s.doc_id""")
def document_symbols(spark, d):
    out = news.symbols(driver_table(spark, d, "documents"), "doc_id", "text", universe(spark, d))
    return out.select("doc_id", F.size("symbols").cast("long").alias("n"), F.array_join("symbols", ",").alias("symbols"))


@query(UNIVERSE + """, k AS (SELECT symbol FROM u UNION SELECT unnest(['NIFTY', 'SENSEX', 'RBI', 'SEBI', 'FII', 'FPI', 'INFLATION', 'GDP', 'REPO RATE', 'MONETARY POLICY', 'BUDGET', 'F&O', 'DERIVATIVES']))
  SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM d JOIN k ON contains(t, ' ' || symbol || ' ')) GROUP BY 1""")
def relevant_documents(spark, d):
    kept = news.relevant(driver_table(spark, d, "documents"), "doc_id", "text", universe(spark, d))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


#: A model's answer made from an event: fenced or bare, sometimes cut off, with values out of bounds.
ANSWER = """SELECT event_id, value, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'not json' WHEN event_id % 3 = 0 THEN '```json' || chr(10) || b || chr(10) || '```' ELSE b END AS raw
  FROM (SELECT *, '{"sentiment": ' || CAST(CAST(event_id % 9 AS DOUBLE) / 2 - 2 AS VARCHAR) || ', "uncertainty": ' || CAST(CAST(event_id % 5 AS DOUBLE) / 4 AS VARCHAR) || CASE WHEN event_id % 4 = 0 THEN '' ELSE ', "pause_minutes": ' || CAST(event_id % 400 AS VARCHAR) END || ', "mm_action": "' || CASE event_type WHEN 'click' THEN 'WIDEN' WHEN 'error' THEN 'PAUSE' WHEN 'view' THEN 'SELL' ELSE 'NORMAL' END || '", "symbols": ["U' || CAST(user_id % 10 AS VARCHAR) || '", "' || event_type || '"]}' AS b FROM events)"""


def answers(spark, d):
    e = driver_table(spark, d, "events")
    half = lambda n, by, less: ((F.col("event_id") % n).cast("double") / by - less).cast("string")
    action = F.when(F.col("event_type") == "click", "WIDEN").when(F.col("event_type") == "error", "PAUSE").when(F.col("event_type") == "view", "SELL").otherwise("NORMAL")
    pause = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(', "pause_minutes": '), (F.col("event_id") % 400).cast("string")))
    body = F.concat(F.lit('{"sentiment": '), half(9, 2, 2.0), F.lit(', "uncertainty": '), half(5, 4, 0.0), pause, F.lit(', "mm_action": "'), action, F.lit('", "symbols": ["U'), (F.col("user_id") % 10).cast("string"), F.lit('", "'), F.col("event_type"), F.lit('"]}'))
    raw = F.when(F.col("event_id") % 7 == 0, "not json").when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return e.select("event_id", raw.alias("raw"))


_PARSED = ANSWER.join(["WITH a AS (", """), j AS (SELECT event_id, CASE WHEN raw <> 'not json' THEN CASE WHEN starts_with(raw, '```') THEN substr(raw, 9, length(raw) - 12) ELSE raw END END AS b FROM a),
  s AS (SELECT event_id, greatest(-1, least(1, CAST(json_extract_string(b, '$.sentiment') AS DOUBLE))) AS sentiment, CAST(json_extract_string(b, '$.uncertainty') AS DOUBLE) AS uncertainty, least(240, coalesce(CAST(json_extract_string(b, '$.pause_minutes') AS INTEGER), 0)) AS pause_minutes,
    CASE WHEN json_extract_string(b, '$.mm_action') IN ('PAUSE', 'WIDEN') THEN json_extract_string(b, '$.mm_action') ELSE 'NORMAL' END AS mm_action, [json_extract_string(b, '$.symbols[0]'), json_extract_string(b, '$.symbols[1]')] AS symbols FROM j WHERE b IS NOT NULL)"""])


@query(_PARSED + " SELECT event_id, sentiment, uncertainty, pause_minutes, mm_action FROM s")
def scored_answers(spark, d):
    return news.scored(answers(spark, d), "raw", ["event_id"]).select("event_id", "sentiment", "uncertainty", "pause_minutes", "mm_action")


@query(_PARSED + """, e AS (SELECT unnest(symbols) AS symbol, mm_action, uncertainty FROM s) SELECT symbol, count(*) AS n, count(*) FILTER (mm_action = 'PAUSE') AS pause, count(*) FILTER (mm_action = 'WIDEN') AS widen, count(*) FILTER (mm_action = 'NORMAL') AS normal, max(uncertainty) AS most_uncertain, arg_min(mm_action, {'a': -uncertainty, 'b': mm_action}) AS worst_action FROM e GROUP BY 1""")
def news_rollup(spark, d):
    return news.rollup(news.scored(answers(spark, d), "raw"))


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'click') AND CASE WHEN event_id % 3 = 0 THEN event_type = 'error' ELSE event_id % 10 < 5 END THEN 999.0 ELSE round(greatest(1 + floor(value) / 100, CASE event_id % 6 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 WHEN 3 THEN 1.5 ELSE 1.0 END, CASE event_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.2 ELSE 1.0 END), 2) END AS factor FROM events""")
def effective_widen_factor(spark, d):
    e, i = driver_table(spark, d, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "error", "AVOID").when(F.col("event_type") == "click", "PAUSE").otherwise("NORMAL")
    pause, risk = F.when(i % 3 != 0, F.lit(5)), F.when(i % 4 == 0, "HIGH").when(i % 4 == 1, "MEDIUM").otherwise("LOW")
    return e.select("event_id", news.effective_widening(action, pause, i % 10, 1 + F.floor("value") / 100, i % 6, risk).alias("factor"))
