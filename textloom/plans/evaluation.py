"""Plans of judging, comparisons, planning, the learned reranker and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evaluation as ev
from textloom.plans.registry import plan

_PAIR = "CAST(('0x' || substr(h, {}, 4)) AS BIGINT) / 65535.0"


@plan("WITH j AS (SELECT item_id, sha256(text) AS h FROM benchmark) SELECT item_id, " + ", ".join(f"round({_PAIR.format(4 * k + 1)}, 9) AS {n}" for k, n in enumerate(ev.JUDGED)) + " FROM j")
def judge_scores(t):
    scored = t.benchmark.select("item_id", *ev.mock_judge(F.col("text")))
    return scored.select("item_id", *[F.round(n, 9).alias(n) for n in ev.JUDGED])


@plan("""WITH r AS (SELECT CASE WHEN event_type = 'click' THEN 'cache' WHEN event_type = 'view' THEN 'retrieve' ELSE 'none' END AS route, value FROM events)
  SELECT count(*) FILTER (WHERE route = 'cache') AS n_left, count(*) FILTER (WHERE route = 'retrieve') AS n_right, round(avg(value) FILTER (WHERE route = 'cache'), 9) AS mean_left,
  round(avg(value) FILTER (WHERE route = 'retrieve'), 9) AS mean_right, round(avg(value) FILTER (WHERE route = 'cache') - avg(value) FILTER (WHERE route = 'retrieve'), 9) AS delta FROM r""")
def route_means(t):
    r = t.events.select(F.when(F.col("event_type") == "click", "cache").when(F.col("event_type") == "view", "retrieve").otherwise("none").alias("route"), "value")
    out = ev.route_comparison(r, "route", "value")
    return out.select("n_left", "n_right", *[F.round(c, 9).alias(c) for c in ("mean_left", "mean_right", "delta")])


@plan("SELECT p_brand, round(avg(p_retailprice), 6) AS metric, CAST(row_number() OVER (ORDER BY round(avg(p_retailprice), 6) DESC, p_brand) AS INTEGER) AS place FROM part GROUP BY p_brand")
def model_leaderboard(t):
    return ev.leaderboard(t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("metric")), "p_brand", "metric")


@plan("""WITH r AS (SELECT p_brand AS model_key, p_type AS host, max(p_retailprice) AS rate FROM part WHERE p_size > 10 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY rate DESC, host) AS nr FROM r),
  l AS (SELECT p_brand || '-lane' AS lane, p_brand AS model_key, count(*) AS backlog FROM part GROUP BY 1, 2 UNION ALL SELECT 'idle', 'none', 7)
  SELECT lane, l.model_key, backlog, host AS recommended_host, rate, round(backlog / rate, 9) AS drain_seconds FROM l LEFT JOIN b ON b.model_key = l.model_key AND nr = 1""")
def fleet_plan(t):
    rates = t.part.where("p_size > 10").groupBy(F.col("p_brand").alias("model_key"), F.col("p_type").alias("host")).agg(F.max("p_retailprice").alias("rate"))
    lanes = t.part.groupBy(F.concat("p_brand", F.lit("-lane")).alias("lane"), F.col("p_brand").alias("model_key")).agg(F.count("*").alias("backlog"))
    idle = t.spark.range(1).select(F.lit("idle").alias("lane"), F.lit("none").alias("model_key"), F.lit(7).cast("long").alias("backlog"))
    return ev.fleet_plan(lanes.unionByName(idle), rates).withColumn("drain_seconds", F.round("drain_seconds", 9))


@plan("""SELECT lang, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS bytes, CAST(sum(ceil(length(text) / 1500)) AS BIGINT) AS chunks, CAST(sum(ceil(length(text) / 1500)) * 1536 AS BIGINT) AS vector_bytes FROM documents GROUP BY lang""")
def storage_estimate(t):
    return ev.storage_estimate(t.documents.select("lang", F.length("text").cast("long").alias("size")), "lang", "size")


@plan("""WITH e AS (SELECT CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'view' THEN 'thumbs_down' ELSE 'rate' END AS signal, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS value, event_id % 2 = 0 AS lex, length(props) AS n FROM events),
  l AS (SELECT coalesce(value, 0.5) AS score, CAST(lex AS INT) AS is_lexical, n, CASE WHEN signal = 'thumbs_up' OR coalesce(value > 0.5, false) THEN 1 WHEN signal = 'thumbs_down' OR coalesce(value < 0.5, false) THEN 0 END AS label FROM e)
  SELECT label, count(*) AS n, CAST(sum(is_lexical) AS BIGINT) AS lexical, round(sum(score), 6) AS score, CAST(sum(n) AS BIGINT) AS query_len FROM l WHERE label IS NOT NULL GROUP BY label""")
def rerank_examples(t):
    e = t.events.select(F.when(F.col("event_type") == "purchase", "thumbs_up").when(F.col("event_type") == "view", "thumbs_down").otherwise("rate").alias("signal"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 100).alias("value"), F.when(F.col("event_id") % 2 == 0, "lexical").otherwise("dense").alias("source"), F.col("props").alias("query"))
    x = ev.rerank_examples(e)
    return x.groupBy("label").agg(F.count("*").alias("n"), F.sum("is_lexical").cast("long").alias("lexical"), F.round(F.sum("score"), 6).alias("score"), F.sum("query_len").cast("long").alias("query_len"))


@plan()
def topic_clusters(t):
    return ev.all_topics(t.embeddings, "vec_id", "embedding")
