"""Plans over the star schema, events and conversations: filters, joins, aggregates, windows, writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import classify, relational
from textloom.plans.registry import plan


@plan("""SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT sha256(text)) AS n_texts,
         CAST(sum((n > 1)::INT) AS BIGINT) AS n_copied, round(avg(length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) / length(text)), 6) AS visible
         FROM (SELECT *, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) GROUP BY source""")
def corpus_overview(t):
    x = F.col("text")
    visible = F.length(F.regexp_replace(x, tx.SPACE, "")) / F.length(x)
    # the texts themselves go no further
    d = t.documents.select("source", tx.content_hash(x).alias("h"), F.length(x).alias("size"), visible.alias("seen"))
    texts = d.groupBy("h", "source").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("seen").alias("seen"))
    copies = texts.groupBy("h").agg(F.sum("n").alias("n_same"))
    rows = texts.join(copies, "h").groupBy("source")
    return rows.agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("chars"), F.count("*").alias("n_texts"), F.sum(F.when(F.col("n_same") > 1, F.col("n")).otherwise(0)).alias("n_copied"), F.round(F.sum(F.col("seen") * F.col("n")) / F.sum(F.when(F.col("seen").isNotNull(), F.col("n"))), 6).alias("visible"))


@plan("""SELECT coalesce(d.source, 'conversation') AS dataset, count(*) AS n FROM
         (SELECT doc_id AS document_id, NULL AS conversation_id FROM documents UNION ALL SELECT NULL, conv_id FROM conversations) c
         LEFT JOIN documents d ON d.doc_id = c.document_id GROUP BY 1""")
def chunks_per_dataset(t):
    chunks = t.documents.select(F.col("doc_id").alias("document_id")).unionByName(t.conversations.select(F.lit(None).cast("long").alias("document_id")))
    return chunks.join(t.documents.select(F.col("doc_id").alias("document_id"), "source"), "document_id", "left").groupBy(F.coalesce("source", F.lit("conversation")).alias("dataset")).agg(F.count("*").alias("n"))


@plan("SELECT page_id FROM pages WHERE ends_with(lower(url), '.html') OR ends_with(lower(url), '/')")
def filter_url_suffix(t):
    u = F.lower("url")
    return t.pages.where(u.endswith(".html") | u.endswith("/")).select("page_id")


@plan("SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def filter_url_prefix(t):
    return t.pages.where(F.col("url").startswith("https://")).select("page_id")


@plan("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 50")
def keyset_page(t):
    return t.orders.where((F.col("o_orderkey") > 100) & F.col("o_orderstatus").isin("F", "O")).orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@plan("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def pending_embeddings(t):
    return relational.pending(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@plan("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_to_classify(t):
    return relational.pending(t.documents.select("doc_id", "source"), t.labels.select("doc_id"), "doc_id")


@plan("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pool_restricted_vectors(t):
    pool = t.labels.where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return t.embeddings.select("vec_id", "label").join(pool, "vec_id", "left_semi")


@plan("""SELECT c.conv_id, c.turn, c.role, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
         WHERE c.role IS DISTINCT FROM p.role""")
def revision_parents(t):
    c = t.conversations.select("conv_id", "turn", "role")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return c.join(p, ["conv_id", "turn"], "left").where(~F.col("role").eqNullSafe(F.col("parent_role")))


@plan("""WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), m AS (SELECT user_id, event_id AS seen, ts AS seen_ts FROM events WHERE event_type = 'click')
         SELECT e.user_id, e.event_id, count(*) AS n FROM e JOIN m USING (user_id)
         WHERE seen_ts <= ts OR NOT EXISTS (SELECT 1 FROM m x WHERE x.user_id = e.user_id AND x.seen_ts <= e.ts) GROUP BY 1, 2""")
def events_as_of(t):
    e = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    m = t.events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("seen"), F.col("ts").alias("seen_ts"))
    return relational.as_of(e, m, "user_id", "ts", "seen_ts").groupBy("user_id", "event_id").agg(F.count("*").alias("n"))


@plan("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 5 AS INTEGER)) AS at FROM customer WHERE c_custkey % 3 <> 0),
         b AS (SELECT c_custkey AS k, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 7 AS INTEGER)) AS at FROM customer WHERE c_custkey % 4 <> 0)
         SELECT k, CASE WHEN a.at IS NULL OR coalesce(b.at > a.at, false) THEN b.at ELSE a.at END AS at, CASE WHEN a.at IS NULL OR coalesce(b.at > a.at, false) THEN 'remote' ELSE 'local' END AS origin
         FROM a FULL JOIN b USING (k)""")
def bibliography_merge(t):
    day = lambda n: F.expr(f"timestamp'2020-01-01' + make_dt_interval(cast(c_custkey % {n} as int))")
    k = F.col("c_custkey").alias("k")
    return relational.prefer(t.customer.where("c_custkey % 3 <> 0").select(k, day(5).alias("at")), t.customer.where("c_custkey % 4 <> 0").select(k, day(7).alias("at")), "k", "at")


@plan("""SELECT source, count(DISTINCT d.doc_id) AS documents, count(l.doc_id) AS labelled, coalesce(CAST(sum(l.toxic) AS BIGINT), 0) AS toxic
         FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def dataset_stats(t):
    l = t.labels.groupBy("doc_id").agg(F.count("*").alias("labelled"), F.sum("toxic").alias("toxic"))  # noqa: E741
    return t.documents.join(l, "doc_id", "left").groupBy("source").agg(F.count("doc_id").alias("documents"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


@plan("SELECT namespace, value, count(*) AS n FROM (SELECT 'quality' AS namespace, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels UNION ALL SELECT 'lang', lang FROM documents) GROUP BY 1, 2")
def label_counts(t):
    l = t.labels.select(F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))).alias("namespace", "value"))  # noqa: E741
    return l.unionByName(t.documents.select(F.lit("lang").alias("namespace"), F.col("lang").alias("value"))).groupBy("namespace", "value").agg(F.count("*").alias("n"))


@plan("SELECT event_type, count(DISTINCT user_id) AS users, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY event_type")
def activity_per_type(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@plan("SELECT DISTINCT ON (lang, length(text)) lang, length(text) AS n, doc_id FROM documents ORDER BY lang, length(text), doc_id DESC")
def newest_per_key(t):
    return t.documents.groupBy("lang", F.length("text").cast("long").alias("n")).agg(F.max("doc_id").alias("doc_id"))


@plan("SELECT conv_id, max(turn) + 1 AS next_index FROM conversations GROUP BY conv_id")
def next_turn(t):
    return relational.next_index(t.conversations, "conv_id", "turn")


@plan("WITH s AS (SELECT 'src' || i AS source FROM range(30) r(i)) SELECT s.source, count(d.doc_id) AS n FROM s LEFT JOIN documents d USING (source) GROUP BY 1")
def source_mix(t):
    names = t.spark.range(30).select(F.concat(F.lit("src"), "id").alias("source"))
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


@plan("""WITH d AS (SELECT lang, length(text) AS n FROM documents), s AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM d)
         SELECT lang, max(CASE WHEN i = least(CAST(floor(0.5 * c) AS BIGINT), c - 1) THEN n END) AS p50, max(CASE WHEN i = least(CAST(floor(0.95 * c) AS BIGINT), c - 1) THEN n END) AS p95 FROM s GROUP BY lang""")
def nearest_index_percentiles(t):
    w = Window.partitionBy("lang")
    # one row a length, so what a window holds does not grow with the documents
    s = t.documents.select("lang", F.length("text").cast("long").alias("n")).groupBy("lang", "n").agg(F.count("*").alias("k"))
    s = s.withColumn("c", F.sum("k").over(w)).withColumn("upto", F.sum("k").over(w.orderBy("n")))
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("c")), F.col("c") - 1), F.col("n")))
    return s.groupBy("lang").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@plan("SELECT round(least(1.0, sum(length(b.text)) / (SELECT sum(length(text)) FROM documents)), 9) AS coverage FROM benchmark b")
def gold_coverage(t):
    a, b = t.benchmark.agg(F.sum(F.length("text")).alias("a")), t.documents.agg(F.sum(F.length("text")).alias("b"))
    return a.crossJoin(b).select(F.round(F.least(F.lit(1.0), F.col("a") / F.col("b")), 9).alias("coverage"))  # one row each


@plan("""SELECT n.n_name, e.p_brand, e.value, e.rn FROM nation n LEFT JOIN
         (SELECT s_nationkey, p_brand, l_extendedprice AS value, row_number() OVER (PARTITION BY s_nationkey, p_brand ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey) e ON e.s_nationkey = n.n_nationkey AND e.rn = 1""")
def latest_per_host_model(t):
    facts = t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    last = relational.latest(facts, ["s_nationkey", "p_brand"], [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return t.nation.join(last, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "p_brand", F.col("l_extendedprice").alias("value"), F.when(F.col("p_brand").isNotNull(), F.lit(1).cast("long")).alias("rn"))


@plan("SELECT conv_id, turn, lag(turn) OVER w AS prev_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def previous_and_next(t):
    return relational.neighbours(t.conversations, "conv_id", ["turn"], "turn")


@plan("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
         SELECT a.conv_id, a.turn AS anchor, b.turn, b.p - a.p AS offset FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.p BETWEEN a.p - 1 AND a.p + 2 WHERE a.turn % 3 = 0""")
def neighbours_around(t):
    c = t.conversations.select("conv_id", "turn")
    return relational.around(c, c.where("turn % 3 = 0"), "conv_id", "turn", 1, 2)


@plan("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nr FROM events) WHERE nr <= 3")
def latest_feedback(t):
    return relational.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type")


@plan("""WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), n WHERE r <= ceil(n.n * 7 / 100.0)""")
def percentile_head(t):
    return relational.head_percent(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 7).select("o_orderkey")


@plan("""SELECT source, doc_id, n_left > 30 OR b_left > 80000 AS evict FROM (SELECT source, doc_id,
           count(*) OVER (PARTITION BY source) - count(*) OVER w AS n_left, sum(length(text)) OVER (PARTITION BY source) - coalesce(sum(length(text)) OVER w, 0) AS b_left
           FROM documents WINDOW w AS (PARTITION BY source ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def source_caps(t):
    d = t.documents.select("source", "doc_id", F.length("text").cast("long").alias("size"))
    return relational.budget(d, "source", [F.desc("size"), F.asc("doc_id")], "size", 30, 80_000).drop("size")


@plan("""SELECT conv_id, turn, role, 1 AS version FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, role, 2 FROM conversations WHERE turn % 2 = 1""")
def upsert_messages(t):
    c = t.conversations.select("conv_id", "turn", "role")
    return relational.upsert(c.withColumn("version", F.lit(1)), c.where("turn % 2 = 1").withColumn("version", F.lit(2)), ["conv_id", "turn"])


@plan("""SELECT doc_id, 'quality' AS namespace FROM labels UNION ALL SELECT doc_id, 'quality' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_absent_labels(t):
    q = lambda df: df.select("doc_id", F.lit("quality").alias("namespace"))
    return relational.insert_absent(q(t.labels), q(t.documents).unionByName(q(t.documents)), ["doc_id", "namespace"])


@plan("""WITH o AS (SELECT doc_id % 50 AS doc, sha256(text) AS h, row_number() OVER (PARTITION BY doc_id % 50, sha256(text) ORDER BY 1) AS nr FROM documents WHERE doc_id % 3 <> 0),
         n AS (SELECT doc_id % 50 AS doc, sha256(text) AS h, row_number() OVER (PARTITION BY doc_id % 50, sha256(text) ORDER BY 1) AS nr FROM documents WHERE doc_id % 4 <> 0)
         SELECT doc, h, CASE WHEN o.one IS NULL THEN 'insert' WHEN n.one IS NULL THEN 'delete' ELSE 'keep' END AS action FROM (SELECT *, 1 AS one FROM o) o FULL JOIN (SELECT *, 1 AS one FROM n) n USING (doc, h, nr)""")
def chunk_diff(t):
    c = lambda w: t.documents.where(w).select((F.col("doc_id") % 50).alias("doc"), tx.content_hash(F.col("text")).alias("h"))
    return relational.diff(c("doc_id % 3 <> 0"), c("doc_id % 4 <> 0"), ["doc", "h"])


@plan("""WITH d AS (SELECT doc_id, doc_id % 50 AS doc, sha256(text) AS h FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY doc, h ORDER BY doc_id) AS nr FROM d WHERE doc_id % 3 <> 0),
         n AS (SELECT *, row_number() OVER (PARTITION BY doc, h ORDER BY doc_id) AS nr FROM d WHERE doc_id % 4 <> 0 AND doc < 40)
         SELECT n.doc, n.h, o.doc_id AS chunk_id, n.doc_id AS place, CASE WHEN o.doc_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM n LEFT JOIN o ON o.doc = n.doc AND o.h = n.h AND o.nr = 1 AND n.nr = 1
         UNION ALL SELECT doc, h, doc_id, NULL, CASE WHEN (doc, h) IN (SELECT (doc, h) FROM n) THEN 'leave' ELSE 'delete' END FROM o
         WHERE doc IN (SELECT doc FROM n) AND NOT (nr = 1 AND (doc, h) IN (SELECT (doc, h) FROM n))""")
def chunk_replacement(t):
    d = t.documents.select((F.col("doc_id") % 50).alias("doc"), tx.content_hash(F.col("text")).alias("h"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("place"))
    return relational.replace_chunks(d.where("chunk_id % 3 <> 0"), d.where("place % 4 <> 0 AND doc < 40").drop("chunk_id"), "doc", "h", "chunk_id", "place")


@plan("""WITH b AS (SELECT doc_id, to_json({'quality': quality, 'toxic': toxic}) AS before FROM labels WHERE doc_id % 11 <> 0),
         a AS (SELECT doc_id, to_json({'quality': CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END, 'toxic': toxic}) AS after FROM labels WHERE doc_id % 7 <> 0)
         SELECT doc_id, 'relabel' AS tool, CAST(before AS VARCHAR) AS before, CAST(after AS VARCHAR) AS after, false AS dry_run FROM b FULL JOIN a USING (doc_id) WHERE CAST(before AS VARCHAR) IS DISTINCT FROM CAST(after AS VARCHAR)""")
def audit_rows(t):
    c = t.labels.select("doc_id", "quality", "toxic")
    after = c.where("doc_id % 7 <> 0").withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return relational.audit(c.where("doc_id % 11 <> 0"), after, ["doc_id"], "relabel")


@plan("""WITH s AS (SELECT sha256(d.text) AS h, max(vec_id) AS vec_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1)
         SELECT d.doc_id, s.vec_id AS reuse_from FROM documents d JOIN s ON s.h = sha256(d.text) WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def embedding_reuse(t):
    d = t.documents.select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    known = d.join(e, "doc_id", "left_semi").groupBy("h").agg(F.max("doc_id").alias("reuse_from"))
    return relational.pending(d, e, "doc_id").join(known, "h").select("doc_id", "reuse_from")


@plan("""SELECT event_id, CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY AND event_type <> 'purchase' THEN 'failed' ELSE event_type END AS status FROM events""")
def stale_runs(t):
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now)).select("event_id", F.when((F.col("ts") < F.col("now") - F.expr("interval 3 days")) & (F.col("event_type") != "purchase"), "failed").otherwise(F.col("event_type")).alias("status"))


@plan("""WITH e AS (SELECT doc_id, sha256(text) AS rev, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN 'p' ELSE 'x' END AS here, 'p' AS parent, doc_id % 7 = 0 AS gone FROM documents)
         SELECT doc_id, CASE WHEN gone THEN 'tombstone' WHEN here = rev THEN 'in_sync' WHEN here = parent THEN 'fast_forward' ELSE 'conflict' END AS decision FROM e""")
def pull_decisions(t):
    from textloom.streaming.sync import pull_decision

    h = tx.content_hash(F.col("text"))
    here = F.when(F.col("doc_id") % 4 == 0, h).when(F.col("doc_id") % 4 == 1, "p").otherwise("x")
    return t.documents.select("doc_id", pull_decision(here, F.lit("p"), h, F.col("doc_id") % 7 == 0).alias("decision"))


@plan("""WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_discount * 10 AS conf, l_tax * 12 AS lq, l_quantity / 50 AS elev, (l_linenumber % 7) / 6 AS miss, TIMESTAMP '1998-12-01' AS now, l_shipdate AS shipped FROM lineitem),
         f AS (SELECT *, 1 - greatest(0, least(1, conf)) AS cd, (epoch(now) - epoch(shipped)) / 86400 AS age FROM e),
         g AS (SELECT *, CASE WHEN age <= 7 THEN 1.0 WHEN age >= 180 THEN 0.0 ELSE (180 - age) / 173 END AS fr FROM f)
         SELECT k, n, round(greatest(0, least(1, CASE WHEN n % 2 = 0 THEN cd * 0.3 + miss * 0.25 + elev * 0.2 + fr * 0.1 + lq * 0.15 ELSE cd * 0.35 + miss * 0.3 + elev * 0.25 + fr * 0.1 END)), 6) AS score FROM g""")
def curation_scores(t):
    parts = {"confidence_deficit": classify.confidence_deficit(F.col("l_discount") * 10), "missing_metadata": (F.col("l_linenumber") % 7) / 6, "ranker_elevation": F.col("l_quantity") / 50, "freshness": vx.freshness(F.col("l_shipdate"), F.lit("1998-12-01").cast("timestamp"))}
    learned = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 12)
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(classify.curation_score(parts, learned), 6).alias("score"))


@plan("""WITH f AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS drag, max(quality) AS q FROM labels GROUP BY 1),
         c AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1),
         s AS (SELECT d.doc_id, source, 0.2 * (1 - coalesce(f.q, 0)) + 0.2 * CASE WHEN f.q IS NULL THEN 1 ELSE 0 END + 0.15 * (1 - 1.0 / (1 + d.doc_id % 5)) + 0.25 * CASE WHEN c.n > 1 THEN 1 ELSE 0 END + 0.2 * coalesce(f.drag, 0) AS score
               FROM documents d LEFT JOIN f USING (doc_id) JOIN c ON c.h = sha256(d.text))
         SELECT doc_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r, count(*) OVER () AS n FROM s) WHERE r <= ceil(n * 10 / 100.0)""")
def prune_candidates(t):
    f = t.labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("double")).alias("drag"), F.max("quality").alias("q"))
    d = t.documents.select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    copies = d.groupBy("h").agg(F.count("*").alias("n"))
    j = d.join(f, "doc_id", "left").join(copies, "h")
    parts = {"confidence_deficit": classify.confidence_deficit(F.coalesce(F.col("q"), F.lit(0)).cast("double")), "missing_metadata": F.col("q").isNull().cast("double"), "freshness_inverted": 1 - 1.0 / (1 + F.col("doc_id") % 5), "duplicate_density": (F.col("n") > 1).cast("double"), "feedback_drag": F.coalesce("drag", F.lit(0.0))}
    return relational.head_percent(j.select("doc_id", F.round(classify.weighted(parts, classify.PRUNE), 9).alias("score")), [F.desc("score"), F.asc("doc_id")], 10)


@plan("""WITH s AS (SELECT source, lang, length(text) / 1000 AS score FROM documents) SELECT source, lang, count(*) AS n, round(avg(score), 6) AS mean_score, round(1 / (1 + var_pop(score)), 6) AS cohesion FROM s GROUP BY 1, 2""")
def curation_batches(t):
    s = t.documents.select("source", "lang", (F.length("text") / 1000).alias("score"))
    return s.groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(1 / (1 + F.var_pop("score")), 6).alias("cohesion"))


@plan("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'fast' WHEN event_type IN ('purchase', 'view') THEN 'deep' ELSE 'all' END AS lane, json_extract_string(props, '$.k') AS k FROM events""")
def event_routing(t):
    lanes = [("fast", ["click"]), ("all", []), ("deep", ["purchase", "view"])]
    return t.events.select("event_id", classify.route(F.col("event_type"), lanes).alias("lane"), F.get_json_object("props", "$.k").alias("k"))


@plan("""SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY GROUPING SETS ((user_id, event_type))""")
def events_by_user(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@plan("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def events_hourly(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@plan("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    x = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


