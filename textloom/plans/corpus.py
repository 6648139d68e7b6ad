"""Plans over documents, conversations and pages: hashing, statistics, quality, chunking, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import chunking, classify, quality, stats, templates
from textloom.plans.registry import plan

_TOK = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) END"
_VISIBLE = "length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g'))"


@plan("SELECT doc_id, sha256(text) AS content_hash, CAST(('0x' || substr(md5(source || '://' || doc_id), 9, 8)) AS BIGINT) % 2147483648 AS lock_key FROM documents")
def content_hashes(t):
    d = t.documents
    return d.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.lock_key(F.concat("source", F.lit("://"), F.col("doc_id").cast("string"))).alias("lock_key"))


@plan("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS least_id, max(doc_id) AS greatest_id,
           string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) >= 2)
         SELECT h AS content_hash, 'ndc_' || substr(sha256(ids), 1, 16) AS cluster_id, n, least_id, greatest_id FROM g""")
def exact_duplicate_groups(t):
    return stats.exact_duplicates(t.documents.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash")), "doc_id", "content_hash")


@plan(f"""WITH d AS (SELECT source, {_TOK} AS k FROM documents),
         s AS (SELECT source, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS min, max(k) AS max, avg(k) AS mean,
           CAST(floor(quantile_cont(k, 0.5) + 1e-9) AS BIGINT) AS p50, CAST(floor(quantile_cont(k, 0.95) + 1e-9) AS BIGINT) AS p95 FROM d GROUP BY source)
         SELECT source, n, total, min, max, round(mean, 6) AS mean, p50, greatest(p95, p50) AS p95 FROM s""")
def token_stats_by_source(t):
    return stats.token_stats(t.documents.withColumn("k", tx.token_count(F.col("text"))), F.col("k"), "source").withColumn("mean", F.round("mean", 6))


_HIST = """WITH d AS (SELECT {tok} AS v FROM documents), m AS (SELECT min(v) AS lo, max(v) AS hi FROM d),
  e AS (SELECT i, CAST(round_even({edge}, 0) AS BIGINT) AS e FROM m, range(11) r(i)),
  b AS (SELECT a.i AS bin, a.e AS lo, z.e AS hi FROM e a JOIN e z ON z.i = a.i + 1),
  c AS (SELECT (SELECT count(*) FROM e WHERE i BETWEEN 1 AND 9 AND e.e <= d.v) AS bin FROM d)
  SELECT CAST(b.bin AS INTEGER) AS bin, b.lo, b.hi, count(c.bin) AS n FROM b LEFT JOIN c ON c.bin = b.bin GROUP BY b.bin, b.lo, b.hi"""


@plan(_HIST.format(tok=_TOK, edge="lo + i * ((hi - lo) / 10)"))
def length_histogram_linear(t):
    return stats.length_histogram(t.documents, tx.token_count(F.col("text")))


@plan(_HIST.format(tok=_TOK, edge="pow(10.0, log10(greatest(lo, 1)) + i * ((log10(greatest(hi, 1)) - log10(greatest(lo, 1))) / 10))"))
def length_histogram_log(t):
    return stats.length_histogram(t.documents, tx.token_count(F.col("text")), log=True)


@plan(f"""WITH d AS (SELECT doc_id, {_VISIBLE} / length(text) AS r, len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]')) / length(text) AS p,
           len(regexp_extract_all(text, '[A-Za-z]')) AS l, len(regexp_extract_all(text, '[A-Z]')) AS u FROM documents WHERE length(text) > 0),
         s AS (SELECT doc_id, CASE WHEN r < 0.65 THEN r / 0.65 WHEN r > 0.92 THEN greatest(0.0, 1 - (r - 0.92) / (1 - 0.92)) ELSE 1.0 END AS tr,
           CASE WHEN p <= 0.25 THEN 1.0 ELSE greatest(0.0, 1 - (p - 0.25) / (1 - 0.25)) END AS pb, CASE WHEN l = 0 THEN 1.0 ELSE 1 - u / l END AS sr FROM d)
         SELECT doc_id, round(CAST(tr AS DOUBLE), 9) AS token_rate, round(CAST(pb AS DOUBLE), 9) AS punctuation_balance, round(CAST(sr AS DOUBLE), 9) AS shouting_ratio,
           pow(CAST(tr AS DOUBLE) * pb * sr, 1.0 / 3) < 0.45 AS low_quality FROM s""")
def noise_signals(t):
    d, x = t.documents, F.col("text")
    s = d.where(F.length(x) > 0).select("doc_id", tx.token_rate(x).alias("tr"), tx.punctuation_balance(x).alias("pb"), tx.shouting(x).alias("sr"))
    low = F.pow(F.col("tr") * F.col("pb") * F.col("sr"), F.lit(1.0 / 3)) < tx.LOW_QUALITY
    return s.select("doc_id", F.round("tr", 9).alias("token_rate"), F.round("pb", 9).alias("punctuation_balance"), F.round("sr", 9).alias("shouting_ratio"), low.alias("low_quality"))


@plan()
def noise_score(t):
    return t.documents.select("doc_id", quality.noise_score(F.col("text")).alias("s")).select("doc_id", "s.*")


@plan("""WITH d AS (SELECT doc_id, text, lang IS NOT NULL AS has, CAST(lang IS NOT NULL AS INT) + CAST(source IS NOT NULL AS INT) AS n FROM documents)
         SELECT doc_id, round(CAST(CASE WHEN length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) = 0 THEN 0 ELSE
           0.6 * CASE WHEN length(text) < 100 THEN 0 WHEN length(text) > 5000 THEN 0.5 ELSE 1 END + 0.2 * CAST(has AS INT) + 0.2 * least(1.0, n / 3) END AS DOUBLE), 9) AS score FROM d""")
def adequacy_score(t):
    n = F.col("lang").isNotNull().cast("int") + F.col("source").isNotNull().cast("int")
    return t.documents.select("doc_id", F.round(tx.adequacy(F.col("text"), F.col("lang").isNotNull(), n), 9).alias("score"))


def _redact_sql() -> str:
    step, prev = [], "SELECT doc_id, text AS x, CAST(0 AS BIGINT) AS n FROM t"
    for p in tx.SECRET_PATTERNS:
        q = p.replace("'", "''")
        prev = f"SELECT doc_id, regexp_replace(x, '{q}', '{tx.REDACTED}', 'g') AS x, n + len(regexp_extract_all(x, '{q}')) AS n FROM ({prev})"
        step.append(prev)
    return f"""WITH t AS (SELECT doc_id, text || ' password = "' || source || 'x" sk-' || sha256(text) || ' Bearer ' || md5(text) || ' redis://u:p@' || lang || '/0' AS text FROM documents)
      SELECT doc_id, n AS n_secrets, sha256(x) AS redacted_sha FROM ({prev})"""


@plan(_redact_sql())
def redact_secrets(t):
    x = F.concat("text", F.lit(' password = "'), "source", F.lit('x" sk-'), F.sha2("text", 256), F.lit(" Bearer "), F.md5("text"), F.lit(" redis://u:p@"), "lang", F.lit("/0"))
    out, n = tx.redact(F.col("x"))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", n.alias("n_secrets"), F.sha2(out, 256).alias("redacted_sha"))


_QUERIES_SQL = "(SELECT p_name AS q FROM part UNION SELECT replace(p_name, ' ', '_') FROM part UNION SELECT 'a::b' UNION SELECT 'setUp' UNION SELECT '_x' UNION SELECT 'setup' UNION SELECT 'a.b' UNION SELECT '' UNION SELECT ' ' UNION SELECT 'x-y')"


@plan(f"""SELECT q, coalesce(length(trim(q)) > 0 AND NOT regexp_matches(q, '[ \\t\\n]') AND (contains(q, '::') OR contains(q, '->') OR contains(q, '.') OR contains(q, '/')
           OR (regexp_matches(q, '^[A-Za-z_][A-Za-z0-9_]*$') AND (starts_with(q, '_') OR regexp_matches(substr(q, 2), '[A-Z]') OR contains(q, '_')))), false) AS is_symbol,
         array_to_string(list_filter(regexp_extract_all(q, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2), '|') AS tokens FROM {_QUERIES_SQL}""")
def query_shape(t):
    p = t.part.select(F.col("p_name").alias("q"))
    more = t.spark.createDataFrame([(x,) for x in ("a::b", "setUp", "_x", "setup", "a.b", "", " ", "x-y")], "q string")
    q = p.union(p.select(F.replace("q", F.lit(" "), F.lit("_")))).union(more).distinct()
    return q.select("q", tx.is_symbol_shaped(F.col("q")).alias("is_symbol"), F.array_join(tx.query_tokens(F.col("q")), "|").alias("tokens"))


@plan("SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)) AS ext FROM pages")
def page_extension(t):
    return t.pages.select("page_id", tx.uri_extension(F.col("url")).alias("ext"))


_NAMES = ["a (1).md", "a copy.md", "a copy 2.md", "a 2.md", "a (3).md", "a (mac's conflicted copy 2024-01-01).md", "a-conflict-2024-1.md", "plain.md", "noext 7"]


@plan("SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', {p}, {c})" for n, p, c in zip(_NAMES, ["'gdrive'", "'finder'", "'finder'", "'icloud'", "'icloud'", "'dropbox'", "'gdrive'", "NULL", "'icloud'"], ["'a.md'"] * 7 + ["NULL", "'noext'"], strict=True)) + ") v(name, provider, canonical)")
def cloud_duplicates(t):
    return t.spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", tx.cloud_duplicate(F.col("name")).alias("d")).select("name", "d.provider", "d.canonical")


@plan("""WITH c AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 1500 THEN 1 ELSE CAST(ceil((length(text) - 200) / 1300) AS BIGINT) END)) AS i FROM documents WHERE length(text) > 0)
         SELECT doc_id, CAST(i AS INTEGER) AS index, CAST(i * 1300 AS INTEGER) AS start, sha256(substr(text, i * 1300 + 1, 1500)) AS sha FROM c""")
def chunks_fixed_window(t):
    return t.documents.select("doc_id", F.explode(chunking.fixed_window(F.col("text"))).alias("c")).select("doc_id", "c.index", "c.start", F.sha2("c.text", 256).alias("sha"))


@plan("""WITH c AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)
         SELECT doc_id, CAST(i AS INTEGER) AS index, sha256(substr(text, i * 1000 + 1, 1000)) AS sha FROM c""")
def chunks_hard_max(t):
    return t.documents.select("doc_id", F.explode(chunking.hard_max(F.col("text"), 1000)).alias("c")).select("doc_id", "c.index", F.sha2("c.text", 256).alias("sha"))


@plan("""WITH m AS (SELECT conv_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
           string_agg(coalesce(text, ''), chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS text
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
         SELECT conv_id, i AS first_turn, text FROM m WHERE i % 2 = 0 AND (i = 0 OR i + 1 < n) AND length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) > 0""")
def chunks_sliding_window(t):
    return chunking.sliding_window(t.conversations, "conv_id", "turn", "text")


@plan("SELECT conv_id, turn, text FROM conversations WHERE length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) > 0")
def chunks_per_message(t):
    return chunking.per_message(t.conversations, "conv_id", "turn", "text")


@plan()
def chunks_markdown(t):
    return chunking.chunk_with(t.documents, "doc_id", "text", chunking.markdown_pieces, "start int, text string, heading string")


@plan()
def chunks_content_defined(t):
    import hashlib

    def cut(text):
        data = text.encode()
        for a, b in chunking.content_defined(data):
            yield a, b, hashlib.sha256(data[a:b]).hexdigest()

    return chunking.chunk_with(t.documents, "doc_id", "text", cut, "byte_start int, byte_end int, fingerprint string")


@plan()
def chunks_code_lines(t):
    return chunking.chunk_with(t.documents, "doc_id", "text", chunking.code_pieces, "first_line int, last_line int, text string")


_RULES = [
    ("x/a.py", "code", "", ""), ("opencode://s/1", "", "", ""), ("x/b", "conversation", "", ""), ("x/course.epub", "epub", "A primer", ""), ("x/novel.epub", "epub", "", ""),
    ("v/papers/p.txt", "", "", ""), ("v/arxiv-1.pdf", "pdf", "", ""), ("v/x.BIB", "", "", ""), ("v/notes/a.md", "markdown", "", ""), ("v/blog/a", "", "", ""), ("v/docs/a", "", "", ""),
    ("v/a.json", "json", "", ""), ("v/chat.log", "", "", "User: a\nHuman: b\nAssistant: c\n"), ("v/p.pdf", "pdf", "", "Abstract\nwe [1]\nReferences\n"), ("v/big.pdf", "pdf", "", "w" * 150000),
    ("v/mid.pdf", "pdf", "Tutorial", "w" * 24000), ("v/mid2.pdf", "pdf", "", "w" * 24000), ("v/s.pdf", "pdf", "", "w"), ("v/h.html", "html", "", ""), ("v/m", "markdown", "", ""),
    ("v/n.rst", "", "", ""), ("v/n.yaml?x=1", "", "", ""), ("v/n.docx", "", "", ""), ("v/none", "", "", ""),
]
_CLASSES = ["code", "chat", "chat", "textbook", "book", "paper", "paper", "paper", "note", "article", "reference", "reference", "chat", "paper", "book", "textbook", "book", "article", "article", "note", "note", "reference", "article", "other"]


@plan("SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{c}')" for r, c in zip(_RULES, _CLASSES, strict=True)) + ") v(uri, value)")
def rule_classifier_cases(t):
    df = t.spark.createDataFrame(_RULES, "uri string, fmt string, title string, text string")
    return df.select("uri", classify.rule_class(F.col("uri"), F.col("fmt"), F.col("title"), F.col("text"))["value"].alias("value"))


@plan("SELECT page_id, 'article' AS value, CAST(0.5 AS DOUBLE) AS confidence FROM pages")
def classify_pages(t):
    none = F.lit("")
    return t.pages.select("page_id", classify.first_confident([classify.rule_class(F.col("url"), F.lit("html"), none, none)]).alias("c")).select("page_id", "c.value", "c.confidence")


_MSG = "(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def _template_sql(head: str, body: str, tail: str) -> str:
    return f"SELECT conv_id, '{head}' || string_agg({body}, '' ORDER BY turn) || '{tail}' AS text FROM {_MSG} GROUP BY conv_id"


_NL = "' || chr(10) || '"
_BODIES = {
    "chatml": _template_sql("", f"'<|im_start|>' || role || '{_NL}' || text || '<|im_end|>{_NL}'", "<|im_start|>assistant"),
    "llama3": _template_sql("<|begin_of_text|>", f"'<|start_header_id|>' || role || '<|end_header_id|>{_NL}{_NL}' || text || '<|eot_id|>'", f"<|start_header_id|>assistant<|end_header_id|>{_NL}"),
    "gemma": _template_sql("", f"'<start_of_turn>' || CASE WHEN role = 'system' THEN 'user' ELSE role END || '{_NL}' || text || '<end_of_turn>{_NL}'", "<start_of_turn>model"),
    "vicuna": _template_sql("", f"CASE role WHEN 'system' THEN text || '{_NL}{_NL}' WHEN 'user' THEN 'USER: ' || text || '{_NL}' WHEN 'assistant' THEN 'ASSISTANT: ' || text || '{_NL}' ELSE '' END", "ASSISTANT:"),
    "alpaca": _template_sql("", f"CASE role WHEN 'system' THEN text || '{_NL}{_NL}' WHEN 'user' THEN '### Instruction:{_NL}' || text || '{_NL}{_NL}' WHEN 'assistant' THEN '### Response:{_NL}' || text || '{_NL}{_NL}' ELSE '' END", "### Response:"),
}
_BODIES["qwen"] = _BODIES["chatml"]


def _template(name):
    def f(t):
        m = t.conversations.groupBy("conv_id").agg(templates.ordered_messages("turn", "role", "text").alias("m"))
        return m.select("conv_id", templates.render(F.col("m"), name).alias("text"))

    f.__name__ = f"chat_template_{name}"
    return f


for _name, _sql in _BODIES.items():
    plan(_sql)(_template(_name))


@plan("""SELECT conv_id, count(*) AS message_count, string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id""")
def chat_export_view(t):
    m = t.conversations.groupBy("conv_id").agg(F.count("*").alias("message_count"), templates.ordered_messages("turn", "role", "text").alias("m"))
    return m.select("conv_id", "message_count", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["content"], F.lit("")))), "|").alias("messages"))


@plan("""WITH l AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS labels FROM (SELECT doc_id, 'quality:' || quality AS x FROM labels UNION ALL SELECT doc_id, 'toxic:' || toxic FROM labels) GROUP BY doc_id)
         SELECT 'chunk:' || d.doc_id AS id, source AS title, coalesce(l.labels, '') AS labels, length(text) AS n FROM documents d LEFT JOIN l USING (doc_id)""")
def text_export_view(t):
    pairs = t.labels.select("doc_id", F.explode(F.array(F.concat(F.lit("quality:"), "quality"), F.concat(F.lit("toxic:"), "toxic"))).alias("x"))
    named = pairs.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("labels"))
    return t.documents.join(named, "doc_id", "left").select(F.concat(F.lit("chunk:"), "doc_id").alias("id"), F.col("source").alias("title"), F.coalesce("labels", F.lit("")).alias("labels"), F.length("text").cast("long").alias("n"))


@plan("""WITH h AS (SELECT doc_id, sha256(sha256(text)) AS h FROM documents)
         SELECT doc_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 65), lambda i: CAST(instr('0123456789abcdef', h[i]) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 100) AS BIGINT) < 10 AS held_out FROM h""")
def demonstration_split(t):
    return t.documents.select("doc_id", (tx.percent_of_hash(tx.content_hash(F.col("text"))) < 10).alias("held_out"))


@plan("""SELECT a.vec_id, round(1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) + 0.0 AS distance
         FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def cosine_distances(t):
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(one)).select("vec_id", (F.round(vx.cosine_distance(F.col("embedding"), F.col("q")), 6) + 0.0).alias("distance"))


@plan("SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def embedding_centroids(t):
    return stats.centroid(t.embeddings, "embedding", "label").withColumn("mean", F.round("mean", 9))


@plan(f"""WITH d AS (SELECT doc_id % 2 = 0 AS s, {_TOK} AS k FROM documents), n AS (SELECT count(*) FILTER (WHERE s) AS na, count(*) FILTER (WHERE NOT s) AS nb FROM d),
         c AS (SELECT k, sum(count(*) FILTER (WHERE s)) OVER (ORDER BY k) AS a, sum(count(*) FILTER (WHERE NOT s)) OVER (ORDER BY k) AS b FROM d GROUP BY k)
         SELECT na, nb, round(max(abs(a / na - b / nb)), 9) AS statistic FROM c, n GROUP BY na, nb""")
def drift_token_length(t):
    d = t.documents.select((F.col("doc_id") % 2 == 0).alias("s"), tx.token_count(F.col("text")).alias("k"))
    return stats.ks_two_sample(d, "k", "s").select("na", "nb", F.round("statistic", 9).alias("statistic"))


@plan("""WITH c AS (SELECT vec_id % 2 = 0 AS s, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
         z AS (SELECT s, sum(exp(m)) AS z FROM c GROUP BY s), p AS (SELECT i, max(CASE WHEN s THEN exp(m) / z END) AS p, max(CASE WHEN NOT s THEN exp(m) / z END) AS q FROM c JOIN z USING (s) GROUP BY i)
         SELECT round(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))), 9) AS js FROM p""")
def drift_embedding_centroid(t):
    return stats.js_divergence(t.embeddings.select("embedding", (F.col("vec_id") % 2 == 0).alias("s")), "embedding", "s").select(F.round("js", 9).alias("js"))


_CLASSES = ["code", "chat", "reference", "book", "textbook", "paper", "article", "note", "other", "", None]
_HINTS = ["markdown", "cdc", "", None]
_listed = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@plan(f"""WITH h AS (SELECT doc_id, source, ({_listed(_CLASSES)})[doc_id % 11 + 1] AS c, ({_listed(_HINTS)})[doc_id % 4 + 1] AS k FROM documents)
  SELECT doc_id, CASE WHEN c = 'code' THEN 'code' WHEN c = 'chat' THEN 'conversation' WHEN c = 'reference' THEN 'passthrough' WHEN c <> '' THEN 'cdc' WHEN k <> '' THEN k ELSE 'own:' || source END AS chunker FROM h""")
def chunker_dispatch(t):
    pick = lambda values, n: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("doc_id") % n).cast("int"))
    return t.documents.select("doc_id", chunking.chunker_for(pick(_CLASSES, 11), pick(_HINTS, 4), F.concat(F.lit("own:"), "source")).alias("chunker"))
