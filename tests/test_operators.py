import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import chunking, classify, graph, quality, relational, retrieval, templates
from textloom.sources import chat, files
from textloom.streaming import sync


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_repetition_and_blank_scores(spark):
    assert quality.repetition("abcabcabc") == 0.0 and quality.repetition("ab") == 1.0
    df = spark.createDataFrame([(" ",), ("!!!!",), ("A calm sentence with words in it.",)], "t string")
    a, b, c = df.select(quality.noise_score(F.col("t"))["quality_score"]).collect()
    assert a[0] == 0 and b[0] < tx.LOW_QUALITY and c[0] > 0.8


def test_redaction_is_idempotent(spark):
    text = "api_key = 'abc' then sk-ABCDEFGHIJKLMNOPQRST and postgres://u:p@h/db"
    out, n = tx.redact(F.col("t"))
    first = spark.createDataFrame([(text,)], "t string").select(out.alias("t"), n.alias("n"))
    assert first.first().n == 3
    assert tuple(first.select(out, n).first()) == (first.first().t, 0)


def test_percent_of_hash(spark):
    h = hashlib.sha256(b"x").hexdigest()
    assert one(spark, tx.percent_of_hash(F.col("h")), h=h) == int(hashlib.sha256(h.encode()).hexdigest(), 16) % 100


def test_min_max_variants(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, float("nan")), (2, 7.0), (3, 1.0), (3, 1.0)], "g int, x double")
    from pyspark.sql import Window

    got = sorted(tuple(r) for r in df.select("g", vx.min_max(F.col("x"), Window.partitionBy("g"), constant=0.5)).collect())
    assert got == [(1, 0.0), (1, 0.0), (1, 1.0), (2, 1.0), (3, 0.5), (3, 0.5)]


def test_content_defined_chunks_survive_an_append():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcdefghij klmnop") for _ in range(20_000))
    cut = lambda d: [d[a:b] for a, b in chunking.content_defined(d)]
    assert b"".join(cut(data)) == data and all(len(c) <= 4096 for c in cut(data))
    assert cut(data)[:-1] == cut(data + b"more text at the end" * 50)[: len(cut(data)) - 1]
    text = ("naïve café 日本語 " * 700).encode()
    assert all(c.decode() for c in cut(text)) and b"".join(cut(text)) == text


def test_markdown_and_code_pieces():
    text = "# Top\n\n" + "A sentence here. " * 300
    got = list(chunking.markdown_pieces(text))
    assert got[0][2] == "Top" and all(len(p) <= 1500 for _, p, _ in got)
    assert all(text[s : s + len(p)] == p for s, p, _ in got)
    lines = "".join(f"line {k}\n" + ("\n" if k % 7 == 6 else "") for k in range(400))
    pieces = list(chunking.code_pieces(lines))
    assert "".join(p for _, _, p in pieces) == lines and all(len(p) <= 1500 for _, _, p in pieces)
    assert list(chunking.markdown_pieces("")) == [] and list(chunking.code_pieces("")) == []


def test_routing_and_chains(spark):
    lanes = [("any", []), ("code", [".py"]), ("late", [])]
    assert one(spark, classify.route(F.col("e"), lanes), e=".py") == "code"
    assert one(spark, classify.route(F.col("e"), lanes), e=".md") == "any"
    c = lambda v, p: F.struct(F.lit(v).alias("value"), F.lit(p).alias("confidence"))
    assert one(spark, classify.first_confident([c("a", 0.2), c("b", 0.6)])["value"], x=1) == "b"
    assert one(spark, classify.first_confident([c("a", 0.2), c("b", 0.3)])["value"], x=1) == "b"
    parts = {k: F.lit(0.5) for k in classify.CURATION_4}
    assert one(spark, classify.top_part(parts, classify.CURATION_4), x=1) == "confidence_deficit"


def test_template_golden(spark):
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", "s"), ("user", "u"), ("tool", "t"))])
    assert one(spark, templates.render(m, "chatml"), x=1) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>tool\nt<|im_end|>\n<|im_start|>assistant"
    assert one(spark, templates.render(m, "vicuna"), x=1) == "s\n\nUSER: u\nASSISTANT:"
    assert one(spark, templates.render(m, "gemma"), x=1).startswith("<start_of_turn>user\ns<end_of_turn>\n")


def test_metrics_known_answers(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 99, 1)], "query_id int, id int, rank int")
    gold = spark.createDataFrame([(1, 11, 1), (1, 13, 1), (2, 5, 1)], "query_id int, id int, grade int")
    got = {r.query_id: r for r in retrieval.metrics(ranked, gold, 10).collect()}
    assert got[1].mrr == 0.5 and got[1].recall == 0.5 and abs(got[1].ndcg - 0.63093 / 1.63093) < 1e-4
    assert got[2].mrr == got[2].recall == got[2].ndcg == 0


def test_clusters_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1, 0.9) for k in range(1, 30)] + [(100, 101, 0.9)], "a long, b long, similarity double")
    got = graph.clusters(pairs).collect()
    assert {(r.id <= 30, r.n) for r in got} == {(True, 30), (False, 2)}
    assert len({r.cluster_id for r in got}) == 2


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new.distinct(), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, relational.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_chat_formats(spark):
    rows = {
        "jsonl": '{"role":"user","content":"hi"}\nnot json\n{"role":"assistant","content":[{"type":"text","text":"yo"},{"type":"tool_use","name":"f"}]}',
        "event_log": '{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"text":"a"}]}}\n{"type":"response_item","payload":{"type":"function_call","name":"f","arguments":"{}"}}',
        "json_array": '[{"role":"model","parts":[{"text":"x"}]}]',
        "tree_export": json.dumps([{"id": "c", "current_node": "2", "mapping": {"0": {"parent": None}, "1": {"parent": "0", "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}}, "2": {"parent": "1", "message": {"author": {"role": "assistant"}, "content": {"parts": ["r"]}}}}}]),
        "session_log": '{"type":"summary"}\n{"type":"user","sessionId":"s","message":{"role":"user","content":"hey"}}',
    }
    want = {"jsonl": ["hi", "yo"], "event_log": ["a"], "json_array": ["x"], "tree_export": ["q", "r"], "session_log": ["hey"]}
    for fmt, text in rows.items():
        got = chat.parse_chat(spark.createDataFrame([(fmt, text)], "source_uri string, value string"), fmt).orderBy("turn").collect()
        assert [r.content for r in got] == want[fmt], fmt
        assert fmt != "event_log" or "arguments" in got[0].tool_calls


def test_extractors():
    title, text = files.html_text("<title>T</title><nav>no</nav><h2>Head</h2><p>a  <b>b</b></p><script>x</script><li>i</li>")
    assert title == "T" and text == "## Head\n\na b\n\n- i"
    assert files.csv_text("a,b\n1,2").splitlines() == ["| a | b |", "| --- | --- |", "| 1 | 2 |"]
    assert files.subtitle_text("1\n00:00:01,000 --> 00:00:02,000\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\nyou") == "Hello\n\nyou"
    assert files.notebook_text('{"cells":[{"cell_type":"markdown","source":["# t"]},{"cell_type":"code","source":"x=1","outputs":[1]}]}') == "# t\n\n```python\nx=1\n```"
    assert files.extract("a/b.JSON", '{"a":1}')[0] == '```json\n{\n  "a": 1\n}\n```'
    assert files.extract("b.py", "x = 1")[2] == "python"


def test_ignore_rules():
    r = files.IgnoreRules(["*.log", "!keep.log", "/build", "docs/**/tmp", "cache/"])
    assert r.ignored("a/b.log") and not r.ignored("a/keep.log") and r.ignored("build/x") and not r.ignored("a/build")
    assert r.ignored("docs/a/b/tmp/x") and r.ignored("x/cache/y") and not r.ignored("cache")


def test_scan_and_watch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# Title\nbody")
    (src / "b.log").write_text("noise")
    got = files.scan(spark, str(src), ["*.log"]).collect()
    assert [(r.title, r.source_uri.endswith("/a.md")) for r in got] == [("Title", True)]
    seen = []
    q = sync.watch_text(spark, str(src), str(tmp_path / "ck"), lambda df, i: seen.extend(r.text for r in df.collect()), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == ["# Title\nbody", "noise"]


def test_echoes_are_used_up(spark):
    t = "timestamp'2024-01-01 00:00:0{}'"
    row = lambda p, h, s: spark.range(1).select(F.lit(p).alias("path"), F.lit(h).alias("h"), F.expr(t.format(s)).alias("at"))
    written = row("p", "1", 0).union(row("q", "1", 0))
    batch, left = sync.without_echoes(row("p", "1", 3).union(row("q", "2", 3)), written, "path", "h", "at")
    assert [r.path for r in batch.collect()] == ["q"] and [r.path for r in left.collect()] == ["q"]


def test_windowed_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:01' + make_dt_interval(0, 0, cast(id as int)) as ts, 'k' as kind from range(0, 30)").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "e"))
    q = sync.windowed_counts(events, "ts", "kind", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [10, 10, 10]


def test_density_topics():
    import numpy as np

    from textloom.operators.evaluation import density_topics

    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.2, size=(40, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [rng.uniform(-20, 20, size=(6, 2))])
    got = density_topics(x)
    for k in range(3):
        part = got[40 * k : 40 * k + 40]
        assert (part == np.bincount(part[part >= 0]).argmax()).mean() > 0.9
    assert len(set(got[:120].tolist()) - {-1}) == 3
    assert (density_topics(x[:6]) == -1).all()


def test_topics_of_many_blocks_are_those_of_one_set(spark, monkeypatch):
    import numpy as np

    from textloom import plans
    from textloom.operators import evaluation as ev

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.2, size=(70, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 6, 1))] + [rng.uniform(-20, 20, size=(11, 3))])
    x[1] = x[0]  # a copy
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(None, [0.1, 0.1, 0.1]), (900, None), (901, [float("nan")] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    want = ev.density_topics(np.vstack([x, [[0.1] * 3]]))
    for block in (16, 100, 2048):
        monkeypatch.setattr(ev, "BLOCK", block)
        got = {r.vec_id: r.topic for r in ev.all_topics(df, "vec_id", "v").collect()}
        assert len(got) == len(rows) and got[900] == got[901] == -1
        pairs = {(int(want[k]), got[k]) for k in range(len(x))} | {(int(want[-1]), got[None])}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and (-1, -1) in pairs
    assert {r.topic for r in ev.all_topics(df.limit(6), "vec_id", "v").collect()} == {-1}
    assert ev.all_topics(df.limit(0), "vec_id", "v").count() == 0
    # the registered query: topics do not change when the table is larger than a block
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(ev, "BLOCK", 64)
    v = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    whole = ev.density_topics(np.array([r.embedding for r in v], float))
    got = {r.vec_id: r.topic for r in plans.queries()["topic_clusters"](spark, sf).collect()}
    pairs = {(int(a), got[r.vec_id]) for a, r in zip(whole, v, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_topics_move_vectors_in_proportion_to_the_set(spark, monkeypatch):
    import numpy as np

    from textloom.operators import evaluation as ev

    def shuffled():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    monkeypatch.setattr(ev, "BLOCK", 32)
    rng, moved = np.random.default_rng(7), []
    for n in (384, 1536):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 32)))], "id long, v array<double>")
        before = shuffled()
        assert ev.all_topics(df, "id", "v").count() == n
        moved.append(shuffled() - before)
    assert moved[1] < 6 * moved[0]  # four times the vectors


def test_links_and_nearest_are_those_of_all_pairs(monkeypatch):
    import numpy as np

    from textloom.operators import evaluation as ev

    rng = np.random.default_rng(11)
    even, apart = rng.normal(size=(400, 6)), np.vstack([rng.normal(9 * k, 0.3, size=(100, 6)) for k in range(4)])
    copies = np.vstack([np.zeros((150, 6)), np.ones((90, 6)), rng.normal(size=(160, 6))])
    for strip, x in ((16, even), (64, apart[rng.permutation(400)]), (16, apart), (64, copies), (256, copies[rng.permutation(400)])):
        monkeypatch.setattr(ev, "STRIP", strip)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        core = np.sort(d, axis=1)[:, 5]
        cuts = [0, 1, 60, 160, 163, 290, 400]
        for rows, across in ((slice(0, 400), False), (slice(0, 400), True)):
            best = np.full((400, 6), np.inf)
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = np.square(d[rows, a:b])
                best = ev._nearest(best, part.T if across else part, across)
            assert np.allclose(np.sqrt(np.sort(best, axis=1)), np.sort(d, axis=1)[:, :6])
        blocks = [(x[a:b], core[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        reach = np.maximum(d, np.maximum(core[:, None], core[None]))
        for got, a, b in ((ev._links(blocks), *np.triu_indices(400, 1)), (ev._links(blocks[:3], blocks[3:]), *(k.ravel() for k in np.mgrid[0:160, 160:400]))):
            every = np.empty(len(a), ev._EDGE)
            every["w"], every["a"], every["b"] = reach[a, b], a, b
            assert len(got) == 399 and np.allclose(got["w"], ev._forest(every)["w"], atol=1e-6) and np.allclose(got["w"], reach[got["a"], got["b"]], atol=1e-6)
    assert len(ev._links([(x[:1], core[:1])])) == 0


def test_learned_reranker(spark):
    from textloom.operators import evaluation as ev

    events = spark.createDataFrame([("rate", k / 40, "lexical" if k % 2 else "dense", "q" * (k % 5)) for k in range(41)], "signal string, value double, source string, query string")
    model, auc = ev.train_reranker(ev.rerank_examples(events))
    hits = spark.createDataFrame([(1, 7, 0.2, 0.0, 3.0), (1, 8, 0.9, 0.0, 3.0), (1, 9, 0.5, 1.0, 3.0)], "query_id int, id int, score double, is_lexical double, query_len double")
    assert auc > 0.95 and [r.id for r in ev.apply_reranker(model, hits, 2).orderBy("rank").collect()] == [8, 9]


def test_dense_asks_many_queries_in_blocks(spark, monkeypatch):
    import numpy as np

    from textloom.operators import retrieval as rt

    x = np.random.default_rng(5).normal(size=(60, 4))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, embedding array<double>")
    q = v.selectExpr("id AS query_id", "embedding AS q")
    want = sorted((r.query_id, r.id, r["rank"]) for r in rt.dense(q, v, 3).collect())
    monkeypatch.setattr(rt, "ASKED", 16)
    assert sorted((r.query_id, r.id, r["rank"]) for r in rt.dense(q, v, 3).collect()) == want and len(want) == 180
    # more queries than were ever taken at once
    monkeypatch.setattr(rt, "ASKED", 10_000)
    many = spark.range(10_050).selectExpr("id AS query_id", "array(1.0D, 0.0D, 0.0D, double(id)) AS q")
    assert rt.dense(many, v.where("id < 3"), 1).count() == 10_050


def test_scores_that_round_alike_are_ties_before_the_first_cut(spark, tmp_path):
    from textloom import plans

    # the smallest ids are worse by less than the digits that count, and 140 others stand before them
    texts = [(k, "apple " * 10_000 + "filler " * (2 if k < 10 else 1)) for k in range(150)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "apple apple apple")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vectors = [(k, [1.0, 1e-4 if 0 < k < 10 else 0.0]) for k in range(150)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, query in (("lexical_search", 7), ("dense_search", 0)):
        rows = [r for r in plans.queries()[name](spark, str(tmp_path)).collect() if r.query_id == query]
        assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == list(range(10)), name


def test_budget_over_many_ranges(spark):
    # one source holds most rows, sizes tie, are null or zero, and one source is null
    rows = [("hot" if i % 5 else None if i % 10 else "small", i, None if i % 17 == 0 else i % 23) for i in range(400)]
    df = spark.createDataFrame(rows, "source string, id long, size long")
    order = lambda r: (-(r[2] if r[2] is not None else -1), r[1])
    got = {r.id: r.evict for r in relational.budget(df, "source", [F.desc_nulls_last("size"), F.asc("id")], "size", 50, 300).collect()}
    for source in ("hot", "small", None):
        mine = sorted((r for r in rows if r[0] == source), key=order)
        n, b = len(mine), sum(r[2] or 0 for r in mine)
        for r in mine:
            assert got[r[1]] == (n > 50 or b > 300), r
            n, b = n - 1, b - (r[2] or 0)
    assert relational.budget(df.limit(0), "source", [F.asc("id")], "size", 1, 1).collect() == []


def test_similar_clusters_count_copies_without_making_pairs(spark):
    base = [f"w{i}" for i in range(40)]
    sets = [base] * 3 + [[*base[:-1], "x"]] * 2 + [["alone"], ["twin"], ["twin"], [], None]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, s array<string>")
    got = {r.id: (r.n, r.similarity, r.cluster_id) for r in graph.similar_clusters(df, "id", "s", 85).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 6, 7}
    assert got[0][0] == 5 and got[0][1] == pytest.approx((4 * 1.0 + 6 * 39 / 41) / 10)
    assert got[6][:2] == (2, 1.0) and len({got[i][2] for i in range(5)}) == 1 != len({got[0][2], got[6][2]})
    pairs = graph.clusters(retrieval.shingle_pairs(df, "id", "s", 85)).collect()
    assert {r.id: r.cluster_id for r in pairs} == {i: c for i, (_, _, c) in got.items()}
    assert graph.similar_clusters(df.limit(0), "id", "s", 85).collect() == []


def test_replaced_chunks_keep_ids_of_unchanged_texts(spark):
    old = spark.createDataFrame([(1, "a", 10, 0), (1, "b", 11, 1), (1, "a", 12, 2), (1, None, 13, 3), (2, "a", 20, 0)], "doc long, h string, id long, at int")
    new = spark.createDataFrame([(1, "a", 0), (1, "c", 1), (1, "a", 2), (3, "a", 0)], "doc long, h string, at int")
    got = sorted((r.doc, r.h or "", r.id or -1, -1 if r.at is None else r.at, r.action) for r in relational.replace_chunks(old, new, "doc", "h", "id", "at").collect())
    assert got == [
        (1, "", 13, -1, "delete"),
        (1, "a", -1, 2, "insert"),
        (1, "a", 10, 0, "update"),
        (1, "a", 12, -1, "leave"),
        (1, "b", 11, -1, "delete"),
        (1, "c", -1, 1, "insert"),
        (3, "a", -1, 0, "insert"),
    ]
    assert relational.replace_chunks(old, new.limit(0), "doc", "h", "id", "at").collect() == []


def test_audit_of_changed_rows(spark):
    before = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "k long, v string, n int")
    after = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 3)], "k long, v string, n int")
    got = {r.k: (r.before and json.loads(r.before), r.after and json.loads(r.after), r.dry_run) for r in relational.audit(before, after, ["k"], "edit", True).collect()}
    assert got == {2: ({"v": "y", "n": 1}, {"v": "y", "n": None}, True), 3: ({"v": "z", "n": 2}, None, True), 4: (None, {"v": "w", "n": 3}, True)}


def test_chunker_names(spark):
    pick = chunking.chunker_for(F.col("c"), F.col("k"), F.lit("own"))
    df = spark.createDataFrame([("book", "markdown"), ("", "markdown"), (None, ""), (None, None)], "c string, k string")
    assert [r[0] for r in df.select(pick).collect()] == ["cdc", "markdown", "own", "own"]
    for row in (("poem", "cdc"), (None, "lines")):
        with pytest.raises(Exception, match="unknown"):
            spark.createDataFrame([row], df.schema).select(pick).collect()


def test_lexical_blocks_agree_with_postings_and_brute_force(spark, monkeypatch):
    import math
    import random

    from textloom.operators import retrieval as rt

    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["the", "of", "river", "Stone", "oak", "x9", "ab", "c"], [20, 9, 5, 4, 3, 2, 2, 9], k=rng.randrange(0, 30))) if i else None) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = [(q, w) for q in range(9) for w in {"the", "oak", ("river", "x9", "nowhere")[q % 3]}]
    q = spark.createDataFrame(asked, "query_id long, term string")
    words = {i: [w for w in t.lower().split() if len(w) > 1] for i, t in texts if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    df = {w: sum(w in x for x in words.values()) for _, w in asked}
    want = []
    for k in range(9):
        raw = {i: sum(math.log(1 + (50 - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for a, t in asked if a == k and t in x) for i, x in words.items()}
        best = sorted((-round(s / (1 + s), 9), i) for i, s in raw.items() if s > 0)[:5]
        want += [(k, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    rows = lambda x: sorted((r.query_id, r.id, r.score, r["rank"]) for r in x.collect())
    for block, frequent in ((4096, 1024), (2, 1024), (4096, 0), (4, 1)):
        monkeypatch.setattr(rt, "BLOCK", block)
        monkeypatch.setattr(rt, "FREQUENT", frequent)
        assert rows(rt.bm25_texts(q, docs, "doc_id", "text", 5, 9)) == sorted(want)
    assert rows(rt.bm25(q, rt.postings(docs, "doc_id", "text"), rt.lengths(docs, "doc_id", "text"), 5, 9)) == sorted(want)
    # rows of one id are one text
    twice = docs.union(docs.where("doc_id < 5"))
    got = rows(rt.bm25_texts(q, twice, "doc_id", "text", 5, 9))
    assert got == rows(rt.bm25(q, rt.postings(twice, "doc_id", "text"), rt.lengths(twice, "doc_id", "text"), 5, 9)) and len({x[:2] for x in got}) == len(got)
    assert rt.bm25_texts(q.limit(0), docs, "doc_id", "text", 5).collect() == [] and rt.bm25_texts(q, docs.limit(0), "doc_id", "text", 5).collect() == []


def test_repetition_counts_what_slices_count(spark):
    import random
    from collections import Counter

    def slow(t):
        most = {n: max(Counter(t[k : k + n] for k in range(len(t) - n + 1)).values()) for n in range(3, min(8, len(t)) + 1)}
        return max(0.0, 1 - max((c * n / len(t) for n, c in most.items() if c > 1), default=0.0))

    rng = random.Random(1)
    kinds = ["ab", "abc \n", "aé漢字xy", "".join(map(chr, range(300, 900))) + "ab" * 200]
    texts = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(60))) * rng.choice([1, 1, 7]) for _ in range(800)]
    assert [quality.repetition(t) for t in texts] == [slow(t) for t in texts]
    # every part from one look at the text, as the columns say it
    rows = [None, "", " \t", "Ünï THE_end! 漢字 " * 9, "!!!!", "ALL CAPS " * 5]
    x = F.col("t")
    d = spark.createDataFrame([(t,) for t in rows], "t string").coalesce(1)
    for r in d.where("length(trim(replace(t, '\t', ' '))) > 0").select(quality.noise_score(x).alias("s"), tx.token_rate(x), tx.punctuation_balance(x), tx.shouting(x)).collect():
        assert (r.s.token_rate, r.s.punctuation_balance, r.s.shouting_ratio) == tuple(r)[1:]
    assert [tuple(r.s) for r in d.select(quality.noise_score(x).alias("s")).collect()][:3] == [(0.0,) * 5] * 3
    assert "regexp" not in d.select(quality.noise_score(x))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_chunkers_hold_few_pieces_at_a_time(spark):
    import pyarrow as pa

    class Frame:
        def select(self, *_):
            return self

        where = select

        def mapInArrow(self, run, schema):
            return run

    run = chunking.chunk_with(Frame(), "doc_id", "text", chunking.markdown_pieces, "start int, text string, heading string")
    texts = ["word " * 2000] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["doc_id", "text"])
    out = list(run(iter([batch])))
    assert max(b.nbytes for b in out) < 4 << 20 and {b.schema.field("text").type for b in out} == {pa.string()}
    got = [(r["doc_id"], r["index"], r["start"], r["text"], r["heading"]) for b in out for r in b.to_pylist()]
    assert got == [(i, k, *p) for i, t in enumerate(texts) for k, p in enumerate(chunking.markdown_pieces(t))]


def test_metrics_by_label_make_no_pairs(spark):
    from textloom.operators import retrieval as rt

    members = spark.createDataFrame([(i, i % 3 if i % 10 else None, i % 4) for i in range(60)], "id long, label int, grade int")
    queries = members.where("id % 7 = 0").selectExpr("id AS query_id", "label").union(spark.createDataFrame([(99, 8)], "query_id long, label int"))
    ranked = spark.createDataFrame([(q, (q * 5 + r * 7) % 60, r) for q in range(0, 57, 7) for r in range(1, 9)], "query_id long, id long, rank int")
    gold = queries.join(members, "label").select("query_id", "id", "grade")
    rows = lambda m: sorted((r.query_id, round(r.ndcg, 9), round(r.mrr, 9), round(r.recall, 9)) for r in m.collect())
    for k in (3, 40):
        got = rt.labelled_metrics(ranked, queries, members, k)
        assert rows(got) == rows(rt.metrics(ranked, gold, k)) != []


def test_similar_pairs_by_classes_lose_no_pair(spark):
    import random

    rng = random.Random(2)
    sets = []
    for _ in range(40):
        base = rng.sample(range(60), rng.randrange(1, 40))
        sets += [base, base, [x for x in base if rng.random() > 0.05], [*base, rng.randrange(60)]]
    words = [sorted({f"w{x}" for x in s}) for s in sets] + [[], None]
    df = spark.createDataFrame(list(enumerate(words)), "id long, s array<string>")
    both = lambda a, b: (len(set(a) & set(b)), len(set(a) | set(b)))
    want = {(i, j): x / y for i, a in enumerate(words) for j, b in enumerate(words) if i < j and a and b for x, y in [both(a, b)] if 100 * x >= 85 * y}
    got = graph.similar_pairs(df, "id", "s", 85).collect()
    assert len(got) == len(want) > 80 and {(r.a, r.b): r.similarity for r in got} == want
    assert {(r.a, r.b): r.similarity for r in retrieval.shingle_pairs(df, "id", "s", 85).collect()} == want
    assert graph.similar_pairs(df.limit(0), "id", "s", 85).collect() == []


def test_similar_texts_match_their_shingles(spark):
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base), "\t" + "  ".join(base) + "\n", " ".join([*base, "x"]), " ".join(base[:-1]), "a b c", "a\x0bb\x0cc", "a b", "b a", "a", "a b c d", "a b c\xa0d", "\xa0", "a a a a a a", "a a a a", "", " \n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    want = rows(graph.similar_pairs(df.select("id", tx.shingles(F.col("text")).alias("s")), "id", "s", 85))
    assert rows(graph.similar_pairs(df, "id", "text", 85)) == want
    assert {(a, b) for a, b, _ in want} == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3), (4, 5), (12, 13)}
    assert rows(graph.similar_clusters(df, "id", "text", 85)) == rows(graph.similar_clusters(df.select("id", tx.shingles(F.col("text")).alias("s")), "id", "s", 85))


def test_similar_pairs_move_a_set_once_not_for_each_pair(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"m{rng.random()}" for _ in range(400)]
    sets = [[*base[: 400 - i % 7], *(f"own{i}-{k}" for k in range(i % 5 + 1))] for i in range(150)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, s array<string>")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    moved = lambda: sum(stages().apply(i).shuffleWriteBytes() for i in range(stages().size()))
    monkeypatch.setattr(retrieval, "BUCKETS", 1 << 10)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        got = sorted(tuple(r) for r in graph.similar_pairs(df, "id", "s", 85).collect())
        assert len(got) == 150 * 149 // 2 and moved() - before < 10e6
        monkeypatch.setattr(retrieval, "CELL_BYTES", 100_000)  # several blocks for one group
        assert sorted(tuple(r) for r in graph.similar_pairs(df, "id", "s", 85).collect()) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
