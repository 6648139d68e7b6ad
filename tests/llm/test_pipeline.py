import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_components(texts, percent):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus():
    rng = random.Random(11)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if i % 6 == 0:
            words = [w + "###" for w in words]
        rows.append([i, " ".join(words)])
        if i % 2 == 0:
            labels.append((i, int(i % 6 != 0), 0))
    rows[11][1] = rows[7][1].upper()  # a copy
    near = rows[13][1].split()
    near[0] = "other"
    rows[17][1] = " ".join(near)  # a near copy
    rows[19][1] += " mail me at someone.else@mail.example.com now"
    rows += [[400, None], [401, ""]]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs
        if name != "packing":
            assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    clean = {i for i in range(300) if i % 6}
    assert len(clean - ids["quality"]) <= 3 and not ids["quality"] - clean
    # brute force on each stage's own input
    text = {r[0]: r[1] for r in rows}
    first = {}
    for i in sorted(ids["quality"]):
        first.setdefault(text[i].lower(), i)
    assert ids["exact_dedup"] == set(first.values())
    assert ids["near_dedup"] == set(brute_components({i: text[i] for i in ids["exact_dedup"]}, 80).values())
    after = {r.doc_id: r for r in seen["pii"].collect()}
    assert set(after) == ids["near_dedup"]
    changed = {i for i, r in after.items() if r.text != text[i]}
    assert changed == {19} & set(after) and all(len(r.text) == r.n_chars for r in after.values())
    pieces = seen["packing"].collect()
    assert {r.doc_id for r in pieces} == set(after)
    used = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset and len(r.ids) == r.length
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert total.count() == len(pieces)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
