import math
import random

import numpy as np

from textloom.llm import langid, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=400, seed=1):
    rng = random.Random(seed)
    plain = ["river", "stone", "walked", "morning", "the", "a", "of", "and", "light", "house"]
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 7 == 0, i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(15, 60))]
        if bad:
            words = [w + "$$$" for w in words]
        if toxic:
            words[3:3] = ["vile" + rng.choice(["ness", "ly", "st", "r"]), "grumpus"]
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_resampling_keeps_good_and_rejects_bad(spark):
    rows, labels = documents()
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "river " * 9000, "en", "s", 1), (None, "the river", "en", "s", 1), (3, rows[3][1], "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], DOCS + ", kept int")
    lab = spark.createDataFrame([*labels, (4, None, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, lab)
    got = quality.score(docs, model)
    kept = {r.doc_id for r in got.collect() if r.kept}
    assert got.count() == len(rows)
    clean = {i for i in range(400) if i % 7}
    assert len(clean - kept) <= 4 and not {i for i in range(400) if not i % 7} & kept
    assert not {1000, 1001} & kept
    chosen = quality.select(docs, lab)
    assert chosen.columns == docs.columns and {r.doc_id for r in chosen.collect()} == kept
    # brute force: the k greatest keys, ties to the smaller id
    keys = sorted((-r.sample_key, r.doc_id) for r in got.where("doc_id is not null and doc_id <> 3 and sample_key is not null").collect())
    few = docs.where("doc_id is not null and doc_id <> 3")
    assert {r.doc_id for r in quality.score(few, model, k=37).collect() if r.kept} == {i for _, i in keys[:37]}
    assert quality.score(few, model, k=0).where("kept").count() == 0
    assert {r.doc_id for r in quality.select(few, lab, k=37).collect()} == {i for _, i in keys[:37]}
    tied = spark.createDataFrame([(i, "river stone", "en", "s", 0) for i in (7, 7, 7, None)], DOCS)  # equal keys of one id, and noise of none
    assert quality.score(tied, model, k=3).where("kept").count() in (3, 4)  # rows of one id stay together
    assert quality.select(docs.limit(0), lab).count() == 0
    none = lab.limit(0)
    assert quality.score(docs, quality.fit(docs, none)).where("kept").count() == len(rows) - 2
    assert quality.score(docs.limit(0), model).count() == 0


def test_ratio_is_that_of_counted_ngrams(spark):
    """Buckets, counts, ratio and cut by hand over a small table."""
    import re

    from pyspark.sql import functions as F

    rows, labels = documents(60, seed=4)
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, lab)
    halves = {r.id: r.h for r in spark.createDataFrame([(i,) for i, _, _ in labels], "id long").select("id", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).alias("h")).collect()}
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    good = {i for i, q, _ in labels if q == 1 and halves[i] == 0}
    hashes = quality.TokenHashes()
    for i, t, *_ in rows:
        tokens = re.findall(r"\w+|[^\w\s]+", t.lower())
        grams = quality.ngrams(t, hashes)
        assert len(grams) == 2 * len(tokens) - 1
        # equal n-grams share a bucket, and the bucket of a word is that of the word alone
        assert [int(quality.ngrams(w, hashes)[0]) for w in tokens] == grams[: len(tokens)].tolist()
        assert [int(quality.ngrams(f"{a} {b}", hashes)[2]) for a, b in zip(tokens, tokens[1:])] == grams[len(tokens) :].tolist()
        for g in grams:
            raw[g] += 1
            target[g] += i in good
    want = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    assert np.allclose(model.weights, want, atol=1e-12)
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(abs(scored[i].log_weight - want[quality.ngrams(t, hashes)].sum()) < 1e-6 for i, t, *_ in rows)
    reach = sorted(r.sample_key for r in scored.values())
    assert sorted(r.sample_key for r in scored.values() if r.kept) == [x for x in reach if x >= model.cut]


def test_gumbel_noise_is_gumbel():
    x = quality.gumbel(list(range(20_000)), 3)
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.std() - math.pi / 6**0.5) < 0.03


def test_chain_finds_toxic_texts(spark):
    rows, labels = documents(seed=2)
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "en", "s", 0), (902, "vilely grumpus " * 9000, "en", "s", 0)], DOCS)
    lab = spark.createDataFrame([*labels, (6, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    unseen = [i for i in range(400) if i % 2]  # none of them labelled
    right = sum(got[i].flagged == (i % 5 == 0) for i in unseen)
    assert right >= 0.97 * len(unseen)
    assert not got[900].flagged and not got[901].flagged and got[902].flagged
    assert chain.names == ["toxic", "toxic_prose", "toxic_noise"]
    assert len(chain.weights[2]) == len(chain.weights[0]) + 2  # earlier probabilities are features
    empty = toxicity.fit(docs, lab.limit(0))
    assert toxicity.score(docs, empty).where("flagged").count() == 0


def brute_marginals(crf, words):
    n, e = len(crf.langs), [crf.emission(w) for w in words]
    out, total = np.zeros((len(words), n)), 0.0
    for k in range(n ** len(words)):
        path = [k // n**t % n for t in range(len(words))]
        s = crf.begin[path[0]] + sum(e[t][c] for t, c in enumerate(path)) + sum(crf.trans[a, b] for a, b in zip(path, path[1:]))
        total += math.exp(s)
        for t, c in enumerate(path):
            out[t, c] += math.exp(s)
    return out / total


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    crf = langid.Crf(["a", "b", "c"], {"uno": [0, 1]})
    crf.w[:] = rng.normal(size=crf.w.shape) * 0.3
    crf.trans[:], crf.begin[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    texts = [["uno", "dos", "tres", "four"], ["five"], ["uno", "six"]]
    padded, lengths = np.zeros((3, 4, 3)), np.array([4, 1, 2])
    for row, t in zip(padded, texts):
        row[: len(t)] = [crf.emission(w) for w in t]
    got = crf.marginals(padded, lengths)
    for q, t in zip(got, texts):
        assert np.allclose(q[: len(t)], brute_marginals(crf, t), atol=1e-9)


def test_training_follows_the_gradient():
    """Truth less expectation of words and transitions, against differences of the log-likelihood."""
    rng = np.random.default_rng(3)
    crf = langid.Crf(["a", "b", "c"], {"uno": [2]})
    crf.w[:] = rng.normal(size=crf.w.shape) * 0.3
    crf.trans[:], crf.begin[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    part = [[("uno", 0), ("dos", 0), ("tres", 2)], [("four", 1)], [("uno", 2), ("dos", 1)]]

    def likelihood():
        total = 0.0
        for s in part:
            e, labels = [crf.emission(w) for w, _ in s], [y for _, y in s]
            one = lambda path: crf.begin[path[0]] + sum(x[c] for x, c in zip(e, path)) + sum(crf.trans[a, b] for a, b in zip(path, path[1:]))
            paths = [[k // 3**t % 3 for t in range(len(s))] for k in range(3 ** len(s))]
            total += one(labels) - math.log(sum(math.exp(one(p)) for p in paths))
        return total

    lengths, width = np.array([3, 1, 2]), 3
    scores, truth = np.zeros((3, width, 3)), np.zeros((3, width, 3))
    for i, s in enumerate(part):
        for t, (w, y) in enumerate(s):
            scores[i, t], truth[i, t, y] = crf.emission(w), 1
    inside = (np.arange(width)[None, :] < lengths[:, None])[:, :, None]
    p = crf.marginals(scores, lengths) * inside
    pairs = np.einsum("itk,itl->kl", truth[:, :-1], truth[:, 1:]) - crf._pairs(scores, lengths, p)
    start = (truth[:, 0] - p[:, 0]).sum(axis=0)
    step = 1e-5
    for array, grad in ((crf.trans, pairs), (crf.begin, start)):
        for at in np.ndindex(array.shape):
            array[at] += step
            up = likelihood()
            array[at] -= 2 * step
            down = likelihood()
            array[at] += step
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-6


def test_language_edges(spark):
    rows = [(i, t, "aa" if i % 2 else "bb", "s", 0) for i in range(60) for t in ["kala moro tivu" if i % 2 else "streng wurz pfad"]]
    df = spark.createDataFrame([*rows, rows[0], rows[0], (5, "other text of the id", "aa", "s", 0)], DOCS).selectExpr("*", "lang as lang_pred", "0 as score")
    crf = langid.fit(df)
    got = langid.predict(df, crf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"] and got.count() == 63
    assert got.where("doc_id = 0").distinct().count() == 1 and langid.predict(df.limit(0), crf).count() == 0
    assert {r.lang_pred for r in got.where("doc_id % 2 = 1 and doc_id <> 5").collect()} == {"aa"}


def test_chain_is_that_of_models_fitted_in_turn():
    """Chain and folds step by step over 200 texts."""
    rng = np.random.default_rng(8)
    y = np.stack([(rng.random(200) < q).astype(int) for q in (0.4, 0.3)], axis=1)
    features = [np.unique(np.concatenate((rng.integers(0, 40, 12), [50 + k for k in range(2) if y[i, k] and rng.random() < 0.9]))) for i in range(200)]
    chain = toxicity.fit_chain(features, y, ["one", "two"])
    x = np.array([[float(w in set(f.tolist())) for w in chain.words] for f in features], np.float32)
    earlier = np.zeros((200, 0), np.float32)
    for c in range(2):
        full = np.hstack((x, earlier))
        w = toxicity.train_linear(full, y[:, c].astype(np.float32))
        assert np.allclose(chain.weights[c], w, atol=1e-6)
        outside = np.zeros(200, np.float32)
        for i in range(200):  # a text is judged by the model of the other folds
            if i < toxicity.FOLDS:
                others = [j for j in range(200) if j % toxicity.FOLDS != i % toxicity.FOLDS]
                v = toxicity.train_linear(full[others], y[others, c].astype(np.float32))
                mine = [j for j in range(200) if j % toxicity.FOLDS == i]
                outside[mine] = 1 / (1 + np.exp(-np.clip(full[mine] @ v[:-1] + v[-1], -30, 30)))
        earlier = np.hstack((earlier, outside[:, None]))
    got = chain.predict(x[:5].astype(np.float64))
    for row, f in zip(got, x[:5]):
        z = f @ chain.weights[0][:-1] + chain.weights[0][-1]
        p = 1 / (1 + np.exp(-z))
        z = f @ chain.weights[1][:-2] + p * chain.weights[1][-2] + chain.weights[1][-1]
        assert np.allclose(row, [p, 1 / (1 + np.exp(-z))], atol=1e-5)


def test_chain_edges(spark):
    rows, labels = documents(80, seed=6)
    df = spark.createDataFrame([*rows, rows[1], rows[1], (500, None, None, None, None)], DOCS).selectExpr("*", "true as flagged", "0.5D as p_toxic")
    lab = spark.createDataFrame([*labels, labels[1], (2, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(df, lab)
    got = toxicity.score(df, chain)
    assert got.columns == ["doc_id", "p_toxic", "p_toxic_prose", "p_toxic_noise", "flagged"] and got.count() == 83
    assert got.where("doc_id = 1").distinct().count() == 1 and not got.where("doc_id = 500").first().flagged
    assert toxicity.score(df.limit(0), chain).count() == 0


def test_language_of_held_out_and_switched_texts(spark):
    rng = random.Random(5)
    stems = {"aa": ["kala", "moro", "tivu", "sano"], "bb": ["streng", "wurz", "schlag", "pfad"], "cc": ["çoeur", "éau", "ôtre", "reux"]}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(3, 80))), lang, "s", 0) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    mixed = [word("aa") for _ in range(12)] + [word("bb") for _ in range(20)]
    rows += [(500, None, "aa", "s", 0), (501, "", None, "s", 0), (502, "123 ²½ ...", "aa", "s", 0), (503, " ".join(mixed), None, "s", 0), (None, "kala moro", "aa", "s", 0)]
    rows += [(504, "moro kala " * 12_000, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    crf = langid.fit(docs)
    got = langid.predict(docs, crf)
    by = {r.doc_id: r for r in got.collect()}
    truth = {r[0]: r[2] for r in rows[:240]}
    out = [i for i in truth if by[i].held_out]
    assert 40 < len(out) < 80 and sum(by[i].lang_pred == truth[i] for i in out) >= 0.98 * len(out)
    assert by[500].lang_pred == by[501].lang_pred == by[502].lang_pred == "und" and by[502].score == 0
    assert by[503].lang_pred == "bb" and by[503].n_switches == 1 and by[504].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in by.values()) and not by[None].held_out
    nothing = langid.fit(docs.limit(0))
    assert langid.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0
