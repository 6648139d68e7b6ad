import hashlib
import random
import struct

from tokenizers import Tokenizer

from textloom.llm import bpe, url_filter
from textloom.llm.registry import URL_RULES, tokenizer_path

BITS = ["the ", "'s", "'LL", "thingness", "<|endoftext|>", "<|start", " ", "\t", "é", "é", "İ", "Σ", "ß", "日本", "🎉", "1", "23", "$$$", "\x1c", "\x85", " ", "K", "Ǆ", "­", "￼", "naïve"]


def test_bpe_equals_the_library(spark):
    rng = random.Random(0)
    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 30_000), (5, "a" * 20_000), (5, "a" * 20_000)]
    rows += [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(1, 14)))) for i in range(10, 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(df, tokenizer_path()).collect())
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_digest(df.limit(0), tokenizer_path()).count() == 0


def brute_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (h.count("."), len(slash + p), verdict == "block")
            if best is None or key > best[0]:
                best = (key, (verdict, rule))
    return best and best[1]


def test_trie_equals_longest_match():
    rng = random.Random(1)
    labels, parts = ["a", "b", "net", "org"], ["", "x", "xy", "en", "e"]
    for _ in range(300):
        rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))) + "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 3)))) for _ in range(6)]
        trie = url_filter.UrlTrie(rules)
        for _ in range(20):
            host, path = ".".join(rng.choices(labels, k=rng.randint(1, 4))), "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 4)))
            assert trie.find(host, path) == brute_rule(host, path, rules), (rules, host, path)


def test_verdicts(spark):
    urls = ["http://X.Example.NET/en/a?b", "https://example.net/fr/", "http://example.net", "http://a.org/fr/x#y", "ftp://example.com?q=/de/", "http://example.com/de/1", "nothing", "", None, "http://example.com/de/1", "http://e.com/" + "a/" * 40_000]
    df = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df, URL_RULES).collect()}
    assert got[0] == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/fr/", "net/", "block")
    assert got[2] == ("example.net", "", None, "allow")
    assert got[3] == ("a.org", "/fr/x", "org/fr/", "allow")
    assert got[4] == ("example.com", "", None, "allow")
    assert got[5] == got[9] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert url_filter.url_verdicts(df.limit(0), URL_RULES).count() == 0
