import hashlib
import random
import re

from textloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_match_the_patterns():
    rng = random.Random(0)
    bits = ["a", "b.c", "@", "@", ".", "-", "+", " ", " ", "1", "12", "255", "300", "(", ")", "0000", "4539578763621486", "é", "x@y.z", "10.0.0.1", "+1 (017) 555-7713", "\n", "_", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_patterns_discover_unseen_identifiers(spark):
    rng = random.Random(2)
    card = lambda: next(d for d in iter(lambda: "".join(rng.choice("0123456789") for _ in range(16)), "") if plain_luhn(d))
    rows = [(i, f"notes {rng.random()} and then member card number {card()} was shown to us", 1) for i in range(60)]
    rows += [(100, "notes and then member card number QX-778812-Z was shown to us", 1), (101, "in room 1234567 we met", 1), (102, None, 1), (103, "", 1), (103, "", 1), (104, "x" * 60_000 + " me@example.org", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    accepted = pii.learn(df)
    got = {r.doc_id: r for r in pii.report(df, accepted).collect()}
    assert got[100].spans.startswith("card:") and got[100].n_found == 1 and got[100].n_card == 0
    assert got[101].spans == "" and got[102].spans == ""
    assert got[104].spans == "email:60001:60015"
    for i, t, _ in rows:
        want = ",".join(f"{k}:{s}:{e}" for s, e, k in brute(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    masked = {r.doc_id: r.text for r in pii.redact(df, accepted).collect()}
    assert masked[100] == "notes and then member card number <card> was shown to us"
    assert masked[101] == "in room 1234567 we met" and masked[102] is None and masked[103] == ""
    assert pii.learn(df.limit(0)) == {} and pii.report(df.limit(0), {}).count() == 0


def test_mask_overlaps():
    assert pii.mask("abcdefgh", [(1, 4, "card"), (2, 6, "phone")]) == "a<card>gh"


def test_all_accepted_patterns_count_when_they_are_many(spark, monkeypatch):
    names = [a + b for a in "abcdefgh" for b in "stuvw"]  # many contexts, all of the same confidence
    rows = [(100 * k + i, f"we note {n}left {n}lead u{i}x{k}@mail.example.org {n}tail here", 1) for k, n in enumerate(names) for i in range(6)]
    rows += [(None, f"we note {n}left {n}lead QX-77881{k:02}-Z {n}tail here", 1) for k, n in enumerate(names)] + [(9, None, 1), (9, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    few = pii.learn(df)
    assert len(few) > 40
    want = sorted(map(str, pii.report(df, few).collect()))
    masked = sorted(map(str, pii.redact(df, few).collect()))
    monkeypatch.setattr(pii, "MAX_PATTERNS", 10)
    many = pii.learn(df)
    assert sorted(map(str, pii.report(df, many).collect())) == want
    redacted = pii.redact(df, many)
    assert redacted.columns == df.columns and sorted(map(str, redacted.collect())) == masked
    assert sum(r.n_found for r in pii.report(df, many).collect()) == len(names) and not any("QX" in m for m in masked)


def test_promoted_identifiers_induce_patterns_of_their_own(spark):
    logins = ["amber", "birch", "cedar", "dahlia", "elder", "fern"]
    rows = [(i, f"note {i}: please reach user{i}@mail.example.org for help", 1) for i in range(12)]
    rows += [(20 + i, f"please reach {w} for help", 1) for i, w in enumerate(logins)]  # no recogniser knows them
    rows += [(40 + i, f"it was signed off by {w} today", 1) for i, w in enumerate([*logins, "ginkgo"])]
    rows += [(60 + i, f"we walked off to see the {w} tree", 1) for i, w in enumerate(["oak", "ash", "yew"])]
    rows += [(80, "mail (555) 0199 or so", 1), (None, None, 1), (81, "", 1), (82, "please reach", 1), (82, "please reach", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pattern int")
    accepted = pii.learn(df)
    got = {r.doc_id: r for r in pii.report(df, accepted).collect()}
    assert all(got[20 + i].spans == f"email:13:{13 + len(w)}" for i, w in enumerate(logins))
    assert got[46].spans == "email:21:27"  # found in the second round alone
    assert all(got[i].n_spans == 0 for i in (60, 61, 62, 80, 81, 82, None))
    first = pii.report(df, pii.learn(df, rounds=1)).where("doc_id = 46").first()
    assert first.n_spans == 0


def test_hidden_entities_are_found_back(spark):
    rng = random.Random(4)
    rows = [(i, f"{rng.choice('abcdefgh')} then {rng.choice('stuvw')} wrote {k} here", 1) for i in range(90) for k in [f"10.{i}.7.{rng.randint(1, 250)}" if i % 2 else f"+1 (0{i:02}) 555-77{i:02}"]]
    rows += [(200, "version 3.1 of 2024", 1), (201, "5 of 17 pages", 1), (202, "999.1.2.3 is none", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    hidden = {k: sum(pii.hidden(t[a:b], 3) for _, t, _ in rows for a, b, kind in pii.base_spans(t) if kind == k) for k in ("ip", "phone")}
    got = {r.kind: (r.hidden, r.found, r.wrong) for r in pii.found_back(df, 3).collect()}
    assert min(hidden.values()) > 5 and got == {k: (n, n, 0) for k, n in hidden.items()}


def test_shapes_and_places():
    assert pii.shape("QX-778812-Z") == "a-9s-a" and pii.shape("+1 (017) 555-7713") == "+9 (9) 9-9" and pii.shape("a1b2c3d4e5f6") == "M+"
    text = "Call +1 (017) 555-7713, or 12."
    assert {text[a:b] for a, b in pii._marked(text)} >= {"+1 (017) 555-7713", "12", "017"}
    assert pii.patterns_of("x" * 5000 + " my code: 77 end", 5010, 5012)[:2] == ["2|code :", "r|: end"]
    assert pii.secret_spans("password = 'hunter2x' and sk-" + "a1" * 10) == [(12, 20, "secret"), (26, 49, "secret")]
