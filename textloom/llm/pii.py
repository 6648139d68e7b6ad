"""Personal data: fixed recognisers, then bootstrapped contextual extraction.

What the recognisers find are seeds.  Each seed induces lexical patterns: the two words before it, the
words on both sides, and its shape alone or after a word or a kind of word.  A pattern that enough
seeds share is looked for in all texts; what stands in its place are its instances.  Patterns and
instances form a graph, over which Spark scores both in turn: a pattern by the mean of its instances,
an instance by the noisy-or of its other patterns.  Instances of high-confidence patterns are the seeds
of the next round, which induces patterns around them.  Accepted patterns then mark identifiers that no
recogniser knows.  Texts never leave their rows; patterns reach the workers in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import SECRET_PATTERNS
from textloom.llm.common import fresh, in_worker, map_batches, slices, write_few

KINDS = ("email", "ip", "card", "phone")
SEEDED = "secret"  # a fifth kind: credentials after their names, and long strings that mix letters and digits
MAX_PATTERNS = 100_000  # patterns, or values, that a worker holds at once; more are taken in blocks
LEAST_SEEDS, LEAST_SCORE, LEAST_SHARE, ROUNDS, STEPS, PRIOR, DOUBT = 5, 0.8, 0.2, 3, 4, 1.0, 0.7
SLOT = 4  # tokens of an instance
PLAIN = 2  # tokens of an instance without digit or @

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SECRET = re.compile(r"[A-Za-z0-9]{32,}")
_CREDENTIALS = [re.compile(p) for p in SECRET_PATTERNS]
_HINTS = ("://", "sk-", "xai-", "claude-", "bearer", "api", "password", "secret")  # what a credential's text holds
_EDGE = "`.!?*#%&$/\\"
_TOKEN = re.compile(r"""[^\s"'=:,;<>()\[\]{}|]+|[=:]""")
_BREAKS = frozenset("\"'=:,;<>()[]{}|")
_ANY = re.compile("[0-9@]")
_RUNS = re.compile(r"[^\W_]+|\s+")

Span = tuple[int, int, str]
Accepted = dict[str, tuple[str, float]] | DataFrame


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping matches: each @ with the longest local part that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end(), "email"
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[Span]:
    """Spans (start, end, kind) in code points, by start, then kind as in KINDS."""
    if not text:
        return []
    out = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(text: str) -> list[Span]:
    """Credentials by their names or forms, and long strings that mix letters and digits; none overlap."""
    out, end = [], -1
    found = [m.span() for m in _SECRET.finditer(text) if not (m.group().isalpha() or m.group().isdecimal())] if _DIGITS.search(text) else []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [m.span(2) if p.groups > 1 else m.span() for p in _CREDENTIALS for m in p.finditer(text)]
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end and b > a:
            out.append((a, b, SEEDED))
            end = b
    return out


def _run_shape(m: re.Match) -> str:
    w = m.group()
    if w.isspace():
        return " "
    if w.isalpha():
        return "a"
    n = len(w)
    if w.isdecimal():
        return "9" if n < 5 else "9s" if n < 10 else "9m" if n < 14 else "9l" if n < 20 else "9x"
    return "m" if n < 6 else "M" if n < 12 else "M+"


def shape(value: str) -> str:
    """Runs of letters, digits or both as classes of their length, everything else as it is."""
    return _RUNS.sub(_run_shape, value)


def _word(token: str) -> str:
    """A context word: lower case, without marks around it; one with a digit is just a number."""
    return "#" if _DIGITS.search(token) else token.lower().strip(_EDGE) or token


def _around(text: str, start: int, end: int) -> tuple[list[str], str]:
    """The two words before a span and the one after it; fewer at the ends of the text."""
    left, width = [], 100
    while True:  # the first token of a window may be cut
        left = _TOKEN.findall(text, max(0, start - width), start)
        if len(left) > 2 or width >= start:
            break
        width *= 4
    right = _TOKEN.search(text, end)
    return [_word(w) for w in left[-2:]], _word(right.group()) if right else ""


def _kind_of_word(word: str) -> str:
    return word if word in ("", "=", ":", "#") else "w"


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns in whose place a span stands; those of words alone come first."""
    left, right = _around(text, start, end)
    last, form = left[-1] if left else "", shape(text[start:end])
    out = [f"2|{left[0]} {last}"] if len(left) == 2 and "#" not in left else []
    if last and right and "#" not in (last, right):
        out.append(f"r|{last} {right}")
    if form != "a" and not all(c in "a -" for c in form):
        out += [f"w|{last}|{form}", f"k|{_kind_of_word(last)}|{form}", f"s|{form}"]
    return out


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Places with a digit or @: tokens without the marks around them, and runs of up to SLOT neighbours."""
    row: list[tuple[int, int]] = []
    done = 0
    for m in _ANY.finditer(text):
        start = m.start()
        if start < done:
            continue
        end = done = _TOKEN.match(text, start).end()
        while start and text[start - 1] not in _BREAKS and not text[start - 1].isspace():
            start -= 1
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if row and (start - row[-1][1] > 3 or _TOKEN.search(text, row[-1][1], start)):
            row = []
        row = [*row[1 - SLOT :], (start, end)]
        for first, _ in row:
            yield first, end


def _rejected(value: str) -> str | None:
    """!kind for what has the form of a kind but fails its check."""
    if any((a, b) == (0, len(value)) for a, b, _ in base_spans(value)):
        return None
    if _IP.fullmatch(value):
        return "!ip"
    if _CARD.fullmatch(value) and 14 <= len(value.replace(" ", "").replace("-", "")) <= 19:
        return "!card"
    return "!phone" if _PHONE.fullmatch(value) else None


class Lexicon:
    """Patterns as a worker looks for them: words before or around a place, and the rest."""

    def __init__(self, patterns):
        self.all = patterns
        pair = lambda p: tuple(p[2:].split(" ", 1))
        self.two = frozenset(pair(p) for p in patterns if p[0] == "2")
        self.around = frozenset(pair(p) for p in patterns if p[0] == "r")
        self.pairs = [*self.two, *self.around]

    def _words(self, text: str) -> list[str] | None:
        """The words of a text in which a pattern of words alone may stand."""
        if not self.pairs:
            return None
        low = text.lower()
        if len(self.pairs) <= 200 and not any(a in low and b in low for a, b in self.pairs):
            return None
        return [w.strip(_EDGE) or w for w in _TOKEN.findall(low)]

    def places(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(first word, last word, pattern) of places of plain words in patterns of words alone."""
        out = []
        if self.two:
            two = self.two
            out += [(i + 2, i + 2, f"2|{x[0]} {x[1]}") for i, x in enumerate(zip(words, words[1:], strict=False)) if x in two and i + 2 < len(words)]
        if self.around:
            around = self.around
            for n in range(1, PLAIN + 1):
                out += [(i + 1, i + n, f"r|{x[0]} {x[1]}") for i, x in enumerate(zip(words, words[n + 1 :], strict=False)) if x in around]
        return [x for x in out if not any(w in "=:" or _ANY.search(w) for w in words[x[0] : x[1] + 1])]

    def counts(self, text: str) -> list[str]:
        """The patterns of words alone, once for every place of plain words."""
        words = self._words(text)
        return [p for _, _, p in self.places(words)] if words else []

    def plain(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of plain words that stand in a pattern of words alone."""
        words = self._words(text)
        found = {x[:2] for x in self.places(words)} if words else ()
        if not found:
            return
        spans = [m.span() for m in _TOKEN.finditer(text)]
        if len(spans) != len(words):  # lower case has other characters
            return
        for i, j in found:
            start, end = spans[i][0], spans[j][1]
            while start < end and text[start] in _EDGE:
                start += 1
            while end > start and text[end - 1] in _EDGE:
                end -= 1
            if start < end:
                yield start, end

    def of(self, text: str, start: int, end: int) -> list[str]:
        """The lexicon's patterns at a place; two words before it say something of one token only."""
        found = [p for p in patterns_of(text, start, end) if p in self.all]
        return [p for p in found if p[0] != "2" or not _TOKEN.match(text, start) or _TOKEN.match(text, start).end() >= end]


def seeds(text: str | None, holdout: int = 0) -> list[Span]:
    """Base spans and secrets outside them; with a holdout, without those that hidden() names."""
    if not text:
        return []
    base = base_spans(text)
    out = base + _outside(secret_spans(text), base)
    return [x for x in out if not (holdout and hidden(text[x[0] : x[1]], holdout))]


def hidden(value: str, holdout: int) -> bool:
    """Whether a value belongs to the share of 1 / holdout that is not a seed when recall is measured."""
    return zlib.crc32(value.encode("utf-8", "replace")) % holdout == 0


def _outside(spans: list[Span], taken: list[Span]) -> list[Span]:
    """spans that overlap none of taken, both by start."""
    out, k, far = [], 0, -1
    for x in sorted(spans):
        while k < len(taken) and taken[k][0] < x[1]:
            far, k = max(far, taken[k][1]), k + 1
        if far <= x[0]:
            out.append(x)
    return out


def _flat(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]


_EDGES = "pattern string, value string, kind string, n long"


def _seed_edges(texts: DataFrame, holdout: int) -> DataFrame:
    """Patterns around the seeds."""

    def start():
        def step(columns):
            found = Counter((p, t[a:b], k) for t in columns[0] if t for a, b, k in seeds(t, holdout) for p in patterns_of(t, a, b))
            return _flat([(*x, n) for x, n in found.items()], 4)

        return step

    return map_batches(texts, start, _EDGES)


def _value_edges(texts: DataFrame, values: dict[str, str]) -> DataFrame:
    """Patterns around the places where given values stand."""
    sent = texts.sparkSession.sparkContext.broadcast(values)

    def start():
        heads = {_TOKEN.search(v).group() for v in sent.value if not _ANY.search(v)}  # of values of plain words

        def step(columns):
            found = Counter()
            for t in columns[0]:
                places = [m.span() for m in _TOKEN.finditer(t)] if t and heads else []
                inside = ((a, b) for i, (a, e) in enumerate(places) if t[a:e].strip(_EDGE) in heads for _, b in places[i : i + PLAIN])
                trimmed = ((a, b - len(t[a:b]) + len(t[a:b].rstrip(_EDGE))) for a, b in inside)
                for a, b in set(chain(_marked(t or ""), trimmed)):
                    kind = sent.value.get(t[a:b])
                    if kind:
                        found.update((p, t[a:b], kind) for p in patterns_of(t, a, b))
            return _flat([(*x, n) for x, n in found.items()], 4)

        return step

    return map_batches(texts, start, _EDGES)


def _instance_edges(texts: DataFrame, patterns: list[str], holdout: int, plain: bool) -> DataFrame:
    """What stands in the place of given patterns: values with a digit or @, of other words their number, or
    (plain) those words themselves."""
    sent = texts.sparkSession.sparkContext.broadcast(frozenset(patterns))

    def start():
        lexicon = Lexicon(sent.value)

        def step(columns):
            found = Counter()
            for t in columns[0]:
                if not t:
                    continue
                known = sorted(seeds(t, holdout))
                if plain:
                    free = _outside([(a, b, "") for a, b in lexicon.plain(t)], known)
                    found.update((p, t[a:b], None) for a, b, _ in free for p in lexicon.of(t, a, b))
                    continue
                found.update((p, t[a:b], k) for a, b, k in known for p in lexicon.of(t, a, b))
                free = _outside([(a, b, "") for a, b in _marked(t)], known)
                found.update((p, t[a:b], _rejected(t[a:b])) for a, b, _ in free for p in lexicon.of(t, a, b))
                found.update((p, None, None) for p in lexicon.counts(t))
            return _flat([(*x, n) for x, n in found.items()], 4)

        return step

    return map_batches(texts, start, _EDGES)


def _blocks(rows: DataFrame, by: str) -> Iterator[list]:
    """The rows in blocks of about MAX_PATTERNS, each on the driver in turn."""
    parts = -(-rows.count() // MAX_PATTERNS)
    for k in range(parts):
        yield rows.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k).collect()


def _merged(tables: list[DataFrame], name: str) -> DataFrame | None:
    """Edge tables as one, an edge once; None if there are none."""
    if not tables:
        return None
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return write_few(every.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), name)


def _scored(graph: DataFrame) -> DataFrame:
    """(pattern, of, conf) from graph (pattern, of, value, fixed): fixed is 1 for a seed of the pattern's kind, 0
    for what is known to be something else, null for the rest."""
    scores = graph.select("pattern", "of", "value", "fixed", F.coalesce("fixed", F.lit(0.0)).alias("score"))
    for _ in range(STEPS):
        sums = scores.groupBy("pattern", "of").agg(F.sum("score").alias("total"), F.count("*").alias("m"))
        # what a pattern says of an instance is the mean of its other instances
        seen = scores.join(sums, ["pattern", "of"]).withColumn("says", (F.col("total") - F.col("score")) / (F.col("m") - 1 + PRIOR))
        votes = seen.groupBy("value", "of").agg(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("says")))).alias("doubt"))
        scores = graph.join(votes, ["value", "of"]).select("pattern", "of", "value", "fixed", F.coalesce("fixed", DOUBT * (1 - F.exp("doubt"))).alias("score"))
    return scores.groupBy("pattern", "of").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("conf"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, holdout: int = 0) -> Accepted:
    """Accepted patterns -> (kind, confidence); beyond MAX_PATTERNS of them a table (pattern, of, conf).

    A pattern needs LEAST_SEEDS different seeds, of all that stands in its place LEAST_SHARE must be
    seeds at first, and in the end its confidence must reach LEAST_SCORE.  Rounds end when nothing
    new is promoted.  Null and empty texts say nothing, repeated rows no more than one, and an empty
    table gives no patterns.  With a holdout, that share of the seeds is hidden, to be found back.
    """
    spark, texts = docs.sparkSession, docs.select(F.col(text_col)).where(F.col(text_col).isNotNull())
    seen_edges = [_merged([_seed_edges(texts, holdout)], "seed-edges")]
    promoted = spark.createDataFrame([], "value string, of string")
    tried = spark.createDataFrame([], "pattern string")
    instances: list[DataFrame] = []
    accepted, last = None, 0
    for _ in range(rounds):
        around = _merged(seen_edges, "edges")
        votes = around.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum("n").alias("n"))
        most = Window.partitionBy("pattern").orderBy(F.desc("seeds"), "kind")  # one kind a pattern
        kept = votes.where(F.col("seeds") >= LEAST_SEEDS).withColumn("nr", F.row_number().over(most)).where("nr = 1")
        kept = write_few(kept.select("pattern", F.col("kind").alias("of"), "n"), "patterns")
        new = write_few(kept.select("pattern").join(tried, "pattern", "left_anti"), "new-patterns")
        for block in _blocks(new, "pattern"):
            found = _merged([_instance_edges(texts, [r[0] for r in block], holdout, plain=False)], "instances")
            instances.append(found.where("value is not null"))
            # patterns of words alone that mostly hold other words go before those are listed
            words = found.where("value is null").select("pattern", F.col("n").alias("others"))
            fair = words.join(kept, "pattern").where(F.col("n") >= LEAST_SHARE * (F.col("n") + F.col("others"))).select("pattern")
            for some in _blocks(write_few(fair, "fair"), "pattern"):
                instances.append(_merged([_instance_edges(texts, [r[0] for r in some], holdout, plain=True)], "words"))
            poor = words.select("pattern").join(fair, "pattern", "left_anti").select("pattern", F.lit(None).cast("string").alias("value"), F.lit("!").alias("kind"), F.lit(0).cast("long").alias("n"))
            instances.append(write_few(poor, "poor"))
        tried = kept.select("pattern").unionByName(tried).distinct()
        every = _merged(instances, "graph-edges") if instances else None
        if every is None:
            break
        usable = kept.join(every.where("kind = '!'").select("pattern"), "pattern", "left_anti")
        graph = every.where("value is not null").join(usable.select("pattern", "of"), "pattern").join(promoted.select("value", F.col("of").alias("now")), "value", "left")
        known = F.coalesce("kind", "now")
        graph = write_few(graph.select("pattern", "of", "value", F.when(known == F.col("of"), 1.0).when(known.isNotNull(), 0.0).alias("fixed"), (F.col("kind").isNull()).alias("unknown")), "graph")
        accepted = write_few(_scored(graph).where(F.col("conf") >= LEAST_SCORE), "accepted")
        best = Window.partitionBy("value").orderBy(F.desc("conf"), "of", "pattern")
        fresh_values = graph.where("unknown").join(accepted, ["pattern", "of"]).withColumn("nr", F.row_number().over(best)).where("nr = 1").select("value", "of")
        promoted, before = write_few(fresh_values, "promoted"), promoted
        count = promoted.count()
        if count <= last:
            break
        for block in _blocks(promoted.join(before, "value", "left_anti"), "value"):
            seen_edges.append(write_few(_value_edges(texts, {r[0]: r[1] for r in block}), "value-edges"))
        last = count
    if accepted is None:
        return {}
    if accepted.count() > MAX_PATTERNS:
        return accepted
    return {r[0]: (r[1], r[2]) for r in accepted.select("pattern", "of", "conf").collect()}


def _lookup(docs: DataFrame, accepted: Accepted, text_col: str) -> tuple[DataFrame, Callable[[list], list[Lexicon]]]:
    """docs with the accepted patterns of each text as a last column, or null where all are broadcast, and what
    makes a lexicon for each row of that column."""
    name = fresh(docs, "accepted")
    if isinstance(accepted, dict):
        sent, kept = docs.sparkSession.sparkContext.broadcast(accepted), []

        def shared(column: list) -> list[Lexicon]:
            if not kept:
                kept.append(Lexicon(sent.value))
            return kept * len(column)

        return docs.withColumn(name, F.lit(None).cast("array<struct<pattern:string,of:string,conf:double>>")), shared

    def start():
        def step(columns):
            rows = []
            for key, t in zip(*columns, strict=True):
                if t:
                    words = [_word(w) for w in _TOKEN.findall(t)]
                    every = {f"2|{a} {b}" for a, b in zip(words, words[1:], strict=False)}
                    every |= {f"r|{a} {b}" for k in range(2, SLOT + 2) for a, b in zip(words, words[k:], strict=False)}
                    every |= {p for a, b in _marked(t) for p in patterns_of(t, a, b)}
                    rows += [(key, p) for p in every]
            return _flat(rows, 2)

        return step

    # by the text: ids may be missing or shared
    key = fresh(docs, "key")
    sha = F.sha2(F.col(text_col), 256)
    used = map_batches(docs.select(sha, F.col(text_col)), start, "key string, pattern string").distinct()
    own = used.join(accepted, "pattern").groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("pattern", "of", "conf")).alias(name))
    joined = docs.withColumn(key, sha).join(write_few(own, "used"), key, "left").select(*docs.columns, name)
    return joined, lambda column: [Lexicon({x["pattern"]: (x["of"], x["conf"]) for x in found or ()}) for found in column]


def all_spans(text: str | None, accepted: Lexicon | dict, holdout: int = 0) -> list[Span]:
    """Base spans, secrets and what accepted patterns mark outside them: of overlapping places the surest, then
    the longest."""
    if not text:
        return []
    lexicon = accepted if isinstance(accepted, Lexicon) else Lexicon(accepted)
    known = sorted(seeds(text, holdout))
    order = {k: i for i, k in enumerate((*KINDS, SEEDED))}
    found = []
    if lexicon.all:
        places = _outside([(a, b, "") for a, b in {*_marked(text), *lexicon.plain(text)}], known)
        for a, b, _ in places:
            votes = [lexicon.all[p] for p in lexicon.of(text, a, b)]
            if votes and _rejected(text[a:b]) is None:
                kind, conf = max(votes, key=lambda v: (v[1], v[0]))
                found.append((-conf, a - b, a, b, kind))
    taken: list[Span] = []
    for _, _, a, b, kind in sorted(found):
        if all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, kind))
    return sorted({*known, *taken}, key=lambda s: (s[0], order[s[2]], s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def report(docs: DataFrame, accepted: Accepted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans.

    n_found counts spans that are not base ones, n_spans all.  A null or empty text has no spans (base_sha256 of
    the empty string).  Repeated rows are reported alike; an empty table gives no rows; other
    columns are not read.
    """
    rows, patterns = _lookup(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)), accepted, text_col)

    def start():
        def step(columns):
            ids, texts, found = columns
            base = [base_spans(t) for t in texts]
            every = [all_spans(t, a) for t, a in zip(texts, patterns(found), strict=True)]
            counts = [[sum(k == kind for _, _, k in b) for b in base] for kind in KINDS]
            digest = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
            return [ids, *counts, digest, [_joined(s) for s in every], [len(s) - len(b) for s, b in zip(every, base, strict=True)], list(map(len, every))]

        return step

    schema = f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long, n_spans long"
    return map_batches(rows, start, schema)


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span as <kind>; of overlapping spans the first, and of those the longest."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
        elif e > at:  # the rest of an overlapping span goes too
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, accepted: Accepted, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with spans masked in text_col, and length_col, where there is one, set to match.

    Null and empty texts and those without spans stay as they are; repeated rows are masked alike;
    an empty table gives no rows.
    """
    rows, patterns = _lookup(docs, accepted, text_col)
    names = docs.columns
    place, size = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch.column(place).to_pylist()
            found = patterns(batch.column(len(names)).to_pylist())
            new = [mask(t, all_spans(t, a)) for t, a in zip(old, found, strict=True)]
            columns = list(batch.columns)[: len(names)]
            columns[place] = pa.array(new, type=columns[place].type)
            if size is not None:
                n = [len(b) if b is not None and b != a else c for a, b, c in zip(old, new, columns[size].to_pylist(), strict=True)]
                columns[size] = pa.array(n, type=columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[: len(names)]))

    return rows.mapInArrow(in_worker(run), docs.schema)


def found_back(docs: DataFrame, holdout: int, text_col: str = "text") -> DataFrame:
    """What patterns learned without a share of the seeds find of it: kind, hidden, found, wrong.

    hidden counts the places of base entities and secrets whose value is hidden, found those that a
    pattern marks with their bounds and kind, wrong the marked places that are no entity at all.
    """
    rows, patterns = _lookup(docs.select(F.col(text_col)), learn(docs, text_col=text_col, holdout=holdout), text_col)

    def start():
        def step(columns):
            found = Counter()
            for t, lexicon in zip(columns[0], patterns(columns[1]), strict=True):
                every = set(seeds(t))
                kept = set(seeds(t, holdout))
                new = set(all_spans(t, lexicon, holdout)) - kept
                found.update((k, "hidden") for _, _, k in every - kept)
                found.update((k, "found" if (a, b, k) in every else "wrong") for a, b, k in new)
            return _flat([(*x, n) for x, n in found.items()], 3)

        return step

    counts = map_batches(rows, start, "kind string, what string, n long")
    return counts.groupBy("kind").pivot("what", ["hidden", "found", "wrong"]).agg(F.sum("n")).na.fill(0)
