"""Column functions over text: hashes, counts, quality signals, redaction, tokens. No Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, quality bands, redaction patterns
SPACE = "[ \\t\\n\\r\\f\\x0B]"
TOKEN_BAND = (0.65, 0.92)
PUNCTUATION_CEILING = 0.25
LOW_QUALITY = 0.45
SHORT_TEXT, LONG_TEXT = 100, 5000
REDACTED = "«redacted»"
SECRET_PATTERNS = [
    r"(?i)(?:postgres(?:ql)?|mysql|mongodb|redis)(?:\+[A-Za-z0-9_]+)?://[^/ \t\n\r@]+@[^ \t\n\r]+",
    r"sk-[A-Za-z0-9_\-]{16,}",
    r"xai-[A-Za-z0-9_\-]{16,}",
    r"claude-[A-Za-z0-9_\-]{16,}",
    r"Bearer[ \t\n\r]+[A-Za-z0-9_.\-]+",
    r"""(?i)(api[_-]?key|password|secret)[ \t\n\r]*[=:][ \t\n\r]*["']?([^ \t\n\r"']+)["']?""",
]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def lock_key(text: Column) -> Column:
    """The first 64 bits of the MD5 as a non-negative 31-bit number."""
    return (F.conv(F.substring(F.md5(text), 9, 8), 16, 10).cast("long") % F.lit(2**31)).cast("long")


def cluster_id(ids: Column) -> Column:
    """Stable name of a group from its sorted ids."""
    return F.concat(F.lit("ndc_"), F.substring(F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256), 1, 16))


def token_count(text: Column, known: Column | None = None) -> Column:
    """The stored count, else a quarter of the length, one at least; none for empty text."""
    guess = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4)))
    return (guess if known is None else F.coalesce(known, guess)).cast("long")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, SPACE, "")) == 0, F.lit(True))


def token_rate(text: Column) -> Column:
    """1 while the share of visible characters is in its band, falling off linearly outside."""
    return in_band(F.length(F.regexp_replace(text, SPACE, "")) / F.length(text))


def in_band(r: Column) -> Column:
    low, high = TOKEN_BAND
    return F.when(r < low, r / low).when(r > high, F.greatest(F.lit(0.0), 1 - (r - high) / (1 - high))).otherwise(1.0)


def punctuation_balance(text: Column) -> Column:
    return below_ceiling(F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")) / F.length(text))


def below_ceiling(d: Column) -> Column:
    c = PUNCTUATION_CEILING
    return F.when(d <= c, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (d - c) / (1 - c)))


def shouting(text: Column) -> Column:
    return calm(F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]")))


def calm(letters: Column, capitals: Column) -> Column:
    return F.when(letters == 0, 1.0).otherwise(1 - capitals / letters)


def adequacy(text: Column, has_label: Column, n_metadata: Column) -> Column:
    """Length band, label and metadata as one score in [0, 1]; blank text scores 0."""
    n = F.length(text)
    size = F.when(n < SHORT_TEXT, 0.0).when(n > LONG_TEXT, 0.5).otherwise(1.0)
    total = 0.6 * size + 0.2 * has_label.cast("int") + 0.2 * F.least(F.lit(1.0), n_metadata / 3)
    return F.when(is_blank(text), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def redact(text: Column) -> tuple[Column, Column]:
    """The text with every secret replaced, pattern by pattern, and how many there were."""
    count, out = F.lit(0), text
    for p in SECRET_PATTERNS:
        count = count + F.regexp_count(out, F.lit(p))
        out = F.regexp_replace(out, p, REDACTED)
    return out, count.cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, width: int = 4) -> Column:
    """Distinct runs of `width` words; a shorter text is one run, an empty one none."""

    def runs(w):
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - width + 1)), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= width, F.array(F.array_join(w, " "))).otherwise(many)

    return F.array_distinct(let(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), runs))


def is_symbol_shaped(q: Column) -> Column:
    """Accessors, CamelCase, snake_case and _private names without white space."""
    plain = q.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    shaped = q.startswith("_") | F.substring(q, 2, 1 << 20).rlike("[A-Z]") | q.contains("_")
    access = reduce(lambda a, b: a | b, [q.contains(x) for x in ("::", "->", ".", "/")])
    return F.coalesce(~is_blank(q) & ~q.rlike(SPACE) & (access | (plain & shaped)), F.lit(False))


def query_tokens(q: Column, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(q, F.lit("([A-Za-z0-9_]+)"), 1), lambda w: F.length(w) >= least)


def uri_extension(uri: Column) -> Column:
    """Lower-cased last suffix of the last path part, '' for none and for dotfiles."""
    name = F.regexp_extract(F.regexp_replace(uri, "[?#].*$", ""), "([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def excerpt(text: Column, budget: int) -> Column:
    """Head and tail of a text longer than the budget."""
    half = budget // 2
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.substring(text, -half, half)))


def cloud_duplicate(name: Column) -> Column:
    """struct(provider, canonical) of a sync service's conflict copy, else nulls."""
    dotted = name.rlike(r"^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    suffix = F.when(dotted, F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)).otherwise("")
    rules = [
        ("gdrive", r"^(.+?)(?: \(1\)|-conflict-[A-Za-z0-9_-]+-[0-9]+)$"),
        ("dropbox", r"^(.+?) \(.*'s conflicted copy .*\)$"),
        ("finder", r"^(.+?) copy(?: ([0-9]+))?$"),
        ("icloud", r"^(.+?)(?: ([0-9]+)| \(([0-9]+)\))$"),
    ]
    hits = [F.when(stem.rlike(p), F.struct(F.lit(k).alias("provider"), F.concat(F.regexp_extract(stem, p, 1), suffix).alias("canonical"))) for k, p in rules]
    return F.coalesce(*hits)


def percent_of_hash(hash_text: Column) -> Column:
    """The SHA-256 of a string as a number, modulo 100."""
    digits = F.transform(F.slice(F.split(F.sha2(hash_text, 256), "(?!^)"), 1, 64), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % 100)
