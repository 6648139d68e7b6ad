"""The rule classifier, classifier chains, embedder routing and curation scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import uri_extension

# Paths, formats, suffixes and limits of the rules
CHAT_SCHEMES = ["claude-code://", "opencode://", "gemini-cli://"]
PAPER_PATHS, NOTE_PATHS = ["/papers/", "/research/"], ["/notes/", "/daily/", "/journal/"]
ARTICLE_PATHS, REFERENCE_PATHS = ["/blog/", "/posts/", "/articles/"], ["/docs/", "/reference/", "/api/"]
REFERENCE_FORMATS = ["json", "yaml", "toml", "csv", "srt"]
NOTE_SUFFIXES = [".md", ".markdown", ".rst", ".txt", ".tex"]
REFERENCE_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".csv", ".tsv", ".srt", ".vtt"]
ARTICLE_SUFFIXES = [".ipynb", ".docx", ".pptx", ".xlsx", ".odt", ".ods"]
PEDAGOGY = r"(?i)\b(textbook|primer|introduction to|course|handbook|cookbook|tutorial|exercises?|lectures?)\b"
CHAT_MARKER = "(?m)^(User|Assistant|Human):"
MARKERS, MARKERS_PER_KB, PAGE_CHARS, BOOK_PAGES, TEXTBOOK_PAGES = 3, 3.0, 3000, 50, 8
CURATION_4 = {"confidence_deficit": 0.35, "missing_metadata": 0.30, "ranker_elevation": 0.25, "freshness": 0.10}
CURATION_5 = {"confidence_deficit": 0.30, "missing_metadata": 0.25, "ranker_elevation": 0.20, "freshness": 0.10, "learned_quality": 0.15}
PRUNE = {"confidence_deficit": 0.20, "missing_metadata": 0.20, "freshness_inverted": 0.15, "duplicate_density": 0.25, "feedback_drag": 0.20}


def rule_class(uri: Column, fmt: Column, title: Column, text: Column) -> Column:
    """struct<value, confidence, rationale> of the first rule that fits."""
    low, t = F.lower(uri), F.coalesce(text, F.lit(""))
    said = lambda value, confidence, why: F.struct(F.lit(value).alias("value"), F.lit(confidence).alias("confidence"), (F.lit(why) if isinstance(why, str) else why).alias("rationale"))
    any_of = lambda test, items: reduce(lambda a, b: a | b, [test(x) for x in items])
    f = F.coalesce(fmt, F.lit(""))
    taught = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), uri).rlike(PEDAGOGY)
    markers = F.regexp_count(t, F.lit(CHAT_MARKER))
    chatty = (markers >= MARKERS) & (markers / F.greatest(F.lit(1.0), F.octet_length(t) / 1024.0) >= MARKERS_PER_KB)
    pages = F.greatest(F.lit(1), F.floor(F.length(t) / PAGE_CHARS)).cast("long")
    counted = lambda a, b: F.concat(F.lit(a), pages.cast("string"), F.lit(b))
    paper = t.rlike(r"(?m)^Abstract\b") & t.rlike(r"\bReferences\b") & t.rlike(r"\[[0-9]+\]")
    name = F.regexp_extract(low, "([^/]*)$", 1)
    ext = uri_extension(uri)
    fallback = lambda value, c: said(value, c, F.concat(F.lit("extension fallback: "), ext))
    return (
        F.when(f == "code", said("code", 0.99, "format=code"))
        .when(any_of(uri.startswith, CHAT_SCHEMES) | (f == "conversation"), said("chat", 0.99, "chat URI scheme or format=conversation"))
        .when((f == "epub") & taught, said("textbook", 0.85, "format=epub + pedagogy regex"))
        .when(f == "epub", said("book", 0.7, "format=epub"))
        .when(any_of(low.contains, [*PAPER_PATHS, "/arxiv-"]) | name.startswith("arxiv-") | low.endswith(".bib"), said("paper", 0.7, "path/filename hint: papers/arxiv/.bib"))
        .when(any_of(low.contains, NOTE_PATHS), said("note", 0.8, "path hint: notes/daily/journal"))
        .when(any_of(low.contains, ARTICLE_PATHS), said("article", 0.7, "path hint: blog/posts/articles"))
        .when(any_of(low.contains, REFERENCE_PATHS), said("reference", 0.7, "path hint: docs/reference/api"))
        .when(f.isin(REFERENCE_FORMATS), said("reference", 0.9, F.concat(F.lit("format="), f)))
        .when(chatty, said("chat", 0.85, "chat markers in body"))
        .when((f == "pdf") & paper, said("paper", 0.75, "PDF: Abstract+References+[n] citations"))
        .when((f == "pdf") & (pages >= BOOK_PAGES), said("book", 0.55, counted("PDF: long (", "p)")))
        .when((f == "pdf") & (pages >= TEXTBOOK_PAGES) & taught, said("textbook", 0.45, counted("PDF: medium (", "p) + pedagogy")))
        .when((f == "pdf") & (pages >= TEXTBOOK_PAGES), said("book", 0.45, counted("PDF: medium (", "p), no pedagogy")))
        .when(f == "pdf", said("article", 0.5, counted("PDF: short (", "p)")))
        .when(f == "html", said("article", 0.5, "format=html"))
        .when(f == "markdown", said("note", 0.5, "markdown default"))
        .when(ext.isin(NOTE_SUFFIXES), fallback("note", 0.5))
        .when(ext.isin(REFERENCE_SUFFIXES), fallback("reference", 0.7))
        .when(ext.isin(ARTICLE_SUFFIXES), fallback("article", 0.45))
        .otherwise(said("other", 0.3, "no rule matched"))
    )


def first_confident(candidates: list[Column], threshold: float = 0.4) -> Column:
    """The first class of at least the threshold, else the last that is there."""
    every = F.filter(F.array(*candidates), lambda c: c.isNotNull())
    good = F.filter(every, lambda c: c["confidence"] >= threshold)
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.try_element_at(every, F.lit(-1)))


def route(ext: Column, lanes: list[tuple[str, list[str]]]) -> Column:
    """The first lane whose suffixes hold ext, else the first without suffixes, else null."""
    special = [F.when(ext.isin(x), name) for name, x in lanes if x]
    rest = [F.lit(name) for name, x in lanes if not x][:1]
    return F.coalesce(*special, *rest, F.lit(None).cast("string"))


def confidence_deficit(c: Column) -> Column:
    return F.coalesce(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.lit(1.0))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The clamped weighted sum; the weights must add up to 1 and name the same parts."""
    if set(parts) != set(weights) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights and parts differ, or the weights do not add up to 1")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))))


def curation_score(parts: dict[str, Column], learned: Column) -> Column:
    """Five weights where a learned quality is there, four elsewhere."""
    return F.when(learned.isNotNull(), weighted(parts | {"learned_quality": F.coalesce(learned, F.lit(0.0))}, CURATION_5)).otherwise(weighted(parts, CURATION_4))


def top_part(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The name of the greatest weighted part; the first named of equal ones."""
    best = F.greatest(*[parts[k] * weights[k] for k in parts])
    return F.coalesce(*[F.when(parts[k] * weights[k] == best, k) for k in parts])
