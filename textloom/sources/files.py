"""Files to text: ignore rules, extractors by suffix, and a folder scan."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form", "svg", "template"}
BLOCKS = {"p", "div", "section", "article", "br", "li", "tr", "table", "ul", "ol", "blockquote", "pre", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
CSV_ROWS = 200
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".rb": "ruby", ".sh": "bash", ".sql": "sql", ".scala": "scala"}


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.title, self.in_title = [], 0, "", False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in SKIPPED:
            self.skip += 1
        elif not self.skip and tag in BLOCKS:
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else ""))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str | None) -> tuple[str, str]:
    """(title, text) without navigation and scripts, headings and list items in Markdown."""
    p = _Html()
    p.feed(html or "")
    p.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))
    return p.title.strip(), re.sub(r"\n{3,}", "\n\n", text).strip()


def csv_text(text: str, delimiter: str = ",") -> str:
    """A Markdown table of at most CSV_ROWS rows; the rest is counted."""
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |"
    more = len(rows) - 1 - CSV_ROWS
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1 : CSV_ROWS + 1]), *([f"... {more} more rows"] if more > 0 else [])])


def structured_text(text: str, kind: str) -> str:
    """A fenced block, indented again where it parses."""
    try:
        shown = json.dumps(json.loads(text), indent=2, ensure_ascii=False) if kind == "json" else text
        if kind == "toml":
            tomllib.loads(text)
    except ValueError:
        shown = text
    return f"```{kind}\n{shown.rstrip()}\n```"


def subtitle_text(text: str) -> str:
    """Spoken lines: no header, cue numbers or times; runs of blank lines become one."""
    lines = [ln.strip() for ln in text.lstrip("\ufeff").splitlines()]
    kept = [ln for k, ln in enumerate(lines) if not (ln.isdigit() or "-->" in ln or (k == 0 and ln.startswith("WEBVTT")))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def notebook_text(text: str) -> str:
    """Cells in order, code fenced in the kernel's language, outputs left out."""
    try:
        book = json.loads(text)
    except ValueError:
        return text
    lang = (book.get("metadata", {}).get("kernelspec") or {}).get("language", "python")
    cells = [(c.get("cell_type"), "".join(s) if isinstance(s := c.get("source", ""), list) else s) for c in book.get("cells", [])]
    return "\n\n".join(f"```{lang}\n{s}\n```" if kind == "code" else s for kind, s in cells if s.strip())


def first_heading(text: str) -> str:
    m = re.search(r"(?m)^\s*#+\s*(\S.*)$", text)
    return m.group(1).strip() if m else next((ln.strip(" #*_-") for ln in text.splitlines() if ln.strip()), "")


EXTRACTORS: dict[str, Callable[[str], str]] = {
    ".html": lambda t: html_text(t)[1], ".htm": lambda t: html_text(t)[1], ".csv": csv_text, ".tsv": lambda t: csv_text(t, "\t"), ".json": lambda t: structured_text(t, "json"), ".toml": lambda t: structured_text(t, "toml"),
    ".yaml": lambda t: structured_text(t, "yaml"), ".yml": lambda t: structured_text(t, "yaml"), ".srt": subtitle_text, ".vtt": subtitle_text, ".ipynb": notebook_text,
}


def extract(name: str, text: str) -> tuple[str, str, str]:
    """(text, title, language) by the suffix of a file name; unknown ones pass through."""
    ext = re.sub(r"^.*?(\.[^./]*)?$", lambda m: m.group(1) or "", name.rsplit("/", 1)[-1]).lower()
    ext = "." + name.rsplit("/", 1)[-1].rsplit(".", 1)[1].lower() if "." in name.rsplit("/", 1)[-1].lstrip(".") else ext
    out = EXTRACTORS.get(ext, lambda t: t)(text)
    title = html_text(text)[0] if ext in (".html", ".htm") else first_heading(out)
    return out, title, LANGUAGES.get(ext, "")


class IgnoreRules:
    """A subset of gitignore: the last rule that fits decides, ! takes back, a final / means folders only."""

    def __init__(self, lines: list[str]):
        self.rules = [self._compile(ln.rstrip()) for ln in lines if ln.strip() and not ln.startswith("#")]

    @staticmethod
    def _compile(line: str) -> tuple[re.Pattern, bool, bool]:
        negated, line = line.startswith("!"), line.lstrip("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body, k = "", 0
        while k < len(line):
            if line.startswith("**/", k):
                body, k = body + "(?:.*/)?", k + 3
            elif line.startswith("**", k):
                body, k = body + ".*", k + 2
            else:
                c = line[k]
                body, k = body + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), k + 1
        return re.compile(("^" if anchored else "^(?:.*/)?") + body + "(?P<rest>/.*)?$"), negated, folder

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        verdict = False
        for pattern, negated, folder in self.rules:
            m = pattern.match(path)
            if m and (not folder or is_dir or m.group("rest")):
                verdict = not negated
        return verdict


def scan(spark: SparkSession, folder: str, ignore: list[str] | None = None, scheme: str = "filesystem") -> DataFrame:
    """Documents of a folder: source_uri, title, text, language, content_hash, modified_at.

    Spark lists the files and reads them in parallel; ignore rules see paths below the folder.
    """
    rules, root = IgnoreRules(ignore or []), folder.rstrip("/")
    rel = F.regexp_extract(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^(?:file:/*)?/*" + re.escape(root.split("://")[-1].lstrip("/")) + "/(.*)$", 1)
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(rel.alias("rel"), F.col("_metadata.file_modification_time").alias("modified_at"), "value")

    schema = "rel string, modified_at timestamp, text string, title string, language string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array([not rules.ignored(p) for p in batch.column("rel").to_pylist()], pa.bool_()))
            out = [extract(p, t or "") for p, t in zip(batch.column("rel").to_pylist(), batch.column("value").to_pylist(), strict=True)]
            parts = [pa.array([o[k] for o in out], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("rel"), batch.column("modified_at"), *parts], names=["rel", "modified_at", "text", "title", "language"])

    docs = files.mapInArrow(run, schema)
    return docs.select(F.concat(F.lit(f"{scheme}://{root}/"), "rel").alias("source_uri"), "title", "text", "language", F.sha2("text", 256).alias("content_hash"), "modified_at")


def extract_html(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, text) of web pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [html_text(h) for h in f.iloc[:, 1]]
            yield pd.DataFrame({"id": f.iloc[:, 0].to_numpy(), "title": [o[0] for o in out], "text": [o[1] for o in out]})

    return pages.select(F.col(id_col).cast("long"), html_col).mapInPandas(run, "id long, title string, text string").withColumnRenamed("id", id_col)
