"""Column functions over names, settings, model output and times. No Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of secrets, time units, a served model's prefix, classes, what stands for unreadable output
SECRET_NAMES = "dsn|password|api[_-]?key|secret|token"
UNIT_SECONDS = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
MODEL_PREFIX = "text-embedding-"
CLASSES = ["code", "chat", "book", "textbook", "paper", "article", "reference", "note", "other"]
UNREADABLE = "invalid LLM output"
SNIPPET = 120


def is_secret_name(name: Column) -> Column:
    """Whether a setting's name says that its value is secret."""
    return F.coalesce(F.lower(name).rlike(SECRET_NAMES), F.lit(False))


def boost_tokens(query: Column) -> Column:
    """Distinct lower-cased identifiers of a query, none for null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), "[^A-Za-z0-9_]+"), lambda w: w != ""))


def conflict_name(name: Column, host: Column, at: Column, provider: Column | None = None) -> Column:
    """stem.conflict-[provider-]host-time.suffix of a file's name; at is in UTC."""
    dotted = name.rlike(r"^.+\.[^.]+$")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    suffix = F.when(dotted, F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).otherwise("")
    who = F.lit("") if provider is None else F.when(F.coalesce(provider, F.lit("")) != "", F.concat(provider, F.lit("-"))).otherwise("")
    return F.concat(stem, F.lit(".conflict-"), who, host, F.lit("-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), suffix)


def duration_text(seconds: Column) -> Column:
    """Whole seconds as Zs, Ym Zs, Xh Ym or Xd Yh; a dash for negative and non-finite ones."""
    n = F.bround(seconds, 0).cast("long")
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    m, h, d = F.floor(n / 60), F.floor(n / 3600), F.floor(n / 86400)
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    bad = seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")) | (seconds < 0)
    return (
        F.when(bad, "—")
        .when(n < 60, part(n, "s"))
        .when(m < 60, pair(part(m, "m"), part(n % 60, "s")))
        .when(h < 24, pair(part(h, "h"), part(m % 60, "m")))
        .otherwise(pair(part(d, "d"), part(h % 24, "h")))
    )


def age_text(at: Column, now: Column) -> Column:
    """How long ago in whole seconds, minutes, hours or days; times to come count as now, null is null."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(at), F.lit(0))
    said = lambda unit, size: F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(at.isNotNull(), F.when(s < 60, said("s", 1)).when(s < 3600, said("m", 60)).when(s < 86400, said("h", 3600)).otherwise(said("d", 86400)))


def age_seconds(spec: Column) -> Column:
    """Seconds of a duration such as 90, 1.5m or 2h; null where it is no non-negative finite number and unit."""
    s = F.trim(spec)
    number = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    unit = F.regexp_extract(s, number + "([smhd]?)$", 1)
    value = F.regexp_extract(s, "(" + number[1:] + ")", 1).try_cast("double")
    times = F.when(unit == "", 1.0)
    for name, size in UNIT_SECONDS.items():
        times = times.when(unit == name, size)
    out = value * times
    return F.when(s.rlike(number + "[smhd]?$") & (out >= 0) & (out < float("inf")), F.abs(out))


def model_name(model_id: Column) -> Column:
    """A served model's bare name: no registry, no tag, no prefix, lower case."""
    bare = F.regexp_extract(F.regexp_replace(F.lower(F.trim(model_id)), "^.*/", ""), "^[^:]*", 0)
    return F.regexp_replace(bare, f"^{MODEL_PREFIX}", "")


def model_identity(own: Column, aliases: Column) -> Column:
    """provider:model of the least pair among struct(provider, model_id) own and the array aliases."""
    clean = lambda p: F.struct(F.trim(p["provider"]).alias("provider"), F.trim(p["model_id"]).alias("model_id"))
    least = F.array_min(F.transform(F.array_append(F.coalesce(aliases, F.array().cast("array<struct<provider:string,model_id:string>>")), own), clean))
    return F.concat(least["provider"], F.lit(":"), least["model_id"])


def embedder_fingerprint(provider: Column, model_id: Column, dimension: Column, normalize: Column, distance: Column, append_eos: Column | None = None) -> Column:
    """SHA-256 over an embedder's settings; the mark of ended inputs is there only when they are ended."""
    flag = F.when(normalize, "True").otherwise("False")
    whole = F.concat_ws("|", F.trim(provider), F.trim(model_id), dimension.cast("string"), flag, F.trim(distance))
    if append_eos is not None:
        whole = F.concat(whole, F.when(append_eos, "|append_eos=1").otherwise(""))
    return F.sha2(whole, 256)


def json_string(x: Column) -> Column:
    """x as a JSON string."""
    listed = F.to_json(F.array(x))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def demonstration_hash(query: Column, student: Column, teacher: Column, target: Column) -> Column:
    """SHA-256 of the compact JSON list of a demonstration; messages are arrays of struct(content, role)."""
    return F.sha2(F.concat(F.lit("["), json_string(query), F.lit(","), F.to_json(student), F.lit(","), F.to_json(teacher), F.lit(","), json_string(target), F.lit("]")), 256)


def merge_key(pairs: Column, key: str, value: Column) -> Column:
    """The map with key set to value, all others as they were."""
    rest = F.map_filter(F.coalesce(pairs, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def entity_type(path: Column) -> Column:
    """The kind of entity that a path /kind/id names, null if it names none."""
    found = F.regexp_extract(path, r"^/?(chunk|document|conversation)s?/[0-9]+$", 1)
    return F.when(found != "", found)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.5))


def parse_class(output: Column) -> Column:
    """struct(value, confidence, rationale) of a model's JSON answer; `other` at 0.2 where it is none."""
    known = F.get_json_object(output, "$.class")
    good = F.coalesce(known.isin(CLASSES), F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _number(F.get_json_object(output, "$.confidence"))))
    why = F.coalesce(F.get_json_object(output, "$.rationale"), F.lit(""))
    bad = F.concat(F.lit(f"{UNREADABLE}: "), F.substring(F.coalesce(output, F.lit("")), 1, SNIPPET))
    return F.struct(
        F.when(good, known).otherwise("other").alias("value"),
        F.when(good, sure).otherwise(0.2).alias("confidence"),
        F.when(good, why).otherwise(bad).alias("rationale"),
    )


def parse_enrichment(output: Column) -> Column:
    """struct(docstring, summary, symbols, confidence) of a model's JSON answer; unreadable ones say so at 0."""
    row = F.from_json(output, "docstring string, summary string, symbols array<string>, confidence string")
    good = F.coalesce(F.trim(output).startswith("{") & F.get_json_object(output, "$").isNotNull(), F.lit(False))
    one = F.get_json_object(output, "$.symbols")
    symbols = F.coalesce(row["symbols"], F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _number(F.get_json_object(output, "$.confidence"))))
    return F.struct(
        F.when(good, F.get_json_object(output, "$.docstring")).alias("docstring"),
        F.when(good, F.coalesce(F.get_json_object(output, "$.summary"), F.lit(""))).otherwise(UNREADABLE).alias("summary"),
        F.when(good, symbols).otherwise(F.array().cast("array<string>")).alias("symbols"),
        F.when(good, sure).otherwise(0.0).alias("confidence"),
    )


def parse_rerank(output: Column) -> Column:
    """The first number of a judge's answer, within 0 to 10; 0 where there is none."""
    n = F.regexp_extract(F.coalesce(output, F.lit("")), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(n, F.lit(0.0))))
