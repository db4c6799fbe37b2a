"""Reading JSON out of model answers: Catalyst first, a small repair helper for rows that don't parse."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "struct<points: array<struct<description: variant, score: variant>>>"
REPORT = "struct<title: string, summary: string, rating: double, rating_explanation: string, findings: array<struct<summary: string, explanation: string>>>"


def first_object(text: str | None) -> str | None:
    """The first outermost ``{...}`` of a text that parses, repaired if need be; None if there is none."""
    decoder = json.JSONDecoder()
    bare = re.sub(r"```(?:json)?", "", text or "")
    at = bare.find("{")
    while at >= 0:
        for attempt in (bare[at:], repair(bare[at:])):
            try:
                value, _ = decoder.raw_decode(attempt)
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False)
        at = bare.find("{", at + 1)
    return None


NAME = re.compile(r"[^\W\d]\w*(?=\s*:)")
CLOSED = re.compile(r"\s*([,:}\]]|$)")
EMPTY_PLACE = re.compile(r",(?=\s*[}\]])")


def repair(text: str) -> str:
    """JSON with its faults outside strings mended: braces doubled throughout, bare keys, single quotes, trailing commas.

    One walk over the text keeps account of being inside a string, where nothing changes. A single-quoted string ends at a
    quote that a comma, colon, bracket or the end follows.
    """
    doubled, made, at = text.startswith("{{"), [], 0
    while at < len(text):
        c = text[at]
        if c == '"':
            end = at + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            made.append(text[at : end + 1])
            at = end + 1
        elif c == "'":
            end = text.find("'", at + 1)
            while end >= 0 and not CLOSED.match(text, end + 1):
                end = text.find("'", end + 1)
            end = len(text) if end < 0 else end
            made.append(json.dumps(text[at + 1 : end].replace("\\'", "'"), ensure_ascii=False))
            at = end + 1
        elif doubled and text[at : at + 2] in ("{{", "}}"):
            made.append(c)
            at += 2
        elif EMPTY_PLACE.match(text, at):
            at += 1
        elif (name := NAME.match(text, at)) and (at == 0 or not text[at - 1].isalnum()):
            made.append(json.dumps(name[0]))
            at = name.end()
        else:
            made.append(c)
            at += 1
    return "".join(made)


@F.pandas_udf(T.StringType())
def _first_object(s: pd.Series) -> pd.Series:
    return s.map(first_object, na_action="ignore")


#: What Python's json writes otherwise than it was given, or reads and the JVM does not; and a list's end behind an object, which
#: could close the list that a text is put in to see that it is one object and nothing more.
REWRITTEN = r"[0-9][eE]|[0-9.]{16}|\.[0-9]*0(?![0-9])|\\|NaN|Infinity|\}\s*\]"


def _one(items: Column) -> Column:
    """Whether a variant is a list of one item."""
    return F.try_variant_get(items, "$[0]", "variant").isNotNull() & F.try_variant_get(items, "$[1]", "variant").isNull()


def json_object(answer: Column) -> Column:
    """The answer's JSON object; only answers that aren't plain JSON from their first brace to the end reach Python: a call of it
    under a condition takes every row all the same, so the others are null there."""
    def read(t: Column) -> Column:
        plain = F.startswith(F.ltrim(answer), F.lit("{")) & F.try_parse_json(answer).isNotNull()
        whole = ~F.contains(answer, F.lit("```")) & ~t.rlike(REWRITTEN) & _one(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))))
        return F.when(plain, answer).when(whole, t)

    tail = F.when(F.contains(answer, F.lit("{")), F.substr(answer, F.instr(answer, "{")))
    given = F.when(tail.isNotNull(), F.get(F.transform(F.array(tail), read), F.lit(0)))
    return F.coalesce(_first_object(F.when(tail.isNotNull() & given.isNull(), answer)), given)


def _kind(v: Column) -> Column:
    """The JSON kind of a variant: STRING, BOOLEAN, a kind of number, or another."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _number(v: Column) -> Column:
    """A JSON number as a double, true and false as 1 and 0; null for other kinds."""
    kind = _kind(v)
    return F.when(kind == "BOOLEAN", v.try_cast("boolean").cast("double")).when((kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), v.try_cast("double"))


def whole_number(v: Column) -> Column:
    """A JSON value as Python's int() takes it: a number cut to whole, true and false, a text of digits with a sign; else null."""
    text = F.when(_kind(v) == "STRING", v.try_cast("string"))
    digits = F.when(text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("long"))
    return F.coalesce(digits, _number(v).cast("long"))


def points(answer: Column) -> Column:
    """Scored points of a map answer, those with a text and a whole score; an answer without any point gives one empty one of 0."""
    found = F.from_json(json_object(answer), POINTS)["points"]
    read = F.transform(found, lambda p: F.struct(F.when(_kind(p["description"]) == "STRING", p["description"].try_cast("string")).alias("description"), whole_number(p["score"]).cast("double").alias("score")))
    kept = F.filter(read, lambda p: p["description"].isNotNull() & p["score"].isNotNull())
    none = F.array(F.struct(F.lit("").alias("description"), F.lit(0.0).alias("score")))
    return F.when(F.size(found) > 0, kept).otherwise(none)


def report(answer: Column) -> Column:
    """A report struct, null unless title, summary and findings are there."""
    r = F.from_json(json_object(answer), REPORT)
    return F.when(r["title"].isNotNull() & r["summary"].isNotNull() & r["findings"].isNotNull(), r)


def rating(answer: Column, default: float = 1.0) -> Column:
    """The rating of an answer: a number as it is, true and false as 1 and 0, a text that is a number as that; null for another
    text, which no threshold lets pass; ``default`` where the answer has none."""
    def read(v: Column) -> Column:
        text = F.when(_kind(v) == "STRING", v.try_cast("string"))
        return F.when(v.isNull() | (_kind(v) == "VOID"), F.lit(float(default))).otherwise(F.coalesce(_number(v), text.try_cast("double")))

    v = F.from_json(json_object(answer), "struct<rating: variant>")["rating"]
    return F.get(F.transform(F.array(v), read), F.lit(0))  # the answer is parsed once for all that is asked of it


GIVEN = "struct<json: string, label: string, number: double, text: boolean>"


def given_rating(answer: Column, default: int = 1) -> Column:
    """The rating of an answer as it was given: its JSON, how Python writes it, its number, and whether it is a text; ``default``
    where the answer has none, null where it is neither a number nor a truth value nor a text."""
    v = F.from_json(json_object(answer), "struct<rating: variant>")["rating"]
    text, json_text = _kind(v) == "STRING", F.to_json(v)
    label = F.when(text, v.try_cast("string")).when(_kind(v) == "BOOLEAN", F.initcap(json_text)).otherwise(json_text)
    made = F.struct(json_text.alias("json"), label.alias("label"), _number(v).alias("number"), text.alias("text"))
    absent = F.struct(F.lit(str(default)).alias("json"), F.lit(str(default)).alias("label"), F.lit(float(default)).alias("number"), F.lit(False).alias("text"))
    return F.when(v.isNull(), absent).when(text | _number(v).isNotNull(), made)


def _most_frequent(values: Column) -> Column:
    """The most frequent value of an array, the smallest of equals."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def vote(given: Column) -> Column:
    """The whole number that most of an array of :func:`given_rating` say, the smallest of equals; null if any of them is null.

    With a text among them they are counted as texts, and the winner must be a whole number; else as numbers, the winner cut to whole.
    """
    label = F.trim(_most_frequent(F.transform(given, lambda g: g["label"])))
    by_text = F.when(label.rlike(r"^[+-]?\d+$"), label.try_cast("long"))
    by_number = _most_frequent(F.transform(given, lambda g: g["number"])).cast("long")
    return F.when(F.exists(given, lambda g: g.isNull()), None).when(F.exists(given, lambda g: g["text"]), by_text).otherwise(by_number)
