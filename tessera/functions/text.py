"""Text expressions: trimming, content ids, windows of code points, record parsing and row rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the extraction answer format.
RECORD_DELIMITER, FIELD_DELIMITER, COMPLETION_MARK = "##", "<|>", "<|COMPLETE|>"
CLAIM_FIELDS = ("subject_id", "object_id", "type", "status", "start_date", "end_date", "description", "source_text")


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_id(*parts: Column, bits: int = 512) -> Column:
    """Hex digest of the parts written one after the other; null parts count as empty."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), bits)


def window_count(n: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` with ``overlap`` that cover ``n`` tokens; the last one ends the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(size - overlap)) + 1).cast("int")


def token_windows(df: DataFrame, text_col: str = "text", size: int = 1200, overlap: int = 100) -> DataFrame:
    """One row for each window of code points, with ordinal, chunk and n_tokens in place of the text.

    Windows are cut before they are exploded, so a long text isn't copied once a window. Null and empty texts give none.
    """
    step, n = size - overlap, F.length(text_col)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), window_count(n, size, overlap) - 1), lambda i: F.substring(F.col(text_col), i * step + 1, F.lit(size))))
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    rows = df.select(*rest, F.posexplode(parts).alias("ordinal", "chunk"))
    return rows.withColumn("n_tokens", F.length("chunk").cast("long"))


def metadata_prefix(pairs: list[tuple[str, Column]]) -> Column:
    """``key: value.`` lines that go before a chunk; null values are left out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(".\n")) for k, v in pairs])


def records(answer: Column) -> Column:
    """Records of a model's answer, one layer of parentheses and the completion mark taken off; blanks dropped."""
    bare = F.replace(answer, F.lit(COMPLETION_MARK), F.lit(""))
    parts = F.split(bare, RECORD_DELIMITER, -1)
    return F.filter(F.transform(parts, lambda r: F.regexp_replace(trim_all(r), r"^\(|\)$", "")), lambda r: r != "")


def fields(record: Column) -> Column:
    return F.split(record, r"<\|>", -1)


def clean(c: Column) -> Column:
    """Trimmed, HTML entities decoded, and without control characters."""
    return F.regexp_replace(unescape_if_needed(trim_all(c)), "[\\x00-\\x1f\\x7f-\\x9f]", "")


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities decoded; only rows with an ampersand need to come here."""
    import html

    return s.map(lambda x: html.unescape(x) if x is not None else None)


def unescape_if_needed(c: Column) -> Column:
    return F.coalesce(unescape(F.when(F.contains(c, F.lit("&")), c)), c)  # other rows reach the worker as nulls


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, '^"|"$', "")


def parse_graph(df: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Entity and relationship records of every answer: kind, title or source, type or target, description, weight."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != answer_col]
    rows = df.select(*rest, F.posexplode(records(F.col(answer_col))).alias("record_pos", "record")).withColumn("f", fields(F.col("record")))
    kind = _unquote(trim_all(F.get("f", F.lit(0))))
    name = lambda i: clean(F.upper(F.get("f", F.lit(i))))
    is_entity = (kind == "entity") & (F.size("f") >= 4)
    is_edge = (kind == "relationship") & (F.size("f") >= 5)
    return rows.filter(is_entity | is_edge).select(
        *rest, "record_pos", kind.alias("kind"), name(1).alias("first"), name(2).alias("second"), clean(F.get("f", F.lit(3))).alias("description"),
        F.when(is_edge, F.coalesce(F.expr("try_cast(trim(element_at(f, -1)) as double)"), F.lit(1.0))).alias("weight"),
    )


def parse_claims(df: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Claim records: eight trimmed fields by position, missing ones null."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != answer_col]
    rows = df.select(*rest, F.posexplode(records(F.col(answer_col))).alias("record_pos", "record")).withColumn("f", fields(F.col("record")))
    return rows.select(*rest, "record_pos", *[trim_all(F.get("f", F.lit(i))).alias(n) for i, n in enumerate(CLAIM_FIELDS)])


def raw_row(*cols: Column, sep: str = "|") -> Column:
    """A line of values without quoting; nulls are empty."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def quoted(c: Column, sep: str = ",") -> Column:
    """A CSV value, quoted only where it holds the separator, a quote or a line end."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    special = "|".join(f"\\{x}" if x in "|" else x for x in (sep, '"', "\n", "\r"))
    return F.when(s.rlike(special), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(*cols: Column, sep: str = ",") -> Column:
    return F.concat_ws(sep, *[quoted(c, sep) for c in cols])


def section(title: str, header: list[str], body: Column, sep: str = "|") -> Column:
    return F.concat(F.lit(f"-----{title}-----\n{sep.join(header)}\n"), body)


def xml_escape(c: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def brace_escape(c: Column) -> Column:
    """Braces doubled, for templates that bind names in braces."""
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def entity_text(title: Column, description: Column) -> Column:
    """``title:description``; a lone colon, when both are empty, is empty."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(":"), F.coalesce(description, F.lit("")))
    return F.when(both == ":", "").otherwise(both)


def report_text(title: Column, summary: Column, findings: Column) -> Column:
    """Markdown of a report from its title, summary and findings array<struct<summary, explanation>>."""
    parts = F.transform(findings, lambda f: F.concat(F.lit("## "), f["summary"], F.lit("\n\n"), f["explanation"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), summary, F.array_join(parts, "\n\n"))


def python_float(c: Column) -> Column:
    """A number as Python prints a float: plain from 1e-4 to 1e16, else with an exponent of two digits or more; null is empty.

    The digits are the JVM's, which before version 19 finds one more than the shortest for a few numbers.
    """
    s = F.abs(c).cast("double").cast("string")  # plain from 1e-3 to 1e7, else one digit, a point, digits and an exponent
    part = lambda i: F.regexp_extract(s, r"^(\d)\.(\d+)E(-?\d+)$", i)
    lead, rest, e = part(1), F.when(part(2) == "0", "").otherwise(part(2)), part(3).try_cast("int")
    above = F.rpad(F.concat(lead, rest), F.greatest(e + 1, F.length(rest) + 1), F.lit("0"))
    tail = F.substring(above, e + 2, F.lit(400))
    large = F.concat(F.substring(above, F.lit(1), e + 1), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), lead, rest)
    power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    exponent = F.concat(lead, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), power)
    made = F.when(s == "Infinity", "inf").when(e.isNull(), s).when((e >= 0) & (e < 16), large).when((e < 0) & (e >= -4), small).otherwise(exponent)
    negative = F.startswith(c.cast("double").cast("string"), F.lit("-"))
    return F.when(c.isNull(), "").otherwise(F.concat(F.when(negative, "-").otherwise(""), made))


def citations(answer: Column) -> Column:
    """``[Data: Name (1, 2, +more); Other (3)]`` as array<struct<dataset, record_ids, has_more>>."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[Data:\s*([^\]]+)\]"), F.lit(1))
    items = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*;\s*")))
    well = F.filter(items, lambda i: i.rlike(r"^\s*[A-Za-z][A-Za-z ]*\(\s*[^()]+\)\s*$"))
    ids = lambda i: F.split(F.regexp_extract(i, r"\(([^()]*)\)", 1), r"\s*,\s*")
    return F.transform(well, lambda i: F.struct(
        F.trim(F.regexp_extract(i, r"^\s*([A-Za-z][A-Za-z ]*?)\s*\(", 1)).alias("dataset"),
        F.filter(F.transform(ids(i), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$")).alias("record_ids"),
        F.exists(ids(i), lambda x: F.trim(x) == "+more").alias("has_more"),
    ))


SENTENCE = r"(?<=[.!?。！？])\s*"


def semantic_windows(df: DataFrame, text_col: str = "text", size: int = 1200) -> DataFrame:
    """Chunks of at most ``size`` code points that end at paragraphs, else sentences, else words, else anywhere."""
    import re

    def split(text: str, seps: tuple[str, ...]) -> Iterator[str]:
        if len(text) <= size:
            yield text
            return
        if not seps:
            yield from (text[i : i + size] for i in range(0, len(text), size))
            return
        held = ""
        ends = [m.end() for m in re.finditer(seps[0], text) if m.end()]
        for a, b in zip([0, *ends], [*ends, len(text)]):
            if len(held) + b - a <= size:
                held += text[a:b]
                continue
            if held:
                yield held
            held = text[a:b]
            if len(held) > size:
                *whole, held = split(held, seps[1:])
                yield from whole
        if held:
            yield held

    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c != text_col], F.col(text_col).alias("chunk"))

    def run(batches):
        for pdf in batches:
            pdf = pdf.assign(chunk=[[c for c in split(t or "", (r"\n\s*\n", SENTENCE, r"\s+")) if c.strip()] for t in pdf["chunk"]])
            pdf = pdf[pdf["chunk"].map(len) > 0]
            pdf["ordinal"] = pdf["chunk"].map(lambda c: list(range(len(c))))
            yield pdf.explode(["chunk", "ordinal"]).astype({"ordinal": "int32"})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInPandas(run, f"{kept}, ordinal int").withColumn("n_tokens", F.length("chunk").cast("long"))


def with_metadata(chunks: DataFrame, pairs: list[tuple[str, Column]], chunk_col: str = "chunk") -> DataFrame:
    """``chunks`` with the metadata lines before each chunk, and n_tokens counted again."""
    return chunks.withColumn(chunk_col, F.concat(metadata_prefix(pairs), F.col(chunk_col))).withColumn("n_tokens", F.length(chunk_col).cast("long"))


def python_list(items: Column) -> Column:
    """A list of texts as Python prints it: double quotes only around a text with a single quote and no double one."""

    def one(x):
        safe = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))


def json_list(items: Column) -> Column:
    """A JSON array of texts with a blank behind each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)), ", "), F.lit("]"))


def python_int(c: Column) -> Column:
    """A JSON text as Python's int() takes it: whole numbers, numbers cut to whole, true and false; null for the rest."""
    bare = F.trim(c)
    return F.coalesce(bare.try_cast("long"), bare.try_cast("double").cast("long"), F.when(F.lower(bare) == "true", 1).when(F.lower(bare) == "false", 0))


def identifier(c: Column) -> Column:
    """Whether a text is a plain identifier."""
    return F.coalesce(c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def period(now: Column | None = None) -> Column:
    """The UTC date as text; a fixed time can be given for tests."""
    return F.date_format(F.to_utc_timestamp(now, F.current_timezone()) if now is not None else F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")
