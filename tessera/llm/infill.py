"""Fill-in-the-middle transformation by an Aho-Corasick event scan.

A unit is a run of non-blank characters with the blanks before it; blanks at the end of a text are a unit of their own.
One automaton holds the six ASCII blanks, at which the class of a character changes, and the sentinels. Its hits are the
events of a text. Between two blanks lies a gap, and a gap that is not empty is one unit, so the number of units and the
place where the k-th one ends follow from differences of event positions: no character between events is looked at.
Prefix and middle end where the ranks drawn from a hash of the document's id say. A text without an event is one unit.

Defined results: a null text is an empty one; an empty text or one that holds a sentinel stays plain, so that
:func:`restored` can always tell the pieces apart; a null id is hashed as an empty one; rows that repeat an id and a text
come out alike; very long texts cost 16 bytes an event; an empty table gives an empty result; a column named like a new
one is replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rows import long, slices
from tessera.session import without_columns

BLANKS = "\t\n\x0b\x0c\r "
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def event_automaton():
    """The automaton of blanks (value 0) and sentinels (value 1)."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in BLANKS:
        made.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        made.add_word(s, 1)
    made.make_automaton()
    return made


def unit_ends(text: str, automaton) -> tuple[np.ndarray, bool]:
    """Where each unit ends, in code points, and whether the text holds a sentinel."""
    events = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
    blanks = events[events[:, 1] == 0, 0]
    bounds = np.r_[-1, blanks, len(text)]
    ends = bounds[1:][np.diff(bounds) > 1]  # a gap that is not empty is one unit
    if len(blanks) and blanks[-1] == len(text) - 1:
        ends = np.r_[ends, len(text)]
    return ends, len(blanks) < len(events)


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers below 2**32 out of the hash of seed and id."""
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str | None, doc_id, automaton, seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text; lengths in code points, none for a plain one."""
    text = text or ""
    ends, marked = unit_ends(text, automaton)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: str, form: str) -> str:
    """The text an output was made of: pieces hold no sentinel, and none can arise where a piece meets one."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    inner = output.index(marks[1])
    last = output.index(marks[2], inner)
    one, two, middle = output[3:inner], output[inner + 3 : last], output[last + 3 :]
    return two + middle + one if form == "spm" else one + middle + two


FIELDS = [long("n"), T.StructField("form", T.StringType()), long("prefix_chars"), long("middle_chars")]


def _apply(docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField], row: Callable[[str | None, object, object], tuple], keep_text: bool) -> DataFrame:
    base = without_columns(docs, [f.name for f in fields if f.name.lower() not in (id_col.lower(), text_col.lower())])
    at, by = base.columns.index(text_col), base.columns.index(id_col)
    stay = [i for i in range(len(base.columns)) if keep_text or i != at]
    kinds = [{"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = event_automaton()
        for batch in slices(batches, 64):
            made = [row(t, i, automaton) for t, i in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist())]
            columns = [pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], *columns], names=[*[batch.schema.names[i] for i in stay], *[f.name for f in fields]])

    return base.mapInArrow(run, T.StructType([*[base.schema[i] for i in stay], *fields]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and the output text, in one pass without a shuffle."""
    fields = [*FIELDS, T.StructField("output", T.StringType())]
    return _apply(docs, id_col, text_col, fields, lambda t, i, a: transformed(t, i, a, seed, rate, spm), True)


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``made`` with the text rebuilt from output and form as a column restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [restored(o or "", f or "plain") for o, f in zip(batch.column(output_col).to_pylist(), batch.column(form_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])

    base = without_columns(made, ["restored"])
    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField("restored", T.StringType())]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``docs`` less its text, with the transformation's columns and the hashes of output and of the text rebuilt from it."""

    def row(text, doc_id, automaton):
        *told, output = transformed(text, doc_id, automaton, seed)
        return (*told, sha256(output.encode()).hexdigest(), sha256(restored(output, told[1]).encode()).hexdigest())

    fields = [*FIELDS, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    return _apply(docs, id_col, text_col, fields, row, False).select(F.col(id_col), *[f.name for f in fields])
