"""Model calls as partitioned jobs: a provider answers prompts inside Arrow batches, in order, with retries left to Spark.

A provider is a function from a list of prompts to a list of answers (None for a failure). It is built once a task by a
factory, so that connections are not shipped. ``offline`` is a deterministic provider for tests and dry runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.answers import given_rating, rating, report, vote
from tessera.functions.answers import points as answer_points
from tessera.operators.search import reduce_points
from tessera.session import cut

Provider = Callable[[list[str]], list[str | None]]


def ask(df: DataFrame, factory: Callable[[], Provider], prompt_col: str = "prompt", answer_col: str = "answer", size: int = 16) -> DataFrame:
    """``df`` with the provider's answers, ``size`` prompts a call."""
    base = df.select("*", F.lit(None).cast("string").alias(answer_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in batches:
            prompts = pdf[prompt_col].tolist()
            answers = [a for i in range(0, len(prompts), size) for a in provider(prompts[i : i + size])]
            yield pdf.assign(**{answer_col: answers})

    return base.mapInPandas(run, base.schema)


def bind(template: str, **values: Column) -> Column:
    """A template with its ``{{ name }}`` places filled."""
    made = F.lit(template)
    for name, value in values.items():
        made = F.replace(made, F.lit("{{ " + name + " }}"), F.coalesce(value.cast("string"), F.lit("")))
    return made


def extract_graph(units: DataFrame, factory: Callable[[], Provider], template: str, gleanings: int = 0, more: str = "MORE", loop: str = "LOOP") -> DataFrame:
    """Parsed records of every unit (id, text, pos): answers of the first call and of each gleaning, one after the other.

    Between gleanings the provider is asked whether to go on; a unit whose reply is not ``Y`` stops there.
    """
    asked = ask(units.select("id", "pos", bind(template, input_text=F.col("text")).alias("prompt")), factory).withColumn("go", F.lit(True))
    for turn in range(gleanings):
        if turn:
            again = asked.withColumn("prompt", F.concat("prompt", F.lit("\n"), "answer", F.lit("\n" + loop))).withColumnRenamed("answer", "held")
            reply = ask(again.filter("go"), factory)
            asked = again.filter("not go").withColumn("answer", F.lit(None).cast("string")).unionByName(reply)
            asked = asked.withColumn("go", F.col("go") & F.coalesce(F.trim("answer") == "Y", F.lit(False))).drop("answer").withColumnRenamed("held", "answer")
        again = asked.withColumn("prompt", F.concat("prompt", F.lit("\n"), "answer", F.lit("\n" + more))).withColumnRenamed("answer", "before")
        gleaned = ask(again.filter("go"), factory).withColumn("answer", F.concat_ws(X.RECORD_DELIMITER, "before", "answer")).drop("before")
        asked = again.filter("not go").withColumnRenamed("before", "answer").unionByName(gleaned)
    return X.parse_graph(asked.select("id", "pos", "answer"))


def extract_claims(units: DataFrame, factory: Callable[[], Provider], template: str) -> DataFrame:
    """Claims of the first answer for each unit; later answers are never parsed, so none is asked for."""
    return X.parse_claims(ask(units.select("id", bind(template, input_text=F.col("text")).alias("prompt")), factory).select("id", "answer"))


def summarize_descriptions(rows: DataFrame, factory: Callable[[], Provider], template: str, budget: int = 4000) -> DataFrame:
    """``rows`` with description: of no distinct description an empty text, of one itself, of more the provider's answer.

    Many descriptions are folded: they are asked for as soon as what is collected uses up ``budget`` less the bare
    prompt, and the answer goes on as the first of the next lot, so that no prompt grows with the hub.
    """
    distinct = rows.withColumn("__d", F.array_sort(F.array_distinct("descriptions")))
    few = distinct.filter(F.size("__d") <= 1).withColumn("description", F.coalesce(F.get("__d", F.lit(0)), F.lit("")))
    many = distinct.filter(F.size("__d") > 1).withColumn("description", F.lit(None).cast("string"))
    fill = lambda items: template.replace("{{ description_list }}", json.dumps(items, ensure_ascii=False, separators=(",", ":")))
    bare = len(fill([]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in batches:
            todo = [(i, list(d)) for i, d in enumerate(pdf["__d"])]
            made: list[str | None] = [None] * len(pdf)
            while todo:  # one lot of every row a turn, so that calls hold many rows
                lots, later = [], []
                for i, items in todo:
                    room, n = max(0, budget - bare), 0
                    for n, item in enumerate(items, 1):
                        room = max(0, room - len(item))
                        if room == 0 and n > 1:
                            break
                    lots.append((i, items[:n], items[n:]))
                answers = [a for at in range(0, len(lots), 16) for a in provider([fill(lot) for _, lot, _ in lots[at : at + 16]])]
                for (i, _, rest), answer in zip(lots, answers):
                    made[i] = answer
                    if rest and answer is not None:
                        later.append((i, [answer, *rest]))
                todo = later
            yield pdf.assign(description=made)

    return few.drop("__d").unionByName(many.mapInPandas(run, many.schema).drop("__d"))


def community_reports(contexts: DataFrame, factory: Callable[[], Provider], template: str) -> DataFrame:
    """Reports of (community, level, context), one job a level, deepest first; unusable answers are dropped."""
    levels = [r[0] for r in contexts.select("level").distinct().orderBy(F.desc("level")).collect()]  # a handful
    made = None
    for level in levels:
        asked = cut(ask(contexts.filter(F.col("level") == level).withColumn("prompt", bind(template, input_text=F.col("context"))), factory))
        made = asked if made is None else made.unionByName(asked)
    if made is None:
        made = contexts.withColumn("prompt", F.lit("")).withColumn("answer", F.lit(None).cast("string"))
    parsed = made.withColumn("r", report(F.col("answer"))).filter("r is not null")
    full = X.report_text(F.col("r.title"), F.col("r.summary"), F.col("r.findings"))
    return parsed.select("community", "level", F.col("r.title").alias("title"), F.col("r.summary").alias("summary"), full.alias("full_content"), F.col("r.rating").alias("rank"), F.col("r.rating_explanation").alias("rating_explanation"), F.col("r.findings").alias("findings"), X.content_id(full).alias("id"))


def lots(texts: list[str], rows: int, tokens: int) -> Iterator[list[str]]:
    """Consecutive texts in lots of at most ``rows`` and at most ``tokens`` code points; an oversized text is a lot of its own."""
    held, size = [], 0
    for t in texts:
        if held and (len(held) >= rows or size + len(t) > tokens):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def embed(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text", id_col: str = "id", size: int = 8191, overlap: int = 100, batch_rows: int = 16) -> DataFrame:
    """(id, vector): texts in snippets, their vectors averaged and scaled where there are several.

    A call holds at most ``batch_rows`` snippets and ``size`` tokens.
    """
    from tessera.functions.vectors import reconstitute

    snippets = X.token_windows(rows.select(id_col, text_col), text_col, size, overlap)
    base = snippets.select(id_col, "chunk", F.array().cast("array<double>").alias("vector"))

    def run(batches):
        provider = factory()
        for pdf in batches:
            yield pdf.assign(vector=[v for lot in lots(pdf["chunk"].tolist(), batch_rows, size) for v in provider(lot)])

    return reconstitute(base.mapInPandas(run, base.schema), id_col, "vector")


#: The fields that are embedded, with the table and the text they come from.
FIELDS = {
    "text_unit_text": ("text_units", F.col, ("text",)),
    "entity_description": ("entities", X.entity_text, ("title", "description")),
    "community_full_content": ("community_reports", F.col, ("full_content",)),
}


def embed_fields(tables: dict[str, DataFrame], factory, names: tuple[str, ...] = tuple(FIELDS), **limits) -> dict[str, DataFrame]:
    """(id, vector) of each named field; fields whose table is missing are left out."""
    made = {}
    for name in names:
        table, text, cols = FIELDS[name]
        if table in tables:
            body = text(*cols) if text is F.col else text(*map(F.col, cols))
            made[name] = embed(tables[table].select("id", body.alias("text")), factory, **limits)
    return made


def map_reduce(batches: DataFrame, factory: Callable[[], Provider], map_template: str, reduce_template: str, budget: int) -> tuple[DataFrame, str | None]:
    """Scored points (batch, at, description, score) of every batch (batch, context), and the answer made of those that fit.

    With no point above zero no answer is asked for.
    """
    asked = ask(batches.select("batch", bind(map_template, context_data=F.col("context")).alias("prompt")), factory)
    points = cut(asked.select("batch", F.posexplode(answer_points(F.col("answer"))).alias("at", "p")).select("batch", "at", "p.description", "p.score"))
    chosen = reduce_points(points, budget).orderBy(F.desc("score"), "batch", "at").collect()  # no more than the budget holds
    if not chosen:
        return points, None
    return points, factory()([reduce_template.replace("{{ report_data }}", "\n\n".join(r["text"] for r in chosen))])[0]


def answer_from(rows: DataFrame, order: list[str], header: str, factory: Callable[[], Provider], template: str, line: str = "line") -> tuple[str, str | None]:
    """The context of rows that a budget has cut (header, then their lines in order) and the provider's answer to it.

    ``template`` takes the context as ``context_data``. Without a row the provider is asked with the header alone.
    """
    lines = [r[0] for r in rows.orderBy(*order).select(line).collect()]  # what the budget holds
    context = header + "".join(f"{t}\n" for t in lines)
    return context, factory()([template.replace("{{ context_data }}", context)])[0]


def rate(communities: DataFrame, factory: Callable[[], Provider], template: str, repeats: int = 1) -> DataFrame:
    """(community, rating, ratings, given): each community's text is rated ``repeats`` times; the whole number most of them say, the
    smallest of equals (:func:`tessera.functions.answers.vote`), the ratings as numbers and as the JSON they were, in order."""
    asked = ask(communities.select("community", bind(template, context_data=F.col("context")).alias("prompt"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("turn")), factory)
    votes = cut(asked.select("community", "turn", given_rating(F.col("answer")).alias("g"), rating(F.col("answer")).alias("rating")))
    every = votes.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("turn", "rating", "g"))).alias("v"))  # a vote a repeat
    said = F.transform("v", lambda x: x["g"])
    return every.select("community", vote(said).alias("rating"), F.transform("v", lambda x: x["rating"]).alias("ratings"), F.transform(said, lambda g: g["json"]).alias("given"))


def budgeted_examples(examples: DataFrame, budget: int, least: int, cost: str = "tokens", order: str = "at") -> DataFrame:
    """The first ``least`` examples in order, and those behind them while all fit ``budget``."""
    run = F.sum(cost).over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))  # a prompt's examples: a few rows
    numbered = examples.withColumn("__n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order))).withColumn("__run", run)
    return numbered.filter((F.col("__n") <= least) | (F.col("__run") <= budget)).drop("__n", "__run")


def query_events(context: DataFrame, tokens: Iterator[str | None]) -> Iterator[tuple[str, object]]:
    """What a streamed query tells its caller: the context, every token that is not empty, then the whole answer or the error."""
    yield "context", context
    held = []
    try:
        for t in tokens:
            if t:
                held.append(t)
                yield "token", t
    except Exception as e:  # noqa: BLE001  the caller is told, whatever it was
        yield "failed", e
        return
    yield "completed", "".join(held)


def offline() -> Provider:
    """Answers with one entity record for each capitalised word and an edge between neighbours."""
    import re

    def answer(prompt: str) -> str:
        words = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+", prompt)))[:8]
        made = [f'("entity"<|>{w}<|>word<|>{w} is named)' for w in words] + [f'("relationship"<|>{a}<|>{b}<|>{a} and {b}<|>1)' for a, b in zip(words, words[1:])]
        return "##".join(made) + X.COMPLETION_MARK

    return lambda prompts: [answer(p) for p in prompts]


def offline_vectors(dim: int = 8) -> Callable[[list[str]], list[list[float]]]:
    import zlib

    return lambda texts: [[((zlib.crc32(f"{i}:{t}".encode()) % 2000) - 1000) / 1000 + 1e-6 for i in range(dim)] for t in texts]
