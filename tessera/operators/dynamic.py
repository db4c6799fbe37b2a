"""Communities chosen for a question by model calls inside a loop of waves, and the Global search that answers from their reports.

A wave is a table: its communities are rated in one job and cut before the next wave is made of the children of those that matter.
So the jobs are as many as the hierarchy is deep, and what crosses to the driver is the size of each wave. The order in which
communities come to be asked about is kept as a wave number and a path of places, of which a lower level has one more each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.models import Provider, bind, map_reduce, rate
from tessera.operators.packing import pack_whole
from tessera.operators.search import community_weights
from tessera.session import cut

#: Name and columns of the table that a batch of reports shows.
REPORTS_NAME = "Reports"
REPORT_COLUMNS = ("id", "title", "occurrence weight", "content", "rank")


@dataclass
class Selection:
    """What a walk did.

    ``rated``: (community, level, parent, wave, path, rating, ratings, relevant, selected) of every community asked about;
    ``skipped``: (by, community, reason) of children not asked about, for want of a report or since they were before;
    ``waves``: number, source (initial, children or fallback) and size of each wave.
    """

    rated: DataFrame
    skipped: DataFrame
    waves: list[tuple[int, str, int]]

    def reports(self, reports: DataFrame) -> DataFrame:
        """``reports`` of the selected communities."""
        return reports.join(self.rated.filter("selected").select("community"), "community", "left_semi")


def _kept(rated: DataFrame, keep_parent: bool) -> DataFrame:
    """(community) of relevant ones; unless ``keep_parent`` a parent goes once a relevant child comes after it, or is itself."""
    good = rated.filter("relevant").select("community", "parent", F.struct("wave", "path").alias("at"))
    if keep_parent:
        return good.select("community")
    last = good.filter("parent is not null").groupBy(F.col("parent").alias("community")).agg(F.max("at").alias("child"))
    return good.join(last, "community", "left").filter("child is null or child < at").select("community")


def walk(communities: DataFrame, backed: DataFrame, rater: Callable[[DataFrame], DataFrame], threshold: int = 1, max_level: int = 2, keep_parent: bool = False) -> Selection:
    """Waves from level 0 on: a community rated ``threshold`` or more opens its children, whatever their level.

    ``communities`` (community, level, parent, children), one row and whole number a community; ``backed`` (community) those with a
    report, the only ones ever asked about, each once. ``rater`` takes (community) and gives (community, rating, ratings); no rating
    is not relevant. After a wave without anything to open, and with nothing chosen so far, the level with the number of waves
    passed is tried whole, if it isn't beyond ``max_level``. No report at level 0 is an error. A child that has a report but no row
    in ``communities`` is rated, at the level of its wave, and opens nothing.
    """
    meta = cut(communities.select("community", "level", "parent", "children"))
    known = cut(backed.select("community").filter("community is not null").distinct())
    whole = lambda level: meta.filter(F.col("level") == level).join(known, "community", "left_semi").select("community", F.array(F.col("community").cast("long")).alias("path"))
    wave, source, rated, skipped, waves = cut(whole(0)), "initial", None, None, []
    if not (size := wave.count()):
        raise ValueError("no community of level 0 has a report")
    while size:
        number = len(waves)
        waves.append((number, source, size))
        votes = cut(rater(wave.select("community")).select("community", "rating", "ratings"))  # no call is made twice
        told = wave.join(votes, "community", "left").join(meta, "community", "left")
        told = told.withColumn("level", F.coalesce("level", F.lit(number))).withColumn("wave", F.lit(number)).withColumn("relevant", F.coalesce(F.col("rating") >= threshold, F.lit(False)))
        told = cut(told.select("community", "level", "parent", "children", "wave", "path", "rating", "ratings", "relevant"))
        rated = told if rated is None else rated.unionByName(told)
        kids = told.filter("relevant").select(F.col("community").alias("by"), "path", F.posexplode("children").alias("place", "community"))
        kids = cut(kids.select("by", "community", F.concat("path", F.array(F.col("place").cast("long"))).alias("path")).join(known.withColumn("backed", F.lit(True)), "community", "left"))
        unseen = kids.filter("backed").join(rated.select("community"), "community", "left_anti")
        fresh = cut(unseen.groupBy("community").agg(F.min("path").alias("path")))
        again = kids.filter("backed").join(fresh, ["community", "path"], "left_anti")
        left = kids.filter("backed is null").select("by", "community", F.lit("no report").alias("reason")).unionByName(again.select("by", "community", F.lit("repeated").alias("reason")))
        skipped = left if skipped is None else skipped.unionByName(left)
        wave, source, size = fresh, "children", fresh.count()
        if not size and number + 1 <= max_level and _kept(rated, keep_parent).isEmpty():
            wave, source = cut(whole(number + 1).join(rated.select("community"), "community", "left_anti")), "fallback"
            size = wave.count()
    kept = _kept(rated, keep_parent).withColumn("selected", F.lit(True))
    made = rated.drop("children").join(kept, "community", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return Selection(cut(made), skipped, waves)


def select_communities(question: str, communities: DataFrame, reports: DataFrame, factory: Callable[[], Provider], template: str, repeats: int = 1, use_summary: bool = False, **rules) -> Selection:
    """:func:`walk` with ratings by a provider: ``template`` takes a report's ``description`` (its content, or its summary) and the
    ``question``. Of repeated reports of a community the one of the smallest id is shown."""
    text = "summary" if use_summary else "content"
    shown = reports.groupBy("community").agg(F.min_by(text, "id").alias("text"))

    def rater(wave: DataFrame) -> DataFrame:
        prompt = bind(template, description=F.col("text"), question=F.lit(question))
        return rate(shown.join(wave, "community").select("community", prompt.alias("context")), factory, "{{ context_data }}", repeats).select("community", "rating", F.col("given").alias("ratings"))

    return walk(communities, shown, rater, **rules)


def report_batches(reports: DataFrame, most: int, place: str = "place") -> DataFrame:
    """(batch, context, ids) of reports (id, community, title, occurrence, content, rank) packed in the order of ``place``.

    A batch's unquoted lines, its header and the table's name have at most ``most`` characters together, but an oversized line is a
    batch of its own. The context is the header and the lines, quoted where needed, by occurrence and rank, then place. ``place``
    has no ties and no nulls.
    """
    shown = [F.col("community"), F.col("title"), X.python_float(F.col("occurrence")), F.col("content"), X.python_float(F.col("rank").cast("double"))]
    header = "|".join(REPORT_COLUMNS) + "\n"
    rows = reports.withColumn("cost", F.length(X.raw_row(*shown)) + 1).withColumn("line", X.csv_row(*[c.cast("string") for c in shown], sep="|"))
    packed = pack_whole(rows.select("id", "occurrence", "rank", "line", "cost", F.col(place).alias("place")), "cost", most - len(header) - len(f"-----{REPORTS_NAME}-----\n"), "place")
    order = F.struct((-F.col("occurrence")).alias("o"), (-F.col("rank")).alias("r"), "place", "line", "id")
    lines = packed.groupBy("batch").agg(F.array_sort(F.collect_list(order)).alias("l"))  # what ``most`` characters hold
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("batch", F.concat(F.lit(header), body, F.lit("\n")).alias("context"), F.transform("l", lambda x: x["id"]).alias("ids"))


def shuffled(reports: DataFrame, seed: int = 86) -> DataFrame:
    """``reports`` with a place that no order of ids or table is seen in: a digest of id and seed, the id behind it."""
    return reports.withColumn("place", F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), "id")), F.lit("-"), F.col("id")))


def global_search(question: str, reports: DataFrame, entities: DataFrame, factory: Callable[[], Provider], map_template: str, reduce_template: str, most: int = 12_000, budget: int = 12_000, selection: Selection | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """Batches, their scored points and the answer to ``question`` from ``reports``, or from those a selection keeps.

    ``entities`` hold community_ids and text_unit_ids. The templates may show the ``question``; the map template takes
    ``context_data``, the reduce template ``report_data``. Where no point scores above zero there is no answer (None).
    """
    kept = reports if selection is None else selection.reports(reports)
    batches = cut(report_batches(shuffled(community_weights(kept, entities)), most))
    ask = lambda template: template.replace("{{ question }}", question)
    points, answer = map_reduce(batches, factory, ask(map_template), ask(reduce_template), budget)
    return batches, points, answer
