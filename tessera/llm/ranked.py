"""Exact ranked retrieval over documents reordered by recursive graph bisection.

A bounded sample of documents and the terms of a stated query set form a bipartite graph. Recursive bisection halves the sample
again and again, swapping documents between halves while that lowers the cost of coding the gaps in the terms' lists. Each
split leaves a rule: what a document gains by going right, summed over its terms, against the sample's median. Every document
of the table goes down these rules to a leaf, and documents are numbered anew by leaf, length and id. Consecutive numbers make
the shards of the clustered index; a shard is one row of inverted lists that carries, for each query, the most any of its
documents can score.

A query visits shards by descending bound, in waves; what it has found so far sets its floor, and it stops when no shard that
is left has a bound of at least its floor. A bound equal to the floor is visited, as an equal score may belong to a smaller
doc_id: the index holds the ids themselves, and ties go by them, not by the new numbers. So results are exact whatever the
sample was; the order decides how many shards are read only.

Defined results: null, empty and term-free texts count in no statistic and are found by nothing; documents without an id count
in the statistics and are not returned; rows that repeat an id are documents of their own; items without an id or without a term
found nothing; items that repeat an id and a text are one item; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import slices
from tessera.operators.order import dense_ordinal
from tessera.session import cut, stored

#: ASCII letters and digits stay, A-Z in lower case; other ASCII parts terms; bytes of other characters stay.
TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
NODES = "doc_id long, n long, leaf int, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def _matched(text: str | None, places: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """(terms with repeats, places of known terms, their counts)."""
    words = terms_of(text)
    held = Counter(words)
    known = sorted((places[w], k) for w, k in held.items() if w in places)
    return len(words), [p for p, _ in known], [k for _, k in known]


class Bisection:
    """Rules of a binary tree over documents: ``weights[node, term]`` say what going right gains, ``bars[node]`` what it takes."""

    def __init__(self, depth: int, terms: int):
        self.depth = depth
        self.weights = np.zeros(((1 << depth) - 1, terms), np.float32)
        self.bars = np.full((1 << depth) - 1, np.inf)

    def gains(self, node: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[node[doc], term], minlength=n)

    def leaves(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        node = np.zeros(n, np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (self.gains(node, doc, term, n) > self.bars[node])
        return node - ((1 << self.depth) - 1)


def _halves(doc: np.ndarray, term: np.ndarray, n: int, terms: int, rounds: int) -> np.ndarray:
    """Weights of one split of ``n`` documents with postings (doc, term): halves swap documents while both gain."""
    right = np.arange(n) % 2 == 1
    for _ in range(rounds + 1):
        each = [np.bincount(term[right[doc] == side], minlength=terms) for side in (False, True)]
        size = [max(1, n - int(right.sum())), max(1, int(right.sum()))]
        weights = np.log2(size[0] / (each[0] + 1)) - np.log2(size[1] / (each[1] + 1))
        gain = np.bincount(doc, weights[term], minlength=n)
        left_by, right_by = np.flatnonzero(~right), np.flatnonzero(right)
        left_by, right_by = left_by[np.argsort(-gain[left_by], kind="stable")], right_by[np.argsort(gain[right_by], kind="stable")]
        k = min(len(left_by), len(right_by))
        swap = int((gain[left_by[:k]] - gain[right_by[:k]] > 1e-9).sum())
        if not swap:
            break
        right[left_by[:swap]], right[right_by[:swap]] = True, False
    return weights


def bisect(lists: list[list[int]], terms: int, depth: int, rounds: int = 12) -> Bisection:
    """The rules learned on a sample of documents, each a list of term places."""
    tree = Bisection(depth, terms)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    term = np.array([t for x in lists for t in x], np.int64)
    node = np.zeros(len(lists), np.int64)
    for at in range((1 << depth) - 1):
        mine = np.flatnonzero(node == at)
        if len(mine) < 2:
            continue
        place = np.full(len(lists), -1)
        place[mine] = np.arange(len(mine))
        here = place[doc] >= 0
        d, t = place[doc[here]], term[here]
        tree.weights[at] = _halves(d, t, len(mine), terms, rounds)
        gain = np.bincount(d, tree.weights[at][t], minlength=len(mine))
        tree.bars[at] = float(np.median(gain))
        node[mine] = 2 * at + 1 + (gain > tree.bars[at])
    return tree


def index(docs: DataFrame, places: dict[bytes, int], tree: Bisection, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, leaf, terms, counts) of every document with a term; only terms of the query set are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [_matched(t, places) for t in batch.column(1).to_pylist()]
            size = [len(p) for _, p, _ in made]
            term = np.array([x for _, p, _ in made for x in p], np.int64)
            count = np.array([x for _, _, c in made for x in c], np.int64)
            leaf = tree.leaves(np.repeat(np.arange(len(made)), size), term, len(made))
            ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in made], pa.int64()), pa.array(leaf.astype(np.int32)), *lists], names=["doc_id", "n", "leaf", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, NODES).filter("n > 0")


SHARDS = "shard long, ids binary, terms binary, ends binary, places binary, values binary, items array<int>, bounds array<long>"


def packed(rows: DataFrame, weights: np.ndarray, wanted: list[np.ndarray], n_docs: int, n_terms: int) -> DataFrame:
    """One row a shard of (shard, doc_id, n, terms, counts): its inverted lists and, for each query it can serve, its bound."""
    terms = len(weights)
    asks = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    asked = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["terms"].str.len().to_numpy()
        term, tf = (np.concatenate(pdf[c].to_list()).astype(np.int64) for c in ("terms", "counts"))
        place = np.repeat(np.arange(len(pdf)), size)
        m = 50 + (50 * pdf["n"].to_numpy(np.int64) * n_docs) // n_terms
        value = (1_000_000_000 * tf) // (1000 * tf + 20 * m[place])
        by = np.argsort(term, kind="stable")
        term, place, value = term[by], place[by], value[by]
        held, first = np.unique(term, return_index=True)
        most = np.zeros(terms, np.int64)
        if len(held):
            most[held] = np.maximum.reduceat(value, first)
        bound = np.zeros(len(wanted), np.int64)
        np.add.at(bound, asks, (weights * most)[asked])
        items = np.flatnonzero(bound > 0)
        ends = np.r_[first, len(term)].astype(np.int32)
        raw = [pdf["doc_id"].to_numpy(np.int64), held.astype(np.int32), ends, place.astype(np.int32), value.astype(np.int32)]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])]} | {c: [x.tobytes()] for c, x in zip(("ids", "terms", "ends", "places", "values"), raw)} | {"items": [items.tolist()], "bounds": [bound[items].tolist()]})

    return rows.groupBy("shard").applyInPandas(pack, SHARDS)


FOUND = "item int, doc_id long, score long"


def visited(shards: DataFrame, asked: DataFrame, weights: np.ndarray, wanted: list[np.ndarray], k: int) -> DataFrame:
    """(item, doc_id, score): of each visit (shard, item, floor) the ``k`` best documents that reach the floor."""
    visits = asked.groupBy("shard").agg(F.collect_list(F.struct("item", "floor")).alias("visits"))  # at most one a query

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples():
                ids = np.frombuffer(x.ids, np.int64)
                terms, ends, places, values = (np.frombuffer(b, np.int32) for b in (x.terms, x.ends, x.places, x.values))
                at = {t: i for i, t in enumerate(terms.tolist())}
                out = []
                for visit in x.visits:
                    score = np.zeros(len(ids), np.int64)
                    for t in wanted[visit["item"]].tolist():
                        if (i := at.get(t)) is not None and weights[t]:
                            score[places[ends[i] : ends[i + 1]]] += weights[t] * values[ends[i] : ends[i + 1]].astype(np.int64)
                    best = np.flatnonzero(score >= max(1, visit["floor"]))
                    best = best[np.lexsort((ids[best], -score[best]))[:k]]
                    out.append(pd.DataFrame({"item": np.full(len(best), visit["item"], np.int32), "doc_id": ids[best], "score": score[best]}))
                yield pd.concat(out, ignore_index=True)

    return shards.join(visits, "shard").select("ids", "terms", "ends", "places", "values", "visits").mapInPandas(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = 50, depth: int = 6, sample_rows: int = 4096, features: int = 16_384, shard_rows: int = 2048, block: int = 512, first: int = 4, growth: int = 8) -> DataFrame:
    """(item, rank, doc_id, score): each item's ``k`` best documents of a score above 0, ties to the smaller id.

    The query set is stated and read in blocks of ``block`` items. The order is learned on at most ``sample_rows`` documents
    chosen by hash, by the ``features`` terms most of them hold; ``depth`` sets the number of leaves.
    """
    items = cut(queries.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").distinct())
    total = items.count()
    made = None
    for some in range(max(1, -(-total // block))):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(-(-total // block))) == some) if total > block else items
        got = _search(docs, part.orderBy("id", "text").collect(), id_col, text_col, k, depth, sample_rows, features, shard_rows, first, growth)  # one block
        made = got if made is None else made.unionByName(got)
    return made.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def _search(docs: DataFrame, items: list, id_col: str, text_col: str, k: int, depth: int, sample_rows: int, features: int, shard_rows: int, first: int, growth: int) -> DataFrame:
    spark = docs.sparkSession
    held = [sorted(set(terms_of(r["text"]))) for r in items]
    places = {t: i for i, t in enumerate(sorted(set().union(*held)))}
    wanted = [np.array([places[t] for t in x], np.int64) for x in held]
    nothing = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    if not places:
        return nothing
    rows = docs.count()
    chance = min(1.0, 1.5 * sample_rows / max(1, rows))
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < int(chance * (1 << 30))).limit(sample_rows)
    flat = Bisection(0, len(places))
    lists = [r["terms"] for r in index(drawn, places, flat, id_col, text_col).select("terms").collect()]  # at most sample_rows
    often = Counter(t for x in lists for t in x)
    some = {t: i for i, (t, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:features])}
    small = bisect([[some[t] for t in x if t in some] for x in lists], max(1, len(some)), depth)
    tree = Widened(small, some, len(places))
    base = stored(index(docs, places, tree, id_col, text_col))
    n_docs, n_terms = base.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return nothing
    df = np.zeros(len(places), np.int64)
    for r in base.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one row a query term
        df[r["t"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    numbered = dense_ordinal(base.filter("doc_id is not null"), "leaf", "n", "doc_id", name="place")
    shards = stored(packed(numbered.withColumn("shard", F.floor(F.col("place") / shard_rows)), weights, wanted, int(n_docs), int(n_terms)))
    bounds = shards.select("shard", F.explode(F.arrays_zip("items", "bounds")).alias("b")).select("shard", F.col("b.items").alias("item"), F.col("b.bounds").alias("bound"))
    ranked = stored(bounds.withColumn("turn", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))))
    best, low, high = None, 0, first
    while True:
        left = ranked.filter(F.col("turn") > low)
        if best is None:
            open_ = left.withColumn("floor", F.lit(1).cast("long"))
        else:
            floors = best.filter(F.col("rank") == k).select("item", F.col("score").alias("floor"))  # a row a query
            open_ = left.join(F.broadcast(floors), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).filter("bound >= floor")
            if open_.isEmpty():
                break
        found = visited(shards, open_.filter(F.col("turn") <= high).select("shard", "item", "floor"), weights, wanted, k)
        both = found if best is None else found.unionByName(best.select("item", "doc_id", "score"))
        best = cut(best_of(both, k))
        low, high = high, high * growth
    named = spark.createDataFrame([(i, int(r["id"])) for i, r in enumerate(items)], "item int, id long")
    return best.join(F.broadcast(named), "item").select(F.col("id").alias("item"), "rank", "doc_id", "score")  # one block of queries


class Widened(Bisection):
    """A tree over all places of terms out of one over ``some`` of them; other terms weigh nothing."""

    def __init__(self, small: Bisection, some: dict[int, int], terms: int):
        self.depth, self.bars = small.depth, small.bars
        self.small = small.weights
        self.to = np.full(terms, -1, np.int64)
        for t, i in some.items():
            self.to[t] = i

    def gains(self, node: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        to = self.to[term]
        known = to >= 0
        return np.bincount(doc[known], self.small[node[doc[known]], to[known]], minlength=n)
