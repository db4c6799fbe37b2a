"""Exact top-k inner products over norm-sorted blocks.

Vectors are scaled to whole numbers, ordered by descending length, packed into chunks and dealt into blocks. Blocks are
met in waves, the longest vectors first and four times as many in each wave as before it. After a wave the best ``k`` of
every query so far are merged, and the k-th of them (score and id) is the floor that a candidate of the next wave has to
beat. A query slot goes only to blocks whose longest vector can still reach one of its floors. Inside a cell of one slot
and one block, partial sums over the leading axes of a fixed rotation (the right singular vectors of a bounded sample) plus
the Cauchy-Schwarz bound of what is left drop candidates axis group by axis group; the products of those that stay are
taken whole, in exact arithmetic. A cell returns only what beats the floor, at most ``k`` rows a query.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows with a null id, take no
part; vectors of different length don't meet; rows that repeat an id are that id's own and no candidates for it, a
repeated query counts once (its largest vector); a component beyond the doubles is held at the largest double, a product
beyond a long at the long's limits. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import matrices
from tessera.session import broadcast_if_small, cut

EXACT = 2.0**52
BIGGEST = float(np.finfo(np.float64).max)
LONG = np.iinfo(np.int64)
FOUND = "q long, id long, score long"


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, held at the largest double."""
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    with np.errstate(over="ignore"):
        return np.minimum(top * np.sqrt(((x / safe[:, None]) ** 2).sum(1)), BIGGEST)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, dim, len, v array<double>) of rows that take part; v holds floor(scale * x)."""

    def run(batches):
        for batch in batches:
            for dim, at, x in matrices(batch.column(1)):
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(x * scale), -BIGGEST, BIGGEST)
                yield pd.DataFrame({"id": batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64), "dim": np.int32(dim), "len": lengths(v), "v": list(v)})

    def arrow(batches):
        import pyarrow as pa

        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter("id is not null and size(x) > 0")
    return rows.mapInArrow(arrow, "id long, dim int, len double, v array<double>")


def rotation(df: DataFrame, sample_rows: int) -> dict[int, np.ndarray]:
    """By vector length: right singular vectors of at most ``sample_rows`` rows, chosen by hash, each at length one."""
    rows = df.filter("len > 0").orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("dim", "v").collect()
    made = {}
    for dim in {r[0] for r in rows}:
        x = np.array([r[1] for r in rows if r[0] == dim])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        made[dim] = np.linalg.svd(x / np.linalg.norm(x, axis=1, keepdims=True), full_matrices=True)[2].T
    return made


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of all rows of ``q`` with all of ``x`` as int64."""
    if np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, q.shape[1]) < EXACT:
        return (q @ x.T).astype(np.int64)
    left, right = [[int(c) for c in r] for r in q], [[int(c) for c in r] for r in x]
    return np.array([[max(LONG.min, min(LONG.max, sum(map(int.__mul__, a, b)))) for b in right] for a in left], np.int64).reshape(len(q), len(x))


class Cell:
    """The queries of one cell with their floors; candidates are fed to it tile by tile, longest first."""

    def __init__(self, q_id: np.ndarray, q: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, turn: np.ndarray | None, k: int):
        self.q_id, self.q, self.k = q_id, q, k
        self.floor, self.floor_id = floor.astype(np.int64), floor_id.astype(np.int64)  # a candidate must beat this pair
        self.open = floor_id == LONG.max  # no k-th result yet
        self.turn = np.eye(q.shape[1]) if turn is None else turn
        self.unit, self.len = self._turned(q)
        dim = q.shape[1]
        self.steps = sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2)})
        self.rest = self._rests(self.unit)
        none = np.zeros(0, np.int64)
        self.best = (none, none, none)  # place of the query, id, score

    def _turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows at length one in rotated axes, and their lengths; zero rows stay zero."""
        top = np.abs(x).max(axis=1, initial=0.0)
        u = x / np.where(top > 0, top, 1.0)[:, None]
        size = np.linalg.norm(u, axis=1)
        return (u / np.where(size > 0, size, 1.0)[:, None]) @ self.turn, lengths(x)

    def _rests(self, unit: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt(np.maximum(0.0, (unit[:, s:] ** 2).sum(1))) for s in self.steps]

    def feed(self, x_id: np.ndarray, x: np.ndarray) -> bool:
        """Take in one tile; False once no later, shorter candidate can reach any floor."""
        unit, size = self._turned(x)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            need = np.where(self.len > 0, self.floor / self.len, np.where(self.floor > 0, np.inf, -np.inf))  # a product of at least this with the candidate alone
            need = np.where(self.open, -np.inf, need)
            rows = np.flatnonzero(size.max(initial=0.0) * (1 + 1e-9) + 1e-6 >= need)
            if not len(rows):
                return False
            # the cosine a pair needs, less a slack for rounding
            bar = np.where(size[None, :] > 0, need[rows, None] / np.where(size > 0, size, 1.0)[None, :], np.where(need[rows, None] > 0, np.inf, -np.inf))
            bar = bar - 1e-9 * np.maximum(1.0, np.abs(bar))
        cols, x_rest, low = np.arange(len(x)), self._rests(unit), 0
        sums = np.zeros((len(rows), len(cols)))
        for s, q_rest, rest in zip(self.steps, self.rest, x_rest):
            if self.open.any():
                break
            sums += self.unit[rows, low:s] @ unit[cols, low:s].T
            low = s
            alive = sums + np.outer(q_rest[rows], rest[cols]) >= bar
            r, c = alive.any(1), alive.any(0)
            if not r.any():
                return True
            if r.sum() * c.sum() < 0.7 * alive.size:
                rows, cols, sums, bar = rows[r], cols[c], sums[np.ix_(r, c)], bar[np.ix_(r, c)]
        score = _products(self.q[rows], x[cols])
        beats = (score > self.floor[rows, None]) | ((score == self.floor[rows, None]) & (x_id[None, cols] < self.floor_id[rows, None])) | self.open[rows, None]
        beats &= self.q_id[rows, None] != x_id[None, cols]
        if beats.sum() > 4 * self.k * len(rows) and score.shape[1] > self.k:
            ranked = np.where(beats, score, LONG.min)
            kth = np.partition(ranked, -self.k, axis=1)[:, -self.k]
            beats &= score >= kth[:, None]
        i, j = np.nonzero(beats)
        if len(i):
            self._merge(rows[i], x_id[cols[j]], score[i, j])
        return True

    def _merge(self, place: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        place, ids, score = (np.concatenate(p) for p in zip(self.best, (place, ids, score)))
        order = np.lexsort((ids, -score.astype(object) if score.min() == LONG.min else -score, place))
        place, ids, score = place[order], ids[order], score[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
        keep = rank < self.k
        self.best = (place[keep], ids[keep], score[keep])
        last = rank == self.k - 1
        self.floor[place[last]], self.floor_id[place[last]], self.open[place[last]] = score[last], ids[last], False


def search_cell(q_id, q, floor, floor_id, x_id, x, turn, k: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of what beats each query's floor among the candidates ``x``, at most ``k`` a query."""
    cell = Cell(q_id, q, floor, floor_id, turn, k)
    order = np.lexsort((x_id, -lengths(x)))
    for a in range(0, len(order), tile):
        if not cell.feed(x_id[order[a : a + tile]], x[order[a : a + tile]]):
            break
    place, ids, score = cell.best
    return q_id[place], ids, score


def blocks_of(vectors: DataFrame, parts: int, block_rows: int, chunk: int = 1024) -> DataFrame:
    """(dim, block, most, ids, x): chunks of the vectors in descending length; ``x`` holds their components as doubles.

    A block is a stretch of whole range partitions, about ``block_rows`` rows long.
    """

    def pack(batches):
        at, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= chunk:
                yield one(at, held.iloc[:chunk])
                held = held.iloc[chunk:]
        if held is not None and len(held):
            yield one(at, held)

    def one(at, pdf):
        groups = [(dim, g) for dim, g in pdf.groupby("dim", sort=False)]
        return pd.DataFrame({"part": at, "dim": [d for d, _ in groups], "most": [g["len"].max() for _, g in groups], "n": [len(g) for _, g in groups], "ids": [g["id"].tolist() for _, g in groups], "x": [np.stack(g["v"]).astype("<f8").tobytes() for _, g in groups]})

    order = [F.desc("dim"), F.desc("len"), "id"]
    dealt = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = cut(dealt.mapInPandas(pack, "part int, dim int, most double, n long, ids array<long>, x binary"))
    sizes = packed.groupBy("dim", "part").agg(F.sum("n").alias("n"))  # one row a range partition
    before = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("dim", "part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block_rows).cast("int").alias("block"))
    dense = sizes.withColumn("block", F.dense_rank().over(Window.partitionBy("dim").orderBy("block")) - 1)
    return packed.join(broadcast_if_small(dense), ["dim", "part"]).select("dim", "block", "most", "ids", "x")


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20, scale: float = 64.0, block_rows: int = 16_384, query_rows: int = 1_024, sample_rows: int = 4_096) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` highest products of every query row with all other rows.

    Queries are the rows whose id is divisible by ``query_every``. Ties go to the smaller id.
    """
    vectors = cut(whole_vectors(df, id_col, vector_col, scale))
    turns = rotation(vectors, sample_rows)
    total = vectors.count()
    chunks = cut(blocks_of(vectors, max(1, -(-total // block_rows)), block_rows))
    wave = F.when(F.col("block") == 0, 0).otherwise(F.floor(F.log(4.0, F.col("block") + 0.5)) + 1).cast("int")
    heads = cut(chunks.groupBy("dim", "block").agg(F.max("most").alias("most")).withColumn("wave", wave))
    slots = max(1, -(-total // (query_every * query_rows)))
    queries = vectors.filter(F.col("id") % query_every == 0).groupBy("id", "dim").agg(F.max(F.struct("v", "len")).alias("m"))
    queries = cut(queries.select("id", "dim", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot"), F.col("m.v").alias("v"), F.col("m.len").alias("len")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "id": [], "score": []}).astype(np.int64)
        dim = int(left["q_dim"].iloc[0])
        x = np.concatenate([np.frombuffer(b, "<f8") for b in right["x"]]).reshape(-1, dim)
        x_id = np.concatenate([np.asarray(i, np.int64) for i in right["ids"]])
        found = search_cell(left["id"].to_numpy(np.int64), np.stack(left["v"]), left["floor"].to_numpy(np.int64), left["floor_id"].to_numpy(np.int64), x_id, x, turns.get(dim), k)
        return pd.DataFrame(dict(zip(("q", "id", "score"), found)))

    best, last = None, heads.agg(F.max("wave")).first()[0]
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    for at in range(0 if last is None else last + 1):
        floored = queries.withColumn("floor", F.lit(LONG.min)).withColumn("floor_id", F.lit(LONG.max))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("f"), F.col("id").alias("fi"))
            floored = queries.join(kth, "id", "left").withColumn("floor", F.coalesce("f", F.lit(LONG.min))).withColumn("floor_id", F.coalesce("fi", F.lit(LONG.max)))
        # the length a vector needs to reach the lowest bar of a slot
        bar = F.when(F.col("floor_id") == LONG.max, float("-inf")).when(F.col("len") > 0, (F.col("floor") - 1e-6) / F.col("len") * (1 - F.signum("floor") * 1e-9)).otherwise(float("-inf"))
        slot = floored.groupBy("dim", "slot").agg(F.min(bar).alias("bar"))
        cells = slot.join(heads.filter(F.col("wave") == at), "dim").filter(F.col("most") + 1e-6 >= F.col("bar")).select("dim", "slot", "block")  # slots by blocks, not queries by rows
        cells = broadcast_if_small(cut(cells))
        left = floored.join(cells, ["dim", "slot"]).select(F.col("dim").alias("q_dim"), F.col("slot").alias("q_slot"), F.col("block").alias("q_block"), "id", "v", "floor", "floor_id")
        right = chunks.join(cells, ["dim", "block"]).select("dim", "slot", "block", "ids", "x")
        found = left.groupBy("q_dim", "q_slot", "q_block").cogroup(right.groupBy("dim", "slot", "block")).applyInPandas(search, FOUND)
        merged = found if best is None else best.select("q", "id", "score").unionByName(found)
        best = cut(merged.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k))
    if best is None:
        best = df.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    return best.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
