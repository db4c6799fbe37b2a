"""SimHash near duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are read as 32 two-bit segments, and its embedding is the vector of their bit counts. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. The range join at
distance 3 runs on a grid: the vector is dealt into six blocks of segments, and two vectors within distance 3 agree on
at least three whole blocks, so each of the 20 block triples gives one grid cell per fingerprint. Within a cell, pairs
must pass the Manhattan bound, then the exact Hamming distance. Only distinct fingerprints enter the grid. A cell with
more than ``tile`` fingerprints is compared tile by tile in separate groups, and each group reports a spanning forest
of its links, so no cell of any size is collected whole or expanded into all pairs.

:func:`keep_first` serves a filtering stage, by five-word shingles and a Jaccard similarity of 0.8: fingerprints so wide
apart have no selective grid, so texts meet in passages they share instead, pass by the same bounds, and are then compared by
their whole shingle sets.

Defined results: null, empty and word-free texts have fingerprint zero and link like any other; rows with a null id
keep their fingerprint, link nothing and have a null component; repeated rows each have a row; texts that share an id link
by what each of them is; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import chain, combinations, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import append, long, over_texts, slices
from tessera.operators.components import connected_components
from tessera.session import broadcast_if_small, cut, stored, without_columns

SEED, SHINGLE, BLOCKS = 42, 3, 6
#: The segments (two bits each, lowest bits first) of every block.
DEAL = [[s for s in range(32) if s % BLOCKS == b] for b in range(BLOCKS)]
LOW = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) or [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65_536):
        part = grams[at : at + 65_536]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(grams)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """``docs`` with a long column fp."""
    return append(docs, text_col, [long("fp")], lambda: lambda texts: [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], keep_text)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, still packed two bits each."""
    x = fp.view(np.uint64)
    return (x & LOW) + ((x >> np.uint64(1)) & LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of packed two-bit counts, for arrays that broadcast together."""
    up = np.uint64(0xAAAAAAAAAAAAAAAA)
    d = a ^ b  # 0: equal; 01, 11: one apart (0-1, 1-2); 10: two apart (0-2)
    odd = d & LOW
    two = ((d & up) >> np.uint64(1)) & ~odd & LOW
    return np.bitwise_count(odd).astype(np.int16) + 2 * np.bitwise_count(two).astype(np.int16)


def cells(fp: DataFrame) -> DataFrame:
    """``fp`` (fp, rep) exploded to its 20 grid cells, each named by a 64-bit number."""
    masks = []
    for triple in combinations(range(BLOCKS), 3):
        bits = sum(3 << (2 * s) for b in triple for s in DEAL[b])
        masks.append(bits - (1 << 64) if bits >= 1 << 63 else bits)
    low = F.lit(int(LOW))
    first, second = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    counts = F.shiftleft(first.bitwiseAND(second), 1).bitwiseOR(first.bitwiseXOR(second))  # a carry without overflow
    keyed = fp.withColumn("counts", counts)
    named = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return keyed.select("fp", "rep", F.explode(named).alias("cell"))


def _forest(fp: np.ndarray, rep: np.ndarray, left: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges that connect the linked rows of one group. ``left``: rows that start a comparison."""
    order = np.argsort(fp, kind="stable")
    fp, rep, left = fp[order], rep[order], left[order]
    counts, parent = popcounts(fp), np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    src, dst = [], []
    for i in np.flatnonzero(left):
        near = np.flatnonzero(manhattan(counts, counts[i]) <= distance)
        near = near[np.bitwise_count((fp[near] ^ fp[i]).view(np.uint64)) <= distance]
        a = root(int(i))
        for j in near[parent[near] != a]:
            b = root(int(j))
            if a != b:
                parent[b] = a
                src.append(int(rep[a])), dst.append(int(rep[b]))
        parent[near] = np.where(parent[near] == near, parent[near], a)
    return src, dst


def links(fp: DataFrame, distance: int = 3, tile: int = 4096, bucket_rows: int = 100_000) -> DataFrame:
    """(src, dst) between representatives: enough links to connect all fingerprints within ``distance``.

    ``fp`` (fp, rep) must be cheap to read again. Cells meet the workers in about ``bucket_rows`` rows at a time.
    """
    placed = cells(fp)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    both = placed.join(sizes, "cell")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    both = both.withColumn("tiles", tiles).withColumn("own", own)
    spread = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("cell", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "fp", "rep")
    buckets = F.pmod(F.xxhash64("cell", "t1", "t2"), F.lit(max(32, 20 * fp.count() // bucket_rows))).cast("int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "t1", "t2"], kind="stable")
        cell, t1, t2, own_, fps, reps = (pdf[c].to_numpy() for c in ("cell", "t1", "t2", "own", "fp", "rep"))
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])])
        sizes = np.diff(np.r_[starts, len(cell)])
        a = starts[sizes == 2]  # by far the most groups, compared together
        a = a[manhattan(popcounts(fps[a]), popcounts(fps[a + 1])) <= distance]
        a = a[np.bitwise_count((fps[a] ^ fps[a + 1]).view(np.uint64)) <= distance]
        src, dst = reps[a].tolist(), reps[a + 1].tolist()
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            part = slice(at, at + n)
            s, d = _forest(fps[part], reps[part], own_[part] == t1[at], distance)
            src += s
            dst += d
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return spread.groupBy(buckets.alias("bucket")).applyInPandas(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """(id, fp, component) of every document; component is the smallest id reachable by links."""
    prints = cut(fingerprints(docs.select(id_col, text_col), text_col, keep_text=False).select(F.col(id_col).cast("long").alias("id"), "fp"))
    fp = cut(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    roots = connected_components(cut(links(fp, distance)))
    classes = fp.join(roots, fp["rep"] == roots["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    joined = prints.join(classes, "fp", "left")
    return joined.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def _cut_at(h: np.ndarray, every: int) -> np.ndarray:
    """Passages of a shingle sequence as hashes; one ends behind every shingle whose hash is divisible by ``every``."""
    if not len(h):
        return np.zeros(1, np.int64)
    ends = np.flatnonzero(h % np.uint64(every) == 0) + 1
    starts = np.r_[0, ends[ends < len(h)]]
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    mixed = (h ^ (h >> np.uint64(29))) * (2 * place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(np.add.reduceat(mixed, starts)).view(np.int64)


def _shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)


def _bits(h: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0])


def sketches(rows: DataFrame, shingle: int, every: int) -> DataFrame:
    """(id, k0, k1, n, f0, f1, cells) of rows (id, k0, k1, text): distinct shingles, two fingerprints, passage hashes."""

    def run(batches):
        for batch in slices(batches):
            made = []
            for text in batch.column(3).to_pylist():
                h = _shingle_hashes(text, shingle)
                once = np.unique(h)
                with np.errstate(over="ignore"):
                    other = (once ^ (once >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
                made.append((len(once), _bits(once), _bits(other ^ (other >> np.uint64(28))), _cut_at(h, every)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *[pa.array([m[i] for m in made], pa.int64()) for i in range(3)], pa.array([m[3] for m in made], pa.list_(pa.int64()))], names=["id", "k0", "k1", "n", "f0", "f1", "cells"])

    return over_texts(rows, run, "id long, k0 long, k1 long, n long, f0 long, f1 long, cells array<long>")


def likely_links(texts: DataFrame, similarity: float, share: float = 0.25, tile: int = 2048, bucket_rows: int = 100_000) -> DataFrame:
    """(src, dst) between nodes of ``texts`` (node, n, f0, f1, cells) that are likely to be as similar as asked.

    Two texts meet in a passage they share, if it is not among the ``share`` of their own passages that most texts
    hold: texts that have more than that share of their passages in common meet in another one. They meet only where
    their numbers of shingles allow the similarity, and pass by the Manhattan bound, then the Hamming distance of both fingerprints, which
    may differ in as many bits as the similarity makes likely and three standard deviations more. A group reports a
    spanning forest of its links; one of more than ``tile`` texts is compared tile by tile.
    """
    angle = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    most = int(np.ceil(128 * angle + 3 * np.sqrt(128 * angle * (1 - angle))))
    placed = texts.select("node", F.explode("cells").alias("cell"))
    often = placed.groupBy("cell").agg(F.count("*").alias("often")).filter("often > 1")
    shared = placed.join(often, "cell")  # what else a text has meets its rows by node, where the window puts them
    own = Window.partitionBy("node")
    # passages that no other text holds are the rarest; they have no row here
    ranked = shared.withColumn("at", F.row_number().over(own.orderBy("often", "cell"))).withColumn("held", F.count("*").over(own))
    rare = ranked.join(texts.select("node", "n", "f0", "f1", F.size("cells").alias("m")), "node").filter(F.col("at") + F.col("m") - F.col("held") <= F.ceil(F.col("m") * (1 - share)))
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / float(-np.log(similarity))).cast("int")
    tiles = F.ceil(F.col("often") / F.lit(tile)).cast("int")
    rows = rare.withColumn("size", step).withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    spread = rows.withColumn("step", F.explode(F.array(F.col("size"), F.col("size") - 1))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("cell", "step", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "size", "node", "n", "f0", "f1")
    group = F.xxhash64("cell", "step", "t1", "t2")
    buckets = F.pmod(group, F.lit(max(32, 20 * texts.count() // bucket_rows))).cast("int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "n"], kind="stable")
        g, n, f0, f1, node, own_, t1, size, step_ = (pdf[c].to_numpy() for c in ("g", "n", "f0", "f1", "node", "own", "t1", "size", "step"))
        c0, c1 = popcounts(f0), popcounts(f1)

        def near(i, j):
            close = manhattan(c0[i], c0[j]) + manhattan(c1[i], c1[j]) <= most
            close &= np.bitwise_count((f0[i] ^ f0[j]).view(np.uint64)).astype(np.int16) + np.bitwise_count((f1[i] ^ f1[j]).view(np.uint64)) <= most
            return close & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))

        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[starts, len(g)])
        a = starts[sizes == 2]
        a = a[near(a, a + 1)]
        src, dst = node[a].tolist(), node[a + 1].tolist()
        for at, k in zip(starts[sizes > 2], sizes[sizes > 2]):
            parent, every = np.arange(k), np.arange(at, at + k)

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i in np.flatnonzero((own_[every] == t1[at]) & (size[every] == step_[at])):
                mine = root(int(i))
                rest = np.flatnonzero(parent != mine)
                linked = rest[near(np.full(len(rest), at + i), at + rest)]
                for j in linked:
                    b = root(int(j))
                    if b != mine:
                        parent[b] = mine
                        src.append(int(node[at + i])), dst.append(int(node[at + j]))
                parent[linked] = mine
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return spread.withColumn("g", group).groupBy(buckets.alias("bucket")).applyInPandas(run, "src long, dst long").distinct()


class Places:
    """Which texts hold a shingle: sorted arrays of 12 bytes an entry, and lists for the few that came last."""

    def __init__(self):
        self.keys, self.texts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.last, self.n = defaultdict(list), 0

    def add(self, shingles: np.ndarray, text: int) -> None:
        for x in shingles.tolist():
            self.last[x].append(text)
        self.n += len(shingles)
        if self.n > 4096 + len(self.keys) // 4:
            keys = np.fromiter(chain.from_iterable(repeat(x, len(t)) for x, t in self.last.items()), np.int64, self.n)
            keys, texts = np.r_[self.keys, keys], np.r_[self.texts, np.fromiter(chain.from_iterable(self.last.values()), np.int32, self.n)]
            order = np.argsort(keys, kind="stable")
            self.keys, self.texts = keys[order], texts[order]
            self.last, self.n = defaultdict(list), 0

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """The texts of all ``shingles``, repeats included."""
        lo, hi = np.searchsorted(self.keys, shingles), np.searchsorted(self.keys, shingles, "right")
        n = hi - lo
        old = self.texts[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.r_[old, np.fromiter(chain.from_iterable(self.last.get(x, ()) for x in shingles.tolist()), np.int32)]


class Heads:
    """Shingle sets of texts that stay, kept by how they differ from what most texts of their class hold.

    Of the core, the shingles of more than half of ``sample``, a text notes those it lacks; shingles outside are noted as they are.
    Both are few in near copies, so that many such texts are compared at once by counting short lists.
    """

    def __init__(self, similarity: float, sample: list[np.ndarray]):
        held, times = np.unique(np.concatenate([*sample, np.zeros(0, np.int64)]), return_counts=True)
        self.core = held[2 * times > len(sample)]
        self.similarity, self.n = similarity, 0
        self.sizes, self.lacks = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.where = (Places(), Places())  # by core shingle lacked, by other shingle held

    def _parts(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.setdiff1d(self.core, shingles, assume_unique=True), np.setdiff1d(shingles, self.core, assume_unique=True)

    def like(self, shingles: np.ndarray) -> bool:
        """Whether a text that stays is as similar as asked."""
        if not self.n:
            return False
        parts = self._parts(shingles)
        places = np.concatenate([where.of(part) for where, part in zip(self.where, parts)])
        both = len(self.core) - len(parts[0]) - self.lacks[: self.n] + np.bincount(places, minlength=self.n)
        return bool((both >= self.similarity * (self.sizes[: self.n] + len(shingles) - both)).any())

    def add(self, shingles: np.ndarray) -> None:
        if self.n == len(self.sizes):
            self.sizes, self.lacks = np.r_[self.sizes, self.sizes * 0], np.r_[self.lacks, self.lacks * 0]
        parts = self._parts(shingles)
        for where, part in zip(self.where, parts):
            where.add(part, self.n)
        self.sizes[self.n], self.lacks[self.n] = len(shingles), len(parts[0])
        self.n += 1


def dropped_texts(docs: DataFrame, texts: DataFrame, shingle: int, similarity: float, bound: int = 500_000) -> DataFrame:
    """(node) of texts to drop: each has a Jaccard similarity of at least ``similarity`` with a text that stays.

    Links only name candidates. In a round the texts of smallest id in each class, as many as hold ``bound`` shingles together (one
    at least), are compared by their whole shingle sets in order of id: a text stays unless it is as similar to one that does.
    The rest of the class is compared with those that stay, in tiles; who is like none of them goes on to the next round.
    """
    roots = cut(connected_components(cut(likely_links(texts, similarity))))
    left = stored(texts.join(broadcast_if_small(roots), "node").select("node", "id", "k0", "k1", "n", F.col("component").alias("class")))

    def sets(batches):
        for batch in slices(batches):
            made = [np.unique(_shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    held = docs.join(broadcast_if_small(left.select("node", "id", "k0", "k1")), ["id", "k0", "k1"]).select("node", "text").dropDuplicates(["node"])
    held = stored(over_texts(held, sets, "node long, shingles array<long>"))

    def among(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "k0", "k1"])
        every, stays = [np.asarray(x, np.int64) for x in pdf["shingles"]], []
        heads = Heads(similarity, every)
        for x in every:
            stays.append(not heads.like(x))
            if stays[-1]:
                heads.add(x)
        return pd.DataFrame({"class": pdf["class"], "node": pdf["node"], "stays": stays})

    def against(members: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        known = [np.asarray(x, np.int64) for x in some["whole"]]
        heads = Heads(similarity, known)
        for x in known:
            heads.add(x)
        return pd.DataFrame({"node": members["node"].to_numpy(np.int64), "like": np.array([heads.like(np.asarray(x, np.int64)) for x in members["shingles"]], bool)})

    def first(df: DataFrame, by: list[str]) -> DataFrame:
        run = F.sum("n").over(Window.partitionBy(*by).orderBy("id", "k0", "k1", "node").rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("run", F.coalesce(run, F.lit(0))).filter(F.col("run") <= bound).drop("run")

    gone = []
    while not left.isEmpty():
        salted = first(left.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64))), ["class", "salt"])
        heads = stored(first(salted, ["class"]).select("class", "node", "id", "k0", "k1"))
        told = stored(heads.join(held, "node").groupBy("class").applyInPandas(among, "class long, node long, stays boolean"))
        gone.append(told.filter("not stays").select("node"))
        rest = left.join(heads.select("node"), "node", "left_anti")
        sizes = stored(rest.groupBy("class").agg(F.ceil(F.sum("n") / F.lit(8 * bound)).cast("int").alias("tiles")))
        if sizes.isEmpty():
            break
        rest = stored(rest)
        members = rest.join(sizes, "class").join(held, "node").select("class", F.pmod(F.xxhash64("node"), "tiles").alias("tile"), "node", "shingles")
        known = told.filter("stays").join(sizes, "class").join(held, "node").select(F.col("class").alias("h_class"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)).alias("h_tile"), F.col("shingles").alias("whole"))
        met = stored(members.groupBy("class", "tile").cogroup(known.groupBy("h_class", "h_tile")).applyInPandas(against, "node long, like boolean"))
        gone.append(met.filter("like").select("node"))
        left = stored(rest.join(met.filter("not like").select("node"), "node", "left_semi"))
    return reduce(DataFrame.unionByName, gone) if gone else docs.sparkSession.createDataFrame([], "node long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, every: int = 10) -> DataFrame:
    """``docs`` less copies and near copies: texts whose sets of ``shingle`` words have a Jaccard similarity of ``similarity``.

    Of equal texts the row of smallest id stays, once; of texts as similar as asked the one of smallest id, and every
    text that goes is that similar to one that stays. Texts without a word are equal to each other in this sense. Rows that share
    an id but not the text are told apart. Rows with a null id stay. An empty table gives an empty result; extra columns stay.
    """
    key = [F.xxhash64(F.lit(i), F.col(text_col)) for i in (0, 1)]
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), key[0].alias("k0"), key[1].alias("k1"), F.col(text_col).alias("text"))
    made = cut(sketches(rows, shingle, every))
    rest = F.struct("id", "n", "f0", "f1", "cells")
    texts = made.groupBy("k0", "k1").agg(F.min_by(rest, "id").alias("x")).select("k0", "k1", "x.*")
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()))
    gone = dropped_texts(rows, texts, shingle, similarity)
    stay = texts.join(gone, "node", "left_anti").select("id", "k0", "k1", F.lit(True).alias("stays"))
    told = cut(made.groupBy("id", "k0", "k1").agg(F.count("*").alias("times")).join(stay, ["id", "k0", "k1"], "left"))
    out = broadcast_if_small(told.filter("stays is null or times > 1").select(F.col("id").alias("__id"), F.col("k0").alias("__k0"), F.col("k1").alias("__k1"), F.coalesce("stays", F.lit(False)).alias("__once")))
    base = without_columns(docs, ["__id", "__k0", "__k1", "__once"])
    same = (F.col(id_col).cast("long") == F.col("__id")) & (key[0] == F.col("__k0")) & (key[1] == F.col("__k1"))
    joined = base.join(out, same, "left")
    once = joined.filter("__once").dropDuplicates(["__id", "__k0", "__k1"])
    return joined.filter("__once is null").unionByName(once).select(*[F.col(f"`{c}`") for c in base.columns])
