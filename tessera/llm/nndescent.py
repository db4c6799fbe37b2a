"""Embedding near duplicates by NN-descent.

Vectors of one label are sorted along a few random directions and compared inside runs of neighbours, which starts a
graph of each vector's ``k`` nearest. Rounds of neighbours-of-neighbours joins refine it. Neighbour lists whose every
entry passes the threshold are saturated: they may miss links. Such a list is enlarged to all members of its class (the
component of threshold links found so far), compared exactly in tiles. Before that, members of saturated classes are
searched again among each other, so that classes which touch are joined. Rounds go on until links stop coming. Every
attempt is audited label by label against a blocked full search for a sample of its vectors, saturated classes apart, and by
the mean share a linked vector keeps; below ``target`` another start and more rounds follow. A label that is still below it,
or whose sample holds too few linked vectors to tell, is compared whole in tiles. The audit's recall is told for each row.

Defined results: null, empty, zero or non-finite vectors, and rows whose label or id is null, link with nothing; they
are returned with no links (a null id has a null component). Vectors of different length don't link. Rows repeating an
id count as separate vectors, of which the one with most links gives n_links, and share a component. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import matrices
from tessera.operators.components import connected_components
from tessera.session import cut

PAIRS = "a long, b long, sim double"
EMPTY = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sim": np.zeros(0)})


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(key, id, part, v): rows that can link, scaled to length one in double precision; part holds label and length.

    ``key`` numbers the rows, so that rows repeating an id stay apart. The result is checkpointed, which fixes the numbers.
    """

    def run(batches):
        for batch in batches:
            for dim, at, x in matrices(batch.column(2)):
                top = np.abs(x).max(axis=1)
                at, x, top = at[top > 0], x[top > 0], top[top > 0]
                x = x / top[:, None]
                v = x / np.linalg.norm(x, axis=1)[:, None]
                ids, label = (batch.column(i).to_numpy(zero_copy_only=False)[at].astype(np.int64) for i in (0, 1))
                flat = pa.array(v.ravel(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(np.full(len(at), dim, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), flat)], names=["id", "label", "dim", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col)).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    made = rows.filter("id is not null and label is not null and size(x) > 0").mapInArrow(run, "id long, label long, dim int, v array<double>")
    return cut(made.select(F.monotonically_increasing_id().alias("key"), "id", F.xxhash64("label", "dim").alias("part"), "v"))


def _best(row: np.ndarray, sims: np.ndarray, k: int) -> pd.DataFrame:
    """The k most similar others of each row in a block of all-pairs similarities."""
    n = len(row)
    np.fill_diagonal(sims, -2.0)
    k = min(k, n - 1)
    if k < 1:
        return EMPTY
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    a = np.repeat(np.arange(n), k)
    return pd.DataFrame({"a": row[a], "b": row[top.ravel()], "sim": sims[a, top.ravel()]})


def start(vectors: DataFrame, k: int, passes: list[int], block: int, rows: int) -> DataFrame:
    """Neighbour candidates: vectors sorted along random directions (one set a pass), all pairs inside runs."""
    made = None
    for seed in passes:
        def code(batches, seed=seed):
            for pdf in batches:
                keys = np.zeros(len(pdf), np.int64)
                fine = np.zeros(len(pdf))
                dims = pdf["v"].str.len().to_numpy()
                for d in np.unique(dims):
                    turn = np.random.default_rng([seed, int(d)]).normal(size=(int(d), 9))
                    at = np.flatnonzero(dims == d)
                    p = np.stack(pdf["v"].iloc[at]) @ turn
                    keys[at] = ((p[:, :8] > 0) << np.arange(8)).sum(1)
                    fine[at] = p[:, 8]
                yield pdf.assign(code=keys, fine=fine)

        def runs(batches, k=k):
            rest = None
            for pdf in batches:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                while len(pdf) >= 2 * block:
                    yield near(pdf.iloc[:block], k)
                    pdf = pdf.iloc[block // 2 :].reset_index(drop=True)  # runs overlap by a half
                rest = pdf
            if rest is not None and len(rest):
                for a in range(0, max(1, len(rest) - block // 2), block // 2):
                    yield near(rest.iloc[a : a + block], k)

        def near(pdf, k):
            out = []
            for _, g in pdf.groupby("part", sort=False):
                v = np.stack(g["v"])
                out.append(_best(g["key"].to_numpy(), v @ v.T, k))
            return pd.concat(out) if out else EMPTY

        coded = vectors.select("key", "part", "v").mapInPandas(code, "key long, part long, v array<double>, code long, fine double")
        parts = max(1, rows // 8192)
        dealt = coded.repartitionByRange(parts, "part", "code", "fine", "key").sortWithinPartitions("part", "code", "fine", "key")
        found = dealt.mapInPandas(runs, PAIRS)
        made = found if made is None else made.unionByName(found)
    return made


def top_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def refine(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """One NN-descent round: the members of every neighbourhood (both directions) are compared with each other.

    Of a vector that many name as neighbour, 2k of the reverse edges are used here, chosen by hash in salted parts;
    links this leaves out are the tiles' work.
    """
    def few(df: DataFrame, by: list[str], most: int) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("a", "b")))).filter(F.col("n") <= most)

    salted = few(graph.select("a", "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(32))), ["b", "salt"], 2 * k)
    used = few(salted, ["b"], 2 * k).select("a", "b")
    both = used.unionByName(used.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(used.select("a", F.col("a").alias("b"))).distinct()
    worst = graph.groupBy("a").agg(F.min("sim").alias("worst"), F.count("*").alias("have"))
    worst = worst.select(F.col("a").alias("b"), F.when(F.col("have") >= k, F.col("worst")).otherwise(-2.0).alias("worst"))
    hoods = both.join(worst, "b").join(vectors.select(F.col("key").alias("b"), "v"), "b").select("a", "b", "worst", "v")

    def compare(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            a = pdf["a"].to_numpy()
            ends = np.flatnonzero(a[1:] != a[:-1]) + 1
            done = int(ends[-1]) if len(ends) else 0
            yield from groups(pdf.iloc[:done], ends[:-1])
            rest = pdf.iloc[done:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from groups(rest, np.zeros(0, int))

    def groups(pdf, ends):
        if not len(pdf):
            return
        member, worst_, v = pdf["b"].to_numpy(), pdf["worst"].to_numpy(), np.stack(pdf["v"])
        left, right, sim = [], [], []
        for s, e in zip([0, *ends], [*ends, len(pdf)]):
            sims = v[s:e] @ v[s:e].T
            np.fill_diagonal(sims, -2.0)
            i, j = np.nonzero(sims > worst_[s:e, None])
            left.append(member[s:e][i])
            right.append(member[s:e][j])
            sim.append(sims[i, j])
        yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right), "sim": np.concatenate(sim)})

    found = hoods.repartition("a").sortWithinPartitions("a").mapInPandas(compare, PAIRS)
    return top_neighbours(graph.select("a", "b", "sim").unionByName(found), k)


def _spread(members: DataFrame, by: str, tile) -> DataFrame:
    """``members`` (by, key, v) dealt into tiles, a copy for each pair of tiles (t1 <= t2) of its group."""
    sizes = members.groupBy(by).agg(F.count("*").alias("size"))
    dealt = members.join(sizes, by).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select(by, F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "key", "v")
    return spread.repartition(by, "t1", "t2")  # else the joins' partitioning by group alone would serve, and a group be one task


def _near_blocks(pdf: pd.DataFrame, threshold: float):
    """(rows, columns, links between them) of one pair of tiles, some rows at a time."""
    v, left = np.stack(pdf["v"]), (pdf["own"] == pdf["t1"]).to_numpy()
    same = int(pdf["t1"].iloc[0]) == int(pdf["t2"].iloc[0])
    rows, cols = np.flatnonzero(left), np.arange(len(v)) if same else np.flatnonzero(~left)
    for a in range(0, len(rows), 512):
        some = rows[a : a + 512]
        near = v[some] @ v[cols].T >= threshold
        if same:
            near[np.arange(len(near)), some] = False
        yield some, cols, near, same


def tile_counts(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(key, n_links): for members (class, key, v), links inside the class counted in tiles, never listed."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(pdf), np.int64)
        for rows, cols, near, same in _near_blocks(pdf, threshold):
            n[rows] += near.sum(1)
            if not same:
                n[cols] += near.sum(0)
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "n": n})

    return _spread(members, "class", tile).groupBy("class", "t1", "t2").applyInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n_links"))


def exact_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """(key, component, n_links) of every vector (part, key, v) with a link: all pairs of a part are compared, in tiles.

    Each pair of tiles reports its counts and a spanning forest of its links. Tiles grow with the part, so that few
    copies of a vector travel, up to what a worker holds.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        key, parent = pdf["key"].to_numpy(), np.arange(len(pdf))
        n, src, dst = np.zeros(len(pdf), np.int64), [], []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for rows, cols, near, same in _near_blocks(pdf, threshold):
            n[rows] += near.sum(1)
            if not same:
                n[cols] += near.sum(0)
            for i in np.flatnonzero(near.any(1)):
                linked, a = cols[near[i]], root(int(rows[i]))
                for j in linked[parent[linked] != a]:
                    b = root(int(j))
                    if a != b:
                        parent[b] = a
                        src.append(a), dst.append(b)
                parent[linked] = a
        held, src, dst = np.flatnonzero(n), np.array(src, np.int64), np.array(dst, np.int64)
        other = pd.array([*[None] * len(held), *key[dst]], "Int64")
        return pd.DataFrame({"a": np.r_[key[held], key[src]], "b": other, "n": np.r_[n[held], np.zeros(len(src), np.int64)]})

    tile = F.least(F.greatest(F.col("size") / 16, F.lit(1024)), F.lit(16_384))
    made = cut(_spread(vectors.select("part", "key", "v"), "part", tile).groupBy("part", "t1", "t2").applyInPandas(compare, "a long, b long, n long"))
    counts = made.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    roots = connected_components(made.filter("b is not null"), "a", "b")
    return counts.join(roots, F.col("key") == F.col("node")).select("key", "component", "n_links")


def audit(vectors: DataFrame, counts: DataFrame, threshold: float, target: float, sample: int, least: int, chunk: int = 8192) -> DataFrame:
    """(part, proved, low, recall): of each part, whether ``counts`` (key, n_links, hot) is proved whole enough, or shown not to be.

    Of a part's hot vectors and of its others, about ``sample`` each are drawn by hash and compared with the whole part. Each
    needs at least ``least`` of them with links, and these need to have kept a mean share of ``target`` of their links.
    Where all vectors were drawn, none may have lost a link.
    """
    known = vectors.select("part", "key", "v").join(counts, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    strata = known.groupBy("part", "hot").agg(F.count("*").alias("size"))
    parts = strata.groupBy("part").agg(F.ceil(F.sum("size") / chunk).cast("int").alias("chunks"))
    drawn = known.join(strata, ["part", "hot"]).filter(F.pmod(F.xxhash64("key", F.lit(11)), F.col("size")) < sample)
    drawn = drawn.join(parts, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    whole = vectors.join(parts, "part").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(12)), F.col("chunks")).cast("int"))
    both = drawn.select("part", "chunk", F.lit(True).alias("drawn"), "key", "v").unionByName(whole.select("part", "chunk", F.lit(False).alias("drawn"), "key", "v"))

    def full(pdf: pd.DataFrame) -> pd.DataFrame:
        v, key, own = np.stack(pdf["v"]), pdf["key"].to_numpy(), pdf["drawn"].to_numpy(bool)
        rows, cols = np.flatnonzero(own), np.flatnonzero(~own)
        n = np.zeros(len(rows), np.int64)
        for a in range(0, len(rows), 512):
            some = rows[a : a + 512]
            n[a : a + 512] = ((v[some] @ v[cols].T >= threshold) & (key[some][:, None] != key[cols])).sum(1)
        return pd.DataFrame({"key": key[rows], "n": n})

    true = both.repartition("part", "chunk").groupBy("part", "chunk").applyInPandas(full, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    share = F.when(F.col("n") > 0, F.least("n", F.coalesce("n_links", F.lit(0))) / F.col("n"))
    each = true.join(known.select("part", "hot", "key", "n_links"), "key").join(strata, ["part", "hot"]).groupBy("part", "hot", "size")
    each = each.agg(F.count(share).alias("linked"), F.avg(share).alias("mean"), F.coalesce(F.min(share), F.lit(1.0)).alias("worst"))
    proved = F.when(F.col("size") <= sample, F.col("worst") == 1).otherwise((F.col("linked") >= least) & (F.col("mean") >= target))
    recall = F.sum(F.col("mean") * F.col("linked")) / F.sum("linked")
    low = F.coalesce(F.when(F.col("size") <= sample, F.col("worst") < 1).otherwise((F.col("linked") >= least) & (F.col("mean") < target)), F.lit(False))
    return each.groupBy("part").agg(F.every(F.coalesce(proved, F.lit(False))).alias("proved"), F.some(low).alias("low"), recall.alias("recall"))


def descend(plain: DataFrame, total: int, threshold: float, k: int, rounds: int, passes: int, block: int, tile: int, target: float, audit_rows: int, linked_rows: int, retries: int) -> tuple[DataFrame, DataFrame]:
    """(key, component, n_links) of vectors (key, part, v) by NN-descent, and what the audit says of each part."""
    graph = cut(top_neighbours(start(plain, k, list(range(passes)), block, total), k))
    for attempt in range(retries + 1):
        done, had, now = 0, -1, graph.filter(F.col("sim") >= threshold).count()
        while done < rounds or now > 1.001 * had:  # till links stop coming
            graph = cut(refine(graph, plain, k))
            done, had, now = done + 1, now, graph.filter(F.col("sim") >= threshold).count()
        links = graph.filter(F.col("sim") >= threshold)
        roots = cut(connected_components(links, "a", "b"))
        full = links.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        full = full.join(roots, full["a"] == roots["node"]).select(F.col("component").alias("class")).distinct()
        crowd = roots.select(F.col("node").alias("key"), F.col("component").alias("class")).join(full, "class")
        crowd = cut(crowd.join(plain, "key"))
        # saturated classes that touch: their members are sorted and compared along fresh directions
        again = start(crowd.select("key", "part", "v"), k, [100 + passes * attempt + i for i in range(2)], block, total)
        bridge = again.filter(F.col("sim") >= threshold).select("a", "b")
        roots = cut(connected_components(links.select("a", "b").unionByName(bridge), "a", "b"))
        wide = crowd.select("key", "v").join(roots, F.col("key") == F.col("node")).select(F.col("component").alias("class"), "key", "v")
        inside = tile_counts(wide, threshold, tile)
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        listed = both.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("listed"))
        counts = cut(roots.select(F.col("node").alias("key"), "component").join(listed, "key", "left").join(inside, "key", "left").select("key", "component", F.coalesce("n_links", "listed", F.lit(0)).alias("n_links"), F.col("n_links").isNotNull().alias("hot")))
        told = cut(audit(plain, counts.select("key", "n_links", "hot"), threshold, target, audit_rows, linked_rows))
        low = plain.join(told.filter("low"), "part", "left_semi")
        if attempt == retries or low.isEmpty():
            break
        fresh = start(low, k, [10 * (attempt + 1) + i for i in range(passes)], block, total)
        graph = cut(top_neighbours(graph.select("a", "b", "sim").unionByName(fresh), k))
    return counts.select("key", "component", "n_links"), told


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, k: int = 10, rounds: int = 2, passes: int = 4, block: int = 256, tile: int = 2048, target: float = 0.97, audit_rows: int = 2048, linked_rows: int = 64, retries: int = 3) -> DataFrame:
    """(id, n_links, component, kept, recall) of every row; links are pairs of equal label with cosine >= ``threshold``.

    ``recall`` is what the audit of the rounds measured for the row's label, before anything was compared whole; null where no
    vector that it drew has a link.
    """
    vectors = unit_vectors(df, id_col, vector_col, label_col)
    plain = vectors.select("key", "part", "v")
    total = plain.count()
    found, told = descend(plain, total, threshold, k, rounds, passes, block, tile, target, audit_rows, linked_rows, retries)
    proved = told.filter("proved").select("part")
    kept = plain.join(proved, "part", "left_semi").select("key")
    # what the audit doesn't prove is compared whole
    exact = exact_links(plain.join(proved, "part", "left_anti"), threshold)
    counts = cut(exact.unionByName(found.join(kept, "key", "left_semi")))
    # keys back to ids: a component is named by the smallest id in it, over all its rows
    named = vectors.select("key", "id").join(counts, "key")
    least = named.groupBy("component").agg(F.min("id").alias("first"))
    named = named.join(least, "component").select("id", "key", "n_links", "first")
    recalls = vectors.select("id", "part").join(told.select("part", "recall"), "part").groupBy("id").agg(F.min("recall").alias("recall"))
    per_id = named.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("first").alias("first"))
    rows = df.select(F.col(id_col).cast("long").alias("id"))
    out = rows.join(per_id, "id", "left").join(recalls, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component_id"), "recall")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), "recall")
