"""Communities by Leiden's method, written as grouped joins: moves, refinement, aggregation, until nothing moves.

Every step is a few joins and grouped sums over edges, so a hub is pre-aggregated before the shuffle and no component or
community of more than ``whole`` edges meets in one task. What crosses to the driver is a number a step. Graphs and components
of up to ``whole`` edges are parted side by side, each in a task of its own, since a job a step costs more than they do; what
the steps have made of a larger one goes on in a task as soon as it has no more edges than that.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import broadcast_if_small, cut, row_bytes, stored

LEAST = 1e-9  # gains below this are rounding


def _coin(c: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of communities (node, c) over undirected edges (a, b, weight); a self loop counts once, its end's degree twice."""
    c = communities.select("node", "c")
    named = edges.join(c.withColumnsRenamed({"node": "a", "c": "ca"}), "a").join(c.withColumnsRenamed({"node": "b", "c": "cb"}), "b")
    ends = named.select(F.col("ca").alias("c"), "weight", F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inside"))
    ends = ends.unionByName(named.select(F.col("cb").alias("c"), "weight", F.lit(0.0).alias("inside")))
    sums = ends.groupBy("c").agg(F.sum("weight").alias("mass"), F.sum("inside").alias("inside"))
    total, inside, squares = sums.agg(F.sum("mass"), F.sum("inside"), F.sum(F.col("mass") * F.col("mass"))).first()
    return 0.0 if not total else float(2 * inside / total - resolution * squares / (total * total))


def _small(df: DataFrame, rows: int, max_bytes: int = 64_000_000) -> DataFrame:
    """``df`` of about ``rows`` rows, broadcast where those are few."""
    return F.broadcast(df) if rows * row_bytes(df) <= max_bytes else df


def _spread(df: DataFrame, by: str, rows: int = 0, a_task: int = 500_000) -> DataFrame:
    """``df`` dealt by a key to as many tasks as a shuffle has, to more where ``a_task`` of its ``rows`` would be exceeded."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // a_task + 1), by)


def _between(e: DataFrame, edges: int) -> DataFrame:
    """Both directions (node, other, w) of edges that are no loops, stored dealt by node, so that a node's sums are whole before a shuffle."""
    e = e.filter("a <> b")
    both = e.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"), "w"))
    return stored(_spread(both, "node", 2 * edges))


def _moved(near: DataFrame, state: DataFrame, n: int, turn: int, resolution: float) -> DataFrame:
    """``state`` (node, k, m, g, c) after the nodes of one hash half went to the neighbouring community of best gain; with ``gain``,
    what each of them won. The halves change every second turn, which keeps neighbours from trading places."""
    known = state.join(_small(state.groupBy("c").agg(F.sum("k").alias("mass")), n), "c")
    pull = F.lit(resolution / 2) / F.col("m") * F.col("k")
    own = known.select("node", "k", pull.alias("pull"), F.col("c").alias("own"))
    mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
    to = near.filter(mine).join(_small(known.select(F.col("node").alias("other"), "c", "mass"), n), "other")
    scored = to.groupBy("node", "c").agg(F.sum("w").alias("w"), F.first("mass").alias("mass")).join(_small(own, n), "node").withColumn("stays", F.col("c") == F.col("own"))
    scored = scored.withColumn("gain", F.round(F.col("w") - F.col("pull") * (F.col("mass") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)), 9))
    best = scored.groupBy("node").agg(F.max_by(F.struct("c", "gain"), F.struct("gain", "stays", -F.xxhash64("c"))).alias("best"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("had"))
    had = F.coalesce("had", F.round(-pull * (F.col("mass") - F.col("k")), 9))
    joined = known.join(_small(best, n), "node", "left").withColumn("gain", F.col("best.gain") - had)
    goes = F.col("gain") > LEAST
    return joined.select("node", "k", "m", "g", F.when(goes, F.col("best.c")).otherwise(F.col("c")).alias("c"), F.when(goes, F.col("gain")).alias("gain"))


def _moves(near: DataFrame, state: DataFrame, n: int, rounds: int, resolution: float) -> DataFrame:
    """Moves till neither half wins anything, ``rounds`` times both halves at most; modularity never falls below its start."""
    quiet = 0
    for turn in range(2 * rounds):
        made = stored(_moved(near, state, n, turn, resolution))
        quiet = quiet + 1 if made.filter("gain is not null").isEmpty() else 0
        state = made.select("node", "k", "m", "g", "c")
        if quiet == 2:
            break
    return state


def _gaining(near: DataFrame, parts: DataFrame, n: int, resolution: float) -> DataFrame:
    """(p, q, gain) in both directions of adjacent parts of one community that would be better off as one."""
    sizes = parts.groupBy("part").agg(F.sum("k").alias("k"), F.first("m").alias("m"))
    ends = near.join(_small(parts.select("node", F.col("part").alias("p"), F.col("c").alias("cp")), n), "node")
    ends = ends.join(_small(parts.select(F.col("node").alias("other"), F.col("part").alias("q"), F.col("c").alias("cq")), n), "other").filter("cp = cq and p <> q")
    links = ends.groupBy("p", "q").agg(F.sum("w").alias("w"))
    pairs = links.join(_small(sizes.withColumnsRenamed({"part": "p", "k": "kp"}), n), "p").join(_small(sizes.drop("m").withColumnsRenamed({"part": "q", "k": "kq"}), n), "q")
    gain = F.round(F.col("w") - F.lit(resolution / 2) / F.col("m") * F.col("kp") * F.col("kq"), 9)
    return pairs.select("p", "q", gain.alias("gain")).filter(F.col("gain") > LEAST)


def _refined(near: DataFrame, parts: DataFrame, n: int, turn: int, resolution: float) -> DataFrame:
    """``parts`` (node, k, m, g, c, part) after single nodes of tails joined the adjacent part of heads of best positive gain."""
    lone = parts.groupBy("part").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("part").alias("p"))
    pairs = _gaining(near, parts, n, resolution).filter(~_coin(F.col("p"), turn) & _coin(F.col("q"), turn)).join(lone, "p")
    best = pairs.groupBy("p").agg(F.max_by("q", F.struct("gain", -F.xxhash64("q"))).alias("to"))
    return parts.join(best.withColumnRenamed("p", "part"), "part", "left").select("node", "k", "m", "g", "c", F.coalesce("to", "part").alias("part"))


def _paired(gaining: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` after every two that gain most by each other became one; the pair of the highest gain is always among them."""
    tie = F.xxhash64(F.least("p", "q"), F.greatest("p", "q"))
    best = gaining.groupBy("p").agg(F.max_by("q", F.struct("gain", tie)).alias("q"))
    both = best.join(best.select(F.col("q").alias("p"), F.col("p").alias("q")), ["p", "q"]).filter("p > q")
    return parts.join(both.withColumnsRenamed({"p": "part", "q": "to"}), "part", "left").select("node", "k", "m", "g", "c", F.coalesce("to", "part").alias("part"))


def _aggregated(e: DataFrame, parts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are parts, where edges inside a part become a loop, and its state, which starts from the communities."""
    ends = e
    for end in ("a", "b"):
        ends = ends.join(_small(parts.select(F.col("node").alias(end), F.col("part").alias(f"p{end}")), n), end)
    graph = ends.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.sum("w").alias("w"), F.first("g").alias("g"))
    state = parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), *[F.first(x).alias(x) for x in ("m", "g", "c")])
    return stored(graph), stored(state)


def _most(e: DataFrame) -> tuple[int, int]:
    """Edges in all, and of the largest graph."""
    return e.groupBy("g").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()


def _visits(at: np.ndarray, near: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, half: float, inside: np.ndarray | None = None) -> bool:
    """Nodes go, one by one, to the adjacent community of best gain till none wins; whether one went. ``c`` is changed.

    Where ``inside`` is given, only nodes that are alone go, and only to a node of the same value there, so what they form is connected.
    Plain numbers are faster than arrays for nodes of few neighbours, which most are.
    """
    mass, size, moved = np.bincount(c, k, len(k)).tolist(), np.bincount(c, minlength=len(k)).tolist(), False
    of, at, k, within = c.tolist(), at.tolist(), k.tolist(), inside if inside is None else inside.tolist()
    waiting, queue = [True] * len(k), deque(range(len(k)))
    while queue:
        i = queue.popleft()
        waiting[i], own = False, of[i]
        if within is not None and size[own] > 1:
            continue
        js, ws, sums = near[at[i] : at[i + 1]], w[at[i] : at[i + 1]], {}
        if within is None and len(js) > 250:
            kinds, where = np.unique(c[js], return_inverse=True)
            sums = dict(zip(kinds.tolist(), np.bincount(where, ws).tolist()))
        else:
            for j, x in zip(js.tolist(), ws.tolist()):
                if within is None or within[j] == within[i]:
                    to = of[j]
                    sums[to] = sums.get(to, 0.0) + x
        pull, new, most = half * k[i], own, -math.inf
        for to, x in sums.items():
            gain = x - pull * (mass[to] - (k[i] if to == own else 0.0))
            if gain > most or (gain == most and to < new):
                new, most = to, gain
        if new == own or most - (sums.get(own, 0.0) - pull * (mass[own] - k[i])) <= LEAST:
            continue
        moved = True
        mass[own], mass[new], size[own], size[new] = mass[own] - k[i], mass[new] + k[i], size[own] - 1, size[new] + 1
        of[i] = c[i] = new
        if within is None:
            for j in (js[c[js] != new] if len(js) > 250 else js).tolist():
                if of[j] != new and not waiting[j]:
                    waiting[j] = True
                    queue.append(j)
    return moved


def _pieces(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _parted(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, half: float, c: np.ndarray) -> tuple[np.ndarray, bool]:
    """Communities of nodes 0 to n - 1 under edges without loops, from ``c`` on, and whether the first visits moved a node.

    Visits, parts that grow inside the communities, and the parts as nodes; at the end every community is a node and none wants to move.
    """
    where, first = np.arange(len(k)), None
    while True:
        ends, others = np.r_[a, b], np.r_[b, a]
        order = np.argsort(ends, kind="stable")
        at = np.searchsorted(ends[order], np.arange(len(k) + 1))
        graph = at, others[order], np.r_[w, w][order], k
        moved = _visits(*graph, c, half)
        first = moved if first is None else first
        if not moved and len(np.unique(c)) == len(k):
            return where, first
        part = np.arange(len(k))
        _visits(*graph, part, half, inside=c)
        if len(np.unique(part)) == len(k):  # nothing grows: communities become nodes, those in pieces fall apart
            inner = c[a] == c[b]
            part = c = _pieces(len(k), a[inner], b[inner])
        held, index, part = np.unique(part, return_index=True, return_inverse=True)
        c, k, where = np.unique(c[index], return_inverse=True)[1], np.bincount(part, k, len(held)), part[where]
        lo, hi = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
        pairs, to = np.unique((lo * len(held) + hi)[lo < hi], return_inverse=True)
        a, b, w = pairs // len(held), pairs % len(held), np.bincount(to, w[lo < hi], len(pairs))


def _settled(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, half: float, c: np.ndarray, rounds: int) -> np.ndarray:
    """The smallest member of each node's community; edges are in order, loops are left out here."""
    a, b, w = (x[a != b] for x in (a, b, w))
    for turn in range(rounds):
        found, moved = _parted(a, b, w, k, half, c.copy())
        if turn and not moved:
            break
        c = found
    first, at = np.unique(c, return_index=True, return_inverse=True)[1:]
    return first[at]


def _numbers(names: pa.Array, *columns: pa.ChunkedArray) -> list[np.ndarray]:
    return [pc.index_in(x, value_set=names).to_numpy().astype(np.int64) for x in columns]


def _alone(state: DataFrame, e: DataFrame, rounds: int, resolution: float) -> DataFrame:
    """(node, c) of graphs ``u``, each of which fits a task; ``state`` (unit, node, k, m, c), ``e`` (u, a, b, w). c is the smallest member."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        if not len(nodes):  # no weight at all
            return pa.table({"node": nodes["node"], "c": nodes["node"]})
        nodes = nodes.sort_by("node")
        names, k, m = nodes["node"].combine_chunks(), nodes["k"].to_numpy(), nodes["m"][0].as_py()
        (a, b), (c,) = _numbers(names, edges["a"], edges["b"]), _numbers(pc.unique(nodes["c"]).sort(), nodes["c"])
        order = np.lexsort((b, a))
        c = _settled(a[order], b[order], edges["w"].to_numpy()[order], k, resolution / 2 / m, c, rounds)
        return pa.table({"node": names, "c": names.take(pa.array(c))})

    node = state.schema["node"].dataType.simpleString()
    return _spread(state, "unit").groupBy("unit").cogroup(_spread(e, "u").groupBy("u")).applyInArrow(run, f"node {node}, c {node}")


def nested(edges: DataFrame, most: int, rounds: int = 3, resolution: float = 1.0) -> DataFrame:
    """(step, c, parent, node): communities of each graph ``g`` over ``edges`` (a, b, weight, g), those of more than ``most`` nodes
    parted again, and so on; of what no longer parts nothing is told. Each graph is parted to its end in one task, which must hold it.
    """

    def run(edges: pa.Table) -> pa.Table:
        names = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks])).sort()
        a, b = _numbers(names, edges["a"], edges["b"])
        order = np.lexsort((b, a))
        todo, made = [(0, np.arange(len(names)), a[order], b[order], edges["weight"].to_numpy()[order].astype(float))], []
        while todo:
            step, nodes, a, b, w = todo.pop()
            k = np.bincount(a, w, len(nodes)) + np.bincount(b, w, len(nodes))
            if not w.sum():
                continue
            c = _settled(a, b, w, k, resolution / 2 / w.sum(), np.arange(len(nodes)), rounds)
            held, sizes = np.unique(c, return_counts=True)
            if len(held) == 1:
                continue
            made.append((np.full(len(nodes), step), nodes[c], np.full(len(nodes), nodes[0]), nodes))
            inner = np.flatnonzero(c[a] == c[b])
            inner = inner[np.argsort(c[a[inner]], kind="stable")]
            for x in held[sizes > most]:
                own = np.flatnonzero(c == x)
                at = inner[slice(*np.searchsorted(c[a[inner]], [x, x + 1]))]
                todo.append((step + 1, nodes[own], np.searchsorted(own, a[at]), np.searchsorted(own, b[at]), w[at]))
        step, c, parent, node = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*made)) if made else [np.zeros(0, np.int64)] * 4
        return pa.table({"step": pa.array(step, pa.int32()), **{k: names.take(pa.array(x)) for k, x in (("c", c), ("parent", parent), ("node", node))}})

    node = edges.schema["a"].dataType.simpleString()
    return _spread(edges, "g").groupBy("g").applyInArrow(run, f"step int, c {node}, parent {node}, node {node}")


def _forests(e: DataFrame, a_run: int) -> DataFrame:
    """(a, b) with the components of ``e`` (a, b): of every run of edges, each node with the smallest of its component there."""

    def made(held):
        edges = pa.Table.from_batches(held)
        names = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks])).sort()
        low = pa.array(_pieces(len(names), *_numbers(names, edges["a"], edges["b"])))
        return pa.RecordBatch.from_arrays([names, names.take(low)], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= a_run:
                yield made(held)
                held, size = [], 0
        if size:
            yield made(held)

    return e.mapInArrow(run, e.schema)


def _roots(e: DataFrame, a_run: int = 500_000) -> DataFrame:
    """(node, component) of the edges ``e`` (a, b): runs of them are thinned out in tasks while that helps, what is left meets by joins."""
    pairs = stored(_forests(e, a_run))
    n = pairs.count()
    while n > a_run:
        thinner = stored(_forests(pairs.coalesce(n // a_run + 1), a_run))
        had, n = n, thinner.count()
        if n > had / 2:
            return connected_components(thinner, "a", "b")
        pairs = thinner
    return stored(_forests(pairs.coalesce(1), a_run)).withColumnsRenamed({"a": "node", "b": "component"})  # one run holds them


def _units(e: DataFrame, whole: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(u, a, b, w) of ``e`` (a, b, w, g) that fit a task, (node, unit) of their nodes, and the rest of ``e``, if any.

    A unit is a graph, or a component of one that is too large: moves never leave a component.
    """
    def fits(e: DataFrame) -> DataFrame | None:
        sizes = e.groupBy("u").agg(F.count("*").alias("n"))
        return None if (sizes.agg(F.max("n")).first()[0] or 0) <= whole else broadcast_if_small(cut(sizes.filter(F.col("n") > whole).select("u")))

    e = e.withColumn("u", F.concat(F.lit("g"), F.col("g").cast("string")))
    rest = None
    if (large := fits(e)) is not None:
        inside = e.join(large, "u", "left_semi")
        roots = _roots(inside.select("a", "b")).select(F.col("node").alias("a"), F.concat(F.lit("c"), F.col("component").cast("string")).alias("u"))
        e = stored(e.join(large, "u", "left_anti").unionByName(inside.drop("u").join(roots, "a").select(*e.columns)))
        if (large := fits(e)) is not None:
            rest, e = e.join(large, "u", "left_semi").select("a", "b", "w", "g"), e.join(large, "u", "left_anti")
    nodes = e.select(F.col("a").alias("node"), F.col("u").alias("unit")).union(e.select("b", "u")).distinct()
    return e.select("u", "a", "b", "w"), nodes, rest


def communities_of(edges: DataFrame, rounds: int = 3, resolution: float = 1.0, merges: int = 3, levels: int = 12, whole: int = 1_000_000) -> DataFrame:
    """(node, c): connected communities over ``edges`` (a, b, weight), none of which a merge of two would better.

    A level moves nodes between communities, refines each community into parts that grow along its edges, and makes the parts the
    nodes of the next level's graph, which starts from the communities. Edges of one pair are added up; an empty input gives an empty
    result. Where edges have a column ``g``, each value of it is a graph of its own, with its own total weight, and all are parted
    side by side. Graphs and components of at most ``whole`` edges are parted inside a task, larger ones by joins till what is left
    of each has no more edges than that: there, while even the graph of communities is larger, or refining shrinks it little, the
    connected pieces of communities are the next nodes. Where levels stop before, adjacent ones are merged while any merge gains.
    """
    group = F.col("g") if "g" in edges.columns else F.lit(0)
    e = stored(edges.withColumn("g", group).groupBy("a", "b").agg(F.sum("weight").cast("double").alias("w"), F.first("g").alias("g")))
    ends = e.select(F.col("a").alias("node"), "w", "g").unionByName(e.select(F.col("b").alias("node"), "w", "g"))
    totals = e.groupBy("g").agg(F.sum("w").alias("m")).filter("m > 0")
    state = stored(ends.groupBy("node").agg(F.sum("w").alias("k"), F.first("g").alias("g")).join(totals, "g").select("node", "k", "m", "g", F.col("node").alias("c")))
    few, nodes, rest = _units(e, whole)
    alone = _alone(state.drop("g").join(nodes, "node"), few, rounds, resolution)
    if rest is None:
        return alone
    e = stored(rest)
    ends = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    state = stored(state.join(ends, "node", "left_semi"))
    graph, where, n = e, state.select("node", F.col("node").alias("at")), state.count()
    had, most = _most(graph)
    for level in range(levels):
        near, before, nodes, fine = _between(graph, had), had, n, (graph, where)
        state = _moves(near, state, n, rounds, resolution)
        pieces = _roots(_within(graph, state, n)).withColumnsRenamed({"component": "part"})
        coarse = stored(state.join(pieces, "node", "left").withColumn("part", F.coalesce("part", "node")).withColumn("c", F.col("part")))
        graph, moved, where, n = _next(graph, coarse, where, n)
        had, most = _most(graph)
        if most <= whole:  # parts of communities make larger graphs than these do
            parts = state.withColumn("part", F.col("node"))
            for turn in range(merges):
                parts = stored(_refined(near, parts, nodes, 100 * level + turn, resolution))
            refined = _next(fine[0], parts, fine[1], nodes)
            sizes = _most(refined[0])
            if sizes[1] <= whole or sizes[0] <= 0.6 * before:
                (graph, moved, where, n), (had, most) = refined, sizes
        state = moved
        if most <= whole or n > 0.9 * nodes:
            break
    if most <= whole:
        found = _alone(state.withColumnRenamed("g", "unit"), graph.withColumnRenamed("g", "u"), rounds, resolution)
    else:
        near, parts = _between(graph, had), stored(state.withColumn("part", F.col("node")).withColumn("c", F.lit(0)))
        while not (gaining := stored(_gaining(near, parts, n, resolution))).isEmpty():
            parts = stored(_paired(gaining, parts))
        found = parts.select("node", F.col("part").alias("c"))
    at = stored(where.join(found.withColumnRenamed("node", "at"), "at").select("node", "c"))
    return at.join(at.groupBy("c").agg(F.min("node").alias("least")), "c").select("node", F.col("least").alias("c")).unionByName(alone)


def _next(graph: DataFrame, parts: DataFrame, where: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The graph of parts, its state, where each node of the first graph lies in it, and the number of its nodes."""
    graph, state = _aggregated(graph, parts, n)
    where = stored(where.join(parts.select(F.col("node").alias("at"), "part"), "at").select("node", F.col("part").alias("at")))
    return graph, state, where, state.count()


def _within(graph: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """(a, b): edges of the graph inside communities."""
    ends = graph.filter("a <> b").select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(_small(state.select(F.col("node").alias(end), F.col("c").alias(f"c{end}")), n), end)
    return ends.filter("ca = cb").select("a", "b")
