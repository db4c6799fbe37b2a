"""Repeated byte strings by external induced suffix sorting.

Every window of ``width`` bytes owns an anchor: of its 50-byte strings the one of smallest hash, the leftmost of equals.
Equal windows have equal anchors at the same place, so suffixes need sorting only where they start in windows around one
anchor. Anchors are the sampled suffixes of induced sorting. They are counted, those that occur once are gone, and the bytes
around the others (a piece: all windows of an anchor that follow each other) are dealt by anchor and come to a task sorted, out
of Spark's spilling sort, which is the disk-backed queue here: a task reads its shard as a stream of groups and holds a bounded
batch of them, however large the shard is.

Within a batch, suffix order and common-prefix values are induced twice. At the upper level the text right of an anchor is a
string over eight-byte symbols, read from its end: the order of the suffixes one symbol further left is the known order, sorted
stably by the new symbol, and the common prefix of two neighbours is eight more than the least one between their tails. This
gives the order of the anchors. At the lower level bytes left of the anchor are put in front, one after the other, in the same
way, up to the window that starts furthest left. A window is repeated when its suffix shares ``width`` bytes with a neighbour in
this order. Suffixes that can no longer share so many are dropped on the way.

Pieces of equal bytes are one before they travel, with a count. A group of a single piece needs no sorting. A group of more than
``hot`` different pieces is dealt again by the hashes of its windows, so that none is one task's.

Defined results: null and empty texts have no bytes; a text shorter than ``width`` loses nothing; repeated rows repeat all their
windows; ids, null or not, and other columns play no part; an empty table gives an empty result; bytes are those of the text
in UTF-8, so what is kept need not be.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rows import long, slices
from tessera.session import broadcast_if_small, checkpoint_dir, cut, remove, without_columns

ANCHOR = 50
BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15 | 1
#: One 64-bit number a byte value, drawn once and for all.
BYTES = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PAD = 0xFF  # no byte of UTF-8


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Polynomial hashes modulo 2**64 of any stretch of a block of at most ``BLOCK`` bytes."""

    def __init__(self):
        self.up, self.down = _powers(BASE, BLOCK + 1), _powers(pow(BASE, -1, 1 << 64), BLOCK + 1)

    def load(self, block: np.ndarray) -> None:
        self.sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(BYTES[block] * self.down[: len(block)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * at)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def pieces_of(data: np.ndarray, ends: np.ndarray, width: int, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """(text, first, windows, anchor offset, anchor hash, piece hash) of texts laid end to end, which end at ``ends``.

    A piece is the run of windows that start at ``first``, ``first + 1``, … of one text and own one anchor.
    """
    made = []
    w, step = width - ANCHOR + 1, BLOCK - width
    starts = np.r_[0, ends[:-1]]
    for at in range(0, max(0, len(data) - width + 1), step):
        block = data[at : at + step + width - 1]
        hashes.load(block)
        n = len(block) - ANCHOR + 1
        grams = hashes.of(slice(0, n), slice(ANCHOR, n + ANCHOR), hashes.up[:n])
        packed = (grams & ~np.uint64(BLOCK - 1)) | np.arange(n, dtype=np.uint64)
        anchor = (sliding_least(packed, w) & np.uint64(BLOCK - 1)).astype(np.int64)  # one a window
        place = np.arange(len(anchor))
        # windows that lie in one text
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + len(block), "left")
        some_starts, some_ends = starts[lo : hi + 1] - at, ends[lo : hi + 1] - at
        text = np.repeat(np.arange(len(some_ends)), np.clip(some_ends, 0, len(block)) - np.clip(some_starts, 0, len(block)))[: len(anchor)]
        inside = place + width <= some_ends[text]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
        runs = np.flatnonzero(new)
        total = np.add.reduceat(inside.astype(np.int64), runs)
        runs, total = runs[total > 0], total[total > 0]  # windows that reach over an end come last in their run
        a = anchor[runs]
        stop = runs + total - 1 + width
        h = hashes.of(runs, stop, hashes.up[runs]) ^ (total.astype(np.uint64) << np.uint64(32)) ^ (a - runs).astype(np.uint64)
        made.append((text[runs] + lo, runs - some_starts[text[runs]], total, a - runs, grams[a].view(np.int64), _mixed(h).view(np.int64)))
    if not made:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*made))


def laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)


PIECES = "k0 long, k1 int, first long, windows int, back int, anchor long, piece long"


def pieces(rows: DataFrame, width: int) -> DataFrame:
    """All pieces of rows (k0, k1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches, 64):
            data, ends = laid_out(batch.column(2).to_pylist())
            text, first, windows, back, anchor, piece = pieces_of(data, ends, width, hashes)
            k0, k1 = (batch.column(i).take(pa.array(text)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([k0, k1, pa.array(first), pa.array(windows.astype(np.int32)), pa.array(back.astype(np.int32)), pa.array(anchor), pa.array(piece)], names=["k0", "k1", "first", "windows", "back", "anchor", "piece"])

    return rows.mapInArrow(run, PIECES)


def least_between(values: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of ``values[before + 1 : at + 1]`` for places with before < at, from minima over powers of two."""
    if not len(at):
        return np.zeros(0, values.dtype)
    length = at - before
    level = np.frexp(length)[1] - 1
    out, row = np.empty(len(at), values.dtype), values
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(row[before[here] + 1], row[at[here] + 1 - (1 << k)])
        row = np.minimum(row[: -(1 << k)], row[1 << k :]) if len(row) > 1 << k else row
    return out


def induce(order: np.ndarray, common: np.ndarray, group: np.ndarray, symbol: np.ndarray, size: int, most: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order and common-prefix values of suffixes one symbol of ``size`` bytes further left than those in ``order``.

    ``common[i]`` is what the suffix at place i shares with the one before it; groups follow each other and share nothing.
    Suffixes that are not ``live`` drop out.
    """
    at = np.arange(len(order)) if live is None else np.flatnonzero(live[order])
    g, s = group[order[at]], symbol[order[at]]
    by = np.lexsort((s, g))
    g, s, at = g[by], s[by], at[by]
    made = np.zeros(len(at), common.dtype)
    same = np.r_[False, g[1:] == g[:-1]] if len(g) else np.zeros(0, bool)
    equal = np.flatnonzero(same & np.r_[False, s[1:] == s[:-1]]) if len(g) else np.zeros(0, int)
    made[equal] = np.minimum(least_between(common, at[equal - 1], at[equal]).astype(np.int64) + size, most)
    if size > 1:
        other = np.flatnonzero(same & np.r_[False, s[1:] != s[:-1]])
        apart = s[other] ^ s[other - 1]
        made[other] = sum((apart < np.uint64(1 << (8 * k))).astype(np.uint8) for k in range(1, size))
    return order[at], made


def repeated_windows(group: np.ndarray, times: np.ndarray, back: np.ndarray, windows: np.ndarray, content: list[bytes], width: int) -> np.ndarray:
    """A matrix: whether window j of piece i is repeated in another place. ``group`` is sorted; pieces are distinct in a group."""
    m = len(group)
    flags = np.zeros((m, width - ANCHOR + 1), bool)
    data = np.frombuffer(b"".join(content), np.uint8)
    start = np.r_[0, np.cumsum([len(c) for c in content])[:-1]].astype(np.int64)
    size = np.array([len(c) for c in content], np.int64)
    # upper level: eight-byte symbols right of the anchor, padded by a byte that no text has
    cols = -(-width // 8) * 8
    right = np.full((m, cols), PAD, np.uint8)
    length = np.minimum(size - back, cols)
    row = np.repeat(np.arange(m), length)
    col = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    right[row, col] = data[start[row] + back[row] + col]
    words = right.view(">u8").astype(np.uint64)
    order, common = np.arange(m), np.zeros(m, np.uint8)
    for t in range(words.shape[1] - 1, -1, -1):
        order, common = induce(order, common, group, words[:, t], 8, width)
    flags[times > 1] = True
    # lower level: bytes left of the anchor
    for step in range(int(back.max(initial=0)) + 1):
        if step:
            best = np.zeros(m, np.int64)  # what a suffix shares with either neighbour
            best[order] = common
            best[order[:-1]] = np.maximum(common[:-1], common[1:])
            live = (back >= step) & (best + back - step + 1 >= width)
            kept = order[live[order]]
            if not len(kept):
                break
            symbol = np.zeros(m, np.uint8)
            symbol[kept] = data[start[kept] + back[kept] - step]
            order, common = induce(order, common, group, symbol, 1, width, live)
        full = common >= width
        hit = order[full | np.r_[full[1:], False]]
        window = back[hit] - step
        hit, window = hit[window < windows[hit]], window[window < windows[hit]]
        flags[hit, window] = True
    flags[np.arange(flags.shape[1])[None, :] >= windows[:, None]] = False
    return flags


RUNS = "anchor long, piece long, start int, stop int"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true cells."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def sorted_runs(held: DataFrame, width: int, shards: int, batch_rows: int = 8192) -> DataFrame:
    """(anchor, piece, start, stop): runs of repeated windows of pieces (anchor, piece, times, back, windows, content), each taken once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(rest) < batch_rows:
                continue
            key = rest["anchor"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the group that may go on
            if last:
                yield told(rest.iloc[:last])
                rest = rest.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield told(rest)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, piece, times, back, windows = (pdf[c].to_numpy(np.int64) for c in ("anchor", "piece", "times", "back", "windows"))
        group = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])
        row, first, last = _runs(repeated_windows(group, times, back, windows, pdf["content"].tolist(), width))
        return pd.DataFrame({"anchor": anchor[row], "piece": piece[row], "start": first.astype(np.int32), "stop": last.astype(np.int32)})

    return held.repartition(shards, "anchor").dropDuplicates(["anchor", "piece"]).sortWithinPartitions("anchor").mapInPandas(run, RUNS)


def window_runs(held: DataFrame, width: int) -> DataFrame:
    """As :func:`sorted_runs` for groups of any size: equal windows meet by their hashes, and counts leave each task combined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            made = []
            for x in pdf.itertuples():
                hashes.load(np.frombuffer(x.content, np.uint8))
                at = np.arange(x.windows)
                made.append(hashes.of(at, at + width, hashes.up[: x.windows]).view(np.int64))
            n = pdf["windows"].to_numpy()
            at = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, int)
            whole = {c: np.repeat(pdf[c].to_numpy(), n) for c in ("anchor", "piece", "times", "back")}
            yield pd.DataFrame(whole | {"start": at.astype(np.int32), "h": np.concatenate(made) if made else np.zeros(0, np.int64)})

    every = held.mapInPandas(run, "anchor long, piece long, times long, back int, start int, h long").withColumn("left", F.col("back") - F.col("start"))
    often = every.groupBy("anchor", "left", "h").agg(F.sum("times").alias("n")).filter("n > 1").drop("n")
    return every.join(often, ["anchor", "left", "h"], "left_semi").select("anchor", "piece", "start", F.col("start").alias("stop"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, hot: int = 8192, shard_bytes: int = 16_000_000) -> DataFrame:
    """(k0, k1, cover) of texts, named by two hashes, that hold repeated windows: cover lists (from, to) stretches of bytes."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/suffixes-{uuid.uuid4().hex}"
    keyed = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).withColumns(_keys("text"))
    rows = keyed.filter(F.octet_length("text") >= width)
    pieces(rows.select("k0", "k1", "text"), width).write.parquet(f"{folder}/pieces")
    every = spark.read.schema(PIECES).parquet(f"{folder}/pieces")
    often = every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    # copies of a text have the same pieces at the same places, which are one row from here on
    here = every.join(often, "anchor", "left_semi").groupBy("k0", "k1", "first", "anchor", "piece", "windows", "back").agg(F.count("*").alias("copies"))
    here.write.parquet(f"{folder}/here")
    here = spark.read.schema(here.schema).parquet(f"{folder}/here")
    kinds = here.groupBy("anchor", "piece").agg(F.sum("copies").alias("times"), F.min(F.struct("k0", "k1", "first", "windows", "back")).alias("at"))
    groups = here.select("anchor", "piece").distinct().groupBy("anchor").agg(F.count("*").alias("kinds"))
    kinds.join(groups, "anchor").select("anchor", "piece", "times", "kinds", "at.*").write.parquet(f"{folder}/kinds")
    kinds = spark.read.parquet(f"{folder}/kinds")
    alone = kinds.filter("kinds = 1 and times > 1").select("anchor", "piece", F.lit(0).alias("start"), (F.col("windows") - 1).alias("stop"))
    # the bytes of every other piece, from the row of smallest id that holds its text
    wanted = kinds.filter("kinds > 1")
    owners = broadcast_if_small(wanted.select("k0", "k1").distinct())
    first = rows.join(owners, ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.min(F.coalesce("id", F.lit(""))).alias("id"))
    some = rows.withColumn("id", F.coalesce("id", F.lit(""))).join(broadcast_if_small(first), ["k0", "k1", "id"])
    lists = wanted.groupBy("k0", "k1").agg(F.collect_list(F.struct("anchor", "piece", "times", "kinds", "first", "windows", "back")).alias("p"))
    held = some.join(lists, ["k0", "k1"]).select(F.encode("text", "utf-8").alias("raw"), F.explode("p").alias("p"))
    held = held.select("p.*", F.substring("raw", F.col("p.first").cast("int") + 1, F.col("p.windows") + (width - 1)).alias("content"))
    held.write.parquet(f"{folder}/held")  # both ways below read it, so that whole texts travel once
    held = spark.read.schema(held.schema).parquet(f"{folder}/held")
    size = wanted.agg(F.sum(F.col("windows") + width)).first()[0] or 0
    cool = sorted_runs(held.filter(F.col("kinds") <= hot), width, max(32, int(size // shard_bytes)))
    warm = window_runs(held.filter(F.col("kinds") > hot).dropDuplicates(["anchor", "piece"]), width) if not wanted.filter(F.col("kinds") > hot).isEmpty() else None
    found = alone.unionByName(cool) if warm is None else alone.unionByName(cool).unionByName(warm)
    span = F.struct((F.col("first") + F.col("start")).alias("from"), (F.col("first") + F.col("stop") + width).alias("to"))
    cover = cut(here.join(found, ["anchor", "piece"]).groupBy("k0", "k1").agg(F.collect_list(span).alias("cover")))
    remove(spark, folder)
    return cover


def _keys(text_col: str) -> dict:
    return {"k0": F.xxhash64(text_col), "k1": F.hash(F.lit(7), text_col)}


def merged(cover: np.ndarray) -> np.ndarray:
    """Sorted (from, to) stretches joined where they touch or overlap."""
    if not len(cover):
        return cover.reshape(0, 2)
    cover = cover[np.argsort(cover[:, 0], kind="stable")]
    reach = np.maximum.accumulate(cover[:, 1])
    new = np.r_[True, cover[1:, 0] > reach[:-1]]
    return np.stack([cover[new, 0], reach[np.r_[new[1:], True]]], 1)


FIELDS = [long("n_bytes"), long("n_removed"), long("n_spans"), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, keep_bytes: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, the bytes kept and their hash; the text itself goes."""
    names = [f.name for f in FIELDS]
    base = without_columns(docs, [*(n for n in names if n.lower() != id_col.lower()), "__k0", "__k1", "__cover"])
    cover = repeats(base, id_col, text_col, width).withColumnsRenamed({"k0": "__k0", "k1": "__k1", "cover": "__cover"})
    keyed = base.withColumns({f"__{k}": v for k, v in _keys(text_col).items()})
    named = broadcast_if_small(cover.select("__k0", "__k1").withColumn("__in", F.lit(True)))
    told = keyed.join(named, ["__k0", "__k1"], "left")
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    # texts without a repeat need not meet the covers
    rest = told.filter("__in is null").withColumn("__cover", none)
    joined = told.filter("__in").join(cover, ["__k0", "__k1"])
    stay = [c for c in base.columns if c != text_col]
    both = rest.select(*stay, text_col, "__cover").unionByName(joined.select(*stay, text_col, "__cover"))
    fields = [f for f in FIELDS if keep_bytes or f.name != "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            made = []
            for text, spans in zip(batch.column(len(stay)).to_pylist(), batch.column(len(stay) + 1).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                gone = merged(np.array([(s["from"], s["to"]) for s in spans or ()], np.int64).reshape(-1, 2))
                kept = b"".join(raw[a:b] for a, b in zip(np.r_[0, gone[:, 1]], np.r_[gone[:, 0], len(raw)]))
                made.append((len(raw), len(raw) - len(kept), len(gone), kept, sha256(kept).hexdigest()))
            columns = dict(zip(names, zip(*made))) if made else {n: [] for n in names}
            kinds = {"kept": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(stay))], *[pa.array(columns[f.name], kinds.get(f.name, pa.int64())) for f in fields]], names=[*stay, *[f.name for f in fields]])

    return both.mapInArrow(run, T.StructType([*[both.schema[c] for c in stay], *fields]))
