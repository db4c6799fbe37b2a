"""Packing token pieces into fixed windows by non-negative least squares.

Each document is tokenized once and cut into whole windows and one remainder. The histogram of remainder lengths, in
units of ``unit`` tokens (at most window / unit bins whatever the corpus), goes to the driver. There, all combinations
of two or three lengths that fill a window are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what they leave is packed best-fit into open windows. The plan is a
small table of (sequence range, slot, length bin, rank range); the pieces meet it by a join on their rank in their bin.

Defined results: a null text counts as empty and packs as its closing id alone; rows without a document id are packed
as any other; repeated rows are separate documents; an empty input gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_alphabet
from tessera.llm.rows import over_texts, slices
from tessera.session import cut, without_columns

#: Characters that every Unicode version and both regex engines class alike: ASCII, Latin letters, common marks.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u017f\u2010-\u2027\u20ac]*")
LONG_BLANK = re.compile(r"\s{64}")
#: Fixed value: the pattern by which byte-level BPE of this family parts words.
PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, if choosing the merge of lowest id is choosing the first in the list.

    That holds when the file is plain byte-level BPE, its merges make tokens of rising ids, and no token is made by two.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges")):
        return None
    made = [model["vocab"]["".join(m if not isinstance(m, str) else m.split(" ", 1))] for m in model["merges"]]
    if made != sorted(set(made)):
        return None
    back = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class WordTokens:
    """Token ids of texts, the same as the tokenizers library gives.

    Where the file's merges are ranks (``merge_ranks``), texts of common characters go to tiktoken's encoder over those
    ranks, several times as fast; any other text, or one with a special token, goes to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = merge_ranks(json.load(f))
        self.quick = tiktoken.Encoding("ranks", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.quick and COMMON.fullmatch(text) and not LONG_BLANK.search(text) and not any(s in text for s in self.special):
            return np.array(self.quick.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, close_id: int = 1) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): whole windows of each document, then its remainder."""

    def run(batches):
        coder, close, size = load(tokenizer), np.array([close_id], "<u4").tobytes(), 4 * window
        for batch in slices(batches):
            out = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = coder.encode(text) + close
                for at in range(0, len(data), size):
                    part = data[at : at + size]
                    for k, v in (("id", doc), ("start", at // 4), ("length", len(part) // 4), ("crc", zlib.crc32(part)), ("all", len(data) // 4)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], batch.schema.field(0).type), *[pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "all")]], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    kept = docs.select(F.col(id_col), F.col(text_col))
    return over_texts(kept, run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, {PIECES}")


def combinations(bins: int) -> np.ndarray:
    """Rows of up to three bins (0 for none) whose lengths in units sum to ``bins`` exactly."""
    a = np.arange(1, bins // 2 + 1)
    pairs = np.stack([a, bins - a, np.zeros_like(a)], 1)
    triples = [np.stack([np.full(len(b), x), b, bins - x - b], 1) for x in range(1, bins // 3 + 1) if len(b := np.arange(x, (bins - x) // 2 + 1))]
    return np.concatenate([pairs, *triples]).astype(np.int64)


def solve_nnls(combos: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with little ``|A x - wanted|``, A counting each bin in each combination; accelerated projected
    gradient steps on index arrays, as A has at most three entries a column."""
    used = combos > 0
    flat, column = combos[used], np.nonzero(used)[0]
    a_x = lambda x: np.bincount(flat, x[column], len(wanted))
    a_t = lambda r: np.bincount(column, r[flat], len(combos))
    v = np.ones(len(combos))  # the largest eigenvalue of A'A by power steps bounds the step length
    for _ in range(30):
        v = a_t(a_x(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / max(1e-12, float(v @ a_t(a_x(v)))) / 1.05
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * a_t(a_x(y) - wanted))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def plan(histogram: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of the slots, sequences of that kind) that use up ``histogram`` exactly; each kind's bins fit a window."""
    left = np.zeros(bins + 1, np.int64)
    for b, n in histogram.items():
        left[b] = n
    made: Counter[tuple[int, ...]] = Counter()
    made[(bins,)] += int(left[bins])
    left[bins] = 0
    if left.sum():
        combos = combinations(bins)
        combos = combos[((combos == 0) | (left[combos] > 0)).all(1)]
        if len(combos):
            x = solve_nnls(combos, left.astype(float))
            for i in np.argsort(-x, kind="stable"):
                kind = Counter(int(b) for b in combos[i] if b)
                if times := min(int(x[i]), *(int(left[b]) // k for b, k in kind.items())):
                    made[tuple(sorted(kind.elements(), reverse=True))] += times
                    for b, k in kind.items():
                        left[b] -= k * times
    # residuals: longest first into the fullest open kind of window that takes it, many equal windows at a time
    open_at: dict[int, Counter[tuple[int, ...]]] = defaultdict(Counter)  # by room
    for b in range(bins, 0, -1):
        todo = int(left[b])
        while todo:
            room = next((r for r in range(b, bins) if open_at[r]), None)
            if room is None:
                fill = min(bins // b, todo)
                times = todo // fill
                open_at[bins - fill * b][(b,) * fill] += times
                todo -= times * fill
                continue
            kind, have = open_at[room].popitem()
            fill = min(room // b, todo)
            times = min(have, todo // fill)
            if have > times:
                open_at[room][kind] += have - times
            open_at[room - fill * b][kind + (b,) * fill] += times
            todo -= times * fill
    for kinds in open_at.values():
        made.update(kinds)
    return sorted((k, n) for k, n in made.items() if n and k)


def pack(cut_pieces: DataFrame, id_col: str = "doc_id", window: int = 2048, unit: int = 4, salts: int = 64) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset. A hot length is ranked within salted parts, then shifted."""
    spark, bins = cut_pieces.sparkSession, window // unit
    base = without_columns(cut_pieces, ["sequence_id", "offset", "__bin", "__salt", "__rank", "__slot"])
    base = base.withColumn("__bin", F.ceil(F.col("length") / unit).cast("int")).withColumn("__salt", F.pmod(F.xxhash64(id_col, "start"), F.lit(salts)).cast("int"))
    counts = base.groupBy("__bin", "__salt").count().collect()  # at most bins * salts rows
    histogram, shift = Counter(), {}
    for r in sorted(counts, key=lambda r: (r[0], r[1])):
        shift[r[0], r[1]] = histogram[r[0]]
        histogram[r[0]] += r[2]
    rows, first, taken = [], 0, Counter()
    for kind, times in plan(histogram, bins):
        for b, k in Counter(kind).items():
            # the k slots of one bin share its next k * times ranks: rank // k picks the window, rank % k the slot
            rows.append((b, taken[b], taken[b] + k * times, first, k, kind.index(b)))
            taken[b] += k * times
        first += times
    spans = defaultdict(list)
    for b, low, high, seq, k, slot in rows:
        spans[b].append((low, seq, k, slot))
    plan_df = spark.createDataFrame([(b, [x[0] for x in s], [x[1] for x in s], [x[2] for x in s], [x[3] for x in s]) for b, s in spans.items()], "__bin int, low array<long>, seq array<long>, k array<int>, slot array<int>")
    shift_df = spark.createDataFrame([(b, s, n) for (b, s), n in shift.items()], "__bin int, __salt int, __shift long")
    order = Window.partitionBy("__bin", "__salt").orderBy(id_col, "start", "ids_crc32", "doc_tokens")
    ranked = base.withColumn("__rank", F.row_number().over(order)).join(F.broadcast(shift_df), ["__bin", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__shift")).join(F.broadcast(plan_df), "__bin")
    # __at: the last span of the bin that starts at or before the rank, by halving steps over its sorted starts
    steps = F.array(*[F.lit(1 << p) for p in range(max(map(len, spans.values()), default=1).bit_length(), -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.coalesce(F.get("low", lo + step) <= F.col("__rank"), F.lit(False)), lo + step).otherwise(lo))
    placed = ranked.withColumn("__at", at)
    inside = F.col("__rank") - F.get("low", "__at")
    placed = placed.withColumn("sequence_id", F.get("seq", "__at") + F.floor(inside / F.get("k", "__at"))).withColumn("__slot", F.get("slot", "__at") + inside % F.get("k", "__at"))
    window_of = Window.partitionBy("sequence_id").orderBy("__slot")
    return placed.withColumn("offset", F.sum("length").over(window_of) - F.col("length")).select(*base.columns[:-2], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, close_id: int = 1, unit: int = 4) -> DataFrame:
    """Pieces of all ``docs`` with their sequence and offset. Tokenizes once; the pieces are written, then packed."""
    return pack(cut(pieces(docs, tokenizer, id_col, text_col, window, close_id)), id_col, window, unit)
