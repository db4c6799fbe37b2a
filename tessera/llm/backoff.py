"""Stupid-backoff language-model scores of documents, from count tables partitioned by n-gram hash.

Tokens are the stretches of a text between ASCII white space. A pair of neighbours scores ln(c(u w) / c(u)) if the
corpus holds it at least ``min_count`` times, else ln(alpha * c(w) / N); a document's first token scores ln(c(w) / N).
The scored documents are the corpus: a pair counted once was seen in the scored text alone, so by default it counts as
unseen. Without that cutoff no text would ever back off.

Word counts are a table keyed by a 64-bit hash. Documents are exploded into pairs, which meet their counts in hash
buckets: every task sends, for each bucket, the distinct pairs of a run of documents with the documents that hold them,
so a pair is counted, joined and scored where its hash lives and no pair crosses the network once per occurrence.
Counts of heavy words (at least one in ``heavy`` tokens, so at most ``heavy`` of them) travel with the tasks, and pairs
name them by small codes; the other words' terms meet their counts in a second set of buckets, where no word has more than N / heavy occurrences.
Hot pairs are counted over all documents before, and scored where the documents lie, so that none of them fills a bucket.
Which pairs are hot, at most ``hot_pairs`` of them, a hash sample of the texts says; a pair it misses goes to its bucket as any other.

Defined results: null, empty and white texts have no token, log_score 0 and a null mean; repeated rows each count and
each have a row, with the results of its own text; so do rows that share an id or have none, which are told apart by a
64-bit hash of id and text. Pairs are named by 64-bit hashes. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import over_texts, slices
from tessera.session import broadcast_if_small, checkpoint_dir, cut

MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Hash of each recent word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of word hashes."""
    x = u >> np.uint64(31)
    x ^= u
    x *= MIX
    x += w
    y = x >> np.uint64(29)  # one array of helping values, used again
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(32), out=y)
    x ^= y
    return x


def tokens(text: str | None, known: Hashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _runs(batches, run_tokens: int):
    """(row keys, lengths, all hashes) of consecutive documents holding about ``run_tokens`` tokens."""
    known, keys, parts, size = Hashes(), [], [], 0
    for batch in slices(batches):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = tokens(text, known)
            keys.append(key)
            parts.append(h)
            size += len(h)
            if size >= run_tokens:
                yield keys, np.array([len(p) for p in parts]), np.concatenate(parts)
                keys, parts, size = [], [], 0
    if keys:
        yield keys, np.array([len(p) for p in parts]), np.concatenate(parts)


def hot_pairs_of(docs: DataFrame, most: int, one_in: int, run_tokens: int) -> np.ndarray:
    """(pair hash, first word, second word) of the commonest pairs in one in ``one_in`` texts, chosen by hash; sorted by pair."""

    def run(batches):
        for _, sizes, h in _runs(batches, min(run_tokens, FEW)):
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            at = np.flatnonzero(doc[1:] == doc[:-1])
            p, first, n = np.unique(pair_hash(h[at], h[at + 1]), return_index=True, return_counts=True)
            some = n >= 2
            yield pa.RecordBatch.from_arrays([*[pa.array(x[some].view(np.int64)) for x in (p, h[at][first], h[at + 1][first])], pa.array(n[some].astype(np.int64))], names=["p", "u", "w", "c"])

    sample = docs.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(one_in)) == 0).select(F.lit(0).cast("long"), "text")
    counts = over_texts(sample, run, "p long, u long, w long, c long").groupBy("p").agg(F.min("u").alias("u"), F.min("w").alias("w"), F.sum("c").alias("c"))
    rows = counts.orderBy(F.desc("c"), "p").limit(most).select("p", "u", "w").collect()  # at most ``most``
    made = np.array(rows, np.int64).reshape(-1, 3).view(np.uint64)
    return made[np.argsort(made[:, 0])]


def _places(p: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Place of each pair hash in the sorted ``hot`` ones, -1 for the others."""
    if not len(hot):
        return np.full(len(p), -1)
    at = np.minimum(np.searchsorted(hot, p), len(hot) - 1)
    return np.where(hot[at] == p, at, -1)


def gram_counts(docs: DataFrame, hot: np.ndarray, run_tokens: int = 1_000_000) -> DataFrame:
    """(pair, h, c): the unigram table (pair false) and the counts of the hot pairs (pair true), over all documents."""

    def run(batches):
        for _, sizes, h in _runs(batches, min(run_tokens, FEW)):
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            at = np.flatnonzero(doc[1:] == doc[:-1])
            place = _places(pair_hash(h[at], h[at + 1]), hot)
            held = np.bincount(place[place >= 0], minlength=len(hot))
            u, n = np.unique(h, return_counts=True)
            keys = np.concatenate([u, hot[held > 0]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys)) >= len(u)), pa.array(keys), pa.array(np.r_[n, held[held > 0]].astype(np.int64))], names=["pair", "h", "c"])

    return over_texts(docs, run, "pair boolean, h long, c long").groupBy("pair", "h").agg(F.sum("c").alias("c"))


#: Tokens a run where only sums or rows of single documents leave it, which are the same for runs of any size.
FEW = 125_000

#: Code of a word that is not among the heavy ones.
LIGHT = 0xFFFFF


def _codes(h: np.ndarray, heavy_h: np.ndarray) -> np.ndarray:
    """Places of words in the sorted heavy ones, LIGHT for the others."""
    if not len(heavy_h):
        return np.full(len(h), LIGHT, np.int64)
    at = np.minimum(np.searchsorted(heavy_h, h), len(heavy_h) - 1)
    return np.where(heavy_h[at] == h, at, LIGHT)


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _pairs(docs: DataFrame, buckets: int, run_tokens: int, heavy_h: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(bucket, codes, light, times, docs, keys): distinct pairs, hot ones left out, of a run of documents in one bucket.

    ``codes`` holds the steps between the rising codes of all first words, then the codes of all second ones; hashes of
    those that are LIGHT follow in ``light``. Of each pair, ``times`` gives its occurrences, each of which has a place of ``keys`` in ``docs``.
    """

    def run(batches):
        for keys, sizes, h in _runs(batches, run_tokens):
            keys, code = np.array(keys, np.int64), _codes(h.view(np.int64), heavy_h)
            doc = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
            at = np.flatnonzero(doc[1:] == doc[:-1])
            p = pair_hash(h[at], h[at + 1])
            cold = _places(p, hot) < 0
            at, p = at[cold], p[cold]
            bucket = ((p >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            # pairs that agree in all of this key may come apart into more than one entry, which does no harm
            key = code[at].astype(np.uint64) << np.uint64(20)
            key |= bucket << np.uint64(40)
            key |= p & np.uint64(0xFFFFF)
            order = np.argsort(key)
            del key, cold
            p, at, bucket = p[order], at[order], bucket[order]
            del order
            new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][: len(p)])
            times, first, bucket = np.diff(np.r_[new, len(p)]), at[new], bucket[new].astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[k], cuts[k + 1])
                lo, hi = new[cuts[k]], new[cuts[k + 1]] if cuts[k + 1] < len(new) else len(p)
                words = np.concatenate([first[own], first[own] + 1])
                codes = code[words]
                held, where = np.unique(doc[at[lo:hi]], return_inverse=True)
                n = len(codes) // 2
                steps = np.r_[np.diff(codes[:n], prepend=0), codes[n:]]
                binary = [pa.array([x], pa.binary()) for x in (_pack(steps), h[words[codes == LIGHT]].tobytes(), _pack(times[own]), _pack(where))]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *binary, pa.array([keys[held]], pa.list_(pa.int64()))], names=["bucket", "codes", "light", "times", "docs", "keys"])

    return over_texts(docs, run, "bucket int, codes binary, light binary, times binary, docs binary, keys array<long>")


def _words(block, heavy_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and hashes of the words of one row of :func:`_pairs`, first words first."""
    codes = _unpack(block.codes)
    codes[: len(codes) // 2] = np.cumsum(codes[: len(codes) // 2])
    light, h = codes == LIGHT, np.empty(len(codes), np.int64)
    h[~light], h[light] = heavy_h[codes[~light]], np.frombuffer(block.light, "<i8")
    return codes, h


def _sum_by(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(doc, return_inverse=True)
    return u, np.bincount(at, value, len(u))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (own, text) with a key ``id``: the id itself, which packs best, or for null and repeated ids a hash with the text."""
    hashed = -F.abs(F.xxhash64("own", "text").bitwiseAND(F.lit((1 << 62) - 1))) - F.lit(1 << 62)
    again = cut(rows.groupBy("own").agg(F.count("*").alias("n")).filter("n > 1 and own is not null").select("own"))
    few = broadcast_if_small(again)
    if few is again:  # too many to be sent around
        return rows.withColumn("id", hashed)
    marked = rows.join(few.withColumn("again", F.lit(True)), "own", "left")
    return marked.select("own", F.when(F.col("own").isNull() | F.col("again"), hashed).otherwise(F.col("own")).alias("id"), "text")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.4, min_count: int = 2, heavy: int = 500_000, bucket_chars: int = 8_000_000, run_tokens: int = 1_000_000, hot_pairs: int = 100_000, hot_sample: int = 64) -> DataFrame:
    """(id, n_tokens, log_score, mean_log_score) of every document under counts from all of them."""
    if not 0 < heavy < LIGHT:
        raise ValueError("heavy must be 1 to 1,048,574")
    rows = _keyed(docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text")))
    texts = rows.select("id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-chars // bucket_chars))
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/word-counts-{uuid.uuid4().hex}"
    hot = hot_pairs_of(texts, hot_pairs, hot_sample, run_tokens)
    hot_p = hot[:, 0].copy()
    gram_counts(texts.select(F.lit(0).cast("long"), "text"), hot_p, run_tokens).write.parquet(folder)
    grams = docs.sparkSession.read.schema("pair boolean, h long, c long").parquet(folder)
    counts = grams.filter("not pair").select("h", "c")
    total = counts.agg(F.sum("c")).first()[0] or 0
    often = {r["h"]: r["c"] for r in counts.filter(F.col("c") * heavy >= F.lit(total)).collect()}  # at most ``heavy`` words
    heavy_h = np.array(sorted(often), np.int64)
    heavy_ln = np.log(np.array([often[h] for h in heavy_h.tolist()], float)) if often else np.zeros(0)

    def look(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is heavy, and if so ln of its count."""
        return value(_codes(h, heavy_h))

    def value(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_heavy, ln = code != LIGHT, np.zeros(len(code))
        ln[is_heavy] = heavy_ln[code[is_heavy]]
        return is_heavy, ln

    floor = math.log(alpha) - math.log(max(total, 1))
    hot_s = np.zeros(len(hot))
    if len(hot):  # the score of a hot pair is a constant
        named = docs.sparkSession.createDataFrame(pd.DataFrame(hot.view(np.int64), columns=["p", "u", "w"]))  # at most hot_pairs rows
        named = named.join(grams.filter("pair").select(F.col("h").alias("p"), "c"), "p")
        named = named.join(counts.select(F.col("h").alias("u"), F.col("c").alias("cu")), "u").join(counts.select(F.col("h").alias("w"), F.col("c").alias("cw")), "w")
        term = F.when(F.col("c") >= min_count, F.log("c") - F.log("cu")).otherwise(F.log("cw") + F.lit(floor))
        scored_at = {r["p"]: r["s"] for r in named.select("p", term.alias("s")).collect()}
        hot_s = np.array([scored_at[p] for p in hot_p.view(np.int64).tolist()])
    parts = max(8, buckets // 2)  # documents meet their sums in this many parts, one row for each bucket and part

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = list(pdf.itertuples(index=False))
        halves = [[x.reshape(2, -1) for x in _words(b, heavy_h)] for b in blocks]
        code, h = (np.concatenate([x[i] for x in halves], 1) for i in (0, 1))
        cuts = np.cumsum([0, *[x[0].shape[1] for x in halves]])
        del halves  # a bucket's arrays are large: none is kept longer than it is read
        times = np.concatenate([_unpack(b.times) for b in blocks])
        kinds, at = np.unique(pair_hash(*h.view(np.uint64)), return_inverse=True)
        c = np.bincount(at, times, len(kinds))[at]
        del kinds, at
        keep = c >= min_count
        word, own = np.where(keep, *h), np.where(keep, *code)  # the word whose count is still needed, and its sign
        del h, code
        sign = np.where(keep, -1.0, 1.0)
        is_heavy, ln = value(own)
        known = np.where(keep, np.log(c), floor) + sign * ln
        del c, keep, own, ln
        ids, sums, light = [], [], []
        for b, lo, hi in zip(blocks, cuts, cuts[1:]):
            entry = np.repeat(np.arange(lo, hi), times[lo:hi])
            doc, keys = _unpack(b.docs), np.asarray(b.keys, np.int64)
            ids.append(keys)
            sums.append(np.bincount(doc, known[entry], len(keys)))
            rest = ~is_heavy[entry]
            light.append((word[entry[rest]], sign[entry[rest]], keys[doc[rest]]))
        ids, sums = _sum_by(np.concatenate(ids), np.concatenate(sums))
        lw, ls, ld = (np.concatenate(x) for x in zip(*light))
        del known, word, sign, is_heavy, times, light
        order = np.lexsort((ld, lw, (lw.view(np.uint64) % np.uint64(buckets))))
        lw, ls, ld = lw[order], ls[order], ld[order]
        made = [{"bucket": int(blocks[0].bucket), "word": [], "n": [], "sign": [], "docs": ids, "sums": sums}] if len(ids) else []
        if len(lw):
            new = np.flatnonzero(np.r_[True, (lw[1:] != lw[:-1]) | (ld[1:] != ld[:-1])])
            sums_ = np.add.reduceat(ls, new)
            lw, ld = lw[new], ld[new]
            lw, ld, sums_ = lw[sums_ != 0], ld[sums_ != 0], sums_[sums_ != 0]
            where = (lw.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            for k, lo, hi in zip(*(lambda ks: (ks, np.searchsorted(where, ks), np.searchsorted(where, ks, "right")))(np.unique(where))):
                first = np.flatnonzero(np.r_[True, lw[lo + 1 : hi] != lw[lo : hi - 1]])
                made.append({"bucket": int(k), "word": lw[lo:hi][first], "n": np.diff(np.r_[first, hi - lo]).astype(np.int32), "sign": sums_[lo:hi].astype(np.int32), "docs": ld[lo:hi], "sums": []})
        return pd.DataFrame(made, columns=["bucket", "word", "n", "sign", "docs", "sums"], dtype=None if made else object)

    scored = _pairs(texts, buckets, run_tokens, heavy_h, hot_p).groupBy("bucket").applyInPandas(pairs, "bucket int, word array<long>, n array<int>, sign array<int>, docs array<long>, sums array<double>")

    # first tokens, hot pairs, and tokens a document: first words' terms meet the counts with the light words of the pairs
    def firsts(batches):
        for keys, sizes, h in _runs(batches, min(run_tokens, FEW)):
            starts = np.r_[0, np.cumsum(sizes)[:-1]][sizes > 0]
            key = np.array(keys, np.int64)[sizes > 0]
            w = h[starts].view(np.int64)
            is_heavy, ln = look(w)
            doc = np.repeat(np.arange(len(key), dtype=np.int32), sizes[sizes > 0])
            at = np.flatnonzero(doc[1:] == doc[:-1])
            place = _places(pair_hash(h[at], h[at + 1]), hot_p)
            held = place >= 0
            known = ln - math.log(max(total, 1)) + np.bincount(doc[at][held], hot_s[place[held]], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(known), pa.array(sizes[sizes > 0].astype(np.int64)), pa.array(np.where(is_heavy, 0, w)), pa.array(~is_heavy)], names=["id", "s", "n", "w", "light"])

    heads = cut(over_texts(texts, firsts, "id long, s double, n long, w long, light boolean"))
    bucket_of = lambda h: F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(buckets)) * 2 + h.bitwiseAND(1), F.lit(buckets)).cast("int")  # noqa: E731  unsigned h % buckets
    head_pieces = heads.filter("light").select(bucket_of(F.col("w")).alias("bucket"), F.array("w").alias("word"), F.array(F.lit(1)).alias("n"), F.array(F.lit(1)).alias("sign"), F.array("id").alias("docs"), F.array().cast("array<double>").alias("sums"))
    table = counts.select(bucket_of(F.col("h")).alias("bucket"), "h", "c")

    def words(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"part": np.zeros(0, np.int64), "ids": pd.Series([], dtype=pd.ArrowDtype(pa.list_(pa.int64()))), "sums": pd.Series([], dtype=pd.ArrowDtype(pa.list_(pa.float64())))})
        h, c = right["h"].to_numpy(), right["c"].to_numpy()
        order = np.argsort(h)
        h, ln = h[order], np.log(c[order])
        done = left["sums"].map(len) > 0  # what the pairs' buckets have summed passes through
        ids, sums = [np.concatenate(left.loc[done, "docs"].to_list())] if done.any() else [], left.loc[done, "sums"].to_list()
        if not done.all():
            word, n, sign, docs_ = (np.concatenate(left.loc[~done, c].to_list()) for c in ("word", "n", "sign", "docs"))
            ids.append(docs_)
            sums.append(np.repeat(ln[np.searchsorted(h, word)], n) * sign)
        ids, sums = _sum_by(np.concatenate(ids), np.concatenate(sums))
        part = (pair_hash(ids.view(np.uint64), ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, starts = np.unique(part[order], return_index=True)
        return pd.DataFrame({"part": held, "ids": np.split(ids[order], starts[1:]), "sums": np.split(sums[order], starts[1:])})

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sums = _sum_by(np.concatenate(pdf["ids"].to_list()), np.concatenate(pdf["sums"].to_list()))
        return pd.DataFrame({"id": ids, "s": sums})

    light = scored.unionByName(head_pieces).groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(words, "part long, ids array<long>, sums array<double>")
    light = light.groupBy("part").applyInPandas(totals, "id long, s double")
    sums = light.unionByName(heads.select("id", "s")).groupBy("id").agg(F.sum("s").alias("s"))
    sizes = heads.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("times"))  # rows equal in id and text share a key
    each = sizes.join(sums, "id").select("id", (F.col("n") / F.col("times")).cast("long").alias("n"), (F.col("s") / F.col("times")).alias("s"))
    out = rows.select("own", "id").join(each, "id", "left")
    log_score = F.coalesce("s", F.lit(0.0))
    return out.select(F.col("own").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_tokens"), log_score.alias("log_score"), F.when(F.col("n") > 0, log_score / F.col("n")).alias("mean_log_score"))
