"""Operators with one right answer, against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import backoff, bpe, nndescent, packing, rows, sharding, simhash, topk
from tessera.llm.registry import vocabulary


def texts() -> list:
    rnd = random.Random(3)
    words = "the cat sat on a mat with Éclair über naïve 3.14 don't <|endoftext|> 中文 😀 ﬁ Σας".split()
    made = [None, "", " ", "one", "x" * 5_000, "tab\tand\nline  two  blanks ", "\x1c odd \x85 space　", " ".join(rnd.choices(words, k=6_000))]
    made += [" ".join(rnd.choices(words, k=rnd.randrange(1, 60))) for _ in range(60)]
    return made + made[8:20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, FP string").repartition(3).cache()


def test_texts_reach_python_in_bounded_batches(spark):
    """A task's texts are not one Arrow batch, in the operators' own stages too; a lower bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def run(batches):
        for b in batches:
            yield b.select(["id"]).slice(0, 1).set_column(0, "id", pa.array([b.nbytes]))

    big = spark.range(3_000, numPartitions=1).select("id", F.repeat(F.lit("0123456789"), 1_000).alias("text"))
    try:
        simhash.sketches(big.limit(1).select("id", F.lit(0).cast("long").alias("k0"), F.lit(0).cast("long").alias("k1"), "text"), 5, 10).collect()
        assert max(r.id for r in big.mapInArrow(run, "id long").collect()) < 5 << 20
        spark.conf.set(name, "1m")
        got = [r.id for r in rows.over_texts(big, run, "id long").collect()]
        assert len(got) > 28 and max(got) < 2 << 20 and spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
    assert [rows.in_bytes(x) for x in ("67108864b", "4m", "1g", "12")] == [64 << 20, 4 << 20, 1 << 30, 12]


def test_bpe_is_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = sorted((r.text or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, vocabulary("word_bpe_49k.json"), keep_text=True).collect())
    want = []
    for x in texts():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((x or "", len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_stream_is_whole(spark):
    t = bpe.load(vocabulary("word_bpe_49k.json"))
    word = "".join(random.Random(1).choices("abcdefghij", k=9_000))
    assert list(t.word([word])) == list(t.word([word[i : i + 7] for i in range(0, 9_000, 7)]))
    m = bpe.Utf8Machine()
    data = "aé中😀".encode() + b"\xff\xe4"
    assert "".join([m.feed(data[i : i + 1]) for i in range(len(data))]) + m.close() == data.decode("utf-8", "replace")


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs.filter("doc_id is not null"), vocabulary("byte_bpe_50k.json")).collect()
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in enumerate(texts()) if i != 5}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert sum(n for _, n in own) <= 2048 and [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()


def test_packing_quick_encoder(spark):
    coder, rnd = packing.load(vocabulary("byte_bpe_50k.json")), random.Random(9)
    assert coder.quick is not None
    for _ in range(500):
        x = "".join(rnd.choices("ab' \n\r\t.,ZÉßñœ09½’“'s'll|<>\x1c\x85", k=rnd.randrange(50)))
        assert coder.encode(x) == np.array(coder.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def smallest_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, parts, run = (low + high) // 2, 1, 0
        for s in sizes:
            parts, run = (parts + 1, s) if run + s > mid else (parts, run + s)
        low, high = (low, mid) if parts <= k else (mid + 1, high)
    return low


def test_sharding(spark, docs):
    rows = sharding.shard(docs, shards=5).collect()
    assert len(rows) == len(texts())
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    by_text = {}
    for x in texts():
        key = "0" * 64 + "-" if x is None else hashlib.sha256(x.encode()).hexdigest()
        by_text[key] = by_text.get(key, 0) + len((x or "").encode()) + 8
    sums = [sum(r["size"] for r in rows if r.shard == k) for k in range(5)]
    assert max(sums) == smallest_capacity([by_text[k] for k in sorted(by_text)], 5)


@pytest.mark.parametrize("n,index_rows", [(3, 64), (700, 64)])
def test_cuts_settle(spark, n, index_rows):
    rnd = random.Random(n)
    sizes = [rnd.choice([8, 9, rnd.randrange(8, 500_000)]) for _ in range(n)]
    rows = [(int(e), s, i + 1) for i, (e, s) in enumerate(zip(np.cumsum(sizes), sizes))]
    ends = sharding.minimax_cuts(spark.createDataFrame(rows, "end_bytes long, bytes long, rank long"), 24, index_rows)
    assert max(np.diff([0, *ends])) == smallest_capacity(sizes, 24)


def test_simhash(spark, docs):
    import xxhash

    def brute(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: brute(x) for i, x in enumerate(texts()) if i != 5}
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in rows if r.doc_id is not None} == prints
    group = {i: i for i in prints}
    for i in sorted(prints):
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
    assert {r.doc_id: r.component for r in rows if r.doc_id is not None} == group


def test_simhash_tiles(spark):
    """One crowded cell dealt into tiles loses no link."""
    fp = spark.createDataFrame([(i, i) for i in range(64)], "fp long, rep long").cache()
    from tessera.operators.components import connected_components

    assert connected_components(simhash.links(fp, tile=8)).select("component").distinct().count() == 1


def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    rows = [(i, (base[i % 12] + rng.normal(size=6) * 0.12).tolist(), i % 3) for i in range(200)]
    rows += [(200, None, 0), (201, [0.0] * 6, 1), (202, [float("nan")] * 6, 1), (203, rows[0][1], 0), (204, rows[1][1], None), (205, [], 2), (206, [1.0, None], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).cache()


def test_topk(spark):
    rows, df = vectors(spark)
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {(q, r + 1, i, s) for q in whole if q % 20 == 0 for r, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])), key=lambda p: (-p[0], p[1]))[:20])}
    assert {tuple(r) for r in topk.top_k(df, block_rows=32, query_rows=4).collect()} == want


def test_topk_of_huge_components_and_zero_vectors(spark):
    """Components whose squares, or whose scaled values, are beyond a double; ties of clamped and of zero products."""
    big = [[1e160, 1.0], [-1e160, 2.0], [1e307, 1.0], [3e9, 3e9], [-3e9, 1.0], [0.0, 0.0], [0.0, 0.0], [1.0, 2.0], [-2.0, 0.5], [1e30, -1e30]] * 4
    rows = [(i, v) for i, v in enumerate(big)]
    lim, top = np.iinfo(np.int64), float(np.finfo(float).max)
    whole = {i: [int(min(top, max(-top, float(np.floor(64 * np.float64(x)))))) for x in v] for i, v in rows}
    held = lambda a, b: max(lim.min, min(lim.max, sum(x * y for x, y in zip(a, b))))
    want = {(q, r + 1, i, s) for q in whole if q % 4 == 0 for r, (s, i) in enumerate(sorted(((held(whole[q], v), i) for i, v in whole.items() if i != q), key=lambda p: (-p[0], p[1]))[:7])}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for size in (4, 100):
        assert {tuple(r) for r in topk.top_k(df, k=7, query_every=4, block_rows=size, query_rows=2).collect()} == want


def test_topk_floors_hold_rows_back():
    """A cell returns at most k rows a query, and none that does not beat the floor, however many candidates tie."""
    x = np.ones((5_000, 8))
    q, ids = np.ones((3, 8)), np.arange(10, 5_010)
    at, got, score = topk.search_cell(np.arange(3), q, np.full(3, np.iinfo(np.int64).min), np.full(3, np.iinfo(np.int64).max), ids, x, None, 20)
    assert len(got) == 60 and set(got) == set(range(10, 30)) and set(score) == {8}
    assert len(topk.search_cell(np.arange(3), q, np.full(3, 8), np.full(3, 9), ids, x, None, 20)[1]) == 0


def test_embedding_links(spark):
    rows, df = vectors(spark)
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and lab is not None}
    near = {i: [j for j in good if j != i and good[j][1] == good[i][1] and float(good[i][0] @ good[j][0]) >= 0.93] for i in good}
    group = {i: i for i, _, _ in rows}
    for i, js in near.items():
        for j in js:
            a, b = sorted((group[i], group[j]))
            group = {k: a if v == b else v for k, v in group.items()}
    want = {i: (len(near.get(i, [])), group[i], group[i] == i) for i, _, _ in rows}
    assert {r.vec_id: tuple(r)[1:] for r in nndescent.near_duplicates(df).drop("recall").collect()} == want


def test_embedding_links_of_a_large_label(spark):
    """Isolated pairs just above the threshold, few among many thousand vectors and a hot class, all keep their link."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(18_000, 64))
    v[:700] = v[0] + 0.1 * rng.normal(size=(700, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for i in range(1_000, 1_160, 2):
        away = v[i + 1] - v[i] * (v[i] @ v[i + 1])
        v[i + 1] = 0.935 * v[i] + (1 - 0.935**2) ** 0.5 * away / np.linalg.norm(away)
    n = np.concatenate([(v[a : a + 1000] @ v.T >= 0.93).sum(1) - 1 for a in range(0, len(v), 1000)])
    order = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), v[i].tolist(), 0) for i in order], "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(v))] == n.tolist()
    assert all(got[i].component_id == i - i % 2 for i in range(1_000, 1_160)) and all(got[i].component_id == 0 for i in range(700))


def backoff_brute(texts):
    """(tokens, score) of every text by the definition."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    one, two = Counter(a for w in words for a in w), Counter(p for w in words for p in zip(w, w[1:]))
    total = sum(one.values())
    pair = lambda u, x: np.log(two[u, x] / one[u]) if two[u, x] >= 2 else np.log(0.4 * one[x] / total)
    return [(len(w), float((np.log(one[w[0]] / total) if w else 0.0) + sum(pair(u, x) for u, x in zip(w, w[1:])))) for w in words]


@pytest.mark.parametrize("heavy,hot,one_in", [(20, 0, 64), (20, 50, 1), (500_000, 100_000, 1)])
def test_backoff(spark, docs, heavy, hot, one_in):
    """Whatever is heavy or hot, every row has the score of its own text; repeats and rows without an id too."""
    got = backoff.score(docs.withColumn("d", F.col("doc_id")), bucket_chars=20_000, heavy=heavy, hot_pairs=hot, hot_sample=one_in).collect()
    want = backoff_brute(texts())
    ids = [i if i != 5 else None for i in range(len(want))]
    assert sorted((str(r.doc_id), r.n_tokens, round(r.log_score, 5)) for r in got) == sorted((str(i), n, round(s, 5)) for i, (n, s) in zip(ids, want))


def test_backoff_of_repeats_null_ids_and_one_row(spark):
    made = [(1, "a b c"), (None, "a b"), (None, "c d"), (2, "c d a"), (None, "b"), (None, None), (3, "d d"), (0, "b c"), (1, "a b c"), (1, "c c"), (None, "a b"), (4, ""), (5, "\t ")]
    for rows in (made, made[:1], [(None, None)], [(7, "one")], [(7, "one"), (7, "one")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        want = sorted((str(i), n, round(s, 6), round(s / n, 6) if n else None) for (i, _), (n, s) in zip(rows, backoff_brute([x for _, x in rows])))
        for heavy, hot in ((1, 0), (20, 10)):
            got = backoff.score(df, heavy=heavy, hot_pairs=hot, hot_sample=1).collect()
            assert sorted((str(r.doc_id), r.n_tokens, round(r.log_score, 6), r.mean_log_score and round(r.mean_log_score, 6)) for r in got) == want


def test_backoff_takes_texts_in_bounded_batches(spark):
    """Each stage of op10 that reads whole texts bounds its Arrow batches, whatever ran in the session before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, docs = spark.conf.get(name), spark.createDataFrame([(1, "a b c"), (2, "b c")], "doc_id long, text string")
    calls = [lambda: backoff.score(docs), lambda: backoff.gram_counts(docs, np.zeros(0, np.uint64)), lambda: backoff.hot_pairs_of(docs, 5, 1, 100), lambda: backoff._pairs(docs, 8, 100, np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    try:
        for call in calls:
            spark.conf.set(name, "64m")
            call()
            assert rows.in_bytes(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.set(name, before)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert packing.pack_documents(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert sharding.shard(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert backoff.score(none).count() == 0 and topk.top_k(vec).count() == 0 and nndescent.near_duplicates(vec).count() == 0


def test_embedding_audit_is_told(spark):
    """Small labels go through the rounds too; the audit tells their recall where a drawn vector has a link."""
    _, df = vectors(spark)
    rows = nndescent.near_duplicates(df).collect()
    linked = [r for r in rows if r.n_links]
    assert linked and all(r.recall is not None and 0.9 <= r.recall <= 1 for r in linked)
