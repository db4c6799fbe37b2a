"""Fill-in-the-middle, repeated byte strings and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import infill, ranked, suffixes

WORDS = "the cat sat on a mat with Éclair über naïve 3.14 don't 中文 😀 ﬁ Σας".split()


def some_texts() -> list:
    rnd = random.Random(7)
    mk = lambda n: " ".join(rnd.choices(WORDS, k=n))
    passage = mk(60)
    made = [None, "", " ", "\t\n", "one", "a <P> b", "x" * 3_000, "ab" * 300, passage, passage, passage, " lead", "trail \n", "\x1c odd \x85 space　end"]
    made += [mk(30) + passage + mk(40), mk(10) + passage[3:] + mk(5), mk(2_000) + passage]
    made += [mk(20) + passage[: 150 + 5 * i] + mk(20) for i in range(20)]
    base = mk(300).split()
    for _ in range(12):
        words = list(base)
        for _ in range(6):
            words[rnd.randrange(300)] = f"zz{rnd.randrange(99)}"
        made.append(" ".join(words))
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 9 else None, t, "clash", b"x") for i, t in enumerate(some_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, N_bytes string, kept binary").repartition(3).cache()


def test_fill_in_middle(spark, docs):
    unit = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    rows = {r.doc_id: r for r in infill.restore(infill.transform(docs.withColumn("FORM", F.lit(1)), rate=90)).collect()}
    assert len(rows) == docs.count() and {r.form for r in rows.values()} == {"plain", "psm", "spm"}
    for i, r in rows.items():
        t = r.text or ""
        units = unit.findall(t)
        h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[j : j + 8], 16) for j in range(0, 32, 8))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or "<P>" in t or h3 % 100 >= 90 else "spm" if h4 % 100 < 80 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.restored) == (len(units), form, want, t)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert infill.digests(docs).count() == len(rows) and infill.digests(docs.limit(0)).count() == 0


def kept_bytes(texts: list, width: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if times[r[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot", [8192, 2])
def test_repeated_strings(spark, docs, hot, monkeypatch):
    real = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda *a, **k: real(*a, **k, hot=hot))  # 2: every group goes window by window
    rows = suffixes.without_repeats(docs).collect()
    want = kept_bytes(some_texts(), 200)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in rows)
    assert got == sorted((-1 if i == 9 else i, *w) for i, w in enumerate(want))
    assert sum(w[1] for w in want) > 10_000
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in rows)


def test_repeats_of_nothing(spark, docs):
    assert suffixes.without_repeats(docs.limit(0)).count() == 0
    one = suffixes.without_repeats(docs.filter("doc_id < 6")).collect()
    assert len(one) == 6 and all(r.n_removed == 0 for r in one)


def test_a_long_text_spans_blocks(spark):
    rnd = random.Random(5)
    passage = "".join(rnd.choices("abcdefgh ", k=900))
    long = "".join(rnd.choices("abcdefgh ", k=suffixes.BLOCK - 400)) + passage + "".join(rnd.choices("abcdefgh ", k=70_000)) + passage[100:700]
    texts = [long, "z" + passage[:205]]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffixes.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(i, *w) for i, w in enumerate(kept_bytes(texts, 200))]


def test_induced_order():
    """Order and common prefixes of each step are those of the suffixes themselves."""
    rnd = np.random.default_rng(3)
    rows = rnd.integers(97, 99, (60, 24), dtype=np.uint8)
    group = np.sort(rnd.integers(0, 4, 60))
    words = rows.view(">u8").astype(np.uint64)
    order, common = np.arange(60), np.zeros(60, np.uint8)
    for t in range(words.shape[1] - 1, -1, -1):
        order, common = suffixes.induce(order, common, group, words[:, t], 8, 200)
        tails = [(int(group[i]), bytes(rows[i, 8 * t :])) for i in order]
        assert tails == sorted(tails)
        for j in range(1, 60):
            (ga, a), (gb, b) = tails[j - 1], tails[j]
            assert common[j] == (next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), len(a)) if ga == gb else 0)


def bm(docs_rows: list, items: list, k: int) -> set:
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(i, Counter(word.findall((t or "").translate(low)))) for i, t in docs_rows]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = set()
    for item, text in set(items):
        asked = set(word.findall((text or "").translate(low)))
        scores = []
        for i, c in terms:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if s > 0 and i is not None and item is not None:
                scores.append((-s, i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def test_ranked_search(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Éa", "中文"]
    rows = [(i, " ".join(rnd.choices(words, weights=range(1, 63), k=rnd.randrange(1, 60)))) for i in range(400)]
    rows += [(1000 + i, t.upper()) for i, (_, t) in enumerate(rows[:80])] + [(None, "w1 w2"), (2000, None), (2001, ""), (2002, "..."), (2003, "w61 " * 5_000)]
    items = [(i, " ".join(rnd.choices(words, k=12))) for i in range(10)] + [(3, "w5, w7; W9"), (4, None), (5, "nowhere"), (None, "w1"), (6, "w3"), (6, "w3")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Rank string").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    want = bm(rows, items, 7)
    for shard_rows, block in ((16, 512), (64, 3)):
        got = ranked.search(docs, asked, k=7, depth=3, shard_rows=shard_rows, block=block, first=1, growth=2).collect()
        assert len(got) == len(want) and {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == want
    assert ranked.search(docs.limit(0), asked).count() == 0 and ranked.search(docs, asked.limit(0)).count() == 0


def test_bisection_parts_topics():
    rnd = random.Random(2)
    lists = [sorted(rnd.sample(range(20 * (i % 2), 20 * (i % 2) + 20), 8)) for i in range(64)]
    rnd.shuffle(lists)
    tree = ranked.bisect(lists, 40, 1)
    doc = np.repeat(np.arange(64), 8)
    leaf = tree.leaves(doc, np.concatenate(lists), 64)
    assert {int(leaf[i]) for i, x in enumerate(lists) if x[0] < 20} != {int(leaf[i]) for i, x in enumerate(lists) if x[0] >= 20}
    assert sorted(Counter(leaf.tolist()).values()) == [32, 32]


def test_pieces_meet_without_a_second_join(spark, monkeypatch):
    """Groups that are sorted and groups that go by hashes read the same stored pieces: whole texts are joined once."""
    plans = []
    for name in ("sorted_runs", "window_runs"):
        real = getattr(suffixes, name)
        monkeypatch.setattr(suffixes, name, lambda held, *a, real=real: (plans.append(held._jdf.queryExecution().optimizedPlan().toString()), real(held, *a))[1])
    rnd = random.Random(5)
    passages = ["".join(rnd.choices("abcdefgh ", k=260)) for _ in range(3)]
    texts = ["".join(rnd.choices("abcdefgh ", k=40)) + passages[i % 3] + "".join(rnd.choices("abcdefgh ", k=40)) for i in range(9)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(c for c in [r.cover for r in suffixes.repeats(rows, hot=2).collect()])
    assert len(plans) == 2 and not any("Join" in p for p in plans)
