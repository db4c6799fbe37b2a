"""Learned operators against the whole computation written out plainly, and stages against brute force on odd inputs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql.classic.dataframe import DataFrame

from tessera.llm import langid, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def rest(i, by):
    return zlib.crc32(str(i).encode()) % by


def labelled():
    """200 texts of a small vocabulary; toxic ones hold one to four words of their own, some clean ones hold one by chance."""
    rnd = random.Random(11)
    plain, bad = ["".join(rnd.choices(LETTERS, k=rnd.randrange(2, 8))) for _ in range(120)], ["grolk", "snarfing", "snarfed", "bleeg"]
    rows = []
    for i in range(200):
        toxic = int(rnd.random() < 0.3)
        words = rnd.choices(plain, k=rnd.randrange(5, 60))
        at = rnd.randrange(len(words))
        words[at:at] = rnd.choices(bad, k=rnd.randrange(1, 5)) if toxic else rnd.choices(bad, k=1) if rnd.random() < 0.05 else []
        rows.append((i, " ".join(words).capitalize() + "!", toxic))
    return rows


def segments(s, at=0):
    """Maximal segments by their definition: the best sum (of equal ones the longer, then the first), then both sides."""
    best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i, j = best[3], best[4]
    return segments(s[:i], at) + [(at + i, at + j, best[0])] + segments(s[j:], at + j)


def test_toxicity_written_out(spark):
    rows = labelled()
    seen = [r for r in rows if rest(r[0], 5) not in (0, 4)]
    words = lambda t: [w.strip("!").lower() for w in t.split()]
    holds = lambda t: set(words(t)) | {"~" + w[:5] for w in words(t) if len(w) > 5}
    toxic, clean = Counter(), Counter()
    for _, t, y in seen:
        (toxic if y else clean).update(holds(t))
    a0, b0 = sum(toxic.values()), sum(clean.values())
    scores, shares = {}, []
    for f in toxic:
        alpha = 0.5 + 1000 / (a0 + b0) * (toxic[f] + clean[f])
        a, b = toxic[f] + alpha, clean[f] + alpha
        d = math.log(a / (a0 + 1000 - a)) - math.log(b / (b0 + 1000 - b))
        if toxic[f] >= 2 and d / math.sqrt(1 / a + 1 / b) >= 3.5 and d > 0.5:
            scores[f] = d
            if f[0] != "~":
                shares.append(((clean[f] + 0.5) / (b0 + 1000), d))
    assert {"grolk", "~snarf", "bleeg"} <= set(scores)
    total = sum(p for p, _ in shares)
    shares = [(p / max(1.0, total / 0.25), d) for p, d in shares]
    low, high = 0.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        v = sum(p * math.exp(mid * d) for p, d in shares) + (1 - sum(p for p, _ in shares)) * math.exp(-mid * 0.5)
        low, high = (mid, high) if v < 1 else (low, mid)
    lam = low
    value = lambda w: scores.get(w, scores.get("~" + w[:5], 0.0) if len(w) > 5 else 0.0)
    found = lambda t: segments([value(w) if value(w) > 0 else -0.5 for w in words(t)])
    sample = [(t, y) for i, t, y in rows if rest(i, 5) == 4]
    best = [(max((s for *_, s in found(t)), default=0.0), len(words(t))) for t, y in sample if not y]
    log_k = math.log(max(sum(s > 0 for s, _ in best), 0.5) / sum(n * math.exp(-lam * s) for s, n in best))
    evidence = lambda t: sum(max(0.0, lam * s - log_k - math.log(len(words(t)))) for *_, s in found(t))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    # labels of held-out rows are turned round: nothing may come of them
    labels = spark.createDataFrame([(i, 1 - y if rest(i, 5) == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.scores == pytest.approx(scores) and (model.lam, model.log_k) == pytest.approx((lam, log_k))
    x, y = np.array([[1, math.log1p(evidence(t))] for t, _ in sample]), np.array([y for _, y in sample], float)
    q = 1 / (1 + np.exp(-x @ [model.bias, model.slope]))
    assert np.abs(x.T @ (y - q) - 1e-2 * np.array([model.bias, model.slope])).max() < 1e-6  # the logistic fit has no gradient left
    for r in toxicity.score(docs, model).collect():
        e = evidence(r.text)
        assert r.evidence == pytest.approx(e) and r.score == pytest.approx(1 / (1 + math.exp(-(model.bias + model.slope * math.log1p(e)))))
        for s in r.segments:
            assert all(value(w) > 0 for w in (words(r.text[s.start : s.end])[0], words(r.text[s.start : s.end])[-1]))


def test_toxic_spans_of_growing_lower_case():
    model = toxicity.ToxicityModel({"grolk": 9.0}, log_k=-5.0)
    text = "İİ iz GROLK grolk end"
    found, _ = model.segments(text, model.lookup())
    assert [text[s["start"] : s["end"]] for s in found] == ["GROLK grolk"]


def test_held_out_labels_give_no_share(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rest(i, 5) == 0)) for i in range(40)], "doc_id long, toxic int")
    assert {r.score < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {True}


def test_language_written_out(spark):
    """Sizes, choice, margin and rejection of every text, from the model's dictionaries by plain calls of the library."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rnd = random.Random(2)
    noise = [(10_000 + i, " ".join("".join(rnd.choices(LETTERS, k=rnd.randrange(2, 10))) for _ in range(n)), None) for i, n in enumerate([300, 1000, 2000])]
    odd = [(20_000, "½ ² Ⅷ", "en"), (20_001, None, "en"), (20_002, "", None), (None, "words without an id", "de"), (20_003, "ß", None)]
    docs = rows.unionByName(spark.createDataFrame(noise + odd, "doc_id long, text string, lang string")).cache()
    model = langid.fit(docs)

    def size(content, level, data, block):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        z = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(z.compress(data[i : i + block])) for i in range(0, len(data), block))

    for r in langid.predict(docs.filter("doc_id is null or doc_id < 200 or doc_id >= 10000"), model).collect():
        letters = "".join(c if langid.regex.match(r"[\p{L}\p{M}]", c) else " " for c in (r.text or "").lower()).split()
        if not any(langid.regex.search(r"\p{L}", w) for w in letters):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        data = (" " + " ".join(letters) + " ").encode()
        sizes = {k: float(size(b" ".join(parts[:2]), 6, data, 16_384)) for k, parts in model.contents.items()}
        gap = lambda s: (sorted(s.values())[1] - min(s.values())) / sorted(s.values())[1]
        if gap(sizes) < 0.03:
            sizes = {k: sum(size(p, 9, data, 4_096) for p in parts) / len(parts) for k, parts in model.contents.items()}
        assert r.lang_pred == min(sizes, key=lambda k: sizes[k]) and r.margin == pytest.approx(gap(sizes))
        assert r.accepted == (gap(sizes) >= model.least(len(data)))
        if r.doc_id is not None and 10_000 <= r.doc_id < 20_000:
            assert not r.accepted


def test_one_language_rejects_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' and length(text) > 300").select("doc_id", "text", "lang").limit(300)
    model = langid.fit(docs)
    rnd = random.Random(4)
    noise = spark.createDataFrame([(i, " ".join("".join(rnd.choices(LETTERS, k=rnd.randrange(2, 10))) for _ in range(300))) for i in range(20)], "doc_id long, text string")
    assert langid.predict(noise, model).filter("accepted").count() == 0
    assert langid.predict(docs, model).filter("accepted").count() >= 0.98 * docs.count()


def test_attention_gradient():
    """One step of plain descent moves every layer against the gradient that finite differences give."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, 7)) for n in (1, 3, 5, 2)]
    y = np.array([0.0, 1.0, 1.0, 0.0])

    def loss(m):
        p, _ = m.scores(bags)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    start = quality.train(bags, y, hidden=4, gate=3, epochs=0)
    start.c = rng.normal(size=5)
    x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]
    grads = quality.gradients(start, x, starts, y)
    for name, g in grads.items():
        layer = getattr(start, name)
        for at in np.ndindex(layer.shape):
            kept, step = layer[at], 1e-6
            layer[at] = kept + step
            up = loss(start)
            layer[at] = kept - step
            down = loss(start)
            layer[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def near_copies():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices(LETTERS, k=rnd.randrange(3, 9)))
    shared = [word() for _ in range(30)]
    rows = [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "One two"), (6, "one two three"), (6, "other text under one id"), (6, "other text under one id")]
    for g in range(25):
        base = [word() for _ in range(rnd.randrange(8, 200))] + (shared if g % 3 == 0 else [])
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(copy) // 60)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((100 + len(rows), " ".join(copy)))
    return rows


def holds(rows, kept):
    """No two kept texts are alike, and every text that goes is like one that stays."""

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = [grams(t) for i, t in kept if i is not None]
    assert not any(like(a, b) for n, a in enumerate(sets) for b in sets[:n])
    assert all(any(like(grams(t), s) for s in sets) for i, t in rows if i is not None and (i, t) not in kept)


def test_near_copies_by_brute_force(spark):
    """What goes is as similar to something that stays, what stays is not alike, rows without an id stay, repeats go."""
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, NODE string").repartition(4)
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sum(i is None for i, _ in kept) == 2 and len(kept) == len(set(kept)) + 1

    holds(rows, kept)
    assert {i for i, _ in kept} >= {1, 4, 6} and not {2, 3, 5} & {i for i, _ in kept}
    assert sum(i == 6 for i, _ in kept) == 2


def test_a_class_beyond_the_bound_is_settled_in_rounds(spark, monkeypatch):
    """A class of 120 near copies, five texts at a time."""
    rnd = random.Random(1)
    base = [["".join(rnd.choices(LETTERS, k=6)) for _ in range(60)] for _ in range(2)]
    base[1][:28] = base[0][:28]  # the groups share a passage and may be one class
    rows = []
    for i in range(120):
        w = list(base[i % 2])
        w[40 + i % 15] = f"w{i}"
        rows.append((i, " ".join(w)))
    plain = simhash.dropped_texts
    monkeypatch.setattr(simhash, "dropped_texts", lambda *a: plain(*a, bound=300))
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    holds(rows, kept)
    assert {0, 1} <= {i for i, _ in kept} and len(kept) < 40


def stages():
    import corpus_pipeline as P

    return P.STAGES


def test_stages_on_odd_tables(spark):
    """Nulls anywhere, empty and long texts, repeats, ties, other columns, and no rows at all."""
    rows = [(None, None, None, None, None), (1, None, "en", "s", 1), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 5), (3, "another text of the same id", "de", None, 5), (3, "another text of the same id", "de", None, 5), (4, "12 % 34", None, "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.filter("doc_id < 0"), docs.selectExpr("*", "1 as score", "2 as fp", "3 as lang_pred")):
        now = table
        for name, stage in stages()[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns, name
            before, now = now.count(), now.cache()
            assert before == now.count()
        packed = stages()[-1][1](spark, now, SF)
        assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_no_language_learned_keeps_the_corpus(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", None, "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(stages())["language"](spark, docs, SF).count() == 5


def test_tiles_are_dealt_apart(spark, monkeypatch):
    """Pairs of tiles of one group meet in several tasks, not in the one of their group."""
    from tessera.llm import nndescent

    members = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(400)], "part long, key long, v array<double>")
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *by, plain=DataFrame.repartition: plain(df, 8, *by))  # else few rows are put together again
    spread = nndescent._spread(members, "part", 50)
    counts = defaultdict(set)
    for r in spread.selectExpr("spark_partition_id() as p", "t1", "t2").collect():
        counts[r.t1, r.t2].add(r.p)
    assert all(len(p) == 1 for p in counts.values()) and len(set().union(*counts.values())) > 3


def test_heads_are_small_and_right():
    """Texts that stay take few bytes an entry, and likeness is that of whole shingle sets."""
    import tracemalloc

    rnd = np.random.default_rng(2)
    sets = [np.unique(np.r_[np.arange(100), rnd.integers(0, 1 << 60, rnd.integers(100, 400))]) for _ in range(300)]
    sets += [np.unique(np.r_[s[: len(s) - len(s) // k], rnd.integers(0, 1 << 60, 2)]) for s, k in zip(sets, [5, 8, 12, 30] * 20)]
    tracemalloc.start()
    heads, stays, entries = simhash.Heads(0.8, sets), [], 0
    for s in sets:
        like = any(len(np.intersect1d(s, t)) >= 0.8 * len(np.union1d(s, t)) for t in stays)
        assert heads.like(s) == like
        if not like:
            heads.add(s)
            stays.append(s)
            entries += len(s)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 300 < len(stays) < 380 and kept < 40 * entries
