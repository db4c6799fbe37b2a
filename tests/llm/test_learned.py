"""Learned operators: held-out accuracy over the small driver tables, defined results, and the pipeline's rules."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label, by, rest):
    out = registry.queries()[name](spark, SF).filter("held_out")
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id")
    assert rows.filter(F.crc32(F.col("doc_id").cast("string")) % by != rest).isEmpty()
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_toxicity(spark):
    assert held_out(spark, "op1_toxicity", "toxic", 5, 0) >= 0.95


def test_quality(spark):
    assert held_out(spark, "op7_quality", "quality", 4, 2) >= 0.95


def test_language(spark):
    out = registry.op4_language(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.98


def test_segments():
    """The linear scan finds the runs that a definition by recursion gives; of equal runs the shorter is maximal."""
    import random

    def brute(s, at=0):
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return brute(s[:i], at) + [(at + i, at + j, best[0])] + brute(s[j:], at + j)

    rnd = random.Random(2)
    for _ in range(200):
        s = [rnd.choice([-30, -15, -10, 7, 11, 23]) for _ in range(rnd.randrange(1, 14))]
        got = toxicity.maximal_segments([(i, i + 1, x) for i, x in enumerate(s)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(s)]


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !", "c"), (None, "words here", "d"), (5, "word " * 50_000, "e")], "doc_id long, text string, Score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.segments == [] for r in rows.values())
    rows = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(rows) == 5 and all(r.score == pytest.approx(0.5) for r in rows)
    made = langid.predict(docs, langid.LanguageModel()).collect()
    assert {r.lang_pred for r in made} == {"und"} and len(made) == 5


def test_margin_by_length():
    """The bar of a class, of the nearest one above the shortest, the shorter of two; none below the shortest."""
    model = langid.LanguageModel({}, {5: 0.1, 9: 0.3})
    assert [model.least(n) for n in (0, 1, 15, 16, 31, 64, 128, 300, 10**7)] == [0.0, 0.0, 0.0, 0.1, 0.1, 0.1, 0.3, 0.3, 0.3]
    assert langid.LanguageModel().least(100) == 0.0


def test_short_texts_stay(spark):
    """A word or two, which no training text is as short as, is accepted whatever its margin; no letter at all is not."""
    words = {"en": "the house and the river were of old stone", "fr": "la maison et le fleuve furent de pierre", "de": "das haus und der fluss waren aus stein"}
    rows = [(i, " ".join([words[la]] * 8), la) for i, la in enumerate(list(words) * 150)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "zz"), (2, "Von."), (3, "12")], "doc_id long, text string")
    assert model.narrow and {r.doc_id: r.accepted for r in langid.predict(asked, model).collect()} == {1: True, 2: True, 3: False}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) in (4, 5)
    before, kept = docs.count(), docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
    assert 0.8 * before < kept.count() <= before
    packed = P.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
