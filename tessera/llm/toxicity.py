"""Toxic passages by maximum-scoring segment search.

Fitting counts, for every word and every word beginning, the labelled documents of each class that hold it, and
turns the counts into log-odds under an informative Dirichlet prior. Scoring finds all maximal segments of a
document's word scores in one linear scan (Ruzzo and Tompa), converts each sum to a normalised score
``lambda * S - ln(K * n)`` of the extreme-value (Karlin-Altschul) law, and adds those above zero. K comes from the best
segments of clean documents. A one-variable logistic fit on labelled documents that the word counts did not see maps that
evidence to a probability.

Defined results: a null, empty or word-free text has no segment and gets the score of no evidence; repeated rows are
scored alike, and rows with a null id are scored but not learnt from; rows that repeat an id are one document for the
calibration, the one of most evidence; a label that repeats counts as its largest; a training set without both classes
gives a constant score, the share of label 1 among the training labels (0 when there is none); an empty table gives an empty
result; a column named like a new one is replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rows import append, double, over_texts, remainder, slices
from tessera.session import broadcast_if_small, cut

WORD = re.compile(r"[^\W\d_]+")
STEM = 5
SEGMENT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("log_e", T.DoubleType())]))
SEGMENT_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())]))


def features(words) -> set[str]:
    """A text's words and, marked by a leading tilde, the first five letters of its longer words."""
    distinct = set(words)
    return distinct | {"~" + w[:STEM] for w in distinct if len(w) > STEM}


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring runs of disjoint ordered (start, end, score) spans, in linear time.

    A kept candidate holds the cumulative sums left of it and up to its end; ``above`` links each candidate to the
    nearest earlier one whose left sum is smaller, so a search never visits a candidate twice.
    """
    kept: list[list] = []  # start, end, left sum, right sum, link to the nearest candidate with a smaller left sum
    total = 0.0
    for start, end, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        item = [start, end, before, total, -1]
        at = len(kept) - 1
        while True:
            while at >= 0 and kept[at][2] >= item[2]:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= item[3]:
                item[4] = at
                kept.append(item)
                break
            item[0], item[2] = kept[at][0], kept[at][2]
            del kept[at:]
            at = len(kept) - 1
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def lowered(text: str) -> str:
    """The text in lower case, character for character: those whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


@dataclass
class ToxicityModel:
    """Word log-odds, the cost of a neutral word, the extreme-value constants, and the two logistic weights."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    log_k: float = 0.0
    bias: float = -20.0
    slope: float = 0.0

    def lookup(self) -> WordScores:
        return WordScores(self.scores)

    def sums(self, words: list[str], lookup: WordScores) -> list[tuple[int, int, float]]:
        """All maximal segments (first word, word behind the last, sum) of a text's words."""
        hits = [(i, s) for i, s in enumerate(map(lookup.__getitem__, words)) if s > 0]
        spans, last = [], 0
        for i, s in hits:
            if i > last:
                spans.append((last, i, -self.drift * (i - last)))
            spans.append((i, i + 1, s))
            last = i + 1
        return maximal_segments(spans)

    def segments(self, text: str | None, lookup: WordScores) -> tuple[list[dict], float]:
        """Significant segments as character spans, and the summed normalised score of the text."""
        low = lowered(text) if text else ""
        words = WORD.findall(low)
        log_kn = self.log_k + math.log(max(1, len(words)))
        found = [(a, b, s, log_kn - self.lam * s) for a, b, s in self.sums(words, lookup) if self.lam * s > log_kn]
        if not found:
            return [], 0.0
        want = {i for a, b, _, _ in found for i in (a, b - 1)}
        at = {i: m.span() for i, m in enumerate(WORD.finditer(low)) if i in want}
        named = [{"start": at[a][0], "end": at[b - 1][1], "score": s, "log_e": e} for a, b, s, e in found]
        return named, sum(-e for _, _, _, e in found)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.bias + self.slope * math.log1p(evidence)))))


class WordScores(dict):
    """Score of any word: its own, else that of its beginning, else 0. Holds at most a million looked-up words."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        score = self.model.get(word)
        if score is None:
            score = self.model.get("~" + word[:STEM], 0.0) if len(word) > STEM else 0.0
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = score
        return score


def _counts(train: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class that hold the feature; partial sums leave each task."""

    def run(batches):
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            keys = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[1][k] for k in keys], pa.int64()), pa.array([sums[0][k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])
            sums[0].clear(), sums[1].clear()
            return out

        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[label].update(features(WORD.findall(lowered(text))))
                if len(sums[0]) + len(sums[1]) > 400_000:
                    yield flush()
        yield flush()

    return over_texts(train, run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_by: int = 5, held_rest: int = 0, chance: float = 3.0, prior: float = 0.5, prior_mass: float = 1000.0, drift: float = 0.5, max_tokens: int = 200_000, calibration_rows: int = 20_000) -> ToxicityModel:
    """Fit on labelled rows whose remainder differs from ``held_rest``.

    Counts cover all of them but those of the remainder before it, of which ``calibration_rows`` documents, in crc32
    order, calibrate. A feature's z must pass a bar that ``chance`` of all features tested would pass by chance alone, so the
    bar rises with the corpus. The model keeps the ``max_tokens`` features of largest z, ties by name.
    """
    rest = remainder(id_col, held_by)
    lab = labels.filter(f"{label_col} in (0, 1)").filter(rest != held_rest).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    rows = docs.select(id_col, text_col).filter(rest != held_rest).filter(F.length(text_col) > 0)
    rows = rows.join(broadcast_if_small(lab), id_col).withColumn("__rest", rest)
    calibrate_on = (held_rest - 1) % held_by
    counts = cut(_counts(rows.filter(F.col("__rest") != calibrate_on).select(text_col, "__label")))
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n_tox, n_clean = (float(x or 0) for x in sums)
    share = lab.agg(F.avg("__label")).first()[0] or 0.0
    constant = ToxicityModel(bias=math.log(max(share, 1e-9) / max(1 - share, 1e-9)), drift=drift)
    if not n_tox or not n_clean:
        return constant
    alpha = F.lit(prior) + F.lit(prior_mass / (n_tox + n_clean)) * (F.col("toxic") + F.col("clean"))
    a, b = F.col("toxic") + alpha, F.col("clean") + alpha
    delta = F.log(a / (F.lit(n_tox + prior_mass) - a)) - F.log(b / (F.lit(n_clean + prior_mass) - b))
    tested = counts.filter("toxic >= 2")
    bar = NormalDist().inv_cdf(1 - min(0.05, chance / max(1, tested.count())))
    scored = tested.withColumn("d", delta).withColumn("z", F.col("d") / F.sqrt(1 / a + 1 / b)).filter((F.col("z") >= bar) & (F.col("d") > drift))
    best = scored.orderBy(F.desc("z"), "feature").limit(max_tokens).collect()
    model = ToxicityModel({r["feature"]: float(r["d"]) for r in best}, drift)
    if not best:
        return constant
    # lambda solves sum(p * exp(lambda * s)) = 1 over a clean document's word scores, neutral words included
    s = np.array([r["d"] for r in best if r["feature"][0] != "~"] or [1.0])
    p = np.array([(r["clean"] + prior) / (n_clean + prior_mass) for r in best if r["feature"][0] != "~"] or [prior / n_clean])
    p = p / max(1.0, p.sum() / 0.25)
    low, high = 0.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        value = float((p * np.exp(mid * s)).sum() + (1 - p.sum()) * math.exp(-mid * drift))
        low, high = (mid, high) if value < 1 else (low, mid)
    model.lam = max(low, 1e-3)
    # the sample is chosen by id alone; its texts are read and scored where they lie
    ids = lab.filter(rest == calibrate_on).orderBy(F.crc32(F.col(id_col).cast("string")), id_col).limit(calibration_rows)
    _calibrate(model, docs.select(id_col, text_col).join(F.broadcast(ids), id_col), id_col, text_col)  # at most calibration_rows ids
    return model


def _calibrate(model: ToxicityModel, sample: DataFrame, id_col: str, text_col: str) -> None:
    """Set K from clean documents' best segments, then the logistic weights from the evidence of all.

    K is the likeliest of the law P(best < s) = exp(-K n e^(-lambda s)), where documents without a segment are known to
    have a best one below zero only: the number of clean documents with a segment over the sum of n e^(-lambda s).
    """

    def run(batches):
        lookup = model.lookup()
        for batch in slices(batches):
            words = [WORD.findall(lowered(t)) if t else [] for t in batch.column(0).to_pylist()]
            sums = [[s for _, _, s in model.sums(w, lookup)] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), pa.array([max(1, len(w)) for w in words], pa.int64()), batch.column(1), batch.column(2)], names=["sums", "n", "label", "id"])

    kind = sample.schema[id_col].dataType.simpleString()
    found = cut(over_texts(sample.select(text_col, "__label", id_col), run, f"sums array<double>, n long, label int, id {kind}"))
    best = F.coalesce(F.array_max("sums"), F.lit(0.0))
    held, mass = found.filter("label = 0").agg(F.count(F.when(F.size("sums") > 0, 1)), F.sum(F.col("n") * F.exp(-F.lit(model.lam) * best))).first()
    model.log_k = math.log(max(held, 0.5) / mass) if mass else 0.0
    normal = F.transform("sums", lambda s: F.greatest(F.lit(0.0), F.lit(model.lam) * s - F.lit(model.log_k) - F.log("n")))
    evidence = F.aggregate(normal, F.lit(0.0), lambda total, x: total + x)
    rows = found.groupBy("id").agg(F.max(evidence).alias("evidence"), F.max("label").alias("label")).select("evidence", "label").collect()  # at most calibration_rows
    if not rows:
        model.bias, model.slope = -2.0, 1.0
        return
    x, y = np.log1p([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):  # Newton steps on the ridge-penalised likelihood
        q = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + np.eye(2) * 1e-2, design.T @ (y - q) - 1e-2 * w)
        w += np.clip(step, -5, 5)
    model.bias, model.slope = float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score, evidence and the significant segments (character spans, score, natural log of E)."""

    def make():
        lookup = model.lookup()

        def work(texts):
            made = [model.segments(t, lookup) for t in texts]
            return [pa.array([model.probability(e) for _, e in made], pa.float64()), pa.array([e for _, e in made], pa.float64()), pa.array([s for s, _ in made], SEGMENT_ARROW)]

        return work

    return append(docs, text_col, [double("score"), double("evidence"), T.StructField("segments", SEGMENT)], make, keep_text)
