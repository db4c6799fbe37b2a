"""Language identification by compression.

Each language gets a few raw-content zstandard dictionaries made of its own training texts. A text is cut into
blocks, every block is compressed with every dictionary, and the language with the fewest bytes wins. The margin
is the gap to the runner-up relative to the runner-up's bytes; with one learned language the runner-up is compression
without a dictionary. What counts as narrow is learned for each length of text from training texts outside the
dictionaries: a fifth of the margin that all but one in twenty of them have. A text below it is rejected
(``accepted`` false). None is asked of a text in a shorter class than any that enough training texts are in, nor where those of
its class have none.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with score 0 and not accepted; equal
sizes go to the language with more training texts, then by name; with no learned language everything is ``und``. Rows with a
null id are predicted but not learnt from; rows that repeat an id in one language are one training text (the largest), in
several languages one for each; repeated rows are predicted alike; an empty table gives an empty result; a column named
like a new one is replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rows import append, double, over_texts, remainder
from tessera.session import broadcast_if_small, cut

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: Evenly spaced slices that a long training text gives to a dictionary.
SLICES = 4


def normalise(text: str) -> bytes:
    """Lower case, with every run of anything but letters as one space."""
    return (" " + " ".join(WORD.findall(text.lower())) + " ").encode("utf-8", "replace")


def band(size: int) -> int:
    """Length class of a text: the power of two its normalised bytes reach."""
    return max(0, size).bit_length()


@dataclass
class LanguageModel:
    """Dictionary contents by language, best-supported language first, and the narrowest margin asked for by length class."""

    contents: dict[str, list[bytes]] = field(default_factory=dict)
    narrow: dict[int, float] = field(default_factory=dict)

    def least(self, size: int) -> float:
        """The margin asked of a text of ``size`` bytes: that of its class, or of the nearest one known, the shorter of two; none
        below the shortest known."""
        if not self.narrow or band(size) < min(self.narrow):
            return 0.0
        at = min(self.narrow, key=lambda b: (abs(b - band(size)), b))
        return self.narrow[at]


def _by_slot(train: DataFrame, by: list, slots: int, seed: int) -> DataFrame:
    """(lang, id, slot, n): of each language, group of ``by`` and hash slot, the row of smallest hash; one narrow pass."""
    key = F.xxhash64("id", F.lit(seed))
    picked = train.select("lang", "id", *by, F.pmod(key, F.lit(slots)).alias("slot"), F.xxhash64(key).alias("h"))
    return picked.groupBy("lang", *[c for c in picked.columns if c not in ("lang", "id", "slot", "h")], "slot").agg(F.min(F.struct("h", "id")).alias("m"), F.count("*").alias("n")).select("lang", "slot", "n", F.col("m.id").alias("id"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_by: int = 3, held_rest: int = 1, dictionaries: int = 4, dict_bytes: int = 16_384, texts_per_dictionary: int = 24, texts_per_class: int = 24) -> LanguageModel:
    """Dictionary contents by language, and the margins asked for.

    The bounded sample, ``dictionaries * texts_per_dictionary`` texts a language, is chosen by hash from all training
    rows: one narrow pass keeps the smallest hash of each hash bucket, a second reads those texts. A long one
    gives evenly spaced slices, so that it doesn't fill a dictionary alone. Another sample, ``texts_per_class`` texts
    of each language and length class, gives the margins.
    """
    train = docs.filter((remainder(id_col, held_by) != held_rest) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    train = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    picked = cut(_by_slot(train, [], dictionaries * texts_per_dictionary, 1))
    if not (chosen := picked.count()):
        return LanguageModel()
    if chosen > 1_000_000:
        raise ValueError("too many languages for one set of dictionaries")
    texts = train.join(F.broadcast(picked), ["id", "lang"]).groupBy("lang", "slot", "id").agg(F.max("n").alias("n"), F.max("text").alias("text"))
    share = dict_bytes // texts_per_dictionary

    def contents(pdf):
        made, pdf = [], pdf.sort_values(["slot", "id"])
        for d in range(dictionaries):
            parts = []
            for text in pdf.loc[pdf.slot % dictionaries == d, "text"]:
                data = normalise(text)
                starts = [len(data) * i // SLICES for i in range(SLICES)] if len(data) > share else [0]
                parts += [data[a : a + share // len(starts)] for a in starts]
            made.append(b" ".join(parts)[-dict_bytes:] or b" ")
        return pdf.assign(content=[made] * len(pdf), support=int(pdf.n.sum()))[["lang", "support", "content"]].head(1)

    rows = texts.groupBy("lang").applyInPandas(contents, "lang string, support long, content array<binary>").collect()
    model = LanguageModel({r["lang"]: [bytes(c) for c in r["content"]] for r in sorted(rows, key=lambda r: (-r["support"], r["lang"]))})
    tried = _by_slot(train, [F.floor(F.log2(F.length("text"))).alias("size")], texts_per_class, 2).join(F.broadcast(picked.select("lang", "id")), ["lang", "id"], "left_anti")
    tried = train.join(broadcast_if_small(tried.select("lang", "id").distinct()), ["id", "lang"]).select("text", "lang")

    def margins(batches):
        ready = Compressors(model.contents)
        for batch in batches:
            made = [(ready.classify(t), lang) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            made = [(band(size), margin if name == lang else 0.0) for (name, _, margin, size), lang in made if name != UNKNOWN]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([m for _, m in made], pa.float64())], names=["band", "margin"])

    by_band = over_texts(tried, margins, "band int, margin double").groupBy("band").agg(F.percentile("margin", F.lit(0.05)).alias("low"), F.count("*").alias("n"))
    model.narrow = {r["band"]: r["low"] / 5 for r in by_band.filter("n >= 8").collect()}
    return model


def _ready(content: bytes, level: int):
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class Compressors:
    """The dictionaries made ready for compression, once a task.

    Every text is compressed with one joined dictionary a language. Where that leaves a margin below ``clear``, the
    sizes are taken again at a higher level and summed over all dictionaries of a language, which counts finer.
    """

    def __init__(self, contents: dict[str, list[bytes]], clear: float = 0.03):
        self.names, self.clear = list(contents), clear
        self.coarse = [[_ready(b" ".join(parts[:2]), 6)] for parts in contents.values()]
        self.fine = [[_ready(part, 9) for part in parts] for parts in contents.values()]
        self.bare = zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    @staticmethod
    def sizes(sets: list[list], data: bytes, block: int) -> np.ndarray:
        """Compressed bytes by language, summed over dictionaries and over blocks of the whole text."""
        blocks = [data[i : i + block] for i in range(0, len(data), block)]
        return np.array([sum(len(c(b)) for c in ready for b in blocks) for ready in sets], float)

    def classify(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, relative margin and bytes of normalised text."""
        data = normalise(text) if text and self.names else b""
        if not data.strip():
            return UNKNOWN, 0.0, 0.0, 0
        sizes = np.zeros(0)
        for sets, block in ((self.coarse, 16_384), (self.fine, 4_096)):
            sizes = self.sizes(sets, data, block) / len(sets[0])
            if len(self.names) == 1:  # no other language to compare with
                sizes = np.r_[sizes, self.sizes([[self.bare]], data, block)]
            best = int(sizes[: len(self.names)].argmin())
            rival = float(np.delete(sizes, best).min())
            margin = max(0.0, rival - sizes[best]) / rival
            if margin >= self.clear:
                break
        weights = np.exp2(-np.clip((sizes - sizes[best]) * 4.0, -1000.0, 1000.0))
        return self.names[best], float(weights[best] / weights.sum()), float(margin), len(data)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and accepted."""

    def make():
        ready = Compressors(model.contents)

        def work(texts):
            made = [ready.classify(t) for t in texts]
            names, scores, margins, sizes = ([m[i] for m in made] for i in range(4))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array([n != UNKNOWN and m >= model.least(b) for n, m, b in zip(names, margins, sizes)], pa.bool_())]

        return work

    return append(docs, text_col, [T.StructField("lang_pred", T.StringType()), double("score"), double("margin"), T.StructField("accepted", T.BooleanType())], make, keep_text)
