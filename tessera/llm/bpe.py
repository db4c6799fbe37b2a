"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

A tokenizer file's merge list fixes how many symbols to the right of a token boundary can still remove it: the
*sufficient lookahead*. The transducer buffers that many symbols, emits every token that ends before them, and goes
on from the last emitted boundary, so a word of any length needs constant memory. Complete short words are looked up
in a bounded cache of what the transducer made of them before.

Defined results: null and empty texts have no tokens; special-token strings inside a text become their ids, as in
the tokenizers library; bytes that form no UTF-8 text decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.rows import append, long

#: Fixed values of the byte-level alphabet: bytes that stand for themselves; the others map to U+0100 upwards.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Unicode White_Space, which the tokenizers library means by \s; Python's own class also holds U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
CACHED_WORD, BLOCK, CACHE = 64, 512, 600_000


def byte_alphabet() -> list[str]:
    plain, table, extra = set(PLAIN), [], 0x100
    for b in range(256):
        if b in plain:
            table.append(chr(b))
        else:
            table.append(chr(extra))
            extra += 1
    return table


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols right of a position that can decide whether any merge crosses it.

    Merge k joins a and b only if b's symbols are there and no earlier merge takes b, or a piece at b's right edge
    while b is being built, away to the right; such a merge in turn needs its own lookahead. Merges are walked in
    order of priority, so every earlier one is known: reach(k) = |b| + max(reach(j): j < k, left(j) at b's right edge).
    """
    right: dict[str, str] = {}
    reach: dict[str, int] = defaultdict(int)  # by left part, the longest so far
    most = 1
    for a, b in merges:
        edge, ahead = b, 0
        while edge is not None:
            ahead = max(ahead, reach[edge])
            edge = right.get(edge)
        need = length[b] + ahead
        reach[a] = max(reach[a], need)
        most = max(most, need)
        right.setdefault(a + b, b)
    return most


class Utf8Machine:
    """Turns a stream of bytes into text; keeps at most three bytes of an unfinished character between feeds."""

    def __init__(self) -> None:
        self.tail = b""

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character starts within the last three bytes
            lead = data[-back]
            if lead >= 0xC0:
                size = 2 if 0xC2 <= lead < 0xE0 else 3 if lead < 0xF0 and lead >= 0xE0 else 4 if 0xF0 <= lead < 0xF5 else 1
                begun = data[-back:]
                if back < size and self._open(begun):
                    keep = back
                break
            if lead < 0x80:
                break
        self.tail = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _open(begun: bytes) -> bool:
        """Whether ``begun`` is a proper prefix of some encoded character."""
        try:
            begun.decode("utf-8")
        except UnicodeDecodeError as e:
            return e.reason == "unexpected end of data" and e.start == 0
        return False

    def close(self) -> str:
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


class Transducer:
    """Encoder and decoder read from a tokenizers JSON file of BPE kind with a byte-level alphabet."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.alphabet = byte_alphabet()
        length = lambda t: len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) else len(t)
        self.lookahead = sufficient_lookahead(merges, {t: length(t) for t in set(chain.from_iterable(merges))})
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kinds = [n["type"] for n in ((spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {"type": ""}])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        steps = (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        if pattern is None:
            raise ValueError("a tokenizer with a Split pattern is needed")
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.tokens: list[str] = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        decoder = (spec.get("decoder") or {}).get("type")
        back = {c: bytes([b]) for b, c in enumerate(self.alphabet)}
        self.byte_level = decoder == "ByteLevel"
        self.glue = b"" if self.byte_level else b" "
        self.pieces = [b"".join(back.get(c, c.encode()) for c in t) if self.byte_level else t.encode() for t in self.tokens]
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.known: dict[str, tuple[int, ...]] = {}

    # ---- encoding -----------------------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # the library lowers each character alone: no final sigma
        return text

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges of ``symbols``, lowest rank first, leftmost first."""
        rank, n = self.rank, len(symbols)
        if n <= 24:
            while len(symbols) > 1:
                ranks = [rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
                if (low := min(ranks)) == 1 << 60:
                    break
                i = ranks.index(low)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s]

    def word(self, parts: Iterable[str]) -> Iterator[int]:
        """Token ids of one word that arrives in parts, each emitted once no later symbol can change it."""
        pending: list[str] = []
        for part in parts:
            for at in range(0, len(part), BLOCK):
                pending += [self.alphabet[b] for b in part[at : at + BLOCK].encode("utf-8", "replace")]
                if len(pending) > self.lookahead + BLOCK:
                    done, limit = 0, len(pending) - self.lookahead
                    for token in self.merge(list(pending)):
                        if done + len(token) > limit:
                            break
                        done += len(token)
                        yield self.vocab[token]
                    del pending[:done]
        if pending:
            pending[-1] += self.suffix
            for token in self.merge(pending):
                if (i := self.vocab.get(token)) is not None:
                    yield i

    def run(self, run: str) -> tuple[int, ...]:
        """Ids of a stretch between white space."""
        return tuple(chain.from_iterable(self.word([w]) for w in self.pattern.findall(run)))

    def encode(self, text: str | None) -> Iterator[Iterable[int]]:
        """Ids of a text in order, as many short groups."""
        if not text:
            return
        for piece in self.splitter.split(text) if self.splitter and self.splitter.search(text) else (text,):
            if piece in self.special:
                yield (self.special[piece],)
                continue
            piece, known = self.normal(piece), self.known
            runs = piece.split() if not ODD_SPACE.search(piece) else regex.split(f"[{SPACE}]+", piece)
            for run in runs:
                ids = known.get(run)
                if ids is None:
                    if len(run) > CACHED_WORD:
                        yield from (self.word([w]) for w in self.pattern.findall(run))
                        continue
                    if len(known) >= CACHE:
                        known.clear()
                    ids = known[run] = self.run(run)
                yield ids

    # ---- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids in order, as pieces; holds one block of ids and an unfinished character at most."""
        machine, block, first, pieces = Utf8Machine(), [], True, self.pieces
        for i in ids:
            block.append(pieces[i])
            if len(block) == 8192:
                yield machine.feed((b"" if first else self.glue) + self.glue.join(block))
                block, first = [], False
        if block:
            yield machine.feed((b"" if first else self.glue) + self.glue.join(block))
        yield machine.close()


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The transducer of a tokenizer file, kept with its cache while a Python worker lives."""
    with open(path, encoding="utf-8") as f:
        return Transducer(json.load(f))


FIELDS = [long("n_tokens"), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, token_ids and the decoded text. ``tokenizer`` is a path that every executor has."""

    def make():
        t = load(tokenizer)

        def work(texts):
            ids = [list(chain.from_iterable(t.encode(x))) for x in texts]
            return [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(["".join(t.decode(x)) for x in ids], pa.string())]

        return work

    return append(docs, text_col, FIELDS, make)


def digests(docs: DataFrame, tokenizer: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs``, less the text unless it is to be kept, with n_tokens and the digests of ids and decoded text, hashed as they stream by."""

    def one(t: Transducer, text: str | None):
        n, ids_hash, text_hash, block = 0, hashlib.sha256(), hashlib.sha256(), []

        def seen() -> Iterator[int]:
            nonlocal n
            for group in t.encode(text):
                block.extend(group)
                if len(block) >= 8192:
                    yield from flush()
            yield from flush()

        def flush() -> list[int]:
            nonlocal n
            made, block[:] = list(block), []
            if made:
                ids_hash.update(((" " if n else "") + " ".join(map(t.decimal.__getitem__, made))).encode())
                n += len(made)
            return made

        for piece in t.decode(seen()):
            text_hash.update(piece.encode("utf-8", "replace"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def make():
        t = load(tokenizer)

        def work(texts):
            made = [one(t, x) for x in texts]
            return [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())]

        return work

    return append(docs, text_col, [long("n_tokens"), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make, keep_text)
