"""Subword ids of a given vocabulary: greedy longest match, pairs cut and padded to one length."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import padded

#: Words longer than this are unknown as a whole, as in the published tokenizer.
LONGEST = 100


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and their ids; a piece inside a word begins with ``##``."""

    ids: dict[str, int]
    unknown: str = "[UNK]"
    first: str = "[CLS]"
    between: str = "[SEP]"
    pad: str = "[PAD]"
    lower: bool = True

    def __post_init__(self) -> None:
        missing = [p for p in (self.unknown, self.first, self.between, self.pad) if p not in self.ids]
        if missing:
            raise ValueError(f"not in the vocabulary: {missing}")


def vocabulary(spark: SparkSession, path: str, **about) -> Vocabulary:
    """A file of one piece a line, numbered from 0 in order; a vocabulary is small and of fixed size."""
    whole = spark.read.text(path, wholetext=True).first()[0]
    return Vocabulary({piece.rstrip("\r"): i for i, piece in reversed(list(enumerate(whole.rstrip("\n").split("\n"))))}, **about)


def _mark(c: str) -> bool:
    return c.isascii() and c.isprintable() and not c.isalnum() and c != " " or unicodedata.category(c).startswith("P")


def words(text: str, lower: bool) -> list[str]:
    """White space parts words, and every punctuation mark is one of its own; lower-cased words lose their accents."""
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    out: list[str] = []
    for chunk in text.split():
        begin = 0
        for i, c in enumerate(chunk):
            if _mark(c):
                out += [chunk[begin:i], c]
                begin = i + 1
        out.append(chunk[begin:])
    return [w for w in out if w]


def pieces(word: str, v: Vocabulary, longest: int) -> list[int]:
    """The longest piece that fits, again and again; a word that no pieces make up is one unknown."""
    if len(word) > LONGEST:
        return [v.ids[v.unknown]]
    out, begin = [], 0
    while begin < len(word):
        for end in range(min(len(word), begin + longest), begin, -1):
            found = v.ids.get(("##" if begin else "") + word[begin:end])
            if found is not None:
                out.append(found)
                begin = end
                break
        else:
            return [v.ids[v.unknown]]
    return out


def subwords(text: Column, v: Vocabulary) -> Column:
    """The ids of a text, without special ones; null: none."""
    longest = max(len(p.removeprefix("##")) for p in v.ids)

    def f(texts: pa.Array) -> pa.Array:
        known: dict[str, list[int]] = {}

        def ids(word: str) -> list[int]:
            if word not in known:
                if len(known) > 100_000:
                    known.clear()
                known[word] = pieces(word, v, longest)
            return known[word]

        return pa.array([[i for w in words(t or "", v.lower) for i in ids(w)] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(f, "array<int>")(text)


def model_inputs(a: Column, v: Vocabulary, b: Column | None = None, max_length: int = 512) -> Column:
    """input_ids, token_type_ids and attention_mask, all ``max_length`` long, of ids or of a pair of them.

    The longer of a pair is cut first, entry by entry, so both end at the same length or the shorter stays whole.
    """
    one = lambda name: F.array(F.lit(v.ids[name]))
    room = max_length - (2 if b is None else 3)
    if room < 0:
        raise ValueError("no room for the special ids")
    if b is None:
        left, right = F.slice(a, 1, room), F.array().cast("array<int>")
        whole = F.concat(one(v.first), left, one(v.between))
    else:
        half = room // 2
        # Alternating cuts end with the odd entry on the first text.
        keep_a = F.greatest(F.least(F.size(a), F.lit(room) - F.size(b)), F.least(F.size(a), F.lit(room - half)))
        left = F.slice(a, F.lit(1), keep_a)
        right = F.slice(b, F.lit(1), F.least(F.size(b), F.lit(room) - F.size(left)))
        whole = F.concat(one(v.first), left, one(v.between), right, one(v.between))
    second = F.size(right) + F.lit(0 if b is None else 1)
    kinds = F.concat(F.array_repeat(F.lit(0), F.size(whole) - second), F.array_repeat(F.lit(1), second))
    mask = F.array_repeat(F.lit(1), F.size(whole))
    return F.struct(padded(whole, max_length, F.lit(v.ids[v.pad])).alias("input_ids"), padded(kinds, max_length, F.lit(0)).alias("token_type_ids"), padded(mask, max_length, F.lit(0)).alias("attention_mask"))
