"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from the model file: the normaliser (space to U+2581, one of them put in
front), the pieces (a trie from characters to ids, with byte pieces for characters that no piece has),
and a grammar over neighbouring pieces. Their composition with the text is searched for its shortest
path in the tropical semiring. The model is of the BPE kind, whose result is no sum of piece scores;
so the grammar holds the merge order instead: an arc from piece p to q weighs 1 if merging the
characters of pq by score gives back (p, q), and is infinite otherwise. A sequence is the model's own
exactly if all its neighbours are so, hence one path alone is finite, for every prefix of the text.

No piece runs across the end of a word, so the composition splits before each run of U+2581 and
recurring stretches reuse their path. Texts are encoded whole.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import load, nested, settle, unnested

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Memory for paths and for grammar arcs that one Python worker remembers.
PATH_BYTES, END_BYTES, ARC_BYTES = 144 << 20, 48 << 20, 64 << 20
#: Characters of a stretch whose states are remembered; longer ones are searched on their own.
SHORT = 64
_STRETCH = re.compile(SPACE + "+[^" + SPACE + "]*|[^" + SPACE + "]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Bounded(dict):
    """A dictionary of bounded size: ``room`` counts the bytes of what comes next, and starts anew, from the short keys, when it is full."""

    def __init__(self, most: int, short: int) -> None:
        super().__init__()
        self.most, self.short, self.held = most, short, 0

    def room(self, cost: int) -> None:
        if self.held + cost > self.most:
            kept = [(k, v) for k, v in self.items() if len(k) <= self.short] if self.short else []
            kept = kept if len(kept) * 300 < self.most // 2 else []
            self.clear()
            self.update(kept)
            self.held = 300 * len(kept)
        self.held += cost


def _fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message, in order."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            out.append((key >> 3, varint()))
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        out.append((key >> 3, raw[at : at + n]))
        at += n
    return out


class Normaliser:
    """The normaliser's transducer, compiled from the model file: which character stands for a space, whether one goes in
    front, and whether runs of them shrink. Models whose normaliser has a character map are refused, and so are
    models of another kind than BPE, whose path the grammar here does not weigh, or without byte pieces."""

    BPE = 2

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = dict(x for x in _fields(f.read()) if x[0] in (2, 3))  # 2: the trainer's settings, 3: the normaliser's
        trainer, spec = dict(_fields(model.get(2, b""))), dict(_fields(model.get(3, b"")))
        if trainer.get(3, 1) != self.BPE:
            raise ValueError(f"not a BPE model: kind {trainer.get(3, 1)}")
        if not trainer.get(35, 0):
            raise ValueError("a model without byte fallback")
        if spec.get(2):
            raise ValueError("the model's normaliser has a character map")
        self.front, self.shrink, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if not escape or trainer.get(24, 0):
            raise ValueError("spaces that stay as they are, or go behind words, are not supported")

    def __call__(self, text: str) -> str:
        if self.shrink:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.front else "") + text.replace(" ", SPACE)


class Transducer:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.normalise = Normaliser(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.bytes_ = {sp.id_to_piece(i): i for i in range(size) if sp.is_byte(i)}
        self.byte_ids = [self.bytes_[f"<0x{b:02X}>"] for b in range(256)]
        skip = {i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.pieces = [None if i in skip else sp.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if p is not None}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.size = size
        self.surface = [bytes([self.byte_ids.index(i)]) if i in set(self.byte_ids) else (p or "").replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        # The piece transducer: a state is its arcs by character and the id it emits, if it is final.
        root: list = [{}, None]
        for p, i in self.ids.items():
            node = root
            for c in p:
                node = node[0].setdefault(c, [{}, None])
            node[1] = i
        self.trie = root[0]
        back: list = [{}, None]  # the same from the last character of each piece to its first
        for p, i in self.ids.items():
            node = back
            for c in reversed(p):
                node = node[0].setdefault(c, [{}, None])
            node[1] = i
        self.back, self.length = back[0], [len(p or "") for p in self.pieces]
        self.ends = Bounded(END_BYTES, 6)
        self.arcs, self.paths, self.older, self.paths_held = Bounded(ARC_BYTES, 0), {}, {}, 0

    def merged(self, text: str) -> list[str]:
        """Merge characters by best score, leftmost first, until no two neighbours make a piece."""
        parts: list[str | None] = list(text)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score, heap = self.score, []
        for i in range(len(parts) - 1):
            if (s := score.get(parts[i] + parts[i + 1])) is not None:
                heap.append((-s, i, parts[i] + parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(parts) and (s := score.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def allowed(self, p: int, q: int) -> bool:
        """Whether the grammar has a finite arc from p to q."""
        key = p * self.size + q
        ok = self.arcs.get(key)
        if ok is None:
            a, b = self.pieces[p], self.pieces[q]
            ok = self.merged(a + b) == [a, b]
            self.arcs.room(120)
            self.arcs[key] = ok
        return ok

    @lru_cache(maxsize=65536)  # noqa: B019  one transducer lives as long as its worker
    def whole(self, q: int) -> bool:
        """Whether a path may begin with piece q: merging its characters gives the piece itself."""
        return self.merged(self.pieces[q]) == [self.pieces[q]]

    def shortest(self, stretch: str) -> tuple[int, ...]:
        """Ids on the shortest path of the composition with one stretch of normalised text."""
        n, trie, arcs, size = len(stretch), self.trie, self.arcs, self.size
        # Per position: least weight, last piece (-1 at the start and after bytes), place before, ids emitted.
        weights: list = [None] * (n + 1)
        lasts, before, emitted = [-1] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        weights[0] = 0
        for i in range(n):
            weight = weights[i]
            if weight is None:
                continue
            node = trie.get(stretch[i])
            if node is None:
                raw = tuple(self.byte_ids[b] for b in stretch[i].encode("utf-8", "surrogatepass"))
                if weights[i + 1] is None or weight + len(raw) < weights[i + 1]:
                    weights[i + 1], lasts[i + 1], before[i + 1], emitted[i + 1] = weight + len(raw), -1, i, raw
                continue
            last, j, weight = lasts[i], i + 1, weight + 1
            while True:
                q = node[1]
                if q is not None:
                    if last < 0:
                        ok = self.whole(q)
                    else:
                        ok = arcs.get(last * size + q)
                        if ok is None:
                            ok = self.allowed(last, q)
                    if ok and (weights[j] is None or weight < weights[j]):
                        weights[j], lasts[j], before[j], emitted[j] = weight, q, i, (q,)
                if j == n:
                    break
                node = node[0].get(stretch[j])
                if node is None:
                    break
                j += 1
        out: list[tuple] = []
        while n > 0:
            out.append(emitted[n])
            n = before[n]
        out.reverse()
        return tuple([x for ids in out for x in ids])

    def path(self, stretch: str) -> tuple[int, ...]:
        """The shortest path of a short stretch, from remembered states: the one finite path to a state depends on the
        characters up to it alone, so words that begin alike share their states. A state is the last piece, or -1 after bytes."""
        ends, arcs, size, back, n = self.ends, self.arcs, self.size, self.back, len(stretch)
        if ends.held > ends.most:
            ends.room(0)
        known = n
        while known and stretch[:known] not in ends:
            known -= 1
        ends.held += (n - known) * 200
        states: list = [None] * (n + 1)  # those of this stretch that were asked for
        states[0] = -1
        for j in range(known + 1, n + 1):
            i, last = j - 1, -1
            node = back.get(stretch[i])
            while node is not None:
                q = node[1]
                if q is not None:
                    before = states[i]
                    if before is None:
                        before = states[i] = ends[stretch[:i]]
                    if before < 0:
                        ok = self.whole(q)
                    else:
                        ok = arcs.get(before * size + q)
                        if ok is None:
                            ok = self.allowed(before, q)
                    if ok:
                        last = q
                        break
                if not i:
                    break
                i -= 1
                node = node[0].get(stretch[i])
            states[j] = ends[stretch[:j]] = last
        out: list[int] = []
        while n:
            last = states[n]
            if last is None:
                last = ends[stretch[:n]]
            if last < 0:
                out.extend(self.byte_ids[b] for b in reversed(stretch[n - 1].encode("utf-8", "surrogatepass")))
                n -= 1
            else:
                out.append(last)
                n -= self.length[last]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        paths = self.paths
        if self.paths_held > PATH_BYTES // 2:  # what was not met since the last turn goes
            self.older, self.paths, self.paths_held = paths, {}, 0
            paths = self.paths
        older = self.older
        for stretch in _STRETCH.findall(self.normalise(text)):
            ids = paths.get(stretch)
            if ids is None:
                if len(stretch) <= SHORT:
                    ids = paths[stretch] = older.get(stretch) or self.path(stretch)
                    self.paths_held += 240 + 2 * len(stretch) + 8 * len(ids)
                else:
                    ids = self.shortest(stretch)
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text: surfaces joined, the space in front taken off, bytes that make no character as U+FFFD."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


_RESULT = "struct<n:bigint,crc:bigint,back:boolean,ids:array<int>>"


def pieces_of(spark: SparkSession, text, model: str | None = None):
    """A struct for a text: number of ids, their CRC-32 as little-endian 32-bit integers, whether decoding
    gives the text back, and the ids. Null: no ids and back is null; the empty text: no ids, true.

    A literal U+2581 in a text reads as a space, as in the model; back allows for it.
    """
    path = model or default_model()
    settle(spark)

    def encode(texts: pa.Array) -> pa.Array:
        t, ids, back = transducer(path), [], []
        for x in texts.to_pylist():
            i = t.encode(x or "")
            ids.append(np.array(i, np.int32))
            back.append(None if x is None else t.decode(i) == x.replace(SPACE, " "))
        lengths = [len(i) for i in ids]
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), flat)
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array(back, pa.bool_()), lists], ["n", "crc", "back", "ids"])

    return F.arrow_udf(encode, _RESULT)(text)


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The columns of ``docs``, then n_pieces and piece_ids in place of any of these names.

    Null and empty texts have no ids. Equal texts have equal ids, every row stays, and extra columns may
    have any other names; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("n_pieces", "piece_ids")]
    out = docs.select(nested(docs).alias("row"), pieces_of(docs.sparkSession, docs["text"], model).alias("p"))
    return out.select(*unnested(kept), F.col("p.n").alias("n_pieces"), F.col("p.ids").alias("piece_ids"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the ids of its whole text, their number and CRC-32, and whether they decode to it."""
    docs = load(spark, sf_dir, "documents")
    out = docs.select("doc_id", pieces_of(spark, docs["text"]).alias("p"))
    return out.select("doc_id", F.col("p.n").alias("n_pieces"), F.col("p.crc").alias("ids_crc32"), F.col("p.back").alias("round_trip"), F.col("p.ids").alias("piece_ids"))
