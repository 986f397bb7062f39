"""Token ids in files of Re-Pair compressed blocks.

Documents are dealt by ranges of doc_id into shards; a shard is tokenised in order, an end id after
each document, and cut into blocks of about BLOCK_IDS ids. A block is compressed by Re-Pair: in each
round the most frequent pairs of ids that share no symbol become nonterminals, until no pair occurs twice. It stores rules, the
expansion length of every nonterminal, the final string and the documents' lengths, so that any
stretch is decoded without the rest.

File format: a folder of Parquet part files in the shared folder, one row a block with its key (shard,
block), its counts and the binary payload. Spark's committer writes it, so a task that is lost and
run again leaves no torn file, and any store that Spark writes will do.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import UPPER, cut, load, lower_bytes, settle

VOCABULARY, END_ID = "word_bpe_49k.json", 1
BLOCK_IDS = 1 << 18
#: Text in a shard, which is one task and its blocks; memory for words that one Python worker remembers.
SHARD_BYTES, CACHE_BYTES = 16 << 20, 96 << 20
MARKS, MOST_MARKS, _LETTERS = ".,;:!?#*$%&", 8, r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]{1,40}\z"
_IS_MARK, _IS_LETTER = (np.isin(np.arange(256), np.frombuffer(x.encode(), np.uint8)) for x in (MARKS, UPPER + UPPER.lower()))
_HEAD = struct.Struct("<4sIIII")
_MAGIC = b"SXR1"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _probes() -> list[str]:
    """Texts that show whether a tokenizer looks across white space: every kind of neighbour on either side of every gap."""
    sides = ["a", "Zé", "don't", "12", ",", "(x", "日本", "\u0301", "<", "_"]
    return [x + gap + y for x in sides for y in sides for gap in (" ", "\n", "\t ", "\x0b\x0c\r")] + [" " + x + "  " for x in sides]


def _bytes(words: pa.StringArray) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer never looks across the ASCII white space that separates words, which probes find
    out at load, each distinct word goes through the library and its ids are remembered, in CACHE_BYTES at
    most. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(_probes(), add_special_tokens=False)]
        words = [[self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in t.encode().split()] for t in _probes()]
        self.by_word = whole == [[i for w in ids for i in w] for ids in words]
        capitals = [e.ids for e in self.tokenizer.encode_batch_fast([t.upper() if t.isascii() else t for t in _probes()], add_special_tokens=False)]
        self.folds = capitals == whole
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        size = self.tokenizer.get_vocab_size()
        parts = all(self.tokenizer.encode(f"{w}{m}", add_special_tokens=False).ids == [*self.tokenizer.encode(w, add_special_tokens=False).ids, *self.tokenizer.encode(m, add_special_tokens=False).ids] for w in ("a", "é", "some", "words", "1a", "don't", "x's", ",é") for m in (*MARKS, *(m + n for m in MARKS for n in MARKS), *(n + m * (MOST_MARKS - 1) for m in MARKS for n in ".,#")))
        self.last = np.array([bool(suffix) and parts and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.apart = parts and not any(set(x.content) & set(MARKS) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.forms = self._forms()
        #: Words of a-z are in form as they come.
        self.formed = self.folds and self.forms is not None and all(self.forms[c] == chr(c) for c in range(97, 123))

    def _forms(self) -> dict[int, str] | None:
        """What the tokenizer makes of each letter before its model sees it, if every word of letters goes to the model as one piece, letter
        by letter, as probes show; None otherwise."""
        t = self.tokenizer
        if t.normalizer is None or t.pre_tokenizer is None or any(x.content.isalpha() for x in t.get_added_tokens_decoder().values()):
            return None
        letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
        made = [t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(c)) for c in letters]
        forms = {ord(c): x[0][0] for c, x in zip(letters, made, strict=True) if len(x) == 1}
        words = ["some", "Words", "straße", "endoftext", *(f"{c}a{c}o{d}" for c, d in zip(letters, letters[1:] + letters[:1], strict=True)), *("".join(letters[i : i + 40]) for i in range(0, len(letters), 7))]
        same = len(forms) == len(letters) and all([x.id for x in self.model.tokenize(w.translate(forms))] == t.encode(w, add_special_tokens=False).ids for w in words)
        return forms if same else None

    def _of_letters(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words of letters with their ids, straight from the library's model."""
        texts = b"\n".join(words).decode()
        if not (self.formed and texts.isascii()):
            texts = texts.translate(self.forms)
        one, number, ids, cuts = self.model.tokenize, attrgetter("id"), array("I"), [0]
        for t in texts.split("\n"):
            ids.extend(map(number, one(t)))
            cuts.append(4 * len(ids))
        return zip(words, map(ids.tobytes().__getitem__, map(slice, cuts, cuts[1:])), strict=False)

    def _words(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all texts and where those of each begin; marks behind a letter are a word of their own, where probes allow it.

        White space at either end of a text leaves an empty word there, which has no ids.
        """
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.folds else texts)
        words, begins = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        _, ends, data = words.buffers()
        if not self.apart or not len(words) or not data:
            return words, begins
        ends, chars = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data, np.uint8)
        at = np.flatnonzero(_IS_MARK[chars[ends[1:] - 1]] & (ends[1:] > ends[:-1]))
        low, cuts = ends[at], ends[at + 1] - 1
        more = np.arange(len(at))
        for _ in range(MOST_MARKS - 1):
            more = more[(cuts[more] > low[more]) & _IS_MARK[chars[cuts[more] - 1]]]
            cuts[more] -= 1
        before = chars[cuts - 1]
        # The letters from U+00C0 to U+00FF are two bytes, of which the first is C3.
        letter = _IS_LETTER[before] | ((cuts - low > 1) & (chars[np.maximum(cuts, 2) - 2] == 0xC3) & (before != 0x97) & (before != 0xB7))
        behind = (cuts > low) & letter
        at, cuts = at[behind], cuts[behind]
        ends = np.insert(ends, at + 1, cuts)
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), data), begins + np.searchsorted(at, begins)

    def _new(self, words: pa.StringArray) -> dict[bytes, bytes]:
        """Ids of words not remembered. Words of letters go straight to the library's model, where probes allow it;
        else many to a call, as the last token of each bears the suffix that ends a word."""
        found: dict[bytes, bytes] = {}
        if self.last.any():
            plain = pc.match_substring_regex(words, _LETTERS)
            rest, letters = _bytes(words.filter(pc.invert(plain))), _bytes(words.filter(plain))
            if self.forms is not None:
                for part in ([w for w in letters if w.isascii()], [w for w in letters if not w.isascii()]):
                    for begin in range(0, len(part), 512):
                        found.update(self._of_letters(part[begin : begin + 512]))
                letters = []
            for begin in range(0, len(letters), 512):
                part = letters[begin : begin + 512]
                ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
                ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
                if len(ends) == len(part) and ends[-1] == 4 * len(ids):
                    raw, cuts = ids.tobytes(), [0, *ends.tolist()]
                    found.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
                else:
                    rest += part
        else:
            rest = _bytes(words)
        for begin in range(0, len(rest), 4096):
            part = rest[begin : begin + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                found[w] = array("I", e.ids).tobytes()
        return found

    def encode(self, texts: list[str | None] | pa.StringArray) -> list[np.ndarray]:
        """The ids of each text. Texts that come as an Arrow array are parted into words and these numbered without a Python object a word."""
        if isinstance(texts, list):
            texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
        texts = texts.fill_null("")
        words, begins = self._words(texts)
        coded = words.dictionary_encode()
        known = self.known
        known[b""] = b""
        words = _bytes(coded.dictionary)
        ids = list(map(known.get, words))
        fresh = [i for i, x in enumerate(ids) if x is None]
        new = self._new(coded.dictionary.take(pa.array(fresh, pa.int64())))
        known.update(new)
        for i in fresh:
            ids[i] = new[words[i]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, which = np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(size[which]))
        # The place of each id in the ids of the distinct words: where its word's begin there, less where they begin here.
        place = np.repeat(first[which] - ends[:-1], size[which])
        place += np.arange(len(place))
        flat, cuts = np.frombuffer(b"".join(ids), np.uint32)[place], ends[begins].tolist()
        self.held += sum(map(len, new)) + sum(map(len, new.values())) + 180 * len(new)
        if self.held > CACHE_BYTES:  # short words come back most
            self.known = {w: i for w, i in known.items() if len(w) <= 7}
            self.held = sum(map(len, self.known)) + sum(map(len, self.known.values())) + 180 * len(self.known)
            if self.held > CACHE_BYTES // 2:
                self.known, self.held = {}, 0
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _disjoint(x: np.ndarray, y: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """Pairs (x, y) taken greedily by count, ties by order: a pair goes in if none before it begins with its second
    symbol or ends with its first. Then a chosen pair can overlap only itself, where both its symbols are one.

    All pairs with no better one left against them go in at once, which gives what one at a time would.
    """
    order = np.argsort(-counts, kind="stable")
    x, y = x[order], y[order]
    left, chosen = np.arange(len(x)), []
    best_first, best_second = np.empty(top, np.int64), np.empty(top, np.int64)
    while len(left):
        a, b = x[left], y[left]
        best_second[a], best_first[b] = len(x), len(x)
        best_first[a[::-1]] = left[::-1]
        best_second[b[::-1]] = left[::-1]
        good = (left <= best_second[a]) & (left <= best_first[b])
        chosen.append(left[good])
        first, second = np.zeros(top, bool), np.zeros(top, bool)
        first[a[good]] = True
        second[b[good]] = True
        left = left[~good & ~first[b] & ~second[a] & ~((a == b) & (first[a] | second[a]))]
    return np.sort(order[np.concatenate(chosen)]) if chosen else left


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules as pairs of symbols, expansion lengths of the rules, string of symbols).

    Symbols below len(terminals) stand for an id, the rest for a rule. Pairs are replaced from the left
    without overlap, until none occurs twice. A pair that occurs once never comes to occur twice, as what
    is new contains a new symbol: so each round looks at the places still live alone. An empty string has no rules.
    """
    seen = np.bincount(ids) > 0 if len(ids) and int(ids.max()) < 1 << 22 else None
    if seen is not None:
        terminals = np.flatnonzero(seen)
        s = (np.cumsum(seen) - 1)[ids]
    else:
        terminals, s = np.unique(ids, return_inverse=True)
        s = s.astype(np.int64).ravel()
    base = len(terminals)
    rules: list[np.ndarray] = []
    size = np.ones(base, np.int64)
    lengths = [size]
    top = base
    live = np.ones(max(0, len(s) - 1), bool)
    while len(at := np.flatnonzero(live)):
        # Places by their pair: one sort of pair and place packed into a word, or of the pairs where that is too wide.
        code, bits = s[at] * top + s[at + 1], len(s).bit_length()
        if top * top < 1 << (62 - bits):
            packed = np.sort(code << bits | at)
            at, code = packed & ((1 << bits) - 1), packed >> bits
        else:
            order = np.argsort(code, kind="stable")
            at, code = at[order], code[order]
        cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        counts = np.diff(np.append(cuts, len(code)))
        twice = counts > 1
        some = np.repeat(twice, counts)
        live[at[~some]] = False
        at, pairs, counts = at[some], code[cuts[twice]], counts[twice]
        chosen = _disjoint(pairs // top, pairs % top, counts, top)
        if not len(chosen):
            break
        symbol = np.full(len(pairs), -1, np.int64)
        symbol[chosen] = np.arange(len(chosen))
        place = np.repeat(symbol, counts)
        at, place = at[place >= 0], place[place >= 0]
        if len(chosen) < 1 << (62 - bits):
            packed = np.sort(at << (62 - bits) | place)
            at, place = packed >> (62 - bits), packed & ((1 << (62 - bits)) - 1)
        else:
            order = np.argsort(at)
            at, place = at[order], place[order]
        # Runs of one symbol overlap themselves: keep every second start of a run of starts.
        fresh = np.concatenate(([True], np.diff(at) != 1))
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        odd = (np.arange(len(at)) - run_start) % 2 == 0
        at, place = at[odd], place[odd]
        pair = np.stack((pairs[chosen] // top, pairs[chosen] % top), 1)
        rules.append(pair)
        lengths.append(size[pair[:, 0]] + size[pair[:, 1]])
        size = np.concatenate((size, lengths[-1]))
        s[at] = top + place
        live[at[at < len(live)]] = True
        live[at[at > 0] - 1] = True
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        # The pair after a new symbol is that of the symbol it swallowed with the next one.
        rest = np.flatnonzero(keep)
        s, live = s[rest], live[rest[: len(rest) - keep[-1]]]
        live = live[: max(0, len(s) - 1)]
        top += len(chosen)
    return terminals, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), np.concatenate(lengths[1:]) if rules else np.zeros(0, np.int64), s


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32 in the least number of bits that holds the largest of them, lowest bit first."""
    width = max(1, int(x.max()).bit_length()) if len(x) else 1
    bits = np.unpackbits(x.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return struct.pack("<IB", len(x), width) + np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpacked(raw: memoryview, at: int) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", raw, at)
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at + 5), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64), at + 5 + size


def write_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block's payload: ``lengths`` are the documents' numbers of ids, together all of ``ids``."""
    terminals, rules, expansions, string = compress(ids)
    parts = [_packed(np.asarray(x, np.int64)) for x in (terminals, rules.ravel(), expansions, string, lengths)]
    return _HEAD.pack(_MAGIC, len(ids), len(terminals), len(rules), len(lengths)) + b"".join(parts)


class Block:
    """Random access to a payload: ``read(start, n)`` expands no more than the symbols that the stretch touches."""

    def __init__(self, payload: bytes) -> None:
        magic, self.n_ids, n_terminals, _, _ = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        raw, at = memoryview(payload), _HEAD.size
        self.terminals, at = _unpacked(raw, at)
        rules, at = _unpacked(raw, at)
        self.rules = rules.reshape(-1, 2)
        expansions, at = _unpacked(raw, at)
        self.string, at = _unpacked(raw, at)
        self.lengths, at = _unpacked(raw, at)
        self.size = np.concatenate((np.ones(n_terminals, np.int64), expansions))
        self.starts = np.concatenate(([0], np.cumsum(self.size[self.string]))) if len(self.string) else np.zeros(1, np.int64)

    def expand(self, s: np.ndarray) -> np.ndarray:
        """The ids of some symbols; a round works on the symbols that are rules yet, each at its place in the result."""
        base, size = len(self.terminals), self.size
        ends = np.cumsum(size[s])
        out = np.empty(int(ends[-1]) if len(s) else 0, np.int64)
        at = ends - size[s]
        while len(s):
            plain = s < base
            out[at[plain]] = self.terminals[s[plain]]
            rule, at = self.rules[s[~plain] - base], at[~plain]
            s, at = rule.T.ravel(), np.concatenate((at, at + size[rule[:, 0]]))
        return out

    def read(self, start: int = 0, n: int | None = None) -> np.ndarray:
        end = self.n_ids if n is None else min(self.n_ids, start + n)
        if start >= end:
            return np.zeros(0, np.int64)
        i, j = np.searchsorted(self.starts, start, "right") - 1, np.searchsorted(self.starts, end, "left")
        got = self.expand(self.string[i:j])
        return got[start - self.starts[i] : end - self.starts[i]]


_BLOCKS = "shard int, block int, doc_ids array<bigint>, n_ids bigint, payload binary"


def _write(path: str):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        who: list[int | None] = []
        held: list[np.ndarray] = []
        count = 0

        def out() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], np.int64)
            payload = write_block(np.concatenate(held), lengths)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([who], pa.list_(pa.int64())), pa.array([count], pa.int64()), pa.array([payload], pa.binary())], ["shard", "block", "doc_ids", "n_ids", "payload"])

        for batch in batches:
            texts, docs = batch.column("text"), batch.column("doc_id").to_pylist()
            for d, ids in zip(docs, encoder(path).encode(texts), strict=True):
                who.append(d)
                held.append(np.append(ids, np.uint32(END_ID)))
                count += len(ids) + 1
                if count >= BLOCK_IDS:
                    yield out()
                    who, held, count, number = [], [], 0, number + 1
        if held:
            yield out()

    return blocks


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files to the folder ``path``, which must not exist; returns the table of their blocks.

    Without a path the files are scratch: in the shared folder, until the application ends. Shards are of
    about SHARD_BYTES of text. Order: ascending doc_id, null first, rows of one doc_id by hash of their
    text, which also lets a doc_id with very many rows span shards. Null and empty texts hold the end id
    alone; an empty table has no blocks; other columns are not written.
    """
    spark = docs.sparkSession
    settle(spark)
    n = shards or int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES) + 1
    ordered = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text").repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    blocks = ordered.select("doc_id", "text").mapInArrow(_write(vocabulary or default_vocabulary()), _BLOCKS)
    if path is None:
        return cut(blocks)
    blocks.write.parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def open_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The table of blocks that ``write_token_files`` wrote to ``path``."""
    return spark.read.schema(_BLOCKS).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block, docs, payload in zip(batch.column("shard"), batch.column("block"), batch.column("doc_ids"), batch.column("payload"), strict=True):
            b = Block(payload.as_py())
            ids, ends = b.read().astype("<u4"), np.cumsum(b.lengths)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, b.lengths, strict=True)]
            rows = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * rows, pa.int32()), pa.array([block.as_py()] * rows, pa.int32()), docs.values, pa.array(ends - b.lengths, pa.int64()), pa.array(b.lengths, pa.int64()), pa.array(crc, pa.int64())], ["shard", "block", "doc_id", "_at", "n_tokens", "ids_crc32"])


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the blocks.

    Where a shard starts is a running sum over shards, one row each; within a shard, over its blocks.
    """
    from pyspark.sql import Window

    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_shard"))
    within = sizes.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("_block"))
    starts = within.join(before, "shard").select("shard", "block", (F.col("_shard") + F.col("_block")).alias("_start"))
    docs = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(_read, "shard int, block int, doc_id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, read back from the token files: start, n_tokens and the CRC-32 of its ids.

    A null or empty text has the end id alone. Rows that share a doc_id stand side by side, rows without one after all others; texts of any
    length are encoded whole. An empty table gives an empty one. Only doc_id and text are read.
    """
    return read_documents(write_token_files(load(spark, sf_dir, "documents").select("doc_id", "text")))
