"""The corpus operators against plain code on small, awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import image_copies, language_id, line_dedup, mixing, near_dedup, pieces, quality_classifier, quality_rules, repeats, token_files
from sextant.llm.common import lower_bytes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet. " * 400
AWKWARD = [
    (1, "One two three four five six seven.\nSame line here!\n\nTail", "en", "a", 1),
    (1, "One two three four five six seven.\nSame line here!\n\nTail", "en", "a", 1),
    (2, "\t same LINE here! \nAnother body of words that nobody else has", "en", None, None),
    (3, None, None, "b", 0),
    (None, "Same line here!\nno id at all", "en", "a", 3),
    (None, None, None, None, None),
    (4, "", "fr", "b", 0),
    (5, " \n\t ", "fr", "b", 0),
    (6, LONG, "la", "b", len(LONG)),
    (7, LONG + "end", "la", "é", len(LONG)),
    (8, "$$$ ### 12345", None, "c", 5),
    (2, "Second row of the same id, with other words in it", "en", "c", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_text_stats_against_plain_code():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b", "c ", "a b c ", "\n", "#", "é", " ", "!\n"]) for _ in range(rng.randint(0, 60)))
        words = [w for w in t.encode().split()]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            dup += bool(x.encode().split()) and x in seen
            seen.add(x)
        assert quality_rules.text_stats(t)[:5] == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
    assert quality_rules.text_stats(None) == (0,) * len(quality_rules.STATS)


def test_quality_rules(spark, docs, empty):
    good = [(100 + i, " ".join(f"word{i}x{j}" for j in range(80)) + ".", "en", "s", 1) for i in range(60)]
    bad = [(200 + i, " ".join(f"w{i}x{j}$$$" for j in range(80)), "en", "s", 1) for i in range(6)]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(spark.createDataFrame(good + bad + AWKWARD, SCHEMA)).collect()}
    assert {x[0] for x in good} <= kept and not kept & {x[0] for x in bad} and not kept & {3, 4, 5, 8}
    assert quality_rules.quality_rules(empty).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.8
    votes = np.where(rng.random((20000, 8)) < np.where(y[:, None], 0.98, 0.6), np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.fit_label_model(patterns, counts)
    assert abs(m.prior - 0.8) < 0.03 and all(abs(g - 0.98) < 0.03 and abs(b - 0.6) < 0.06 for g, b in m.accuracy)


def test_targets():
    got = mixing.targets({"a": 100, "b": 1, "c": 50, None: 10})
    assert got["b"] == 3 and sum(got.values()) == pytest.approx(161) and got[None] == 30
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(0)
    pi, size = rng.random(500), rng.integers(0, 900, 500)
    out = mixing.flight(pi, size, 7)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs((out - pi).sum()) < 1e-6 and abs((out - pi) @ size) < 1e-3
    tries = np.mean([mixing.flight(pi[:30], size[:30], s) for s in range(400)], 0)
    assert np.abs(tries - pi[:30]).max() < 0.15


def test_mixing(spark, docs, empty):
    rng = random.Random(5)
    rows = AWKWARD + [(i, "w " * rng.randint(1, 99), "en", rng.choice(["a", "b", None]), 1) for i in range(1000, 2500)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in ("a", "b", None))
    mix = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA))
    assert mix.columns == docs.columns and abs(mix.filter("source = 'a'").select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] - target["a"]) <= 5
    assert mixing.mixed(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    def key(x):
        return lower_bytes(x.encode()).strip(b" \t\n\x0b\x0c\r").decode()

    last = 2**63
    holders = defaultdict(set)
    for d, t, *_ in AWKWARD:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(last if d is None else d)
    want = []
    for d, t, *_ in AWKWARD:
        lines = (t or "").split("\n")
        gone = [len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != (last if d is None else d) for x in lines]
        want.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "") for r in line_dedup.with_lines_dropped(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert line_dedup.line_dedup(docs).columns == docs.columns and line_dedup.line_dedup(empty).count() == 0


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = lower_bytes((t or "").encode()).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                up[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            k = find(i)
            least[k] = d if least[k] is None else min(d, least[k])
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, empty, width, percent):
    rng = random.Random(8)
    rows = [(d, t) for d, t, *_ in AWKWARD]
    base = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(120)]
    for i in range(60):  # a hub, and copies with more and more edits that are not all alike
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicates(table, width, percent).collect()
    want = brute_components(rows, width, percent)
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, want))
    left = near_dedup.near_dedup(table, width, percent).collect()
    with_words = [r["doc_id"] for r in left if (r["text"] or "").split()]
    assert sorted(x for x in with_words if x is not None) == sorted({c for _, n, c in want if n and c is not None})
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.near_dedup(empty).columns == empty.columns


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 3, 50, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert not (near_dedup.sketch(a) == near_dedup._UNSEEN).any()
    agree = []
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
        agree.append((near_dedup.sketch(x[:360]) == near_dedup.sketch(x[40:])).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_repeats(spark, docs, empty):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(30, 120))) for _ in range(12)]
    rows = [(d, t) for d, t, *_ in AWKWARD]
    for i in range(100):
        t = "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, i, None]), rng.choice([t, t, t, None, "a" * rng.randint(0, 300)])))
    last, first = 2**63, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], last), last if d is None else d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (last if d is None else d):
                gone[i : i + 50] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        want.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("row.doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert repeats.without_repeats(empty).count() == 0


def test_collection_is_sorted_with_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(30):
        m = int(rng.integers(1, 12))
        s, base = np.zeros((m, repeats.WIDTH), np.uint8), rng.integers(1, 4, 200).astype(np.uint8)
        for i in range(m):
            a, b, o = rng.integers(0, 10), rng.integers(60, repeats.WIDTH + 1), rng.integers(0, 100)
            s[i, a:b] = base[o : o + b - a]
        owner, start, lcp = repeats.collection(s)
        ends = [int(np.flatnonzero(x)[-1]) + 1 for x in s]
        suffixes = [bytes(s[o, b : ends[o]]) for o, b in zip(owner, start)]
        assert suffixes == sorted(suffixes) and len(suffixes) == int((s > 0).sum()) + m
        for x, y, n in zip(suffixes, suffixes[1:], lcp[1:]):
            assert n == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_the_two_ways_to_cover_agree():
    rng = np.random.default_rng(1)
    r = np.zeros(200, repeats._RECORD)
    base = rng.integers(1, 5, (4, repeats.WIDTH)).astype(np.uint8)
    r["context"], r["left"], r["size"], r["doc"] = base[rng.integers(0, 4, 200)], repeats.REACH, repeats.WIDTH, rng.permutation(200)
    for i in range(200):
        r["context"][i, : rng.integers(0, repeats.REACH)] = rng.integers(1, 5)
    r["context"][:, repeats.REACH : repeats.REACH + repeats.K] = 9
    a, b = (set(zip(*(x.tolist() for x in f(r)))) for f in (repeats._covered, repeats._covered_by_sort))
    assert a == b and a


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.default_vocabulary())
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.read_documents(token_files.write_token_files(docs.select("doc_id", "text"), shards=3)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t, *_ in AWKWARD)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert token_files.read_documents(token_files.write_token_files(empty.select("doc_id", "text"))).count() == 0


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (7, 1), (5000, 1), (5000, 2), (5000, 40)])
def test_blocks_read_anywhere(n, kinds):
    rng = random.Random(n + kinds)
    ids = np.array([rng.randrange(kinds) * 7 for _ in range(n)], np.int64)
    block = token_files.Block(token_files.write_block(ids, np.array([n])))
    assert (block.read() == ids).all()
    for _ in range(40):
        a, m = rng.randrange(n + 1), rng.randrange(n + 1)
        assert (block.read(a, m) == ids[a : a + m]).all()


def test_words_are_enough_for_the_tokenizer():
    from tokenizers import Tokenizer

    plain, mine, rng = Tokenizer.from_file(token_files.default_vocabulary()), token_files.Encoder(token_files.default_vocabulary()), random.Random(2)
    bits = ["a", "'s", "<|endoftext|>", "<|startoftext|>", " ", "\n", "\x0b", " ", "é", "́", "İ", "Σ", "1", "!", "\x1c", " ", "日本", "\x00"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        assert mine.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_texts_in_arrow_are_encoded_as_the_library_does():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, mine, rng = Tokenizer.from_file(token_files.default_vocabulary()), token_files.Encoder(token_files.default_vocabulary()), random.Random(3)
    bits = ["a", "The", "ÀÉ", "ß", "ñ", "ÿ", "Ł", "×", "endoftext", "'s", ".", "?!", "....", "7", "$", " ", " ", "\n", "\x0b", "\x1c", "\u00a0", "w" * 41]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, "", " ", " x ", "reblethoning toanonndsh,"]
    whole = pa.array(texts, pa.string())
    assert mine.forms is not None  # words of letters go straight to the library's model
    for begin, end in ((0, 700), (700, 700), (700, len(texts))):
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts[begin:end]]
        assert [x.tolist() for x in mine.encode(whole.slice(begin, end - begin))] == want
    mine.forms = None
    mine.known = {}
    assert [x.tolist() for x in mine.encode(whole)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_marks_behind_letters_are_parted_from_their_words():
    """A word that only its marks tell from others costs no call of the library; ids stay those of whole texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, mine, rng = Tokenizer.from_file(token_files.default_vocabulary()), token_files.Encoder(token_files.default_vocabulary()), random.Random(9)
    ends = [*token_files.MARKS, ",###", ".$$$", "%%%%%%%%", "*********", "'s.", "'", "<|", "|>", "<|endoftext|>.", "\u0301.", "\u0338,", "=\u0338"]
    starts = ["word", "Zé", "É", "ÿ", "×", "x÷", "ł", "日本", "7", "a7", "don't", "(b", "#a", "", "<|endoftext|>", "l" * 45]
    texts = ["".join(rng.choice(starts) + rng.choice(ends) + rng.choice(["", " ", "\n", " \t", "\u00a0"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += [None, "", " ", ",", " , ", "a,", "a, ", "é.", *(a + b for a in starts for b in ends)]
    whole = pa.array(texts, pa.string())
    for begin, end in ((0, 1000), (1000, 1001), (1001, len(texts))):
        assert [x.tolist() for x in mine.encode(whole.slice(begin, end - begin))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts[begin:end]]
    mine = token_files.Encoder(token_files.default_vocabulary())
    mine.encode(["some some. some, some### some.%%% é é! é$$$"])
    assert set(mine.known) == {b"", b"some", "é".encode(), b".", b",", b"###", b".%%%", b"!", b"$$$"}


def test_pieces_against_the_library(spark, docs, empty):
    import sentencepiece

    sp, t, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), pieces.transducer(pieces.default_model()), random.Random(1)
    vocabulary = [sp.id_to_piece(i) for i in range(259, 32000)]
    texts = ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) for _ in range(2000)] + ["".join(rng.choice("ab \n\tthe  inxé①日́\U0001d518▁") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [x[1] or "" for x in AWKWARD]
    for x in texts:
        assert t.encode(x) == sp.encode(x) and t.decode(sp.encode(x)) == sp.decode(sp.encode(x))
    got = pieces.encode_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_pieces"]) for r in got) == sorted((str(d), len(sp.encode(x or ""))) for d, x, *_ in AWKWARD)
    assert pieces.encode_documents(empty).count() == 0
    assert docs.select("text", pieces.pieces_of(spark, docs["text"]).alias("p")).filter("text IS NOT NULL AND NOT p.back").count() == 0


def test_language_id(spark, docs, empty):
    rng = random.Random(3)
    words = {"xx": ["aba", "abo", "bab", "oba"], "yy": ["zuk", "kuz", "uzk", "kku"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(30)), g, "s", 1) for i in range(300) for g in [rng.choice(["xx", "yy"])]]
    table = spark.createDataFrame(rows + AWKWARD[:0] + [(900, None, "xx", None, None), (901, "123 $$", None, "s", 1), (None, "aba abo", "xx", "s", 1)], SCHEMA)
    model = language_id.train(*language_id.labelled_sample(table))
    got = {r["doc_id"]: r for r in language_id.identify(table.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score", language_id.held_out().alias("h")).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    held = [(d, g) for d, _, g, *_ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["h"] for d, _ in held) and np.mean([got[d]["lang_pred"] == g for d, g in held]) > 0.95
    none = language_id.train(*language_id.labelled_sample(empty))
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_quality_classifier(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.4
        w = [f"w{rng.randrange(50)}" + ("$$$" if bad else "") for _ in range(40)]
        if toxic:
            w[5] = "slur"
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
        rows[-1] += (bad, toxic)
    table = spark.createDataFrame([r[:5] for r in rows] + [(None, None, None, None, None), (999, "", None, None, 0)], SCHEMA)
    known = spark.createDataFrame([*labels, (labels[0][0], labels[0][1], labels[0][2]), (7777, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(table, known).collect()}
    assert np.mean([(got[r[0]]["quality"] >= 0.5) == (not r[5]) for r in rows]) > 0.95
    assert np.mean([(got[r[0]]["toxic"] >= 0.5) == r[6] for r in rows]) > 0.95
    assert quality_classifier.classify(empty, known.limit(0)).count() == 0
    assert {round(r["quality"], 6) for r in quality_classifier.classify(table, known.limit(0)).collect()} == {0.5}


def test_image_copies(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(12):
        plain = image_copies.drawn(rng.random(8))
        for k in range(5):
            x = image_copies.edited(plain, k)
            rows.append((10 * i + k, x.tobytes(), x.shape[0], x.shape[1]))
            want[10 * i + k] = 10 * i
    rows += [(900, None, 4, 4), (901, b"abc", 64, 64), (902, bytes(4096), 64, 64), (903, bytes(4096), 64, 64), (None, rows[0][1], 64, 64), (None, b"", None, None)]
    schema = "image_id bigint, pixels binary, height int, width int"
    got = {r["image_id"]: r["copy_of"] for r in image_copies.image_copies(spark.createDataFrame(rows[:-1], schema)).collect()}
    assert {k: v for k, v in got.items() if k is not None and k < 900} == want
    assert got[900] == 900 and got[901] == 901 and got[902] == got[903] == 902 and got[None] == 0
    assert image_copies.image_copies(spark.createDataFrame([], schema)).count() == 0


def _altered(image, kind, rng):
    """Noise, blur or a slightly smaller copy: edits that leave many strings 20 to 40 bits apart."""
    x = image.astype(float)
    if kind == 0:
        x += rng.normal(0, 30, x.shape)
    elif kind == 1:
        x = image_copies.blurred(image_copies.blurred(x)) + rng.normal(0, 12, x.shape)
    else:
        x = image_copies.resized(x, 57, 57) + rng.normal(0, 8, (57, 57))
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def test_image_links_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    images = [y for _ in range(40) for x in [image_copies.drawn(rng.random(8))] for y in (x, *(_altered(x, k, rng) for k in range(3)))]
    packed = [image_copies.describe(x) for x in images]
    want = {(i, j) for j in range(len(images)) for i in range(j) if image_copies.same_scene(*packed[i], *packed[j]) >= image_copies.LEAST_MATCHES}
    schema = "image_id bigint, pixels binary, height int, width int"
    table = spark.createDataFrame([(i, x.tobytes(), *x.shape) for i, x in enumerate(images)], schema)
    group = list(range(len(images)))
    for i, j in sorted(want):
        old, new = max(group[i], group[j]), min(group[i], group[j])
        group = [new if g == old else g for g in group]
    got = {r["image_id"]: r["copy_of"] for r in image_copies.image_copies(table).collect()}
    assert got == dict(enumerate(group))


@pytest.mark.parametrize("held", [1 << 24, 1 << 9])
def test_matches_of_blocks_against_pairs(held, monkeypatch):
    """Ties, equal strings and products taken in parts: the matches and links of blocks are those of each pair by itself."""
    rng = np.random.default_rng(21)
    base = [image_copies.drawn(rng.random(8)) for _ in range(9)]
    sets = [image_copies.describe(x) for b in base for x in (b, image_copies.edited(b, 3))] + [(np.zeros((0, 2)), np.zeros((0, 32), np.uint8))]
    sets += [(rng.random((40, 2)) * 60, rng.integers(0, 2, (40, 1), np.uint8) * np.ones((1, 32), np.uint8)) for _ in range(3)]
    want, links, fit = {}, set(), set()
    for i, (pa_, sa) in enumerate(sets):
        for j, (pb, sb) in enumerate(sets):
            d = np.bitwise_count(sa[:, None] ^ sb[None]).sum(2, dtype=np.int64)
            if d.size:
                best, back = d.argmin(1), d.argmin(0)
                p = [k for k in range(len(sa)) if d[k, best[k]] <= image_copies.NEAR_BITS and back[best[k]] == k]
                if len(p) >= image_copies.LEAST_MATCHES:
                    want[i, j] = (p, best[p].tolist())
                    if image_copies.same_scene(pa_, sa, pb, sb, image_copies.LEAST_MATCHES):
                        links.add((i, j))
    monkeypatch.setattr(image_copies, "HELD", held)
    for same in (False, True):
        got = {(i, j): (p.tolist(), q.tolist()) for i, j, p, q in image_copies.matched(sets, sets, same)}
        assert got == {k: v for k, v in want.items() if k[0] < k[1] or not same} and len(got) > 9
    for (i, j), (p, q) in want.items():
        a, b = sets[i][0][p] @ np.array([1, 1j]), sets[j][0][q] @ np.array([1, 1j])
        if len(image_copies.fitting(a[None], b[None])):
            fit.add((i, j))
    assert len(fit) < len(want) and links and links <= fit


def test_strings_close_on_any_axes(monkeypatch):
    """The bound of the shadows loses no string within NEAR_BITS, whatever the axes and the parts; opposite strings do not count as equal."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (50, 32), dtype=np.uint8)
    b = np.concatenate([a, ~a, *(np.packbits(np.unpackbits(a, axis=1) ^ (rng.random((50, 256)).argsort(1) < n), axis=1) for n in (39, 40, 41))])
    d = np.bitwise_count(a[:, None] ^ b[None]).sum(2, dtype=np.int64)
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    far = np.zeros(256, np.float32), np.eye(256, 2, dtype=np.float32)
    for tile in (1 << 18, 100):
        monkeypatch.setattr(image_copies, "TILE", tile)
        for main in (image_copies.axes(a), far):
            parts = image_copies._close(x, y, image_copies._shadows(a, *main)[0], image_copies._shadows(b, *main)[1])
            p, q, bits = (np.concatenate(v) for v in zip(*parts, strict=True))
            assert sorted(zip(p.tolist(), q.tolist(), bits.tolist(), strict=True)) == [(i, j, d[i, j]) for i, j in np.argwhere(d <= 40).tolist()] and len(p) >= 150


def test_matches_where_most_strings_are_equal(monkeypatch):
    """Images of a few strings each: what a part holds is cut to one match a string and image, with the same matches."""
    rng = np.random.default_rng(9)
    few = rng.integers(0, 256, (12, 32), dtype=np.uint8)
    sets = [(rng.random((30, 2)) * 60, few[rng.integers(0, 12, 30)]) for _ in range(6)]
    want = {}
    for i, (_, sa) in enumerate(sets):
        for j, (_, sb) in enumerate(sets):
            d = np.bitwise_count(sa[:, None] ^ sb[None]).sum(2, dtype=np.int64)
            p = [k for k in range(30) if d[k].min() <= image_copies.NEAR_BITS and d[:, d[k].argmin()].argmin() == k]
            want[i, j] = (p, d[p].argmin(1).tolist())
    for tile in (1 << 18, 1 << 9):
        monkeypatch.setattr(image_copies, "TILE", tile)
        got = {(i, j): (p.tolist(), q.tolist()) for i, j, p, q in image_copies.matched(sets, sets)}
        assert got == {k: v for k, v in want.items() if len(v[0]) >= image_copies.LEAST_MATCHES} and len(got) > 9


def test_copies_end_the_search_for_a_transform(monkeypatch):
    """Of two equal images one of the first transforms explains enough; the others are not tried."""
    points, strings = image_copies.describe(image_copies.drawn(np.random.default_rng(2).random(8)))
    tried, places = [], image_copies.places
    monkeypatch.setattr(image_copies, "places", lambda fits, at: tried.append(len(fits)) or places(fits, at))
    assert image_copies.same_scene(points, strings, points, strings, image_copies.LEAST_MATCHES) >= image_copies.LEAST_MATCHES
    assert 0 < sum(tried) <= 2 * len(points)


def test_blocks_of_images(spark, monkeypatch):
    """Each image comes once, in blocks that are bounded by their strings; those without strings are named and not compared."""
    monkeypatch.setattr(image_copies, "BLOCK", 300)
    rng = np.random.default_rng(6)
    images = [image_copies.drawn(rng.random(8)) for _ in range(12)] + [np.zeros((64, 64), np.uint8), np.zeros((3, 5), np.uint8)]
    columns = [[f"{k}" for k in range(14)], range(14), [x.tobytes() for x in images], *([x.shape[i] for x in images] for i in (0, 1))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sha", "node", "pixels", "height", "width"])
    blocks = [r for b in image_copies._blocks(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist()]
    packed = {k: image_copies.pack(*image_copies.describe(x)) for k, x in enumerate(images)}
    assert {x["node"]: x["d"] for r in blocks for x in r["_x"]} == {k: d for k, d in packed.items() if d} and len(packed[12]) == 0
    assert sorted((x["node"], x["sha"], x["n"]) for r in blocks for x in r["named"]) == [(k, f"{k}", len(d) // 40) for k, d in packed.items()]
    assert len(blocks) > 3 and max(sum(x["n"] for x in r["named"]) for r in blocks) < 600


def _tiled(rng, tile):
    return np.block([[image_copies.drawn(rng.random(8))[:tile, :tile] for _ in range(240 // tile)] for _ in range(240 // tile)])


def test_large_images_and_sizes():
    rng = np.random.default_rng(10)

    def linked(a, b):
        return image_copies.same_scene(*image_copies.describe(a), *image_copies.describe(b), image_copies.LEAST_MATCHES) >= image_copies.LEAST_MATCHES

    def sized(x, side):
        return np.clip(np.rint(image_copies.resized(image_copies.blurred(x.astype(float)), side, side)), 0, 255).astype(np.uint8)

    for _ in range(3):
        photo, collage = _tiled(rng, 40), _tiled(rng, 60)
        assert not linked(photo, collage)
        collage[100:160, 100:160] = photo[30:90, 30:90]
        for other in (photo[100:160, 70:130], collage, sized(photo, 180), sized(photo, 120), sized(photo, 100)):
            assert linked(photo, other) and linked(other, photo)


def test_few_true_matches_among_many():
    rng = np.random.default_rng(12)
    lost = 0
    for _ in range(80):
        strings = rng.integers(0, 256, (90, 32), dtype=np.uint8)
        one, two = rng.random((90, 2)) * 240, rng.random((90, 2)) * 240
        true = rng.permutation(90)[:8]
        one[true] = np.stack(np.divmod(np.arange(8), 3), 1) * 25.0 + 40
        two[true] = one[true] @ np.array([[0.0, 1.0], [-1.0, 0.0]]) + [200, 10]
        lost += image_copies.same_scene(one, strings, two, strings) < 8
    assert lost == 0


def test_blocks_until_no_pair_occurs_twice():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 40_000, 3000)
    for ids in (np.concatenate((passage, rng.integers(0, 40_000, 500), passage)), np.zeros(1001, np.int64), rng.integers(0, 9, 5000), passage[:1], passage[:0]):
        terminals, rules, lengths, string = token_files.compress(ids)
        seen: Counter = Counter()
        pairs = list(zip(string[:-1].tolist(), string[1:].tolist(), strict=True))
        last: dict = {}
        for at, pair in enumerate(pairs):
            if last.get(pair, -2) != at - 1:
                seen[pair] += 1
                last[pair] = at
        assert max(seen.values(), default=0) < 2
        assert token_files.Block(token_files.write_block(ids, np.array([len(ids)]))).read().tolist() == ids.tolist()
        if len(ids) == 6500:
            assert lengths.max() >= len(passage) - 1


def test_pipeline_on_awkward_rows(spark, docs, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.columns[:5] == docs.columns, name
        assert stage(spark, empty, "").count() == 0, name


def _plain_kept(rows, model):
    """Quality rules in plain code: the votes of each text and their posterior."""
    kept = []
    for r in rows:
        s = dict(zip(quality_rules.STATS, quality_rules.text_stats(r[1])))
        part = lambda a, b: s[a] / max(1, s[b])  # noqa: B023, E731
        mean, punct, ended = part("word_chars", "n_words"), part("n_punct", "word_chars"), part("n_ended_lines", "n_lines")
        cast = [
            (part("n_symbols", "n_words") < 0.02, part("n_symbols", "n_words") > 0.1),
            (part("n_repeat_words", "n_words") < 0.1, part("n_repeat_words", "n_words") > 0.3),
            (s["n_dup_lines"] == 0, part("n_dup_lines", "n_lines") > 0.4),
            (3 <= mean <= 9, mean < 2.5 or mean > 12),
            (part("n_upper", "n_letters") < 0.15, part("n_upper", "n_letters") > 0.4),
            (part("n_marks", "n_words") < 0.05, part("n_marks", "n_words") > 0.3),
            (punct < 0.06, punct > 0.08),
            (ended > 0.7, ended < 0.1),
        ]
        odds = model.prior / (1 - model.prior)
        for (good, bad), (p, q) in zip(cast, model.accuracy, strict=True):
            odds *= (1 - p) / q if bad else p / (1 - q) if good else 1
        if s["n_words"] >= 50 and 2 * s["n_repeat_words"] <= s["n_words"] and odds >= 1:
            kept.append(r)
    return kept


def test_pipeline_against_plain_code(spark):
    import os

    import sentencepiece

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    stages, rows = [f for _, f in corpus_pipeline.STAGES], [tuple(r) for r in table.collect()]
    model = quality_rules.learn(table.select(quality_rules.text_statistics(spark, table["text"]).alias("stats")))

    def step(i, frame):
        out = stages[i](spark, frame, sf)
        return out, [tuple(r) for r in out.collect()]

    frame, got = step(0, table)
    assert sorted(map(str, got)) == sorted(map(str, _plain_kept(rows, model)))
    rows, (frame, got) = got, step(1, frame)
    key = lambda x: lower_bytes(x.encode()).strip(b" \t\n\x0b\x0c\r").decode()
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    want = []
    for d, t, g, s, n in rows:
        left = [x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        want.append((d, "\n".join(left), g, s, len("\n".join(left))))
    assert sorted(map(str, got)) == sorted(map(str, want))
    rows, (frame, got) = got, step(2, frame)
    stay = {c for _, n, c in brute_components([(d, t) for d, t, *_ in rows], 5, 80) if n} | {d for d, t, *_ in rows if not (t or "").split()}
    assert sorted(map(str, got)) == sorted(str(r) for r in rows if r[0] in stay)
    rows, (frame, got) = got, step(3, frame)
    size = {r[0]: len(r[1].encode().split()) for r in rows}
    per, taken, copies = defaultdict(int), defaultdict(int), Counter(r[0] for r in got)
    for r in rows:
        per[r[3]] += size[r[0]]
    for r in got:
        taken[r[3]] += size[r[0]]
    want_ = mixing.targets(dict(per))
    assert set(got) <= set(rows) and max(copies.values()) <= 3
    assert all(abs(taken[s] - want_[s]) <= max(size[r[0]] for r in rows if r[3] == s) for s in per)
    rows, (frame, got) = got, step(4, frame)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    ids = {r[1]: sp.encode(r[1]) for r in rows}
    assert sorted(map(str, got)) == sorted(str((*r, len(ids[r[1]]), ids[r[1]])) for r in rows)
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(map(str, got))


EXTRA = ["row", "_row", "_kept", "_stats", "stats", "_out", "_n", "_t", "_c", "key", "_key", "_copies", "n", "taken", "p", "_p", "f", "h", "cut", "_cut", "_pieces", "did", "th", "node", "comp", "part", "i", "kept", "lines", "gone", "a.b", "worded", "t1", "s"]


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """The awkward rows with columns named as any operator might name its own, and one of maps."""
    return docs.select("*", *(F.concat_ws("-", F.lit(c), "doc_id", "source").alias(c) for c in EXTRA), F.create_map(F.lit("k"), "doc_id").alias("m"))


@pytest.mark.parametrize("apply", [quality_rules.quality_rules, line_dedup.line_dedup, near_dedup.near_dedup, mixing.mix_sources, pieces.encode_documents, lambda d: language_id.identify(d, language_id.train([], [])), lambda d: quality_classifier.classify(d, d.sparkSession.createDataFrame([], "doc_id bigint, quality int, toxic int"))], ids=["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode_documents", "identify", "classify"])
def test_other_columns_stay(clashing, apply):
    out = apply(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    for r in out.collect():
        assert all(r[c] == "-".join(str(x) for x in (c, r["doc_id"], r["source"]) if x is not None) for c in EXTRA) and r["m"] == {"k": r["doc_id"]}


def test_other_columns_stay_beside_repeats(clashing):
    for r in repeats.without_repeats(clashing).select("row.*").collect():
        assert all(r[c] == "-".join(str(x) for x in (c, r["doc_id"], r["source"]) if x is not None) for c in EXTRA)


def test_long_words_differ_by_the_place_of_their_bytes(spark):
    a, b = bytearray(b"x" * 9000), bytearray(b"x" * 9000)
    a[100], a[100 + 4096], b[100], b[100 + 4096] = b"yzzy"
    rows = [(1, a.decode()), (2, b.decode()), (3, a.decode())]
    assert near_dedup.shingle_sets([t for _, t in rows], 3)[0] != near_dedup.shingle_sets([t for _, t in rows], 3)[1]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_texts_over_a_piece(spark):
    """Texts of more than a mebibyte take the ways for long texts of shingles, subwords and anchors."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**7)}" for _ in range(180_000)]
    text = " ".join(words)
    assert len(text) > 1 << 20
    (got,) = near_dedup.shingle_sets([text], 3)
    assert len(got) == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    short = text[: 1 << 16]
    table = spark.createDataFrame([(1, text), (2, text[-300:] + "!"), (3, text + " tail"), (4, short)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.without_repeats(table).select("row.doc_id", "cut.n_removed").collect()}
    assert got == {1: 0, 2: 300, 3: len(text), 4: len(short)}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table, 3, 85).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_spans_of_very_many_texts():
    n = 3 * (1 << 22)
    text = np.repeat(np.arange(n // 2, dtype=np.int64), 2)
    begin = np.tile(np.array([0, 30], np.int64), n // 2)
    t, b, e = repeats._spans(text, begin, begin + 50)
    assert len(t) == n // 2 and (b == 0).all() and (e == 80).all()


def test_counts_of_common_shingles():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(np.concatenate((rng.integers(0, 60, rng.integers(1, 50)), rng.integers(0, 10**6, 20)))).astype(np.uint64) for _ in range(n)] for n in (40, 33))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert (near_dedup.common_counts(left, right) == np.array(want)).all()
    assert (near_dedup.common_counts(left[:1], right[:1]) == np.array(want)[:1, :1]).all()


def test_thresholds_without_a_shape_are_refused():
    assert near_dedup.shape(85) == (36, 8) and near_dedup.shape(80) == (48, 6)
    with pytest.raises(ValueError):
        near_dedup.shape(3)


def test_equal_rows_are_one_unit(spark):
    rows = [(7, "w " * 9, "en", "a", 1)] * 20_000 + [(i, "w " * (i % 50), "en", "b", 1) for i in range(3000)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(table).collect()
    assert len(got) == len(rows) and max(r["copies"] for r in got) - min(r["copies"] for r in got if r["source"] == "a") <= 3
    for s in "ab":
        taken, target = sum(r["size"] * r["copies"] for r in got if r["source"] == s), next(r["target"] for r in got if r["source"] == s)
        assert abs(taken - target) <= 9
    assert len({r["copies"] for r in got if r["doc_id"] == 7 and r["source"] == "a"}) <= 2
    assert mixing.mix_sources(table).filter("source = 'a'").count() == sum(r["copies"] for r in got if r["source"] == "a")


def test_one_doc_id_very_often(spark):
    rows = [(1, "aba abo bab", "xx", "s", 1)] * 20_000 + [(i, "zuk kuz uzk" if i % 2 else "aba bab oba", "yy" if i % 2 else "xx", "s", 1) for i in range(2, 400)]
    counts, labels = language_id.labelled_sample(spark.createDataFrame(rows, SCHEMA))
    assert len(labels) <= 400 and labels.count("yy") > 100
    known = spark.createDataFrame([(i, i % 2, None) for i in range(1, 300)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["quality"] for r in quality_classifier.classify(spark.createDataFrame(rows, SCHEMA), known).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(300, 400)]) > 0.95


def test_unseen_script_is_rejected(spark):
    rng = random.Random(3)
    words = {"xx": ["aba", "abo", "bab", "oba"], "yy": ["zuk", "kuz", "uzk", "kku"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(30)), g, "s", 1) for i in range(300) for g in [rng.choice(["xx", "yy"])]]
    table = spark.createDataFrame([*rows, (900, "это другой язык совсем иначе", None, "s", 1)], SCHEMA)
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(table, language_id.train(*language_id.labelled_sample(table))).collect()}
    assert got[900] and np.mean([got[r[0]] for r in rows]) < 0.05


def test_token_files_at_a_path(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs.select("doc_id", "text"), path=path, shards=2)
    again = token_files.read_documents(token_files.open_token_files(spark, path))
    assert again.count() == len(AWKWARD)


def test_tokenizers_that_see_spaces_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, mine = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["one two  three", " lead", "a\nb", None, "", "Zé 12"]
    assert not mine.by_word and token_files.Encoder(token_files.default_vocabulary()).by_word
    assert [x.tolist() for x in mine.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_unfit_models_are_refused(tmp_path):
    def message(*fields):
        return b"".join(bytes([n << 3]) + bytes([v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v for n, v in fields)

    for trainer, spec in (([(3, 1)], []), ([(3, 2)], [])):
        path = tmp_path / "x.model"
        path.write_bytes(message((2, message(*trainer)), (3, message(*spec))))
        with pytest.raises(ValueError):
            pieces.Normaliser(str(path))


def test_stretches_with_shared_beginnings():
    import sentencepiece

    sp, t, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), pieces.Transducer(pieces.default_model()), random.Random(4)
    t.ends.most = 200_000
    for _ in range(4000):  # with caches that overflow again and again
        x = "".join(rng.choice(["th", "er", "ing", "on", ",", ".", " ", "é", "\u3042", "A"]) for _ in range(rng.randint(1, 30)))
        assert t.encode(x) == sp.encode(x)
