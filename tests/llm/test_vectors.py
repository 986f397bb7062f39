"""Whitening, SimHash and hard negatives against plain code on small, awkward tables."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sextant.llm import negatives, simhash, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int"


def clusters(n, d=6, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.1
    return np.float32(base + rng.normal(size=d))


# whitening


def test_merge_is_lossless():
    x = clusters(500).astype(float)
    parts = np.split(x, [1, 2, 100, 103, 400])
    total = whitening.summarize(parts[0])
    for p in parts[1:]:
        total = whitening.merge(total, whitening.summarize(p))
    whole = whitening.summarize(x)
    assert total.n == 500 and np.allclose(total.sums, whole.sums, rtol=1e-13) and np.allclose(total.values, whole.values, rtol=1e-11)
    cov = total.vectors.T * total.eigenvalues @ total.vectors
    assert np.allclose(cov, np.cov(x.T, bias=True), rtol=0, atol=1e-14)


def test_op11_against_numpy(spark, tmp_path):
    x = clusters(700, 12)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0] * 11 + [None], 1), (903, [float("nan")] * 12, 1), (904, [float("inf")] * 12, 1), (None, x[0].tolist(), None), (5, x[5].tolist(), 2)]
    spark.createDataFrame(rows + odd, VECTORS).repartition(20).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_whitening(spark, str(tmp_path)).collect()
    kept = np.vstack((x, x[0], x[5])).astype(float)
    w = np.floor(1024 * kept).astype(np.int64) + 100000
    n, s = len(w), w.sum(0)
    e, v = np.linalg.eigh(np.cov(w.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    want = (w - s / n) @ v[:, :8] / np.sqrt(e[:8])
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for r in w]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    sign = {}
    for r in got:
        i = 700 if r["vec_id"] is None else r["vec_id"]
        k = r["component"] - 1
        s_ = sign.setdefault(k, np.sign(r["whitened"] * want[i, k]))
        assert r["deviation"] == deviation[i] and abs(r["whitened"] * s_ - want[i, k]) < 1e-9 and abs(r["explained"] - e[k] / e.sum()) < 1e-12
    assert sorted(sign) == list(range(8))


def test_whitening_of_awkward_tables(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return whitening.op11_whitening(spark, f"{tmp_path}/{name}").collect()

    assert run([], "none") == [] and run([(1, None, 1)], "null") == []
    one = run([(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1)], "equal")
    assert len(one) == 4 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in one)
    mixed = run([(1, [0.5, 0.25], 1), (2, [0.0, 0.5], 1), (3, [1.0], 1), (4, [2.0], 1), (5, [3e38], 1)], "widths")
    assert {(r["vec_id"], r["n"]) for r in mixed} == {(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)}
    assert [r["deviation"] for r in mixed if r["vec_id"] == 5] == [None]


def test_whiten_keeps_columns_and_all_components(spark):
    x = clusters(300, 5)
    rows = [(i, v.tolist(), "a", "b") for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "`a.b` bigint, embedding array<float>, v string, _g string")
    out = whitening.whiten(t)
    assert out.columns == ["a.b", "embedding", "v", "_g"]
    w = np.array([r["embedding"] for r in out.collect()])
    assert w.shape == (300, 5) and np.allclose(np.cov(w.T, bias=True), np.eye(5), atol=1e-9)
    assert whitening.whiten(t.limit(0)).count() == 0


# simhash


def plain_simhash(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    """Least doc_id that steps of ``radius`` bits reach, by rows (doc_id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius or prints[i][0] is not None and prints[i][0] == prints[j][0]:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(prints):
        ids.setdefault(find(i), []).append(doc)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(prints))]


def test_fingerprints_against_plain_code(monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE", 50)
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", "c ", "É ", "\n", "\x1c", "word ", "  ", "　x "]) for _ in range(rng.randint(0, 200)))
        assert simhash.simhash(t.encode()) == plain_simhash(t)
    assert simhash.simhash(b"") == simhash.simhash(b" \n") == 0


def test_the_hash_is_the_one_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_masks_cover_every_pair():
    for radius in (2, 4):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        rng = random.Random(6)
        spots = [(i, j) for i in range(64) for j in range(i)] if radius == 2 else [rng.sample(range(64), 4) for _ in range(3000)]
        assert all(any(not m & sum(1 << p for p in s) for m in tables) for s in spots)


@pytest.mark.parametrize("bucket", [256, 3, 1])
def test_links_connect_what_brute_force_connects(spark, bucket):
    rng = random.Random(7)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    fps |= {rng.getrandbits(12) << 20 for _ in range(150)}  # many that agree on most bits
    fps = sorted(fps)
    signed = [(simhash._signed(x),) for x in fps]
    links = simhash.links_within(spark.createDataFrame(signed, "fp bigint"), 2, bucket).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in links)
    root = {x[0]: x[0] for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r["a"])] = find(r["b"])
    mine = {}
    for i, x in enumerate(signed):
        mine.setdefault(find(x[0]), set()).add(i)
    theirs = {}
    for i, c in enumerate(plain_components(list(enumerate(fps)), 2)):
        theirs.setdefault(c, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_op12_against_plain_code(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), " ".join(t), "x"))
            t = [*t]
            t[rng.randrange(len(t))] = rng.choice(words)
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (None, rows[3][1], "x"), (None, "nobody else has this", "x"), (1003, "one two THREE", "x"), (1003, "four five six", "x"), (1004, "FOUR five six", "x"), (3, rows[3][1], "x"), (1005, "long words " * 200_000, "x")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id bigint, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op12_simhash(spark, str(tmp_path)).collect()
    prints = [(d, plain_simhash(t)) for d, t, _ in rows]
    want = sorted(((d is None, d or 0, f"{f:016x}", c is None, c or 0) for (d, f), c in zip(prints, plain_components(prints, 2), strict=True)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"] is None, r["component_id"] or 0) for r in got) == want
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert simhash.op12_simhash(spark, f"{tmp_path}/none").count() == 0


# hard negatives


def plain_negatives(rows, anchors, positives, negatives_, low, high):
    out = []
    for a, la, xa in {(a, la, tuple(xa)) for a, la, xa in anchors}:
        score = lambda x: sum(p * q for p, q in zip(xa, x, strict=True))  # noqa: E731, B023
        fit = [(i, lab, score(x)) for i, lab, x in rows if len(x) == len(xa)]
        first = sorted(((-s, i) for i, lab, s in fit if lab == la and i != a))[:positives]
        for ps, pid in first:
            good = sorted(((-s, i) for i, lab, s in fit if lab != la and low * -ps <= 100 * s <= high * -ps))[:negatives_]
            out += [(a, pid, r + 1, i, -ps, -s) for r, (s, i) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 60, 10**6, 2**29])
def test_hard_negatives_against_plain_code(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    rng = random.Random(9)
    d = 8
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 7]), [rng.randint(-scale, scale) for _ in range(d)]) for i in range(300)]
    rows += [(400, 1, [1, 2]), (401, 2, [1, 2]), (402, 1, [3, 1]), (10, 0, rows[10][2]), (20, 5, rows[20][2])]
    anchors = [r for r in rows if r[0] % 10 == 0]
    t = spark.createDataFrame([*rows, (None, 1, [1] * d), (500, None, [1] * d), (501, 1, None), (502, 1, []), (503, 1, [None] * d)], "id bigint, label int, x array<bigint>").repartition(3)
    got = negatives.hard_negatives(t, t.filter("id % 10 = 0"), 3, 4)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == plain_negatives(rows, anchors, 3, 4, 30, 90)


def test_hard_negatives_of_empty_tables(spark):
    t = spark.createDataFrame([], "id bigint, label int, x array<bigint>, score string")
    assert negatives.hard_negatives(t, t).count() == 0


def test_planes_bound_every_product():
    rng = np.random.default_rng(10)
    rows, a = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, 7)
    total, exact = np.zeros(50), rows @ a
    for w, p, rest in negatives.Planes(rows, int(np.abs(a).sum())).steps():
        total += p @ a * w
        assert ((total + rest * np.minimum(a, 0).sum() <= exact) & (exact <= total + rest * np.maximum(a, 0).sum())).all()
    assert (total == exact).all()
