"""Copies of images by local descriptors.

Every image gives corners at several scales; each corner a 256-bit string of intensity tests on a patch
turned to its main direction. Matches vote for a similarity transform; a pair of images is a copy if one transform
explains enough of them.

Equal images collapse to one node before they are described. Then every pair of nodes is compared, block by block: strings of unrelated
images agree so often in any set of tables that covers NEAR_BITS of BITS that all pairs meet there, so tables would
save nothing: two images in three that have nothing in common have LEAST_MATCHES such strings, each the other's nearest.
A matrix product of two blocks gives the distances of all their strings on the main axes, which are never more than the whole; those
that leave NEAR_BITS possible are counted, and give the matches of each pair of images. Those of
many pairs, as many matches each, go through the transforms at once, and only pairs of which one explains LEAST_MATCHES
go through the check of their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, load, settle
from sextant.llm.near_dedup import components

BITS = 256
#: Levels of each image; the factors between levels of two images run over the scales that same_scene admits.
SCALES = tuple(2.5 ** (k / 4) for k in range(5))
NEAR_BITS, LEAST_MATCHES, TOLERANCE, PLACE = 40, 8, 2.5, 4
RADIUS = 9
SIDE = 64
#: Strings in a block of images, distances held at once at most and as a rule, matches up to which pairs of images are tried together.
BLOCK, HELD, TILE, FEW = 16384, 1 << 24, 1 << 18, 32
#: Numbers that a string casts as its shadow.
AXES = 64


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5, (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    y, x = np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), image.shape[0] - 2), np.minimum(x.astype(int), image.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a, b, c, d = image[y0][:, x0], image[y0][:, x0 + 1], image[y0 + 1][:, x0], image[y0 + 1][:, x0 + 1]
    return (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy


def blurred(image: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.clip(np.arange(-2, n + 2), 0, n - 1)
        p = image[at] if axis == 0 else image[:, at]
        parts = [p[k : k + n] if axis == 0 else p[:, k : k + n] for k in range(5)]
        image = (parts[0] + 4 * parts[1] + 6 * parts[2] + 4 * parts[3] + parts[4]) / 16
    return image


@lru_cache(maxsize=1)
def tests() -> np.ndarray:
    """Pairs of points of the intensity tests, drawn once from a normal distribution within the patch."""
    p = np.random.default_rng(31).normal(0, RADIUS / 2.2, (BITS, 2, 2))
    return np.clip(p, -RADIUS, RADIUS)


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of all Harris maxima over the response bar and far enough from the border, the strongest first, and their strengths."""
    gy, gx = np.gradient(image)
    a, b, c = blurred(gx * gx), blurred(gy * gy), blurred(gx * gy)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    h, w = r.shape
    inner = r[RADIUS : h - RADIUS, RADIUS : w - RADIUS]
    peak = inner > max(1e-9, 0.005 * r.max())
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                peak &= inner >= r[RADIUS + dy : h - RADIUS + dy, RADIUS + dx : w - RADIUS + dx]
    y, x = np.nonzero(peak)
    y, x = y + RADIUS, x + RADIUS
    order = np.lexsort((x, y, -r[y, x]))
    return np.stack((x[order], y[order]), 1).astype(float), r[y, x][order]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, y in the image's own pixels) and packed strings of the corners of all scales; an image too small or flat has none."""
    points, strings = [], []
    image = image.astype(float) / 255
    for s in SCALES:
        h, w = round(image.shape[0] / s), round(image.shape[1] / s)
        if min(h, w) < 2 * RADIUS + 3:
            continue
        level = blurred(resized(image, h, w) if s != 1 else image)
        at, _ = corners(level)
        if not len(at):
            continue
        grid = np.arange(-RADIUS, RADIUS + 1)
        disc = [(x, y) for x in grid for y in grid if x * x + y * y <= RADIUS * RADIUS]
        dx, dy = np.array(disc).T
        xi, yi = at[:, 0].astype(int)[:, None], at[:, 1].astype(int)[:, None]
        v = level[np.clip(yi + dy, 0, h - 1), np.clip(xi + dx, 0, w - 1)]
        angle = np.arctan2((v * dy).sum(1), (v * dx).sum(1))
        p = tests()
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = p[None, :, :, 0] * cos - p[None, :, :, 1] * sin, p[None, :, :, 0] * sin + p[None, :, :, 1] * cos
        sx, sy = np.clip(np.rint(at[:, 0, None, None] + px), 0, w - 1).astype(int), np.clip(np.rint(at[:, 1, None, None] + py), 0, h - 1).astype(int)
        bits = level[sy[..., 0], sx[..., 0]] < level[sy[..., 1], sx[..., 1]]
        points.append((at + 0.5) * s - 0.5)
        strings.append(np.packbits(bits, axis=1))
    if not points:
        return np.zeros((0, 2)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(points), np.concatenate(strings)


def nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each string of a the first of the nearest strings of b."""
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    step, best = max(1, HELD // len(b)), []
    for begin in range(0, len(a), step):
        part = a[begin : begin + step]
        best.append(sum(np.bitwise_count(part[:, None, k] ^ b[None, :, k]).astype(np.uint16) for k in range(b.shape[1])).argmin(1))
    return np.concatenate(best)


def places(fits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of ``fits`` in how many cells of the image the points are that it marks."""
    cell = np.unique(np.floor(np.stack((at.real, at.imag), 1) / PLACE), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    return np.logical_or.reduceat(fits[:, order], starts, axis=1).sum(1)


def same_scene(pa_: np.ndarray, sa: np.ndarray, pb: np.ndarray, sb: np.ndarray, enough: int = 0) -> int:
    """Most matches that one similarity transform explains; each corner matches its nearest string, if that is near.

    A place of either image counts once, on however many levels it matches. With ``enough`` the search ends at
    the first transform that explains so many, and fewer count as none.
    """
    if not len(pa_) or not len(pb):
        return 0
    best, back = nearest(sa, sb), nearest(sb, sa)
    ok = (np.bitwise_count(sa ^ sb[best]).sum(1, dtype=np.int64) <= NEAR_BITS) & (back[best] == np.arange(len(sa)))
    a, b = pa_[ok] @ np.array([1, 1j]), pb[best[ok]] @ np.array([1, 1j])
    return explained(a, b, enough)


def explained(a: np.ndarray, b: np.ndarray, enough: int = 0) -> int:
    """``same_scene`` of matches between the points ``a`` and ``b``, given as complex numbers."""
    if len(a) < max(2, enough):
        return 0
    most, begin, step, held = 0, 0, max(1, HELD // 8 // len(a) ** 2), max(1, HELD // 8 // len(a))
    while begin < len(a) - 1:  # every two matches far enough apart propose a transform; of copies, one of the first will do
        rows = np.arange(begin, min(begin + (min(step, 1 + begin) if enough else step), len(a) - 1))
        begin += len(rows)
        i, j = np.nonzero((np.arange(len(a)) > rows[:, None]) & (np.abs(a[rows, None] - a) >= 6))
        i = rows[i]
        turn = (b[i] - b[j]) / (a[i] - a[j])
        scale = np.abs(turn)
        fair = (scale > 0.4) & (scale < 2.5)
        turn, shift, slack = turn[fair], b[i[fair]] - turn[fair] * a[i[fair]], TOLERANCE * np.minimum(1, scale[fair])
        for at in range(0, len(turn), held):
            t = turn[at : at + held, None]
            fits = np.abs(t * a + shift[at : at + held, None] - b) <= slack[at : at + held, None]
            fits = fits[fits.sum(1) >= max(most + 1, enough)]
            if len(fits):
                most = max(most, int(np.minimum(places(fits, a), places(fits, b)).max()))
            if enough and most >= enough:
                return most
    return most


def pack(points: np.ndarray, strings: np.ndarray) -> bytes:
    return np.concatenate((points.astype("<f4").view(np.uint8).reshape(len(points), 8), strings), axis=1).tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.uint8).reshape(-1, 8 + BITS // 8)
    return np.ascontiguousarray(x[:, :8]).view("<f4").astype(float), np.ascontiguousarray(x[:, 8:])


def axes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and main axes of the bits of some packed strings, as 1 and -1."""
    bits = np.unpackbits(strings[: BLOCK // 4], axis=1).astype(np.float32) * 2 - 1
    mean = bits.mean(0)
    return mean, np.ascontiguousarray(np.linalg.eigh((bits - mean).T @ (bits - mean))[1][:, ::-1][:, :AXES])


def _shadows(strings: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two forms of all strings: a product of one of each is -1/2 of the squared distance of their shadows on the axes."""
    at = (np.unpackbits(strings, axis=1).astype(np.float32) * 2 - 1 - mean) @ turn
    half, one = -0.5 * (at * at).sum(1, keepdims=True), np.ones((len(at), 1), np.float32)
    return np.concatenate((at, half, one), 1), np.concatenate((at, one, half), 1)


def _close(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places p of ``a`` and q of ``b`` whose strings, in words of 64 bits, differ in NEAR_BITS or fewer, and in how many, part by part.

    A shadow is never longer than what casts it, so products of ``x`` and ``y`` pass all of these; they are then counted.
    """
    rows = max(1, min(len(a), HELD, TILE))
    width = max(1, min(HELD, TILE) // rows)
    for at in range(0, len(a), rows):
        for begin in range(0, len(b), width):
            near = x[at : at + rows] @ y[begin : begin + width].T >= -2 * NEAR_BITS - 0.25
            p, q = np.divmod(np.flatnonzero(near), near.shape[1])
            p, q = p + at, q + begin
            bits = np.bitwise_count(a.take(p, 0) ^ b.take(q, 0)).view(np.uint16)  # of four words: added in pairs, as numpy sums short rows slowly
            bits = ((bits & 255) + (bits >> 8)).view(np.uint32).ravel()
            bits = (bits & 65535) + (bits >> 16)
            kept = np.flatnonzero(bits <= NEAR_BITS)
            if len(kept):
                yield p[kept], q[kept], bits[kept].astype(np.int64)


def _least(group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every group once, in order, with its least rank."""
    order = np.lexsort((rank, group))
    order = order[np.diff(group[order], prepend=-1) > 0]
    return group[order], rank[order]


def matched(left: list, right: list, same: bool = False, main: tuple | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, p, q) for all images with at least LEAST_MATCHES strings p of left[i] and q of right[j] within NEAR_BITS, each the
    first of the other's nearest, in order of p: no others can be copies. With ``same`` the lists are one, and i < j. Any
    axes ``main`` give the same; those of like strings leave least to count."""
    a, b = (np.concatenate([s for _, s in side]) for side in (left, right))
    main = main or axes(a)
    x, y = _shadows(a, *main)[0], _shadows(b, *main)[1]
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    a_starts, b_starts = (np.cumsum([0, *(len(s) for _, s in side)]) for side in (left, right))
    of_b = np.repeat(np.arange(len(right)), np.diff(b_starts))
    for i in range(len(left)):
        begin = b_starts[i + 1] if same else 0
        mine = slice(a_starts[i], a_starts[i + 1])
        # The least of (bits, place) is the first of the nearest: for a string of the right, and for one of the left in an image of the right.
        for_q, found = np.full(len(b) - begin, 1 << 62), []
        for p, q, bits in _close(a[mine], b[begin:], x[mine], y[begin:]):
            np.minimum.at(for_q, q, bits << 40 | p)
            part = p * len(right) + of_b[begin:][q], bits << 40 | q
            found.append(part if len(p) < TILE // 64 else _least(*part))
        if not found:
            continue
        group, rank = _least(*(np.concatenate(v) for v in zip(*found, strict=True)))
        (p, image), q = np.divmod(group, len(right)), rank & ((1 << 40) - 1)
        mutual = for_q[q] == (rank - q | p)
        p, q, image = p[mutual], q[mutual] + begin, image[mutual]
        order = np.argsort(image, kind="stable")
        p, q = p[order], q[order]
        ends = np.cumsum([0, *np.bincount(image, minlength=len(right))])
        for j in np.flatnonzero(np.diff(ends) >= LEAST_MATCHES).tolist():
            yield i, j, p[ends[j] : ends[j + 1]], q[ends[j] : ends[j + 1]] - b_starts[j]


def fitting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` and ``b``, the matches of one pair of images each, of which some transform explains LEAST_MATCHES, places aside."""
    n, good = a.shape[1], []
    i, j = np.triu_indices(n, 1)
    step = max(1, HELD // 8 // (len(i) * n))
    for begin in range(0, len(a), step):
        x, y = a[begin : begin + step], b[begin : begin + step]
        apart = x[:, i] - x[:, j]
        row, k = np.nonzero(np.abs(apart) >= 6)
        turn = (y[row, i[k]] - y[row, j[k]]) / apart[row, k]
        scale = np.abs(turn)
        fair = (scale > 0.4) & (scale < 2.5)
        row, k, turn, slack = row[fair], k[fair], turn[fair], TOLERANCE * np.minimum(1, scale[fair])
        shift = y[row, i[k]] - turn * x[row, i[k]]
        fits = np.abs(turn[:, None] * x[row] + shift[:, None] - y[row]) <= slack[:, None]
        good.append(begin + np.unique(row[fits.sum(1) >= LEAST_MATCHES]))
    return np.concatenate(good)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    main = None
    for batch in batches:
        for one, two, same in zip(batch.column("_x"), batch.column("_y"), batch.column("_same").to_pylist(), strict=True):
            left, out = one.as_py(), ([], [])
            right = left if same else two.as_py()
            sets = [[unpack(x["d"]) for x in side] for side in (left, right)]
            main = main or axes(np.concatenate([strings for _, strings in sets[0]]))
            points = [[at @ np.array([1, 1j]) for at, _ in side] for side in sets]
            waiting: dict[int, list] = {}
            held = 0

            def settled(waiting=waiting, out=out) -> None:
                for pairs in waiting.values():
                    for k in fitting(np.stack([x[2] for x in pairs]), np.stack([x[3] for x in pairs])).tolist():
                        if explained(*pairs[k][2:], LEAST_MATCHES) >= LEAST_MATCHES:
                            out[0].append(pairs[k][0])
                            out[1].append(pairs[k][1])
                waiting.clear()

            for i, j, p, q in matched(*sets, same, main):
                a, b, x, y = left[i]["node"], right[j]["node"], points[0][i][p], points[1][j][q]
                if a > b:
                    order = np.argsort(q)
                    a, b, x, y = b, a, y[order], x[order]
                if a == b:
                    continue
                if len(x) <= FEW:
                    waiting.setdefault(len(x), []).append((a, b, x, y))
                    held += len(x)
                    if held > HELD // 64:
                        settled()
                        held = 0
                elif explained(x, y, LEAST_MATCHES) >= LEAST_MATCHES:
                    out[0].append(a)
                    out[1].append(b)
            settled()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describes distinct images and puts those of a task together, some BLOCK strings a row: ``_x``, what is compared, and ``named``, whose they are."""
    x, named, size = [], [], 0
    types = [pa.list_(pa.struct([("node", pa.int64()), ("d", pa.binary())])), pa.list_(pa.struct([("sha", pa.string()), ("node", pa.int64()), ("n", pa.int64())]))]

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((x, named), types, strict=True)], ["_x", "named"])

    for batch in batches:
        for sha, node, raw, h, w in zip(*(batch.column(c) for c in ("sha", "node", "pixels", "height", "width")), strict=True):
            points, strings = describe(np.frombuffer(raw.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py()))
            named.append({"sha": sha.as_py(), "node": node.as_py(), "n": len(points)})
            if len(points):
                x.append({"node": node.as_py(), "d": pack(points, strings)})
            size += len(points) + 1
            if size >= BLOCK:
                yield block()
                x, named, size = [], [], 0
    if named:
        yield block()


def links_of(blocks: DataFrame) -> DataFrame:
    """a < b for every pair of nodes in ``blocks`` (block, _x: node and d) that ``same_scene`` takes for copies."""
    blocks = blocks.filter(F.size("_x") > 0).select("block", "_x")
    right = blocks.select(F.col("block").alias("_b"), F.col("_x").alias("_y")).hint("shuffle_replicate_nl")
    # Of the two orders of two blocks a hash picks one, so that tasks on either side of the diagonal get as many.
    pair = F.pmod(F.xxhash64(F.least("block", "_b"), F.greatest("block", "_b")), F.lit(2)) == 0
    both = blocks.join(right, (F.col("block") == F.col("_b")) | ((F.col("block") < F.col("_b")) == pair)).select("_x", "_y", (F.col("block") == F.col("_b")).alias("_same"))
    return cut(both.mapInArrow(_linked, "a bigint, b bigint"))


def image_copies(images: DataFrame) -> DataFrame:
    """image_id, n_corners, copy_of (the smallest id its links reach, itself included) and kept, for every row.

    ``images``: image_id, pixels (8-bit grey rows), height, width; other columns are dropped. Null or ill-sized pixels have no
    corners and no links; so have flat images, unless pixel for pixel equal. Rows without an image_id
    count as one that comes after all others. The table is read twice and must be the same both times; of equal
    images one is described.
    """
    settle(images.sparkSession)
    good = F.col("height").cast("bigint") * F.col("width") == F.length("pixels")
    sha = F.when(good & (F.col("height") > 0) & (F.col("width") > 0), F.sha2(F.concat(F.format_string("%d,%d,", "height", "width").cast("binary"), "pixels"), 256))
    images = images.select("image_id", F.coalesce("image_id", F.lit(2**63 - 1)).alias("node"), sha.alias("sha"), "pixels", "height", "width")
    rows = cut(images.select("image_id", "node", "sha"))
    nodes = images.filter("sha IS NOT NULL").groupBy("sha").agg(F.min("node").alias("node"), *(F.first(c).alias(c) for c in ("pixels", "height", "width")))
    blocks = nodes.mapInArrow(_blocks, "_x array<struct<node:bigint,d:binary>>, named array<struct<sha:string,node:bigint,n:bigint>>")
    blocks = cut(blocks.select(F.monotonically_increasing_id().alias("block"), "_x", "named"))
    labels = components(links_of(blocks))
    nodes = blocks.select(F.explode("named").alias("x")).select("x.sha", F.col("x.node").alias("_r"), "x.n")
    named = nodes.join(labels, F.col("_r") == F.col("node"), "left").select("sha", "n", F.coalesce("comp", "_r").alias("comp"))
    comp = F.coalesce("comp", "node")
    first = F.when(comp < 2**63 - 1, comp)
    return rows.join(named, "sha", "left").select("image_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_corners"), first.alias("copy_of"), F.coalesce(first == F.col("image_id"), F.lit(True)).alias("kept"))


def drawn(vector: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey image of texture and rectangles whose places, sizes and tones come from a vector: a fixture, as no table holds images."""
    seed = int.from_bytes(hashlib.sha256(np.ascontiguousarray(vector, "<f4").tobytes()).digest()[:8], "little")
    rng = np.random.default_rng(seed)
    image = 128 + resized(rng.normal(0, 40, (side // 3, side // 3)), side, side)
    for x, y, w, h, tone in zip(rng.integers(0, side, 26), rng.integers(0, side, 26), rng.integers(5, 22, 26), rng.integers(5, 22, 26), rng.integers(-90, 90, 26), strict=True):
        image[y : y + h, x : x + w] += tone
    return np.clip(image, 0, 255).astype(np.uint8)


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """0: as it is; 1: cropped at two sides; 2: brighter and flatter; 3: a quarter turn; 4: a box pasted on."""
    side = image.shape[0]
    if kind == 1:
        return np.ascontiguousarray(image[side // 8 :, : side - side // 10])
    if kind == 2:
        return np.clip(image * 0.8 + 30, 0, 255).astype(np.uint8)
    if kind == 3:
        return np.ascontiguousarray(np.rot90(image))
    if kind == 4:
        image = image.copy()
        image[: side // 5, : side // 4] = 255
    return image


def images_of(embeddings: DataFrame) -> DataFrame:
    """Every vector twice as an image: as drawn (id 2 * vec_id), and one edit of it (id 2 * vec_id + 1), chosen by vec_id mod 5."""

    def draw(ids: pa.Array, vectors: pa.Array) -> pa.Array:
        out = []
        for i, v in zip(ids.to_pylist(), vectors.to_pylist(), strict=True):
            plain = drawn(np.array(v or [], np.float32))
            other = edited(plain, (i or 0) % 5)
            out.append([{"edit": 0, "pixels": plain.tobytes(), "height": plain.shape[0], "width": plain.shape[1]}, {"edit": 1, "pixels": other.tobytes(), "height": other.shape[0], "width": other.shape[1]}])
        return pa.array(out, pa.list_(pa.struct([("edit", pa.int32()), ("pixels", pa.binary()), ("height", pa.int32()), ("width", pa.int32())])))

    made = F.arrow_udf(draw, "array<struct<edit:int,pixels:binary,height:int,width:int>>")
    return embeddings.select("vec_id", F.explode(made("vec_id", "embedding")).alias("i")).select((2 * F.col("vec_id") + F.col("i.edit")).alias("image_id"), "i.pixels", "i.height", "i.width")


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image made from ``embeddings``: its corners and the first copy of it.

    Only vec_id and the vector are read; a row without a usable vector makes no image. An empty table gives an empty one.
    """
    settle(spark)
    return image_copies(images_of(load(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
