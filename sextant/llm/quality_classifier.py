"""Quality classifier by co-training.

Two views of a document: its text (hashed words and character-shape trigrams) and its page metadata
(source, language and the length its table states), which says nothing that the text view reads. A
logistic model per view is fitted on the labelled sample; in each round either view scores all other
documents on the executors, and those that it is surest of, for and against, go to the other one as
pseudo-labels; a view that they would make worse on labelled rows kept apart leaves them. A logistic
combination, fitted on the rows kept apart, calibrates both views into one probability. One head learns
``quality``, another ``toxic``; a row with one label trains one.

Only the labelled sample and the pseudo-labels reach the driver, both bounded by documented parameters;
features are taken once from every whole text and written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, let_go, load, nested, settle, unnested
from sextant.llm.near_dedup import _words
from sextant.llm.subwords import subword_counts

WORD_BUCKETS, SHAPE_BUCKETS, META_BUCKETS = 1 << 18, 1 << 12, 1 << 12
#: Bounds: labelled rows a head, by smallest hash; pseudo-labels that a view gives in one round; rounds.
LABELLED, PSEUDO, ROUNDS = 4800, 80, 3
#: Share of a view's labelled rows at either end of its scores beyond which it is sure.
SURE = 0.05
TASKS = ("quality", "toxic")
VIEWS = ("text", "meta")
_SIZES = (WORD_BUCKETS + SHAPE_BUCKETS, META_BUCKETS)
_SHAPE = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})
#: A view of a row: bucket numbers as unsigned 32-bit integers, then as many 32-bit floats.
_FEATURES = "struct<text:binary,meta:binary>"

Rows = list[tuple[np.ndarray, np.ndarray]]


def text_view(texts: list[str | None]) -> Rows:
    """Sparse features of whole texts: presence of word buckets, weighed shares of shape trigrams."""
    out = []
    for t, words in zip(texts, _words(texts), strict=True):
        at = np.unique((words >> np.uint64(20)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        shape = subword_counts((t or "").translate(_SHAPE).replace("a" * 4, "a"), SHAPE_BUCKETS, (3,), 5, lower=False)
        hit = np.flatnonzero(shape)
        out.append((np.concatenate((at, hit + WORD_BUCKETS)), np.concatenate((np.ones(len(at)), np.log1p(100 * shape[hit] / max(1, shape.sum()))))))
    return out


def meta_view(sources: list, langs: list, lengths: list) -> Rows:
    """Sparse features of the metadata: source, language, both together, and the stated length in doublings."""
    out = []
    for s, g, n in zip(sources, langs, lengths, strict=True):
        names = [f"s:{s}", f"g:{g}", f"sg:{s}:{g}", f"n:{n if n is None else max(0, n).bit_length()}"]
        at = np.unique([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % META_BUCKETS for x in names]).astype(np.int64)
        out.append((at, np.ones(len(at))))
    return out


def _packed(rows: Rows) -> list[bytes]:
    return [i.astype("<u4").tobytes() + v.astype("<f4").tobytes() for i, v in rows]


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 8
    return np.frombuffer(raw, "<u4", n).astype(np.int64), np.frombuffer(raw, "<f4", n, 4 * n).astype(np.float64)


def features(docs: DataFrame) -> Column:
    """Both views of the rows of ``docs`` as packed features. Null texts count as empty; null sources, languages and
    lengths are values; a table without one of these columns counts as holding nulls."""
    settle(docs.sparkSession)

    def both(texts: pa.Array, sources: pa.Array, langs: pa.Array, lengths: pa.Array) -> pa.Array:
        views = text_view(texts.to_pylist()), meta_view(sources.to_pylist(), langs.to_pylist(), lengths.to_pylist())
        return pa.StructArray.from_arrays([pa.array(_packed(v), pa.binary()) for v in views], list(VIEWS))

    given = [docs[c].cast(t) if c in docs.columns else F.lit(None).cast(t) for c, t in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "bigint"))]
    return F.arrow_udf(both, _FEATURES)(*given)


def logits(rows: Rows, w: np.ndarray, bias: float) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    n = np.array([len(i) for i, _ in rows])
    value = w[np.concatenate([i for i, _ in rows])] * np.concatenate([v for _, v in rows])
    return np.bincount(np.repeat(np.arange(len(rows)), n), value, len(rows)) + bias


def logistic(rows: Rows, y: np.ndarray, size: int, least: float = 3.5, steps: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch AdaGrad on the features whose means differ between the classes by ``least`` standard errors.

    One class only, or no rows: the prior alone.
    """
    w, share = np.zeros(size), (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return w, bias
    at, v = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    n1, n0, up = y.sum(), len(y) - y.sum(), y[row] > 0.5
    mean1, mean0 = np.bincount(at[up], v[up], size) / n1, np.bincount(at[~up], v[~up], size) / n0
    mean, square = np.bincount(at, v, size) / len(y), np.bincount(at, v * v, size) / len(y)
    error = np.sqrt(np.maximum(square - mean * mean, 1e-12) * (1 / n1 + 1 / n0))
    known = np.abs(mean1 - mean0) > least * error
    keep = known[at]
    at, v, row = at[keep], v[keep], row[keep]
    total, total_bias = np.full(size, 1e-4), 1e-4
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v * w[at], len(rows)) + bias, -30, 30)))
        d = (p - y) / len(y)
        g, gb = np.bincount(at, v * d[row], size) + l2 * w, d.sum()
        total += g * g
        total_bias += gb * gb
        w -= 0.3 * g / np.sqrt(total)
        bias -= 0.3 * gb / np.sqrt(total_bias)
    return w, float(bias)


Model = tuple[np.ndarray, float]


@dataclass
class Head:
    text: Model
    meta: Model
    weights: tuple[float, float, float] = (1.0, 1.0, 0.0)  # of the text logit, the metadata logit, and the constant


@dataclass
class Trainer:
    """One head in training: rows and labels of either view, and the quarter of the labelled rows kept apart."""

    rows: list[Rows]
    labels: list[list[float]]
    apart: list[Rows]
    apart_labels: np.ndarray
    share: float
    known: int  # labelled rows at the head of ``rows``; pseudo-labels follow
    models: list[Model] = field(default_factory=list)

    @classmethod
    def of(cls, views: list[Rows], y: np.ndarray) -> Trainer:
        apart = np.arange(len(y)) % 4 == 3
        fit, held = np.flatnonzero(~apart), np.flatnonzero(apart)
        known = y[fit].astype(float).tolist()
        out = cls([[v[i] for i in fit] for v in views], [list(known), list(known)], [[v[i] for i in held] for v in views], y[held].astype(float), float(np.mean(known)) if known else 0.0, len(fit))
        out.fit()
        return out

    def fit(self) -> None:
        self.models = [logistic(self.rows[k], np.array(self.labels[k]), _SIZES[k]) for k in (0, 1)]

    def _apart_loss(self, k: int, model: Model) -> float:
        z = logits(self.apart[k], *model)
        return _loss(np.clip(z, -12, 12)[:, None], self.apart_labels, np.ones(1))

    def learn(self, k: int, rows: Rows, labels: list[float]) -> bool:
        """View k takes pseudo-labels of the other one, unless they raise its log loss on the rows kept apart."""
        if not rows:
            return False
        new = logistic(self.rows[k] + rows, np.array(self.labels[k] + labels), _SIZES[k])
        if self._apart_loss(k, new) > self._apart_loss(k, self.models[k]):
            return False
        self.rows[k], self.labels[k], self.models[k] = self.rows[k] + rows, self.labels[k] + labels, new
        return True

    def bars(self, k: int) -> tuple[float, float]:
        """The logits of view k that a share SURE of the labelled rows is at or below, and at or above."""
        z = np.concatenate((logits(self.rows[k][: self.known], *self.models[k]), logits(self.apart[k], *self.models[k])))
        return (float(np.quantile(z, SURE)), float(np.quantile(z, 1 - SURE))) if len(z) else (0.0, 0.0)

    def head(self) -> Head:
        z = np.stack([logits(self.apart[k], *self.models[k]) for k in (0, 1)], 1) if len(self.apart_labels) else np.zeros((0, 2))
        return Head(self.models[0], self.models[1], _combine(z, self.apart_labels))


_RIDGE = np.array([0.5, 0.5, 0.05])


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Log loss of a logistic combination, summed, without overflow."""
    z = x @ w
    return float((np.logaddexp(0, z) - y * z).sum())


def _combine(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A ridge-bound logistic combination of both logits, its weights not negative.

    Newton steps are halved until the penalised loss falls, as a full step overshoots where the logits are far
    out. Either view alone, with a constant, is fitted the same way; the best of the three on the log loss is taken, so the
    combination is no worse than the better view on the rows it is fitted on. One class only: both logits as they are.
    """
    if not 0 < y.sum() < len(y):
        return 1.0, 1.0, 0.0
    x = np.c_[np.clip(z, -12, 12), np.ones(len(z))]

    def fitted(use: list[int]) -> np.ndarray:
        start = np.array([1.0, 1.0, 0.0])[use]
        w, part, ridge = start.copy(), x[:, use], _RIDGE[use]
        cost = lambda v: _loss(part, y, v) + float((ridge * (v - start) ** 2).sum()) / 2
        now = cost(w)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve(part.T @ (part * (p * (1 - p))[:, None]) + np.diag(ridge), part.T @ (p - y) + ridge * (w - start))
            for _ in range(40):
                if (new := cost(w - step)) < now:
                    break
                step = step / 2
            else:
                break
            w, gain, now = w - step, now - new, new
            if gain < 1e-9 * (1 + now):
                break
        out = np.zeros(3)
        out[use] = w
        return out

    tried = [w for w in (fitted([0, 1, 2]), fitted([0, 2]), fitted([1, 2])) if (w[:2] >= 0).all()]
    best = min(tried, key=lambda w: _loss(x, y, w), default=np.array([0.0, 0.0, np.log(y.mean() / (1 - y.mean()))]))
    return tuple(float(a) for a in best)


def labelled(feats: DataFrame, labels: DataFrame) -> tuple[dict[str, list], set[tuple]]:
    """For each task (label, view, view) of at most LABELLED rows, those with the smallest hashes of doc_id and text; and
    the (doc_id, h) of all of them.

    Labels of one document are averaged; null labels and doc_ids don't count. Equal rows count once.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.avg(t).alias(t) for t in TASKS))
    rows = feats.filter("worded").select("doc_id", "h").distinct().join(known, "doc_id").withColumn("_o", F.xxhash64("doc_id", "h", F.lit(5)))
    out, ids = {}, {}
    for t in TASKS:
        got = rows.filter(F.col(t).isNotNull()).orderBy("_o", "doc_id", "h").limit(LABELLED).select("doc_id", "h", t).collect()
        out[t] = [((r["doc_id"], r["h"]), r[t]) for r in got]
        ids |= dict.fromkeys(k for k, _ in out[t])
    views = fetched(feats, list(ids))
    return {t: [(y >= 0.5, *views[k]) for k, y in each] for t, each in out.items()}, set(ids)


def fetched(feats: DataFrame, ids: list[tuple[int, int]]) -> dict[tuple, tuple]:
    """Both views of the given (doc_id, h), as many as there are ids."""
    if not ids:
        return {}
    wanted = feats.sparkSession.createDataFrame(ids, "doc_id bigint, h bigint")
    got = feats.join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("f").alias("f")).collect()
    return {(r["doc_id"], r["h"]): (_unpacked(r["f"]["text"]), _unpacked(r["f"]["meta"])) for r in got}


def _surest(feats: DataFrame, trainers: dict[str, Trainer], used: set[tuple]) -> list[tuple]:
    """(task, view, label, doc_id, h): for each the PSEUDO rows at most that the view is surest of, over all rows but the used ones.

    Every row is scored on the executors and each of the eight lists is a distributed top-k. A view is sure of a row beyond
    the scores that all but SURE of its labelled rows have: each view by its own scale, so the weaker one teaches as well.
    """
    spark = feats.sparkSession
    names = [(t, k) for t in TASKS for k in (0, 1)]
    shared = spark.sparkContext.broadcast([trainers[t].models[k] for t, k in names])  # dense weights of fixed size

    def score(text: pa.Array, meta: pa.Array) -> pa.Array:
        views = [[_unpacked(x.as_py()) for x in v] for v in (text, meta)]
        return pa.StructArray.from_arrays([pa.array(logits(views[k], *m), pa.float64()) for (_, k), m in zip(names, shared.value, strict=True)], [f"{t}_{k}" for t, k in names])

    kind = "struct<" + ",".join(f"{t}_{k}:double" for t, k in names) + ">"
    known = spark.createDataFrame(sorted(used), "doc_id bigint, h bigint")  # bounded: the sample and what was given so far
    free = feats.filter("worded").join(F.broadcast(known), ["doc_id", "h"], "left_anti")
    rows = cut(free.select("doc_id", "h", F.arrow_udf(score, kind)("f.text", "f.meta").alias("z")).select("doc_id", "h", "z.*").distinct())
    lists = []
    for t, k in names:
        up = min(PSEUDO - 1, max(1, round(PSEUDO * trainers[t].share)))
        low, high = trainers[t].bars(k)
        for label, z, bar, n in ((1, F.col(f"{t}_{k}"), high, up), (0, -F.col(f"{t}_{k}"), -low, PSEUDO - up)):
            best = rows.filter(z >= bar).orderBy(z.desc(), "doc_id", "h").limit(n)
            lists.append(best.select(F.lit(t).alias("task"), F.lit(k).alias("view"), F.lit(label).alias("label"), "doc_id", "h"))
    every = lists[0]
    for x in lists[1:]:
        every = every.union(x)
    got = [tuple(r) for r in every.collect()]
    let_go(rows)
    return got


def fit(feats: DataFrame, labels: DataFrame) -> dict[str, Head]:
    """Co-train both heads on the features of all documents: ``feats`` has doc_id, h, worded and f."""
    known, used = labelled(feats, labels)
    trainers = {t: Trainer.of([[r[1 + k] for r in rows] for k in (0, 1)], np.array([r[0] for r in rows], bool)) for t, rows in known.items()}
    for _ in range(ROUNDS if any(0 < x.share < 1 for x in trainers.values()) else 0):
        given = _surest(feats, trainers, used)
        views = fetched(feats, sorted({x[3:] for x in given}))
        learned = False
        for t, x in trainers.items():
            for k in (0, 1) if 0 < x.share < 1 else ():
                told = [(views[tuple(key)][k], float(label)) for task, giver, label, *key in given if (task, giver) == (t, 1 - k)]
                learned |= x.learn(k, [v for v, _ in told], [y for _, y in told])
        used |= {x[3:] for x in given}
        if not learned:
            break
    return {t: x.head() for t, x in trainers.items()}


_SCORES = "struct<" + ",".join(f"{t}_text:double,{t}_meta:double,{t}:double" for t in TASKS) + ">"


def scores(spark: SparkSession, heads: dict[str, Head], f: Column) -> Column:
    """For each head the probabilities of either view and of both together, from packed features."""
    shared = spark.sparkContext.broadcast(heads)  # two dense weight vectors a head, whatever the input

    def score(text: pa.Array, meta: pa.Array) -> pa.Array:
        views, columns = [[_unpacked(x.as_py()) for x in v] for v in (text, meta)], {}
        for task, head in shared.value.items():
            a, b = logits(views[0], *head.text), logits(views[1], *head.meta)
            z = head.weights[0] * np.clip(a, -12, 12) + head.weights[1] * np.clip(b, -12, 12) + head.weights[2]
            for name, x in ((f"{task}_text", a), (f"{task}_meta", b), (task, z)):
                columns[name] = pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))), pa.float64())
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return F.arrow_udf(score, _SCORES)(f["text"], f["meta"])


def featured(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, h (hash of the text), worded (it has a text and a doc_id) and f, written to the shared folder."""
    h = F.xxhash64("text")
    return cut(docs.select(row.alias("row"), "doc_id", h.alias("h"), (F.col("doc_id").isNotNull() & F.col("text").isNotNull()).alias("worded"), features(docs).alias("f")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever their names, then quality and toxic: co-trained probabilities of every document.

    A null text counts as empty; null sources and languages are values; rows without a doc_id are scored
    but never learned from. Equal scores rank by doc_id. With no labels every probability is one half.
    """
    kept = [c for c in docs.columns if c not in TASKS]
    feats = featured(docs, nested(docs))
    heads = fit(feats, labels)
    return feats.select("row", scores(docs.sparkSession, heads, F.col("f")).alias("s")).select(*unnested(kept), *(F.col(f"s.{t}").alias(t) for t in TASKS))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: probabilities of quality and of toxicity, by view and combined; kept if good and not toxic."""
    docs = load(spark, sf_dir, "documents")
    feats = featured(docs, F.struct("doc_id"))
    heads = fit(feats, load(spark, sf_dir, "labels"))
    out = feats.select("doc_id", scores(spark, heads, F.col("f")).alias("s"))
    return out.select("doc_id", F.col("s.quality_text").alias("text_score"), F.col("s.quality_meta").alias("meta_score"), F.col("s.quality").alias("quality"), F.col("s.toxic").alias("toxic"), ((F.col("s.quality") >= 0.5) & (F.col("s.toxic") < 0.5)).alias("kept"))
