"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

The model is fitted on a bounded sample of labelled rows, whose subword counts (not texts) reach the
driver; it then predicts every whole text. Temperature scaling on a part of the sample that training
doesn't see calibrates the score, and the least score that part of the sample supports is the bar
under which a prediction counts as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import load, nested, settle, unnested
from sextant.llm.subwords import subword_counts

BUCKETS, DIM = 4096, 16
#: The bound of the labelled sample: distinct rows per language, those with the smallest hashes, and rows of all
#: languages together, of which each gets an equal share but one row at least. Every language is learned.
SAMPLE_ROWS, ALL_ROWS = 600, 60_000
UNKNOWN = "und"
#: Share of right predictions that the bar lets pass at least, and how far below their scores it stays.
LEAST_KEPT, SLACK = 0.995, 0.02


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # embeddings times output weights: buckets x labels
    bias: np.ndarray
    temperature: float
    bar: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


Sparse = list[tuple[np.ndarray, np.ndarray]]


def _shares(rows: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, buckets and shares of sparse rows of counts laid end to end."""
    n = [len(at) for at, _ in rows]
    share = [c / max(1, c.sum()) for _, c in rows]
    return np.concatenate(([0], np.cumsum(n))).astype(np.int64), np.concatenate([at for at, _ in rows]), np.concatenate(share)


def train(rows: Sparse, labels: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """SGD over mini-batches of sparse rows (buckets, counts) in given order; a batch alone is dense. A fifth of the
    rows calibrates. No rows: a model without labels."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng, y = np.random.default_rng(seed), np.searchsorted(names, labels)
    starts, at, share = _shares(rows)
    norm = np.sqrt(np.add.reduceat(np.append(share**2, 0.0), starts[:-1])) if len(at) else np.ones(len(y))
    scale = float(norm.mean()) or 1.0

    def dense(b: np.ndarray) -> np.ndarray:
        n = starts[b + 1] - starts[b]
        k = np.repeat(starts[b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        x = np.zeros((len(b), BUCKETS))
        x[np.repeat(np.arange(len(b)), n), at[k]] = share[k]
        return x

    held = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~held)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, len(names))), np.zeros(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for b in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            x = dense(b) / scale
            hidden = x @ emb
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p /= len(b)
            grad = p @ out.T
            out -= step * hidden.T @ p
            bias -= step * p.sum(0)
            seen = np.flatnonzero(x.any(0))
            emb[seen] -= step * x[:, seen].T @ grad
    emb[np.setdiff1d(np.arange(BUCKETS), at)] = 0.0  # what training never saw is no evidence, so strange texts score low
    table = emb @ out / scale
    check = np.flatnonzero(held) if held.any() else fit
    z = np.concatenate([dense(b) @ table for b in np.array_split(check, len(check) // 512 + 1)]) + bias

    def soft(t: float) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.1, 10, 41), key=lambda t: -np.log(np.maximum(soft(t)[np.arange(len(check)), y[check]], 1e-12)).mean())
    p = soft(temperature)
    right, score = p.argmax(1) == y[check], p.max(1)
    # The bar keeps LEAST_KEPT of the right ones and, where wrong ones pass, rises until 99% of what passes is right.
    order = np.argsort(-score, kind="stable")
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99
    bar = float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    if right.any():
        bar = max(bar, float(np.quantile(score[right], 1 - LEAST_KEPT)) - SLACK)
    return LanguageModel(names, table, bias, float(temperature), min(bar, 0.9))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Sparse, list[str]]:
    """Subword counts and languages of at most ``rows`` distinct rows a language: those with the smallest hashes of doc_id and text.

    Rows whose crc32(doc_id) mod 5 is 0 or whose doc_id, lang or text is null are never among them. Rows that
    share doc_id, lang and text count once, before anything reaches the driver. A first pass counts distinct
    rows per language; the hash that lets about 2 * ``rows`` of them through picks the rows, of which the
    smallest hashes per language stay.
    """
    row = F.xxhash64("doc_id", "text")
    learn = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", row.alias("h"), "text")
    few = learn.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    rows = max(1, min(rows, ALL_ROWS // max(1, len(few))))
    chosen = docs.sparkSession.createDataFrame([(r["lang"], float(min(1.0, (2.0 * rows + 50) / max(1, r["n"])))) for r in few], "_lang string, _share double")
    spread = F.xxhash64("h", F.lit(3)) / F.lit(2.0**64) + 0.5
    picked = learn.join(F.broadcast(chosen), F.col("lang") == F.col("_lang")).filter(spread <= F.col("_share"))  # one row a language
    last = Window.partitionBy("lang").orderBy("h", "doc_id")
    kept = picked.groupBy("lang", "doc_id", "h").agg(F.first("text").alias("text")).withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= rows)

    def sparse(texts: pa.Array) -> pa.Array:
        out = [subword_counts(t, BUCKETS) for t in texts.to_pylist()]
        return pa.array([np.concatenate((i := np.flatnonzero(c), c[i])).astype(np.int32).tobytes() for c in out], pa.binary())

    got = kept.select("doc_id", "lang", "h", F.arrow_udf(sparse, "binary")("text").alias("c")).collect()
    got = sorted(got, key=lambda r: (r["lang"], r["h"], r["doc_id"]))
    counts = [tuple(np.frombuffer(r["c"], np.int32).reshape(2, -1).astype(np.int64)) for r in got]
    return counts, [r["lang"] for r in got]


def held_out():
    """True where crc32(doc_id as text) mod 5 is 0, and for a null doc_id, which is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_of(spark: SparkSession, text, model: LanguageModel):
    """A struct of lang, score and rejected for a text, from the text alone.

    A null text, one without a letter, and any text where nothing was learned get ``und``, score 0, rejected.
    Ties go to the first language in code-point order.
    """
    settle(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x labels numbers, whatever the rows

    def predict(texts: pa.Array) -> pa.Array:
        m, label, score = shared.value, [], []
        for t in texts.to_pylist():
            if t is None or not m.labels:
                label.append(UNKNOWN)
                score.append(0.0)
                continue
            p = m.probabilities(subword_counts(t, BUCKETS))
            k = int(p.argmax())
            label.append(m.labels[k])
            score.append(float(min(1.0, p[k])))
        return pa.StructArray.from_arrays([pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array([x < m.bar or g == UNKNOWN for x, g in zip(score, label, strict=True)], pa.bool_())], ["lang", "score", "rejected"])

    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.arrow_udf(predict, "struct<lang:string,score:double,rejected:boolean>")(F.when(lettered, text))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of ``docs``, then lang_pred, score and rejected in place of any of these names; see ``language_of``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    out = docs.select(nested(docs).alias("row"), language_of(docs.sparkSession, docs["text"], model).alias("p"))
    return out.select(*unnested(kept), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: held_out, lang_pred and score of its whole text, and whether the score is rejected.

    Null texts and texts without a letter are ``und``, as is everything if no row teaches. Null languages and doc_ids
    teach nothing; a row without a doc_id is predicted like any other. Repeated rows teach once and are predicted alike; ties go to the
    language that is first by code points. An empty table gives an empty one. Only doc_id, text and lang are read.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(*labelled_sample(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
