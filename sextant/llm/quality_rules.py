"""Quality rules as weak supervision.

Every document gets plain text statistics; rules over them vote good (+1), bad (-1) or abstain (0).
Expectation-maximisation over the counts of the vote patterns estimates each rule's accuracy in
either class, and the posterior probability of the good class replaces a demand that all rules pass.

What reaches the driver is one count per vote pattern, at most 3 to the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, load, nested, settle, unnested

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters", "n_upper", "n_marks", "n_punct")
#: Prior accuracy of a rule's votes on good and on bad documents, prior share of good documents, and how
#: many pseudo-votes the priors count for, whatever the number of rows.
START, PRIOR, STRENGTH, N_RULES = (0.995, 0.25), 0.9, 50.0, 8
_SYMBOLS, _SPACE, _MARKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r", b"!?"
_UPPER = bytes(range(65, 91))
_NOT_LETTERS = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ENDS = (b".", b"!", b"?", b'"', b":", b";")


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more in the sequence."""
    n = len(ids) - 2
    if n < 2:
        return 0
    _, first = np.unique(ids, return_inverse=True)
    base = np.int64(first.max() + 1)
    pairs = np.unique(first[:-1] * base + first[1:], return_inverse=True)[1]
    windows = pairs[:-1] * base + first[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of STATS for one whole text; all zero for null."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids) if len(seen) < len(words) else 0,
        len(lines),
        sum(x.rstrip().endswith(_ENDS) for x in lines),
        len(raw.translate(None, _NOT_LETTERS)),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _MARKS)),
        len(raw) - len(raw.translate(None, _PUNCT)),
    )


def _stats(texts: pa.Array) -> pa.Array:
    rows = [text_stats(t.as_py()) for t in texts]
    columns = np.array(rows, np.int64).reshape(len(rows), len(STATS))
    return pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(len(STATS))], list(STATS))


def text_statistics(spark: SparkSession, text: Column) -> Column:
    """A struct of the statistics of a text; a null or empty text counts zero of everything."""
    settle(spark)
    return F.arrow_udf(_stats, "struct<" + ",".join(f"{x}:bigint" for x in STATS) + ">")(text)


def votes(s: Column) -> list[tuple[str, Column]]:
    """The rules, each a vote of +1, -1 or 0 from a struct of statistics."""

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def ratio(a: str, b: str) -> Column:
        return s[a] / F.greatest(s[b], F.lit(1))

    mean, symbols, repeated = ratio("word_chars", "n_words"), ratio("n_symbols", "n_words"), ratio("n_repeat_words", "n_words")
    doubled, ended, shouted, marks = ratio("n_dup_lines", "n_lines"), ratio("n_ended_lines", "n_lines"), ratio("n_upper", "n_letters"), ratio("n_marks", "n_words")
    punct = ratio("n_punct", "word_chars")
    return [
        ("symbols", rule(symbols < 0.02, symbols > 0.1)),
        ("repeats", rule(repeated < 0.1, repeated > 0.3)),
        ("lines", rule(s["n_dup_lines"] == 0, doubled > 0.4)),
        ("word_length", rule(mean.between(3, 9), (mean < 2.5) | (mean > 12))),
        ("shouting", rule(shouted < 0.15, shouted > 0.4)),
        ("marks", rule(marks < 0.05, marks > 0.3)),
        ("punctuation", rule(punct < 0.06, punct > 0.08)),
        ("endings", rule(ended > 0.7, ended < 0.1)),
    ]


@dataclass(frozen=True)
class LabelModel:
    """prior: probability of the good class; accuracy: for each rule, that of a vote given good and given bad."""

    prior: float
    accuracy: tuple[tuple[float, float], ...]

    def weight(self, rule: int, vote: int) -> float:
        good, bad = self.accuracy[rule]
        return float(np.log(good / (1 - bad)) if vote > 0 else np.log((1 - good) / bad))

    def posterior(self, cast: list[Column]) -> Column:
        logit = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for i, v in enumerate(cast):
            logit = logit + F.when(v > 0, self.weight(i, 1)).when(v < 0, self.weight(i, -1)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = STRENGTH) -> LabelModel:
    """EM over distinct vote patterns (rows of -1, 0, 1) with their counts.

    Beta priors of ``strength`` pseudo-votes say which class is which: a rule seldom speaks against a good
    document (accuracy START[0]) and any one rule sees only some kinds of bad ones (START[1]).
    Abstentions carry no evidence. With no rows the priors come back.
    """
    n_rules = patterns.shape[1] if patterns.size else N_RULES
    alpha = np.tile(np.array(START), (n_rules, 1))
    prior = PRIOR
    up, down, counts = (patterns > 0).astype(float), (patterns < 0).astype(float), counts.astype(float)
    for _ in range(rounds if patterns.size else 0):
        logit = np.log(prior / (1 - prior)) + up @ np.log(alpha[:, 0] / (1 - alpha[:, 1])) + down @ np.log((1 - alpha[:, 0]) / alpha[:, 1])
        q = counts / (1 + np.exp(-np.clip(logit, -500, 500)))
        r = counts - q
        new = np.stack([(q @ up + START[0] * strength) / (q @ (up + down) + strength), (r @ down + START[1] * strength) / (r @ (up + down) + strength)], 1)
        new, before = np.clip(new, 0.02, 0.9999), (alpha, prior)
        prior = float(np.clip((q.sum() + PRIOR * strength) / (counts.sum() + strength), 0.02, 0.98))
        alpha = new
        if np.abs(alpha - before[0]).max() < 1e-9 and abs(prior - before[1]) < 1e-9:
            break
    return LabelModel(prior, tuple((float(g), float(b)) for g, b in alpha))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def learn(stats: DataFrame, column: str = "stats") -> LabelModel:
    """Fit on the vote patterns of all rows that the base test leaves open; at most 3 to the number of rules of them reach the driver."""
    rules = votes(F.col(column))
    rows = stats.filter(~base_failed(F.col(column))).select(*(v.alias(n) for n, v in rules)).groupBy(*(n for n, _ in rules)).agg(F.count("*").alias("_rows")).collect()
    rows = sorted(tuple(r) for r in rows)
    return fit_label_model(np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows]))


def verdict(model: LabelModel, s: Column, least: float = 0.5) -> tuple[Column, Column]:
    """Posterior quality of a struct of statistics, and whether the document is kept."""
    posterior = model.posterior([v for _, v in votes(s)])
    return posterior, ~base_failed(s) & (posterior >= least)


def quality_rules(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``.

    Null and empty texts fail the base test. Repeated rows are judged alike and each stays or goes as it
    is; other columns, nulls among them, pass through, whatever their names. A posterior of exactly one
    half stays. An empty table gives an empty table. Statistics are taken once and written beside the rows.
    """
    rows = cut(docs.select(nested(docs).alias("row"), text_statistics(docs.sparkSession, docs["text"]).alias("stats")))
    return rows.filter(verdict(learn(rows), F.col("stats"))[1]).select(*unnested(docs.columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the statistics, the base test and the posterior verdict."""
    docs = load(spark, sf_dir, "documents")
    stats = cut(docs.select("doc_id", text_statistics(spark, docs["text"]).alias("stats")))
    s = F.col("stats")
    posterior, kept = verdict(learn(stats), s)
    return stats.select(
        "doc_id", s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
        base_failed(s).alias("base_failed"), kept.alias("kept"), posterior.alias("posterior"),
    )
