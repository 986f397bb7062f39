"""Rules that one vote can't decide, reruns of the mix, and texts above a megabyte in the operators that take whole texts."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sextant.llm import language_id, line_dedup, mixing, pieces, quality_classifier, quality_rules, subwords

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n=80, end="."):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) for _ in range(n)) + end


def test_one_wrong_rule_is_overruled(spark):
    good = [(i, prose(i), "en", "s", 1) for i in range(2000)]
    odd = [(5000 + i, prose(i + 9000, end=""), "en", "s", 1) for i in range(5)]  # no line ends as sentences do: one rule votes against
    bad = [(6000 + i, " ".join(w + "$$|" for w in prose(i + 5000).split()), "en", "s", 1) for i in range(400)]
    t = spark.createDataFrame(good + odd + bad, SCHEMA)
    stats = t.select("doc_id", quality_rules.text_statistics(spark, t["text"]).alias("s"))
    cast = {r["doc_id"]: list(r[1:]) for r in stats.select("doc_id", *(v for _, v in quality_rules.votes(F.col("s")))).collect()}
    assert all(sum(v < 0 for v in cast[x[0]]) == 1 for x in odd)
    kept = {r["doc_id"] for r in quality_rules.quality_rules(t).collect()}
    assert kept == {x[0] for x in good + odd}


def test_reruns_of_the_mix_agree(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", None]), 1) for i in range(400)]
    t = spark.createDataFrame([*rows, rows[0], rows[1]], SCHEMA)
    once = sorted(map(str, mixing.mixed(t).collect()))
    again = sorted(map(str, mixing.mixed(t.repartition(7, "text")).collect()))
    assert once == again and len(once) == 402


LONG = (prose(1, 150_000), "Same shared line of words\n" * 50_000, "x" * 1_500_000)


def test_texts_above_a_megabyte(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(LONG)] + [(10, "Same shared line of words\nand one more", "en", "s", 1)]
    t = spark.createDataFrame(rows, SCHEMA)
    stats = {r["doc_id"]: r["s"] for r in t.select("doc_id", quality_rules.text_statistics(spark, t["text"]).alias("s")).collect()}
    assert stats[0]["n_words"] == 150_000 and stats[1]["n_dup_lines"] == 49_999 and stats[1]["n_repeat_words"] == 250_000 and stats[2]["word_chars"] == 1_500_000
    taken = {r["doc_id"]: r for r in mixing.mixed(t).collect()}
    assert taken[0]["size"] == 150_000 and taken[1]["size"] == 250_000 and taken[2]["size"] == 1
    lines = {r["row"]["doc_id"]: r for r in line_dedup.with_lines_dropped(t).collect()}
    assert lines[10]["kept"] == "and one more" and lines[1]["n_dropped"] == 0 and lines[1]["n_lines"] == 50_001
    assert hashlib.sha256(lines[0]["kept"].encode()).digest() == hashlib.sha256(LONG[0].encode()).digest()
    scored = quality_classifier.classify(t, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert len(scored) == 4 and all(r["quality"] == 0.5 for r in scored)


def test_long_texts_in_subwords_and_pieces(spark):
    whole = subwords.subword_counts(LONG[0], 1 << 12)
    assert whole.sum() > 150_000 and np.count_nonzero(whole) > 100
    t = spark.createDataFrame([(0, LONG[2][:1_100_000], "en", "s", 1), (1, prose(4), "en", "s", 1)], SCHEMA)
    got = {r["doc_id"]: r for r in pieces.encode_documents(t).select("doc_id", "n_pieces").collect()}
    assert got[0]["n_pieces"] > 1000 and got[1]["n_pieces"] > 80
    model = language_id.train(*language_id.labelled_sample(t))
    assert language_id.identify(t.select("doc_id", "text"), model).count() == 2
