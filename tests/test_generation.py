"""Beam search, subword inputs and isolated failures against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sextant.functions import subword
from sextant.operators import answer, beam
from sextant.sources import versions

VOCAB, END = 6, 0


def model():
    """A table-driven toy: log-probabilities of all tokens after the last two. Nested, so that workers get it by value."""

    def toy(prompt, tokens, size=VOCAB):
        rng = random.Random(f"{prompt}|{tokens[-2:]}")
        w = [rng.random() ** 3 + 0.01 for _ in range(size)]
        return [(t, math.log(x / sum(w))) for t, x in enumerate(w)]

    def step(prompts, tokens):
        return [toy(p, t) for p, t in zip(prompts, tokens, strict=True)]

    return toy, step


def plain(prompt, beams, most, n, forced=None):
    live, done, toy = [([], 0.0)], [], model()[0]
    for length in range(1, most + 1):
        cand = []
        for b, (tokens, s) in enumerate(live):
            for t, lp in toy(prompt, tokens):
                grams = {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()
                if n and tuple([*tokens, t][-n:]) in grams and len(tokens) >= n - 1 or length == 1 and forced is not None and t != forced:
                    continue
                cand.append((-(s + lp), b, t, tokens))
        first = sorted(cand)[: 2 * beams]
        done += [(-c / length, tokens) for r, (c, _, t, tokens) in enumerate(first) if t == END and r < beams]
        live = [([*tokens, t], -c) for c, _, t, tokens in first if t != END][:beams]
        if length == most:
            done += [(s / length, tokens) for tokens, s in live]
        elif len(done) >= beams or not live:
            break
    return max(done, key=lambda x: (x[0], [-t for t in x[1]]), default=None)


@pytest.mark.parametrize(("beams", "most", "n", "forced"), [(4, 7, 3, None), (2, 5, 2, 3), (1, 4, 0, None)])
def test_beam_search_equals_plain_code(spark, beams, most, n, forced):
    rows = [(q, r, f"prompt {q} {r}" if q else None) for q in range(5) for r in range(2)]
    got = beam.beam_search(spark.createDataFrame(rows, "qid int, rank int, prompt string"), ["qid", "rank"], "prompt", model()[1], END, beams, most, n, forced).collect()
    want = {(q, r): plain(p or "", beams, most, n, forced) for q, r, p in rows}
    assert len(got) == len([w for w in want.values() if w])
    for g in got:
        score, tokens = want[g["qid"], g["rank"]]
        assert abs(g["sequence_score"] - score) < 1e-9 and g["tokens"] == tokens


def test_no_trigram_repeats(spark):
    t = spark.createDataFrame([([1, 2, 3, 1, 2], 3), ([1, 2, 3, 1, 2], 1), ([1, 1], 1), ([1, 1, 1], 1), ([], 1)], "tokens array<int>, t int")
    assert [r[0] for r in t.select(beam.repeats(F.col("tokens"), F.col("t"), 3)).collect()] == [True, False, False, True, False]


PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "##a", "the", "cafe", "!", "##s", "a"]


def test_subwords_by_hand(spark, tmp_path):
    (tmp_path / "v.txt").write_text("\n".join(PIECES) + "\n")
    v = subword.vocabulary(spark, str(tmp_path / "v.txt"))
    assert v.ids["[SEP]"] == 3 and len(v.ids) == len(PIECES)
    t = spark.createDataFrame([("The unaffable!", "cafés"), ("x the", None), ("", "the the the the the the"), ("a" * 101, "unaff")], "a string, b string")
    rows = t.select(subword.subwords(F.col("a"), v).alias("a"), subword.subwords(F.col("b"), v).alias("b"))
    assert [tuple(r) for r in rows.collect()] == [([8, 4, 5, 6, 10], [9, 11]), ([1, 8], []), ([], [8] * 6), ([1], [4, 5])]
    out = [r[0] for r in rows.select(subword.model_inputs(F.col("a"), v, F.col("b"), 9)).collect()]
    assert out[0]["input_ids"] == [2, 8, 4, 5, 6, 3, 9, 11, 3] and out[0]["token_type_ids"] == [0] * 6 + [1] * 3
    assert out[1]["input_ids"] == [2, 1, 8, 3, 3, 0, 0, 0, 0] and out[1]["attention_mask"] == [1] * 5 + [0] * 4 and out[1]["token_type_ids"] == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert out[2]["input_ids"] == [2, 3, 8, 8, 8, 8, 8, 8, 3]
    single = [r[0] for r in rows.select(subword.model_inputs(F.col("a"), v, max_length=5)).collect()]
    assert single[0]["input_ids"] == [2, 8, 4, 5, 3] and single[3]["attention_mask"] == [1, 1, 1, 0, 0]
    with pytest.raises(ValueError):
        subword.Vocabulary({"a": 0})


def test_one_failing_prompt_loses_one_row(spark, tmp_path):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot answer")
        return [(t.upper(), 0.5) for t in texts]

    t = spark.createDataFrame([(i, "bad" if i == 7 else f"q{i}") for i in range(20)] + [(20, None)], "qid int, prompt string").coalesce(2)
    counts = answer.accepted_and_rejected(answer.generate_isolated(t, "prompt", model), str(tmp_path))
    assert counts == {"n_rows": 21, "n_failed": 1, "n_done": 20}
    seen = versions.opened(spark, str(tmp_path))
    assert {r["qid"]: r["answer"] for r in seen["accepted"].collect()} == {i: f"Q{i}" for i in range(20) if i != 7} | {20: ""}
    assert [(r["qid"], r["error"]) for r in seen["rejected"].collect()] == [(7, "RuntimeError: cannot answer")]
    assert versions.latest(spark, str(tmp_path)).content["counts"]["n_failed"] == 1
    short = answer.generate_isolated(t, "prompt", lambda x: [("a", 1.0)])  # always one result: batches fail, rows don't
    assert short.filter("error IS NOT NULL").count() == 0
