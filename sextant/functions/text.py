"""String scalars: tokens, prefixes, prompts, snippets, padding, answer normalisation. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_GAP = r"[^\p{L}\p{N}]+"
SPACE = r"(?U)\s+"


def stripped(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nonblank(c: Column) -> Column:
    return F.coalesce(F.length(stripped(c)) > 0, F.lit(False))


def safe_id(c: Column) -> Column:
    """A whole number, or null."""
    return c.try_cast("bigint")


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TERM_GAP), lambda t: t != "")


def tokens(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda t: t != "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces; null reads as empty."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)\b(a|an|the)\b", " "), SPACE, " "))


def with_prefix(c: Column, kind: str, model_family: str | None = None, always: bool = False) -> Column:
    """``query: `` or ``passage: `` in front, always or for the family of models that wants it."""
    return F.concat(F.lit(f"{kind}: "), c) if always or "e5" in (model_family or "").lower() else c


def without_prefix(c: Column, *kinds: str) -> Column:
    """The prefixes gone wherever they stand."""
    for kind in kinds:
        c = F.replace(c, F.lit(f"{kind}: "), F.lit(""))
    return c


def retrieval_prompt(question: Column, title: Column, text: Column) -> Column:
    e = F.lit("")
    return F.concat(F.coalesce(question, e), F.lit(" [SEP_TITLE] "), F.coalesce(title, e), F.lit(" [SEP_TEXT] "), F.coalesce(text, e))


def gold_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("question: "), F.coalesce(question, F.lit("")), F.lit("  context: "), F.coalesce(context, F.lit("")))


def training_prompt(question: Column, context: Column) -> Column:
    return F.concat_ws(" ", without_prefix(question, "query"), without_prefix(context, "passage"))


def snippet(c: Column, n: int = 150, missing: str | None = None) -> Column:
    out = F.concat(F.substring(c, 1, n), F.lit("..."))
    return F.when(F.coalesce(c, F.lit("")) != "", out).otherwise(F.lit(missing)) if missing is not None else out


def first_answer(answers: Column) -> Column:
    return F.coalesce(F.get(answers, F.lit(0)), F.lit(""))


def any_answer_in(answers: Column, text: Column) -> Column:
    """Whether any non-null answer is in the text, case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.exists(answers, lambda a: F.contains(low, F.lower(a))), F.lit(False))


def padded(ids: Column, n: int, pad: Column) -> Column:
    """Cut or padded to n entries."""
    cut = F.slice(ids, 1, n)
    return F.concat(cut, F.array_repeat(pad, F.greatest(F.lit(0), F.lit(n) - F.size(cut))))


def masked_labels(ids: Column, pad: Column, ignore: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def attention_mask(ids: Column, pad: Column) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def term_key(id_: Column, most: int = 239) -> Column:
    """``chunk:`` and the id, or the SHA-256 of an id too long for a key."""
    return F.concat(F.lit("chunk:"), F.when(F.length(id_) > most, F.sha2(id_, 256)).otherwise(id_))


def context_text(ctx: Column) -> Column:
    """The ``text`` of a context, else its ``context``; empty counts as missing."""
    return F.coalesce(F.nullif(ctx["text"], F.lit("")), F.nullif(ctx["context"], F.lit("")), F.lit(""))


def joined_titles(ranked: Column) -> Column:
    """Non-empty titles of an array of (rank, title), in rank order, bars between."""
    titles = F.transform(F.array_sort(ranked), lambda s: s["title"])
    return F.array_join(F.filter(titles, lambda t: F.coalesce(t, F.lit("")) != ""), " | ")


def index_of(values: Column, value) -> Column:
    """Place of the first equal entry from 0, or null."""
    return F.nullif(F.array_position(values, value), F.lit(0)) - 1


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(tokens_: Column) -> Column:
    """Tokens in order with the number of each among its equals, so that equal multisets become equal sets.

    One pass over the sorted array: an entry's number is its place less that of the first of its equals.
    """
    return bound(
        F.array_sort(tokens_),
        lambda s: bound(
            F.map_from_arrays(F.array_distinct(s), F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull())),
            lambda first: F.transform(s, lambda t, i: F.concat((i - F.element_at(first, t)).cast("string"), F.lit(":"), t)),
        ),
    )


def counted(tokens_: Column) -> Column:
    """Array of (term, tf): the distinct entries in order and how often each occurs. One sort; no row meets another."""

    def runs(s: Column, first: Column) -> Column:
        return F.transform(first, lambda b, j: F.struct(F.get(s, b).alias("term"), (F.coalesce(F.get(first, j + 1), F.size(s)) - b).cast("bigint").alias("tf")))

    starts = lambda s: F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull())
    return bound(F.array_sort(tokens_), lambda s: bound(starts(s), lambda first: runs(s, first)))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens that two arrays share, each as often as in both."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def token_f1(prediction: Column, gold: Column, normalize: bool = True) -> Column:
    """F1 of the token multisets. Both empty: 1 if normalising, else 0; one empty: 0. Either text is normalised once."""

    def f1(x: Column) -> Column:
        p, g = x["p"], x["g"]
        total = F.size(p) + F.size(g)
        score = 2 * multiset_overlap(p, g).cast("double") / F.greatest(total, F.lit(1))
        return F.when(total == 0, F.lit(1.0 if normalize else 0.0)).otherwise(score)

    sides = [(tokens(normalize_answer(x)) if normalize else tokens(x)) for x in (prediction, gold)]
    return bound(F.struct(sides[0].alias("p"), sides[1].alias("g")), f1)


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def best_over(metric, prediction: Column, golds: Column, **options) -> Column:
    """The best of a metric over several golds; no golds: 0."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: metric(prediction, g, **options))), F.lit(0.0))
