"""English stemming (the published Porter2 algorithm) as built-in expressions, one column a step.

The steps are SQL text that Spark and other engines read alike, so they stay in generated code and can be
checked elsewhere. Terms are lower-case runs of letters and digits; there are no apostrophes to strip.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exceptional forms and the suffix tables of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
#: Last letters of every ending that a step looks at: a term with any other stays as it is.
TOUCHED = "cdegilmnrsty"
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"


def _ends(x: str, suffix: str) -> str:
    return f"right({x}, {len(suffix)}) = '{suffix}'"


def _cut(x: str, n: int, add: str = "") -> str:
    left = f"left({x}, length({x}) - {n})"
    return f"concat({left}, '{add}')" if add else left


def _table(x: str, rules: dict[str, str], region: str, more: str = "") -> str:
    """The longest suffix decides: replaced if it lies in the region, else nothing happens."""
    cases = [(s, f"CASE WHEN length({x}) - {len(s)} >= {region} THEN {_cut(x, len(s), to)} ELSE {x} END") for s, to in rules.items()]
    chain = " ".join(f"WHEN {_ends(x, s)} THEN {then}" for s, then in sorted(cases, key=lambda c: -len(c[0])))
    return f"CASE {more} {chain} ELSE {x} END"


def _matches(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, '{pattern}', 0) <> ''"


#: A short syllable at the end: vowel, then one other than w, x, Y behind another, or a vowel and one other alone.
_SHORT = f"(^{VOWEL}{OTHER}$|{OTHER}{VOWEL}[^aeiouywxY]$)"


def steps(term: str) -> list[tuple[str, str]]:
    """(column, expression) in order; the last one, ``stem_9``, is the stem of the column ``term``."""
    out = [("stem_0", f"regexp_replace(regexp_replace({term}, '^y', 'Y'), '([aeiou])y', '$1Y')")]
    r1 = f"^{OTHER}*{VOWEL}+{OTHER}"
    special = " ".join(f"WHEN left(stem_0, {len(p)}) = '{p}' THEN {len(p)}" for p in PREFIXES)
    out.append(("stem_r1", f"CASE {special} WHEN {_matches('stem_0', r1)} THEN length(regexp_extract(stem_0, '{r1}', 0)) ELSE length(stem_0) END"))
    rest = "substring(stem_0, stem_r1 + 1)"
    out.append(("stem_r2", f"CASE WHEN {_matches(rest, r1)} THEN stem_r1 + length(regexp_extract({rest}, '{r1}', 0)) ELSE length(stem_0) END"))
    x = "stem_0"
    out.append(("stem_1", f"CASE WHEN {_ends(x, 'sses')} THEN {_cut(x, 2)} WHEN {_ends(x, 'ied')} OR {_ends(x, 'ies')} THEN CASE WHEN length({x}) > 4 THEN {_cut(x, 2)} ELSE {_cut(x, 1)} END WHEN {_ends(x, 'us')} OR {_ends(x, 'ss')} THEN {x} WHEN {_ends(x, 's')} AND {_matches(x, VOWEL + '.+s$')} THEN {_cut(x, 1)} ELSE {x} END"))
    x = "stem_1"
    inside = "CASE WHEN length({0}) - {1} >= stem_r1 THEN {2} ELSE {0} END"
    drop = []
    for s in ("ingly", "edly", "ing", "ed"):
        drop.append(f"WHEN {_ends(x, s)} THEN CASE WHEN {_matches(x, VOWEL + '.*' + s + '$')} THEN concat({_cut(x, len(s))}, '|') ELSE {x} END")
    out.append(("stem_2", f"CASE WHEN {x} IN ({', '.join(repr(w) for w in AFTER_1A)}) THEN {x} WHEN {_ends(x, 'eedly')} THEN {inside.format(x, 5, _cut(x, 3))} {drop[0]} {drop[1]} WHEN {_ends(x, 'eed')} THEN {inside.format(x, 3, _cut(x, 1))} {drop[2]} {drop[3]} ELSE {x} END"))
    x, y = "stem_2", _cut("stem_2", 1)  # a bar at the end says that something went
    doubles = " OR ".join(_ends("stem_2", d + "|") for d in DOUBLES)
    adds = " OR ".join(_ends("stem_2", d + "|") for d in ("at", "bl", "iz"))
    out.append(("stem_3", f"CASE WHEN NOT {_ends(x, '|')} THEN {x} WHEN {adds} THEN concat({y}, 'e') WHEN {doubles} THEN {_cut(x, 2)} WHEN length({x}) - 1 <= stem_r1 AND {_matches(y, _SHORT)} THEN concat({y}, 'e') ELSE {y} END"))
    x = "stem_3"
    out.append(("stem_4", f"CASE WHEN {_matches(x, '.' + OTHER + '[yY]$')} THEN {_cut(x, 1, 'i')} ELSE {x} END"))
    x = "stem_4"
    ogi = f"WHEN {_ends(x, 'logi')} THEN CASE WHEN length({x}) - 3 >= stem_r1 THEN {_cut(x, 1)} ELSE {x} END"
    li = f"WHEN {_ends(x, 'li')} AND NOT ({' OR '.join(_ends(x, s) for s in STEP_2 if s.endswith('li'))}) THEN CASE WHEN length({x}) - 2 >= stem_r1 AND {_matches(x, '[cdeghkmnrt]li$')} THEN {_cut(x, 2)} ELSE {x} END"
    out.append(("stem_5", _table(x, STEP_2, "stem_r1", f"{ogi} {li}")))
    x = "stem_5"
    out.append(("stem_6", _table(x, STEP_3, "stem_r1", f"WHEN {_ends(x, 'ative')} THEN CASE WHEN length({x}) - 5 >= stem_r2 THEN {_cut(x, 5)} ELSE {x} END")))
    x = "stem_6"
    ion = f"WHEN {_ends(x, 'ion')} THEN CASE WHEN length({x}) - 3 >= stem_r2 AND {_matches(x, '[st]ion$')} THEN {_cut(x, 3)} ELSE {x} END"
    out.append(("stem_7", _table(x, dict.fromkeys(STEP_4, ""), "stem_r2", ion)))
    x, y = "stem_7", _cut("stem_7", 1)
    out.append(("stem_8", f"CASE WHEN {_ends(x, 'e')} THEN CASE WHEN length({x}) - 1 >= stem_r2 OR (length({x}) - 1 >= stem_r1 AND NOT {_matches(y, _SHORT)}) THEN {y} ELSE {x} END WHEN {_ends(x, 'll')} AND length({x}) - 1 >= stem_r2 THEN {y} ELSE {x} END"))
    fixed = " ".join(f"WHEN {term} = '{a}' THEN '{b}'" for a, b in SPECIAL.items())
    out.append(("stem_9", f"CASE WHEN length({term}) <= 2 OR {term} IN ({', '.join(repr(w) for w in INVARIANT)}) THEN {term} {fixed} WHEN stem_1 IN ({', '.join(repr(w) for w in AFTER_1A)}) THEN stem_1 ELSE lower(stem_8) END"))
    return out


def stemmed(term: str) -> Column:
    """The English stem of the column ``term``; null stays null.

    Each step is the body of a lambda over a one-element array, which names what the step before gave: the
    expression grows with the number of steps and not as a power of it, whatever the optimizer inlines.
    """
    known, value = ["term"], f"named_struct('term', `{term}`)"
    for name, sql in steps("term"):
        body = re.sub(r"\b(stem_\w+|term)\b(?!')", r"v.\1", sql)
        fields = ", ".join(f"'{k}', v.{k}" for k in known)
        value = f"get(transform(array({value}), v -> named_struct({fields}, '{name}', {body})), 0)"
        known.append(name)
    return F.expr(f"CASE WHEN right(`{term}`, 1) IN ({', '.join(map(repr, TOUCHED))}) THEN {value}.stem_9 ELSE lower(`{term}`) END")
