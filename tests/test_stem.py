import pytest

from sextant.functions import stem

# Pairs of the published sample vocabulary.
PAIRS = dict(x.split(":") for x in """consign:consign consigned:consign consignment:consign consistency:consist consistently:consist consolation:consol consolatory:consolatori
consolidate:consolid consolingly:consol conspicuously:conspicu conspiracy:conspiraci conspirators:conspir constables:constabl constance:constanc knackeries:knackeri
knavish:knavish kneaded:knead kneeling:kneel knightly:knight knitted:knit knives:knive knockers:knocker hopping:hop hoping:hope skies:sky dying:die generously:generous
communication:communic ties:tie cries:cri gas:gas gaps:gap this:this by:by say:say cry:cri luxuriated:luxuri apology:apolog relational:relat happiness:happi formative:format
controlling:control rate:rate excited:excit proceedings:proceed agreed:agre feed:feed""".split())


def test_published_pairs(spark):
    rows = spark.createDataFrame([*PAIRS.items(), (None, None)], "term string, want string").withColumn("got", stem.stemmed("term"))
    assert {r["term"]: r["got"] for r in rows.filter("NOT got <=> want").collect()} == {}


def test_steps_stay_small_under_filters(spark):
    rows = spark.createDataFrame([("hopping",)], "term string").withColumn("got", stem.stemmed("term")).filter("got = 'hop'")
    assert rows.join(rows.select("got"), "got").count() == 1


@pytest.mark.parametrize("word", ["a1", "é", "日本", "x"])
def test_odd_terms(spark, word):
    assert spark.createDataFrame([(word,)], "term string").select(stem.stemmed("term").alias("s")).first()["s"] == word


def test_other_last_letters_change_nothing(spark):
    """Every ending of the steps has a last letter that is looked at; the long way is not taken for other terms."""
    endings = [*stem.STEP_2, *stem.STEP_3, *stem.STEP_4, *stem.SPECIAL, *stem.INVARIANT, *stem.AFTER_1A, "ative", "ion", "logi", "li", "sses", "ied", "eed", "ingly", "y", "e", "ll"]
    assert {e[-1] for e in endings} == set(stem.TOUCHED)
    terms = ["yoyo", "boyish", "ab", "x1", "schö", "tyk", "", None]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    assert [r[0] for r in df.select(stem.stemmed("term")).collect()] == terms
