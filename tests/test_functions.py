"""Cleaning, tagging and phrases against Python's own regular expressions and hand-made cases."""

import re

import pytest
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import nlp

MAIL = "From: a@b.com\nTo: c@d.org\nSubject: x\nDear Bob,\nsee www.site.org/a and notes.doc, 12.5e-3 items; it's (fine)!\n----- Original Message -----\n" + "=" * 12 + "\nad text here\n" + "=" * 12 + "\nBye."


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("step", [C.PRINTABLE, *C.KEA, *C.LDA, C.ONE_SPACE, C.LEFT_TRIM, C.NO_SPACE_BEFORE_QUOTE, *C.MAIL])
def test_steps_equal_python(spark, step):
    pattern = re.sub(r"\(\?<(\w+)>", r"(?P<\1>", step.pattern).replace(r"\k<pfc>", "(?P=pfc)").replace(r"\k<pf>", "(?P=pf)")
    put = re.sub(r"\$(\d)", r"\\g<\1>", step.put)
    for text in (MAIL, "-+- 123.23.'123e -123.123 daf 76% x", "it 's ' a", "  a  b", "To: no end", "é £ ü\x0b", ""):
        assert one(spark, text, step) == re.sub(pattern, put, text, flags=re.ASCII), text


def test_headers_without_an_end_stay(spark):
    assert one(spark, "To: nobody knows", C.mail_clean) == "To: nobody knows"
    assert "ad text" not in one(spark, MAIL, C.mail_clean) and "c@d.org" not in one(spark, MAIL, C.mail_clean)


def test_sections(spark):
    get = lambda t: tuple(one(spark, t, C.sections))
    assert get("####a\nb&&&&no@@@@p") == ("a\nb", "p")
    assert get("####a@@@@p####c") == ("c", "p")
    assert get("none") == (None, None)


@pytest.mark.parametrize("word,tag", [("12", "CD"), ("would", "MD"), ("going", "VBG"), ("played", "VBD"), ("kindness", "NN"), ("useful", "JJ"), ("a", "PREP"), ("xyz", None)])
def test_suffix_tags(spark, word, tag):
    assert one(spark, word, nlp.suffix_tag) == tag


def test_gerunds_are_nouns_in_a_nouns_place(spark):
    def tags(pairs):
        df = spark.createDataFrame([(pairs,)], "p array<struct<word:string,tag:string>>")
        return [p["tag"] for p in df.select(nlp.remap_wcd(F.col("p"))).first()[0]]

    assert tags([("optical", "JJ"), ("switching", "VBG"), ("runs", "VB")]) == ["JJ", "NN", "VB"]
    assert tags([("switching", "VBG"), ("foo", None)]) == ["NN", "Z0"]
    assert tags([("switching", "VBG"), ("very", "RB")]) == ["VBG", "RB"]
    assert tags([("cat", "NN"), ("and", "CC"), ("running", "VBG"), ("fast", "RB")])[2] == "VBG"  # "and" is Z3 by then
    assert tags([("DQPSK", None), ("'s", None), ("an", "DT")]) == ["NN-ABR", "Z1", "Z3"]


def test_chunks(spark):
    line = "big/JJ house/NN '/Z1 door/NN the/Z3 water/NN price/NN # light/NN "
    found = spark.createDataFrame([(line,)], "t string").select(*nlp.chunks(F.col("t"), [nlp.ADJECTIVE_NOUNS, nlp.SEVERAL_NOUNS, nlp.ONE_NOUN])).first()
    assert [list(x) for x in found] == [["big/JJ house/NN '/Z1 door/NN "], ["water/NN price/NN "], ["light/NN "]]


def test_key_sentences(spark):
    stop = ["the"]
    get = lambda text, keys, s=stop: spark.createDataFrame([(text, keys)], "t string, k array<string>").select(nlp.key_sentence(F.col("t"), F.col("k"), s)).first()[0]
    text = "The Red fox . two red dogs and fox . none"
    assert get(text, []) == ""
    assert get(text, ["zebra"]).startswith("The Red")
    assert get(text, ["red", "fox"]).startswith("The Red")  # a tie goes to the first
    assert get(text, ["red"], None).startswith("two red")  # case counts without normalising
    assert get(text, ["dogs!"]).startswith("two red")


def test_career_sentences(spark):
    text = "He likes tea. He was born in May. She sings."
    assert one(spark, text, nlp.without_career) == "He likes tea. She sings."
