"""Cleaning in linear time: long runs of one character, and steady patterns that do what the plain ones do."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import nlp
from loomwright.plans import text as T

RUN = 100_000
RUNS = [" ", "\n", "-", ".", "a", "A", ">", "*", "1", "=", " >", "- ", "\t "]
STEADY = {name: step for name, step in vars(C).items() if isinstance(step, C.Step) and step.steady}
STEADY |= {f"apart{k}": s for k, s in enumerate(nlp.R_APART)} | {f"r{k}": s for k, s in enumerate(C.r_steps(T.R_STOP)[:2])}


@pytest.fixture(scope="module")
def long_texts(spark):
    texts = [(f"word {r * (RUN // len(r))}", k) for k, r in enumerate(RUNS)] + [(f"{r * (RUN // len(r))}end. This", k) for k, r in enumerate(RUNS)]
    return spark.createDataFrame(texts, "text string, k int").repartition(4).cache()


@pytest.mark.parametrize("name", ["mail", "kea", "lda", "infer", "r", "r_sentences", "sentences", "treebank"])
def test_long_runs(long_texts, name):
    text = C.printable(F.col("text"))
    made = {
        "mail": lambda: C.mail_clean(text), "kea": lambda: C.kea_clean(F.col("text")), "lda": lambda: C.lda_clean(text), "infer": lambda: C.lda_clean(text, infer=True),
        "r": lambda: C.r_normalise(text, T.R_STOP), "r_sentences": lambda: nlp.r_sentences(text), "sentences": lambda: nlp.sentences(text), "treebank": lambda: nlp.treebank_tokens(text),
    }[name]()
    assert long_texts.select(made.alias("x")).filter("x is not null").count() == 2 * len(RUNS)


@pytest.mark.parametrize("name", sorted(STEADY))
def test_steady_patterns_do_the_same(spark, name):
    step, rng = STEADY[name], random.Random(name)
    words = ["a", "Z", "1", "2.5", " ", "  ", "\n", "\t", "-", "--", "+", ".", ",", ":", ";", "?", "!", ">", "*", "'", "e", "a@b.c ", "ftp://x", "Original", " Message", "==========", "----------- ", ">>>>>>>>>>>>", "This e-mail is the property", " estoppel or otherwise. Thank you.", " tel "]
    texts = [("".join(rng.choice(words) for _ in range(rng.randint(0, 14))),) for _ in range(3000)]
    both = spark.createDataFrame(texts, "text string").select("text", C.Step(step.pattern, step.put)(F.col("text")).alias("plain"), step(F.col("text")).alias("steady"))
    assert both.filter("plain != steady").limit(3).collect() == []


def test_steady_cut(spark):
    rng = random.Random(1)
    texts = [("".join(rng.choice(["a", "b", " ", ".", "!", ";", "-", "\n"]) for _ in range(20)),) for _ in range(3000)]
    both = spark.createDataFrame(texts, "text string").select(F.split("text", nlp.R_CUT).alias("plain"), F.split("text", nlp.R_CUT_STEADY).alias("steady"))
    assert both.filter("plain != steady").limit(3).collect() == []


def by_python(text):
    """The mail chain by Python's engine, with each pattern as it reads without regard to time."""
    text = re.sub(r"[^\x20-\x7E\t\n\r\x0B\x0C]", "", text)
    ahead = rf"(?={C.HEADERS}|Hello[\W]|Hi[\W]|Dear[\W])"
    for pattern, put in (
        (rf"([ \t>]*)(To:[ \t]|Cc:[ \t]|Bcc:[ \t]|Received:[ \t])([\s\S]*?){ahead}", " "),
        (rf"([ \t>]*)({C.HEADERS})([\s\S]{{0,200}}?){ahead}", " "),
        (r"([>*]|\s)+This\s+e-mail\s+is\s+the\s+property[\s\S]*estoppel\s+or\s+otherwise\.\s+Thank you\.([>*]|\s)+", "\n"),
        (r"-+\s*Original\s+Message\s*-+", " "),
        (r"(?P<pf>(?P<pfc>[+*_=#~<>/-])(?P=pfc){9,})(([> \t\n\r\f\x0B]*)([^\s+*_=#~<>/-]+)(([> \t\n\r\f\x0B]+[^>\s]+){0,300}?)([> \t\n\r\f\x0B]*))(?P=pf)", "\n"),
    ):
        text = re.sub(pattern, put, text, flags=re.IGNORECASE | re.ASCII)
    return text


def test_mail_chain_against_python(spark):
    rng = random.Random(7)
    parts = ["To: bob@x.org\n", "Cc: al", "> From: me ", " Sent: today\n", "Subject: re: fw", "Hello ", "Dear all, ", "Hi,", "body text here ", "\n\n", " > ", "----- Original Message -----", "==========", "notice of a kind", "X-Mailer: 5 ", " This e-mail is the property of us; estoppel or otherwise. Thank you.\n", "é", "Received: by "]
    texts = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))),) for _ in range(1500)]
    got = spark.createDataFrame(texts, "text string").select("text", C.mail_clean(C.printable(F.col("text"))).alias("clean")).collect()
    assert [(r.text, r.clean) for r in got if r.clean != by_python(r.text)][:2] == []


def test_needs_leave_no_match_out(spark):
    rng = random.Random(9)
    words = ["a", "Z9", " ", "\n", "://", "WWW.", "www", ".", "@", "b.c", ".TXT", ".Jpeg", ".jpg", ".doc", "x", "(", "'", "-", "é", "ſ", "K"]
    texts = [("".join(rng.choice(words) for _ in range(rng.randint(0, 14))),) for _ in range(4000)]
    df = spark.createDataFrame(texts, "text string")
    for step in (C.LINKS, C.MAIL_ADDRESSES, C.FILE_NAMES):
        assert step.needs
        both = df.select("text", C.Step(step.pattern, step.put)(F.col("text")).alias("plain"), step(F.col("text")).alias("held"))
        assert both.filter("plain != held").limit(3).collect() == []


def test_texts_are_cleaned_once(spark, small):
    """A filter on a cleaned text must not clean it again."""
    found = T.raw_preprocessed_match(spark, small)
    assert "regexp_replace" not in found._jdf.queryExecution().executedPlan().toString()
