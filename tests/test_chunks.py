"""Noun phrases of the word-cloud kind against a walk over tokens, one sentence and one rule after the other."""

import random
import re

import pyarrow.parquet as pq

from loomwright.functions import cleaning as C
from loomwright.functions.lexicon import SUFFIX_TAGS, TAG_OF_WORD
from loomwright.plans import text as T


def tag(word):
    if word.lower() in TAG_OF_WORD:
        return TAG_OF_WORD[word.lower()]
    return next((t for p, t in SUFFIX_TAGS if re.search(p.replace(r"\z", r"\Z"), word, re.ASCII)), None)


def remapped(words):
    tags, out = [tag(w) for w in words], []
    odd = lambda t: re.match(r"\W", t, re.ASCII) is not None
    for k, (w, t) in enumerate(zip(words, tags)):
        p1, p2 = ([*out[-2:][::-1], "Y0", "Y0"])[:2]
        if t is None:
            t = "NN-ABR" if re.search(C.ABBREVIATION.replace(r"\z", r"\Z"), w, re.ASCII) else "Z1" if w in ("'", "'s") else "Z0"
        elif t.startswith("VBG"):
            following = k + 1 < len(tags) and (tags[k + 1] is None or odd(tags[k + 1]))
            t = "NN" if p1.startswith("JJ") or (odd(p1) or p1.startswith("CC")) and p2.startswith("N") or following else t
        elif len(w) <= 3:
            t = "Z3"
        out.append(t)
    return out


def run(items, at, test):
    n = at
    while n < len(items) and items[n] and test(items[n][1]):
        n += 1
    return n


noun = lambda t: t.startswith("N")


def owned(items, at):
    """Where "owner's things" from at ends; at itself if there are none."""
    n = run(items, at, noun)
    if n > at and n < len(items) and items[n] and items[n][1] == "Z1":
        m = run(items, n + 1, noun)
        return m if m > n + 1 else at
    return at


def adjective(items, at):
    a = run(items, at, lambda t: t.startswith("JJ"))
    n = run(items, a, noun) if a > at else at
    return max(n, owned(items, a)) if n > a else at


def several(items, at):
    if (n := owned(items, at)) > at:
        return n
    n = run(items, at, noun)
    return n if n >= at + 2 else at


def taken(items, rule):
    found, left, at = [], [], 0
    while at < len(items):
        end = rule(items, at)
        if end > at:
            found.append([w for w, _ in items[at:end]])
            left.append(None)
            at = end
        else:
            left.append(items[at])
            at += 1
    return found, left


def singular(w):
    if re.search(r"[a-z]{2}ies\Z", w):
        return w[:-3] + "y"
    if re.search(r"(sh|ch|x|ss|z)es\Z", w):
        return w[:-2]
    return w[:-1] if re.search(r"[a-z]{2}[^sui]s\Z", w) else w


def phrase(words, dequote=True):
    ws = [w.lower() for w in words]
    joined = " ".join([*ws[:-1], singular(ws[-1])])
    return re.sub(r" +'", "'", joined) if dequote else joined


def wcd(text):
    text = re.sub(r"[^\x20-\x7E\t\n\r\x0B\x0C]", "", text)
    text = re.sub(r"[ \t\n\x0B\f\r]+", " ", re.sub(r"(\r?\n)+", ". ", text))
    items = []
    for s in filter(None, re.sub(r"([.!?]) +", "\\1\n", text).split("\n")):
        if re.search(r"^[A-Z0-9\s\W]+\Z", s, re.ASCII):
            s = s.lower()
        words = re.findall(r"\w+|[^\w ]", s, re.ASCII)
        items += [(w.replace("/", "|"), t) for w, t in zip(words, remapped(words))] + [None]
    first, items = taken(items, adjective)
    second, items = taken(items, several)
    third, _ = taken(items, lambda x, at: at + 1 if x[at] and noun(x[at][1]) else at)
    return "|".join(map(phrase, first + second)), "|".join(phrase(w, False) for w in third)


def test_over_documents(spark, small):
    table = pq.read_table(f"{small}/documents.parquet").to_pydict()
    want = {k: wcd(x) for k, x in zip(table["doc_id"], table["text"]) if x is not None}
    got = {r.doc_id: (r.several, r.single) for r in T.np_chunks_wcd(spark, small).collect()}
    assert {k: got[k] for k in want} == want


def test_over_odd_sentences(spark):
    from pyspark.sql import functions as F

    from loomwright.functions import nlp

    rng = random.Random(8)
    words = ["big", "optical", "network", "systems", "'", "s", "meeting", "boxes", "running", "and", ".", "!", ",", "IEEE", "the", "A/B", "cities", "good", "\n", "MODEL", "data", "of", "#", "fastest"]
    texts = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 20))),) for _ in range(800)]
    found = spark.createDataFrame(texts, "text string").select("text", nlp.wcd_text_phrases(F.col("text")).alias("p"))
    for r in found.select("text", F.array_join("p.several", "|").alias("a"), F.array_join("p.single", "|").alias("b")).collect():
        assert (r.a, r.b) == wcd(r.text), r.text


def test_workers_give_what_columns_give(spark):
    """Words that are tagged once in a worker, against the column expressions that tag each token."""
    from pyspark.sql import functions as F

    from loomwright.functions import lexicon as L
    from loomwright.functions import nlp
    from loomwright.operators import chunker

    rng = random.Random(12)
    words = ["big", "optical", "network", "systems", "'", "'s", "meeting", "boxes", "glass", "running", "and", ".", "!", ",", "IEEE", "X_1", "the", "A/B", "cities", "-12.5", "12x5", "good", "\n", "\t", "\r\n", "MODEL", "a", "said", "would", "illness", "  ", "(", "#"]
    df = spark.createDataFrame([(k, None if k == 0 else "".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 25)))) for k in range(900)], "id int, text string")
    text = F.col("text")
    lines = F.transform(nlp.sentences(text), lambda s: nlp.encoded(nlp.remap_lda(nlp.tagged(nlp.tokens(C.lower_if_upper(s))))))
    one, two = nlp.chunks(F.array_join(lines, "# "), [nlp.ADJECTIVE_NOUNS, nlp.NOUNS])
    joined = F.concat(F.array_join(nlp.lda_phrases(one, L.LDA_STOP), " "), F.lit("|"), F.array_join(nlp.lda_phrases(two, L.LDA_STOP), " "))
    wcd = nlp.wcd_text_phrases(text)
    want = df.select("id", F.array_join(nlp.kea_filter(nlp.tagged(nlp.tokens(text)), L.KEA_STOP), " ").alias("kept"), F.size(one), F.size(two), joined, wcd["several"], wcd["single"])
    kea = chunker.each(df, text, "kept string", lambda: chunker.kea_kept(L.KEA_STOP))
    lda = chunker.each(df, text, "a int, n int, phrases string", lambda: chunker.lda_chunks(L.LDA_STOP))
    both = chunker.each(df, C.BREAKS_TO_SENTENCES(text), "several array<string>, single array<string>", chunker.wcd_chunks)
    got = kea.join(lda, "id").join(both, "id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_queries_tag_words_once(spark, small):
    """No plan has the suffix rules, which columns try on each token."""
    for query in (T.np_chunks_lda, T.np_chunks_infer, T.np_chunks_wcd, T.token_filter_kea, T.backoff_tags):
        assert "ould" not in query(spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_exchanged_once(spark):
    """All groups and joins of phrase counts are by conversation, whose partitions grow in number with the input."""
    from loomwright.operators import phrasecloud

    rng = random.Random(3)
    rows = [(c, rng.choice(phrasecloud.SECTIONS), f"{rng.choice('abc')}word {rng.choice('xyz')}word") for c in range(40) for _ in range(9)]
    counts = phrasecloud.phrase_counts(spark.createDataFrame(rows, "conv_id int, section string, phrase string").repartition(5), "conv_id", 40)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\), (\w+)", plan))
    assert len(dealt) == 1 and all(re.fullmatch(r"conv_id#\d+", by) and int(n) == 40 for by, n, _ in dealt) and "Join" not in plan
