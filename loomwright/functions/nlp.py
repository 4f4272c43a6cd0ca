"""Sentences, tokens, tags, noun phrases, lemmas and key sentences as column expressions.

Tagged sentences are strings of "word/TAG " items, on which the chunk grammar is a regular expression. Nothing here
leaves the JVM: every operator is a higher-order function or a regular expression over one document's row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions.lexicon import SUFFIX_TAGS, TAG_OF_WORD

BLANKS = C.Step(C.SPACE + "+", " ")
ENDS = C.Step(r"([.!?])[ ]+", "$1\n")
TOKEN = r"\w+|[^\w ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def sentences(text: Column) -> Column:
    """array<string>: cut after . ! ? and white space. White space inside becomes single blanks."""
    return F.filter(F.split(ENDS(BLANKS(text)), "\n"), lambda s: s != "")


def r_sentences(text: Column, split: str | None = None) -> Column:
    """The other splitter: punctuation is set apart from words, then cut at a lone . ! ; : ? between blanks; or at a fixed string."""
    if split is not None:
        return F.split(text, r"\Q" + split + r"\E")
    apart = C.chain(text, R_APART)
    return F.split(apart, R_CUT_STEADY)


R_APART = [C.Step(r"([0-9A-Za-z]+)([!-/:-@\[-`{-~]+)", "$1 $2", r"([0-9A-Za-z])([!-/:-@\[-`{-~]++)"), C.Step(r"([!-/:-@\[-`{-~]+)([0-9A-Za-z]+)", "$1 $2", r"([!-/:-@\[-`{-~])([0-9A-Za-z]++)")]
R_CUT = r"[ \t\n\x0B\f\r!-/:-@\[-`{-~]+[.!;:?][ \t\n\x0B\f\r]+"
#: The same for Java's engine; a run is entered at its start only.
R_CUT_STEADY = r"(?:(?<![ \t\n\x0B\f\r!-/:-@\[-`{-~])|\G)" + R_CUT


def tokens(sentence: Column) -> Column:
    """array<string>: runs of word characters, and every other non-blank character alone."""
    return F.regexp_extract_all(BLANKS(sentence), F.lit(TOKEN), F.lit(0))


#: Penn Treebank conventions, fixed values: quotes, marks, brackets and contractions that are tokens of their own.
TREEBANK = [
    C.Step(r'^"', "`` "), C.Step(r'([ (\[{<])"', "$1 `` "), C.Step(r"([:,])([^0-9])", " $1 $2"), C.Step(r"([:,])$", " $1 "), C.Step(r"[.][.][.]", " ... "),
    C.Step(r"([;@#$%&?!])", " $1 "), C.Step(r"""([^.])([.])([\])}>"']*)[ ]*$""", "$1 $2$3 "), C.Step(r"([^'])' ", "$1 ' "), C.Step(r"([\[\](){}<>])", " $1 "), C.Step(r"--", " -- "),
    C.Step(r"$", " "), C.Step(r'"', " '' "), C.Step(r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), C.Step(r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    C.Step(r"(?i)\b(can)(not)\b", "$1 $2"), C.Step(r"(?i)\b(gim|lem)(me)\b", "$1 $2"), C.Step(r"(?i)\b(gon|wan)(na)\b", "$1 $2"), C.Step(r"(?i)\b(got)(ta)\b", "$1 $2"),
]


def treebank_tokens(sentence: Column) -> Column:
    """array<string>: words as the Penn Treebank has them, so that "don't" is "do", "n't" and a final stop stands alone."""
    return F.filter(F.split(C.chain(BLANKS(sentence), TREEBANK), " "), lambda t: t != "")


def suffix_tag(word: Column, gerunds: bool = True) -> Column:
    """The tag of the first suffix rule that matches, else null. gerunds: whether -ing is a rule."""
    rules = [(p, t) for p, t in SUFFIX_TAGS if gerunds or t != "VBG"]
    return reduce(lambda otherwise, rule: F.when(word.rlike(rule[0]), rule[1]).otherwise(otherwise), reversed(rules), F.lit(None).cast("string"))


def table_tag(tags: dict[str, str] = TAG_OF_WORD) -> Callable[[Column], Column]:
    """A tagger that looks the lower-cased word up in a small table: a hash set for each tag."""
    words: dict[str, list[str]] = {}
    for word, tag in sorted(tags.items()):
        words.setdefault(tag, []).append(word)

    def of(word: Column) -> Column:
        return reduce(lambda found, tag: F.when(word.isin(words[tag]), tag).otherwise(found), words, F.lit(None).cast("string"))

    return lambda word: let(F.lower(word), of)


def backoff(*taggers: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The first tagger that gives a tag decides."""
    return lambda word: F.coalesce(*(t(word) for t in taggers))


TAGGER = backoff(table_tag(), suffix_tag)


def tagged(words: Column, tagger: Callable[[Column], Column] = TAGGER) -> Column:
    """array<struct<word, tag>>; tag may be null."""
    return F.transform(words, lambda w: F.struct(w.alias("word"), tagger(w).alias("tag")))


def kea_filter(pairs: Column, stop: list[str]) -> Column:
    """Sentence ends stay; of the rest, untagged words, nouns, verbs and PP that aren't stop words and have 3 to 19 letters."""
    listed = F.array(*(F.lit(w) for w in stop))

    def keep(p: Column) -> Column:
        tag, word = p["tag"], p["word"]
        open_ = F.coalesce(tag.rlike(r"^(?i)(N[NP]|VB|PP|\.)"), F.lit(True))
        return (F.coalesce(tag, F.lit("")) == ".") | (open_ & ~F.array_contains(listed, F.lower(word)) & F.length(word).between(3, 19))

    return F.transform(F.filter(pairs, keep), lambda p: p["word"])


def remap_lda(pairs: Column) -> Column:
    """Untagged: abbreviation or Z0; verbs: NN-VB; other words of up to three letters: Z3."""

    def one(p: Column) -> Column:
        tag, word = p["tag"], p["word"]
        return F.when(tag.isNull(), F.when(C.is_abbreviation(word), "NN-ABR").otherwise("Z0")).when(tag.startswith("VB"), "NN-VB").when(F.length(word) <= 3, "Z3").otherwise(tag)

    return F.transform(pairs, lambda p: F.struct(p["word"].alias("word"), one(p).alias("tag")))


def remap_wcd(pairs: Column) -> Column:
    """As remap_lda, but a quote is Z1, and a gerund is a noun only in a noun's place.

    That place depends on the two tags before, as remapped, and on the next tag as it came; so this is a fold.
    """
    return let(pairs, _fold_wcd)


def _fold_wcd(pairs: Column) -> Column:
    start = F.struct(F.lit("Y0").alias("p1"), F.lit("Y0").alias("p2"), F.array().cast("array<struct<word:string,tag:string>>").alias("out"))
    indexed = F.transform(pairs, lambda p, i: F.struct(p["word"].alias("word"), p["tag"].alias("tag"), (i + 1 < F.size(pairs)).alias("more"), F.get(pairs, i + 1)["tag"].alias("next")))
    odd = lambda tag: tag.rlike(r"^\W")

    def step(acc: Column, p: Column) -> Column:
        tag, word = p["tag"], p["word"]
        noun = acc["p1"].startswith("JJ") | ((odd(acc["p1"]) | acc["p1"].startswith("CC")) & acc["p2"].startswith("N")) | (p["more"] & (p["next"].isNull() | odd(p["next"])))
        new = (
            F.when(tag.isNull(), F.when(C.is_abbreviation(word), "NN-ABR").when(word.isin("'", "'s"), "Z1").otherwise("Z0"))
            .when(tag.startswith("VBG"), F.when(noun, "NN").otherwise(tag))
            .when(F.length(word) <= 3, "Z3")
            .otherwise(tag)
        )
        return F.struct(new.alias("p1"), acc["p1"].alias("p2"), F.concat(acc["out"], F.array(F.struct(word.alias("word"), new.alias("tag")))).alias("out"))

    return F.aggregate(indexed, start, step, lambda acc: acc["out"])


def encoded(pairs: Column) -> Column:
    """One "word/TAG " for each pair; a slash in a word becomes |."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.translate(p["word"], "/", "|"), F.lit("/"), p["tag"], F.lit(" "))), "")


ADJECTIVE_NOUNS = r"(?:\S+/JJ\S* )+(?:\S+/N\S* )+(?:\S+/Z1 (?:\S+/N\S* )+)?"
NOUNS = r"(?:\S+/N\S* )+"
SEVERAL_NOUNS = r"(?:\S+/N\S* )+\S+/Z1 (?:\S+/N\S* )+|(?:\S+/N\S* ){2,}"
ONE_NOUN = r"\S+/N\S* "
BARRIER = "# "


def chunks(line: Column, rules: list[str]) -> list[Column]:
    """For each rule in turn the chunks it finds in what the rules before have left."""
    found = []
    for rule in rules:
        found.append(F.regexp_extract_all(line, F.lit(rule), F.lit(0)))
        line = F.regexp_replace(line, F.lit(rule), F.lit(BARRIER))
    return found


def lemma(word: Column) -> Column:
    """Singular of a regular English plural in lower case; a rule, not a dictionary."""
    return (
        F.when(word.rlike(r"[a-z]{2}ies\z"), F.regexp_replace(word, r"ies\z", "y"))
        .when(word.rlike(r"(sh|ch|x|ss|z)es\z"), F.regexp_replace(word, r"es\z", ""))
        .when(word.rlike(r"[a-z]{2}[^sui]s\z"), F.regexp_replace(word, r"s\z", ""))
        .otherwise(word)
    )


def words_of(chunk: Column) -> Column:
    """Lower-cased words of a chunk."""
    return F.split(F.lower(F.rtrim(F.regexp_replace(chunk, r"/\S+ ", " "))), " ")


def lda_phrases(found: Column, stop: list[str]) -> Column:
    """Lemmas joined by blanks; a phrase with a stop word is dropped."""
    listed = F.array(*(F.lit(w) for w in stop))
    lemmas = F.transform(found, lambda c: F.transform(words_of(c), lemma))
    return F.transform(F.filter(lemmas, lambda ws: ~F.arrays_overlap(ws, listed)), lambda ws: C.NO_SPACE_BEFORE_QUOTE(F.array_join(ws, " ")))


def wcd_phrases(found: Column, dequote: bool = True) -> Column:
    """Words joined by blanks, the last as its lemma."""

    def one(c: Column) -> Column:
        ws = words_of(c)
        joined = let(ws, lambda x: F.array_join(F.concat(F.slice(x, 1, F.size(x) - 1), F.array(let(F.element_at(x, -1), lemma))), " "))
        return C.NO_SPACE_BEFORE_QUOTE(joined) if dequote else joined

    return F.transform(found, one)


def wcd_text_phrases(text: Column) -> Column:
    """struct<several, single>: the phrases of several words and of one word of a text, sentence by sentence."""
    lines = F.transform(sentences(C.BREAKS_TO_SENTENCES(text)), lambda s: encoded(remap_wcd(tagged(tokens(C.lower_if_upper(s))))))

    def both(line: Column) -> Column:
        adjective, several, single = chunks(line, [ADJECTIVE_NOUNS, SEVERAL_NOUNS, ONE_NOUN])
        return F.struct(F.concat(wcd_phrases(adjective), wcd_phrases(several)).alias("several"), wcd_phrases(single, dequote=False).alias("single"))

    return let(F.array_join(lines, "# "), both)


def lda_text_phrases(text: Column, stop: list[str], infer: bool = False) -> Column:
    """array<string>: all adjective phrases, then all noun phrases of a text."""
    lines = F.transform(sentences(C.lda_clean(text, infer)), lambda s: encoded(remap_lda(tagged(tokens(C.lower_if_upper(s))))))

    def both(line: Column) -> Column:
        adjective, nouns = chunks(line, [ADJECTIVE_NOUNS, NOUNS])
        return F.concat(lda_phrases(adjective, stop), lda_phrases(nouns, stop))

    return let(F.array_join(lines, "# "), both)


def phrase_words(phrases: Column) -> Column:
    """Words of phrases, cut at every non-word character, without those that start with a number or have under three letters."""
    cut = F.flatten(F.transform(phrases, lambda p: F.split(p, r"\W")))
    return F.filter(cut, lambda w: ~w.rlike(C.STARTS_WITH_NUMBER) & (F.length(w) > 2))


def without_career(biography: Column, fixed: bool = False) -> Column:
    """The biography without sentences that tell of a career."""
    pattern = r"(?i)\s(" + (C.CAREER_SPACED if fixed else C.CAREER) + ")"
    return F.array_join(F.filter(sentences(biography), lambda s: ~s.rlike(pattern)), " ")


def key_sentence(text: Column, keys: Column, stop: list[str] | None = None, split: str | None = None) -> Column:
    """The first sentence with most of the keys; "" without keys, the first sentence without a hit.

    With stop words, sentences are normalised and keys lower-cased before keys are looked for; else both stay as they are.
    """
    parts = r_sentences(text, split)
    look = (lambda s: C.r_normalise(s, stop)) if stop else (lambda s: s)
    wanted = F.transform(keys, lambda k: C.without_punctuation(k, lower=stop is not None))
    hits = lambda s, ks: let(look(s), lambda x: F.size(F.filter(ks, lambda k: F.contains(x, k))))
    best = let(wanted, lambda ks: F.array_max(F.transform(parts, lambda s, i: F.struct(hits(s, ks).alias("hits"), (-i).alias("at"), s.alias("s")))))
    return F.when(F.size(keys) > 0, best["s"]).otherwise("")


def language_scores(text: Column, stop_words: dict[str, list[str]]) -> Column:
    """array<struct<hits, language>>: distinct lower-cased words among each language's stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(C.printable(text)), F.lit(r"\w+"), F.lit(0)))
    hits = lambda ws, own: F.size(F.array_intersect(ws, F.array(*map(F.lit, own)))).alias("hits")
    return let(words, lambda ws: F.array(*(F.struct(hits(ws, own), F.lit(name).alias("language")) for name, own in sorted(stop_words.items()))))


def best_language(scores: Column) -> Column:
    """The language with most hits, of equal ones the first by name."""
    most = F.array_max(F.transform(scores, lambda s: s["hits"]))
    return F.filter(scores, lambda s: s["hits"] == most)[0]["language"]
