"""The text functions of functions.nlp on whole documents in Python workers, where what depends on a word alone is found out once.

As column expressions each token is tagged anew by a chain of patterns. Results are the same; tests hold both against each other.
Texts must be printable already, since classes are ASCII ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import nlp
from loomwright.functions.lexicon import SUFFIX_TAGS, TAG_OF_WORD

#: Words that a worker remembers at most.
MOST = 1 << 19


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


SPACES, ENDS, TOKEN = _compiled(C.SPACE + "+"), _compiled(r"([.!?])[ ]+"), _compiled(nlp.TOKEN)
UPPER, ABBREVIATION = _compiled(C.ALL_UPPER), _compiled(C.ABBREVIATION)
SUFFIXES = [(_compiled(p), t) for p, t in SUFFIX_TAGS]
ADJECTIVE_NOUNS, NOUNS, SEVERAL_NOUNS, ONE_NOUN = map(_compiled, (nlp.ADJECTIVE_NOUNS, nlp.NOUNS, nlp.SEVERAL_NOUNS, nlp.ONE_NOUN))
TAG_ENDS, QUOTED, ODD = _compiled(r"/\S+ "), _compiled(r"[ ]+(['])"), _compiled(r"\W")
OPEN = re.compile(r"(N[NP]|VB|PP|\.)", re.ASCII | re.IGNORECASE)
IES, ES, S = _compiled(r"[a-z]{2}ies\z"), _compiled(r"(sh|ch|x|ss|z)es\z"), _compiled(r"[a-z]{2}[^sui]s\z")


class Memo(dict):
    """What a function gives for a key, remembered for the last keys, MOST at most."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, key):
        if len(self) >= MOST:
            self.clear()
        found = self[key] = self.of(key)
        return found


def each(df: DataFrame, text: Column, kinds: str, maker: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """df with columns of the given kinds in place of text; maker gives a worker its function of a text. Null gives nulls."""
    keep = [c for c in df.columns if c != "text"]
    held = df.select(*keep, text.alias("text"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), kinds])
    names = [*keep, *(k.split()[0] for k in kinds.split(", "))]
    types = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,bigint>": pa.map_(pa.string(), pa.int64())}[k.split()[1]] for k in kinds.split(", ")]

    def run(batches):
        made = maker()
        none = (None,) * len(types)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = [none if (t := x.as_py()) is None else made(t) for x in part.column(len(keep))]
                yield pa.record_batch([*part.columns[: len(keep)], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types))], names=names)

    return held.mapInArrow(run, schema)


def tag(word: str) -> str | None:
    """nlp.TAGGER."""
    return TAG_OF_WORD.get(word.lower()) or suffix_tag(word)


def suffix_tag(word: str) -> str | None:
    return next((t for p, t in SUFFIXES if p.search(word)), None)


def sentences(text: str) -> list[str]:
    return [s for s in ENDS.sub("\\1\n", SPACES.sub(" ", text)).split("\n") if s]


def tokens(sentence: str) -> list[str]:
    return TOKEN.findall(SPACES.sub(" ", sentence))


def lower_if_upper(sentence: str) -> str:
    return sentence.lower() if UPPER.search(sentence) else sentence


def lemma(word: str) -> str:
    if IES.search(word):
        return word[:-3] + "y"
    if ES.search(word):
        return word[:-2]
    return word[:-1] if S.search(word) else word


def words_of(chunk: str) -> list[str]:
    return TAG_ENDS.sub(" ", chunk).rstrip(" ").lower().split(" ")


def chunks(line: str, rules: list[re.Pattern]) -> list[list[str]]:
    found = []
    for rule in rules:
        found.append([m.group() for m in rule.finditer(line)])
        line = rule.sub(nlp.BARRIER, line)
    return found


def kea_kept(stop: list[str]) -> Callable[[str], tuple]:
    """(kept,): the words that nlp.kea_filter keeps."""
    stopped = frozenset(stop)

    def keep(word: str) -> bool:
        t = tag(word)
        return t == "." or (t is None or OPEN.match(t) is not None) and word.lower() not in stopped and 3 <= len(word) <= 19

    known = Memo(keep)
    return lambda text: (" ".join([w for w in tokens(text) if known[w]]),)


def lda_chunks(stop: list[str]) -> Callable[[str], tuple]:
    """(n_adjective, n_noun, phrases) of a text that C.lda_clean() has cleaned."""
    stopped = frozenset(stop)

    def item(word: str) -> str:
        t = tag(word)
        if t is None:
            t = "NN-ABR" if ABBREVIATION.search(word) else "Z0"
        elif t.startswith("VB"):
            t = "NN-VB"
        elif len(word) <= 3:
            t = "Z3"
        return f"{word.replace('/', '|')}/{t} "

    items, lemmas = Memo(item), Memo(lemma)

    def phrases(found: list[str]) -> str:
        kept = ([lemmas[w] for w in words_of(c)] for c in found)
        return " ".join([QUOTED.sub(r"\1", " ".join(ws)) for ws in kept if stopped.isdisjoint(ws)])

    def of(text: str) -> tuple:
        line = "# ".join(["".join([items[w] for w in tokens(lower_if_upper(s))]) for s in sentences(text)])
        one, two = chunks(line, [ADJECTIVE_NOUNS, NOUNS])
        return len(one), len(two), f"{phrases(one)}|{phrases(two)}"

    return of


def wcd_chunks() -> Callable[[str], tuple]:
    """(several, single): nlp.wcd_text_phrases() of a text whose breaks end sentences, C.BREAKS_TO_SENTENCES."""

    def fixed(word: str) -> tuple[str, str | None, str | None]:
        """(word as it is written, its tag, its tag after remapping or null for a gerund)."""
        t = tag(word)
        if t is None:
            new = "NN-ABR" if ABBREVIATION.search(word) else "Z1" if word in ("'", "'s") else "Z0"
        else:
            new = None if t.startswith("VBG") else "Z3" if len(word) <= 3 else t
        return word.replace("/", "|"), t, new

    known, lemmas, odd = Memo(fixed), Memo(lemma), Memo(lambda t: ODD.match(t) is not None)

    def line_of(words: list[str]) -> str:
        found, out, p1, p2 = [known[w] for w in words], [], "Y0", "Y0"
        for k, (word, t, new) in enumerate(found):
            if new is None:
                follows = k + 1 < len(found) and ((after := found[k + 1][1]) is None or odd[after])
                new = "NN" if p1.startswith("JJ") or (odd[p1] or p1.startswith("CC")) and p2.startswith("N") or follows else t
            out.append(f"{word}/{new} ")
            p1, p2 = new, p1
        return "".join(out)

    def phrase(chunk: str) -> str:
        *ws, last = words_of(chunk)
        return " ".join([*ws, lemmas[last]])

    def of(text: str) -> tuple:
        line = "# ".join([line_of(tokens(lower_if_upper(s))) for s in sentences(text)])
        adjective, several, single = chunks(line, [ADJECTIVE_NOUNS, SEVERAL_NOUNS, ONE_NOUN])
        return [QUOTED.sub(r"\1", phrase(c)) for c in adjective + several], [phrase(c) for c in single]

    return of


def tag_counts(tagger) -> Callable[[str], tuple]:
    """(tags,): how often a text has each tag of a BackoffTagger over tag(), "none" for words without one."""
    base = Memo(tag)
    known = Memo(lambda key: tagger.tag(key[2], key[:2], base[key[2]]))

    def of(text: str) -> tuple:
        found: Counter = Counter()
        for s in sentences(text):
            back2 = back1 = None
            for word in tokens(s):
                back2, back1 = back1, known[back2, back1, word]
                found[back1 or "none"] += 1
        return (list(found.items()),)

    return of
