"""Text cleaning as column expressions: each step is a regular expression and what takes its place.

A step's pattern means the same to Java's engine and to RE2 unless it looks around or back, so that a chain of steps can
also be written down as SQL. All classes are ASCII ones. Null stays null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """Replace all matches of pattern; $1, $2 in put are groups.

    steady, where given, has the same matches or the same outcome in Java's engine, in linear time on long runs of one
    character: a run is entered at its start, or where the match before ended, and not given back bit by bit. needs, where
    given, is what a text with a match has, and is looked for in linear time first.
    """

    pattern: str
    put: str = ""
    steady: str = ""
    steady_put: str | None = None
    needs: str = ""

    def __call__(self, text: Column) -> Column:
        made = lambda t: F.regexp_replace(t, F.lit(self.steady or self.pattern), F.lit(self.put if self.steady_put is None else self.steady_put))
        return F.transform(F.array(text), lambda t: F.when(t.rlike(self.needs), made(t)).otherwise(t))[0] if self.needs else made(text)

    def sql(self, text: str) -> str:
        put = self.put.replace("$", "\\").replace("'", "''")
        return f"regexp_replace({text}, '{self.pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"


def chain(text: Column, steps: list[Step]) -> Column:
    return reduce(lambda t, step: step(t), steps, text)


def chain_sql(text: str, steps: list[Step]) -> str:
    return reduce(lambda t, step: step.sql(t), steps, text)


# Patterns, headers and word lists that results depend on.
SPACE = r"[ \t\n\x0B\f\r]"
PRINTABLE = Step(r"[^\x20-\x7E\t\n\r\x0B\x0C]")
LINKS = Step(r"(?i)(^|\W)([a-zA-Z]+://|www\.)\w[\w.]*\w", "$1 ", needs=r"://|[wW]{3}\.")
MAIL_ADDRESSES = Step(r"(^|\W)\w[\w.]+\w@\w[\w.]+\w", "$1 ", needs="@")
FILE_NAMES = Step(
    r"(?i)(^|\W)[\w()-_\[\]@~<>.]+\.(com|txt|doc[x]?|xls[s]?|exe|zip|ppt[x]?|rar|img|gif|png|bmp|jp[e]?g|htm[l]?|url)", "$1 ",
    r"(?i)(^|[^\w()-_\[\]@~<>.])[\w()-_\[\]@~<>.]+\.(com|txt|doc[x]?|xls[s]?|exe|zip|ppt[x]?|rar|img|gif|png|bmp|jp[e]?g|htm[l]?|url)",
    needs=r"\.(?i:com|txt|doc|xls|exe|zip|ppt|rar|img|gif|png|bmp|jpe?g|htm|url)",
)
NUMBERS = Step(r"(^|\W)[-+ ]*\d[\d.',]*(\d[eE]?[-+ ]*\d[\d.',]+)?", "$1 ", r"(^|(?:(?<!\W)|\G)[-+ ]|[^\w+ -])[-+ ]*+\d[\d.',]*(\d[eE]?[-+ ]*\d[\d.',]+)?")
BREAKS_TO_BLANKS = Step(r"(\t|\n)+", " ", r"[\t\n]++")
PUNCTUATION_KEA = Step(r"""["`£$%^&*:@#~<>,/\\|_+=]+""", " ")
APART_LEFT_KEA = Step(r"(\w)([;.!?]+)", "$1 $2")
APART_RIGHT_KEA = Step(r"([;.!?]+)(\w)", "$1 $2", r"([;.!?])(\w)")
BREAKS_TO_SENTENCES = Step(r"(\r?\n)+", ". ", r"(?:\r?\n)++")
PUNCTUATION_LDA = Step(r"""["`£$%^&*@#~<>/\\_+=']+""", " ")
APART_LEFT_LDA = Step(r"(\w)([;.!?,:|-]+)", "$1 $2")
APART_RIGHT_LDA = Step(r"([;.!?,:|-]+)(\w)", "$1 $2", r"([;.!?,:|-])(\w)")
ONE_SPACE = Step(SPACE + "{2,}", " ")
LEFT_TRIM = Step("^" + SPACE + "+")
NO_SPACE_BEFORE_QUOTE = Step(r"[ ]+(['])", "$1", r"(?<! )[ ]++(['])")
ALL_UPPER = r"^[A-Z0-9\s\W]+\z"
ABBREVIATION = r"^([A-Z0-9]{3,}[A-Z0-9_-]*|[A-Z0-9_-]*[A-Z0-9]{3,})\z"
STARTS_WITH_NUMBER = r"^(^|\W)[-+ ]*\d"
HEADERS = (
    r"Content-Class:[ \t]|MIME-Version:[ \t]|Date:[ \t]|From:[ \t]|Sent:[ \t]|To:[ \t]|Subject:[ \t]|\[mailto:[ \t]?|"
    r"Thread-Topic:[ \t]|Thread-Index:[ \t]|Cc:[ \t]|Bcc:[ \t]|Full-name:[ \t]|Message-ID:[ \t]|Return-Path:[ \t]|Received:[ \t]|"
    r"Content-Transfer-Encoding:[ \t]|X-MimeOLE:[ \t]|X-MS-Has-Attach:[ \t]|X-MS-TNEF-Correlator:[ \t]|"
    r"X-OriginalArrivalTime:[ \t]|X-MIME-Autoconverted:[ \t]|X-UIDL:[ \t]|X-Keywords:[ \t]|X-Mailer:[ \t]"
)
UNTIL_HEADER = rf"(?={HEADERS}|Hello[\W]|Hi[\W]|Dear[\W])"
#: Where a run of blanks and quoting marks begins, or goes on behind the match before.
QUOTED = r"(?:(?<![ \t>])|\G)[ \t>]*+"
_RECIPIENTS = rf"(To:[ \t]|Cc:[ \t]|Bcc:[ \t]|Received:[ \t])([\s\S]*?){UNTIL_HEADER}"
_OTHERS = rf"({HEADERS})([\s\S]{{0,200}}?){UNTIL_HEADER}"
RECIPIENTS = Step(rf"(?i)([ \t>]*){_RECIPIENTS}", " ", rf"(?i){QUOTED}{_RECIPIENTS}")
OTHER_HEADERS = Step(rf"(?i)([ \t>]*){_OTHERS}", " ", rf"(?i){QUOTED}{_OTHERS}")
DISCLAIMER = Step(
    r"(?i)[>*\s]+This\s+e-mail\s+is\s+the\s+property[\s\S]*estoppel\s+or\s+otherwise\.\s+Thank you\.[>*\s]+", "\n",
    r"(?i)(?:(?<![>*\s])|\G)[>*\s]++This\s++e-mail\s++is\s++the\s++property[\s\S]*estoppel\s++or\s++otherwise\.\s++Thank you\.[>*\s]++",
)
ORIGINAL_MESSAGE = Step(r"(?i)-+\s*Original\s+Message\s*-+", " ", r"(?i)(?<!-)-++\s*+Original\s++Message\s*+-++")
_BLOCK = r"(([> \t\n\r\f\x0B]*)([^\s+*_=#~<>/-]+)(([> \t\n\r\f\x0B]+[^>\s]+){0,300}?)([> \t\n\r\f\x0B]*))\k<pf>"
RULED_BLOCK = Step(
    r"(?i)(?<pf>(?<pfc>[+*_=#~<>/-])\k<pfc>{9,})" + _BLOCK, "\n",
    # but for ">", which a block may start with, a rule can only be followed by its block where its run ends
    r"(?i)(?<pf>[+]{10,}+|[*]{10,}+|_{10,}+|={10,}+|#{10,}+|~{10,}+|<{10,}+|/{10,}+|-{10,}+|(?:(?<!>)|\G)>{10,})" + _BLOCK,
    needs="|".join(rf"(?<![{c}])[{c}]{{10,}}+[^{c}][\s\S]*[{c}]{{10}}" for c in "+*_=#~<>/") + r"|(?<!-)-{10,}+[^-][\s\S]*-{10}",
)
#: Words whose sentences are dropped from a biography; blanks inside are missing, as the matched results have it.
CAREER = (
    r"belllab|join|staff|author|co[-]?author|journal|conference|paper|patent|fellow|chair|member|institute|IEEE|academy|editor|"
    r"committee|award|ph\.?d|msc|m\.s\.|bsc|b\.s\.|degree|born|child|grew|editor|chief|board|medal|director|world|international|"
    r"inc\.|startup|cto|founder"
)
#: The same with its blanks.
CAREER_SPACED = CAREER.replace("belllab", "bell lab").replace("|cto|", "|cto |")
R_STOP_WORDS_ADDED = "tel po cc bcc am pm subject thanks tkx thank regards best good"

MAIL = [RECIPIENTS, OTHER_HEADERS, DISCLAIMER, ORIGINAL_MESSAGE, RULED_BLOCK]
STRIP = [LINKS, MAIL_ADDRESSES, FILE_NAMES, NUMBERS]
KEA = [*STRIP, BREAKS_TO_BLANKS, PUNCTUATION_KEA, APART_LEFT_KEA, APART_RIGHT_KEA]
LDA = [BREAKS_TO_SENTENCES, NUMBERS, PUNCTUATION_LDA, APART_LEFT_LDA, APART_RIGHT_LDA]


def printable(text: Column) -> Column:
    """Only printable ASCII and white space stay."""
    return PRINTABLE(text)


def mail_clean(text: Column) -> Column:
    """Headers, disclaimer, quoting rule and ruled blocks go."""
    return chain(text, MAIL)


def kea_clean(text: Column, mail: bool = True) -> Column:
    """Printable text without mail boilerplate, links, addresses, files, numbers; sentence marks set apart."""
    return chain(printable(text), [*(MAIL if mail else []), *KEA])


def lda_clean(text: Column, infer: bool = False) -> Column:
    """Line breaks end sentences; numbers and punctuation go. infer: white space is collapsed too, as for new texts."""
    return chain(text, LDA + ([ONE_SPACE, LEFT_TRIM] if infer else []))


def lower_if_upper(sentence: Column) -> Column:
    """A sentence without a lower-case letter is lower-cased."""
    return F.when(sentence.rlike(ALL_UPPER), F.lower(sentence)).otherwise(sentence)


def is_abbreviation(word: Column) -> Column:
    return word.rlike(ABBREVIATION)


def r_steps(stop_words: list[str]) -> list[Step]:
    """Normaliser of lower-cased text: addresses, links, stop words, then punctuation and digits except quotes."""
    return [
        Step(r"[a-z][!-~]*@[!-~]+ ", " ", r"(?:(?<![!-~])|\G)([!-`{-~]*+)[a-z][!-~]*@[!-~]+ ", "$1 "),
        Step(r"[a-z]+://[!-~]+", " ", r"(?<![a-z])[a-z]++://[!-~]+"),
        Step(r"\b(" + "|".join(stop_words) + r")\b"),
        Step(r"[\x21\x23-\x26\x28-\x40\x5b-\x60\x7b-\x7f]+", " "),
    ]


def r_normalise(text: Column, stop_words: list[str]) -> Column:
    return chain(F.lower(text), r_steps(stop_words))


def without_punctuation(key: Column, lower: bool = True) -> Column:
    return F.regexp_replace(F.lower(key) if lower else key, r"[!-/:-@\[-`{-~]+", "")


def sections(text: Column) -> Column:
    """struct<interests, publications> of a text with #### (interests), &&&& (ignored) and @@@@ (publications) markers.

    A section runs to the next marker; the last of a kind counts; a kind that is absent is null.
    """
    marked = F.regexp_replace(text, r"(####|&&&&|@@@@)", "\x01$1")
    parts = F.split(marked, "\x01")

    def last(marker: str) -> Column:
        own = F.filter(parts, lambda p: p.startswith(marker))
        return F.when(F.size(own) > 0, F.substring(F.element_at(own, -1), 5, 2_000_000_000))

    return F.struct(last("####").alias("interests"), last("@@@@").alias("publications"))


def stem_of(path: Column) -> Column:
    """The file name without folders, a _bio mark and its extension."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", ""), r"_bio$", "")


def normal_name(name: str) -> str:
    """A column name in lower case, dots as underscores, the first minus sign as "na"."""
    return name.lower().replace(".", "_").replace("-", "na", 1)
