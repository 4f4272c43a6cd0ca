"""License scans: an Aho-Corasick automaton finds phrases and identifier tags, a shunting-yard parser evaluates expressions.

The automaton runs once over each text's words, joined by single blanks, so that a phrase matches however its words are
spaced or set off. Texts with an ``SPDX-License-Identifier`` tag are looked at again for the expression behind the tag.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: A-Z lower-cased; every other ASCII character but 0-9 and a-z becomes a blank; bytes of other characters stay.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The method's own phrases: notices and names that say a licence, with the weight of each in the score.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.9),
    "licensed under the mit": ("mit", 0.7),
    "apache 2 0": ("apache", 0.5),
    "apache software license": ("apache", 0.8),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "boost software license": ("bsl", 0.9),
    "this is free and unencumbered software": ("unlicense", 0.9),
    "public domain": ("public-domain", 0.4),
    "creative commons": ("cc", 0.6),
    "cc by": ("cc-by", 0.6),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "cc0 1 0": ("cc0", 0.7),
    "all rights reserved": ("proprietary", 0.5),
    "spdx license identifier": ("", 0.0),
}
TAG = re.compile(rb"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n*]*)", re.IGNORECASE)
ITEM = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
#: How strongly each operator binds.
BINDS = {"or": 1, "and": 2, "with": 3}
KNOWN = set(BASE.values()) | {label for label, _ in NOTICES.values()} - {""}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "bsl", "unlicense", "cc0", "0bsd", "zlib", "python"}


def family(identifier: str) -> str:
    """The label of a licence identifier: its lower-cased name without a version behind a hyphen ("GPL-2.0-only": gpl; "W3C": w3c)."""
    return re.sub(r"(.)-v?\d[\d.]*(-.*)?$", r"\1", identifier.lower().rstrip("+"))


def names_licence(word: str) -> bool:
    """Whether a word behind an operator can be an identifier: it has a capital, a digit or a hyphen, or is a known name."""
    return word != word.lower() or bool(re.search(r"[\d-]", word)) or word in KNOWN


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in postfix order by the shunting-yard algorithm; None if it isn't one."""
    out: list[str] = []
    ops: list[str] = []
    operand = False  # whether the last item ended an operand
    items = ITEM.findall(text)
    for at, item in enumerate(items):
        word = item.lower()
        if word in BINDS:
            if not operand:
                return None
            following = next((x for x in items[at + 1 :] if x != "("), None)
            if following is not None and not names_licence(following):
                break  # "and", "or" or "with" of the prose behind the expression
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = False
        elif item == "(":
            if operand:
                return None
            ops.append(item)
        elif item == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops or not operand:
                return None
            ops.pop()
        else:
            if operand:
                break  # prose behind the expression
            out.append(item)
            operand = True
    while ops:
        if ops[-1] == "(":
            return None
        out.append(ops.pop())
    return out if out and operand else None


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The licence labels an expression names, and whether some choice it offers is permissive throughout."""
    stack: list[tuple[set[str], bool]] = []
    for item in postfix:
        if item in BINDS:
            (right, free), (left, own) = stack.pop(), stack.pop()
            # an exception (with) names no licence of its own and keeps what stands before it
            stack.append((left, own) if item == "with" else (left | right, own and free if item == "and" else own or free))
        else:
            stack.append(({family(item)}, family(item) in PERMISSIVE))
    return stack[-1]


@lru_cache(1)
def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def scan(raw: bytes) -> tuple:
    """(n_words, places, labels, expression, permissive, score) of a UTF-8 text; places: (first word, phrase) in order."""
    words = raw.translate(TO_WORDS).split()
    if not words:
        return 0, [], [], None, None, 0.0
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places, at, seen = [], 0, 0
    for end, phrase in automaton().iter(joined):
        start = end - len(phrase) - 1
        # blanks before the match, the first one not counted: overlapping matches may start before the last one
        if start >= at:
            seen, at = seen + joined.count(" ", at, start), start
            word = seen
        else:
            word = seen - joined.count(" ", start, at)
        places.append((word, phrase))
    places.sort()
    labels = {BASE[p] for _, p in places if p in BASE} | {NOTICES[p][0] for _, p in places if p in NOTICES} - {""}
    expression = permissive = None
    miss = 1.0
    for p in {p for _, p in places}:
        miss *= 1 - (NOTICES[p][1] if p in NOTICES else 0.8)
    if any(p == "spdx license identifier" for _, p in places):
        for found in TAG.finditer(raw):
            if postfix := parse_expression(found[1].decode("utf-8", "replace")):
                named, free = evaluate(postfix)
                labels |= named
                expression = " ".join(postfix) if expression is None else f"{expression}; {' '.join(postfix)}"
                permissive = free if permissive is None else permissive and free
                miss *= 0.02
    return len(words), places, sorted(labels), expression, permissive, round(1 - miss, 6)


NAMES = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expression string, permissive boolean"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, expression, permissive, places.

    places has every match as (word, phrase), words counted from 0. Null and empty texts have no words: counts and score
    are 0, labels are "" and the places null. expression is the postfix form of all tag expressions, null without one;
    permissive: whether each of them can be met by permissive licences alone. Rows stay as many as they are.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for v in batch.column(1).cast(pa.binary()):
                n, places, labels, expression, permissive, score = scan(v.as_py() or b"")
                base = [(w, p) for w, p in places if p in BASE]
                names = ",".join(sorted({BASE[p] for _, p in base}))
                rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, names, ",".join(labels), score, expression, permissive, [{"word": w, "phrase": p} for w, p in places]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            names = [id_col, *(x.split()[0] for x in NAMES.split(", ")), "places"]
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}`", f"cast(`{text_col}` as string) as `text`").mapInArrow(run, f"`{id_col}` {kind}, {NAMES}, places array<struct<word:bigint,phrase:string>>")
