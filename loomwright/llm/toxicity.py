"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into symbols: insult, threat, target, negation, report, quote mark and
other. Three small transducers rewrite them: one marks what stands in the scope of a negation, one what is reported or
quoted, one what is aimed at somebody. Their composition is one automaton, which reads a clause once and emits, at each
insult or threat, its kind and marks. A document's score is a logistic function of the weights that its matched clauses
emit, summed by kind and marks; a negated or reported insult thus has another weight than a plain one.

The insult lexicon (words and stems) and the weights are learned from a bounded sample of labelled rows. Only words and
marks go into a score; language, source and identifier don't.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = "other", "insult", "threat", "target", "negation", "report", "quote", "end"
SYMBOLS = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END]
#: Closed-class words and threat verbs of four languages.
CLASSES = {
    TARGET: "you your you're he she they them him her his their du dich dir dein deine ihr euch euer er sie tu toi vous votre ton ils elles lui leur usted ustedes vosotros ellos ellas tú tu eres",
    NEGATION: "not never no neither nor isn't aren't wasn't don't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say called calls wrote writes quoted claimed claims according reported sagte sagt nannte schrieb laut dit disait écrit appelé selon dijo dice llamó escribió según",
    THREAT: "kill murder strangle slaughter hurt töten umbringen ermorden verprügeln tuer assassiner frapper matar asesinar golpear",
}
SEEDS = ("idiot", "moron", "imbecile", "scumbag", "bastard", "trottel", "vollidiot", "dummkopf", "arschloch", "connard", "abruti", "salaud", "imbécile", "gilipollas", "cabrón", "estúpido")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]|[\"“”«»„]")
LETTERS = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;\n]")
#: Lengths of the stems that are tried, besides whole words.
STEMS = (4, 5, 6, 7, 8)


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, output); where there is none, the symbol is copied and the state stays. Start: 0."""

    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def symbols(marks: str = "") -> list[str]:
    """The kinds with every set of these marks."""
    return [kind + "".join(m for m, on in zip(marks, x, strict=True) if on) for kind in (INSULT, THREAT) for x in product((0, 1), repeat=len(marks))]


def scope(opener: str, mark: str, reach: int, kinds: list[str]) -> Transducer:
    """Marks the kinds that follow an opener by at most ``reach`` other symbols in the same clause."""
    t = Transducer()
    for left in range(reach + 1):
        t.arcs[left, opener] = (reach, opener)
        t.arcs[left, END] = (0, END)
        for symbol in [*SYMBOLS, *kinds]:
            if symbol in (opener, END):
                continue
            t.arcs[left, symbol] = (max(left - 1, 0), symbol + mark if left and symbol in kinds else symbol)
    return t


def quotation(mark: str, kinds: list[str]) -> Transducer:
    """Marks the kinds inside quote marks; a quotation ends with its clause at the latest."""
    t = Transducer()
    t.arcs |= {(0, QUOTE): (1, QUOTE), (1, QUOTE): (0, QUOTE), (1, END): (0, END)}
    t.arcs |= {(1, k): (1, k + mark) for k in kinds}
    return t


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The transducer that reads what first reads and gives what second makes of its output; states are pairs."""
    made, todo, seen = Transducer(), [0], {0}
    pair = lambda s: (0, 0) if s == 0 else s
    while todo:
        state = todo.pop()
        a, b = pair(state)
        for symbol in alphabet:
            a2, middle = first.step(a, symbol)
            b2, out = second.step(b, middle)
            after = 0 if (a2, b2) == (0, 0) else (a2, b2)
            made.arcs[state, symbol] = (after, out)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return made


def grammar() -> Transducer:
    """negation ∘ report ∘ quotation ∘ target, read from the left."""
    t = compose(scope(NEGATION, "-", 3, symbols()), scope(REPORT, "~", 6, symbols("-")), SYMBOLS)
    t = compose(t, quotation('"', symbols("-~")), SYMBOLS)
    return compose(t, scope(TARGET, "!", 5, [k + q for k in symbols("-~") for q in ("", '"')]), SYMBOLS)


#: What the grammar can emit, in order: kind, negated, reported or quoted, aimed.
FEATURES = [(kind, n, r, t) for kind in (INSULT, THREAT) for n in (0, 1) for r in (0, 1) for t in (0, 1)]


#: Where the labels say little about a feature, its weight stays near this one.
PRIOR = np.array([(1.0 if n else 1.5 if r else 3.0 + 0.5 * t) if kind == INSULT else (0.0 if n or r else 0.5 + 2.5 * t) for kind, n, r, t in FEATURES])


def feature(symbol: str) -> int:
    kind = INSULT if symbol.startswith(INSULT) else THREAT
    return FEATURES.index((kind, int("-" in symbol), int("~" in symbol or '"' in symbol), int("!" in symbol)))


class Grammar:
    """A lexicon (entries: word "word$" or stem "stem", each with a weight) with the composed transducer."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None = None, bias: float = -2.5):
        import ahocorasick

        self.lexicon = lexicon
        self.weights = PRIOR if weights is None else weights
        self.bias = bias
        self.classes = {w: c for c, ws in CLASSES.items() for w in ws.split()}
        self.arcs = grammar().arcs
        self.emits = {out: feature(out) for _, out in self.arcs.values() if out.startswith((INSULT, THREAT))}
        self.search = ahocorasick.Automaton()
        for entry in {x.rstrip("$") for x in lexicon} | set(CLASSES[THREAT].split()):
            self.search.add_word(entry, len(entry))
        self.search.make_automaton()

    def lookup(self, word: str) -> tuple[str, float]:
        if (weight := self.lexicon.get(f"{word}$")) is not None:
            return INSULT, weight
        for n in STEMS:
            if n <= len(word) and (weight := self.lexicon.get(word[:n])) is not None:
                return INSULT, weight
        return self.classes.get(word, OTHER), 1.0

    def features(self, text: str) -> np.ndarray:
        """Weights emitted by kind and marks, dampened by a logarithm."""
        sums, low, done = [0.0] * len(FEATURES), text.lower(), -1
        for end, size in self.search.iter(low):
            start = end - size + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            # the clause can't begin before the end of the last one, so each character is searched once at most
            a = max(done, max(low.rfind(c, max(done, 0), start) for c in ".!?;\n") + 1, 0)
            stop = CLAUSE.search(low, start)
            done = stop.end() if stop else len(low)
            state = 0
            for word in WORD.findall(low, a, done):
                symbol, weight = (END if word in ".!?;\n" else QUOTE, 1.0) if not word[0].isalpha() else self.lookup(word)
                state, out = self.arcs[state, symbol]
                if out in self.emits:
                    sums[self.emits[out]] += weight
        return np.log1p(np.array(sums))

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(min(z, 60), -60)))


def entries(text: str) -> set[str]:
    """The words ("word$") and stems of a text."""
    words = set(LETTERS.findall(text.lower()))
    return {f"{w}$" for w in words if len(w) > 3} | {w[:n] for w in words for n in STEMS if len(w) > n}


def choose(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, min_support: int = 6, min_odds: float = 3.0) -> dict[str, float]:
    """Lexicon of the entries that toxic texts have far more often; a stem only where no longer entry explains it."""
    odds = {x: math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1)) for x, (a, b) in counts.items()}
    good = {x for x in counts if counts[x][0] >= min_support and odds[x] >= min_odds}
    best: dict[str, int] = Counter()
    for x in good:
        bare = x.rstrip("$")
        for n in STEMS:
            if n < len(bare) or n == len(bare) and x.endswith("$"):
                best[bare[:n]] = max(best[bare[:n]], counts[x][0])
    kept = {x for x in good if x.endswith("$") or best[x] < 0.95 * counts[x][0]}
    covered = lambda x: any(x.rstrip("$")[:n] in kept for n in STEMS if n < len(x))
    return {x: min(odds[x], 6.0) / 3 for x in sorted(kept) if not covered(x)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; the ridge pulls weights towards PRIOR and leaves the bias alone."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep, prior = np.append(PRIOR, -2.5), np.append(np.full(x.shape[1] - 1, ridge), 1e-6), np.append(PRIOR, 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


#: Least hashes of a signature, and how many of them make a band.
HASHES, BAND = 16, 4
_TURNS = np.random.default_rng(7).integers(0, 1 << 63, (2, HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: str) -> list[int]:
    """The least values of a text's word triples under HASHES hash functions: texts agree in a share of them that estimates their similarity."""
    words = text.lower().split()
    triples = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [tuple(words)]
    found = np.array([xxhash.xxh64_intdigest(" ".join(t)) for t in triples], np.uint64)
    return (_TURNS[0] * found + _TURNS[1]).min(axis=1).view(np.int64).tolist()


def near_copies(rows: DataFrame) -> DataFrame:
    """(own_id, th) of rows (own_id, th, toxic, sketch) that agree in half of their signature with the first row, by id, of some band they share with it."""
    keys = F.array(*(F.xxhash64(F.slice("sketch", k + 1, BAND)) for k in range(0, HASHES, BAND)))
    banded = rows.select("own_id", "th", "toxic", "sketch", F.posexplode(keys).alias("band", "key"))
    lead = F.first(F.struct("own_id", "th", "sketch")).over(Window.partitionBy("toxic", "band", "key").orderBy("own_id", "th"))
    alike = F.size(F.filter(F.zip_with("sketch", "lead.sketch", lambda x, y: x == y), lambda same: same)) * 2 >= HASHES
    other = (F.col("own_id") != F.col("lead.own_id")) | (F.col("th") != F.col("lead.th"))
    return banded.withColumn("lead", lead).filter(other & alike).select("own_id", "th").distinct()


def in_fold(id_col: str = "doc_id"):
    """Held out: crc32 of the id as text leaves 2 modulo 4. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def _mapped(df: DataFrame, make, schema: str, names: list[str]) -> DataFrame:
    """make(list of texts, record batch) gives the columns."""

    def run(batches):
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(0)]
            yield pa.record_batch(make(texts, batch), names=names)

    return df.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 12_000) -> Grammar:
    """The grammar with its lexicon and weights from at most max_labelled labelled rows outside the held-out fold.

    max_labelled is the documented bound of the sample: the rows with the least seeded hash of their id. Of near
    copies among them the one with the least id counts. The same rows give the same grammar however they're partitioned. Without labels of both classes, seed words and fixed weights are used.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & ~in_fold(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").alias("toxic"))
    drawn = durable(marked.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled), "labelled")
    # at most max_labelled rows of two numbers: a proven bound for the broadcast
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text"))
    texts = own.join(F.broadcast(drawn), F.col("own_id") == F.col("label_id")).select("text", F.col("toxic").cast("int").alias("toxic"), "own_id")
    kind = texts.schema["own_id"].dataType.simpleString()
    names = ["text", "toxic", "own_id", "sketch"]
    keyed = _mapped(texts, lambda t, b: [*b.columns, pa.array([signature(x) for x in t], pa.list_(pa.int64()))], f"text string, toxic int, own_id {kind}, sketch array<bigint>", names)
    keyed = durable(keyed.withColumn("th", F.xxhash64("text")), "sketched")
    copies = durable(near_copies(keyed), "copies")
    # dealt out again, as what follows is heavy by row; the table is bounded
    spread = keyed.join(F.broadcast(copies), ["own_id", "th"], "left_anti").repartition(docs.sparkSession.sparkContext.defaultParallelism, "own_id", "th")
    sample = durable(spread.dropDuplicates(["own_id", "th"]).select("text", "toxic"), "sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Grammar({f"{w}$": 2.0 for w in SEEDS})

    def count(texts, batch):
        found = (Counter(), Counter())
        for text, toxic in zip(texts, batch.column(1).to_pylist(), strict=True):
            found[toxic].update(entries(text))
        names = sorted({*found[0], *found[1]})
        return [pa.array(names, pa.string()), *(pa.array([found[k][x] for x in names], pa.int64()) for k in (1, 0))]

    tallied = _mapped(sample, count, "entry string, a bigint, b bigint", ["entry", "a", "b"]).groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rare = F.col("a") * totals[0] >= 10 * F.col("b") * totals[1]
    seeds = tallied.filter(F.col("entry").isin([f"{w}$" for w in SEEDS]))
    counts = {r["entry"]: (r["a"], r["b"]) for r in tallied.filter((F.col("a") >= 6) & rare).unionByName(seeds).distinct().collect()}
    lexicon = {f"{w}$": 2.0 for w in SEEDS if counts.get(f"{w}$", (0, 0))[1] <= counts.get(f"{w}$", (0, 0))[0]}
    lexicon |= choose(counts, totals[1], totals[0])
    plain = Grammar(lexicon)
    names = [f"f{k}" for k in range(len(FEATURES))]
    made = _mapped(
        sample,
        lambda t, b: [b.column(1), *map(pa.array, np.array([_grammar(lexicon).features(x) for x in t]).reshape(-1, len(FEATURES)).T.copy())],
        "toxic int, " + ", ".join(f"{x} double" for x in names),
        ["toxic", *names],
    )
    rows = np.array(made.collect(), float)
    order = np.lexsort(rows.T)
    plain.weights, plain.bias = logistic(rows[order, 1:], rows[order, 0])
    return plain


_MADE: dict = {}


def _grammar(lexicon, weights=None, bias: float = 0.0) -> Grammar:
    """One automaton for each Python worker and lexicon."""
    key = (tuple(lexicon.items()), bias)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Grammar(lexicon, weights, bias)
    return _MADE[key]


def score_documents(docs: DataFrame, model: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted (1 from the threshold on).

    Whole texts are read. Null and empty texts have no clause and get the score of a text without matches. Rows stay as
    many as they are; an empty table gives an empty result; other columns are ignored.
    """
    lexicon, weights, bias = model.lexicon, model.weights, model.bias

    def make(texts, batch):
        g = _grammar(lexicon, weights, bias)
        return [batch.column(1), pa.array([g.score(x) for x in texts], pa.float64())]

    kind = docs.schema[id_col].dataType.simpleString()
    scored = _mapped(docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col)), make, f"`{id_col}` {kind}, score double", [id_col, "score"])
    return scored.select(id_col, in_fold(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Grammar, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose text scores at or above the threshold; columns unchanged."""
    lexicon, weights, bias = model.lexicon, model.weights, model.bias
    at = docs.columns.index(text_col)

    def run(batches):
        g = _grammar(lexicon, weights, bias)
        for batch in batches:
            yield batch.filter(pa.array([g.score(v.as_py() or "") < threshold for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
