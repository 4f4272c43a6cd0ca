"""The backoff tagger against a plain version that counts contexts one by one."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomwright.operators.tagger import STAGES, BackoffTagger, context_of


def plain(sentences, base, cutoff):
    tables = {}

    def guess(words, at, history):
        for stage in reversed([s for s in STAGES if s in tables]):
            c = context_of(stage, words[at], history)
            if c is not None and c in tables[stage]:
                return tables[stage][c]
        return base(words[at])

    for stage in STAGES:
        counts, useful = defaultdict(Counter), set()
        for sentence in sentences:
            words, tags = [w for w, _ in sentence], [t for _, t in sentence]
            for k, tag in enumerate(tags):
                c = context_of(stage, words[k], tags[:k])
                if tag is None or c is None:
                    continue
                counts[c][tag] += 1
                if guess(words, k, tags[:k]) != tag:
                    useful.add(c)
        found = {}
        for c in useful:
            n, tag = min((-n, t) for t, n in counts[c].items())
            if -n > cutoff:
                found[c] = tag
        tables[stage] = found
    return tables


def corpus():
    rng = random.Random(6)
    words = ["walking", "talking", "table", "run", "runs", "the", "a", "can", "light", "Cabling"]
    return [[(w, rng.choice(["NN", "VB", "JJ", None] if w in ("run", "light", "can") else ["DT"] if len(w) < 4 else ["NN", "VBG"])) for w in (rng.choice(words) for _ in range(rng.randint(1, 9)))] for _ in range(120)]


def test_training_and_tagging(spark, tmp_path):
    sentences = corpus()
    rows = spark.createDataFrame([(k, [{"word": w, "tag": t} for w, t in s]) for k, s in enumerate(sentences)], "doc_id long, words array<struct<word:string,tag:string>>")
    base = F.when(F.col("word").endswith("ing"), "VBG")
    for cutoff in (0, 3):
        model = BackoffTagger.train(rows.repartition(5), base, cutoff)
        assert model.tables == plain(sentences, lambda w: "VBG" if w.endswith("ing") else None, cutoff)
    model.save(spark, f"{tmp_path}/tagger")
    assert BackoffTagger.load(spark, f"{tmp_path}/tagger").tables == model.tables
    guessed = [[(w, "VBG" if w.endswith("ing") else None) for w, _ in s] for s in sentences]
    fresh = spark.createDataFrame([(k, [{"word": w, "tag": t} for w, t in s]) for k, s in enumerate(guessed)], rows.schema)
    got = {r.doc_id: [p.tag for p in r.words] for r in model.apply(fresh).collect()}
    for k, s in enumerate(guessed):
        tags = []
        for w, otherwise in s:
            found = [model.tables[x][c] for x in reversed(STAGES) if (c := context_of(x, w, tags)) in model.tables[x]]
            tags.append(found[0] if found else otherwise)
        assert got[k] == tags
    assert BackoffTagger.train(rows.limit(0)).tables == {s: {} for s in STAGES}
