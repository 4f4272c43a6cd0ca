"""Near copies of five-word shingles against brute force over all pairs, also where long lists are taken in steps."""

import random
from collections import Counter

import pytest

from loomwright.llm import shingles, simhash

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(texts):
    """{text: its class}, classes connected by pairs of similarity 0.8 or more."""
    sets = {}
    for x in set(texts):
        w = x.translate(LOWER).split()
        sets[x] = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    up = {x: x for x in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = sorted(sets)
    for i, x in enumerate(held):
        for y in held[:i]:
            both = len(sets[x] & sets[y])
            if 10 * both >= 8 * (len(sets[x]) + len(sets[y]) - both):
                up[root(x)] = root(y)
    return {x: root(x) for x in held}


def want(rows):
    roots = brute([x for _, x in rows])
    least = {}
    for k, x in rows:
        least[roots[x]] = min(k, least.get(roots[x], k))
    return Counter((k, least[roots[x]]) for k, x in rows)


def edited():
    """Groups of copies with one to three words replaced, unlike texts around one passage, and short ones."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = ["", " \n", "one two", "One two", "one two three"]
    for size, length, edits in ((60, 60, 1), (25, 200, 3), (6, 30, 1)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for at in r.sample(range(length), r.randint(0, edits)):
                own[at] = word()
            texts.append(" ".join(own))
    passage = [word() for _ in range(30)]
    texts += [" ".join([*passage, *(word() for _ in range(r.randint(2, 12)))]) for _ in range(60)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("cap, rounds", [(1000, 4), (3, 1)])
def test_components(spark, cap, rounds):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, simhash.similar_components(docs, cap=cap, rounds=rounds).select("doc_id", "component_id").collect()))
    assert got == want(rows)


def test_ids_may_repeat_or_lack(spark):
    near = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(3, near), (7, near), (7, "quite another text of its own"), (7, near + " u"), (None, near), (None, "x y z"), (None, "X y  z"), (2, "one"), (2, "one"), (2, "ONE"), (9, None), (8, "")]
    docs = spark.createDataFrame([(k, x, "g", 1, 2) for k, x in rows], "doc_id long, text string, th string, node int, of_id int").repartition(3)
    found = simhash.drop_near_copies(docs)
    assert found.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in found.collect())
    assert sum(got.values()) == 5 and got[3, near] == got[7, "quite another text of its own"] == got[8, ""] == 1
    assert sum(got[k, x] for k, x in ((None, "x y z"), (None, "X y  z"))) == 1 and got[2, "one"] + got[2, "ONE"] == 1
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


def test_comparisons_follow_the_group(spark, monkeypatch):
    """An original and copies with up to four words of 146 replaced, many pairs below 0.8: few comparisons for each, not one for each pair."""
    tried, verified = [], shingles.verified

    def counted(pairs, *rest):
        tried.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "verified", counted)
    r = random.Random(9)
    base, rows = [f"w{k}" for k in range(146)], []
    for k in range(250):
        own = list(base)
        for at in r.sample(range(146), r.randint(1, 4)):
            own[at] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    rows.append((len(rows), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, simhash.similar_components(docs).select("doc_id", "component_id").collect()))
    assert got == want(rows)
    assert sum(tried) < 5 * len(rows)
