"""The pipeline stage by stage against brute force: what goes, what stays, and what the last stage says of it."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from loomwright.llm import mixing, toxicity
from tests.llm.test_contracts import awkward, bare, library
from tests.llm.test_shingles import want as want_near


@pytest.fixture(scope="module", params=["sf0.001", "awkward"])
def where(request, spark, tmp_path_factory):
    return "/root/testdata/sf0.001" if request.param == "sf0.001" else awkward(spark, tmp_path_factory.mktemp("awkward"))


def key(r):
    return (r.doc_id, r.text, r.source)


def test_stages(spark, where, tmp_path):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, now, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, where).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == corpus_pipeline.STAGES[-1][0] or now.columns == columns
        kept[name] = now.collect()
    model = toxicity.learn(docs, spark.read.parquet(f"{where}/labels.parquet"))
    clean = [r for r in docs.collect() if model.score(r.text or "") < 0.3]
    assert Counter(map(key, kept["toxicity"])) == Counter(map(key, clean))

    largest = {}
    for r in clean:
        largest[r.text or ""] = max(largest.get(r.text or "", r.doc_id), r.doc_id)
    once = {(r.doc_id, r.text or "") for r in clean if r.doc_id == largest[r.text or ""]}
    assert Counter((r.doc_id, r.text or "") for r in kept["exact_dedup"]) == Counter(once)

    apart = Counter(k for k, least in want_near(sorted(once)).elements() if k == least)
    assert Counter(r.doc_id for r in kept["simhash_near_dedup"]) == apart

    near = kept["simhash_near_dedup"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in near}
    total = defaultdict(int)
    for r in near:
        total[r.source] += size[r.doc_id]
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    target = dict(zip(names, mixing.targets([total[s] for s in names], [k % 3 + 1 for k in range(len(names))])))
    times, got = Counter(r.doc_id for r in kept["mix_sources"]), Counter()
    for r in kept["mix_sources"]:
        got[r.source] += size[r.doc_id]
    assert set(times) <= set(size) and max(times.values()) <= 3
    most = max(size.values())
    assert all(abs(got[s] - target[s]) <= 2 * most + 64 for s in names)

    t, want = library(), Counter()
    for r in kept["mix_sources"]:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[r.doc_id, r.source, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, kept["bpe_encode_decode"])) == want


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, bare(spark, tmp_path)).collect() == []


def test_reruns_agree(spark, small):
    once, again = (Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) for _ in range(2))
    assert once == again
