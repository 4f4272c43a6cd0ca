"""The registered queries against brute-force versions, over whole tables and over a table of awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from loomwright.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, node long, kept string, size long, key string, blob string, run int, times int, label_id long, toxic int, row_id long, row string, own_id long, gone_id long, own_sha string, text_sha256 string, more boolean, shard int, h long"


def awkward(spark, folder) -> str:
    """A folder with documents of nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long = "alpha beta gamma delta " * 20_000 + "password = 'abcdefgh12' MIT License\n" + "é😀 " * 1000
    texts = {
        1: None, 2: "", 3: "   \n\t", 4: "one", 5: "one two", 6: "one two three", 7: "One Two THREE", 8: long, 9: long + "x",
        10: "mit license mit license apache license, the GNU General Public License\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH x",
        11: "token: abc token = 'abcdefgh' AKIA0123456789AB " + "0af" * 15 + " secret=passwd=12345678",
        12: "you are an idiot! You are not an idiot. <|endoftext|> ½ ²³ naïve 東京 👩‍👩‍👧  \x85 end", 13: "a b c d e f g h", 14: "a b c d e f g h", 15: "\x00 nul \x1f",
    }
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 5}", None, k, 1, 2, "x", 3, "k", "b", 4, 9, 12, 0, k, "r", k, k, "o", "t", True, 1, 5) for k, t in texts.items()]
    rows += [rows[3], rows[3], rows[12]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(12, 1, 1), (4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "http://user@A.B.example.com:80/x"), (2, None), (3, "no url"), (None, "https://example.com."), (5, "http://localhost/"), (5, "http://localhost/")]
    spark.createDataFrame([(k, u, None, "h", 1) for k, u in pages], "page_id long, url string, html string, host string, n_active int").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def bare(spark, folder) -> str:
    """A folder with empty tables."""
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module", params=["sf0.001", "awkward"])
def folder(request, spark, tmp_path_factory):
    return "/root/testdata/sf0.001" if request.param == "sf0.001" else awkward(spark, tmp_path_factory.mktemp("awkward"))


@pytest.fixture(scope="module")
def docs(folder):
    """(doc_id, text or "", source) of every row."""
    t = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    return [(k, x or "", s) for k, x, s in zip(t["doc_id"], t["text"], t["source"])]


def rows(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    return Counter(found)


rows_of = rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    where = bare(spark, tmp_path)
    for name, query in queries.QUERIES.items():
        assert query(spark, where).collect() == [], name


def test_row_counts(spark, folder, docs):
    for name, query in queries.QUERIES.items():
        if name not in ("op1_token_counts", "op6_url_filter"):
            assert query(spark, folder).count() == len(docs), name


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.no_padding()
    made.no_truncation()
    return made


def test_op1_sections_add_up(spark, folder, docs):
    t, want = library(), Counter()
    for k, text, _ in docs:
        e = t.encode(text, add_special_tokens=False)
        cuts = [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]
        ends = [*cuts[1:], len(text)]
        own, crossing = Counter(), Counter()
        for a, b in e.offsets:
            held = [(min(b, y) - max(a, x), -s) for s, (x, y) in enumerate(zip(cuts, ends)) if min(b, y) > max(a, x)] if a < b else [(1, -max(s for s, x in enumerate(cuts) if x <= a))]
            own[-max(held)[1]] += 1
            crossing[-max(held)[1]] += len(held) > 1
        for s, (x, y) in enumerate(zip(cuts, ends)):
            want[k, s, x, y, own[s], crossing[s], len(e.ids)] += 1
    got = rows(queries.op1_token_counts(spark, folder), "doc_id", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens")
    assert got == want


def test_op2_base(spark, folder, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    lower = {k: k + 32 for k in range(65, 91)}
    want = Counter()
    for k, text, _ in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        places, labels = [], set()
        for p, label in phrases.items():
            own = p.split()
            at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        want[k, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    found = queries.op2_license_scan(spark, folder)
    assert rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in found.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({k: k + 32 for k in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{fingerprint: least id}, by comparing all pairs of different fingerprints."""
    least, kinds = {}, sorted({f for _, f in prints})
    up = {f: f for f in kinds}

    def root(f):
        while up[f] != f:
            f = up[f] = up[up[f]]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    for k, f in prints:
        least[root(f)] = min(least.get(root(f), k), k)
    return {f: least[root(f)] for f in kinds}


def test_op3(spark, folder, docs):
    prints = [(k, brute_simhash(x)) for k, x, _ in docs]
    of = brute_components(prints)
    assert rows(queries.op3_simhash_near_dedup(spark, folder), "doc_id", "fingerprint", "component_id") == Counter((k, f"{f:016x}", of[f]) for k, f in prints)


def brute_sketch(text):
    """Hashes of five-word runs below 1/16 of the range, or the least one; a run's hash takes each word's as the next seed."""
    own = [xxhash.xxh64_intdigest(w, 42) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]

    def run(hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    runs = {run(own[i : i + 5]) for i in range(max(len(own) - 4, 1))} if own else set()
    kept = sorted(h for h in runs if h < 1 << 60)
    return kept or sorted(runs)[:1]


def test_op4_hashes(spark, folder, docs):
    printed = lambda hashes: "".join(f"{h:016x}"[4:] for h in hashes)
    alike = lambda a, b: len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(len(a) == len(b))
    found = {r.doc_id: r for r in queries.op4_document_fingerprints(spark, folder).collect()}
    ordered = sorted({(k, x) for k, x, _ in docs})
    for n, (k, text) in enumerate(ordered):
        own, following = brute_sketch(text), ordered[(n + 1) % len(ordered)]
        assert found[k].fingerprint == printed(own), k
        if following[0] not in [k for k, c in Counter(k for k, *_ in docs).items() if c > 1] and k not in (4, 13):
            assert found[k].near_next == pytest.approx(alike(own, brute_sketch(following[1]))), k


def test_op4(spark, folder, docs):
    found = {r.doc_id: r for r in queries.op4_document_fingerprints(spark, folder).collect()}
    ordered = sorted({(k, x) for k, x, _ in docs})
    repeated = {k for k, n in Counter(k for k, *_ in docs).items() if n > 1}
    for n, (k, text) in enumerate(ordered):
        following = text if k in repeated else ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[k]
        if k not in repeated:
            assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited)), k
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1 and r.near_edited == 1) if text == following and edited == text else True
    by_text = defaultdict(set)
    for k, text in ordered:
        by_text[text].add(found[k].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    for r in found.values():
        own, other = (set(re.findall(".{12}", x)) for x in (r.fingerprint, r.edited_fingerprint))
        least = min(len(own), len(other))
        assert r.near_edited == pytest.approx(len(own & other) / least if least else float(len(own) == len(other)))


def test_op5(spark, folder, docs):
    sizes = Counter()
    for _, x, s in docs:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", x))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, fixed = {}, {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = sum(w for s, w in weight.items() if s not in fixed)
        target = fixed | {s: rest * w / free for s, w in weight.items() if s not in fixed}
        above = {s: 3.0 * sizes[s] for s in target if s not in fixed and target[s] > 3 * sizes[s]}
        if not above:
            break
        fixed |= above
    found = queries.op5_mix_sources(spark, folder).collect()
    again = queries.op5_mix_sources(spark, folder).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    source = {k: s for k, _, s in docs}
    taken = Counter()
    for r in found:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
    for s in names:
        assert abs(taken[s] - target[s]) <= max(64, 0.01 * target[s])


def chained(*values):
    """Spark's xxhash64 of a row: each value's hash is the next one's seed; nulls are passed over. Integers come as bytes."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_op5_quotas_and_blocks(spark, folder, docs):
    four, eight = (lambda k: k.to_bytes(4, "little", signed=True)), (lambda k: k.to_bytes(8, "little", signed=True))
    rows = [(k, s, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x, s in docs]
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    sizes = {s: sum(n for _, t, n in rows if t == s) for s in names}
    targets = dict(zip(names, mixing.targets([sizes[s] for s in names], [k % 3 + 1 for k in range(len(names))])))
    live = [s for s in names if sizes[s]]
    blocks = {s: -(-sizes[s] // 16) for s in live}
    share = {s: targets[s] / 16 for s in live}
    quota = {s: 0 for s in live}
    for _ in range(round(sum(share.values()))):
        best = max((s for s in live if quota[s] < 3 * blocks[s]), key=lambda s: (share[s] / (2 * quota[s] + 1), -names.index(s)))
        quota[best] += 1
    want = Counter()
    for s in names:
        stream = sorted((chained(four(7), eight(k), eight(n)), k, n) for k, t, n in rows if t == s)
        start = 0
        for _, k, n in stream:
            taken = 0
            if n:
                times, more = divmod(quota[s], blocks[s])
                lead = chained(four(7), s, four(0)) % blocks[s]
                again = {b % blocks[s] for b in range(lead, lead + more)}
                taken = n * times + sum((w // 16) in again for w in range(start, start + n))
            want[k, n, sizes[s], taken] += 1
            start += n
    assert rows_of(queries.op5_mix_sources(spark, folder), "doc_id", "size", "source_size", "taken") == want


def test_op7(spark, folder, docs):
    ids = defaultdict(list)
    for k, x, _ in docs:
        ids[x].append(k)
    want = Counter((k, max(ids[x]), len(ids[x]), k == max(ids[x]), sha(x)) for k, x, _ in docs)
    assert rows(queries.op7_exact_dedup(spark, folder), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_op8_base(spark, folder, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    want = Counter()
    for k, x, _ in docs:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
        n = [sum(s[1] == j for s in spans) for j in range(3)]
        want[k, *n, sha(",".join(f"{('assign', 'access', 'hex')[j]}:{a}:{b}" for a, j, b in sorted(spans)))] += 1
    found = queries.op8_secret_scan(spark, folder)
    assert rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    for r in found.collect():
        kept = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert sha(",".join(kept)) == r.base_sha256


def test_op9(spark, folder, docs):
    t = library()
    want = Counter()
    for k, x, _ in docs:
        ids = t.encode(x, add_special_tokens=False).ids
        want[k, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert rows(queries.op9_bpe_encode_decode(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op10_contract(spark, folder):
    for r in queries.op10_toxicity(spark, folder).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op10_held_out_accuracy(spark):
    where = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{where}/labels.parquet").dropna(subset=["doc_id", "toxic"]).set_index("doc_id").toxic
    found = [r for r in queries.op10_toxicity(spark, where).collect() if r.held_out and r.doc_id in labels.index]
    toxic = [r.predicted for r in found if labels[r.doc_id] == 1]
    clean = [r.predicted for r in found if labels[r.doc_id] == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_op6_against_sql(spark, folder):
    import duckdb

    from loomwright.llm import url_filter

    con = duckdb.connect()
    path = f"{folder}/pages.parquet"
    con.sql(f"create view pages as from '{path}{'/*.parquet' if 'sf0' not in folder else ''}'")
    columns = ["page_id", "url", "day", "host", "n_active", "matched_entry", "verdict", "blocked"]
    want = con.sql(f"select {', '.join(columns)} from ({url_filter.SQL})").fetchall()
    if "sf0" in folder:  # the SQL joins on page_id, which the awkward table repeats
        assert rows(queries.op6_url_filter(spark, folder), *columns) == Counter(want)
    else:
        assert queries.op6_url_filter(spark, folder).count() == 6
