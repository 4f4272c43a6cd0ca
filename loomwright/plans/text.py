"""Text queries: cleaning chains, language, tags, phrases, dictionary, keyphrases, phrase weights, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import lexicon as L
from loomwright.functions import nlp
from loomwright.operators import chunker, keyphrases, phrasecloud, tagger, topics
from loomwright.plans.catalog import QUERIES, SQL, query, table
from loomwright.session import durable

CLEAN = C.PRINTABLE.sql("text")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", spread=True)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


@query("size_filter", "SELECT lang, count(*) AS n_docs, count(*) FILTER (strlen(text) < 1000) AS n_small, count(*) FILTER (strlen(text) >= 1000) AS n_kept, sum(CASE WHEN strlen(text) >= 1000 THEN strlen(text) ELSE 0 END)::BIGINT AS kept_bytes FROM documents GROUP BY lang")
def size_filter(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    return texts(spark, sf).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(size < 1000).alias("n_small"), F.count_if(size >= 1000).alias("n_kept"), F.sum(F.when(size >= 1000, size).otherwise(0)).cast("long").alias("kept_bytes")
    )


#: Chains of cleaning steps over printable text.
CHAINS = {
    "printable_clean": [],
    "url_email_strip": [C.LINKS, C.MAIL_ADDRESSES],
    "file_number_strip": [C.FILE_NAMES, C.NUMBERS],
    "punct_kea_chain": [C.BREAKS_TO_BLANKS, C.PUNCTUATION_KEA, C.APART_LEFT_KEA, C.APART_RIGHT_KEA],
    "punct_lda_chain": [C.BREAKS_TO_SENTENCES, C.PUNCTUATION_LDA, C.APART_LEFT_LDA, C.APART_RIGHT_LDA],
    "kea_clean_chain": [C.ORIGINAL_MESSAGE, C.DISCLAIMER, *C.KEA],
    "lda_clean_chain": C.LDA,
    "infer_ws_normalise": [*C.LDA, C.ONE_SPACE, C.LEFT_TRIM],
    "quote_left_join": [C.NO_SPACE_BEFORE_QUOTE],
}


def _register_chain(name: str, steps: list[C.Step]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return texts(spark, sf).select("doc_id", C.chain(C.printable(F.col("text")), steps).alias("clean"))

    query(name, f"SELECT doc_id, {C.chain_sql(CLEAN, steps)} AS clean FROM documents")(run)


for _name, _steps in CHAINS.items():
    _register_chain(_name, _steps)


@query("mail_headers")
def mail_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Looks ahead and back, which DuckDB's engine can't."""
    return table(spark, sf, "conversations").select("conv_id", "turn", C.mail_clean(C.printable(F.col("text"))).alias("clean"))


R_STOP = [*L.STOP_WORDS["en"], *C.R_STOP_WORDS_ADDED.split()]


@query("r_map01", f"SELECT doc_id, {C.chain_sql(f'lower({CLEAN})', C.r_steps(R_STOP))} AS clean FROM documents")
def r_map01(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", C.r_normalise(C.printable(F.col("text")), R_STOP).alias("clean"))


def sentences_sql(text: str) -> str:
    ends = nlp.BLANKS.sql(text)
    return f"list_filter(string_split(regexp_replace({ends}, '([.!?])[ ]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '')"


@query("sentence_split", f"SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest, len(list_filter(s, lambda x: regexp_matches(x, {q(C.ALL_UPPER)}))) AS n_upper FROM (SELECT doc_id, {sentences_sql(CLEAN)} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf).select("doc_id", nlp.sentences(C.printable(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest"), F.size(F.filter("s", lambda x: x.rlike(C.ALL_UPPER))).alias("n_upper"))


@query("treebank_tokens", f"SELECT doc_id, array_to_string(flatten(list_transform({sentences_sql(CLEAN)}, lambda s: list_filter(string_split({C.chain_sql(nlp.BLANKS.sql('s'), nlp.TREEBANK)}, ' '), lambda t: t <> ''))), ' ') AS tokens FROM documents")
def treebank_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = F.flatten(F.transform(nlp.sentences(C.printable(F.col("text"))), nlp.treebank_tokens))
    return texts(spark, sf).select("doc_id", F.array_join(found, " ").alias("tokens"))


@query("backoff_tags")
def backoff_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags by a tagger that is trained on the passages of benchmark, as the rules tag them; SQL can't fold tags over a sentence."""

    def sentences(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.explode(nlp.sentences(C.printable(F.col("text")))).alias("s")).select("doc_id", nlp.tagged(nlp.tokens(F.col("s"))).alias("words"))

    known = sentences(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    model = tagger.BackoffTagger.train(known, base=nlp.suffix_tag(F.col("word")))
    found = chunker.each(texts(spark, sf).select("doc_id", "text"), C.printable(F.col("text")), "tags map<string,bigint>", lambda: chunker.tag_counts(model))
    return found.select("doc_id", F.explode("tags").alias("tag", "n")).groupBy("doc_id", "tag").agg(F.sum("n").alias("n"))


SCORES_SQL = ", ".join(f"len(list_intersect(w, {listed(L.STOP_WORDS[x])})) AS {x}" for x in L.LANGUAGES)
LANGUAGE_SQL = f"""
SELECT doc_id, lang, CASE {' '.join(f"WHEN {x} = greatest({', '.join(L.LANGUAGES)}) THEN '{x}'" for x in L.LANGUAGES)} END AS language, greatest({', '.join(L.LANGUAGES)}) AS hits
FROM (SELECT doc_id, lang, {SCORES_SQL} FROM (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower({CLEAN}), '\\w+')) AS w FROM documents))"""


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    scored = texts(spark, sf).select("doc_id", "lang", nlp.language_scores(F.col("text"), L.STOP_WORDS).alias("s"))
    return scored.select("doc_id", "lang", nlp.best_language(F.col("s")).alias("language"), F.array_max("s")["hits"].alias("hits"))


@query("lang_id_docs", f"SELECT doc_id, language, hits FROM ({LANGUAGE_SQL})")
def lang_id_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf).select("doc_id", "language", "hits")


@query("lang_keep_english", f"SELECT doc_id FROM ({LANGUAGE_SQL}) WHERE language = 'en'")
def lang_keep_english(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf).filter("language = 'en'").select("doc_id")


@query("lang_confusion", f"SELECT lang, language, count(*) AS n FROM ({LANGUAGE_SQL}) GROUP BY lang, language")
def lang_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


def case_sql(word: str, gerunds: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({word}, {q(p)}) THEN '{t}'" for p, t in L.SUFFIX_TAGS if gerunds or t != "VBG") + " END"


def tag_sql(word: str) -> str:
    return f"coalesce(map_extract_value({TAGS_SQL}, lower({word})), {case_sql(word)})"


TAGS_SQL = f"map({listed(sorted(L.TAG_OF_WORD))}, {listed(L.TAG_OF_WORD[w] for w in sorted(L.TAG_OF_WORD))})"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({nlp.BLANKS.sql(text)}, {q(nlp.TOKEN)})"


@query(
    "suffix_tags",
    f"""WITH w AS (SELECT unnest({tokens_sql(CLEAN)}) AS word FROM documents),
d AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT coalesce({case_sql('word')}, 'none') AS tag, count(*) AS n_words, sum(n)::BIGINT AS n_tokens, count(*) FILTER (regexp_matches(word, {q(C.ABBREVIATION)})) AS n_abbreviations FROM d GROUP BY 1""",
)
def suffix_tags(spark: SparkSession, sf: str) -> DataFrame:
    words = texts(spark, sf).select(F.explode(nlp.tokens(C.printable(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(F.coalesce(nlp.suffix_tag(F.col("word")), F.lit("none")).alias("tag")).agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"), F.count_if(C.is_abbreviation(F.col("word"))).alias("n_abbreviations")
    )


@query(
    "token_filter_kea",
    f"""WITH t AS (SELECT doc_id, list_transform({tokens_sql(C.chain_sql(CLEAN, C.KEA))}, lambda w: {{'w': w, 't': {tag_sql('w')}}}) AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(p, lambda x: coalesce(x.t, '') = '.' OR (coalesce(regexp_matches(x.t, '^(?i)(N[NP]|VB|PP|\\.)'), true)
  AND NOT list_contains({listed(L.KEA_STOP)}, lower(x.w)) AND length(x.w) BETWEEN 3 AND 19)), lambda x: x.w), ' ') AS kept FROM t""",
)
def token_filter_kea(spark: SparkSession, sf: str) -> DataFrame:
    return chunker.each(texts(spark, sf).select("doc_id", "text"), C.kea_clean(F.col("text"), mail=False), "kept string", lambda: chunker.kea_kept(L.KEA_STOP))


def lemma_sql(w: str) -> str:
    return (
        f"CASE WHEN regexp_matches({w}, '[a-z]{{2}}ies\\z') THEN regexp_replace({w}, 'ies\\z', 'y') WHEN regexp_matches({w}, '(sh|ch|x|ss|z)es\\z') THEN regexp_replace({w}, 'es\\z', '') "
        f"WHEN regexp_matches({w}, '[a-z]{{2}}[^sui]s\\z') THEN regexp_replace({w}, 's\\z', '') ELSE {w} END"
    )


def words_sql(c: str) -> str:
    return f"string_split(lower(rtrim(regexp_replace({c}, '/\\S+ ', ' ', 'g'))), ' ')"


def lda_lines_sql(infer: bool = False) -> str:
    upper = f"CASE WHEN regexp_matches(s, {q(C.ALL_UPPER)}) THEN lower(s) ELSE s END"
    tag = tag_sql("w")
    remap = f"CASE WHEN {tag} IS NULL THEN CASE WHEN regexp_matches(w, {q(C.ABBREVIATION)}) THEN 'NN-ABR' ELSE 'Z0' END WHEN starts_with({tag}, 'VB') THEN 'NN-VB' WHEN length(w) <= 3 THEN 'Z3' ELSE {tag} END"
    pair = f"replace(w, '/', '|') || '/' || {remap} || ' '"
    return f"array_to_string(list_transform({sentences_sql(C.chain_sql(CLEAN, C.LDA + ([C.ONE_SPACE, C.LEFT_TRIM] if infer else [])))}, lambda s: array_to_string(list_transform({tokens_sql(upper)}, lambda w: {pair}), '')), '# ')"


def lda_phrases_sql(infer: bool = False) -> str:
    kept = f"list_filter(list_transform(@, lambda c: list_transform({words_sql('c')}, lambda w: {lemma_sql('w')})), lambda ws: NOT list_has_any(ws, {listed(L.LDA_STOP)}))"
    joined = "list_transform(@, lambda ws: regexp_replace(array_to_string(ws, ' '), '[ ]+([''])', '\\1', 'g'))"
    one, two = (joined.replace("@", kept.replace("@", x)) for x in ("p1", "p2"))
    return f"""
WITH t AS (SELECT doc_id, {lda_lines_sql(infer)} AS line FROM documents),
c AS (SELECT doc_id, regexp_extract_all(line, {q(nlp.ADJECTIVE_NOUNS)}) AS p1, regexp_extract_all(regexp_replace(line, {q(nlp.ADJECTIVE_NOUNS)}, '# ', 'g'), {q(nlp.NOUNS)}) AS p2 FROM t)
SELECT doc_id, len(p1) AS n_adjective, len(p2) AS n_noun, array_to_string({one}, ' ') || '|' || array_to_string({two}, ' ') AS phrases FROM c"""


def _np_chunks(spark: SparkSession, sf: str, infer: bool) -> DataFrame:
    docs = texts(spark, sf).select("doc_id", "text")
    return chunker.each(docs, C.lda_clean(C.printable(F.col("text")), infer), "n_adjective int, n_noun int, phrases string", lambda: chunker.lda_chunks(L.LDA_STOP))


@query("np_chunks_lda", lda_phrases_sql())
def np_chunks_lda(spark: SparkSession, sf: str) -> DataFrame:
    return _np_chunks(spark, sf, False)


@query("np_chunks_infer", lda_phrases_sql(True))
def np_chunks_infer(spark: SparkSession, sf: str) -> DataFrame:
    return _np_chunks(spark, sf, True)


@query("np_chunks_wcd")
def np_chunks_wcd(spark: SparkSession, sf: str) -> DataFrame:
    """A fold over tags, which SQL has no plain form for."""
    docs = chunker.each(texts(spark, sf).select("doc_id", "text"), C.BREAKS_TO_SENTENCES(C.printable(F.col("text"))), "several array<string>, single array<string>", chunker.wcd_chunks)
    return docs.select("doc_id", F.array_join("several", "|").alias("several"), F.array_join("single", "|").alias("single"))


@query("bio_without_career", f"SELECT conv_id, turn, array_to_string(list_filter({sentences_sql(CLEAN)}, lambda s: NOT regexp_matches(s, {q('(?i)[ ](' + C.CAREER + ')')})), ' ') AS kept FROM conversations WHERE role = 'assistant'")
def bio_without_career(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", nlp.without_career(C.printable(F.col("text"))).alias("kept"))


@query(
    "section_split",
    """WITH t AS (SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '####' WHEN 'user' THEN '@@@@' ELSE '&&&&' END || replace(text, chr(1), ''), '' ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, string_split(replace(replace(replace(body, '####', chr(1) || '####'), '&&&&', chr(1) || '&&&&'), '@@@@', chr(1) || '@@@@'), chr(1)) AS parts FROM t),
f AS (SELECT conv_id, list_filter(parts, lambda x: starts_with(x, '####')) AS a, list_filter(parts, lambda x: starts_with(x, '@@@@')) AS b FROM p)
SELECT conv_id, a[-1][5:] AS interests, b[-1][5:] AS publications FROM f""",
)
def section_split(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("role") == "system", "####").when(F.col("role") == "user", "@@@@").otherwise("&&&&")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.translate("text", "\x01", "").alias("text"), mark.alias("mark"))
    # turns of a conversation are few; their order is by turn, then role and text
    bodies = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "mark"))).alias("ts"))
    body = F.array_join(F.transform("ts", lambda x: F.concat(x["mark"], x["text"])), "")
    return bodies.select("conv_id", C.sections(body).alias("s")).select("conv_id", "s.interests", "s.publications")


@query(
    "label_join_train",
    """SELECT d.doc_id, l.quality, l.toxic, strlen(d.text) AS n_bytes FROM labels l
JOIN (SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY text) AS r FROM documents) WHERE r = 1) d ON d.doc_id = l.doc_id""",
)
def label_join_train(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf).groupBy("doc_id").agg(F.min("text").alias("text"))
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", F.octet_length("text").alias("n_bytes"))


@query("raw_preprocessed_match", f"SELECT r.doc_id, strlen(r.text) AS raw_bytes, strlen(p.clean) AS clean_bytes FROM documents r JOIN (SELECT doc_id, {C.chain_sql(CLEAN, C.KEA)} AS clean FROM documents) p ON r.doc_id = p.doc_id WHERE length(p.clean) > 0")
def raw_preprocessed_match(spark: SparkSession, sf: str) -> DataFrame:
    # written first: a filter on what is cleaned would go under it and clean every text once more, as would the other side
    sizes = durable(texts(spark, sf).select("doc_id", F.octet_length("text").alias("raw_bytes"), F.octet_length(C.kea_clean(F.col("text"), mail=False)).alias("clean_bytes")), "sizes")
    return sizes.select("doc_id", "raw_bytes").join(sizes.filter("clean_bytes > 0").select("doc_id", "clean_bytes"), "doc_id")


WORDS_SQL = f"SELECT doc_id, unnest(regexp_extract_all(lower({CLEAN}), '[a-z]+')) AS token FROM documents"


@query("bow", f"SELECT doc_id, token, count(*) AS n FROM ({WORDS_SQL}) GROUP BY doc_id, token")
def bow(spark: SparkSession, sf: str) -> DataFrame:
    return topics.bag_of_words(texts(spark, sf))


VOCAB_SQL = f"SELECT token, count(DISTINCT doc_id) AS df FROM ({WORDS_SQL}) GROUP BY token HAVING count(DISTINCT doc_id) <= floor(0.99 * (SELECT count(DISTINCT doc_id) FROM documents))"


@query("vocab_df", f"SELECT token, df, row_number() OVER (ORDER BY df DESC, token) - 1 AS token_id FROM ({VOCAB_SQL})")
def vocab_df(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    return topics.dictionary(topics.bag_of_words(docs), docs.count())


@query("bow_encoded", f"SELECT b.doc_id, d.token_id, b.n FROM (SELECT doc_id, token, count(*) AS n FROM ({WORDS_SQL}) GROUP BY doc_id, token) b JOIN (SELECT token, row_number() OVER (ORDER BY df DESC, token) - 1 AS token_id FROM ({VOCAB_SQL})) d ON b.token = d.token")
def bow_encoded(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    bags = topics.bag_of_words(docs)
    return topics.encode(bags, topics.dictionary(bags, docs.count()))


@query(
    "tf_idf",
    f"""WITH b AS (SELECT doc_id, token, count(*) AS n FROM ({WORDS_SQL}) GROUP BY doc_id, token), d AS ({VOCAB_SQL})
SELECT b.doc_id, b.token, round(b.n * ln((SELECT count(*) FROM documents) / d.df::DOUBLE), 6) AS weight FROM b JOIN d ON b.token = d.token""",
)
def tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    return topics.tf_idf(topics.bag_of_words(docs), docs.count())


CANDIDATES_SQL = f"""
w AS (SELECT doc_id, regexp_extract_all(lower({CLEAN}), '[a-z]+') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n_words, unnest(list_concat(list_concat(
   list_transform(range(1, len(w) + 1), lambda i: {{'p': i, 'g': w[i:i]}}), list_transform(range(1, len(w)), lambda i: {{'p': i, 'g': w[i:i + 1]}})),
   list_transform(range(1, len(w) - 1), lambda i: {{'p': i, 'g': w[i:i + 2]}}))) AS c FROM w),
k AS (SELECT doc_id, n_words, c.p AS p, array_to_string(c.g, ' ') AS phrase FROM g WHERE NOT list_contains({listed(L.STOP_WORDS['en'])}, c.g[1]) AND NOT list_contains({listed(L.STOP_WORDS['en'])}, c.g[-1]) AND length(c.g[1]) > 2 AND length(c.g[-1]) > 2),
s AS (SELECT doc_id, phrase, count(*) AS tf, round((min(p) - 1) / any_value(n_words)::DOUBLE, 6) AS first_position FROM k GROUP BY doc_id, phrase)"""


@query("keyphrase_candidates", f"WITH {CANDIDATES_SQL} SELECT * FROM s")
def keyphrase_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return keyphrases.candidates(texts(spark, sf))


@query(
    "keyphrase_topk",
    f"""WITH {CANDIDATES_SQL}, d AS (SELECT phrase, count(*) AS df FROM s GROUP BY phrase),
r AS (SELECT s.doc_id, s.phrase, round(s.tf * ln((SELECT count(*) FROM documents) / d.df::DOUBLE) * (1 - s.first_position), 6) AS score FROM s JOIN d ON s.phrase = d.phrase)
SELECT doc_id, phrase, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank FROM r) WHERE rank <= 10""",
)
def keyphrase_topk(spark: SparkSession, sf: str) -> DataFrame:
    return keyphrases.Corpus(texts(spark, sf)).top_phrases(10)


KEYS = "system network report energy information service time people".split()


def key_sentence_sql(stop: bool) -> str:
    cut = f"string_split_regex({C.chain_sql(CLEAN, nlp.R_APART)}, {q(nlp.R_CUT)})"
    look = C.chain_sql("lower(s)", C.r_steps(R_STOP)) if stop else "s"
    return f"""
WITH t AS (SELECT doc_id, list_slice(list_distinct_sorted, 1, 5) AS keys, parts FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower({CLEAN}), '[a-z]+'), lambda w: length(w) > 8))) AS list_distinct_sorted, {cut} AS parts FROM documents)),
h AS (SELECT doc_id, keys, parts, list_transform(parts, lambda s: len(list_filter(keys, lambda k: contains({look}, k)))) AS hits FROM t)
SELECT doc_id, CASE WHEN len(keys) = 0 THEN '' ELSE parts[list_position(hits, list_max(hits))] END AS key_sentence FROM h"""


def _key_sentences(spark: SparkSession, sf: str, stop: list[str] | None) -> DataFrame:
    text = C.printable(F.col("text"))
    long_words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 8)
    docs = texts(spark, sf).select("doc_id", text.alias("text"), F.slice(F.array_sort(F.array_distinct(long_words)), 1, 5).alias("keys"))
    return docs.select("doc_id", nlp.key_sentence(F.col("text"), F.col("keys"), stop).alias("key_sentence"))


@query("key_sentence", key_sentence_sql(True))
def key_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return _key_sentences(spark, sf, R_STOP)


@query("key_sentence_plain", key_sentence_sql(False))
def key_sentence_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _key_sentences(spark, sf, None)


#: Sections by role: what a conversation's system, user and assistant turns stand for.
BAGS_SQL = f"""
t AS (SELECT conv_id, CASE role WHEN 'system' THEN 'int' WHEN 'user' THEN 'pub' ELSE 'bio' END AS section, unnest(regexp_extract_all(lower({CLEAN}), '[a-z]+(?: [a-z]+)?')) AS phrase FROM conversations),
w AS (SELECT conv_id, section, phrase, unnest(list_filter(string_split(phrase, ' '), lambda x: length(x) > 2)) AS word FROM t),
gate AS (SELECT conv_id, count(DISTINCT word) AS n FROM w WHERE section <> 'bio' GROUP BY conv_id),
keep AS (
  SELECT t.* FROM t WHERE section = 'int'
  UNION ALL SELECT t.* FROM t WHERE section = 'pub' AND EXISTS (SELECT 1 FROM w a WHERE a.conv_id = t.conv_id AND a.section = 'pub' AND a.phrase = t.phrase)
  UNION ALL SELECT t.* FROM t LEFT JOIN gate g ON g.conv_id = t.conv_id WHERE section = 'bio' AND (coalesce(g.n, 0) <= 4 OR EXISTS (
     SELECT 1 FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.word = b.word AND b.section <> 'bio' WHERE a.conv_id = t.conv_id AND a.section = 'bio' AND a.phrase = t.phrase))),
bags AS (SELECT conv_id, section, x AS word, count(*) AS n FROM (SELECT conv_id, section, unnest(list_filter(string_split(phrase, ' '), lambda x: length(x) > 2)) AS x FROM keep) GROUP BY conv_id, section, x),
phrases AS (SELECT DISTINCT conv_id, phrase FROM keep),
pw AS (SELECT conv_id, phrase, unnest(list_filter(string_split(phrase, ' '), lambda x: length(x) > 2)) AS word FROM phrases),
counted AS (
  SELECT p.conv_id, p.phrase, coalesce(sum(b.n) FILTER (b.section = 'int'), 0)::BIGINT AS cint, coalesce(sum(b.n) FILTER (b.section = 'pub'), 0)::BIGINT AS cpub, coalesce(sum(b.n) FILTER (b.section = 'bio'), 0)::BIGINT AS cbio
  FROM phrases p LEFT JOIN pw ON pw.conv_id = p.conv_id AND pw.phrase = p.phrase LEFT JOIN bags b ON b.conv_id = pw.conv_id AND b.word = pw.word GROUP BY p.conv_id, p.phrase),
stats AS (SELECT conv_id, phrase, cint, cpub, cbio, len(list_filter(string_split(phrase, ' '), lambda x: length(x) > 2)) AS len FROM counted)"""


@query("phrase_counts", f"WITH {BAGS_SQL} SELECT * FROM stats")
def phrase_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _phrase_counts(table(spark, sf, "conversations"), phrasecloud.two_word_phrases)[0]


def _phrase_counts(turns: DataFrame, phrases) -> tuple[DataFrame, int]:
    parts = phrasecloud.parts_for(turns)
    return phrasecloud.phrase_counts(phrases(turns), "conv_id", parts), parts



@query(
    "phrase_weights_top100",
    f"""WITH {BAGS_SQL}, v AS (SELECT conv_id, phrase, (8 * cint + 2 * cpub + cbio) / len::DOUBLE AS w FROM stats WHERE len > 0),
n AS (SELECT conv_id, phrase, w / sum(w) OVER (PARTITION BY conv_id) AS weight FROM v)
SELECT conv_id, phrase, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(weight, 9) DESC, phrase) AS rank FROM n WHERE round(weight, 9) >= 1e-3) WHERE rank <= 100""",
)
def phrase_weights_top100(spark: SparkSession, sf: str) -> DataFrame:
    counts, parts = _phrase_counts(table(spark, sf, "conversations"), phrasecloud.two_word_phrases)
    return phrasecloud.top_weights(counts, "conv_id", parts=parts)



@query("phrase_cloud_tagged")
def phrase_cloud_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """The same over tagged noun phrases, whose tag fold SQL has no plain form for."""
    counts, parts = _phrase_counts(table(spark, sf, "conversations", spread=True), phrasecloud.noun_phrases)
    return phrasecloud.top_weights(counts, "conv_id", parts=parts)



@query(
    "token_filter_stop_anti",
    f"SELECT token, count(*) AS n FROM ({WORDS_SQL}) WHERE token NOT IN ({', '.join(map(q, L.KEA_STOP))}) GROUP BY token",
)
def token_filter_stop_anti(spark: SparkSession, sf: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in L.KEA_STOP], "token string")
    bags = topics.bag_of_words(texts(spark, sf))
    return bags.groupBy("token").agg(F.sum("n").alias("n")).join(F.broadcast(stop), "token", "left_anti")


__all__ = ["QUERIES", "SQL"]
