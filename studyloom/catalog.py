"""Every query of the library by name, and SQL that says the same.

Tables are read whole, documents in every language: word lists are English, other texts simply hold fewer of their words.
Operators over token trees (tree_*, analyse_*) run on all documents, as the rules take any text. Queries of small given tables
(fx_definitions, fact_*, selection_fold and the lexicon's) are those whose rows SQL states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, oracles
from .functions import lexicon as L
from .functions import text as X
from .operators import annotate, cards, corpus, definitions, digest, facts, headings, keywords, ranking, salience, surface
from .plans.analyse import KEPT, Analysis, part
from .sources import jobs, requests, webhook

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Text


@query
def norm_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.normalise("text").alias("text"))


@query
def collapse_ws(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.collapse("text").alias("text"))


@query
def list_marker(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", X.strip_list_marker("line").alias("line"))


@query
def whitespace_share(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(X.whitespace_share("text"), 9).alias("share"))


@query
def heading_lines(spark, sf_dir):
    return headings.headings(documents(spark, sf_dir))


@query
def fx_headings(spark, sf_dir):
    """Headings of texts that have some; those of documents have none."""
    return headings.headings(fixtures.headed(spark))


@query
def sentences_l0(spark, sf_dir):
    return surface.sentences(documents(spark, sf_dir))


@query
def tokens_l0(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(surface.tokens(X.normalise("text"))).alias("i", "token"))
    return rows.select("doc_id", "i", "token", F.lower("token").alias("lower"), F.col("token").rlike(surface.ALPHA).alias("is_alpha"))


@query
def usable_sentences(spark, sf_dir):
    return surface.usable_sentences(documents(spark, sf_dir)).select("doc_id", "index", "sentence")


@query
def doc_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own = docs.select("doc_id", F.size(surface.tokens(X.normalise("text"))).alias("tokens"))
    return own.join(surface.usable_sentences(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences")), "doc_id", "left").select("doc_id", "tokens", F.coalesce("sentences", F.lit(0)).alias("sentences"))


@query
def clean_forms(spark, sf_dir):
    """The forms that terms and definitions take, of every benchmark text."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", X.clean_definition("text").alias("definition"), X.back_key("text").alias("back_key"), X.strip_article(X.collapse("text")).alias("no_article"), X.display_form("text").alias("display"), X.normalise_key(F.lower("text")).alias("key"), X.clean_term(F.array_join(F.slice(F.split("text", "[ \\n]+"), 1, 4), " ")).alias("term"))


@query
def cloze_blank(spark, sf_dir):
    """Each usable sentence with its third word blanked."""
    rows = surface.usable_sentences(documents(spark, sf_dir)).withColumn("flat", X.collapse("sentence")).withColumn("word", F.get(surface.words(F.col("flat")), F.lit(2)))
    return rows.select("doc_id", "index", X.blank_first("flat", "word").alias("front"))


@query
def plausible_terms(spark, sf_dir):
    """Whether the first three words of each sentence could be a term, and whether it names a property."""
    rows = surface.usable_sentences(documents(spark, sf_dir)).select("doc_id", "index", F.array_join(F.slice(surface.words(F.col("sentence")), 1, 3), " ").alias("term"))
    return rows.select("doc_id", "index", "term", X.is_plausible_term("term").alias("plausible"), X.is_property_of("term").alias("is_property"))


# Corpus and keywords


@query
def vocab(spark, sf_dir):
    return surface.vocabulary(documents(spark, sf_dir)).select("doc_id", F.explode("terms").alias("term"))


@query
def doc_freq(spark, sf_dir):
    return corpus.document_frequency(surface.vocabulary(documents(spark, sf_dir)))


@query
def corpus_stats(spark, sf_dir):
    return corpus.documents(surface.vocabulary(documents(spark, sf_dir)))


@query
def idf_final(spark, sf_dir):
    vocabulary = surface.vocabulary(documents(spark, sf_dir))
    total = corpus.documents(vocabulary)
    return corpus.document_frequency(vocabulary).join(F.broadcast(total)).select("term", F.round(corpus.idf(F.col("documents"), F.col("df")), 6).alias("idf"))  # one row


@query
def idf_asof(spark, sf_dir):
    before, terms = corpus.as_of(surface.vocabulary(documents(spark, sf_dir)))
    return terms.join(before, "doc_id").select("doc_id", "term", "documents", "df", F.round(corpus.idf(F.col("documents"), F.col("df")), 6).alias("idf"))


@query
def kw_counts(spark, sf_dir):
    return keywords.counts(surface.phrases(documents(spark, sf_dir)))


@query
def kw_topk(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return keywords.extract(surface.phrases(docs), surface.vocabulary(docs)).select("doc_id", "place", "key", "term", "score", "count")


# Ranking


@query
def freq_rank(spark, sf_dir):
    return ranking.frequency_rank(surface.usable_sentences(documents(spark, sf_dir))).select("doc_id", "index", ranking.rounded(F.col("score"), 9).alias("score"))


def benchmark_sentences(spark, sf_dir):
    """The items of the benchmark as the sentences of one document."""
    return table(spark, sf_dir, "benchmark").select(F.lit(0).cast("long").alias("doc_id"), F.col("item_id").cast("int").alias("index"), F.col("text").alias("sentence"), F.transform(F.filter(surface.words(F.col("text")), surface.is_content), F.lower).alias("words"))


@query
def sim_edges(spark, sf_dir):
    return ranking.similarity_edges(benchmark_sentences(spark, sf_dir)).select("i", "j", ranking.rounded(F.col("weight"), 9).alias("weight"))


@query
def textrank(spark, sf_dir):
    return ranking.textrank(benchmark_sentences(spark, sf_dir)).select("index", ranking.rounded(F.col("score"), 6).alias("score"))


@query
def rank_all(spark, sf_dir):
    """Every English document by the method that suits its length."""
    return ranking.rank_sentences(surface.usable_sentences(documents(spark, sf_dir))).select("doc_id", "index", ranking.rounded(F.col("score"), 6).alias("score"))


@query
def sentence_cut(spark, sf_dir):
    return ranking.sentence_cut(ranking.frequency_rank(surface.usable_sentences(documents(spark, sf_dir))), 0.25).select("doc_id", ranking.rounded(F.col("cut"), 9).alias("cut"))


@query
def summary_freq(spark, sf_dir):
    sents = surface.usable_sentences(documents(spark, sf_dir))
    return ranking.summarise(sents, ranking.frequency_rank(sents).withColumn("score", ranking.rounded(F.col("score"), 9)))


@query
def summary_all(spark, sf_dir):
    sents = surface.usable_sentences(documents(spark, sf_dir))
    return ranking.summarise(sents, ranking.rank_sentences(sents).withColumn("score", ranking.rounded(F.col("score"), 9)))


# Definitions, cards and quizzes by surface patterns, over all English documents


@query
def def_surface(spark, sf_dir):
    return surface.definitions(documents(spark, sf_dir)).select("doc_id", "rank", "index", "term", "definition", "pattern", F.round("confidence", 6).alias("confidence"))


@query
def definition_cards(spark, sf_dir):
    return cards.definition_cards(surface.definitions(documents(spark, sf_dir)), 25).select("doc_id", "ord", "front", "back", "kind")


@query
def quiz_distractors(spark, sf_dir):
    return cards.distractors(surface.definitions(documents(spark, sf_dir)))


@query
def quiz(spark, sf_dir):
    return cards.quiz(surface.definitions(documents(spark, sf_dir))).select("doc_id", "ord", "prompt", F.array_join("options", "\n").alias("options"), "correct_index")


# Token trees over all documents


def annotated(spark, sf_dir):
    return annotate.annotate(documents(spark, sf_dir))


def analysis(spark, sf_dir, name=None):
    """The analysis of all documents, which keeps what the named part needs; all if there is no name."""
    return Analysis(documents(spark, sf_dir), kept=KEPT.get(name))


@query
def tree_tokens(spark, sf_dir):
    return annotated(spark, sf_dir).select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.i", "t.text", "t.lemma", "t.pos", "t.dep", "t.head")


@query
def tree_definitions(spark, sf_dir):
    return analysis(spark, sf_dir, "definitions").found_definitions().select("doc_id", "rank", "index", "term", "definition", "pattern", F.round("confidence", 6).alias("confidence"))


@query
def tree_facts(spark, sf_dir):
    return analysis(spark, sf_dir, "facts").found_facts().select("doc_id", "rank", "index", "term", "back", "family", "pattern", "confidence", "other")


def facts_of(sents: DataFrame, pattern: str) -> DataFrame:
    return shown(facts.candidates(sents).where(F.col("pattern") == pattern))


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "pattern", X.clean_term("words").alias("term"), X.clean_definition("back_text").alias("back"))


def tree_fact_query(pattern: str) -> Query:
    return lambda spark, sf_dir: shown(digest.pattern_facts(documents(spark, sf_dir), pattern))


for _pattern in L.FAMILY:
    FOUND[f"tree_fact_{_pattern}"] = tree_fact_query(_pattern)


@query
def tree_term_distractors(spark, sf_dir):
    """Wrong answers among the terms that a document defines; the given relations are the lexicon."""
    terms = analysis(spark, sf_dir, "definitions").definitions.select("doc_id", "term")
    return cards.term_distractors(terms, terms, fixtures.relations(spark))


@query
def analyse_keywords(spark, sf_dir):
    return analysis(spark, sf_dir, "keywords").keywords


@query
def analyse_cards(spark, sf_dir):
    return part(documents(spark, sf_dir), "cards", 25)


@query
def analyse_quiz(spark, sf_dir):
    return part(documents(spark, sf_dir), "quiz", 10)


@query
def analyse_summary(spark, sf_dir):
    return part(documents(spark, sf_dir), "summary", 3)


@query
def analyse_salience(spark, sf_dir):
    return salience.sentence_salience(analysis(spark, sf_dir, "ranks").ranks)


@query
def analyse_result(spark, sf_dir):
    """The whole plan: a row per document with all parts."""
    return analysis(spark, sf_dir).result()


# Small given tables


def fact_query(pattern: str) -> Query:
    return lambda spark, sf_dir: facts_of(annotate.sentences(annotate.annotate(fixtures.sentences(spark))), pattern)


for _pattern in L.FAMILY:
    FOUND[f"fact_{_pattern}"] = fact_query(_pattern)


@query
def fx_definitions(spark, sf_dir):
    rows = annotate.annotate(fixtures.sentences(spark))
    return definitions.extract(annotate.sentences(rows), annotate.chunk_counts(annotate.chunks(rows))).select("doc_id", "term", "definition", "pattern", F.round("confidence", 6).alias("confidence"))


@query
def selection_fold(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, ord int, front string, back string, kind string, confidence double, evidence string")
    return cards.fact_cards(none, fixtures.fact_rows(spark), 20).select("doc_id", "ord", "front", "back", "kind", "confidence")


@query
def synonym_antijoin(spark, sf_dir):
    return cards.unreliable(fixtures.relations(spark))


@query
def term_siblings(spark, sf_dir):
    return cards.siblings(fixtures.relations(spark))


@query
def cosine_band(spark, sf_dir):
    """All vectors whose similarity to a vector of the query set (ids divisible by 100) lies in the band.

    Queries go in blocks of neighbouring ids, 256 at most where ids don't repeat, and each block meets every row once.
    """
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = own.where("vec_id % 100 = 0").groupBy(F.floor(F.col("vec_id") / 25_600).alias("block")).agg(F.collect_list(F.struct(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))).alias("queries"))
    pairs = own.crossJoin(asked.select("queries")).select("vec_id", "embedding", F.inline("queries")).where("vec_id != query_id")
    near = pairs.withColumn("similarity", cards.cosine(F.col("embedding"), F.col("asked"))).where(cards.in_band(F.col("similarity")))
    return near.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


# Requests, jobs, results


@query
def request_validation(spark, sf_dir):
    return requests.split(documents(spark, sf_dir), max_chars=5000)[1].select("doc_id", "status", "status_code", "message")


@query
def option_validation(spark, sf_dir):
    """Option ranges, with the numbers of orders as requests."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 400 - 50).cast("int").alias("n"))
    found = requests.option_problem({name: F.col("n") for name in L.OPTION_RANGES})
    return rows.select("l_orderkey", "l_linenumber", found["message"].alias("message"))


@query
def limit_clamp(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 300 - 40).alias("n"))
    return rows.select("event_id", requests.clamped("n", 100).alias("quiz"), requests.clamped("n", 50).alias("summary"))


@query
def job_parse(spark, sf_dir):
    """Conversation turns as jobs."""
    rows = table(spark, sf_dir, "conversations")
    lines = rows.select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("job_id"), "text", F.col("role").alias("reply_to"))).alias("value"))
    return jobs.parse(lines).select("job_id", "text", jobs.queue(F.col("reply_to")).alias("queue"), "is_good")


@query
def job_deadletter(spark, sf_dir):
    return jobs.dead_letters(jobs.parse(fixtures.job_lines(spark))).select("value")


@query
def result_route(spark, sf_dir):
    parsed = jobs.parse(fixtures.job_lines(spark)).where("is_good")
    return jobs.route(parsed.withColumn("error", F.lit(None).cast("string")).withColumn("result", F.lit(None).cast("string"))).select("queue", "correlation", "message")


def document_jobs(spark, sf_dir):
    """Documents as job lines; one without a text is no job."""
    lines = documents(spark, sf_dir).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("job_id"), "text", F.col("source").alias("reply_to"))).alias("value"))
    return jobs.parse(lines)


@query
def document_deadletters(spark, sf_dir):
    return jobs.dead_letters(document_jobs(spark, sf_dir)).select("value")


@query
def document_routes(spark, sf_dir):
    """The answer to each document's job: its whole result as JSON, for the queue of its source."""
    good = document_jobs(spark, sf_dir).where("is_good")
    docs = good.select(F.col("job_id").cast("long").alias("doc_id"), "text")
    results = Analysis(docs).result()
    made = results.select(F.col("doc_id").cast("string").alias("job_id"), F.to_json(F.struct(*(c for c in results.columns if c != "doc_id"))).alias("result"))
    return jobs.route(good.join(made, "job_id").withColumn("error", F.lit(None).cast("string"))).select("queue", "correlation", "message")


@query
def signed_bodies(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct("item_id", "text")).alias("body"))
    return rows.select("item_id", webhook.signature("body", "secret").alias("signature"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_all(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
