"""The surface annotator: sentences, words and phrases from built-in expressions alone, without a parser.

Sentences end at . ! ? before white space and at line feeds. Words are runs of ASCII letters, digits, apostrophes
and hyphens; any other visible character is a mark. A lemma is the lower-cased word; a content word is alphabetic,
no stop word and longer than two letters; a phrase is a maximal run of one to three alphabetic words that are no
stop words. Everything stays in the row of its document, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X

WORD = "[A-Za-z0-9'-]+"
TOKEN = WORD + "|[^ \\t\\n\\r\\f\\x0BA-Za-z0-9'-]"
ALPHA = "^[A-Za-z]+$"


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1))


def is_content(word: Column) -> Column:
    return word.rlike(ALPHA) & ~F.lower(word).isin(*L.STOP_WORDS) & (F.length(word) > 2)


def sentence_array(text: Column) -> Column:
    """Sentences of a normalised text, in order, without empty ones."""
    lines = F.split(F.regexp_replace(text, "([.!?])[ \\t\\n\\r\\f\\x0B]+", "$1\n"), "\\n+")
    return F.filter(F.transform(lines, X.strip), lambda s: s != "")


def with_sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text (normalised) and sents, the array of sentences."""
    return docs.select("doc_id", X.normalise(text_col).alias("text")).withColumn("sents", sentence_array(F.coalesce("text", F.lit(""))))


def sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per sentence: doc_id, pos, sentence."""
    return with_sentences(docs, text_col).select("doc_id", F.posexplode("sents").alias("pos", "sentence"))


def usable(sentence: Column) -> Column:
    own = words(sentence)
    letters = F.size(F.filter(own, lambda w: w.rlike(ALPHA)))
    return X.is_usable_sentence(sentence, F.size(own), letters >= L.MIN_ALPHA_SHARE * F.greatest(F.size(own), F.lit(1)))


def usable_sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The sentence table: doc_id, index (among usable ones), sentence, words (content lemmas, repeats kept)."""
    kept = with_sentences(docs, text_col).select("doc_id", F.posexplode(F.filter("sents", usable)).alias("index", "sentence"))
    return kept.withColumn("words", F.transform(F.filter(words(F.col("sentence")), is_content), F.lower))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and terms, the distinct content lemmas of the whole text."""
    return docs.select("doc_id", F.array_distinct(F.transform(F.filter(words(F.coalesce(X.normalise(text_col), F.lit(""))), is_content), F.lower)).alias("terms"))


def phrases(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Keyword candidates: doc_id, key, display, position (token index), total (words of the document, 1 at least)."""
    own = docs.select("doc_id", tokens(F.coalesce(X.normalise(text_col), F.lit(""))).alias("toks"))
    own = own.withColumn("flags", F.transform("toks", lambda t: t.rlike(ALPHA) & ~F.lower(t).isin(*L.STOP_WORDS)))
    own = own.withColumn("total", F.greatest(F.lit(1), F.size(F.filter("toks", lambda t: t.rlike(f"^{WORD}$")))))
    flag = lambda i: F.coalesce(F.get("flags", i), F.lit(False))
    every = F.when(F.size("toks") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("toks") - 1))
    starts = F.filter(every, lambda i: flag(i) & ~flag(i - 1))
    sized = F.transform(starts, lambda i: F.struct(i.alias("at"), F.when(~flag(i + 1), 1).when(~flag(i + 2), 2).when(~flag(i + 3), 3).otherwise(4).alias("n")))
    short = F.filter(sized, lambda r: r["n"] <= L.MAX_PHRASE_TOKENS)
    rows = own.select("doc_id", "total", "toks", F.explode(short).alias("r")).select("doc_id", "total", F.col("r.at").alias("position"), F.array_join(F.slice("toks", F.col("r.at") + 1, F.col("r.n")), " ").alias("text"))
    return rows.where(is_candidate_text(F.col("text"))).select("doc_id", F.lower("text").alias("key"), X.display_form("text").alias("display"), "position", "total")


def is_candidate_text(text: Column) -> Column:
    low = F.lower(text)
    own = F.filter(F.split(low, " "), lambda w: ~w.isin(*L.FILLER_LINKS))
    return (F.length(text) >= L.MIN_TERM_CHARS) & ~low.isin(*L.DOMAIN_FILLER) & ~((F.size(own) > 0) & F.forall(own, lambda w: w.isin(*L.DOMAIN_FILLER)))


def definitions(docs: DataFrame, text_col: str = "text", limit: int = 50) -> DataFrame:
    """Copular definitions by surface: up to three words, is or are, the rest. Columns as of the parsed operator."""
    pattern = "^((?:[A-Za-z'-]+ ){1,3}?)(?:is|are) (.+)$"
    flat = X.collapse("sentence")
    found = usable_sentences(docs, text_col).where(flat.rlike(pattern)).select("doc_id", "index", flat.alias("evidence"))
    found = found.select("doc_id", "index", "evidence", X.clean_term(F.trim(F.regexp_extract("evidence", pattern, 1))).alias("term"), X.clean_definition(F.regexp_extract("evidence", pattern, 2)).alias("definition"))
    found = found.where(X.is_plausible_term("term") & F.length("definition").between(L.MIN_DEFINITION_CHARS, L.MAX_DEFINITION_CHARS))
    found = found.withColumn("pattern", F.lit("copular")).withColumn("confidence", F.lit(L.PATTERN_BASE["copular"]) + F.when(F.length("definition") > F.length("term"), 0.05).otherwise(0.0) - F.when(F.length("definition") < 1.5 * F.length("term"), 0.10).otherwise(0.0)).withColumn("ord", F.col("index"))
    from .definitions import first_of_term

    return first_of_term(found, limit)
