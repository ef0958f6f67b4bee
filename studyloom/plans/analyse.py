"""The whole plan: from documents to cards, quiz, keywords, summary and counts.

Documents are annotated once, and what the parts need of their trees is kept in the shared folder; every part reads its
columns of that table. A part that is not asked for is no part of the plan that runs. Keywords are scored as of the documents before, in the order of seq, so a
document never weighs its own words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotate, cards, corpus, definitions, digest, facts, headings, keywords, ranking, salience
from ..operators.limits import Limit, within
from ..operators.rules import annotate as by_rules
from ..sources.requests import Options
from ..sources.shared import forget, keep


#: What each part needs of the trees.
KEPT = {
    "summary": (digest.WORDS,),
    "ranks": (digest.WORDS,),
    "keywords": (digest.PHRASES, digest.TERMS),
    "definitions": (digest.DEFINITIONS,),
    "quiz": (digest.DEFINITIONS,),
    "facts": (digest.WORDS, digest.FACTS, digest.TOPICS),
    "cards": (digest.WORDS, digest.DEFINITIONS, digest.FACTS, digest.TREES, digest.TOPICS),
}


@dataclass
class Analysis:
    """The parts of an analysis; each is a DataFrame that is planned when first asked for."""

    docs: DataFrame
    options: Options = Options()
    annotator: annotate.Annotator = by_rules
    frequencies: DataFrame | None = None
    documents: int = 0
    #: doc_id (once each) and a column for each option, which hold instead of options.
    limits: DataFrame | None = None
    #: What is kept of the trees; their tokens only for blanks.
    kept: tuple[str, ...] | None = None

    def most(self, name: str, times: int = 1) -> Limit:
        if self.limits is None:
            return times * getattr(self.options, name)
        return self.limits.select("doc_id", (F.col(name) * times).alias("most"))

    @cached_property
    def annotated(self) -> DataFrame:
        blanks = self.options.include_cloze or self.limits is not None
        kept = self.kept or tuple(x for x in (*digest.ALL, digest.TOPICS) if blanks or x != digest.TREES)
        return keep(digest.digest(self.docs, self.annotator, kept))  # now; else stages that start together each annotate the same documents

    @cached_property
    def sentences(self) -> DataFrame:
        return digest.sentences(self.annotated)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return digest.vocabulary(self.annotated)

    @cached_property
    def ranks(self) -> DataFrame:
        # Few rows that the summary and the facts read.
        return keep(ranking.rank_sentences(digest.words(self.annotated)))

    @cached_property
    def all_keywords(self) -> DataFrame:
        # Phrases move once, a row a document; counts, scores and places are then taken where they are.
        counted = keywords.counts(digest.gathered_phrases(self.annotated))
        known = corpus.asked(digest.vocabulary(self.annotated, "keys"), self.frequencies, self.documents)
        joined = counted.join(known, "doc_id", "left").withColumn("df", F.col("known")[F.col("key")])
        return keywords.ranked(keywords.weighed(joined, counted.columns))

    @property
    def keywords(self) -> DataFrame:
        return within(self.all_keywords, self.most("max_keywords"))

    def found_definitions(self) -> DataFrame:
        """definitions for one reader."""
        return definitions.extract(self.sentences, digest.chunk_counts(self.annotated), self.most("max_cards", 2))

    @cached_property
    def definitions(self) -> DataFrame:
        # Cards, facts' room and quiz all start from these few rows.
        return keep(self.found_definitions())

    def found_facts(self) -> DataFrame:
        """facts for one reader."""
        return facts.extract(self.sentences, salience.sentence_salience(self.ranks), salience.salient_keys(digest.topics(self.annotated)))

    @cached_property
    def facts(self) -> DataFrame:
        return keep(self.found_facts())

    @property
    def cards(self) -> DataFrame:
        blanks = self.options.include_cloze if self.limits is None else self.limits.where("include_cloze").select("doc_id")
        return cards.build(self.definitions, self.facts, self.sentences, self.most("max_cards"), blanks)

    @property
    def quiz(self) -> DataFrame:
        return cards.quiz(self.definitions, self.most("max_quiz_questions"))

    @property
    def summary(self) -> DataFrame:
        return ranking.summarise(self.sentences, self.ranks, self.most("max_summary_sentences"))

    @property
    def headings(self) -> DataFrame:
        return headings.headings(self.docs)

    @property
    def stats(self) -> DataFrame:
        return digest.stats(self.annotated)

    def close(self) -> None:
        """Gives up the rows that are kept between the parts."""
        for name in ("annotated", "ranks", "definitions", "facts"):
            if name in self.__dict__:
                forget(self.__dict__[name])

    def result(self) -> DataFrame:
        """One row per document with all parts nested."""

        def nested(df: DataFrame, name: str, order: str) -> DataFrame:
            own = [c for c in df.columns if c != "doc_id" and c != order]
            rows = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, *own))).alias("rows"))
            return rows.select("doc_id", F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in (own if order in ("ord", "place") else [*own, order])))).alias(name))

        out = self.annotated.select("doc_id")
        for name, df, order in (("cards", self.cards, "ord"), ("quiz", self.quiz, "ord"), ("keywords", self.keywords, "place"), ("summary", self.summary, "index")):
            out = out.join(nested(df, name, order), "doc_id", "left")
        stats = self.stats.select("doc_id", F.struct("sentences", "tokens", "chunks").alias("stats"))
        return out.join(stats, "doc_id", "left")


def part(docs: DataFrame, name: str, limit: int = 25, **more) -> DataFrame:
    """One part (cards, quiz, keywords or summary) with its limit brought into range; the others are not planned."""
    return getattr(Analysis(docs, Options.part(name, limit), **({"kept": KEPT[name]} | more)), name)
