"""Cards and quizzes from definitions and facts.

Definitions: doc_id, rank, index, term, definition, evidence, pattern, confidence. Facts: doc_id, rank, term, back,
family, confidence, other. Each document's rows are bounded by the limits of their extraction, so folds over them
stay in one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions import tree as N
from ..sources.shared import cut
from ._arrow import map_rows
from .limits import Limit, with_most, within

FACT = "struct<rank:int,term:string,back:string,family:string,confidence:double,other:string>"


def definition_cards(definitions: DataFrame, max_cards: Limit) -> DataFrame:
    """The best definitions; a property of something is no definition of it."""
    order = Window.partitionBy("doc_id").orderBy("rank")
    kept = within(definitions.where(~X.is_property_of("term")).withColumn("ord", F.row_number().over(order)), max_cards, "ord")
    return kept.select("doc_id", "ord", F.col("term").alias("front"), F.col("definition").alias("back"), F.lit("DEFINITION").alias("kind"), "confidence", "evidence")


def choose_facts(facts: Column, room: Column, backs: Column) -> Column:
    """The greedy choice over facts in order, as a fold.

    A fact is passed over if its term already has one of its family, its back is taken, or its term is full: two, or
    three if all that it has are strong.
    """
    start = F.struct(F.array().cast(f"array<{FACT}>").alias("chosen"), backs.alias("backs"))

    def step(state: Column, fact: Column) -> Column:
        own = F.filter(state["chosen"], lambda c: F.lower(c["term"]) == F.lower(fact["term"]))
        room_for_term = (F.size(own) < L.MAX_PER_TERM) | ((F.size(own) < L.MAX_PER_STRONG_TERM) & F.forall(own, lambda c: c["confidence"] >= L.STRONG_CONFIDENCE))
        fits = (
            (F.size(state["chosen"]) < room)
            & ~F.exists(own, lambda c: c["family"] == fact["family"])
            & ~F.array_contains(state["backs"], X.back_key(fact["back"]))
            & room_for_term
        )
        taken = F.struct(F.array_append(state["chosen"], fact).alias("chosen"), F.array_append(state["backs"], X.back_key(fact["back"])).alias("backs"))
        return F.when(fits, taken).otherwise(state)

    return F.aggregate(facts, start, step)["chosen"]


def fact_cards(definition_rows: DataFrame, facts: DataFrame, max_cards: Limit) -> DataFrame:
    """The chosen facts of each document after its definition cards, with their fronts."""
    most = F.col("most")
    budget = F.greatest(F.lit(L.FACT_FLOOR), F.floor(most * L.FACT_SHARE).cast("int"))
    own = facts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "term", "back", "family", F.col("confidence").cast("double").alias("confidence"), "other"))).alias("facts"))
    used = definition_rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("used"), F.collect_list(X.back_key("back")).alias("backs"), F.collect_list(F.lower("front")).alias("fronts"))
    none = F.array().cast("array<string>")
    joined = with_most(own.join(used, "doc_id", "left"), max_cards).select("doc_id", "facts", "most", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("backs", none).alias("backs"), F.coalesce("fronts", none).alias("fronts"))
    room = F.greatest(F.lit(0), F.least(most - F.col("used"), budget))
    chosen = joined.withColumn("chosen", choose_facts(F.col("facts"), room, F.col("backs")))
    terms = F.concat(F.col("fronts"), F.transform("chosen", lambda c: F.lower(c["term"])))
    rows = chosen.select("doc_id", "used", terms.alias("terms"), F.posexplode("chosen").alias("pos", "c"))
    count = F.size(F.filter("terms", lambda t: t == F.lower(F.col("c.term"))))
    return rows.select(
        "doc_id", (F.col("used") + F.col("pos") + 1).alias("ord"), X.card_front(F.col("c.term"), F.col("c.other"), F.col("c.family"), count).alias("front"), F.col("c.back").alias("back"), F.col("c.family").alias("kind"), F.col("c.confidence").alias("confidence"), F.lit("").alias("evidence")
    )


def good_blank(toks: N.Span, span: N.Span) -> bool:
    """Whether the span is worth asking for in its sentence."""
    own = [t for t in span if N.seen(t)]
    asked = re.sub(rf"(?i)^(?:{'|'.join(L.ARTICLES)}) ", "", N.text(span).strip())
    if not own or len(asked) < L.MIN_BLANK_CHARS or span[0]["i"] == toks[0]["i"]:
        return False
    same = sum(N.text(toks[a : a + len(own)]).lower() == asked.lower() for a in range(len(toks) - len(own) + 1))
    topical = any(t["pos"] in L.CONTENT_POS for t in own) and not any(t["ent_type"] for t in own)
    return topical and same <= 1 and len(own) <= L.MAX_BLANK_SHARE * max(1, sum(map(N.seen, toks)))


def cloze_candidates(definitions: DataFrame, sents: DataFrame) -> DataFrame:
    """A blanked sentence for each definition whose term can be blanked: doc_id, rank, front, back, confidence, evidence."""
    rows = definitions.join(sents.select("doc_id", "index", "toks").where("toks is not null"), ["doc_id", "index"]).select("doc_id", "rank", "confidence", "evidence", "term", "toks")

    def run(doc, rank, confidence, evidence, term, toks) -> Iterator[tuple]:
        span = N.Sentence(toks).find(term)
        if span and good_blank(toks, span):
            yield doc, rank, confidence, evidence, N.text(span)

    kind = definitions.schema["doc_id"].dataType.simpleString()
    found = map_rows(rows, f"doc_id {kind}, rank int, confidence double, evidence string, asked string", run).withColumn("asked", X.collapse("asked"))
    return found.select("doc_id", "rank", X.blank_first("evidence", "asked").alias("front"), X.strip_article("asked").alias("back"), "confidence", "evidence").where("front is not null")


def build(definitions: DataFrame, facts: DataFrame, sents: DataFrame | None, max_cards: Limit = 25, include_cloze: bool | DataFrame = False) -> DataFrame:
    """doc_id, ord, front, back, kind, confidence, evidence: definitions, then facts, then blanks, max_cards a document.

    include_cloze: whether there are blanks, or the documents (doc_id) that have them.
    """
    first = definition_cards(definitions, max_cards)
    out = first.unionByName(fact_cards(first, facts, max_cards))
    if sents is not None and include_cloze is not False:
        asked = definitions if include_cloze is True else definitions.join(include_cloze, "doc_id", "left_semi")
        own = Window.partitionBy("doc_id", "front").orderBy("rank")
        blanks = cloze_candidates(asked, sents).join(out.select("doc_id", "front").distinct(), ["doc_id", "front"], "left_anti")
        blanks = blanks.withColumn("nth", F.row_number().over(own)).where("nth = 1").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")))
        sizes = out.groupBy("doc_id").agg(F.max("ord").alias("used"))
        blanks = blanks.join(sizes, "doc_id", "left").select("doc_id", (F.coalesce("used", F.lit(0)) + F.col("place")).alias("ord"), "front", "back", F.lit("CLOZE").alias("kind"), "confidence", "evidence")
        out = out.unionByName(blanks)
    return within(out, max_cards, "ord")


def distractors(definitions: DataFrame, count: int = L.DISTRACTORS) -> DataFrame:
    """doc_id, rank, place, wrong: for each definition the other definitions of its document that are nearest in length."""
    pool = definitions.select("doc_id", F.col("definition").alias("wrong"), F.col("rank").alias("other_rank")).where(F.length("wrong") >= L.MIN_DISTRACTOR_CHARS)
    pairs = definitions.select("doc_id", "rank", "definition").join(pool, "doc_id").where(F.lower("definition") != F.lower("wrong"))
    order = Window.partitionBy("doc_id", "rank").orderBy(F.abs(F.length("wrong") - F.length("definition")), F.lower("wrong"), "other_rank")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).select("doc_id", "rank", "place", "wrong")


def quiz(definitions: DataFrame, max_questions: Limit = 10) -> DataFrame:
    """doc_id, ord, prompt, options, correct_index, explanation, evidence. Options are in an order that their texts give."""
    strong = definitions.where(F.col("confidence") >= L.MIN_QUIZ_CONFIDENCE).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))).where(F.col("nth") <= L.MAX_QUIZ_DEFINITIONS)
    wrong = distractors(definitions).groupBy("doc_id", "rank").agg(F.collect_list("wrong").alias("wrong")).where(F.size("wrong") >= L.DISTRACTORS)
    rows = strong.join(wrong, ["doc_id", "rank"])
    keyed = F.transform(F.concat(F.array("definition"), F.col("wrong")), lambda o: F.struct(X.seeded_order(F.col("term"), F.col("definition"), o).alias("k"), o.alias("o")))
    rows = rows.withColumn("options", F.transform(F.array_sort(keyed), lambda x: x["o"])).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")))
    return within(rows, max_questions, "ord").select("doc_id", "ord", F.concat(F.lit("What is "), "term", F.lit("?")).alias("prompt"), "options", (F.array_position("options", F.col("definition")) - 1).cast("int").alias("correct_index"), F.col("definition").alias("explanation"), "evidence")


def shares_head(left: Column, right: Column) -> Column:
    """Whether two terms end in the same word."""
    return F.element_at(F.split(F.lower(X.strip(left)), " +"), -1) == F.element_at(F.split(F.lower(X.strip(right)), " +"), -1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def lexical_similarity(a: Column, b: Column) -> Column:
    """A stand-in for terms without vectors: whether their first four letters agree."""
    same = F.substring(F.lower(a), 1, 4) == F.substring(F.lower(b), 1, 4)
    return F.when(same, L.PREFIX_SIMILAR).otherwise(L.PREFIX_DIFFERENT)


def in_band(similarity: Column) -> Column:
    return similarity.between(L.BAND_LOW, L.BAND_HIGH)


def closure(edges: DataFrame) -> DataFrame:
    """(term, other) for every other that is reached from term over edges (term, other), cycles included.

    Paths double in each round, so as many rounds are taken as the logarithm of the longest one; rounds end when no
    pair is new.
    """
    reached = cut(edges.select("term", "other").where("term is not null and other is not null").distinct())
    known = -1
    while (now := reached.count()) != known:
        known = now
        further = reached.join(reached.select(F.col("term").alias("other"), F.col("other").alias("next")), "other").select("term", F.col("next").alias("other"))
        reached = cut(reached.union(further).distinct())
    return reached


def unreliable(relations: DataFrame) -> DataFrame:
    """(term, other) that may be right as well: same set of synonyms, antonyms, or a wider term at any depth.

    relations: term, relation (same, antonym, wider), other. Terms may be wider in a circle, and chains of any length.
    """
    above = closure(relations.where("relation = 'wider'"))
    return above.union(relations.where("relation <> 'wider'").select("term", "other")).distinct()


def siblings(relations: DataFrame, most: int = L.MAX_SIBLINGS) -> DataFrame:
    """(term, sibling): terms under the same wider term, in order, at most so many each."""
    wider = relations.where("relation = 'wider'")
    pairs = wider.select("term", "other").join(wider.select(F.col("term").alias("sibling"), "other"), "other").where("term != sibling").select("term", "sibling").distinct()
    order = Window.partitionBy("term").orderBy("sibling")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("term", "sibling")


def term_distractors(terms: DataFrame, pool: DataFrame, relations: DataFrame, similarity: DataFrame | None = None, count: int = L.DISTRACTORS) -> DataFrame:
    """doc_id, term, place, wrong: terms of the same document that are neither the answer nor near enough to be right.

    With similarity (term, other, similarity) candidates of the middle band come first, nearest its centre; without,
    terms with the same last word do. Siblings fill up what is missing, if they lie in the band.
    """
    a, b = F.lower("term"), F.lower("wrong")
    pairs = terms.select("doc_id", "term").join(pool.select("doc_id", F.col("term").alias("wrong")).distinct(), "doc_id")
    pairs = pairs.where(~F.contains(a, b) & ~F.contains(b, a) & (F.length("wrong") >= 3) & ~F.col("wrong").rlike("^[0-9]+$"))
    bad = unreliable(relations).select(F.lower("term").alias("bad_term"), F.lower("other").alias("bad_other"))
    pairs = pairs.join(bad, (a == F.col("bad_term")) & (b == F.col("bad_other")), "left_anti")
    if similarity is not None:
        pairs = pairs.join(similarity.select("term", F.col("other").alias("wrong"), "similarity"), ["term", "wrong"], "left")
        pairs = pairs.withColumn("similarity", F.coalesce("similarity", lexical_similarity(F.col("term"), F.col("wrong")))).where(in_band(F.col("similarity")))
        first = F.abs(F.col("similarity") - (L.BAND_LOW + L.BAND_HIGH) / 2)
    else:
        first = (~shares_head(F.col("term"), F.col("wrong"))).cast("int").cast("double")
    own = pairs.select("doc_id", "term", "wrong", F.lit(0).alias("source"), first.alias("key"))
    more = terms.select("doc_id", "term").join(siblings(relations), "term").where(in_band(lexical_similarity(F.col("term"), F.col("sibling"))))
    more = more.select("doc_id", "term", F.col("sibling").alias("wrong"), F.lit(1).alias("source"), F.lit(0.0).alias("key"))
    once = Window.partitionBy("doc_id", "term", F.lower("wrong")).orderBy("source", "key", "wrong")
    order = Window.partitionBy("doc_id", "term").orderBy("source", "key", F.lower("wrong"))
    kept = own.unionByName(more).withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).select("doc_id", "term", "place", "wrong")
