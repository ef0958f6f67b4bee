"""Facts: fifteen patterns of properties, comparisons, purposes and processes over the token trees of sentences.

Input rows are usable sentences: doc_id, index, sentence, toks. With salience, facts are gated and weighted by how
central their sentence is and whether their term is a keyword of the document. Trees are walked sentence by sentence;
all that follows is built in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Set
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions import tree as N
from . import rules
from ._arrow import map_rows

PREDICATE_PATTERNS = ("differ_from", "unlike", "ordered_chain", "temporal_advcl")
#: leans: on a pronoun.
CANDIDATE = "family_ord:int,tok:int,pattern:string,words:string,term_text:string,term_pos:string,raw_key:string,back_text:string,leans:boolean,other_words:string"
Shape = tuple[str, N.Token | None, N.Token | None, N.Token | None]
NOTHING: Shape = ("", None, None, None)


def property_shape(s: N.Sentence, t: N.Token) -> Shape:
    lemma = N.lemma(t)
    if t["pos"] not in ("VERB", "AUX") or not (lemma == "be" or lemma in L.COMPOSITION_VERBS or lemma in L.POSSESSION_VERBS):
        return NOTHING
    subject = s.subject(t)
    if subject is None or s.negated(t):
        return NOTHING
    material = s.prep_object(t, L.COMPOSITION_PREPS)
    if lemma in L.COMPOSITION_VERBS and material is not None:
        fits = L.MIN_DEFINITION_CHARS <= len(N.text(s.phrase(material) or []).strip()) <= L.MAX_DEFINITION_CHARS
        if fits or s.child(t, "auxpass"):
            return "consist_of", subject, material, None
    if lemma in L.POSSESSION_VERBS:
        thing = s.direct_object(t)
        known = thing is not None and N.lemma(thing) in L.PROPERTY_NOUNS
        return "possess_property" if known else "possess_salient", subject, thing, None
    return ("be_of", subject, material, None) if lemma == "be" else NOTHING


def comparison_shape(s: N.Sentence, t: N.Token) -> Shape:
    """The first case whose test holds decides, even if it yields nothing."""
    lemma, above = N.lemma(t), s.parent(t)
    if lemma in L.COMPARISON_NOUNS:
        between = s.prep_object(t, ("between",))
        other = s.child(between, "conj")
        return ("difference_between", between, s.copular_complement(t), other) if other is not None else NOTHING
    if lemma in L.DIFFERS_VERBS:
        other = s.prep_object(t, ("from",))
        return ("differ_from", s.subject(t), t, other) if other is not None else NOTHING
    if t["dep"] == "prep" and lemma in L.UNLIKE_MARKERS:
        other = s.child(t, "pobj")
        return ("unlike", s.subject(above), above, other) if other is not None else NOTHING
    if t["dep"] == "acomp" and t["tag"] == "JJR":
        other = s.than_object(t)
        return ("comparative_than", s.subject(above), t, other) if other is not None else NOTHING
    return NOTHING


def purpose_shape(s: N.Sentence, t: N.Token) -> Shape:
    lemma = N.lemma(t)
    known = lemma in L.PURPOSE_VERBS or lemma in L.USEFUL_ADJECTIVES or lemma in L.ENABLING_VERBS
    if not known or t["pos"] not in ("VERB", "AUX", "ADJ") or s.negated(t):
        return NOTHING
    if lemma in L.PURPOSE_VERBS and s.child(t, "auxpass"):
        goal = s.child(t, "xcomp", "pcomp", "advcl") or s.prep_object(t, ("for",))
        return "used_for" if goal is not None and goal["dep"] == "pobj" else "used_to_xcomp", s.subject(t), goal, None
    if t["dep"] == "acomp" and lemma in L.USEFUL_ADJECTIVES:
        return "useful_for", s.subject(s.parent(t)), s.prep_object(t, ("for",)), None
    return ("enable", s.subject(t), s.direct_object(t), None) if lemma in L.ENABLING_VERBS else NOTHING


def process_shape(s: N.Sentence, t: N.Token) -> Shape:
    known = N.lemma(t) in L.PROCEDURAL_VERBS or t["dep"] == "advcl" or t["dep"] == "ROOT" and t["pos"] == "VERB"
    if not known or s.negated(t):
        return NOTHING
    if N.lemma(t) in L.PROCEDURAL_VERBS:
        return "begin_by", s.subject(t), s.prep_object(t, ("by",)), None
    if t["dep"] == "ROOT" and t["pos"] == "VERB":
        chained = any(x["pos"] == "VERB" for x in s.children(t, "conj"))
        ordered = any(x["dep"] == "advmod" and x["lower"] in L.ORDERING_ADVERBS for x in s.subtree(t))
        return ("ordered_chain", s.subject(t), t, None) if chained and ordered else NOTHING
    if t["dep"] == "advcl" and any(x["lower"] in L.TEMPORAL_MARKS for x in s.children(t, "mark", "advmod")):
        return "temporal_advcl", s.subject(s.parent(t)), s.parent(t), None
    return NOTHING


def words(*lemmas: str) -> set[str]:
    """Every word that the rule annotator gives one of the lemmas, and some more."""
    known = {**rules.IRREGULAR, **rules.NOUNS, **rules.BE, **rules.HAVE, **rules.DO}
    out = {w for w, x in known.items() if x in lemmas}
    for x in lemmas:
        out |= {x + end for end in ("", "s", "es", "d", "ed", "ing", "er", "r", x[-1] + "ed", x[-1] + "ing")}
        out |= {x[:-1] + end for end in ("ies", "ied", "ing")}
    return out


@lru_cache(4096)
def words_of(lemma: str) -> frozenset[str]:
    return frozenset(words(lemma))


def names_one(keys: Set[str]) -> Callable[[str], bool]:
    """Whether a sentence holds a word that can end a phrase of one of the keys, by the rule annotator."""
    needed = frozenset().union(*(words_of(last) for last in {x.rpartition(" ")[2] for x in keys} if last))
    return lambda text: not needed.isdisjoint(map(str.lower, rules._WORD.findall(text)))


def forms(*lemmas: str) -> re.Pattern:
    """Finds the words of the lemmas."""
    return re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(sorted(words(*lemmas)))})(?![a-z])")


def may_hold(own: Set[str]) -> bool:
    """Whether a sentence of these lemmas and words can hold a fact of any pattern, by the rule annotator."""
    return any(all(not own.isdisjoint(x) for x in sets) for sets in LEMMAS.values())


#: What sentences must hold, of each set a lemma (or the word itself), for a pattern to be found in them by the rule annotator.
LEMMAS = {
    "consist_of": (L.COMPOSITION_VERBS, L.COMPOSITION_PREPS),
    "possess_property": (L.POSSESSION_VERBS, L.PROPERTY_NOUNS),
    "possess_salient": (L.POSSESSION_VERBS,),
    "be_of": (("be",), L.COMPOSITION_PREPS),
    "difference_between": (L.COMPARISON_NOUNS, ("between",)),
    "differ_from": (L.DIFFERS_VERBS, ("from",)),
    "unlike": (L.UNLIKE_MARKERS,),
    "comparative_than": (("than",),),
    "used_to_xcomp": (L.PURPOSE_VERBS,),
    "used_for": (L.PURPOSE_VERBS, ("for",)),
    "useful_for": (L.USEFUL_ADJECTIVES, ("for",)),
    "enable": (L.ENABLING_VERBS,),
    "begin_by": (L.PROCEDURAL_VERBS, ("by",)),
    "ordered_chain": (L.ORDERING_ADVERBS,),
    "temporal_advcl": (L.TEMPORAL_MARKS,),
}
#: The same of words.
NEEDED = {pattern: tuple(frozenset(words(*x)) for x in sets) for pattern, sets in LEMMAS.items()}
SHAPES = (property_shape, comparison_shape, purpose_shape, process_shape)


def spans(s: N.Sentence, shape: Shape) -> tuple[N.Span | None, N.Span | None, N.Span | None]:
    """The spans of a shape's term, back and other side."""
    pattern, term, back, other = shape
    first = s.participant(term) if pattern == "difference_between" else s.phrase(term)
    if pattern in PREDICATE_PATTERNS:
        second = s.predicate(back, L.UNLIKE_MARKERS if pattern == "unlike" else (), pattern == "ordered_chain", pattern == "temporal_advcl")
    else:
        second = s.phrase(back)
    return first, second, None if other is None else s.participant(other)


def found(s: N.Sentence) -> Iterator[tuple]:
    """The values of CANDIDATE of each candidate."""
    for order, of in enumerate(SHAPES):
        for t in s.toks:
            shape = of(s, t)
            if shape[1] is None or shape[2] is None:
                continue
            term, back, other = spans(s, shape)
            if term and back:
                leans = any(x["lower"] in L.UNRESOLVED_PRONOUNS and x["pos"] == "PRON" for x in back)
                yield order, t["i"], shape[0], N.visible_words(term), N.text(term), N.head_of(term)["pos"], N.phrase_key(term), N.text(back), leans, N.visible_words(other or [])


def candidates(sents: DataFrame) -> DataFrame:
    """A row per candidate: doc_id, index, sentence and CANDIDATE; of trees, or of candidates that a digest has found."""
    if "facts" in sents.columns:
        return sents.select("doc_id", "index", "sentence", F.inline("facts"))

    def run(doc, index, sentence, toks) -> Iterator[tuple]:
        return ((doc, index, sentence, *x) for x in found(N.Sentence(toks)))

    kind = sents.schema["doc_id"].dataType.simpleString()
    return map_rows(sents.select("doc_id", "index", "sentence", "toks"), f"doc_id {kind}, index int, sentence string, {CANDIDATE}", run)


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def confidence(salient: bool) -> Column:
    """Of a candidate's pattern, the shape of its term, both lengths and, if known, how salient it is."""
    term, back = F.length("term_text"), F.length("back_text")
    score = literal_map(L.FACT_BASE)[F.col("pattern")] + F.when(F.col("term_pos").isin("NOUN", "PROPN"), 0.15).when(F.col("term_pos").isin("PRON", "DET"), -0.25).otherwise(0.0)
    score = score + F.when(back > term, 0.05).when(back < 1.5 * term, -0.10).otherwise(0.0)
    if salient:
        score = score + F.when(F.col("score") >= F.col("high"), 0.10).when(F.col("score") >= F.col("middle"), 0.05).otherwise(-0.05)
        score = score + F.when(F.col("salient"), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def extract(sents: DataFrame, salience: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, rank, index, term, back, family, pattern, evidence, confidence, other.

    salience: doc_id, index, score, high, middle (the cuts of the document). keys: doc_id, key (keywords without
    leading articles). Without them, facts that need salience fall away.
    """
    found = candidates(sents).withColumn("term", X.clean_term("words")).withColumn("back", X.clean_definition("back_text"))
    found = found.where((F.col("term") != "") & (F.length("back") >= L.MIN_FACT_CHARS) & ~F.col("leans"))
    if salience is None:
        found = found.where("pattern != 'temporal_advcl'")
    else:
        found = found.withColumn("raw_key", X.normalise_key("raw_key")).join(salience, ["doc_id", "index"], "left")
        found = found.join(keys.select("doc_id", F.col("key").alias("raw_key"), F.lit(True).alias("is_key")), ["doc_id", "raw_key"], "left")
        found = found.withColumn("salient", F.coalesce("is_key", F.lit(False))).fillna(0.0, ["score", "high", "middle"])
        found = found.where((F.col("pattern") != "temporal_advcl") | F.col("salient"))
    found = found.withColumn("raw", confidence(salience is not None)).where(F.col("raw") >= L.MIN_FACT_CONFIDENCE)
    first = Window.partitionBy("doc_id", F.lower("term"), F.lower("back")).orderBy("index", "family_ord", "tok")
    found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").withColumn("confidence", F.round("raw", 4))
    best = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), F.lower("term"), "index", "family_ord", "tok")
    other = X.clean_term("other_words")
    return found.withColumn("rank", F.row_number().over(best)).select(
        "doc_id", "rank", "index", "term", "back", literal_map(L.FAMILY)[F.col("pattern")].alias("family"), "pattern", X.strip("sentence").alias("evidence"), "confidence", F.when(other != "", other).alias("other")
    )
