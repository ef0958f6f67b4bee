"""Definitions: explicit cues, copulas, hypernyms and appositives over the token trees of sentences.

Input rows are usable sentences: doc_id, index, sentence, toks; chunk_counts has doc_id, chunk (a phrase's text in
lower case) and freq over the whole document. Trees are walked sentence by sentence; all that follows is built in.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions import tree as N
from ._arrow import map_rows
from .limits import Limit, within

#: Patterns of a sentence come in this order.
CUE, COPULAR, APPOSITIVE = range(3)
#: A candidate starts from one of these labels, or from the first word of a cue.
SHOWN_BY, CUES = ("attr", "acomp", "appos"), frozenset(c[0] for c in L.CUE_PHRASES)
#: Without one of these, as a lemma or a mark, the rule annotator's trees have no candidates.
NEEDED = CUES | set(L.COPULAS) | {","}
CANDIDATE = "pattern_ord:int,tok:int,pattern:string,words:string,term_text:string,term_pos:string,single:boolean,back:string"


def passes_guards(s: N.Sentence, head: N.Token, subject: N.Token, span: N.Span) -> bool:
    """No negation, no modal, no expletive subject, no contrastive start, and a noun as the complement's head."""
    modal = N.lemma(head) in L.MODALS or any(N.lemma(x) in L.MODALS for x in s.children(head, "aux", "auxpass"))
    expletive = subject["lower"] in L.EXPLETIVE_SUBJECTS and subject["pos"] == "PRON"
    first = next(filter(N.seen, span), None)
    contrastive = first is not None and first["lower"] in L.CONTRASTIVE
    return not (s.negated(head) or modal or expletive or contrastive) and N.head_of(span)["pos"] in ("NOUN", "PROPN")


def found_in(s: N.Sentence) -> Iterator[tuple[int, N.Token, str, N.Span, N.Span]]:
    """(order, token, pattern, term, definition) of each candidate."""
    for t in s.toks:
        if t["dep"] not in SHOWN_BY and N.lemma(t) not in CUES:
            continue
        above = s.parent(t)
        if t["pos"] in ("VERB", "AUX") and any(s.starts(t, c) for c in L.CUE_PHRASES):
            shapes = [(CUE, "cue", t, s.subject(t), s.object(t))]
        elif t["dep"] in ("attr", "acomp") and (N.lemma(above) in L.COPULAS or s.child(above, "cop")):
            shapes = [(COPULAR, "copular", above, s.subject(above), t)]
        else:
            shapes = []
        if t["dep"] == "appos" and above["pos"] in ("NOUN", "PROPN"):
            shapes.append((APPOSITIVE, "appos", above, above, t))
        for order, pattern, head, subject, complement in shapes:
            term, back = (None if x is None else s.phrase(x) for x in (subject, complement))
            if term and back and (order == APPOSITIVE or passes_guards(s, head, subject, back)):
                marked = order == COPULAR and any(m in N.text(back).lower() for m in L.HYPERNYM_MARKERS)
                yield order, t, "hypernym" if marked else pattern, term, back


def found(s: N.Sentence) -> Iterator[tuple]:
    """The values of CANDIDATE of each candidate."""
    for order, t, pattern, term, back in found_in(s):
        yield order, t["i"], pattern, N.visible_words(term), N.text(term), N.head_of(term)["pos"], len(term) == 1 and term[0]["is_alpha"], N.text(back)


def candidates(sents: DataFrame) -> DataFrame:
    """A row per candidate: doc_id, index, sentence and CANDIDATE; of trees, or of candidates that a digest has found."""
    if "definitions" in sents.columns:
        return sents.select("doc_id", "index", "sentence", F.inline("definitions"))

    def run(doc, index, sentence, toks) -> Iterator[tuple]:
        return ((doc, index, sentence, *x) for x in found(N.Sentence(toks)))

    kind = sents.schema["doc_id"].dataType.simpleString()
    return map_rows(sents.select("doc_id", "index", "sentence", "toks"), f"doc_id {kind}, index int, sentence string, {CANDIDATE}", run)


def confidence(definition: Column, freq: Column) -> Column:
    """Of a candidate's pattern, the shape of its term, how often it is named, and both lengths."""
    base = F.create_map(*(F.lit(x) for pair in L.PATTERN_BASE.items() for x in pair))[F.col("pattern")]
    score = base + F.when(F.col("term_pos").isin("NOUN", "PROPN"), 0.15).when(F.col("term_pos").isin("PRON", "DET"), -0.25).otherwise(0.0)
    score = score + F.when(F.col("single"), 0.05).otherwise(0.0) + F.when(freq >= 3, 0.1).when(freq == 2, 0.05).otherwise(0.0)
    score = score + F.when(F.length(definition) > F.length("term_text"), 0.05).otherwise(0.0) - F.when(F.length(definition) < 1.5 * F.length("term_text"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def first_of_term(found: DataFrame, limit: Limit) -> DataFrame:
    """The first row (by ord) of each term of a document, best first, limit a document; rank says the place."""
    first = Window.partitionBy("doc_id", F.lower("term")).orderBy("ord")
    best = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "ord")
    kept = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return within(kept.withColumn("rank", F.row_number().over(best)), limit, "rank").select("doc_id", "rank", "index", "term", "definition", "evidence", "pattern", "confidence")


def extract(sents: DataFrame, chunk_counts: DataFrame, limit: Limit = 100) -> DataFrame:
    """doc_id, rank, index, term, definition, evidence, pattern, confidence."""
    found = candidates(sents).withColumn("term", X.clean_term("words")).withColumn("definition", X.clean_definition("back"))
    found = found.where(X.is_plausible_term("term") & F.length("definition").between(L.MIN_DEFINITION_CHARS, L.MAX_DEFINITION_CHARS))
    found = found.withColumn("chunk", F.lower("term_text")).join(chunk_counts, ["doc_id", "chunk"], "left")
    found = found.withColumn("confidence", confidence(F.col("definition"), F.coalesce("freq", F.lit(1))))
    found = found.withColumn("ord", F.struct("index", "pattern_ord", "tok")).withColumn("evidence", X.collapse("sentence"))
    return first_of_term(found, limit)
