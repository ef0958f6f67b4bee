"""Annotation: from texts to token trees, by the rules of this library or by an installed parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions import tree as N
from . import rules
from ._arrow import map_rows

SPAN = "array<struct<start:int,end:int>>"
Annotator = Callable[[str | None], tuple[list, list, list]]
NOT_INSTALLED = "is not installed"


def parser(model: str) -> Annotator:
    """An annotator of an installed parser, loaded once for each worker process; a missing model is a RuntimeError."""
    loaded: list = []

    def run(text: str | None) -> tuple[list, list, list]:
        if not loaded:
            try:
                import spacy

                loaded.append(spacy.load(model))
            except (ImportError, OSError) as error:
                raise RuntimeError(f"the model {model} {NOT_INSTALLED}") from error
        doc = loaded[0](text or "")
        tokens = []
        for number, sent in enumerate(doc.sents):
            for t in sent:
                tokens.append({"i": t.i, "text": t.text, "lower": t.lower_, "lemma": t.lemma_, "pos": t.pos_, "tag": t.tag_, "dep": t.dep_, "head": t.head.i, "anc": [a.i for a in t.ancestors], "is_alpha": t.is_alpha, "is_stop": t.is_stop, "is_punct": t.is_punct, "is_space": t.is_space, "ent_type": t.ent_type_, "ws": t.whitespace_, "sent": number})
        return tokens, [{"start": c.start, "end": c.end} for c in doc.noun_chunks], [{"start": s.start, "end": s.end} for s in doc.sents]

    return run


def annotate(docs: DataFrame, text_col: str = "text", annotator: Annotator = rules.annotate) -> DataFrame:
    """doc_id, text (normalised), tokens, chunks, sents. The only step that leaves the JVM; each text is parsed once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(doc, text) -> Iterator[tuple]:
        yield doc, text, *annotator(text)

    return map_rows(docs.select("doc_id", X.normalise(text_col).alias("text")), f"doc_id {kind}, text string, tokens {N.TOKENS}, chunks {SPAN}, sents {SPAN}", run)


def content(toks):
    return F.filter(toks, N.visible)


def sentences(annotated: DataFrame) -> DataFrame:
    """Usable sentences: doc_id, index, sentence, toks, words (content lemmas with repeats)."""
    own = F.transform("sents", lambda s: F.slice("tokens", s["start"] + 1, s["end"] - s["start"]))

    def usable(toks):
        seen = content(toks)
        letters = F.size(F.filter(seen, lambda t: t["is_alpha"])) >= L.MIN_ALPHA_SHARE * F.greatest(F.size(seen), F.lit(1))
        return X.is_usable_sentence(N.text_of(toks), F.size(seen), letters, F.exists(seen, lambda t: t["pos"].isin("VERB", "AUX")))

    rows = annotated.select("doc_id", F.posexplode(F.filter(own, usable)).alias("index", "toks"))
    topical = F.filter("toks", lambda t: t["is_alpha"] & ~t["is_stop"] & (F.length(t["text"]) > 2))
    return rows.select("doc_id", "index", X.strip(N.text_of(F.col("toks"))).alias("sentence"), "toks", F.transform(topical, lambda t: F.lower(t["lemma"])).alias("words"))


def chunks(annotated: DataFrame) -> DataFrame:
    """Noun chunks of whole documents: doc_id, start, span, total (visible tokens of the document, 1 at least)."""
    total = F.greatest(F.lit(1), F.size(content(F.col("tokens"))))
    rows = annotated.select("doc_id", "tokens", total.alias("total"), F.explode("chunks").alias("c"))
    return rows.select("doc_id", F.col("c.start").alias("start"), F.slice("tokens", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("span"), "total")


def chunk_counts(chunk_rows: DataFrame) -> DataFrame:
    """How often each chunk reads the same in a document: doc_id, chunk, freq."""
    return chunk_rows.groupBy("doc_id", F.lower(N.text_of(F.col("span"))).alias("chunk")).agg(F.count(F.lit(1)).alias("freq"))


def is_topic(text: Column) -> Column:
    """Whether a phrase's text can be a keyword: long enough, and not filler alone."""
    low = F.lower(text)
    own = F.filter(F.split(low, " +"), lambda w: ~w.isin(*L.FILLER_LINKS))
    return (F.length(text) >= L.MIN_TERM_CHARS) & ~low.isin(*L.DOMAIN_FILLER) & ~((F.size(own) > 0) & F.forall(own, lambda w: w.isin(*L.DOMAIN_FILLER)))


def phrases(chunk_rows: DataFrame) -> DataFrame:
    """Keyword candidates of noun chunks: doc_id, key, display, position, total."""
    span, text = F.col("span"), N.text_of(F.col("span"))
    seen = content(span)
    topical = F.filter(seen, lambda t: t["pos"].isin(*L.CONTENT_POS))
    fits = (
        is_topic(text)
        & F.size(seen).between(1, L.MAX_PHRASE_TOKENS)
        & (F.size(topical) > 0)
        & (F.size(topical) >= 0.5 * F.size(seen))
        & ~F.exists(topical, lambda t: t["is_stop"])
        & F.exists(seen, lambda t: t["is_alpha"])
    )
    return chunk_rows.where(fits).select("doc_id", N.key_of(span).alias("key"), X.display_form(text).alias("display"), F.col("start").alias("position"), "total")


def vocabulary(annotated: DataFrame) -> DataFrame:
    """doc_id and terms: the distinct lemmas of a document's topical words."""
    own = F.filter("tokens", lambda t: t["is_alpha"] & ~t["is_stop"] & (F.length(t["text"]) >= L.MIN_TERM_CHARS) & t["pos"].isin(*L.CONTENT_POS))
    return annotated.select("doc_id", F.array_distinct(F.transform(own, lambda t: F.lower(t["lemma"]))).alias("terms"))


def stats(annotated: DataFrame) -> DataFrame:
    """doc_id, sentences (usable), tokens, chunks."""
    counted = sentences(annotated).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    own = annotated.select("doc_id", F.size(F.filter("tokens", lambda t: ~t["is_space"])).alias("tokens"), F.size("chunks").alias("chunks"))
    return own.join(counted, "doc_id", "left").select("doc_id", F.coalesce("sentences", F.lit(0)).alias("sentences"), "tokens", "chunks")
