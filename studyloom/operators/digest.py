"""What the parts of an analysis need of a document's token trees, without the trees.

A tree takes some hundred times the bytes of its words. So trees live in the Python worker that makes them, one document
at a time: the walks for definitions and facts are taken there, and a row leaves with sentences, candidates, phrases and
counts alone. The rows are those of annotate's functions over whole trees (tests hold both against each other).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions import tree as N
from . import annotate, definitions, facts, rules
from ._arrow import map_rows

#: What a digest can hold: sentences' content words, candidates of definitions (with how often their chunk is named) and
#: of facts, tokens of sentences with a definition, keyword phrases, vocabulary, numbers of tokens and chunks.
WORDS, DEFINITIONS, FACTS, TREES, PHRASES, TERMS, COUNTS = ALL = ("words", "definitions", "facts", "trees", "phrases", "terms", "counts")
#: The phrases (distinct) that name the term of a fact, instead of all phrases, where only facts ask for them; without
#: definitions, sentences are then those of documents with a candidate of a fact.
TOPICS = "topics"
#: What needs every sentence; for the rest, the rule annotator passes over those that can't be usable.
OF_ALL = {PHRASES, TERMS, COUNTS}
#: What blanking a term needs of a token.
SHOWN = ("i", "text", "pos", "is_punct", "is_space", "ent_type", "ws")
#: Fields of a sentence and columns of a row that are there if they are asked for.
OF_SENTENCE = {WORDS: "words:array<string>", DEFINITIONS: f"definitions:array<struct<{definitions.CANDIDATE}>>", FACTS: f"facts:array<struct<{facts.CANDIDATE}>>", TREES: "toks:array<struct<i:int,text:string,pos:string,is_punct:boolean,is_space:boolean,ent_type:string,ws:string>>"}
OF_ROW = {DEFINITIONS: "chunks array<struct<chunk:string,freq:long>>", PHRASES: "total int, keys array<string>, texts array<string>, starts array<int>", TERMS: "terms array<string>", COUNTS: "n_tokens int, n_chunks int", TOPICS: "topics array<struct<key:string,text:string>>"}


#: Between phrases that move as one string; a phrase that holds it is written without.
MARK = "\x00"
ASCII = re.compile("[A-Za-z]+")
ARTICLES = re.compile(rf"(?:(?:{'|'.join(L.ARTICLES)}) )+")


def names(ddl: str) -> list[str]:
    return [f.split(":")[0] for f in ddl.split(",")]


class Plain:
    """A token of an annotator's tree, as the rules' tagged tokens are."""

    __slots__ = ("text", "ws", "lemma", "pos", "alpha", "stop", "punct", "seen", "space")

    def __init__(self, t: N.Token) -> None:
        self.text, self.ws, self.lemma, self.pos, self.alpha, self.stop, self.space = t["text"], t["ws"], t["lemma"], t["pos"], t["is_alpha"], t["is_stop"], t["is_space"]
        self.punct, self.seen = t["is_punct"], N.seen(t)


Tokens = list[Plain] | list[rules.Tok]


def reader(annotator: annotate.Annotator, wanted: Callable[[str], bool] | None = None, with_chunks: bool = True) -> Callable:
    """From a text: tokens, ranges of chunks and of sentences, and what gives a range's tree. The rules make a tree when it is asked for."""
    if annotator is rules.annotate:

        def read(text: str | None) -> tuple:
            toks, chunks, sents = rules.tagged(text, wanted, with_chunks)
            return toks, chunks, sents, lambda a, b: rules.tree(toks[a:b], False)
    else:

        def read(text: str | None) -> tuple:
            trees, *ranges = annotator(text)
            return list(map(Plain, trees)), *([(r["start"], r["end"]) for r in own] for own in ranges), lambda a, b: trees[a:b]

    return read


def fits(seen: Tokens) -> bool:
    """What makes a sentence usable besides its length."""
    letters = sum([t.alpha for t in seen])
    return len(seen) >= L.MIN_SENTENCE_WORDS and letters >= L.MIN_ALPHA_SHARE * len(seen) and any(t.pos in ("VERB", "AUX") for t in seen)


def is_phrase(span: Tokens) -> bool:
    """What makes a chunk a keyword phrase besides its text."""
    seen = [t for t in span if t.seen]
    topical = [t for t in seen if t.pos in L.CONTENT_POS]
    return 1 <= len(seen) <= L.MAX_PHRASE_TOKENS and 0 < len(topical) >= 0.5 * len(seen) and not any([t.stop for t in topical]) and any([t.alpha for t in seen])


def written(span: Tokens) -> str:
    return "".join([t.text + t.ws for t in span]).rstrip(" ")


def key_of(span: Tokens) -> str:
    return " ".join([t.lemma.lower() for t in span if not t.punct])


def bare(key: str) -> str:
    """As normalise_key."""
    return key[m.end() :] if (m := ARTICLES.match(key)) else key


def digest(docs: DataFrame, annotator: annotate.Annotator = rules.annotate, of: tuple[str, ...] = ALL, text_col: str = "text", wanted: Callable[[str], bool] | None = None, in_text: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, sents, and what of names; wanted as of the rules. With in_text, none of texts that wanted is not true of."""
    asked, ids = set(of), docs.schema["doc_id"].dataType.simpleString()
    by_rules, whole = annotator is rules.annotate, not asked.isdisjoint(OF_ALL)
    read = reader(annotator, wanted or (None if whole else rules.may_be_usable), whole)
    of_back, of_key = names(definitions.CANDIDATE).index("term_text"), names(facts.CANDIDATE).index("raw_key")
    walked = [x for x in OF_SENTENCE if x in asked]
    of_facts = TOPICS in asked and DEFINITIONS not in asked

    def chunks_of(text, tokens, chunks, ranges, sought) -> Iterator[Tokens]:
        if by_rules and not whole:  # the chunks of other sentences too, if they can be among those that are asked for
            return rules.chunks_where(text, sought, {tokens[a].sent: tokens[a:b] for a, b in ranges})
        return (tokens[a:b] for a, b in chunks)

    def run(doc, repeated, text) -> Iterator[tuple]:
        text = X.normalised(text)
        if in_text and not wanted(text or ""):
            return
        tokens, chunks, ranges, tree = read(text)
        sents, backs, raw_keys, states_any = [], set(), set(), False
        for a, b in ranges:
            toks = tokens[a:b]
            if not fits([t for t in toks if t.seen]):
                continue
            sentence = written(toks).strip()
            if not L.MIN_SENTENCE_CHARS <= len(sentence) <= L.MAX_SENTENCE_CHARS:
                continue
            own = dict.fromkeys(walked, ())
            own[TREES], own[FACTS] = None, ()
            if WORDS in asked:
                own[WORDS] = [t.lemma for t in toks if t.alpha and not t.stop and len(t.text) > 2]
            lemmas = {x for t in toks for x in (t.lemma, t.low)} if by_rules else None
            defines = DEFINITIONS in asked and (lemmas is None or not definitions.NEEDED.isdisjoint(lemmas))
            states = FACTS in asked and (lemmas is None or facts.may_hold(lemmas))
            if defines or states:
                s = N.Sentence(tree(a, b))
                if defines:
                    own[DEFINITIONS] = list(definitions.found(s))
                    backs.update(x[of_back].lower() for x in own[DEFINITIONS])
                    if own[DEFINITIONS]:
                        own[TREES] = [tuple([t[x] for x in SHOWN]) for t in s.toks] if TREES in asked else None
                if states:
                    own[FACTS] = list(facts.found(s))
                    raw_keys.update(bare(x[of_key]) for x in own[FACTS])
            states_any = states_any or bool(own[FACTS])
            sents.append((sentence, *(own[x] for x in walked)))
        if of_facts and not states_any and not repeated:  # nobody asks how central the sentences of such a document are
            sents = []
        more = []
        if DEFINITIONS in asked:
            sought = None if repeated else rules.holds(backs)
            named = Counter(written(span).lower() for span in chunks_of(text, tokens, chunks, ranges, sought)) if backs or repeated else {}
            more.append([(k, n) for k, n in named.items() if repeated or k in backs])
        if PHRASES in asked:
            spans = [(a, span) for a, b in chunks if is_phrase(span := tokens[a:b])]
            more += [max(1, sum([t.seen for t in tokens])), [key_of(span).replace(MARK, "") for _, span in spans], [written(span).replace(MARK, "") for _, span in spans], [at for at, _ in spans]]
        if TERMS in asked:
            more.append(list(dict.fromkeys([t.lemma for t in tokens if t.pos in L.CONTENT_POS and t.alpha and not t.stop and len(t.text) >= L.MIN_TERM_CHARS])))
        if COUNTS in asked:
            more += [sum([not t.space for t in tokens]), len(chunks)]
        if TOPICS in asked:
            sought = None if repeated else facts.names_one(raw_keys)
            spans = chunks_of(text, tokens, chunks, ranges, sought) if raw_keys or repeated else ()
            more.append(list({(key, written(span)): None for span in spans if (bare(key := key_of(span)) in raw_keys or repeated) and is_phrase(span)}))
        yield doc, sents, *more

    rows = docs.select("doc_id", F.lit(False).alias("repeated"), F.col(text_col).alias("text"))
    if not asked.isdisjoint((DEFINITIONS, TOPICS)):
        # Chunks and topics are those of all rows of an id: rows of an id that comes once need only those that a definition or a fact names.
        often = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("often"))
        if not often.isEmpty():  # texts are dealt by id only then
            rows = rows.join(often, "doc_id", "left").select("doc_id", F.coalesce("often", F.lit(False)).alias("repeated"), "text")
    sent = ",".join(["sentence:string", *(OF_SENTENCE[part] for part in walked)])
    return map_rows(rows, ", ".join([f"doc_id {ids}, sents array<struct<{sent}>>", *(x for part, x in OF_ROW.items() if part in asked)]), run)


def sentences(made: DataFrame) -> DataFrame:
    """Usable sentences: doc_id, index, sentence, and words, definitions, facts, toks as far as the digest has them."""
    rows = made.select("doc_id", F.posexplode("sents").alias("index", "s"))
    more = [F.transform("s.words", F.lower).alias(x) if x == "words" else F.col(f"s.{x}") for x in made.schema["sents"].dataType.elementType.names[1:]]
    return rows.select("doc_id", "index", F.col("s.sentence").alias("sentence"), *more)


def chunk_counts(made: DataFrame) -> DataFrame:
    """How often each chunk that a definition may ask for reads the same in a document: doc_id, chunk, freq."""
    return made.select("doc_id", F.inline("chunks")).groupBy("doc_id", "chunk").agg(F.sum("freq").alias("freq"))


def phrases(made: DataFrame) -> DataFrame:
    """Keyword candidates: doc_id, key, display, position, total."""
    return topical(made.select("doc_id", "total", F.explode(F.arrays_zip("keys", "texts", "starts")).alias("p")))


def gathered_phrases(made: DataFrame) -> DataFrame:
    """phrases, all of an id in one partition: they move once, a row a document, as two strings."""
    lists = ("keys", "texts")
    rows = made.select("doc_id", "total", *(F.when(F.size(x) > 0, F.array_join(x, MARK)).alias(x) for x in lists), "starts").repartition("doc_id")
    rows = rows.select("doc_id", "total", *(F.split(x, MARK).alias(x) for x in lists), "starts")
    return topical(rows.select("doc_id", "total", F.explode(F.arrays_zip("keys", "texts", "starts")).alias("p")))


def topical(rows: DataFrame) -> DataFrame:
    return rows.where(annotate.is_topic(F.col("p.texts"))).select("doc_id", F.lower("p.keys").alias("key"), X.display_form(F.col("p.texts")).alias("display"), F.col("p.starts").alias("position"), "total")


def topics(made: DataFrame) -> DataFrame:
    """doc_id and key of the keyword candidates that name the term of a fact; of all candidates if the digest has them."""
    if "topics" not in made.columns:
        return phrases(made).select("doc_id", "key")
    return made.select("doc_id", F.inline("topics")).where(annotate.is_topic(F.col("text"))).select("doc_id", F.lower("key").alias("key"))


def words(made: DataFrame) -> DataFrame:
    """doc_id, index and words of usable sentences, all of an id in one partition: they move once, a row a document."""
    rows = made.select("doc_id", F.col("sents.words").alias("own")).repartition("doc_id")
    return rows.select("doc_id", F.posexplode("own").alias("index", "own")).select("doc_id", "index", F.transform("own", F.lower).alias("words"))


def vocabulary(made: DataFrame, *more: str) -> DataFrame:
    """doc_id and terms: the distinct lemmas of a document's topical words; more lists of words, in lower case."""
    return made.select("doc_id", F.array_distinct(F.transform("terms", F.lower)).alias("terms"), *(F.transform(x, F.lower).alias(x) for x in more))


def stats(made: DataFrame) -> DataFrame:
    """doc_id, sentences (usable), tokens, chunks."""
    counted = made.groupBy("doc_id").agg(F.sum(F.size("sents.sentence")).alias("sentences"))
    own = made.select("doc_id", F.col("n_tokens").alias("tokens"), F.col("n_chunks").alias("chunks"))
    return own.join(counted, "doc_id", "left").select("doc_id", F.coalesce("sentences", F.lit(0)).alias("sentences"), "tokens", "chunks")


def sentences_with(pattern: str) -> Callable[[str], bool]:
    """Whether a sentence holds a word of each set that the fact pattern can't do without."""
    needed = facts.NEEDED[pattern]

    def wanted(text: str) -> bool:
        own = set(map(str.lower, set(ASCII.findall(text))))
        return not any([x.isdisjoint(own) for x in needed])

    return wanted


def long_enough_with(pattern: str) -> Callable[[str], bool]:
    """sentences_with, of sentences that aren't too short to be usable."""
    wanted = sentences_with(pattern)
    return lambda text: len(text) >= L.MIN_SENTENCE_CHARS and wanted(text)


def pattern_facts(docs: DataFrame, pattern: str) -> DataFrame:
    """Candidates of one fact pattern, of trees of the sentences that can have one: doc_id and the columns of facts.found."""
    wanted = long_enough_with(pattern)
    made = digest(docs, of=(FACTS,), wanted=wanted, in_text=True)  # a sentence has no word that its text lacks
    return sentences(made).select("doc_id", F.inline("facts")).where(F.col("pattern") == pattern)
