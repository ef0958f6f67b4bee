"""Spans and walks in the token tree of a sentence.

The walks stop at the first node that decides and feed one another, which nested column expressions can only say by
repeating themselves; so they are plain functions over one sentence's tokens and run behind Arrow batches, as the
annotator does. A few simple column functions over token arrays stand at the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

TOKEN = "struct<i:int,text:string,lower:string,lemma:string,pos:string,tag:string,dep:string,head:int,anc:array<int>,is_alpha:boolean,is_stop:boolean,is_punct:boolean,is_space:boolean,ent_type:string,ws:string,sent:int>"
TOKENS = f"array<{TOKEN}>"

Token = dict
Span = list[Token]


def lemma(t: Token) -> str:
    return t["lemma"].lower()


def seen(t: Token) -> bool:
    return not t["is_punct"] and not t["is_space"]


def text(span: Span) -> str:
    """The span as written, without what follows its last token."""
    return "".join(t["text"] + t["ws"] for t in span).rstrip()


def visible_words(span: Span) -> str:
    return " ".join(t["text"] for t in span if seen(t))


def head_of(span: Span) -> Token:
    """The token whose parent lies outside of the span, or is itself."""
    first, last = span[0]["i"], span[-1]["i"]
    return next((t for t in span if not first <= t["head"] <= last or t["head"] == t["i"]), span[-1])


def phrase_key(span: Span) -> str:
    return " ".join(lemma(t) for t in span if not t["is_punct"])


@dataclass
class Sentence:
    """One sentence's tokens; walks never leave it."""

    toks: Span

    def __post_init__(self) -> None:
        self.by = {t["i"]: t for t in self.toks}

    @cached_property
    def under(self) -> dict[int, Span]:
        out = defaultdict(list)
        for t in self.toks:
            if t["head"] != t["i"]:
                out[t["head"]].append(t)
        return out

    @cached_property
    def negations(self) -> Span:
        return [t for t in self.toks if t["dep"] == "neg"]

    def parent(self, t: Token) -> Token:
        return self.by.get(t["head"], t)

    def children(self, t: Token, *deps: str) -> Iterator[Token]:
        return (x for x in self.under.get(t["i"], ()) if not deps or x["dep"] in deps)

    def child(self, t: Token | None, *deps: str) -> Token | None:
        return None if t is None else next(self.children(t, *deps), None)

    def below(self, t: Token, out: Callable[[Token], bool] | None = None) -> Span:
        """t and what hangs off it, in no order, without the nodes that out is true of and all below them."""
        found = [t]
        for x in found:
            if own := self.under.get(x["i"]):
                found += own if out is None else [y for y in own if not out(y)]
        return found

    def subtree(self, t: Token) -> Span:
        return sorted(self.below(t), key=lambda x: x["i"])

    def path(self, x: Token, t: Token) -> Iterator[Token]:
        """x and its ancestors below t, nearest first."""
        while x["i"] != t["i"]:
            yield x
            above = self.parent(x)
            if above is x or above["i"] == x["i"]:
                return
            x = above

    def subject(self, t: Token | None) -> Token | None:
        return self.child(t, "nsubj", "nsubjpass")

    def direct_object(self, t: Token) -> Token | None:
        return self.child(t, "dobj", "attr", "oprd")

    def prep_object(self, t: Token, preps: Sequence[str] | None, deps: Sequence[str] = ("pobj", "pcomp")) -> Token | None:
        """The first object under a preposition of t: one of preps, any if None."""
        found = (self.child(p, *deps) for p in self.children(t, "prep") if preps is None or lemma(p) in preps)
        return next((x for x in found if x is not None), None)

    def object(self, t: Token) -> Token | None:
        return self.direct_object(t) or self.prep_object(t, None, ("pobj",))

    def copular_complement(self, noun: Token) -> Token | None:
        """What a copula above noun says of it."""
        above = self.parent(noun)
        copula = above is not noun and (lemma(above) == "be" or self.child(above, "cop"))
        return self.child(above, "attr", "acomp") if copula else None

    def than_object(self, adjective: Token) -> Token | None:
        """The other side of a comparison: the object of than, or the clause that than opens."""
        for x in self.children(adjective, "prep", "advcl"):
            found = self.child(x, "pobj") if x["dep"] == "prep" and lemma(x) == "than" else x if x["dep"] == "advcl" and any(m["lower"] == "than" for m in self.children(x, "mark")) else None
            if found is not None:
                return found
        return None

    def starts(self, t: Token, lemmas: Sequence[str]) -> bool:
        """Whether t and the tokens after it have these lemmas."""
        return all((x := self.by.get(t["i"] + k)) is not None and lemma(x) == w for k, w in enumerate(lemmas))

    def negated(self, t: Token) -> bool:
        return any(x["i"] == t["i"] or any(n["head"] == t["i"] for n in self.path(x, t)) for x in self.negations)

    def enclosing(self, kept: Span) -> Span | None:
        """All tokens from the first visible kept one to the last."""
        numbers = [t["i"] for t in kept if seen(t)]
        first, last = min(numbers, default=0), max(numbers, default=0)
        if not numbers:
            return None
        start = self.toks[0]["i"]  # tokens of a sentence follow one another
        return self.toks[first - start : last - start + 1]

    def opens_clause(self, x: Token) -> bool:
        above = self.parent(x)
        return x["dep"] == "conj" and above["dep"] != "conj" and above["pos"] in ("VERB", "AUX")

    def phrase(self, t: Token) -> Span | None:
        """The noun phrase that t heads."""
        out = lambda n: n["dep"] in L.EXCLUDED_FROM_PHRASE or self.opens_clause(n)
        return self.enclosing(self.below(t, out))

    def participant(self, t: Token) -> Span | None:
        """t with its modifiers, without what continues the clause."""
        return self.enclosing(self.below(t, lambda n: n["dep"] in L.PARTICIPANT_DROP))

    def without_conjuncts(self, t: Token) -> Span | None:
        """t's phrase without the conjuncts (and all below them) and conjunctions that hang off t itself."""
        gone = lambda x: any(n["head"] == t["i"] and (n["dep"] == "conj" or n["dep"] == "cc" and n is x) for n in self.path(x, t))
        return self.enclosing([x for x in self.subtree(t) if not gone(x)])

    def predicate(self, verb: Token, exclude: Sequence[str] = (), conjunctions: bool = False, trailing: bool = False) -> Span | None:
        """verb with all that completes it. On the way up from a token, the first node that stops decides."""

        def dropped(x: Token) -> bool:
            for n in self.path(x, verb):
                if n["dep"] == "conj" and conjunctions or n["dep"] == "advcl" and trailing and n["i"] > verb["i"]:
                    return False
                if n["dep"] in L.PREDICATE_DROP or n["dep"] == "prep" and lemma(n) in exclude:
                    return True
            return False

        return self.enclosing([x for x in self.subtree(verb) if seen(x) and not dropped(x)])

    def find(self, wanted: str, most: int = 8) -> Span | None:
        """The first run of up to most tokens that reads like wanted, in any case."""
        low = wanted.lower()
        for a in range(len(self.toks)):
            for n in range(1, min(most, len(self.toks) - a) + 1):
                if text(self.toks[a : a + n]).lower() == low:
                    return self.toks[a : a + n]
        return None


Test = Callable[[Column], Column]


def visible(t: Column) -> Column:
    return ~t["is_punct"] & ~t["is_space"]


def text_of(span: Column) -> Column:
    return F.rtrim(F.array_join(F.transform(span, lambda x: F.concat(x["text"], x["ws"])), ""))


def key_of(span: Column) -> Column:
    """Lower-cased lemmas of the tokens that are no marks, joined by spaces; determiners stay."""
    return F.array_join(F.transform(F.filter(span, lambda x: ~x["is_punct"]), lambda x: F.lower(x["lemma"])), " ")
