"""A small English annotator of rules: words, lemmas, parts of speech and a shallow dependency tree.

It covers the constructions that the patterns of this library read: subjects, objects, copulas, passives, modals,
negation, prepositions, coordination of nouns and of clauses, relative and participle clauses, appositives, open
complements, adverbial clauses and comparatives. It is no general parser; an annotator with better trees can take its
place, as every operator reads the token schema alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions import lexicon as L

WORD = r"[A-Za-zÀ-ɏ0-9]+(?:['’\-][A-Za-zÀ-ɏ0-9]+)*"
_TOKEN = re.compile(rf"({WORD}|[^\sA-Za-zÀ-ɏ0-9])(\s?)")
_WORD = re.compile(WORD)
_LETTERS = re.compile("[a-z]+")

#: What ends a sentence, with its mark.
_BREAK = re.compile(r"[.!?]\s+|\n+")

#: So few phrases are looked for in a sentence before its words are taken apart.
FEW = 16
#: Words of which a worker remembers what holds in any place.
WORDS_KEPT = 1 << 16

# Closed classes and common open-class words; our own lists.
DET = set("a an the this that these those each every some any no all both another either neither such".split())
POSSESSIVE = set("its their his her our your my whose".split())
PRON = set("it they he she we you i them him us me who what one itself themselves something nothing everything anyone someone".split())
PREP = set("of in on at by for with from to into onto over under between among through during against about above below per via without within than as unlike like across after before upon out contrary".split())
SUB = set("when whenever because although though if unless while whereas since until where once so".split())
CC = set("and or but nor".split())
MODAL = set("can could will would shall should may might must".split())
BE = {"be": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "am": "be"}
HAVE = {"have": "have", "has": "have", "had": "have", "having": "have"}
DO = {"do": "do", "does": "do", "did": "do"}
ADV = set("not never then next finally lastly firstly first subsequently afterwards also only very too always often usually immediately again therefore thus however just more most less least quickly once entirely there here together faster".split())
ADJ = set("linear non-linear binary fixed same different similar new old large small big long short high low fast slow simple complex main last next first second useful helpful essential important necessary contiguous dynamic logarithmic constant quadratic random logical physical single double two-way good better best worst early late other many few several various common viable alternative empty full free open true false".split())
VERBS = set(
    "access add allow apply arise ask assign attach avoid be become begin belong bind bring build call carry cause change check choose collect combine come compare compose comprise compute connect consist contain control convert copy create decode define delete denote depend describe design determine differ divide do draw employ enable encode end ensure enter execute exist expand explain express extend fail fetch find follow form generate get give go grow guarantee handle happen hash have help hold identify implement improve include increase indicate insert involve join keep know lead learn leave let lie link list locate lose make manage map mean measure merge move need note occur offer open operate order organise organize own pass perform permit place point pop prevent process produce program protect prove provide push put raise reach read receive record reduce refer reject release rely remain remove repeat replace represent require resolve return reverse run save search seem select send serve set share show solve sort speed split start stay stop store study support swap take tell term test traverse treat turn understand update use vary visit wait walk want work write appear chain".split()
)
IRREGULAR = {"known": "know", "knew": "know", "meant": "mean", "held": "hold", "kept": "keep", "built": "build", "found": "find", "given": "give", "gave": "give", "taken": "take", "took": "take", "made": "make", "written": "write", "wrote": "write", "put": "put", "set": "set", "read": "read", "run": "run", "ran": "run", "begun": "begin", "began": "begin", "became": "become", "shown": "show", "grown": "grow", "chosen": "choose", "lost": "lose", "led": "lead", "left": "leave", "sent": "send", "bound": "bind", "split": "split", "let": "let", "did": "do", "done": "do", "understood": "understand", "brought": "bring", "said": "say"}
NOUNS = {"vertices": "vertex", "indices": "index", "data": "datum", "halves": "half", "children": "child", "men": "man", "people": "people", "matrices": "matrix", "analyses": "analysis", "feet": "foot", "leaves": "leaf", "bus": "bus", "process": "process", "access": "access", "address": "address", "class": "class", "this": "this", "lens": "lens", "series": "series", "status": "status"}
ADJ_ENDS = ("al", "ous", "ive", "able", "ible", "ful", "ic", "less", "ary", "ant", "ent", "linear")
NOUN_ENDS = ("tion", "sion", "ment", "ness", "ity", "ance", "ence", "ism", "ship", "ure", "ogy")


VERB_ENDS = (("ies", ("y",), "VBZ"), ("es", ("", "e"), "VBZ"), ("s", ("",), "VBZ"), ("ied", ("y",), "VBN"), ("ed", ("", "e"), "VBN"), ("ing", ("", "e"), "VBG"))


def form_of(low: str) -> tuple[str, str] | None:
    """(lemma, tag) if the word can be a form of a known verb."""
    if low in BE:
        return "be", "VBZ"
    if low in HAVE:
        return "have", "VBZ"
    if low in DO:
        return "do", "VBZ"
    if low in IRREGULAR:
        return IRREGULAR[low], "VBN"
    if low in VERBS:
        return low, "VB"
    for end, bases, tag in VERB_ENDS:
        if low.endswith(end):
            stem = low[: -len(end)]
            for base in bases:
                if stem + base in VERBS:
                    return stem + base, tag
            if end in ("ed", "ing") and len(stem) > 2 and stem[-1] == stem[-2] and stem[:-1] in VERBS:
                return stem[:-1], tag
    return None


#: Every form of a known verb; there are few, so words are looked up.
VERB_FORMS = {w: form_of(w) for w in {*BE, *HAVE, *DO, *IRREGULAR, *VERBS} | {v.removesuffix(base) + end for v in VERBS for end, bases, _ in VERB_ENDS for base in bases if v.endswith(base)} | {v + v[-1] + end for v in VERBS for end in ("ed", "ing")}}
verb_lemma = VERB_FORMS.get
#: Sentences without one of these have no verb.
VERBAL = frozenset(VERB_FORMS) | MODAL


@lru_cache(WORDS_KEPT)
def noun_lemma(low: str) -> str:
    if low in NOUNS:
        return NOUNS[low]
    if low.endswith("ies") and len(low) > 4:
        return low[:-3] + "y"
    if low.endswith(("ses", "xes", "ches", "shes", "zes")) and not low.endswith(("bases", "cases", "uses", "nodes")):
        return low[:-2]
    return low[:-1] if low.endswith("s") and not low.endswith(("ss", "us", "is")) and len(low) > 3 else low


@lru_cache(WORDS_KEPT)
def looks(text: str) -> tuple[str, bool, bool, tuple[str, str, str] | None]:
    """In lower case, whether it is letters alone, whether it is a stop word, and what anywhere says."""
    low = text.lower()
    return low, text.isalpha(), low in _STOP, anywhere(text)


class Tok:
    __slots__ = ("i", "text", "ws", "low", "alpha", "stop", "known", "lemma", "pos", "tag", "dep", "head", "sent")
    space = False

    def __init__(self, i: int, text: str, ws: str, sent: int = 0) -> None:
        self.i, self.text, self.ws, self.sent = i, text, ws, sent
        self.low, self.alpha, self.stop, self.known = looks(text)
        self.lemma = self.pos = self.tag = self.dep = ""
        self.head = -1

    @property
    def punct(self) -> bool:
        return self.pos == "PUNCT"

    @property
    def seen(self) -> bool:
        return self.pos != "PUNCT"


def anywhere(text: str) -> tuple[str, str, str] | None:
    """(lemma, part of speech, tag) of a word that has them in any place; of a plain noun, those after a sentence's
    first word; None if neighbours decide. The order of the cases is that of tag."""
    low = text.lower()
    if not re.match(r"[A-Za-zÀ-ɏ0-9]", text):
        return low, "PUNCT", text
    if low.isdigit() or low in ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "zero"):
        return low, "NUM", "CD"
    if low in MODAL:
        return low, "AUX", "MD"
    if low in ("not", "n't"):
        return low, "PART", "RB"
    if low in ("there", "to", "that", "which", "who", "once", "after", "before", "first", "next", "last", "faster") or low in DET or low in BE or low in HAVE or low in DO:
        return None
    if low in POSSESSIVE:
        return low, "PRON", "PRP$"
    if low in CC:
        return low, "CCONJ", "CC"
    if low in SUB:
        return low, "SCONJ", "WRB" if low.startswith("whe") else "IN"
    if low in PREP:
        return low, "ADP", "IN"
    if low in PRON:
        return low, "PRON", "PRP"
    if low in ADV or low.endswith("ly") and len(low) > 4:
        return low, "ADV", "RB"
    if low.endswith("er") and len(low) > 4 or verb_lemma(low) or low in ADJ or low.endswith(ADJ_ENDS):
        return None
    lemma = noun_lemma(low)
    return lemma, *(("PROPN", "NNP") if text[:1].isupper() else ("NOUN", "NNS" if lemma != low else "NN"))


def tag(toks: list[Tok]) -> None:
    """Parts of speech and lemmas, left to right, from the word, its ending and its neighbours."""
    for k, t in enumerate(toks):
        if (known := t.known) and (k or known[1] != "PROPN"):
            t.lemma, t.pos, t.tag = known
            continue
        low, prev, after = t.low, toks[k - 1] if k else None, toks[k + 1] if k + 1 < len(toks) else None
        t.lemma = low
        before = prev
        back = k - 1
        while back >= 0 and toks[back].pos in ("ADV", "PART"):
            back -= 1
        before = toks[back] if back >= 0 else None
        nominal = before is not None and before.pos in ("NOUN", "PROPN", "PRON")
        if not re.match(r"[A-Za-zÀ-ɏ0-9]", t.text):
            t.pos, t.tag = "PUNCT", t.text
        elif low.isdigit() or low in ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "zero"):
            t.pos, t.tag = "NUM", "CD"
        elif low in MODAL:
            t.pos, t.tag = "AUX", "MD"
        elif low in ("not", "n't"):
            t.pos, t.tag = "PART", "RB"
        elif low == "there" and after is not None and after.low in BE:
            t.pos, t.tag = "PRON", "EX"
        elif low == "to" and after is not None and after.low in VERBS and not (after.low.endswith("s")) and not (k + 2 < len(toks) and toks[k + 2].low in BE):
            t.pos, t.tag = "PART", "TO"
        elif low in ("that", "which", "who") and nominal and prev is before and after is not None and (verb_lemma(after.low) or after.low in MODAL):
            t.pos, t.tag = "PRON", "WDT"
        elif low in DET:
            alone = after is None or after.low in BE or after.low in MODAL or after.low in HAVE
            t.pos, t.tag = ("PRON", "DT") if alone and low not in ("a", "an", "the") else ("DET", "DT")
        elif low in POSSESSIVE:
            t.pos, t.tag = "PRON", "PRP$"
        elif low in CC:
            t.pos, t.tag = "CCONJ", "CC"
        elif low in SUB and not (low == "once" and not opens_a_clause(toks, k)):
            t.pos, t.tag = "SCONJ", "WRB" if low.startswith("whe") else "IN"
        elif low in ("after", "before") and opens_a_clause(toks, k):
            t.pos, t.tag = "SCONJ", "IN"
        elif low in PREP:
            t.pos, t.tag = "ADP", "IN"
        elif low in PRON:
            t.pos, t.tag = "PRON", "PRP"
        elif low in BE or low in HAVE or low in DO:
            t.lemma = verb_lemma(low)[0]
            t.pos, t.tag = ("AUX" if low in BE or follows_verb(toks, k) else "VERB"), "VBZ"
        elif low in ADV and not (low in ("first", "next", "last") and after is not None and is_nominal_word(after) and not (prev is not None and prev.pos in ("NOUN", "PROPN"))) and not (low == "faster"):
            t.pos, t.tag = "ADV", "RB"
        elif low.endswith("ly") and len(low) > 4:
            t.pos, t.tag = "ADV", "RB"
        elif low.endswith("er") and len(low) > 4 and after is not None and after.low == "than":
            t.pos, t.tag = "ADJ", "JJR"
            t.lemma = low[:-2]
        elif (found := verb_lemma(low)) and verb_here(toks, k, before, prev, after, found):
            t.lemma, t.tag = found
            t.pos = "VERB"
        elif low in ADJ or low.endswith(ADJ_ENDS) and not (prev is not None and prev.pos in ("ADP", "DET") and (after is None or not is_nominal_word(after))) and not low.endswith(("ment", "element", "parent", "client", "signal", "interval", "component", "event", "variable", "table", "music", "logic", "topic", "argument", "document", "student", "key")):
            t.pos, t.tag = "ADJ", "JJ"
        elif (found := verb_lemma(low)) and found[1] == "VBN" and after is not None and is_nominal_word(after):
            t.pos, t.tag = "ADJ", "JJ"
        else:
            t.lemma = noun_lemma(low)
            proper = t.text[:1].isupper() and (k > 0 or t.text[1:].isupper() and len(t.text) > 1)
            t.pos, t.tag = ("PROPN", "NNP") if proper else ("NOUN", "NNS" if t.lemma != low else "NN")


NOT_NOMINAL = frozenset(DET | PRON | PREP | CC | MODAL | ADV | SUB | set(BE) | set(HAVE) | set(DO) | POSSESSIVE)


def is_nominal_word(t: Tok) -> bool:
    low = t.low
    return "a" <= low[:1] <= "z" and low not in NOT_NOMINAL and not low.endswith("ly")


def opens_a_clause(toks: list[Tok], k: int) -> bool:
    """Whether a verb comes before the next mark."""
    for t in toks[k + 1 : k + 12]:
        if t.text in ",.;:":
            return False
        if t.low in BE or t.low in HAVE or t.low in DO or t.low in MODAL:
            return True
        found = verb_lemma(t.low)
        if found and found[1] == "VBZ":
            return True
    return False


def follows_verb(toks: list[Tok], k: int) -> bool:
    """Whether a participle or base form follows, so that have and do are auxiliaries."""
    for t in toks[k + 1 : k + 4]:
        if t.low in ADV or t.low in ("not", "n't") or t.low.endswith("ly"):
            continue
        if t.low in BE:
            return t.low == "been"
        found = verb_lemma(t.low)
        return bool(found) and (found[1] == "VBN" or toks[k].low in DO and found[1] == "VB")
    return False


def verb_here(toks: list[Tok], k: int, before: Tok | None, prev: Tok | None, after: Tok | None, found: tuple[str, str]) -> bool:
    form = found[1]
    if prev is not None and (prev.tag == "TO" or prev.tag == "MD"):
        return True
    if before is not None and (before.tag == "MD" or before.lemma == "do" and before.pos == "AUX"):
        return True
    if form == "VBN":
        if before is not None and before.lemma in ("be", "have"):
            return True
        if before is not None and before.pos in ("NOUN", "PROPN") and after is not None and (after.low in PREP or after.low in DET):
            return True
        return before is not None and before.pos in ("PRON",)
    if form == "VBG":
        if before is not None and before.pos in ("ADP", "AUX"):
            return not (after is not None and after.low in BE)
        return before is not None and before.pos in ("NOUN", "PROPN") and after is not None and (after.low in PREP or after.low in DET)
    plural = before is not None and before.pos in ("NOUN", "PROPN", "PRON") and (before.tag in ("NNS", "PRP", "WDT") or before.text.lower().endswith("s"))
    ends = after is None or not is_nominal_word(after) or after.low in ADJ or after.low in ADV or after.low.endswith(ADJ_ENDS)
    joined = before is not None and (before.pos == "CCONJ" or before.text == ",") and any(x.pos == "VERB" for x in toks[:k])
    if form == "VBZ":
        if joined and ends:
            return True
        if prev is not None and prev.text == "," and ends and any(x.pos in ("NOUN", "PROPN") for x in toks[:k]):
            return True
        return before is not None and (before.pos in ("NOUN", "PROPN") and before.tag != "NNS" or before.tag in ("PRP", "WDT", "DT") and before.pos == "PRON") and (after is None or ends or not any(x.pos in ("VERB", "AUX") for x in toks[clause_start(toks, k) : k]))
    return plural and (ends or not any(x.pos in ("VERB", "AUX") for x in toks[clause_start(toks, k) : k])) and not (before.tag == "PRP$")


def clause_start(toks: list[Tok], k: int) -> int:
    while k > 0 and not (toks[k - 1].pos in ("SCONJ", "CCONJ") or toks[k - 1].text in (",", ";") or toks[k - 1].tag == "WDT"):
        k -= 1
    return k


@dataclass
class Clause:
    verb: Tok | None = None
    subject: Tok | None = None
    subject_ws: list[Tok] = field(default_factory=list)
    object: Tok | None = None
    auxiliaries: list[Tok] = field(default_factory=list)
    adverbs: list[Tok] = field(default_factory=list)
    preps: list[Tok] = field(default_factory=list)
    mark: Tok | None = None
    kind: str = "ROOT"
    above: Tok | None = None
    cc: Tok | None = None
    passive: bool = False


def attach(t: Tok, head: Tok, dep: str) -> None:
    t.head, t.dep = head.i, dep


def noun_phrases(toks: list[Tok]) -> list[tuple[int, int]]:
    """Ranges of base noun phrases, each ending at its head."""
    out, k = [], 0
    while k < len(toks):
        if toks[k].tag in ("WDT", "EX") or toks[k].pos == "PRON" and toks[k].tag in ("PRP", "DT"):
            out.append((k, k + 1))
            k += 1
            continue
        end, last = k, -1
        while end < len(toks) and (toks[end].pos in ("DET", "ADJ", "NUM", "NOUN", "PROPN") or toks[end].tag == "PRP$") and toks[end].tag != "JJR":
            if toks[end].pos == "DET" and end > k:
                break
            if toks[end].pos in ("NOUN", "PROPN", "NUM"):
                last = end
            end += 1
        if last >= 0 and any(x.pos in ("NOUN", "PROPN") for x in toks[k : last + 1]):
            out.append((k, last + 1))
            k = last + 1
        else:
            k += 1
    return out


def build(toks: list[Tok]) -> list[tuple[int, int]]:
    """Heads and labels for a tagged sentence; returns its noun phrases."""
    phrases = noun_phrases(toks)
    starts = {a: b for a, b in phrases}
    for a, b in phrases:
        head = toks[b - 1]
        for t in toks[a : b - 1]:
            attach(t, head, "det" if t.pos == "DET" else "poss" if t.tag == "PRP$" else "nummod" if t.pos == "NUM" else "amod" if t.pos == "ADJ" else "compound")

    clause = Clause()
    clauses = [clause]
    last: Tok | None = None  # the last noun or verb
    noun: Tok | None = None  # the last noun of the clause
    prep: Tok | None = None  # a preposition that waits for its object
    cc: Tok | None = None
    infinitive: Tok | None = None
    comma = False
    unplaced: list[Tok] = []
    k = 0

    def verb_ahead(at: int) -> bool:
        while at < len(toks) and toks[at].pos in ("ADV", "PART") and toks[at].tag != "TO":
            at += 1
        return at < len(toks) and toks[at].pos in ("VERB", "AUX") and toks[at].tag not in ("VBG",) and not reduced(at)

    def reduced(at: int) -> bool:
        t = toks[at]
        return t.pos == "VERB" and t.tag in ("VBN", "VBG") and (at == 0 or toks[at - 1].pos in ("NOUN", "PROPN"))

    def start(kind: str, above: Tok | None) -> Clause:
        fresh = Clause(kind=kind, above=above)
        clauses.append(fresh)
        return fresh

    while k < len(toks):
        t = toks[k]
        if k in starts and t.tag not in ("WDT",):
            end = starts[k]
            head = toks[end - 1]
            if head.tag == "EX":
                clause.adverbs.append(head)
                head.dep = "expl"
            elif prep is not None:
                attach(head, prep, "pobj")
                if cc is not None and noun is not None:
                    cc = None
                prep, noun = None, head
            elif cc is not None and noun is not None and not (clause.verb is not None and verb_ahead(end)) and last is not None and last.pos not in ("VERB", "AUX"):
                attach(head, noun, "conj")
                attach(cc, noun, "cc")
                cc, noun = None, head
            elif clause.verb is None:
                if clause.subject is None:
                    clause.subject = head
                elif comma and noun is not None:
                    attach(head, noun, "appos")
                else:
                    attach(head, clause.subject, "dep")
                if not (comma and head.dep == "appos"):
                    noun = head
            elif verb_ahead(end) and (cc is not None or comma or clause.object is not None or clause.kind == "advcl" and comma):
                above = clause if clause.kind != "advcl" else clauses[0]
                if clause.kind == "advcl" and clauses[0].verb is None:
                    clause = clauses[0]
                else:
                    fresh = start("conj", above.verb)
                    fresh.cc, cc = cc, None
                    clause = fresh
                clause.subject = noun = head
            elif clause.object is None:
                copular = clause.verb.lemma in L.COPULAS
                attach(head, clause.verb, "attr" if copular else "oprd" if clause.passive else "dobj")
                clause.object = noun = head
            elif comma and noun is not None and cc is None:
                attach(head, noun, "appos")
            else:
                attach(head, clause.verb, "oprd")
                noun = head
            last, comma = head, False
            k = end
            continue
        if t.tag == "WDT":
            fresh = start("relcl", noun)
            fresh.subject = t
            clause = fresh
        elif t.pos == "SCONJ":
            fresh = start("advcl", clause.verb)
            fresh.mark = t
            clause, prep, noun = fresh, None, None
        elif t.tag == "TO":
            infinitive = t
        elif t.pos == "AUX" and not (t.lemma == "be" and main_be(toks, k)):
            if clause.verb is not None and clause.kind in ("advcl", "relcl") and clauses[0].verb is None:
                clause = clauses[0]
            clause.auxiliaries.append(t)
        elif t.pos in ("VERB", "AUX"):
            if t.tag == "VBG" and prep is not None:
                attach(t, prep, "pcomp")
                prep = None
                clause = start("", None)
                clause.verb = t
            elif infinitive is not None and clause.verb is not None:
                fresh = start("xcomp", clause.verb)
                fresh.verb = t
                attach(infinitive, t, "aux")
                infinitive, clause = None, fresh
            elif reduced(k) and noun is not None and not clause.auxiliaries:
                fresh = start("acl", noun)
                fresh.verb, fresh.passive = t, t.tag == "VBN"
                clause = fresh
            elif clause.verb is not None:
                root = clauses[0]
                if clause.kind in ("advcl", "relcl", "acl") and root.verb is None:
                    clause = root
                    clause.verb = t
                else:
                    fresh = start("conj", clause.verb)
                    fresh.cc, cc = cc, None
                    fresh.verb, fresh.adverbs = t, unplaced
                    unplaced = []
                    clause = fresh
            else:
                clause.verb = t
            if clause.verb is t and t.tag == "VBN" and any(x.lemma == "be" for x in clause.auxiliaries):
                clause.passive = True
            last, comma, noun = t, False, None
        elif t.pos == "ADP":
            if t.low in ("unlike", "contrary") and clause.verb is None and clause.subject is None:
                clause.preps.append(t)
            elif clause.verb is None:
                if noun is not None:
                    attach(t, noun, "prep")
                else:
                    clause.preps.append(t)
            elif last is not None and last.pos in ("NOUN", "PROPN", "PRON") and (t.low in ("of", "between", "with") or clause.verb.lemma in L.POSSESSION_VERBS):
                attach(t, last, "prep")
            elif last is not None and last.pos == "ADJ":
                attach(t, last, "prep")
            else:
                attach(t, clause.verb, "prep")
            t.dep = t.dep or "prep"
            prep = t
        elif t.pos == "CCONJ":
            cc = t
        elif t.pos == "ADJ":
            if clause.verb is not None and clause.object is None:
                attach(t, clause.verb, "acomp")
                clause.object, last = t, t
            elif noun is not None:
                attach(t, noun, "amod")
        elif t.pos in ("ADV", "PART"):
            t.dep = "neg" if t.low in ("not", "n't", "never") else "advmod"
            if clause.verb is None:
                clause.adverbs.append(t)
            elif cc is not None:
                unplaced.append(t)
            else:
                attach(t, clause.verb, t.dep)
        elif t.text == ",":
            comma = True
            prep = None
            if clause.kind == "advcl" and clause.verb is not None and clauses[0].verb is None:
                clause, noun = clauses[0], clauses[0].subject
            elif clause.kind in ("relcl", "acl") and clauses[0].verb is None:
                clause, noun = clauses[0], clauses[0].subject
        k += 1

    root = next((c.verb for c in clauses if c.verb is not None and c.kind == "ROOT"), None) or next((c.verb for c in clauses if c.verb is not None), None) or next((x for x in toks if x.pos in ("NOUN", "PROPN")), toks[0])
    attach(root, root, "ROOT")
    for c in clauses:
        v = c.verb
        if v is None:
            for x in (c.subject, c.mark):
                if x is not None and x is not root and x.head < 0:
                    attach(x, root, "dep")
            continue
        if v is not root and v.head < 0:
            above = c.above if c.above is not None and c.above is not v else root
            attach(v, above, c.kind if c.kind not in ("ROOT", "") else "dep")
        if c.subject is not None and c.subject is not root:
            attach(c.subject, v, "nsubjpass" if c.passive else "nsubj")
        for n, x in enumerate(c.auxiliaries):
            attach(x, v, "auxpass" if c.passive and x.lemma == "be" and n == len(c.auxiliaries) - 1 else "aux")
        for x in c.adverbs + c.preps:
            attach(x, v, x.dep or "advmod")
        if c.mark is not None:
            attach(c.mark, v, "advmod" if c.mark.tag == "WRB" else "mark")
        if c.cc is not None:
            attach(c.cc, c.above or root, "cc")
    for t in toks:
        if t.head < 0:
            attach(t, root, "punct" if t.pos == "PUNCT" else t.dep or "dep")
    break_cycles(toks, root)
    return phrases


def main_be(toks: list[Tok], k: int) -> bool:
    """Whether this form of be is the clause's verb and not an auxiliary."""
    for at, t in enumerate(toks[k + 1 : k + 5], k + 1):
        if t.pos in ("ADV", "PART") or t.low in ADV or t.low in ("not",):
            continue
        if t.low in BE:
            return False
        found = verb_lemma(t.low)
        if found and found[1] in ("VBN", "VBG") and t.low not in ADJ:
            after = toks[at + 1] if at + 1 < len(toks) else None
            return bool(after is not None and is_nominal_word(after) and after.low not in VERBS and found[1] == "VBN" and after.low not in PREP)
        return True
    return True


def break_cycles(toks: list[Tok], root: Tok) -> None:
    first, good = toks[0].i, {root.i}
    for t in toks:
        seen, node = set(), t
        while node.i not in good:
            if node.i in seen:
                attach(node, root, "dep")
                break
            seen.add(node.i)
            node = toks[node.head - first]
        good |= seen


def ancestors(toks: list[Tok]) -> dict[int, list[int]]:
    """Of tokens that follow one another, without cycles."""
    first, out = toks[0].i, {}
    for t in toks:
        path, node = [], t
        while node.i not in out and node.head != node.i:
            path.append(node)
            node = toks[node.head - first]
        own = out.setdefault(node.i, [])
        for x in reversed(path):
            own = out[x.i] = [x.head, *own]
    return out


@lru_cache(1)
def split_sentences(text: str) -> tuple[tuple[int, int], ...]:
    """Character ranges of sentences of a normalised text; the last text's are remembered."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        end = m.start() + (m[0][0] != "\n")
        if text[at:end].strip():
            out.append((at, end))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return tuple(out)


def may_be_usable(text: str) -> bool:
    """Whether a sentence is neither too short nor too long and holds a word that can be a verb; without that it can't be usable."""
    if len(text) < L.MIN_SENTENCE_CHARS or len(text) > L.MAX_SENTENCE_CHARS and len(" ".join(text.split())) > L.MAX_SENTENCE_CHARS:
        return False
    if VERBAL.isdisjoint(_LETTERS.findall(text.lower())):  # more than the words, never fewer
        return False
    words = _WORD.findall(text)
    return len(words) >= L.MIN_SENTENCE_WORDS and not VERBAL.isdisjoint(map(str.lower, words))


def holds(phrases: Collection[str]) -> Callable[[str], bool]:
    """Whether a sentence holds one of the phrases (words in lower case with spaces between them)."""
    padded, last = [f" {x} " for x in phrases], {x.rpartition(" ")[2] for x in phrases}

    def wanted(text: str) -> bool:
        if len(last) <= FEW and not any([x in low for low in (text.lower(),) for x in last]):
            return False
        low = f" {' '.join(map(str.lower, _WORD.findall(text)))} "
        return any([x in low for x in padded])

    return wanted


def one(text: str, a: int, b: int, first: int = 0, number: int = 0) -> list[Tok]:
    """The tagged tokens of the sentence at a to b; the first has the number first."""
    found = _TOKEN.findall(text, a, b)
    if not found:
        return []
    toks = [Tok(k, word, " " if space else "", number) for k, (word, space) in enumerate(found, first)]
    toks[-1].ws = " "
    tag(toks)
    return toks


def chunks_where(text: str | None, wanted: Callable[[str], bool] | None, known: dict[int, list[Tok]]) -> Iterator[list[Tok]]:
    """The noun chunks of the sentences that wanted is true of; known has tokens of sentences by their number."""
    for number, (a, b) in enumerate(split_sentences(text or "")):
        if wanted is None or wanted(text[a:b]):
            toks = known.get(number) or one(text, a, b)
            for x, y in noun_phrases(toks):
                yield toks[x:y]


def tagged(text: str | None, wanted: Callable[[str], bool] | None = None, with_chunks: bool = True) -> tuple[list[Tok], list[tuple[int, int]], list[tuple[int, int]]]:
    """(tokens without heads, ranges of noun chunks, ranges of sentences) of a normalised text.

    With wanted, only the sentences that it is true of; no sentence depends on another.
    """
    tokens, chunks, sents = [], [], []
    for number, (a, b) in enumerate(split_sentences(text or "")):
        if wanted is not None and not wanted(text[a:b]):
            continue
        n = len(tokens)
        toks = one(text, a, b, n, number)
        if not toks:
            continue
        if with_chunks:
            chunks += [(n + x, n + y) for x, y in noun_phrases(toks)]
        tokens += toks
        sents.append((n, len(tokens)))
    return tokens, chunks, sents


def tree(toks: list[Tok], with_ancestors: bool = True) -> list[dict]:
    """The tokens of a tagged sentence with heads, labels and ancestors (walks go without)."""
    build(toks)
    above = ancestors(toks) if with_ancestors else defaultdict(tuple)
    return [{"i": t.i, "text": t.text, "lower": t.low, "lemma": t.lemma, "pos": t.pos, "tag": t.tag, "dep": t.dep, "head": t.head, "anc": above[t.i], "is_alpha": t.alpha, "is_stop": t.stop, "is_punct": t.pos == "PUNCT", "is_space": False, "ent_type": "", "ws": t.ws, "sent": t.sent} for t in toks]


def annotate(text: str | None) -> tuple[list[dict], list[dict], list[dict]]:
    """(tokens, noun chunks, sentences) of a normalised text; chunks and sentences are token ranges."""
    tokens, chunks, sents = tagged(text)
    return [t for a, b in sents for t in tree(tokens[a:b])], *([{"start": a, "end": b} for a, b in ranges] for ranges in (chunks, sents))


_STOP = set(L.STOP_WORDS)
