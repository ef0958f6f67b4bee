"""What leaves the annotating worker is what whole trees give, and no tree."""

from __future__ import annotations

import os

import pytest

from studyloom import catalog, fixtures
from studyloom.functions import lexicon as L
from studyloom.functions import text as X
from studyloom.operators import _arrow, annotate, definitions, digest, facts, ranking, rules, salience
from studyloom.plans.analyse import KEPT, Analysis

TEXTS = [" ".join(fixtures.SENTENCES.values()), fixtures.LESSON, None, "", "Only. Short! Ones?", "palabra " * 700 + "is a long line."]
DOCS = [*enumerate(TEXTS), (1, TEXTS[0]), (8, "A valve is a small device. " * 3)]  # one id comes twice


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return annotate.annotate(docs).persist(), digest.digest(docs).persist()


def same(a, b):
    assert a.columns == b.columns
    rows = [sorted(map(repr, df.collect())) for df in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_sentences_and_candidates(both):
    whole, made = annotate.sentences(both[0]), digest.sentences(both[1])
    same(whole.drop("toks"), made.drop("definitions", "facts", "toks"))
    for of in (definitions, facts):
        same(of.candidates(whole), of.candidates(made))


def test_definitions_count_chunks_over_all_rows_of_an_id(both):
    whole, made = both
    counted = annotate.chunk_counts(annotate.chunks(whole))
    same(definitions.extract(annotate.sentences(whole), counted), definitions.extract(digest.sentences(made), digest.chunk_counts(made)))


def test_phrases_vocabulary_stats(both):
    whole, made = both
    same(annotate.phrases(annotate.chunks(whole)), digest.phrases(made))
    same(annotate.vocabulary(whole), digest.vocabulary(made))
    same(annotate.stats(whole), digest.stats(made))


def test_trees_stay_in_the_worker(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for a in [Analysis(docs), *(Analysis(docs, kept=kept) for name, kept in KEPT.items() if name != "cards")]:
        assert "anc" not in a.annotated.schema.simpleString()
        a.close()


def test_any_annotator(spark, both):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    same(both[1], digest.digest(docs, lambda text: rules.annotate(text)))


def test_what_is_not_kept_is_no_empty_result(spark):
    a = Analysis(spark.createDataFrame(DOCS, "doc_id long, text string"), kept=KEPT["summary"])
    with pytest.raises(Exception, match="toks|chunks"):
        a.definitions.schema


@pytest.mark.parametrize("pattern", sorted(L.FAMILY))
def test_only_sentences_that_can_have_a_pattern_become_trees(spark, both, pattern):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    same(catalog.facts_of(annotate.sentences(both[0]), pattern), catalog.shown(digest.pattern_facts(docs, pattern)))
    wanted = digest.sentences_with(pattern)
    kept = [s for s in fixtures.SENTENCES.values() if wanted(s)]
    assert 0 < len(kept) < len(fixtures.SENTENCES)
    assert not rules.tagged("Red birds sing loud songs each day.", wanted)[0]


def test_forms_find_every_word_of_a_lemma():
    lemmas = sorted({*L.POSSESSION_VERBS, *L.PROPERTY_NOUNS, *L.PURPOSE_VERBS, *L.USEFUL_ADJECTIVES, *L.PROCEDURAL_VERBS, *L.DIFFERS_VERBS, *L.COMPARISON_NOUNS, *L.ENABLING_VERBS, "be"})
    stems = {*lemmas, *(x[:-1] for x in lemmas), *(x + x[-1] for x in lemmas)}
    words = {s + e for s in stems for e in ("", "s", "es", "ies", "ed", "d", "ied", "ing", "er", "ly")} | {*rules.IRREGULAR, *rules.NOUNS, *rules.BE, *rules.HAVE, *rules.DO}
    for lemma in lemmas:
        found = facts.forms(lemma)
        for w in words:
            of = {w, rules.noun_lemma(w), (rules.verb_lemma(w) or ("",))[0], w[:-2] if w.endswith("er") else w}
            assert lemma not in of or found.search(w.upper()), (lemma, w)


ODD = ["a\u00a0b\u2009 c\u202f\td", " \t\u2003x \x1c", "so\u00adft", "a\n\n\n\nb\n\nc \n \n\n\n", "  ", None, "a\x0b\x85b \n", "\u00ad a \u00ad"]


def test_texts_are_normalised_alike(spark):
    docs = spark.createDataFrame(enumerate(ODD), "doc_id long, text string").select("doc_id", X.normalise("text").alias("text"))
    assert {r.doc_id: r.text for r in docs.collect()} == {i: X.normalised(x) for i, x in enumerate(ODD)}


#: Sentences that can't be usable, and sentences that name a chunk but have no verb.
MIXED = " ".join(fixtures.SENTENCES.values()) + " Short! It is so. A valve, a valve and A  Valve. The\u3000valve of the old clock, a small device. " + "The valve is " + "long " * 130 + "now. Can. " + fixtures.LESSON


@pytest.mark.parametrize("name", [*KEPT, None])
def test_sentences_that_cannot_be_usable_are_not_tagged(spark, monkeypatch, name):
    docs = spark.createDataFrame([(1, MIXED), (2, None), (3, "A valve, a device, opens. " * 2), (4, MIXED), (4, MIXED)], "doc_id long, text string")
    whole = Analysis(docs, kept=digest.ALL)
    part = Analysis(docs, kept=KEPT.get(name))
    for of in {"definitions": ["definitions"], "quiz": ["definitions", "quiz"], "facts": ["facts"], "ranks": ["ranks"], "summary": ["summary"], "keywords": ["keywords"], "cards": ["cards"], None: ["definitions", "facts", "quiz", "stats"]}[name]:
        same(getattr(whole, of), getattr(part, of))
    whole.close()
    part.close()


def test_sentences_without_a_verb_are_passed_over():
    assert rules.may_be_usable("A valve is a small device of brass.") and not rules.may_be_usable("A valve, a pump and the old clocks of the town.")
    assert len(rules.tagged(MIXED, rules.may_be_usable)[2]) < len(rules.tagged(MIXED)[2])


def test_no_executor_holds_what_is_kept(spark):
    a = Analysis(spark.createDataFrame(DOCS, "doc_id long, text string"))
    files = a.annotated.inputFiles()
    assert files and not a.annotated.is_cached and not {"total", "n_tokens"} & {*Analysis(a.docs, kept=KEPT["definitions"]).annotated.columns}
    a.close()
    assert not [f for f in files if os.path.exists(f.removeprefix("file:").replace("///", "/"))]


def test_values_are_counted_at_any_depth():
    assert _arrow.weight([("a", ["b", "c"], [(1, "d")])]) == 10 and _arrow.weight("abc") == _arrow.weight([]) == _arrow.weight(None) == 1


def test_words_in_any_place():
    assert rules.anywhere("valve") == ("valve", "NOUN", "NN") and rules.anywhere("uses") is None
    for text in ("Valves open. Valves, too.", "NASA builds. The NASA runs"):
        assert [t["pos"] for t in rules.annotate(text)[0]][0] in ("NOUN", "PROPN")


def test_both_cuts_come_from_one_reading_of_the_ranks(spark):
    ranks = spark.createDataFrame([(d, i, float(i * 7 % 5)) for d, n in ((1, 1), (2, 9), (3, 40)) for i in range(n)] + [(None, 0, 1.0)], "doc_id long, index int, score double")
    found = salience.sentence_salience(ranks)
    for fraction, name in ((0.25, "high"), (0.5, "middle")):
        cuts = ranking.sentence_cut(ranks.where("doc_id is not null"), fraction).withColumnRenamed("cut", name)
        same(found.select("doc_id", name).distinct(), cuts)
    assert found.count() == 50 and "Join" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("pattern", sorted(L.FAMILY))
def test_needed_words_are_looked_up_not_searched_for(pattern):
    wanted, odd = digest.sentences_with(pattern), ["HAS-VALUE", "hasvalue", "has2 éform of", "it uses, for", "uséd for", ""]
    for text in [*fixtures.SENTENCES.values(), *odd]:
        assert wanted(text) == all(facts.forms(*x).search(text) is not None for x in facts.LEMMAS[pattern]), text
    assert all(isinstance(x, frozenset) for x in facts.NEEDED[pattern])


def test_sentences_leave_the_worker_stripped(both):
    made = digest.sentences(both[1])
    assert "regexp_replace" not in made._jdf.queryExecution().analyzed().toString()
    assert all(r.sentence == r.sentence.strip() and 25 <= len(r.sentence) <= 600 for r in made.collect())


def test_facts_keep_the_phrases_of_their_terms_alone(spark):
    docs = spark.createDataFrame([(1, MIXED), (2, "The old valves move the red water of the town. " * 3), (4, MIXED), (4, "The stack. A queue. " + fixtures.LESSON)], "doc_id long, text string")
    whole, part = Analysis(docs, kept=digest.ALL), Analysis(docs, kept=KEPT["facts"])
    assert "topics" in part.annotated.columns and not {"keys", "texts", "starts", "total"} & {*part.annotated.columns}
    same(whole.facts, part.facts)
    kept = {r.doc_id: len(r.topics) for r in part.annotated.where("doc_id < 4").collect()}
    assert kept[2] == 0 < kept[1] < digest.phrases(whole.annotated).where("doc_id = 1").count()
    for a in (whole, part):
        a.close()


def test_a_sentence_that_can_end_a_phrase_is_found():
    for text in fixtures.SENTENCES.values():
        toks, chunks, _ = rules.tagged(text)
        for a, b in chunks:
            assert facts.names_one({digest.key_of(toks[a:b])})(text), toks[b - 1].text
    assert not facts.names_one({"red valve"})("The clock stops.") and digest.bare("the a old the valve") == "old the valve"


def test_walks_go_down_from_heads():
    for text in fixtures.SENTENCES.values():
        toks = rules.annotate(text)[0]
        for s in [annotate.N.Sentence([t for t in toks if t["sent"] == 0])]:
            for t in s.toks:
                assert s.subtree(t) == [x for x in s.toks if x["i"] == t["i"] or t["i"] in x["anc"]]
                assert s.negated(t) == any(x["i"] == t["i"] or t["i"] in x["anc"] for x in s.negations)


def test_documents_without_a_fact_send_no_sentences_for_facts(spark):
    plain, lesson = "The old valves move the red water of the town. " * 3, fixtures.LESSON
    docs = spark.createDataFrame([(1, lesson), (2, plain), (3, plain), (3, lesson)], "doc_id long, text string")
    whole, part = Analysis(docs, kept=digest.ALL), Analysis(docs, kept=KEPT["facts"])
    assert {r.doc_id for r in digest.sentences(part.annotated).collect()} == {1, 3}
    assert digest.sentences(part.annotated).where("doc_id = 3").count() == digest.sentences(whole.annotated).where("doc_id = 3").count()
    same(whole.facts, part.facts)
    for a in (whole, part):
        a.close()


def test_tagged_sentences_are_not_tagged_again_for_chunks(monkeypatch):
    text, seen, one = "A valve is a small device of brass. The valve moves water in the town.", [], rules.one
    monkeypatch.setattr(rules, "one", lambda text, a, b, *more: seen.append(a) or one(text, a, b, *more))
    toks, _, ranges = rules.tagged(text, rules.may_be_usable, False)
    found = list(rules.chunks_where(text, rules.holds({"the valve"}), {toks[a].sent: toks[a:b] for a, b in ranges}))
    assert len(seen) == len(ranges) == 2 and digest.written(found[0]) == "The valve"


def test_patterns_pass_over_what_is_too_short_to_be_usable():
    wanted = digest.long_enough_with("possess_property")
    assert wanted("The old engine has a size of two metres.") and not wanted("It has a size.")
