from __future__ import annotations

import pytest

from studyloom.functions.tree import Sentence, text
from studyloom.operators import rules


def parsed(sentence: str) -> Sentence:
    return Sentence(rules.annotate(sentence)[0])


def word(s: Sentence, low: str) -> dict:
    return next(t for t in s.toks if t["lower"] == low)


@pytest.mark.parametrize(
    ("sentence", "low", "dep"),
    [
        ("A valve is a small device.", "device", "attr"),
        ("A dam is defined as a strong wall.", "dam", "nsubjpass"),
        ("A suspension bridge, a cable-borne bridge, carries its deck on ropes.", "carries", "ROOT"),
        ("A lute could be a string instrument.", "could", "aux"),
        ("A lute is not a string instrument.", "not", "neg"),
        ("There is a string instrument called a lute.", "there", "expl"),
        ("A pulley can be used to move a load in stages.", "move", "xcomp"),
        ("When a valve is opened, the hot steam is pushed into the cylinder.", "opened", "advcl"),
        ("Granite is harder than soft limestone.", "harder", "acomp"),
        ("The recipe begins by measuring the dry beans.", "measuring", "pcomp"),
    ],
)
def test_labels(sentence, low, dep):
    assert word(parsed(sentence), low)["dep"] == dep


def test_ancestors_end_at_the_root():
    s = parsed("The clock consists of gears with a spring and two brass hands.")
    assert [s.by[i]["lower"] for i in word(s, "hands")["anc"]] == ["spring", "with", "gears", "of", "consists"]


def test_phrase_keeps_nominal_conjuncts_and_leaves_clauses():
    s = parsed("A delta is a low-lying plain consisting of sand and mud.")
    assert text(s.phrase(word(s, "plain"))) == "a low-lying plain consisting of sand and mud"
    s = parsed("A lute is a string instrument and a drum is percussion.")
    assert "drum" not in text(s.phrase(word(s, "instrument")))


def test_without_conjuncts():
    s = parsed("A delta is a plain of sand and mud.")
    assert text(s.without_conjuncts(word(s, "sand"))) == "sand"


@pytest.mark.parametrize("sentence", ["", "   ", "...", "?", "is is is of of and and", "A , , and .", None, "the the the", "to to run by by"])
def test_any_input_is_a_tree(sentence):
    toks, _, _ = rules.annotate(sentence)
    by = {t["i"]: t for t in toks}
    for t in toks:
        assert all(a in by for a in t["anc"]) and t["i"] not in t["anc"]
