"""Token counts, BPE, chat formatting and the two classifiers."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import bpe, chat, langid, quality, tokencount
from studyloom.llm._shared import bucket_of
from studyloom.llm.queries import tokenizer_path

from .conftest import ODD

PATH = tokenizer_path("word_bpe_49k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")


def random_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    marks = "abcxyzABCéÉßñİıſΣσς ẞ'’ \t\n\x0b\x1c\x85\xa0 ​0123²½中文字😀👍🏽!!.,-_#<|>$\x00한국ー́̈ﬁ"
    special = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "don't"]
    return ["".join(rng.choice(special) if rng.random() < 0.05 else rng.choice(marks) for _ in range(rng.randint(0, 70))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_is_the_library_s(library):
    c = bpe.codec(PATH)
    rng = random.Random(2)
    long = ["".join(rng.choice("abcdeéstr") for _ in range(3000)), "ab" * 2000, "!?" * 1500, "中文" * 500]
    for text in [*ODD, *random_texts(300), *long]:
        expected = library.encode(text or "", add_special_tokens=False).ids
        ids, decoded, n = c.encode(text)
        assert ids == " ".join(map(str, expected)) and n == len(expected)
        assert decoded == library.decode(expected, skip_special_tokens=False) == c.decode(expected)


@pytest.mark.parametrize("leaf", [16, 50])
def test_tree_concatenation_is_exact(leaf):
    merges = bpe.codec(PATH).merges
    rng = random.Random(3)
    for _ in range(20):
        chars = "".join(rng.choice("inthearsto") for _ in range(rng.randint(1, 400)))
        assert merges.encode(chars, leaf=leaf) == merges.leaf(chars, True)


def test_cut_texts_are_encoded_as_whole_ones(spark, library):
    texts = [" ".join(random_texts(30, seed)) for seed in range(4)] + ["x" * 900, None, "<|endoftext|>" * 30]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + texts[:1])], "doc_id long, text string, n_tokens string")
    rows = bpe.encode(docs, PATH, cut_chars=150).collect()
    assert len(rows) == 8
    for r in rows:
        ids = library.encode((texts + texts[:1])[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("size", [9, 31])
def test_pieces_cut_anywhere_give_the_library_s_ids(library, size):
    c = bpe.codec(PATH)
    rng = random.Random(4)
    letters = ["".join(rng.choice(x) for _ in range(400)) for x in ("x", "ab", "中", "наоеит", "한국어", "theinroa", "'s", "!'", "...,", "é́ー", "a1", "ΣσςİI")]
    for text in [*letters, *(" ".join(random_texts(8, s)) for s in range(60)), "".join(rng.choice(["don't", "'ll", "ß", "X", " ", "…"]) for _ in range(300))]:
        cuts = [(0, bpe.APART), *c.cuts(text, size), (len(text), bpe.APART)]
        out = bpe.Streamed(c, False)
        for (a, x), (b, y) in zip(cuts, cuts[1:], strict=False):
            out.add(dict(zip(("head", "ids", "names", "n", "tail", "single"), c.piece(text[a:b], x == bpe.JOINED, y == bpe.JOINED), strict=True)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert out.finish() == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), text
    assert all(len(c.cuts(x * 600 + " ", 50)) >= 8 for x in ("x", "中", "при ", "A, b. "))


def test_a_text_without_spaces_is_cut_in_linear_time():
    c = bpe.codec(PATH)
    for text in ("x" * 4_000_000, "中文字" * 1_000_000, "Привет мир" * 300_000, "A, b. " * 500_000):
        assert len(text) / bpe.CUT_CHARS - 2 <= len(c.cuts(text, bpe.CUT_CHARS)) <= len(text) / bpe.CUT_CHARS


def test_bpe_of_odd_rows(odd, none):
    clash = odd.withColumnsRenamed({"source": "row", "lang": "no"}).withColumn("piece", F.lit(1))
    back = bpe.encode(clash, PATH, cut_chars=100)
    assert set(clash.columns) < set(back.columns) and back.count() == odd.count()
    assert {(r.doc_id, r.no, r.row, r.piece) for r in back.collect()} == {(r.doc_id, r.no, r.row, 1) for r in clash.collect()}
    assert bpe.encode(odd, PATH).count() == odd.count()
    assert bpe.encode(none, PATH, digests=False).count() == 0


def best_segmentation(word: str, pieces: dict[str, float]) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + tokencount.FALLBACK * size, best[end - 1][1] - size)]
        options += [(best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark, odd, none):
    pieces = tokencount.pieces(PIECES)
    texts = random_texts(200, 9)
    counter = tokencount.Counter(pieces)
    split = [tokencount.pre_tokens(t) for t in texts]
    assert counter.count(split) == [sum(best_segmentation(w, pieces) for w in own) for own in split]
    rows = {r.doc_id: r.n_tokens for r in tokencount.count(odd, PIECES).collect()}
    assert rows[0] == rows[1] == rows[2] == 0 and rows[10] == rows[11] > 0
    assert tokencount.count(none, PIECES).count() == 0


def test_a_very_long_pre_token_has_its_own_count():
    pieces = {"▁": -3.0, "a": -2.0, "ab": -2.5, "abc": -2.8, "bca": -2.2, "cab": -2.3}
    counter = tokencount.Counter(pieces)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(n)) for n in (1, 50, 900)]
    assert [counter.alone(w) for w in words] == counter.count([[w] for w in words]) == [best_segmentation(w, pieces) for w in words]
    assert counter.count([["abc" * 2000]]) == [counter.alone("abc" * 2000)] == [best_segmentation("abc" * 2000, pieces)]


def formatted(spark, turns, **limits):
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return chat.windows(rows, **limits)


def conversations(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = [(-7, i, role, r"\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    for conv in range(30):
        first = rng.random() < 0.4
        for turn in range(rng.randint(1, 9)):
            role = "system" if first and turn == 0 else ("user", "assistant")[turn % 2]
            text = rng.choice([None, "", "<|end|>", "<\\|text|> \\", "a <| b"]) if rng.random() < 0.2 else " ".join(rng.choice(["word", "é", "<|turn|>", "\\n", "\n"]) for _ in range(rng.randint(0, 60)))
            out.append((conv, turn, role, text))
    return [*out, (None, 0, None, "x"), (None, 0, None, "x"), (None, 1, "assistant", "y")]


def test_chat_reads_back(spark):
    rows = conversations()
    got = {r.conv_id: r for r in chat.read_back(formatted(spark, rows, budget=40, history=15)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [((r or ""), (t or "")) for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        own = got[conv]
        assert own.n_turns == len(turns) and own.loss_chars == len(loss)
        assert own.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert own.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_windows_keep_to_the_budget(spark):
    rows = [r for r in conversations(4) if r[0] is not None]
    system = {r[0] for r in rows if r[1] == 0 and r[2] == "system"}
    for w in formatted(spark, rows, budget=40, history=15).collect():
        turns = list(chat.parsed(w.text))
        sizes = [chat.count_tokens(t) for _, t, _ in turns]
        assert len(turns) > w.n_repeated
        assert sum(sizes) <= 40 or len(turns) - w.n_repeated == 1
        if w.conv_id in system:
            assert turns[0][0] == "system"
        history = sizes[(w.conv_id in system and w.window > 0) : w.n_repeated]
        assert sum(history) <= 15


def test_windows_count_the_tokens_of_a_tokenizer(spark, library):
    rows = conversations(3)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    df = formatted(spark, rows, budget=40, history=15, tokenizer=PATH)
    for w in df.collect():
        sizes = [size(t) for _, t, _ in chat.parsed(w.text)]
        assert sum(sizes) <= 40 or len(sizes) - w.n_repeated == 1
    plain = {r.conv_id: r for r in chat.read_back(formatted(spark, rows)).collect()}
    assert all(r[:5] == plain[r.conv_id][:5] for r in chat.read_back(df).collect())


def test_history_gives_way_turn_by_turn():
    turns = [("user", "a" * 60), ("assistant", "b" * 60), ("user", "c" * 330)]
    system = ("system", "s" * 100)
    windows = list(chat.spans_of(iter([system, *turns]), 512, 128, len))
    assert [[t[0] for t, _, _ in [(x[1], 0, 0) for x in own]] for _, own in windows] == [["s", "a", "b"], ["s", "b", "c"]]


def test_chat_of_nothing(spark):
    assert chat.read_back(formatted(spark, [])).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 7, 20):
        words = langid.code(n)
        assert len({tuple(w) for w in words.tolist()}) == n
    assert langid.code(4).shape == (4, 7)


LANGS = {"aa": "bado gido lumo".split(), "bb": "xert zquin wrak".split(), "cc": "ééno ûlla çari".split()}


def test_languages_are_told_apart(spark, odd, none):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(LANGS[k]) + rng.choice(["", "s", "en"]) for _ in range(20)), k) for i, k in ((i, rng.choice(list(LANGS))) for i in range(240))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34", "bb"), (902, "bado", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, bucket_of("doc_id") != 0)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == k for i, _, k in held]) > 0.98
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert langid.identify(odd, model).count() == odd.count()
    empty = langid.fit(none, bucket_of("doc_id") != 0)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_a_quality_score_is_that_of_its_features():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.3)
    score = model.scorer()
    for text in [*ODD, *random_texts(40, 5), "one two two one " * 3000]:
        ids, times = quality.features(text)
        margin = 0.3 + ((model.z[ids] * times).sum() / times.sum() if len(ids) else 0)
        assert score(text) == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-6)


def test_training_languages_are_bounded_and_all_there(spark):
    rows = [(i, "x", f"l{i % 12}" if i % 3 else "big") for i in range(3000)] + [(None, "x", "big"), (7, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.sampled(docs, F.col("doc_id").isNotNull(), "doc_id", "lang", 50, 360).groupBy("sample_lang").count().collect()
    langs = {r[2] for r in rows if r[0] is not None and r[2]}
    assert {r.sample_lang for r in found} == langs and {r["count"] for r in found} == {min(50, 360 // len(langs))}


def test_quality_is_learned(spark, odd, none):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["theme", "or", "an", "reel", "in"]) for _ in range(40))
    bad = lambda: rng.choice([" ".join(rng.choice(["th###", "or%%%", "an***"]) for _ in range(40)), "echo " * 40])
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(320)] + [(9999, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, bucket_of("doc_id") != 0)
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([scored[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    out = quality.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    nothing = quality.fit(none, labels, bucket_of("doc_id") != 0)
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}
