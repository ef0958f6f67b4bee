"""run() against plain Python for all five stages, on a small corpus with a trap for each stage."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from studyloom.llm import langid, secret
from studyloom.llm.queries import tokenizer_path

VOCABULARY = tokenizer_path("word_bpe_49k.json")


def low_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(lexicon) for _ in range(n))

    texts = [prose(rng.randint(25, 90)) for _ in range(70)]
    long = prose(120)
    texts += [long, long.upper(), long + " end", " ".join(long.split()[:118]), long.replace(" ", "\n")]
    chain = prose(100).split()
    texts += [" ".join(chain), " ".join([*chain[:-6], *prose(6).split()]), " ".join([*prose(6).split(), *chain[6:]])]
    items = [(1, prose(14)), (2, prose(4)), (3, "")]
    texts += [f"{prose(30)} {items[0][1]} {prose(5)}", f"{prose(25)} {items[1][1].title()}.", f"{prose(25)} {' '.join(items[0][1].split()[:9])}"]
    texts += ["too short", "", None, " ".join(["same eight words stand here again and again"] * 9), prose(40) + " " + "#$%&" * 80]
    texts += [f"{prose(30)} token = \"{'a1b2c3d4e5' * 4}\" {prose(5)}", f"{prose(30)} password: hunter2abc\n{prose(6)}", f"{prose(30)} see postgres://user:pa55word@host/db now"]
    docs = [(3 * i, t, "en" if i % 9 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return docs, items


def kept_by_rules(docs: list[tuple]) -> list[tuple]:
    rows = []
    for d in docs:
        text = d[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars = max(1, len(words)), max(1, sum(map(len, words)))
        marks = len(re.findall(r"""[!?;:"'()\[\]{}=+~^`_/\\@#*$%&|<>]""", text))
        shares = (len(re.findall(r"[#*$%&|<>]", text)) / n, sum(map(len, words)) / n, marks / chars, len(re.findall("[A-Z]", text)) / chars, (len(lines) - len(set(lines))) / max(1, len(lines)))
        rows.append((d, len(words) < 20 or 100 * len(again) > 30 * len(words), shares))
    out = []
    for d, failed, shares in rows:
        for group in (lambda x: x[2:4] == d[2:4], lambda x: x[2] == d[2], lambda x: True):
            own = np.array([s for x, bad, s in rows if not bad and group(x)])
            if len(own) >= 50:
                break
        low, high = (np.quantile(own, q, axis=0, method="inverted_cdf") for q in (0.25, 0.75))
        if not failed and all(s <= h + 3 * max(h - x, least) for s, x, h, least in zip(shares, low, high, (0.05, 2.0, 0.08, 0.1, 0.2), strict=True)):
            out.append(d)
    return out


def one_of_each(docs: list[tuple]) -> list[tuple]:
    grams = []
    for d in docs:
        w = low_words(d[1])
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(grams):
            for j, b in enumerate(grams):
                if a and b and part[i] != part[j] and len(a & b) >= 0.8 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
                    changed = True
    return [d for i, d in enumerate(docs) if part[i] == i]


def clean(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    found = []
    for d in docs:
        words = low_words(d[1])
        leaked = False
        for _, text in items:
            w = low_words(text)
            windows = {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            leaked |= any(tuple(words[i : i + len(x)]) == x for x in windows for i in range(len(words)))
        if not leaked:
            found.append(d)
    return found


def test_run_is_what_plain_python_gives(spark, tmp_path):
    docs, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(docs, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    ruled = kept_by_rules(docs)
    single = one_of_each(ruled)
    left = clean(single, items)
    assert len(docs) > len(ruled) > len(single) > len(left) > 70
    forest, library = secret.fit(vocabulary=VOCABULARY), Tokenizer.from_file(VOCABULARY)
    expected = {}
    for d in left:
        text = d[1]
        spans = secret.candidates(text)
        scores = forest.predict(np.array([secret.row_of(text, s, d[3], forest.words) for s in spans]))
        for (a, b), score in reversed(list(zip(spans, scores, strict=True))):
            text = text[:a] + secret.MARK + text[b:] if score >= secret.CUT else text
        ids = library.encode(text, add_special_tokens=False).ids
        expected[d[0]] = (text, " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False), len(ids))
    assert sum(secret.MARK in t for t, *_ in expected.values()) == 3

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.text, r.token_ids, r.decoded, r.n_tokens) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.ids_sha256 == hashlib.sha256(r.token_ids.encode()).hexdigest() for r in rows)


def test_a_language_is_that_of_the_least_loss():
    rng = np.random.default_rng(4)
    words = langid.code(4)
    model = langid.Model(["a", "b", "c", "d"], words, rng.normal(size=(langid.BUCKETS, words.shape[1])), rng.normal(size=words.shape[1]))
    texts = ["the cat sat", "наоборот и так далее " * 900, "straße über", None, "123 !!", "", "x" * 500]
    langs, scores, ambiguous = model.predictor()(texts)
    for text, lang, score, unsure in zip(texts, langs, scores, ambiguous, strict=True):
        own = langid.words_of(text)
        if not own:
            assert (lang, score, unsure) == ("und", 0.0, True)
            continue
        ids, times = langid.counted(own, langid.LOW, langid.HIGH, langid.BUCKETS, whole=False)
        margin = model.bias + (model.weights[ids] * times[:, None]).sum(axis=0) / times.sum()
        losses = [sum(np.log1p(np.exp(-m * bit)) for m, bit in zip(margin, word, strict=True)) for word in words]
        assert lang == model.languages[int(np.argmin(losses))] and np.isclose(score, np.exp(-min(losses)) / np.exp(-np.array(losses)).sum(), atol=1e-5)
