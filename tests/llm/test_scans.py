"""Quality rules, decontamination, secrets, near-duplicates and repeats against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import decontam, minhash, rules, runindex, secret
from studyloom.llm._shared import lower_words

WORDS = [f"w{i}" for i in range(60)]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Repeats


def kept_by_brute_force(texts: list[str], length: int) -> list[tuple[int, int, str]]:
    seen, out = set(), []
    for text in texts:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return out


def repetitive(seed: int, n: int = 40) -> list[str]:
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(40, 400))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = ["".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) if rng.random() < 0.5 else rng.choice(passages)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 6))]
        out.append("".join(parts))
    return [*out, "", "ab" * 400, "q" * 1000, "q" * 99, out[0]]


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 50_000), (1, 3)])
def test_repeats(spark, seed, hot):
    texts = repetitive(seed)
    rows = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in runindex.remove_repeats(documents(spark, texts).repartition(7), index_bytes=2000, hot_contexts=hot).collect()}
    assert [rows[i] for i in range(len(texts))] == kept_by_brute_force(texts, runindex.LENGTH)


def test_run_index_statistics_are_the_plain_ones():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 25))) for _ in range(9)]
    index = runindex.RunIndex(strings)
    neighbour, common, below = index.statistics()
    text = b"".join(s + b"|" for s in strings)
    best = np.zeros(index.size, int)
    for i, s in enumerate(strings):
        for j in range(len(s)):
            p, tail = index.starts[i] + j, s[j:]
            for k, other in enumerate(strings):
                for m in range(len(other)):
                    if (i, j) != (k, m):
                        n = next((x for x, (a, b) in enumerate(zip(tail, other[m:], strict=False)) if a != b), min(len(tail), len(other) - m))
                        best[p] = max(best[p], n)
    up = np.maximum(common, 0)
    down = np.zeros(index.size, int)
    for p in np.flatnonzero(neighbour >= 0):
        down[neighbour[p]] = max(down[neighbour[p]], common[p])
    assert (np.maximum(up, down) == best).all() and (down == below).all() and len(text) == index.size and index.runs < index.size


def test_repeats_of_odd_rows(spark, odd, none):
    rows = runindex.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    # Rows that repeat a doc_id with the same text are one document, which repeats nothing of itself.
    assert all(r.n_removed == 0 for r in rows if r.doc_id == 11)
    assert runindex.remove_repeats(none).count() == 0
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    twice = spark.createDataFrame([(1, "k" + passage), (1, "z" + passage), (1, "z" + passage), (None, passage)], "doc_id long, text string")
    # Texts that share a doc_id follow each other in their order; a null doc_id loses nothing.
    assert sorted((r.n_bytes, r.n_removed) for r in runindex.remove_repeats(twice).collect()) == [(150, 0), (151, 0), (151, 150), (151, 150)]


@pytest.mark.parametrize("hot", [100, 50_000])
def test_repeats_around_an_anchor_in_very_many_contexts(spark, hot):
    """A phrase of 110 bytes stands in 1,500 different surroundings, some of which share bytes with others."""
    rng = random.Random(9)
    phrase = "".join(rng.choice("abcdefghij ") for _ in range(110))
    sides = ["".join(rng.choice("uvwxyz ") for _ in range(80)) for _ in range(300)]
    texts = [rng.choice(sides)[rng.randint(0, 80) :] + str(i)[:: rng.choice((1, -1))] + phrase[rng.choice((0, 0, 20)) :] + rng.choice(sides)[: rng.randint(0, 80)] for i in range(1500)]
    found = runindex.remove_repeats(documents(spark, texts).repartition(5), index_bytes=20_000, group_bytes=4_000, hot_contexts=hot)
    rows = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()}
    assert [rows[i] for i in range(len(texts))] == kept_by_brute_force(texts, runindex.LENGTH)


def test_an_anchor_of_60000_contexts_is_indexed_in_bounded_pieces():
    rng = random.Random(3)
    anchor, shared = rng.randbytes(32), rng.randbytes(60)
    group = [(i, 0, rng.randbytes(8) + shared + anchor + i.to_bytes(3, "big") + rng.randbytes(65), 68) for i in range(60_000)]
    parts = list(runindex.split(group, 0, 68, 32, 68, 1 << 17))
    assert all(sum(len(g[2]) for g in part) <= 1 << 17 or same >= 0 for part, same in parts)
    # Windows that end three bytes or less behind the anchor repeat: those of 60 bytes before it don't reach 100.
    assert all(runindex.repeats([g[2] for g in part], np.array([g[0] for g in part]), np.zeros(len(part), np.int64), 100)[0].size == 0 for part, same in parts[:3] if same < 0)


@pytest.mark.parametrize("kind", ["string", "long", "date"])
def test_repeats_in_the_order_of_any_ids(spark, kind):
    texts = repetitive(4, 25)
    ids = {"string": [f"d{i:04}" for i in range(len(texts))], "long": [(1 << 62) + i for i in range(len(texts))], "date": None}[kind]
    df = spark.createDataFrame([(ids[i] if ids else i, t, i) for i, t in enumerate(texts)], f"doc_id {kind if ids else 'int'}, text string, n_bytes long")
    df = df if ids else df.withColumn("doc_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id")))
    rows = sorted(runindex.remove_repeats(df.repartition(5)).collect())
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == kept_by_brute_force(texts, runindex.LENGTH)
    twice = runindex.remove_repeats(df.unionByName(df)).collect()
    assert sorted({(r.doc_id, r.n_removed, r.kept_sha256) for r in twice}) == [(r.doc_id, r.n_removed, r.kept_sha256) for r in rows]


@pytest.mark.parametrize("piece", [1 << 18, 300])
def test_each_window_has_its_anchors(piece):
    data = random.Random(1).randbytes(2000) + b"a" * 900 + b"xyz" * 300
    windows = [[] for _ in range(len(data) - 99)]
    for found in runindex.anchors(data, piece=piece):
        for at, key, first, last in zip(*(x.tolist() for x in found), strict=True):
            for w in range(first, last + 1):
                windows[w].append((at - w, key))
    hashes = runindex.string_hashes(runindex._BYTES[np.frombuffer(data, np.uint8)], 32).tolist()
    for w, own in enumerate(windows):
        inside = hashes[w : w + 69]
        assert sorted(set(own)) == [(i, h) for i, h in enumerate(inside) if h == min(inside)]


# Near-duplicates


def similar(texts: list[str | None]) -> dict[int, set[int]]:
    grams = []
    for t in texts:
        w = lower_words(t)
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return {i: {j for j, b in enumerate(grams) if i != j and a and b and len(a & b) >= 0.8 * len(a | b)} for i, a in enumerate(grams)}


def classes(links: dict[int, set[int]]) -> list[int]:
    label = list(range(len(links)))
    for _ in links:
        label = [min([label[i], *(label[j] for j in own)]) for i, own in links.items()]
    return label


def near_texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    return [*out, *out[:5], None, "", "a b", "A B.", "a b c"]


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, block):
    texts = near_texts()
    links = similar(texts)
    rows = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts), block=block).collect()}
    assert [rows[i].n_links for i in range(len(texts))] == [len(links[i]) for i in range(len(texts))]
    assert [rows[i].class_id for i in range(len(texts))] == classes(links)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {(r.class_id, r.n_links) for r in rows if r.doc_id is None} == {(None, 0)}
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one(odd).columns == odd.columns


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.99999), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = minhash.bands_for(threshold, recall)
        assert bands * rows <= minhash.MAX_HASHES and 1 - (1 - threshold**rows) ** bands >= recall


def test_many_pairs_are_counted_as_few_are():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 200, 60)).astype(np.uint64) for _ in range(30)]
    pairs = np.array([(i, j) for i in range(30) for j in range(i + 1, 30)])
    assert minhash.overlaps(sets, pairs).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]


# Decontamination


def test_wu_manber_finds_all():
    rng = random.Random(2)
    for size in (1, 2, 3, 10):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(300)]
        patterns = {tuple(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(size)): k for k in range(6)} | {tuple(text[7 : 7 + size]): 9}
        found = set(decontam.WuManber(patterns).search(text))
        assert found == {(i, k) for p, k in patterns.items() for i in range(300) if tuple(text[i : i + size]) == p}


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(WORDS[:14])), (2, "Two words"), (3, None), (None, "word word"), (4, "..."), (1, " ".join(WORDS[:14]))], "item_id long, text string")
    texts = [" ".join(["x", *WORDS[2:13], "y", "two WORDS two"]), " ".join(WORDS[:9]), None, "TWO words, two-words"]
    rows = {r.doc_id: r for r in decontam.decontaminate(documents(spark, texts), items, block_bytes=20).collect()}
    assert [(r.n_words, r.n_hit, r.n_items, r.item_ids) for _, r in sorted(rows.items())] == [(16, 13, 2, ["1", "2"]), (9, 0, 0, []), (0, 0, 0, []), (4, 4, 1, ["2"])]
    again = decontam.decontaminate(documents(spark, texts), items, block_bytes=20, round_bytes=30).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in again) == sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in rows.values())
    out = decontam.decontaminate(odd, items)
    assert out.count() == odd.count() and out.columns.count("n_words") == 1
    assert decontam.decontaminate(none, items).count() == 0 and not decontam.decontaminate(odd, items.limit(0)).where("contaminated").count()


# Quality rules


def plain_repeats(words: list[str]) -> int:
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)})


def test_counts():
    rng = random.Random(4)
    for n in (0, 5, 8, 9, 40, 200):
        text = "".join(rng.choice(["a", "bé", "c#", "|"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        got = rules.measure(text)
        assert got[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), plain_repeats(words))


def test_rules_keep_the_usual_and_drop_the_far_out(spark, odd, none):
    rng = random.Random(6)
    usual = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(120)]
    junk = [" ".join(w + "###" for w in usual[i].split()) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(usual + junk)], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert all(rows[i] for i in range(120)) and not any(rows[i] for i in range(120, 126))
    out = rules.quality_rules(odd)
    assert out.count() == odd.count() and not out.where("text is null and kept").count()
    assert rules.quality_rules(none).count() == 0


# Secrets


def test_forest_tells_findings_apart():
    held = secret.labelled_findings(300, seed=99)
    forest = secret.fit()
    scores = forest.predict(np.array([secret.describe(v, b, a, p) for v, b, a, p, _ in held]))
    labels = np.array([x[-1] for x in held])
    assert ((scores >= secret.CUT) == labels).mean() > 0.97


def test_redaction(spark, odd, none):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = f'the token = "{key}" and card 1234567890123456, then api_key: \'{key[::-1]}\' end'
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    row = secret.redact(secret.scan(docs, secret.fit())).first()
    assert row.text == "the token = \"[SECRET]\" and card 1234567890123456, then api_key: '[SECRET]' end"
    assert [f.value_sha256 for f in row.findings if f.is_secret] == [hashlib.sha256(k.encode()).hexdigest() for k in (key, key[::-1])]
    forest = secret.fit(secret.labelled_findings(200))
    assert secret.redact(secret.scan(odd, forest)).count() == odd.count() and secret.scan(none, forest).count() == 0


# Columns whose names operators use inside


def test_columns_of_any_name_come_back(spark, odd):
    clash = odd.withColumnsRenamed({"n_words": "gone", "n_chars": "row"}).withColumns({"g_lang": F.lit("q"), "g_source": F.lit(1), "max_word_length": F.lit(2), "kept": F.lit("old")})
    judged = rules.quality_rules(clash)
    assert set(clash.columns) <= set(judged.columns) and judged.count() == odd.count()
    assert {(r.g_lang, r.g_source, r.max_word_length, r.gone) for r in judged.collect()} == {("q", 1, 2, "x")}
    assert minhash.keep_one(clash).columns == clash.columns
    assert decontam.decontaminate(clash, clash.select(F.col("doc_id").alias("item_id"), "text")).count() == odd.count()


def test_thresholds_of_small_groups_are_those_of_their_language(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(30)) + ("!" * 40 if i == 0 else ""), "en", "big" if i < 60 else "small") for i in range(100)]
    counts = rules.counted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep_text=False)
    limits = {r.g_source: r for r in rules.thresholds(counts).collect()}
    assert limits["big"].max_mark_share == pytest.approx(limits["small"].max_mark_share)
    assert [r.doc_id for r in rules.judge(counts, rules.thresholds(counts)).where("not kept").collect()] == [0]
