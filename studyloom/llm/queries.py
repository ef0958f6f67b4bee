"""The thin queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, minhash, quality, rules, runindex, secret, tokencount
from ._shared import bucket_of, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the box keeps the vocabulary files of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out():
    return F.coalesce(bucket_of("doc_id") == 0, F.lit(False)).alias("held_out")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per candidate of every document, with the forest's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret.scan(docs, secret.fit(vocabulary=tokenizer_path("word_bpe_49k.json")), keep_text=False)
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.start", (F.col("f.end") - F.col("f.start")).alias("length"), "f.value_sha256", F.col("f.score").alias("score"), "f.is_secret")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id") != 0)
    return quality.score(docs, model, keep_text=False).select("doc_id", held_out(), "score", "predicted")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count(docs, tokenizer_path("piece_bpe_32k.model"), keep_text=False)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep_text=False)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, bucket_of("doc_id") != 0)
    return langid.identify(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out(), "lang_pred", "score", "ambiguous")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_digest().alias("items_sha256"), "contaminated")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runindex.remove_repeats(docs, keep_bytes=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = rules.quality_rules(docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class of near-duplicates and the number of documents it is linked with."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, i, role, r"\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))], rows.schema)
    return chat.read_back(chat.windows(rows.unionByName(planted), tokenizer=tokenizer_path("word_bpe_49k.json")))


#: Documents' words as in WORDS_SQL; windows of ten words; a window's digest stands for its words.
OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS size
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
         FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM dw, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, d.size, item FROM dwin d JOIN win USING (win) WHERE d.size = win.size),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Windows as digests of 100-byte slices, their first occurrences, gaps and islands of the rest.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, s, md5(substring(h, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM later),
island AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked) GROUP BY doc_id, g),
piece AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM island
          UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN island USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, coalesce(string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a), '') AS k FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(b - a) AS r, count(*) AS c FROM island GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

#: All pairs that share an n-gram, exact similarities, and components by recursion.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
         JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= 0.8 * (na.n + nb.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM pair UNION SELECT r.doc_id, p.b FROM reach r JOIN pair p ON p.a = r.other)
SELECT doc_id, least(doc_id, coalesce(least_other, doc_id)) AS class_id, coalesce(links, 0) AS n_links
FROM w LEFT JOIN (SELECT doc_id, min(other) AS least_other FROM reach GROUP BY doc_id) USING (doc_id)
       LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM pair GROUP BY a) USING (doc_id)
"""

#: The sketches of the small tables hold all their values, so quantile_disc gives the same thresholds.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
          SELECT doc_id, unnest(generate_series(i, i + 7)) AS j FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (
              SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 9)))
          WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(text, '[^!?;:"''()\[\]{}=+~^`_/\\@#*$%&|<>]', '', 'g')) AS n_marks, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, strlen(text) AS n_bytes
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_share, word_chars / greatest(n_words, 1) AS word_length,
        n_marks / greatest(word_chars, 1) AS mark_share, n_upper / greatest(word_chars, 1) AS upper_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share FROM c),
g AS (SELECT *, CASE WHEN (SELECT count(*) FROM m b WHERE NOT b.base_failed AND b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source) >= 50 THEN 1
                     WHEN (SELECT count(*) FROM m b WHERE NOT b.base_failed AND b.lang IS NOT DISTINCT FROM p.lang) >= 50 THEN 2 ELSE 3 END AS level FROM (SELECT DISTINCT lang, source FROM m) p),
q AS (SELECT g.lang, g.source, :quartiles
      FROM g JOIN m b ON NOT b.base_failed AND (g.level = 3 OR b.lang IS NOT DISTINCT FROM g.lang AND (g.level = 2 OR b.source IS NOT DISTINCT FROM g.source)) GROUP BY g.lang, g.source)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND :inside AS kept
FROM m LEFT JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source
""".replace(":quartiles", ", ".join(f"quantile_disc(b.{m}, 0.25) AS lo_{m}, quantile_disc(b.{m}, 0.75) AS hi_{m}" for m in rules.MEASURES)).replace(
    ":inside", " AND ".join(f"m.{m} <= hi_{m} + {rules.FENCE} * greatest(hi_{m} - lo_{m}, {x})" for m, x in rules.MEASURES.items())
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_quality, op3_token_count, op4_bpe, op5_language, op6_decontaminate, op7_repeats, op8_quality_rules, op9_jaccard_join, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": OP6_SQL, "op7_repeats": OP7_SQL, "op8_quality_rules": OP8_SQL, "op9_jaccard_join": OP9_SQL}
