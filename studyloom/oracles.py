"""SQL that gives the rows of the queries, written for an engine of its own."""

from __future__ import annotations

from .functions import lexicon as L


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: White space as the library strips and collapses it, for a regular expression without look-around.
WS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = f"'^{WS}+|{WS}+$', '', 'g'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def normalise(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(translate({x}, chr(160) || chr(8201) || chr(8239) || chr(173), '   '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def capitalised(x: str) -> str:
    return f"upper(substring({x}, 1, 1)) || substring({x}, 2)"


def clean_definition(x: str) -> str:
    own = f"({capitalised(collapse(x))})"
    return f"CASE WHEN regexp_matches({own}, '[.!?]$') OR {own} = '' THEN {own} ELSE {own} || '.' END"


def clean_term(x: str) -> str:
    start = f"regexp_replace({x}, '^((?i:{'|'.join(L.DETERMINERS)})( |$))+', '')"
    return f"trim(regexp_replace({start}, '((^| )(?i:{'|'.join(L.TRAILING_WORDS)}))+$', ''))"


def plausible(x: str) -> str:
    bad = words(L.BAD_TERMS)
    return (
        f"(length({x}) BETWEEN 1 AND {L.MAX_TERM_CHARS} AND lower({x}) NOT IN ({bad}) AND len(list_filter(regexp_split_to_array(lower({x}), '[ -]+'), lambda w: w NOT IN ({bad}))) > 0"
        f" AND len(regexp_split_to_array({x}, ' +')) <= {L.MAX_TERM_WORDS} AND regexp_matches({x}, '\\p{{L}}'))"
    )


WORD = "[A-Za-z0-9''-]+"
TOKEN = WORD + "|[^ \\t\\n\\r\\f\\x0BA-Za-z0-9''-]"
ALPHA = "'^[A-Za-z]+$'"
STOP = words(L.STOP_WORDS)

#: norm: documents. sent: sentences in order. usable: usable ones, with their index among these.
EN = f"norm AS (SELECT doc_id, {normalise('text')} AS text FROM documents)"
SENT = f"""{EN},
line AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS s FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), '\\n+') AS l FROM norm)),
sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, sentence FROM (SELECT doc_id, k, {strip('s')} AS sentence FROM line) WHERE sentence <> '')"""
USABLE = f"""{SENT},
counted AS (SELECT *, regexp_extract_all(sentence, '{WORD}') AS w FROM sent),
usable AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS index, sentence, w FROM counted
           WHERE length(sentence) BETWEEN {L.MIN_SENTENCE_CHARS} AND {L.MAX_SENTENCE_CHARS} AND len(w) >= {L.MIN_SENTENCE_WORDS} AND len(list_filter(w, lambda x: regexp_matches(x, {ALPHA}))) >= {L.MIN_ALPHA_SHARE} * len(w)),
content AS (SELECT doc_id, index, lower(word) AS word FROM (SELECT doc_id, index, unnest(w) AS word FROM usable) WHERE regexp_matches(word, {ALPHA}) AND length(word) > 2 AND lower(word) NOT IN ({STOP}))"""
VOCAB = f"""{EN},
vocab AS (SELECT DISTINCT doc_id, lower(word) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM norm) WHERE regexp_matches(word, {ALPHA}) AND length(word) > 2 AND lower(word) NOT IN ({STOP}))"""
ASOF = f"""{VOCAB},
held AS (SELECT doc_id, count(*) OVER (ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS documents FROM (SELECT DISTINCT doc_id FROM vocab)),
df AS (SELECT doc_id, term, count(*) OVER (PARTITION BY term ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS df FROM vocab)"""


def idf(n: str, df: str) -> str:
    full = f"(ln(({n} + 1.0) / ({df} + 1.0)) + 1.0)"
    few = L.MIN_DOCUMENTS_FOR_IDF
    return f"(CASE WHEN {n} < {few} THEN (1.0 - {n} / {few}.0) * {L.COLD_START_IDF} + {n} / {few}.0 * {full} ELSE {full} END)"


PHRASES = f"""{ASOF},
tok AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM norm)),
total AS (SELECT doc_id, greatest(1, count(*) FILTER (WHERE regexp_matches(token, '^{WORD}$'))) AS total FROM tok GROUP BY doc_id),
run AS (SELECT doc_id, i, token, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM tok WHERE regexp_matches(token, {ALPHA}) AND lower(token) NOT IN ({STOP})),
chunk AS (SELECT doc_id, min(i) AS position, string_agg(token, ' ' ORDER BY i) AS text FROM run GROUP BY doc_id, g HAVING count(*) <= {L.MAX_PHRASE_TOKENS}),
cand AS (SELECT doc_id, position, lower(text) AS key, {capitalised(f"regexp_replace(text, '^((?i:{'|'.join(L.DETERMINERS)}) )+', '')")} AS display FROM chunk
         WHERE length(text) >= {L.MIN_TERM_CHARS} AND lower(text) NOT IN ({words(L.DOMAIN_FILLER)})
           AND NOT (len(list_filter(string_split(lower(text), ' '), lambda w: w NOT IN ({words(L.FILLER_LINKS)}))) > 0 AND len(list_filter(string_split(lower(text), ' '), lambda w: w NOT IN ({words(L.FILLER_LINKS)}) AND w NOT IN ({words(L.DOMAIN_FILLER)}))) = 0)),
counted AS (SELECT doc_id, key, count(*) AS count, arg_min(display, position) AS term, CAST(min(position) AS INTEGER) AS position, CAST(any_value(total) AS INTEGER) AS total FROM cand JOIN total USING (doc_id) GROUP BY doc_id, key),
kw AS (SELECT *, max(count) OVER (PARTITION BY doc_id) AS most FROM counted),
scored AS (SELECT kw.*, round((1.0 + ln(count)) / (1.0 + ln(most)) * {idf('coalesce(documents, 0)', 'coalesce(df, 0)')} * CASE len(string_split(kw.key, ' ')) WHEN 1 THEN 1.0 WHEN 2 THEN 1.1 ELSE 1.15 END * (1.0 + 0.1 * (1.0 - least(position / total, 1.0))), 4) AS score
           FROM kw LEFT JOIN held ON held.doc_id = kw.doc_id LEFT JOIN df ON df.doc_id = kw.doc_id AND df.term = kw.key)"""
FREQ = f"""{USABLE},
f AS (SELECT doc_id, word, count(*) AS freq FROM content GROUP BY ALL),
s AS (SELECT doc_id, index, sum(freq) AS sum, count(*) AS n FROM content JOIN f USING (doc_id, word) GROUP BY ALL),
p AS (SELECT doc_id, max(freq) AS peak FROM f GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS total FROM usable GROUP BY doc_id),
freq_rank AS (SELECT u.doc_id, u.index, coalesce(sum / peak / n * least(n, 30) / 30 * (1.0 + 0.1 * (1.0 - u.index / total)), 0.0) AS score FROM usable u JOIN t USING (doc_id) LEFT JOIN s USING (doc_id, index) LEFT JOIN p USING (doc_id))"""
EDGES = f"""b AS (SELECT CAST(item_id AS INTEGER) AS i, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x)), lambda x: regexp_matches(x, {ALPHA}) AND length(x) > 2 AND x NOT IN ({STOP}))) AS w FROM benchmark),
edge AS (SELECT a.i AS i, c.i AS j, len(list_intersect(a.w, c.w)) / (ln(len(a.w) + 1.0) + ln(len(c.w) + 1.0)) AS weight FROM b a JOIN b c ON a.i < c.i WHERE len(list_intersect(a.w, c.w)) > 0)"""
DEFS = f"""{USABLE},
flat AS (SELECT doc_id, index, {collapse('sentence')} AS evidence FROM usable),
split AS (SELECT doc_id, index, trim(regexp_extract(evidence, '^((?:[A-Za-z''-]+ ){{1,3}}?)(?:is|are) (.+)$', 1)) AS t, regexp_extract(evidence, '^((?:[A-Za-z''-]+ ){{1,3}}?)(?:is|are) (.+)$', 2) AS d FROM flat WHERE regexp_matches(evidence, '^((?:[A-Za-z''-]+ ){{1,3}}?)(?:is|are) (.+)$')),
form AS (SELECT doc_id, index, {clean_term('t')} AS term, {clean_definition('d')} AS definition FROM split),
fit AS (SELECT *, 0.6 + CASE WHEN length(definition) > length(term) THEN 0.05 ELSE 0.0 END - CASE WHEN length(definition) < 1.5 * length(term) THEN 0.1 ELSE 0.0 END AS confidence FROM form WHERE {plausible('term')} AND length(definition) BETWEEN {L.MIN_DEFINITION_CHARS} AND {L.MAX_DEFINITION_CHARS}),
once AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY index) = 1),
def AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(confidence AS DOUBLE) DESC, index) AS INTEGER) AS rank FROM once QUALIFY rank <= 50)"""
WRONG = f"""{DEFS},
wrong AS (SELECT a.doc_id, a.rank, b.definition AS wrong, CAST(row_number() OVER (PARTITION BY a.doc_id, a.rank ORDER BY abs(length(b.definition) - length(a.definition)), lower(b.definition), b.rank) AS INTEGER) AS place
          FROM def a JOIN def b ON a.doc_id = b.doc_id AND lower(a.definition) <> lower(b.definition) AND length(b.definition) >= {L.MIN_DISTRACTOR_CHARS} QUALIFY place <= {L.DISTRACTORS})"""


def with_(ctes: str, rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{rest}"


HEADINGS = f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS k, unnest(x) AS raw FROM (SELECT doc_id, string_split({normalise('text')}, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, k, {strip('raw')} AS line FROM l),
c AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \\t]+'), lambda w: w <> '') AS w FROM s WHERE length(line) > 3 AND length(line) < 80 AND NOT regexp_matches(line, '[.!?:;]$')),
h AS (SELECT doc_id, k, CASE WHEN starts_with(line, '#') THEN {strip("regexp_replace(line, '^[# ]+', '')")} ELSE line END AS heading FROM c
      WHERE starts_with(line, '#') OR (len(w) BETWEEN 2 AND 10 AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 0.6 * len(w)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS pos, heading FROM h QUALIFY pos <= 12"""

TEXTRANK = f"""{EDGES},
both_ways AS MATERIALIZED (SELECT i, j, weight AS w FROM edge UNION ALL SELECT j, i, weight FROM edge),
n AS MATERIALIZED (SELECT count(*) AS n FROM b), total AS MATERIALIZED (SELECT i, sum(w) AS t FROM both_ways GROUP BY i),
share AS MATERIALIZED (SELECT x.i, x.j, x.w / t AS p FROM both_ways x JOIN total USING (i)),
step(k, i, s, moved) AS (
  SELECT 0, i, CAST(1.0 / n AS DOUBLE), CAST(1.0 AS DOUBLE) FROM b, n
  UNION ALL
  SELECT k, i, s, max(abs(s - o)) OVER () FROM (
    SELECT p.k + 1 AS k, p.i AS i, any_value(p.s) AS o,
           {1 - L.DAMPING} / any_value(n.n) + {L.DAMPING} * (coalesce(sum(q.s * share.p), 0) + (SELECT coalesce(sum(z.s), 0) FROM step z WHERE z.i NOT IN (SELECT i FROM total)) / any_value(n.n)) AS s
    FROM step p CROSS JOIN n LEFT JOIN share ON share.j = p.i LEFT JOIN step q ON q.i = share.i
    WHERE p.moved >= {L.TOLERANCE} AND p.k < {L.MAX_ITERATIONS} GROUP BY p.k, p.i))
SELECT i AS index, round(s / sum(s) OVER (), 6) AS score FROM step WHERE k = (SELECT max(k) FROM step)"""

#: Per document: similarity edges, PageRank until its scores settle, and short documents by frequency.
RANKS = f"""{FREQ},
big AS MATERIALIZED (SELECT doc_id, total AS n FROM t WHERE total >= {L.GRAPH_MIN_SENTENCES}),
held AS MATERIALIZED (SELECT DISTINCT doc_id, index AS i, word FROM content JOIN big USING (doc_id)),
size AS MATERIALIZED (SELECT doc_id, i, count(*) AS m FROM held GROUP BY ALL),
both_ways AS MATERIALIZED (SELECT doc_id, i, j, shared / (ln(x.m + 1.0) + ln(y.m + 1.0)) AS w
  FROM (SELECT a.doc_id, a.i, c.i AS j, count(*) AS shared FROM held a JOIN held c ON a.doc_id = c.doc_id AND a.word = c.word AND a.i <> c.i GROUP BY ALL) e
  JOIN size x USING (doc_id, i) JOIN size y ON y.doc_id = e.doc_id AND y.i = e.j),
share AS MATERIALIZED (SELECT doc_id, i, j, w / sum(w) OVER (PARTITION BY doc_id, i) AS p FROM both_ways),
node AS MATERIALIZED (SELECT doc_id, index AS i, n, (doc_id, index) NOT IN (SELECT (doc_id, i) FROM share) AS dangling FROM usable JOIN big USING (doc_id)),
step(k, doc_id, i, s, moved) AS (
  SELECT 0, doc_id, i, CAST(1.0 / n AS DOUBLE), CAST(1.0 AS DOUBLE) FROM node
  UNION ALL
  SELECT k, doc_id, i, s, max(abs(s - o)) OVER (PARTITION BY doc_id) FROM (
    SELECT p.k + 1 AS k, p.doc_id, p.i, p.s AS o, {1 - L.DAMPING} / n + {L.DAMPING} * (coalesce(g.s, 0) + coalesce(z.s, 0) / n) AS s
    FROM step p JOIN node ON node.doc_id = p.doc_id AND node.i = p.i
    LEFT JOIN (SELECT q.doc_id, share.j, sum(q.s * share.p) AS s FROM step q JOIN share ON share.doc_id = q.doc_id AND share.i = q.i GROUP BY ALL) g ON g.doc_id = p.doc_id AND g.j = p.i
    LEFT JOIN (SELECT q.doc_id, sum(q.s) AS s FROM step q JOIN node ON node.doc_id = q.doc_id AND node.i = q.i WHERE node.dangling GROUP BY q.doc_id) z ON z.doc_id = p.doc_id
    WHERE p.moved >= {L.TOLERANCE} AND p.k < {L.MAX_ITERATIONS})),
settled AS (SELECT doc_id, i, s FROM step QUALIFY k = max(k) OVER (PARTITION BY doc_id)),
ranks AS (SELECT doc_id, i AS index, s / sum(s) OVER (PARTITION BY doc_id) AS score FROM settled
          UNION ALL SELECT doc_id, index, score FROM freq_rank JOIN t USING (doc_id) WHERE total < {L.GRAPH_MIN_SENTENCES})"""

VALID = f"""SELECT doc_id, false AS status, CASE WHEN text IS NULL OR length(text) < 1 THEN 422 ELSE 413 END AS status_code,
CASE WHEN text IS NULL OR length(text) < 1 THEN 'text: at least 1 character' ELSE 'text: ' || length(text) || ' characters, at most 5000' END AS message
FROM documents WHERE text IS NULL OR length(text) < 1 OR length(text) > 5000"""

OPTIONS = "SELECT l_orderkey, l_linenumber, CASE " + " ".join(f"WHEN n NOT BETWEEN {a} AND {b} THEN 'options.{name}: between {a} and {b}'" for name, (_, a, b) in L.OPTION_RANGES.items()) + " END AS message FROM (SELECT l_orderkey, l_linenumber, l_partkey % 400 - 50 AS n FROM lineitem)"

FORMS = f"""SELECT item_id, {clean_definition('text')} AS definition, regexp_replace(lower({collapse('text')}), '\\.+$', '') AS back_key, regexp_replace({collapse('text')}, '^(?i:{'|'.join(L.ARTICLES)}) ', '') AS no_article,
{capitalised(collapse(f"regexp_replace(text, '^((?i:{'|'.join(L.DETERMINERS)}) )+', '')"))} AS display, regexp_replace(lower(text), '^((?:{'|'.join(L.ARTICLES)}) )+', '') AS key,
{clean_term("array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 4), ' ')")} AS term FROM benchmark"""

QUIZ = f"""{WRONG},
strong AS (SELECT * FROM def WHERE confidence >= {L.MIN_QUIZ_CONFIDENCE} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) <= {L.MAX_QUIZ_DEFINITIONS}),
full_set AS (SELECT doc_id, rank FROM wrong GROUP BY ALL HAVING count(*) >= {L.DISTRACTORS}),
opt AS (SELECT doc_id, rank, term, definition, definition AS o FROM strong JOIN full_set USING (doc_id, rank) UNION ALL SELECT doc_id, rank, term, definition, wrong FROM strong JOIN full_set USING (doc_id, rank) JOIN wrong USING (doc_id, rank)),
listed AS (SELECT doc_id, rank, term, definition, list(o ORDER BY sha256(term || chr(31) || definition || chr(31) || o), o) AS o FROM opt GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS INTEGER) AS ord, 'What is ' || term || '?' AS prompt, array_to_string(o, chr(10)) AS options, CAST(list_position(o, definition) - 1 AS INTEGER) AS correct_index FROM listed QUALIFY ord <= 10"""


def rows(columns: str, *values: tuple) -> str:
    """A table of expected rows, for fixtures whose answers are written down and not computed."""
    cell = lambda v: "NULL" if v is None else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, v)) + ')' for v in values)}) AS t({columns})"


#: What the sentences of the fixtures define, by hand.
FX_DEFINITIONS = rows(
    "doc_id, term, definition, pattern, confidence",
    (1, "valve", "A small device that controls the flow of water.", "copular", 0.8),
    (2, "pump", "A small device that moves the water to a tank.", "copular", 0.8),
    (3, "dam", "A strong wall of stone.", "cue", 0.95),
    (5, "suspension bridge", "A cable-borne bridge.", "appos", 0.55),
    (6, "lute", "A type of string instrument.", "hypernym", 0.8),
    (11, "delta", "A low plain of sand and mud.", "copular", 0.8),
    (12, "delta", "A low-lying plain consisting of sand and mud.", "copular", 0.8),
    (13, "lute", "A string instrument.", "copular", 0.8),
)

#: What they state, by pattern, by hand.
FX_FACTS = {
    "consist_of": [(21, "clock", "Gears with a spring and two brass hands.")],
    "possess_property": [(22, "steam engine", "A thermal capacity of modest size in the usual case.")],
    "possess_salient": [(23, "engine", "A valve at the top of the cylinder.")],
    "difference_between": [(25, "lute", "The shape of the frame.")],
    "differ_from": [(34, "lute", "A lute differs from a harp in the shape of the frame.")],
    "unlike": [(26, "suspension bridges", "Suspension bridges do not require calm weather.")],
    "comparative_than": [(35, "Granite", "Harder than soft limestone.")],
    "used_to_xcomp": [(28, "pulley", "To move a load in stages.")],
    "used_for": [(36, "pulley", "Steady support of loads.")],
    "useful_for": [(37, "ledger", "Comparison of many sales.")],
    "enable": [(38, "lever", "A movement of the whole load.")],
    "begin_by": [(39, "recipe", "Measuring the dry beans.")],
    "ordered_chain": [(29, "machine", "The machine first sorts the grain and then joins the two batches.")],
}

#: The order-dependent choice among the facts of fixtures, by hand.
FX_SELECTION = rows(
    "doc_id, ord, front, back, kind, confidence",
    (1, 1, "tree — properties", "Nodes with a key.", "PROPERTY", 0.9),
    (1, 2, "stack vs. queue", "The order of removal.", "COMPARISON", 0.85),
    (1, 3, "Tree — purpose", "Keeping keys in order.", "PURPOSE", 0.8),
    (1, 4, "tree — how it works", "Splits a full node.", "PROCESS", 0.75),
    (1, 5, "list", "Growing without copies.", "PURPOSE", 0.6),
    (2, 1, "heap — purpose", "Scheduling of many jobs.", "PURPOSE", 0.65),
    (2, 2, "heap — how it works", "Sifts the last item up.", "PROCESS", 0.55),
)

FX_SYNONYMS = """WITH RECURSIVE r(term, relation, other) AS (VALUES {values}),
above(term, other) AS (SELECT term, other FROM r WHERE relation = 'wider' UNION SELECT a.term, r.other FROM above a JOIN r ON r.term = a.other AND r.relation = 'wider')
SELECT term, other FROM above UNION SELECT term, other FROM r WHERE relation <> 'wider'"""


def masked(key: str, mask: int) -> str:
    """A key of at most 64 bytes, filled up to 64, each byte xor a mask, as a literal of bytes."""
    return "'" + "".join(f"\\x{b ^ mask:02X}" for b in key.encode().ljust(64, b"\0")) + "'::BLOB"


#: The keyed digest by its definition: a digest of the outer key and of the digest of the inner key and the body.
SIGNED = f"""SELECT item_id, sha256({masked('secret', 0x5C)} || unhex(sha256({masked('secret', 0x36)} || encode('{{' ||
concat_ws(',', '"item_id":' || item_id, '"text":' || CAST(to_json(text) AS VARCHAR)) || '}}')))) AS signature FROM benchmark"""


def literal(text: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def all_sql() -> dict[str, str]:
    from .fixtures import HEADED, RELATIONS

    headed = ", ".join(f"({i}, {literal(text)})" for i, text in HEADED.items())
    return {
        "fx_headings": HEADINGS.replace("FROM documents", f"FROM (VALUES {headed}) AS documents(doc_id, text)"),
        "fx_definitions": FX_DEFINITIONS,
        "selection_fold": FX_SELECTION,
        "synonym_antijoin": FX_SYNONYMS.format(values=", ".join(map(repr, RELATIONS))),
        "job_deadletter": rows("value", ('{"job_id": "j3"}',), ("not a job",)),
        "result_route": rows("queue, correlation, message", ("q1", "c1", '{"jobId":"j1","correlationId":"c1","ok":true,"error":null,"result":null}'), ("results", "j2", '{"jobId":"j2","correlationId":null,"ok":true,"error":null,"result":null}'), ("results", "j4", '{"jobId":"j4","correlationId":null,"ok":true,"error":null,"result":null}')),
        **{f"fact_{p}": rows("doc_id, pattern, term, back", *((d, p, t, b) for d, t, b in own)) for p, own in FX_FACTS.items()},
        "norm_text": f"SELECT doc_id, {normalise('text')} AS text FROM documents",
        "collapse_ws": f"SELECT doc_id, {collapse('text')} AS text FROM documents",
        "list_marker": f"SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, regexp_replace(l, '^{WS}*(?:[-•*·]|\\(?[0-9]{{1,3}}[.)]){WS}*', '') AS line FROM (SELECT doc_id, generate_subscripts(x, 1) AS k, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))",
        "whitespace_share": f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE (length(text) - length(regexp_replace(text, '{WS}', '', 'g'))) / length(text) END, 9) AS share FROM documents",
        "heading_lines": HEADINGS,
        "sentences_l0": with_(SENT, "SELECT doc_id, pos, sentence FROM sent"),
        "tokens_l0": with_(EN, f"SELECT doc_id, CAST(i AS INTEGER) AS i, token, lower(token) AS lower, regexp_matches(token, {ALPHA}) AS is_alpha FROM (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM norm))"),
        "usable_sentences": with_(USABLE, "SELECT doc_id, index, sentence FROM usable"),
        "doc_stats": with_(USABLE, f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS INTEGER) AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS sentences FROM norm LEFT JOIN (SELECT doc_id, count(*) AS n FROM usable GROUP BY doc_id) USING (doc_id)"),
        "clean_forms": FORMS,
        "cloze_blank": with_(USABLE, f"SELECT doc_id, index, regexp_replace(flat, '^(.*?)(^|[^A-Za-z0-9_-])' || word || '([^A-Za-z0-9_-].*$|$)', '\\1\\2{L.BLANK}\\3', 'is') AS front FROM (SELECT doc_id, index, {collapse('sentence')} AS flat, w[3] AS word FROM usable)"),
        "plausible_terms": with_(USABLE, f"SELECT doc_id, index, term, {plausible('term')} AS plausible, coalesce(len(string_split(term, ' ')) > 2 AND lower(string_split(term, ' ')[1]) IN ({words(L.PROPERTY_NOUNS)}) AND lower(string_split(term, ' ')[2]) = 'of', false) AS is_property FROM (SELECT doc_id, index, array_to_string(list_slice(w, 1, 3), ' ') AS term FROM usable)"),
        "vocab": with_(VOCAB, "SELECT doc_id, term FROM vocab"),
        "doc_freq": with_(VOCAB, "SELECT term, count(*) AS df FROM vocab GROUP BY term"),
        "corpus_stats": with_(VOCAB, "SELECT count(DISTINCT doc_id) AS documents FROM vocab"),
        "term_siblings": f"WITH r(term, relation, other) AS (VALUES {', '.join(map(repr, RELATIONS))}) SELECT DISTINCT a.term, b.term AS sibling FROM r a JOIN r b ON a.other = b.other AND a.term <> b.term WHERE a.relation = 'wider' AND b.relation = 'wider'",
        "idf_final": with_(VOCAB, f"SELECT term, round({idf('n', 'df')}, 6) AS idf FROM (SELECT term, count(*) AS df FROM vocab GROUP BY term), (SELECT count(DISTINCT doc_id) AS n FROM vocab)"),
        "idf_asof": with_(ASOF, f"SELECT doc_id, term, documents, df, round({idf('documents', 'df')}, 6) AS idf FROM df JOIN held USING (doc_id)"),
        "kw_counts": with_(PHRASES, "SELECT doc_id, key, count, term, position, total, most FROM kw"),
        "kw_topk": with_(PHRASES, "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lower(term), key) AS INTEGER) AS place, key, term, score, count FROM scored QUALIFY place <= 20"),
        "freq_rank": with_(FREQ, "SELECT doc_id, index, round(score, 9) AS score FROM freq_rank"),
        "textrank": "WITH RECURSIVE " + TEXTRANK,
        "sim_edges": with_(EDGES, "SELECT i, j, round(weight, 9) AS weight FROM edge"),
        "sentence_cut": with_(FREQ, "SELECT doc_id, round(score, 9) AS cut FROM (SELECT doc_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, index) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM freq_rank) WHERE place = greatest(0, least(n - 1, CAST(floor(n * 0.25) AS BIGINT) - 1))"),
        "rank_all": with_(RANKS, "SELECT doc_id, index, round(score, 6) AS score FROM ranks", recursive=True),
        "summary_all": with_(RANKS, f"SELECT doc_id, index, {collapse(f'''regexp_replace(sentence, '^{WS}*(?:[-•*·]|\\(?[0-9]{{1,3}}[.)]){WS}*', '')''')} AS text, round(score, 6) AS score FROM (SELECT doc_id, index, round(score, 9) AS score FROM ranks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, index) <= 5) JOIN usable USING (doc_id, index)", recursive=True),
        "summary_freq": with_(FREQ, f"SELECT doc_id, index, {collapse(f'''regexp_replace(sentence, '^{WS}*(?:[-•*·]|\\(?[0-9]{{1,3}}[.)]){WS}*', '')''')} AS text, round(score, 6) AS score FROM (SELECT doc_id, index, round(score, 9) AS score FROM freq_rank QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, index) <= 5) JOIN usable USING (doc_id, index)"),
        "def_surface": with_(DEFS, "SELECT doc_id, rank, index, term, definition, 'copular' AS pattern, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM def"),
        "definition_cards": with_(DEFS, f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS INTEGER) AS ord, term AS front, definition AS back, 'DEFINITION' AS kind FROM def WHERE NOT coalesce(len(string_split(term, ' ')) > 2 AND lower(string_split(term, ' ')[1]) IN ({words(L.PROPERTY_NOUNS)}) AND lower(string_split(term, ' ')[2]) = 'of', false) QUALIFY ord <= 25"),
        "quiz_distractors": with_(WRONG, "SELECT doc_id, rank, place, wrong FROM wrong"),
        "quiz": with_(QUIZ.rpartition("\nSELECT")[0], "SELECT" + QUIZ.rpartition("\nSELECT")[2]),
        "request_validation": VALID,
        "option_validation": OPTIONS,
        "limit_clamp": "SELECT event_id, greatest(1, least(n, 100)) AS quiz, greatest(1, least(n, 50)) AS summary FROM (SELECT event_id, user_id % 300 - 40 AS n FROM events)",
        "job_parse": "SELECT conv_id || '-' || turn AS job_id, text, role AS queue, text IS NOT NULL AS is_good FROM conversations",
        "cosine_band": f"SELECT query_id, vec_id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0) WHERE s BETWEEN {L.BAND_LOW} AND {L.BAND_HIGH}",
        "signed_bodies": SIGNED,
    }
