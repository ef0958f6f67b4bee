"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more characters that keys are made of, with a digit among them (a name before = is cut
off), the values of assignments, quoted or not and of any length, passwords in URLs, and, as one each, signed web
tokens of three parts and armoured blocks. A forest of decision trees, trained in numpy from labelled findings, judges
each from its length, its character transitions, how much of it a dictionary covers, the path (source) and the
neighbouring words. The dictionary is the whole words of a tokenizer's vocabulary file, or a short list. Training
findings are a bounded table (findings=); without one, `labelled_findings` makes a seeded set of known kinds of secrets
and of what is mistaken for them. Documents are scanned where they are read, whole, without
a shuffle.

Defined results: null and empty texts have no candidates; repeated rows are scanned one by one; a null path is an
empty one; candidates of any length are judged; redaction replaces each secret by a mark and nothing else, in time in
proportion to the text; a column named findings is replaced, all others come back.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import append

MARK = "[SECRET]"
CUT = 0.5
TREES, DEPTH, LEAST = 25, 8, 3
#: Characters of text on either side that hold the neighbouring words.
NEAR = 48

_RUN = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
#: The name in a run like NAME=value.
_NAME = re.compile(r"(?:^|[+/])[A-Za-z_][\w\-]*=+(?=[^=])")
_QUOTED = re.compile(r"""[\w.\-]["']?\s{0,3}[=:]\s{0,3}(["'])([^"'\s]+)\1""")
#: A value ends before white space, a quote, or a mark that starts the next assignment; :: and // after : are none.
_BARE = re.compile(r"""[\w.\-]["']?[ \t]{0,3}(?::=|=>|[=:])(?![=:]|//)[ \t]{0,3}((?:(?![&;,?][\w.\-]+[=:])[^\s"'`])+)""")
_URL = re.compile(r"://[^\s/?#:@]{0,100}:([^\s/?#]+)@")
_TOKEN = re.compile(r"eyJ[\w\-]{8,}\.[\w\-]{4,}(?:\.[\w\-]+)?")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z ]{1,40})-----[^-]+-----END \1-----")
_CLOSING = ",;.)]}>"
_WORD = re.compile(r"[A-Za-z]+")
_DIGIT = re.compile(r"[0-9]")

#: Words that announce a secret, words that speak against one, parts of paths that do, common words.
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "signature")
PASSWORD_WORDS = ("secret", "password", "passwd", "pwd", "passphrase", "pass")
SAFE_WORDS = ("commit", "sha", "md5", "checksum", "integrity", "digest", "hash", "uuid", "guid", "id", "version", "revision", "card", "phone", "order", "example", "sample", "dummy", "placeholder", "image", "png", "isbn")
SAFE_PATHS = ("test", "example", "sample", "fixture", "lock", "doc", "mock", "vendor", "node_modules")
DICTIONARY = (
    "able about access account action address after alert array base before build button call change char class click client close code color come config connect content control count create data date default delete description different document domain enable entry error event example false field file filter first follow font form format from function get group handle have header height help here home host image import index info input insert int internal item java just key label language last layout length level line link list load local login long main make manager map message method mode model module more name network new next node none not null number object only open option order other output package page param parent password path people place port post process property public query read ready release remove report request reset response result return root route sample save schema script search section select server service session set should show size some source start state static status step stop string style support switch system table target task test text that their there these they this time title true type under update upload user using value version view void when where which width will window with word work world would write your"
).split()
#: Words that count for coverage have so many letters at least.
LEAST_WORD = 4
FEATURES = ("length", "log_length", "transitions", "digit_share", "upper_share", "other_share", "entropy", "distinct_share", "hex", "digits_only", "cover", "vowel_share", "longest_letters", "longest_same", "key_before", "safe_before", "assigned", "quoted", "key_after", "safe_path", "prefix", "placeholder", "dashes", "password_before", "in_url", "reference", "followed", "armoured")


class Dictionary:
    """Words by which a candidate's coverage is measured."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(w for w in words if len(w) >= LEAST_WORD)
        self.longest = max(map(len, self.words), default=0)

    def covered(self, low: str) -> int:
        """Characters that words cover, from the left, the longest word first."""
        at = found = 0
        while at <= len(low) - LEAST_WORD:
            size = next((k for k in range(min(self.longest, len(low) - at), LEAST_WORD - 1, -1) if low[at : at + k] in self.words), 0) if low[at].isalpha() else 0
            found += size
            at += size or 1
        return found


SHORT_LIST = Dictionary(DICTIONARY)


@functools.cache
def dictionary(path: str) -> Dictionary:
    """The whole words in lower-case letters of a vocabulary file with word ends."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end = model["end_of_word_suffix"]
    return Dictionary(w for x in model["vocab"] if x.endswith(end) and (w := x.removesuffix(end)).isascii() and w.isalpha())


def kind(c: str) -> int:
    return 0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3


def longest(pattern: str, text: str) -> int:
    return max((len(m.group()) for m in re.finditer(pattern, text)), default=0)


def describe(value: str, before: str, after: str, path: str, words_known: Dictionary = SHORT_LIST) -> list[float]:
    """Features of a candidate, in the order of FEATURES."""
    n = len(value)
    kinds = [kind(c) for c in value]
    share = Counter(kinds)
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = value.lower()
    words = [w.lower() for w in _WORD.findall(before)][-4:]
    later = [w.lower() for w in _WORD.findall(after)][:3]
    letters = share[0] + share[1]
    tight = before.rstrip(" \t\"'")
    return [
        n,
        math.log(n),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        share[2] / n,
        share[1] / n,
        share[3] / n,
        entropy,
        len(counts) / n,
        float(not set(low) - set("0123456789abcdef")),
        float(share[2] == n),
        words_known.covered(low) / n,
        sum(low.count(v) for v in "aeiou") / max(1, letters),
        longest("[A-Za-z]+", value),
        longest(r"(.)\1*", value),
        float(any(w in KEY_WORDS for w in words[-2:])),
        float(any(w in SAFE_WORDS for w in words[-3:])),
        float(tight.endswith(("=", ":", ":="))),
        float(before.endswith(('"', "'")) and after.startswith(('"', "'"))),
        float(any(w in KEY_WORDS for w in later)),
        float(any(p in path.lower() for p in SAFE_PATHS)),
        float(bool(re.match(r"AKIA|ASIA|gh[pousr]_|sk_|pk_|xox[bap]-|AIza|eyJ|glpat-", value))),
        float(bool(re.search(r"x{4,}|your|example|placeholder|changeme|1234567|abcdef", low))),
        value.count("-") / n,
        float(any(w in PASSWORD_WORDS for w in words[-2:])),
        float(after.startswith("@") and bool(re.search(r"://[^\s/]*:$", before))),
        float(bool(re.match(r"[$<{%(\[*]|[A-Za-z_.]+[(\[]", value))),
        float(bool(re.match(r"[ \t]+[a-z]", after))),
        float(value.startswith("-----")) * (2 if "PRIVATE" in value[:40] else 1),
    ]


def outside(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that touch none of others, which are in order and apart."""
    starts = [a for a, _ in others]
    return [(a, b) for a, b in spans if not (i := bisect.bisect_left(starts, b)) or others[i - 1][1] <= a]


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Ranges of the candidates of a whole text, in order, without overlap."""
    if not text:
        return []
    found = []
    for m in _RUN.finditer(text):
        name = _NAME.search(m.group())
        start = m.start() + (name.end() if name else 0)
        if _DIGIT.search(text, start, m.end()):
            found.append((start, m.end()))
    if "=" in text or ":" in text:
        found += [m.span(2) for m in _QUOTED.finditer(text)]
        urls = [m.span(1) for m in _URL.finditer(text)]
        # A password inside a URL is a candidate alone, without what surrounds it.
        bare = [(m.start(1), m.start(1) + len(m.group(1).rstrip(_CLOSING))) for m in _BARE.finditer(text)]
        found += [x for x in bare if x[0] < x[1]]
        if urls:
            found = outside(found, urls) + urls
    whole = [m.span() for pattern, sign in ((_TOKEN, "eyJ"), (_ARMOUR, "-----BEGIN")) if sign in text for m in pattern.finditer(text)]
    if whole:
        # What such a one holds or touches is no candidate beside it.
        whole.sort()
        found = outside(found, whole) + whole
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def row_of(text: str, span: tuple[int, int], path: str | None, words: Dictionary = SHORT_LIST) -> list[float]:
    a, b = span
    return describe(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], path or "", words)


Finding = tuple[str, str, str, str, int]


def labelled_findings(n: int = 1200, seed: int = 13) -> list[Finding]:
    """(value, before, after, path, 1 if a secret) of seeded examples."""
    rng = random.Random(seed)
    pick = rng.choice

    def run(alphabet: str, size: int) -> str:
        return "".join(pick(alphabet) for _ in range(size))

    def words(k: int) -> str:
        return " ".join("".join(pick(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "io", "ti", "la", "de", "os")) for _ in range(rng.randint(1, 4))) for _ in range(k))

    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    out: list[Finding] = []
    for _ in range(n):
        value = pick((run(hexes, pick((32, 40, 64))), run(hexes, 40), run(alnum, rng.randint(20, 64)), "AKIA" + run(string.ascii_uppercase + string.digits, 16), "ghp_" + run(alnum, 36), "sk_live_" + run(alnum, 24), base64.b64encode(rng.randbytes(pick((24, 30, 48)))).decode(), run(alnum + "+/", 40)))
        name = pick(("token", "secret", "password", "api_key", "access_key", "auth", "client_secret", "private_key"))
        name = pick((name, name.upper(), name.title()))
        quote = pick(('"', '"', "'", ""))
        value = value.upper() if rng.random() < 0.15 else value
        head = pick((f"{name} = {quote}", f"{name}={quote}", f"{name}: {quote}", f"{name} := {quote}", f"{name} {quote}"))
        plain = "".join(words(3).split())
        short = pick((run(alnum, rng.randint(6, 15)), plain[: rng.randint(4, 8)] + run(string.digits, rng.randint(1, 4)) + plain[:3], run(alnum + "!@#$%&*?", rng.randint(4, 18)), pick((plain[:14], plain[:14].title())), pick((pick(DICTIONARY) + plain[:6], plain[:4] + pick(DICTIONARY) + plain[:2]))))
        lone = pick(("AKIA" + run(string.ascii_uppercase + string.digits, 16), "ghp_" + run(alnum, 36), "sk_live_" + run(alnum, 24), run(alnum, rng.randint(28, 64))))
        secret_name = pick(("password", "passwd", "pwd", "secret", "db_password", "client_secret"))
        secret_name = pick((secret_name, secret_name.upper(), secret_name.title()))
        end, more = pick(("", "\n", ",", ";", " ")), words(3)
        out.append((short, f"{words(3)} {secret_name}{pick(('=', ': ', ' = ', ':', ' := '))}{(q := pick(('', '', chr(34), chr(39))))}", q + end + (more if end.strip() or end == "\n" else ""), pick(("src/main.py", "config.yml", "src0", ".env", "")), 1))
        out.append((short, f"{words(2)} {pick(('https', 'postgres', 'ftp', 'amqp'))}://{pick(('user', 'admin', 'root', words(1)))}:", f"@{pick(('host', 'db', 'localhost', words(1)))}/{pick(DICTIONARY)}", pick(("src0", "config.yml", "")), 1))
        out.append((lone, f"{words(4)} ", f" {words(3)}", pick(("src0", "src/main.py", "")), 1))
        signed = ".".join(("eyJ" + run(alnum, rng.randint(15, 40)), "eyJ" + run(alnum + "-_", rng.randint(20, 120)), run(alnum + "-_", 43)))
        out.append((signed, f"{words(3)} {pick(('Bearer ', 'token: ', 'jwt=', '', ''))}", f"{pick((' ', chr(10), chr(34)))}{words(2)}", pick(("src0", "src/main.py", "")), 1))
        secret_block = rng.random() < 0.5
        title = pick(("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY") if secret_block else ("CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY"))
        body = "\n".join(run(alnum + "+/", 64) for _ in range(rng.randint(2, 12)))
        out.append((f"-----BEGIN {title}-----\n{body}\n-----END {title}-----", words(3) + pick((" ", "\n")), "\n" + words(2), pick(("src0", "server.pem", "")), int(secret_block)))
        other = pick(("name", "color", "note", "time", "size", "timeout", "lang", "mode", "port", "status", words(1), pick(DICTIONARY)))
        calm = pick((words(1), pick(DICTIONARY), run(string.digits, rng.randint(1, 6)), f"{rng.randint(0, 23)}:{run(string.digits, 2)}", f"{run(string.digits, 1)}.{run(string.digits, 1)}.{run(string.digits, 1)}", words(1).title(), f"{pick(DICTIONARY)}.{pick(('py', 'txt', 'js'))}", f"/{pick(DICTIONARY)}/{pick(DICTIONARY)}", f"{pick(DICTIONARY)}_{pick(DICTIONARY)}", plain[:14] + run(string.digits, 1)))
        out.append((calm, f"{words(3)} {pick((other, other.title()))}{pick(('=', ': ', ' = ', ':'))}", f"{pick(('', ',', ';', chr(10)))} {words(2)}", pick(("src0", "src/app.js", "config.yml", "")), 0))
        named = pick((pick(DICTIONARY), pick(DICTIONARY).title(), "${" + pick(DICTIONARY).upper() + "}", "$" + pick(DICTIONARY).upper(), f"<{pick(DICTIONARY)}>", "****", f"os.environ[{pick(DICTIONARY)}]", f"get_{pick(DICTIONARY)}()", "null", "None", "true", "false", "your_password", "changeme", "the", "a", "is", "must"))
        out.append((named, f"{words(3)} {pick((secret_name, 'token', 'key', 'api_key', 'auth', 'Key'))}{pick(('=', ': ', ' = ', ':'))}", f"{pick(('', ',', ';', chr(10)))} {words(2)}", pick(("src0", "src/main.py", ".env", "")), 0))
        out.append((words(1), f"{words(3)} {pick(('token', 'key', 'access', 'auth', 'password', 'secret', 'Key'))}: ", f" {words(2)}", pick(("src0", "docs/example.md", "")), 0))
        out.append((value, f"{words(4)} {head}", f"{quote}{pick(('', '!!', '###', ',', ';'))} {words(3)}", pick(("src/main.py", "config.yml", "src0", "src7", ".env", "")), 1))
        kind_no = rng.randrange(9)
        quote = pick(('"', ""))
        if kind_no == 0:
            bad = (run(string.digits, rng.randint(16, 19)), f"{words(4)} ", f" {words(3)}")
        elif kind_no == 1:
            bad = (str(uuid.UUID(int=rng.getrandbits(128))), f"{words(3)} {pick(('id', 'uuid', 'guid', 'request'))} = {quote}", f"{quote} {words(2)}")
        elif kind_no == 2:
            bad = (run(hexes, pick((40, 64, 32))), f"{words(2)} {pick(('commit', 'sha256:', 'md5', 'checksum', 'integrity', 'revision'))} {quote}", f"{quote} {words(3)}")
        elif kind_no == 3:
            bad = ("_".join(pick(DICTIONARY) for _ in range(4)) + run(string.digits, pick((1, 2))), f"{words(3)} ", f"({words(2)}")
        elif kind_no == 4:
            bad = ("/".join(pick(DICTIONARY) for _ in range(5)) + "/v" + run(string.digits, 1), f"{words(3)} path: {quote}", f"{quote} {words(2)}")
        elif kind_no == 5:
            bad = (pick(("your_api_key_1234567", "xxxxxxxxxxxxxxxx1", "example_token_123456", "changeme12345678", "0000000000000000")), f"{words(2)} {pick(('token', 'password', 'key'))} = {quote}", f"{quote} {words(2)}")
        elif kind_no == 6:
            bad = (words(1).replace(" ", "") * 3 + run(string.digits, 2), f"{words(4)} ", f" {words(3)}")
        elif kind_no == 7:
            bad = ("-".join(run(string.digits, pick((3, 4))) for _ in range(4)), f"{words(3)} {pick(('phone', 'card', 'order', ''))} ", f" {words(3)}")
        else:
            bad = (base64.b64encode(rng.randbytes(60)).decode(), f"{words(2)} data:image/png;base64,", f" {words(2)}")
        out.append((*bad, pick(("src/app.js", "package-lock.json", "tests/test_a.py", "src3", "docs/example.md", "")), 0))
    return out


class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, left child, right child, share of secrets."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], words: Dictionary = SHORT_LIST) -> None:
        self.trees, self.words = trees, words

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def best_split(x: np.ndarray, y: np.ndarray, tried: np.ndarray) -> tuple[float, int, float] | None:
    """(impurity, feature, threshold) of the split with the least Gini impurity."""
    best, n = None, len(y)
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAST) & (n - at >= LEAST)]
        if len(at):
            a, b = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (n - at)
            impurity = (at * a * (1 - a) + (n - at) * b * (1 - b)) / n
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0]:
                best = (float(impurity[i]), int(f), float((v[at[i] - 1] + v[at[i]]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list] = []

    def node(rows: np.ndarray, depth: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, me, me, share])
        if depth < DEPTH and 0 < share < 1:
            tried = rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False)
            if (split := best_split(x[rows], y[rows], tried)) and split[0] < share * (1 - share) - 1e-12:
                low = x[rows, split[1]] <= split[2]
                nodes[me][:2] = split[1:]
                nodes[me][2] = node(rows[low], depth + 1)
                nodes[me][3] = node(rows[~low], depth + 1)
        return me

    node(rng.integers(0, len(y), len(y)), 0)
    kinds = (np.int64, float, np.int64, np.int64, float)
    return tuple(np.array(c, k) for c, k in zip(zip(*nodes, strict=True), kinds, strict=True))


def fit(findings: Sequence[Finding] | None = None, seed: int = 3, vocabulary: str | None = None) -> Forest:
    """A forest from labelled findings, which are a bounded table on the driver; vocabulary: a file for the dictionary."""
    rows = list(findings) if findings is not None else labelled_findings()
    known = dictionary(vocabulary) if vocabulary else SHORT_LIST
    x = np.array([describe(v, b, a, p, known) for v, b, a, p, _ in rows])
    y = np.array([label for *_, label in rows], float)
    rng = np.random.default_rng(seed)
    return Forest([grow(x, y, rng) for _ in range(TREES)], known)


FINDINGS = "findings array<struct<start:int,end:int,value_sha256:string,score:double,is_secret:boolean>>"


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", keep_text: bool = True, cut: float = CUT, mark: str | None = None) -> DataFrame:
    """docs with findings: an array of (start, end, value_sha256, score, is_secret), one for each candidate.

    With a mark, it replaces the secrets in the text within the same pass.
    """

    def make():
        def fn(batch):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            paths = batch.column(batch.schema.get_field_index(path_col)).to_pylist()
            spans = [candidates(t) for t in texts]
            rows = [row_of(t, s, None if p is None else str(p), forest.words) for t, p, own in zip(texts, paths, spans, strict=True) for s in own]
            scores = iter(forest.predict(np.array(rows)).tolist() if rows else ())
            found = [[judged(t, s, next(scores), cut) for s in own] for t, own in zip(texts, spans, strict=True)]
            return (found,) if mark is None else (found, [redacted(t, own, mark) for t, own in zip(texts, found, strict=True)])

        return fn

    if mark is not None:
        return append(docs, f"{FINDINGS}, `{text_col}` string", make).select(*(c for c in docs.columns if c != "findings"), "findings")
    return append(docs, FINDINGS, make, drop=() if keep_text else (text_col,))


def judged(text: str, span: tuple[int, int], score: float, cut: float) -> dict:
    value = text[span[0] : span[1]]
    return {"start": span[0], "end": span[1], "value_sha256": hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(), "score": score, "is_secret": score >= cut}


def redacted(text: str | None, findings: list[dict] | None, mark: str) -> str | None:
    """text with a mark in place of each secret; findings are in order and don't overlap."""
    if not text or not findings:
        return text
    out, at = [], 0
    for x in findings:
        if x["is_secret"]:
            out += [text[at : x["start"]], mark]
            at = x["end"]
    return "".join([*out, text[at:]])


def redact(scanned: DataFrame, text_col: str = "text", mark: str = MARK) -> DataFrame:
    """scanned with every secret in its text replaced by the mark."""

    def make():
        def fn(batch):
            texts, findings = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, "findings"))
            return ([redacted(t, own, mark) for t, own in zip(texts, findings, strict=True)],)

        return fn

    return append(scanned, f"`{text_col}` string", make).select(*scanned.columns)
