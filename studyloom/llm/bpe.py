"""BPE encoding and decoding by tree concatenation.

Where nothing splits a long stretch of text, its halves are encoded on their own (recursively, down to leaves) and
joined: a window of tokens around the join is encoded anew and grows until its outer tokens on both sides are the
ones that were there before. That is exact: merges inside a token sequence are those of the whole iff each adjacent
pair of tokens would be left alone, and every adjacent pair lies in the left half, in the window or in the right
half. The same is done on two levels:

* inside a task, for a pre-token longer than a leaf;
* across tasks, for a text longer than cut_chars: its pieces are encoded by different tasks, whatever the script and
  with or without spaces. A cut is made at the first place whose neighbourhood shows what the split pattern does
  there: either a pre-token ends for sure, and the tokens of both sides stand as they are, or both sides are of one
  pre-token, and the join encodes growing windows of tokens anew. Finding the cuts takes time in proportion to the
  text. Pieces then stream by in order, so a join holds the tokens of a pre-token that is still open, not a text.

Short texts (nearly all) are encoded where they are read, without a shuffle. Distinct pre-tokens are encoded once
per task and kept in a bounded table. The split pattern is that of lower-case vocabularies with word ends (letters,
single digits, runs of other marks, English contractions).

Defined results: null text counts as empty (no tokens); repeated rows are encoded one by one; texts of any length
are whole; columns of any name come back, those named like a result are replaced by it. Decoding joins token strings
by a space, as a tokenizer file without a decoder does.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from ._shared import append, released, written

LEAF, WINDOW = 256, 8
CUT_CHARS = 1 << 16
CACHE = 120_000
#: Characters on either side that show what happens at a cut.
NEAR = 8
APART, JOINED = 1, 2

#: Characters below U+0250: the letters of this range in lower case, for a pattern without Unicode classes.
_LOW_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-ɏ"
_LOW_SPACE = "\\t-\\r \x85\xa0"
_LOW_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LOW_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW_LETTERS}]+|[{_LOW_NUMBER}]|[^{_LOW_SPACE}{_LOW_LETTERS}{_LOW_NUMBER}]+")
#: U+0130 has a lower case of two characters, beyond this range.
_NOT_LOW = re.compile("[^\x00-įı-ɏ]")


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge table of a tokenizer file, on strings of byte characters."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = models.BPE(self.vocab, pairs)
        self.last = models.BPE(self.vocab, pairs, end_of_word_suffix=self.end) if self.end else self.inner

    def leaf(self, chars: str, ends: bool) -> list[tuple[int, str]]:
        """(id, characters) of a short stretch; ends: its last character ends the pre-token."""
        tokens = (self.last if ends else self.inner).tokenize(chars)
        out = [(t.id, t.value) for t in tokens]
        if ends and self.end and out:
            out[-1] = (out[-1][0], out[-1][1].removesuffix(self.end))
        return out

    def ids(self, chars: str) -> list[int]:
        """Ids of a whole pre-token."""
        return [t.id for t in self.last.tokenize(chars)] if len(chars) <= LEAF else [i for i, _ in self.encode(chars)]

    def encode(self, chars: str, ends: bool = True, leaf: int = LEAF) -> list[tuple[int, str]]:
        """(id, characters) of a stretch without a split point, by tree concatenation."""
        if len(chars) <= leaf:
            return self.leaf(chars, ends)
        half = len(chars) // 2
        return self.join(self.encode(chars[:half], False, leaf), self.encode(chars[half:], ends, leaf), ends)

    def join(self, left: list, right: list, ends: bool) -> list:
        """Both sides' tokens, with a window around the join encoded anew until its outer tokens agree."""
        n = WINDOW
        while True:
            a, b = left[-n:], right[:n]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            chars = "".join(x for _, x in a) + "".join(x for _, x in b)
            window = self.leaf(chars, ends and whole_right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            n *= 2


class Known(dict):
    """Decimal ids of pre-tokens and, in names, their token strings; each is made when first asked for."""

    def __init__(self, owner: Codec) -> None:
        super().__init__()
        self.owner, self.names, self.long = owner, {}, []

    def __missing__(self, pre_token: str) -> str:
        c = self.owner
        ids = c.merges.ids(c.byte_text(pre_token))
        self.names[pre_token] = " ".join(map(c.tokens.__getitem__, ids))
        found = self[pre_token] = " ".join(map(str, ids))
        if len(pre_token) > 64:
            self.long.append(pre_token)
        return found

    def empty(self) -> None:
        self.clear()
        self.names.clear()

    def bounded(self) -> Known:
        if len(self) > CACHE:
            self.empty()
        return self


class Codec:
    """Exact encoding and decoding of whole texts with a tokenizer file (byte-level BPE behind a split pattern)."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.merges = Merges(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens = {i: s for s, i in self.merges.vocab.items()} | {i: s for s, i in self.special.items()}
        self.chars = byte_chars()
        self.known = Known(self)

    def normal(self, text: str) -> str:
        return text.lower() if not _NOT_LOW.search(text) else self.library.normalizer.normalize_str(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a normalised text, as plain strings."""
        if not _NOT_LOW.search(text):
            return _LOW_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def stretches(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, text) in order."""
        if not self.specials or not self.specials.search(text):
            return [(False, text)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [(False, text[at : m.start()]), (True, m.group())]
            at = m.end()
        return [*out, (False, text[at:])]

    def pre_tokens(self, text: str | None) -> list[tuple[bool, str]]:
        return [(special, p) for special, s in self.stretches(text or "") for p in ([s] if special else self.split(self.normal(s)))]

    def encode(self, text: str | None) -> tuple[str, str, int]:
        """(decimal ids, decoded text, count) of a whole text."""
        ids, names = [], []
        for special, stretch in self.stretches(text or ""):
            if special:
                ids.append(str(self.special[stretch]))
                names.append(stretch)
            elif pre_tokens := self.split(self.normal(stretch)):
                own, named = self.plain(pre_tokens)
                ids.append(own)
                names.append(named)
        joined = " ".join(ids)
        return joined, " ".join(names), joined.count(" ") + 1 if joined else 0

    def plain(self, pre_tokens: list[str]) -> tuple[str, str]:
        """(decimal ids, decoded text) of pre-tokens."""
        ids = " ".join(map(self.known.bounded().__getitem__, pre_tokens))
        names = " ".join(map(self.known.names.__getitem__, pre_tokens))
        if long := self.known.long:
            for x in long:
                del self.known[x], self.known.names[x]
            long.clear()
        return ids, names

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


    @functools.lru_cache(1 << 14)
    def kind(self, char: str) -> str:
        """What the split pattern takes a character for: space, number, letter or other mark."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        if not split(char):
            return "space"
        return "number" if len(split(char * 2)) == 2 else "letter" if len(split("a" + char)) == 1 else "mark"

    def at_cut(self, text: str, at: int) -> int:
        """APART if a pre-token surely ends at a place, JOINED if both sides surely are of one, else 0."""
        longest = max(map(len, self.special), default=0)
        if self.specials and any(m.end() > NEAR and m.start() < 2 * longest + NEAR for m in self.specials.finditer(text[max(0, at - longest - NEAR) : at + longest + NEAR])):
            return 0
        before, after = text[at - 1], text[at]
        if before in " \t\r\n" or after in " \t\r\n":
            return APART
        if unicodedata.combining(before) or unicodedata.combining(after):
            return 0
        left, right = (self.library.normalizer.normalize_str(x) for x in (text[at - NEAR : at], text[at : at + NEAR]))
        if self.library.normalizer.normalize_str(text[at - NEAR : at + NEAR]) != left + right or min(len(left), len(right)) < 5:
            return 0
        one, two = self.kind(left[-1]), self.kind(right[0])
        if one != two:
            return APART if left[-1] != "'" else 0
        if one in ("space", "number"):
            return APART
        # A contraction has at most three characters and starts with a mark.
        if one == "letter":
            return JOINED if all(self.kind(c) == "letter" for c in left[-4:]) else 0
        return JOINED if all(self.kind(c) == "mark" for c in left[-2:] + right[:2]) else 0

    def cuts(self, text: str, size: int) -> list[tuple[int, int]]:
        """(place, APART or JOINED) of cuts, size characters apart or a little more."""
        out, at = [], size
        while at < len(text) - NEAR:
            if at >= NEAR and (sure := self.at_cut(text, at)):
                out.append((at, sure))
                at += size
            else:
                at += 1
        return out

    def piece(self, text: str, left: bool, right: bool) -> tuple[list[int], str, str, int, list[int], bool]:
        """(ids of a pre-token that began before, decimal ids, decoded text, count, ids of a pre-token that goes on
        behind, whether these two are one) of a piece of a text; left, right: whether its ends are inside a pre-token."""
        if not left and not right:
            return [], *self.encode(text), [], False
        stretches = self.stretches(text)
        head, tail = [], []
        if left:
            plain = self.split(self.normal(stretches[0][1]))
            only = len(stretches) == 1 and len(plain) == 1
            head = [i for i, _ in self.merges.encode(self.byte_text(plain[0]), not (only and right))]
            if only:
                return head, "", "", 0, [], right
            plain_from = plain[1:]
        else:
            plain_from = self.split(self.normal(stretches[0][1])) if not stretches[0][0] else None
        groups: list[list[str] | str] = [stretches[0][1] if plain_from is None else plain_from]
        for special, stretch in stretches[1:]:
            groups.append(stretch if special else self.split(self.normal(stretch)))
        if right:
            tail = [i for i, _ in self.merges.encode(self.byte_text(groups[-1].pop()), False)]
        ids, names = [], []
        for group in groups:
            if isinstance(group, str):
                ids.append(str(self.special[group]))
                names.append(group)
            elif group:
                a, b = self.plain(group)
                ids.append(a)
                names.append(b)
        joined = " ".join(ids)
        return head, joined, " ".join(names), joined.count(" ") + 1 if joined else 0, tail, False

    def byte_text(self, pre_token: str) -> str:
        return "".join(map(self.chars.__getitem__, pre_token.encode("utf-8", "surrogatepass")))

    def pairs(self, ids: list[int]) -> list[tuple[int, str]]:
        """(id, characters) of ids inside a pre-token."""
        return [(i, self.tokens[i].removesuffix(self.merges.end) if self.merges.end else self.tokens[i]) for i in ids]


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class Streamed:
    """A text's ids and decoded text, put together from its pieces in order; hashed as they come, or kept."""

    def __init__(self, c: Codec, digests: bool) -> None:
        self.c, self.n, self.open = c, 0, None
        self.sinks = (hashlib.sha256(), hashlib.sha256()) if digests else ([], [])

    def add(self, piece: dict) -> None:
        head, tail = piece["head"], piece["tail"]
        if head:
            own = self.c.pairs(head)
            self.open = self.c.merges.join(self.open, own, not piece["single"]) if self.open else own
            if piece["single"]:
                return
            self.close()
        if piece["n"]:
            self.put(piece["ids"], piece["names"], piece["n"])
        if tail:
            self.open = self.c.pairs(tail)

    def close(self) -> None:
        if self.open:
            ids = [i for i, _ in self.open]
            self.put(" ".join(map(str, ids)), " ".join(self.c.tokens[i] for i in ids), len(ids))
            self.open = None

    def put(self, *parts) -> None:
        for sink, text in zip(self.sinks, parts[:2], strict=True):
            if isinstance(sink, list):
                sink.append(text)
            else:
                sink.update((" " * bool(self.n) + text).encode("utf-8", "surrogatepass"))
        self.n += parts[2]

    def finish(self) -> tuple[int, str, str]:
        self.close()
        return self.n, *(" ".join(s) if isinstance(s, list) else s.hexdigest() for s in self.sinks)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = True, cut_chars: int = CUT_CHARS, digests: bool = True) -> DataFrame:
    """docs with n_tokens and, by choice, digests of ids and decoded text or both themselves (token_ids, decoded)."""
    names = ("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded")
    ddl = f"n_tokens long, {names[0]} string, {names[1]} string"

    def finished(ids: str, text: str, n: int) -> tuple:
        return (n, digest(ids), digest(text)) if digests else (n, ids, text)

    def whole():
        c = codec(path)

        def fn(batch):
            made = [finished(*c.encode(x)) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            return list(zip(*made, strict=True))

        fn.close = c.known.empty
        return fn

    is_long = F.coalesce(F.length(text_col) > cut_chars, F.lit(False))
    # Ids and decoded texts are larger than their texts: they leave in pieces of a batch.
    short = append(docs.where(~is_long), ddl, whole, drop=() if keep_text else (text_col,), piece_by=None if digests else text_col)
    return short.unionByName(encoded_long(docs.where(is_long), path, text_col, keep_text, cut_chars, digests, names))


PIECE = "no long, at int, left boolean, right boolean, piece string"
DONE = "head array<int>, ids string, names string, n long, tail array<int>, single boolean"


def encoded_long(docs: DataFrame, path: str, text_col: str, keep_text: bool, cut_chars: int, digests: bool, names: tuple[str, str]) -> DataFrame:
    """Long texts: pieces go to tasks of their own. The columns that come back are one, row, and travel with the first
    piece; rows have numbers of their own, as ids may repeat."""
    back = [c for c in docs.columns if c not in ("n_tokens", *names) and (c != text_col or keep_text)]
    keyed = docs.select(F.monotonically_increasing_id().alias("no"), F.col(text_col).alias("piece"), F.struct(*(F.col(c) for c in back)).alias("row") if back else F.lit(None).cast("struct<none:int>").alias("row"))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                cuts = [(0, APART), *c.cuts(text, cut_chars), (len(text), APART)]
                parts = [(at, a == JOINED, b == JOINED, text[start:end]) for at, ((start, a), (end, b)) in enumerate(zip(cuts, cuts[1:], strict=False))]
                columns = [pa.array(x, k) for x, k in zip(zip(*parts, strict=True), (pa.int32(), pa.bool_(), pa.bool_(), pa.string()), strict=True)]
                rows = batch.column(2).slice(i, 1).take(pa.array([0, *[None] * (len(parts) - 1)], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(parts), pa.int64()), *columns, rows], ["no", "at", "left", "right", "piece", "row"])

    schema = T._parse_datatype_string(PIECE).add("row", keyed.schema["row"].dataType)
    pieces = written(keyed.mapInArrow(released(cutting), schema)).repartition("no", "at")

    def encoding():
        c = codec(path)

        def fn(batch):
            texts, left, right = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("piece", "left", "right"))
            return list(zip(*map(c.piece, texts, left, right), strict=True))

        fn.close = c.known.empty
        return fn

    done = append(pieces, DONE, encoding, drop=("piece", "left", "right")).repartition("no").sortWithinPartitions("no", "at")

    def concatenating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        now, row, text = None, None, None

        def result() -> pa.RecordBatch:
            n, a, b = text.finish()
            return pa.RecordBatch.from_arrays([row, pa.array([n], pa.int64()), pa.array([a], pa.string()), pa.array([b], pa.string())], ["row", "n", "a", "b"])

        for batch in batches:
            at_row = batch.schema.get_field_index("row")
            for i in range(batch.num_rows):
                piece = {k: batch.column(batch.schema.get_field_index(k))[i].as_py() for k in ("no", "at", "head", "ids", "names", "n", "tail", "single")}
                if piece["no"] != now:
                    if text:
                        yield result()
                    now, row, text = piece["no"], batch.column(at_row).slice(i, 1), Streamed(c, digests)
                text.add(piece)
        if text:
            yield result()

    out = done.mapInArrow(released(concatenating), T.StructType([keyed.schema["row"]]).add("n", "long").add("a", "string").add("b", "string"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in back), F.col("n").alias("n_tokens"), F.col("a").alias(names[0]), F.col("b").alias(names[1]))
