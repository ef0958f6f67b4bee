"""Token counts under a unigram model by dynamic programming over a trie.

The distinct new pre-tokens of some documents are inserted in a trie, which is walked depth first (in sorted order,
so only the path to the present node is held). The forward score of a prefix (best sum of piece scores that ends
there, and the number of pieces in it) is computed once, from the nodes above it, and serves every pre-token that
shares the prefix. Terminals keep their counts, so a repeated pre-token costs one lookup; beyond a bound they are
dropped and made again. Documents are counted where they are read, without a shuffle.

The vocabulary file holds merge ranks, not probabilities; a piece of rank r scores -ln(r + 2) - 6 (Zipf's law). A
character without a piece falls back to its UTF-8 bytes, which score FALLBACK each. Equal scores prefer fewer
pieces.

Defined results: null and empty texts have no pre-tokens and 0 tokens; repeated rows are counted one by one; texts and
pre-tokens of any length are whole; columns named like a count are replaced by it, all others come back.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame

from ._shared import append
from ._shared import pieces as chunks

FALLBACK = -25.0
#: Terminals that a worker keeps, and the characters of text whose pre-tokens are inserted at once.
MAX_WORDS, CHUNK = 400_000, 4_000_000
#: Longer pre-tokens don't stay; much longer ones are no path of the trie either, so memory stays bounded.
MAX_WORD, MAX_PATH = 256, 4096
SPACE = "▁"
#: Marks that are pre-tokens of their own.
MARKS = ".,;:!?"


@functools.cache
def pieces(path: str) -> dict[str, float]:
    """Piece -> score of a vocabulary file; control and byte pieces are none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(r + 2) - 6 for r, p in enumerate(names)}


Pieces = dict[str, list]


def piece_trie(vocabulary: dict[str, float]) -> Pieces:
    """The vocabulary as a trie: character -> [score or None, children]."""
    root: Pieces = {}
    for piece, score in vocabulary.items():
        children = root
        for char in piece[:-1]:
            children = children.setdefault(char, [None, {}])[1]
        children.setdefault(piece[-1], [None, {}])[0] = score
    return root


class Counter:
    """pre-token -> the number of pieces of its best segmentation."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.root = piece_trie(vocabulary)
        self.terminals: dict[str, int] = {}

    def insert(self, words: set[str]) -> None:
        """Inserts pre-tokens in the trie and walks it depth first, that is in sorted order.

        Of the trie only the path to the present node is held: forward score, tokens and the pieces that may still
        grow. A prefix that the next pre-token shares is not scored again.
        """
        root, path = self.root, ""
        scores, tokens, growing = [0.0], [0], [[]]
        for word in sorted(words):
            if len(word) > MAX_PATH:
                self.terminals[word] = self.alone(word)
                continue
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :], growing[shared + 1 :]
            for end in range(shared, len(word)):
                char = word[end]
                size = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
                best, n, live = scores[end] + FALLBACK * size, tokens[end] + size, []
                for start, children in growing[end]:
                    if (found := children.get(char)) is not None:
                        if (own := found[0]) is not None:
                            total, k = scores[start] + own, tokens[start] + 1
                            if total > best or total == best and k < n:
                                best, n = total, k
                        if found[1]:
                            live.append((start, found[1]))
                if (found := root.get(char)) is not None:
                    if (own := found[0]) is not None:
                        total, k = scores[end] + own, tokens[end] + 1
                        if total > best or total == best and k < n:
                            best, n = total, k
                    if found[1]:
                        live.append((end, found[1]))
                scores.append(best)
                tokens.append(n)
                growing.append(live)
            path = word
            self.terminals[word] = tokens[-1]

    def alone(self, word: str) -> int:
        """Tokens of a very long pre-token: the same scores, of which only those go on that a piece may still use."""
        root = self.root
        score, n, live = 0.0, 0, []
        for char in word:
            size = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
            best, least, grown = score + FALLBACK * size, n + size, []
            for before, k, children in (*live, (score, n, root)):
                if (found := children.get(char)) is not None:
                    if (own := found[0]) is not None:
                        total = before + own
                        if total > best or total == best and k + 1 < least:
                            best, least = total, k + 1
                    if found[1]:
                        grown.append((before, k, found[1]))
            score, n, live = best, least, grown
        return n

    def count(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each text, given as pre-tokens."""
        if len(self.terminals) > MAX_WORDS:
            self.terminals.clear()
        new = set().union(*texts) - self.terminals.keys() if texts else set()
        self.insert(new)
        get = self.terminals.__getitem__
        out = [sum(map(get, words)) for words in texts]
        for word in new:
            if len(word) > MAX_WORD:
                del self.terminals[word]
        return out


@functools.cache
def counter(path: str) -> Counter:
    """One for each worker process; terminals go with each task."""
    return Counter(pieces(path))


def pre_tokens(text: str | None) -> list[str]:
    """White-space words, each behind the space mark, with sentence marks split off."""
    if not text or not (words := text.split()):
        return []
    spaced = SPACE + f" {SPACE}".join(words)
    for mark in MARKS:
        if mark in spaced:
            spaced = spaced.replace(mark, f" {mark} ")
    return spaced.split()


def count(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_pre_tokens and n_tokens."""

    def make():
        own = counter(path)

        def fn(batch):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            words, tokens = [], []
            for a, b in chunks(texts, CHUNK):
                split = [pre_tokens(t) for t in texts[a:b]]
                words += map(len, split)
                tokens += own.count(split)
            return words, tokens

        fn.close = own.terminals.clear
        return fn

    return append(docs, "n_pre_tokens long, n_tokens long", make, drop=() if keep_text else (text_col,))
