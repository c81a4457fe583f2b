"""BPE encoding and decoding with a given vocabulary file, by tree concatenation.

White space never lies inside a token of these vocabularies, so a word between white space is encoded on its own and
remembered. What is long is encoded by halves:

* a run without a split point (LONG_RUN characters or more) by halves of halves, each half by itself; then a window of
  tokens around each join is encoded anew and grown until its first token is the left side's own and its last one the
  right side's own. From there on every neighbouring pair of tokens is one that the merge rules leave alone, which
  makes the whole the same as an encoding in one go;
* a text of more than LEAF characters is cut into leaves, wherever that falls, which different tasks encode; around
  each join a window of words is encoded anew and grown until a whole word on either side comes out as before. Where the
  cut goes through a long run of letters, the window is one of tokens, as within a run.

Null text is read as empty: no tokens, empty decoding. Rows that are repeated, or share an id, each give a row. Special
tokens written out in a text count as the library counts them. An empty table gives no rows. Other columns pass unread.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, texts

#: Code points of a leaf of a long text; characters from which a run without split points is encoded by halves.
LEAF, LONG_RUN = 32768, 1024
#: Words, and pieces of words, whose ids a worker remembers; it starts afresh when there are more.
WORDS_KEPT, PIECES_KEPT = 400_000, 300_000
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = set(_LETTERS).__contains__
_NO_LETTER = re.compile("[²³¹¼½¾]")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it prints, else the next one from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in prints}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(prints))
    return out


class WordBpe(dict):
    """Maps a word to its ids as little-endian uint32 bytes; missing words are encoded and kept."""

    def __init__(self, path: str, long_run: int = LONG_RUN):
        from tokenizers import Tokenizer, models

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.long_run = spec["model"], long_run
        self.suffix = model.get("end_of_word_suffix") or ""
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("this vocabulary isn't split at white space in the expected way")
        self.end = self.tokenizer.model
        self.spec, self._open = model, None
        self.models = models
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.marks = set("'").union(*self.special) - set(_LETTERS)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.letters = {i: c for i, c in byte_letters().items()}
        self.pieces: dict[str, bytes] = {}

    @property
    def open(self):
        """The same merges for a part that isn't the end of a run: its last letter carries no end mark."""
        if self._open is None:
            self._open = self.models.BPE(vocab=self.spec["vocab"], merges=[tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in self.spec["merges"]])
        return self._open

    def _direct(self, run: str, last: bool) -> list[int]:
        return [t.id for t in (self.end if last else self.open).tokenize(run)]

    def _letters_of(self, ids: list[int], ended: bool) -> str:
        text = "".join(map(self.tokens.__getitem__, ids))
        return text[: -len(self.suffix)] if ended and self.suffix and text.endswith(self.suffix) else text

    def tree(self, run: str, last: bool = True) -> list[int]:
        """Ids of a run without split points; last: the run's end is the word's end."""
        if len(run) <= self.long_run:
            return self._direct(run, last)
        mid = len(run) // 2
        left, right = self.tree(run[:mid], False), self.tree(run[mid:], last)
        k = 4
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            to_end = last and b == len(right)
            window = self._letters_of(left[-a:], False) + self._letters_of(right[:b], to_end)
            ids = self._direct(window, to_end)
            if (a == len(left) or ids[0] == left[-a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[: len(left) - a] + ids + right[b:]
            k *= 2

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            n = [t.id for t in self.end.tokenize(piece)] if len(piece) <= self.long_run else self.tree(piece)
            ids = struct.pack(f"<{len(n)}I", *n)
            if len(piece) < 64:
                if len(self.pieces) >= PIECES_KEPT:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _plain(self, word: str) -> bytes:
        """A word without special tokens."""
        low = word.lower()
        if low.isascii() and low.isprintable():
            # Most words are letters, or letters and one other character: one piece, or two.
            if low.isalpha():
                return self._piece(low)
            if low[:-1].isalpha():
                return self._piece(low[:-1]) + self._piece(low[-1])
            return b"".join(map(self._piece, _SPLIT.findall(low)))
        # Below U+0250 no normal form changes anything, and letters are what \w takes for such, but for the numbers in _NO_LETTER.
        if max(low) < "\u0250" and low.isprintable() and not _NO_LETTER.search(low):
            return b"".join([self._piece(p.encode().decode("latin-1").translate(self.letters)) for p in _SPLIT.findall(low)])
        low = self.tokenizer.normalizer.normalize_str(word)
        return b"".join([self._piece(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(low)])

    def __missing__(self, word: str) -> bytes:
        if self.specials and "<|" in word and len(parts := self.specials.split(word)) > 1:
            ids = b"".join([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts if p])
        else:
            ids = self._plain(word)
        if len(word) < 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        """Split at what the vocabulary's pattern takes as white space: not at U+001C-U+001F, unlike str.split."""
        if _ODD_SPACE.search(text):
            return [w for w in _SPACE.split(text) if w]
        return text.split()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text)))

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives for a vocabulary without decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def join(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
        """Encoding of two neighbouring stretches of text from theirs, by windows of words around the join."""
        (lt, li), (rt, ri) = left, right
        if not lt or not rt:
            return (lt or rt), (li or ri)
        if (run := self._join_run(lt, li, rt, ri)) is not None:
            return lt + rt, run
        k = 2
        while True:
            start, stop = _words_back(lt, k), _words_on(rt, k)
            a, b = lt[start:], rt[:stop]
            whole = self.encode(a + b)
            old_a, old_b = self.encode(a), self.encode(b)
            first, last = self._edge(a, 0), self._edge(b, -1)
            if (start == 0 or (whole[: len(first)] == first and li.endswith(old_a))) and (stop == len(rt) or (whole[len(whole) - len(last) :] == last and ri.startswith(old_b))):
                return lt + rt, li[: len(li) - len(old_a)] + whole + ri[len(old_b) :]
            k *= 2

    def _join_run(self, lt: str, li: bytes, rt: str, ri: bytes) -> bytes | None:
        """The join of two texts that cut a long run of plain letters in two, by windows of tokens; None where it is another."""
        if not (_PLAIN(lt[-1:]) and _PLAIN(rt[:1])):
            return None
        a, b = len(lt) - len(lt.rstrip(_LETTERS)), len(rt) - len(rt.lstrip(_LETTERS))
        # What follows the run must not combine with its last letter, what stands before not take of its first ones.
        around = lt[len(lt) - a - 1 : len(lt) - a] + rt[b : b + 1]
        if a + b <= self.long_run or not around.isascii() or self.marks.intersection(around):
            return None
        left, right = np.frombuffer(li, "<u4"), np.frombuffer(ri, "<u4")
        k = 4
        while True:
            x, whole_left = self._tail(left, a, k)
            y, whole_right = self._head(right, b, k)
            window = self._letters_of(left[len(left) - x :].tolist(), True) + self._letters_of(right[:y].tolist(), whole_right)
            ids = self._direct(window, whole_right)
            if (whole_left or ids[0] == left[len(left) - x]) and (whole_right or ids[-1] == right[y - 1]):
                return left[: len(left) - x].tobytes() + np.array(ids, "<u4").tobytes() + right[y:].tobytes()
            k *= 2

    def _tail(self, ids: np.ndarray, letters: int, k: int) -> tuple[int, bool]:
        """How many of the last tokens to take, about k, none of which reaches beyond the run; and whether they are all of it."""
        n = 0
        while n < k and n < len(ids) and letters > 0:
            n += 1
            letters -= len(self._letters_of([int(ids[-n])], True))
        return n, letters <= 0

    def _head(self, ids: np.ndarray, letters: int, k: int) -> tuple[int, bool]:
        n = 0
        while n < k and n < len(ids) and letters > 0:
            letters -= len(self._letters_of([int(ids[n])], True))
            n += 1
        return n, letters <= 0

    def _edge(self, text: str, at: int) -> bytes:
        words = self.words(text)
        return self[words[at]] if words else b""

    def join_all(self, leaves: list[tuple[str, bytes]]) -> bytes:
        """Joins neighbours, then neighbours of those: a tree over the leaves in order."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0][1] if leaves else b""


def _is_space(c: str) -> bool:
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _words_back(text: str, k: int) -> int:
    """Where the last k words of text begin, at a white space; 0 if it has fewer."""
    i, inside = len(text), False
    while i:
        i -= 1
        if _is_space(text[i]):
            if inside:
                k -= 1
                if not k:
                    return i
            inside = False
        else:
            inside = True
    return 0


def _words_on(text: str, k: int) -> int:
    inside = False
    for i, c in enumerate(text):
        if _is_space(c):
            if inside:
                k -= 1
                if not k:
                    return i + 1
            inside = False
        else:
            inside = True
    return len(text)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder for each vocabulary and Python worker, whose memory of words outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_with(docs: DataFrame, path: str, finish: Callable, ddl: str, leaf: int = LEAF) -> DataFrame:
    """Encode every whole text; finish(encoder, doc_id, ids as bytes) gives its rows, as tuples of the columns of ddl."""
    docs = texts(docs)
    short, long = docs.where(F.length("text") <= leaf), docs.where(F.length("text") > leaf)

    def whole():
        bpe = load(path)

        def f(ids, text):
            rows = [r for i, t in zip(ids, text, strict=True) for r in finish(bpe, i, bpe.encode(t))]
            return list(map(list, zip(*rows, strict=True))) if rows else None

        return f

    def cut():
        def f(ids, text):
            rows = [(i, hashlib.sha1(t.encode("utf-8", "surrogatepass")).digest(), k // leaf, t[k : k + leaf]) for i, t in zip(ids, text, strict=True) for k in range(0, len(t), leaf)]
            return list(map(list, zip(*rows, strict=True)))

        return f

    def halves():
        bpe = load(path)
        return lambda ids, key, at, text: [ids, key, at, text, [bpe.encode(t) for t in text]]

    def joined():
        bpe = load(path)

        def f(ids, leaves):
            rows = []
            for i, parts in zip(ids, leaves, strict=True):
                by_at: dict[int, list] = {}
                for p in parts:
                    by_at.setdefault(p["at"], []).append((p["text"], p["ids"]))
                code = bpe.join_all([by_at[k][0] for k in sorted(by_at)])
                for _ in by_at[0]:  # a repeated row has each of its leaves repeated
                    rows += finish(bpe, i, code)
            return list(map(list, zip(*rows, strict=True))) if rows else None

        return f

    leaves = map_columns(long, "doc_id long, key binary, at int, text string", cut).repartition("doc_id", "key", "at")
    coded = map_columns(leaves, "doc_id long, key binary, at int, text string, ids binary", halves)
    grouped = coded.groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "text", "ids")).alias("leaves")).select("doc_id", "leaves")
    return map_columns(short, ddl, whole).unionAll(map_columns(grouped, ddl, joined))


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids of every whole text."""
    return encode_with(docs, path, lambda _, i, code: [(i, np.frombuffer(code, "<u4").tolist())], "doc_id long, ids array<int>", leaf)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text, from encode()'s rows; null ids decode to the empty text."""

    def make():
        bpe = load(path)
        return lambda i, ids: [i, [bpe.decode(x or []) for x in ids]]

    return map_columns(encoded.select("doc_id", "ids"), "doc_id long, text string", make)


_DECIMAL: list[str] = []


def digest(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the text decoded from them."""

    def finish(bpe: WordBpe, i: int, code: bytes) -> list[tuple]:
        if not _DECIMAL:
            _DECIMAL.extend(map(str, range(len(bpe.tokens))))
        ids = np.frombuffer(code, "<u4").tolist()
        return [(i, len(ids), hashlib.sha256(" ".join(map(_DECIMAL.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())]

    return encode_with(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", leaf)
