"""Exact, memoised tokenisation with vocabulary files of public tokenizers.

BPE merges never cross the borders of the pre-tokenizer's pieces, so a text's ids are the
concatenated ids of its pieces.  `PieceEncoder` splits a text into those pieces itself, looks each
piece up in a bounded memo and hands only unseen pieces to the tokenizers library.  Texts with any
character outside the well-understood Latin range below take the library's own path, so ids are
always those of ``Tokenizer.encode(text, add_special_tokens=False)`` of the file as loaded.  Texts that
hold the string of a special token take that path too, so such a string is the special token's id.

Cases: null counts as empty, and both have no ids; repeated texts have equal ids; memory is bounded by
the memos and by one batch of texts, however long.
"""

from __future__ import annotations

import gc
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

#: Code points on which the split below and the library agree: printable ASCII with tab, newline
#: and carriage return, Latin-1 and Latin Extended-A without the dotted capital I (whose lower case
#: has two characters), and general punctuation without separators and format characters.
_PLAIN = [(9, 10), (13, 13), (32, 126), (0xA1, 0x12F), (0x131, 0x17F), (0x2010, 0x2027), (0x20AC, 0x20AC)]


def _ranges(prefix: str) -> str:
    return "".join(
        re.escape(chr(c)) for a, b in _PLAIN for c in range(a, b + 1) if unicodedata.category(chr(c)).startswith(prefix)
    )


_L, _N = _ranges("L"), _ranges("N")
_ODD = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _PLAIN) + "]")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPLITS = {
    # byte-level split: a leading space belongs to the word
    "byte": re.compile(rf"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^\t\n\r {_L}{_N}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"),
    # word split: lower case, white space dropped, digits alone
    "word": re.compile(rf"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^\t\n\r {_L}{_N}]+"),
}


#: Byte-level vocabularies spell bytes as letters: printable ones of Latin-1 as themselves, the rest
#: by the letters from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ALONE = "\0"
#: White space that is not one space or one line break.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


def _spelled(piece: str) -> str:
    """A piece in the letters of a byte-level vocabulary."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", chr(_BYTE_LETTERS[32]))
    return piece.encode().decode("latin-1").translate(_BYTE_LETTERS)


def _bytes(ids: list[int], code: str) -> bytes:
    found = array(code, ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class PieceEncoder:
    """Encodes texts to little-endian bytes of uint32 ids, or of uint16 ids with code "H".

    Words between spaces are looked up in one memo, the pieces of unseen words in another, and the
    pieces unseen there go to the library's model.  A space before a visible character
    always starts a new piece, so words are independent.  Both memos are bounded, so memory is too,
    and results never change.
    """

    def __init__(self, path: str, memo_words: int = 1_200_000, memo_pieces: int = 300_000, code: str = "I"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: each id as bytes
        self.known = [_bytes([i], code) for i in range(self.tok.get_vocab_size())]
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.lower = self.tok.normalizer is not None
        self.split = _SPLITS["word" if self.lower else "byte"].findall
        self.memo_words, self.memo_pieces, self.code = memo_words, memo_pieces, code
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return _bytes(self.tok.encode(text, add_special_tokens=False).ids, self.code)

    def _independent(self, text: str) -> list[str]:
        """The text in parts whose ids are independent; _ALONE marks those that do not follow a space."""
        if self.lower:
            return text.lower().split()
        if text[0] == " " or text[-1] == " " or any(x in text for x in _RUNS):
            return [_ALONE + p for p in self.split(text)]
        # a lone line break is a piece, and the word behind it follows no space
        return (_ALONE + text.replace("\n", f" {_ALONE}\n {_ALONE}")).split(" ")

    def _cut(self, word: str) -> list[str]:
        if word[0] == _ALONE:
            return self.split(word[1:])
        return self.split(word if self.lower else " " + word)

    def _unseen(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in the memo."""
        # a piece is what the pre-tokenizer hands to the model, but for its spelling of bytes
        model, known, pieces = self.tok.model.tokenize, self.known, self.pieces
        space, mark = ("", "") if self.lower else (" ", chr(_BYTE_LETTERS[32]))
        found, cut = {}, {}
        for w in words:
            if w.isalpha():  # a piece of its own
                found[w] = b"".join([known[t.id] for t in model(mark + w if w.isascii() else _spelled(space + w))])
            else:
                cut[w] = self._cut(w)
        fresh = {p: b"".join([known[t.id] for t in model(_spelled(p))]) for p in {p for ps in cut.values() for p in ps}.difference(pieces)}
        for w, ps in cut.items():
            found[w] = b"".join([pieces[p] if p in pieces else fresh[p] for p in ps])
        pieces.update(islice(fresh.items(), max(0, self.memo_pieces - len(pieces))))
        self.words.update(islice(found.items(), max(0, self.memo_words - len(self.words))))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        # a batch makes millions of strings and no cycles: the collector would only walk them again and again
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        get, out, holes, unseen = self.words.get, [], [], set()
        for text in texts:
            if not text:
                out.append([b""])
            elif _ODD.search(text) or any(map(text.__contains__, self.added)):  # the library must read it as a whole
                out.append([self._library(text)])
            else:
                words = self._independent(text)
                ids = list(map(get, words))
                out.append(ids)
                if None in ids:
                    at = [i for i, x in enumerate(ids) if x is None]
                    missing = [words[i] for i in at]
                    unseen.update(missing)
                    holes.append((ids, at, missing))
        if unseen:
            found = self._unseen(unseen)
            for ids, at, missing in holes:
                for i, w in zip(at, missing):
                    ids[i] = found[w]
        return [b"".join(ids) for ids in out]


@lru_cache(maxsize=2)
def encoder(path: str, code: str = "I", memo_words: int = 1_200_000) -> PieceEncoder:
    """The process's encoder of a vocabulary: Python workers serve many tasks, and load and learn once.

    The memo stays in the worker, beside what other operators load there.
    """
    return PieceEncoder(path, memo_words, memo_words // 4, code)
