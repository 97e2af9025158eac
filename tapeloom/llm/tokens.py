"""Token ids of whole texts by a public vocabulary, a word at a time.

White space always parts tokens in this kind of vocabulary (normaliser, splitter and merges work inside a stretch of
text without white space), so ids of a text are the ids of its stretches, one after another. Texts of printable Latin-1
characters, where lower case and the splitter's classes are plain, are split in one go into lower-case pieces (a word, a
digit, a run of marks), of which there are far fewer than stretches; other texts go stretch by stretch through the
library's normaliser. Each Python worker keeps the ids of pieces it has met in a bounded table: a table of results, never
of rows. Ids are bytes of little-endian unsigned 32-bit numbers, ready to be joined, counted, hashed and written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

KEPT_WORDS, KEPT_PIECES = 200_000, 1_000_000  # bounds of the tables of one worker
SLICE = 1 << 20  # code points of a text that are split at a time

# How the vocabulary splits text, and the same for lower-cased printable Latin-1 text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[\n\x20-\x7e\xa1-\xff]*")
PLAIN_PIECES = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'s|'t|'re|'ve|'m|'ll|'d"
                          "|[^\n a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")


class PieceIds(dict):
    """Lower-case piece of text -> its ids as bytes."""

    def __init__(self, whole):
        super().__init__()
        self.tokenize = whole.model.tokenize
        self.in_bytes = {c: "".join(p for p, _ in whole.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(0xA1, 0x100)}

    def coded(self, piece: str) -> bytes:
        """Ids of a piece as the splitter gives it, its bytes spelled as letters."""
        return np.array([t.id for t in self.tokenize(piece)], "<u4").tobytes()

    def __missing__(self, text: str) -> bytes:
        ids = self.coded(text.translate(self.in_bytes))
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[text] = ids
        return ids


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a text that begin after a space or line end."""
    at = 0
    while len(text) - at > size:
        ends = [e for e in (text.find(" ", at + size), text.find("\n", at + size)) if e >= 0]
        if not ends:
            break
        yield text[at:min(ends) + 1]
        at = min(ends) + 1
    yield text[at:] if at else text


class WordIds(dict):
    """Stretch of text -> its ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.pieces = PieceIds(self.whole)
        self.by_word = SPLIT in str(self.whole.pre_tokenizer) and "NFC(), Replace" in str(self.whole.normalizer)

    def __missing__(self, word: str) -> bytes:
        if "<|" in word:  # a special token may be written out
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        elif PLAIN.fullmatch(word):
            ids = self.plain(word)
        else:
            normal = self.whole.normalizer.normalize_str(word)
            ids = b"".join(self.pieces.coded(p) for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal))
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PLAIN_PIECES.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; other kinds of vocabulary get it in one piece."""
        if not self.by_word:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.plain, slices(text)))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table for each vocabulary and worker."""
    return WordIds(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
