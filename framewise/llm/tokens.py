"""Token ids of whole texts with a public tokenizer file, remembered by word.

word_bpe_49k.json lower-cases a text and splits it at white space, at digits and between letters and other marks before
anything else. So a text's ids are those of its words between ASCII white space, one after the other; A-Z may be lower-cased
first; and ASCII marks that end a word of letters may be cut off as a word of their own. A word met before costs a dictionary
look-up; a new one of Latin letters goes to the library's BPE model directly, another one through the library's whole chain.
A text that may hold a special token's string is encoded whole. Tests compare with the library's ids of whole texts. A
tokenizer of another kind is used on whole texts: pass by_word=False."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

WORD_BPE = "word_bpe_49k.json"
_MARKED = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]+)")

# A byte's character in byte-level BPE: itself if it can be printed, else the next free one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ids_of(path: str, by_word: bool = True) -> Ids:
    """The worker's Ids for a tokenizer file: what it remembers serves the tasks that follow in the same worker."""
    return Ids(path, by_word)


class Ids(dict):
    """bytes -> little-endian unsigned 32-bit ids. Bounded: it is emptied when it holds `most` words, and long words aren't kept."""

    def __init__(self, path: str, by_word: bool = True, most: int = 300_000, longest: int = 64):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.by_word, self.most, self.longest = Tokenizer.from_file(path), by_word, most, longest
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model

    def _encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: bytes) -> bytes | None:
        """The ids of a word of Latin letters alone, for which the chain before the model only lower-cases and renames bytes."""
        text = word.decode("utf-8", "replace")
        if not text.isalpha() or max(text) > "\u024f" or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
            return None
        renamed = text if text.isascii() else text.lower().encode().decode("latin-1").translate(BYTE_CHARS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(renamed)])

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > self.longest:
            return self._encode(word)
        found = self._letters(word)
        if found is None:
            m = _MARKED.fullmatch(word)
            found = self[m[1]] + self[m[2]] if m and m[1].decode("utf-8", "replace").isalpha() else self._encode(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found

    def of(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or b"<|" in text:
            return self._encode(text)
        return b"".join(map(self.__getitem__, text.lower().split()))
