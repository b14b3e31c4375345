"""Token ids of whole texts, by a word cache in front of a public tokenizer."""

from __future__ import annotations

import os
from unicodedata import is_normalized

import numpy as np

CACHE_WORDS, CACHE_PARTS = 250_000, 700_000
#: ASCII signs that the splitter keeps apart from letters; the apostrophe begins endings such as 's
_SIGNS = "".join(map(chr, (*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127))))
_LOADED: dict[tuple, "WordCache"] = {}


class WordCache(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes; :meth:`ids` does whole texts.

    The tokenizer's splitter never joins across a space and its normalizer turns white space
    into spaces, so a text's ids are those of its space-separated words one after another. Signs around a run of letters
    are apart too, and case is folded, so such a word is put together from parts met before. Only new parts go
    to the tokenizer. The caches are emptied when full.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS, parts: int = CACHE_PARTS):
        self.most_words, self.most_parts = words, parts
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        # byte-level vocabularies write a byte as the sign of that number, or, if that does not print, as one after 255
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.shown = {b: 256 + i for i, b in enumerate(hidden)}

    def _letters(self, letters: str) -> bytes:
        """Folded letters are one run for the splitter, so the merges apply at once; unusual ones take the whole way."""
        if not (letters.isalpha() and is_normalized("NFC", letters)):
            return self._part(letters)
        found = self.model.tokenize(letters.encode().decode("latin-1").translate(self.shown))
        code = self.parts[letters] = np.array([t.id for t in found], "<u4").tobytes()
        return code

    def _part(self, part: str) -> bytes:
        code = self.parts[part] = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        return code

    def __missing__(self, word: str) -> bytes:
        letters = word.strip(_SIGNS)
        low = letters.lower()
        # a capital sigma's small form depends on its place; some small forms have signs that part from letters
        if letters.isalpha() and low.isalpha() and "\u03a3" not in letters:
            known = self.parts
            code = known.get(low) or self._letters(low)
            if len(letters) < len(word):
                at = word.index(letters)
                before, after = word[:at], word[at + len(letters) :]
                code = (before and (known.get(before) or self._part(before)) or b"") + code + (after and (known.get(after) or self._part(after)) or b"")
        else:
            code = self._part(word) if word else b""
        self[word] = code
        return code

    def ids(self, text: str) -> bytes:
        if len(self) > self.most_words:
            self.clear()
        if len(self.parts) > self.most_parts:
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def word_cache(path: str, words: int = CACHE_WORDS, parts: int = CACHE_PARTS) -> WordCache:
    """One per Python worker, file and size."""
    key = path, words, parts
    if key not in _LOADED:
        _LOADED[key] = WordCache(*key)
    return _LOADED[key]


def drop_caches() -> None:
    """Give back what this worker keeps for tokenizers; later stages of a job that need none call it."""
    _LOADED.clear()


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
