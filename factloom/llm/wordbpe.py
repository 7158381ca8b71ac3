"""Token ids of whole texts for a public BPE vocabulary whose pre-tokenizer drops white space.

Such a vocabulary never joins what stands on either side of a space, so a text's ids are its words' ids one
after another.  A worker keeps the ids of words it has met; the library encodes only the others.
"""

from __future__ import annotations

import os
import re

#: Words a worker remembers.  Beyond it the memory starts anew, which costs time and never a result.
MEMORY_WORDS = 300_000
#: Letters that stay one code point each under NFC and lower-casing, then at most one mark that stands alone.
PLAIN = re.compile("([a-zà-öø-ÿÀ-ÖØ-Þ]+)([.,;:!?]?)")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


class WordIds(dict):
    """word (UTF-8 bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self[b""] = b""
        self.direct = True
        probe = ["over", "älter", "ÉTÉ", "ÿ.", "straße", "a,"]
        want = [self.library(x) for x in probe]
        self.learn([x.encode() for x in probe])
        self.direct = all(b"".join(i.to_bytes(4, "little") for i in w) == self[x.encode()] for x, w in zip(probe, want, strict=True))
        self.clear()
        self[b""] = b""

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words) -> None:
        import numpy as np

        new = [w for w in words if w not in self]
        if not new:
            return
        if len(self) + len(new) > MEMORY_WORDS:
            self.clear()
            self[b""] = b""
            new = list(dict.fromkeys(words))
        plain, others = [], []
        for word in new:
            text = word.decode()
            if self.direct and (parts := PLAIN.fullmatch(text)):
                plain.append((word, parts[1], parts[2]))
            else:
                others.append((word, text))
        codes = self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)
        for (word, _), code in zip(others, codes, strict=True):
            self[word] = np.array(code.ids, dtype="<u4").tobytes()
        for word, letters, mark in plain:
            self[word] = self.run(letters) + (self.run(mark) if mark else b"")

    def run(self, letters: str) -> bytes:
        """The ids of what the pre-tokenizer leaves in one piece, without the steps before the model."""
        key = letters.encode()
        if (known := self.get(key)) is None:
            shown = letters.lower().encode().decode("latin-1").translate(LETTERS)
            known = b"".join(token.id.to_bytes(4, "little") for token in self.tokenizer.model.tokenize(shown))
            if len(self) < MEMORY_WORDS:
                self[key] = known
        return known

    def words(self, text: str) -> list[bytes]:
        """The stretches between spaces, tabs and line feeds.

        A-Z may be lower-cased first, as the normalizer does it later, but for texts that may hold a special
        token: those are matched before normalization.
        """
        raw = text.encode("utf-8", "replace")
        if b"<|" not in raw:
            raw = raw.lower()
        return raw.replace(b"\n", b" ").replace(b"\t", b" ").split(b" ")

    def encode(self, text: str) -> bytes:
        words = self.words(text)
        try:
            return b"".join(map(self.__getitem__, words))
        except KeyError:
            self.learn(dict.fromkeys(words))
            return b"".join(map(self.__getitem__, words))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory per worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
