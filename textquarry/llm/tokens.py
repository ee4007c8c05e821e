"""Token ids by public vocabularies, in Python workers.

Vocabulary files are read from the folder of the ``public_tokenizers`` package or from one given; they are not part of
this repository. Encoders are made once for each worker process.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from functools import lru_cache

import numpy as np

END = 2
ID_BYTES = [struct.Struct(f"={n}I") for n in range(64)]
END_BYTES = np.array([END], np.uint32).tobytes()
#: Words, and stems, whose ids a worker keeps; all go when there are more.
KEPT_WORDS = 600_000


def vocabulary(name: str, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the character of its number if that is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def tokenizer(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ByteEncoder:
    """Ids of a byte-level vocabulary. Its ranks give the same ids as its tokenizers file in a third of the time; texts
    that hold a special token's string go through the tokenizers file itself."""

    def __init__(self, folder: str | None = None, name: str = "byte_bpe_50k", special: tuple[str, ...] = ("<|endoftext|>",)):
        import public_tokenizers
        import tiktoken

        with open(vocabulary(f"{name}.tiktoken", folder), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full, self.special = vocabulary(f"{name}.json", folder), special

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids and the end id."""
        if any(s in text for s in self.special):
            ids = tokenizer(self.full).encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array([*ids, END], np.uint32)


class WordEncoder:
    """Ids of a lower-casing vocabulary whose tokens span neither white space nor a change between letters and marks: a
    word, and a word's stem of letters, is encoded once by the tokenizers library and then kept."""

    #: Python's split() also parts at these, which are not white space to the vocabulary.
    ODD = re.compile("[\x1c-\x1f]")
    STEM = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]*)")

    def __init__(self, folder: str | None = None, name: str = "word_bpe_49k.json", special: tuple[str, ...] = ("<|startoftext|>", "<|endoftext|>")):
        self.tokenizer = tokenizer(vocabulary(name, folder))
        self.model = self.tokenizer.model
        self.special = special
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        return [np.array(got.ids, np.uint32).tobytes() for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        known, stems, match = self.known, self.stems, self.STEM.fullmatch
        if len(stems) + 2 * len(words) > KEPT_WORDS:
            stems.clear()
        others = []
        for word in words:
            if m := match(word):
                stem, mark = m.groups()
                if (ids := stems.get(stem := stem.lower())) is None:
                    # Lower-cased letters, as the library's own steps leave them, need its model only.
                    tokens = self.model.tokenize(stem if stem.isascii() else stem.translate(LETTERS))
                    stems[stem] = ids = ID_BYTES[len(tokens)].pack(*[t.id for t in tokens]) if len(tokens) < 64 else self._encoded([stem])[0]
                if mark and (after := stems.get(mark)) is None:
                    stems[mark] = after = self._encoded([mark])[0]
                known[word] = ids + after if mark else ids
            else:
                others.append(word)
        if others:
            known.update(zip(others, self._encoded(others), strict=True))

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids and the end id."""
        if self.ODD.search(text) or any(s in text for s in self.special):
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], np.uint32)
        words, known = text.split(), self.known
        got = list(map(known.get, words))
        if None in got:
            missing = {w for w, ids in zip(words, got, strict=True) if ids is None}
            if len(known) + len(missing) > KEPT_WORDS:
                known.clear()
                missing = set(words)
            if 2 * len(missing) > KEPT_WORDS:  # more different words than are kept
                return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], np.uint32)
            self._learn(missing)
            got = [known[w] if ids is None else ids for w, ids in zip(words, got, strict=True)]
        got.append(END_BYTES)
        return np.frombuffer(b"".join(got), np.uint32)


@lru_cache(maxsize=2)
def byte_encoder(folder: str | None = None) -> ByteEncoder:
    return ByteEncoder(folder)


@lru_cache(maxsize=2)
def word_encoder(folder: str | None = None) -> WordEncoder:
    return WordEncoder(folder)
