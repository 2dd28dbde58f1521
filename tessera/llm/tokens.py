"""Token ids of whole texts through the tokenizers library, with a bounded cache of words.

A byte-level BPE cuts a text by the usual word pattern and merges within words alone, so a text's ids are those of its words
one behind the other, and natural text repeats its words. The cut is the vocabulary's own pattern: with plain ranges of letters for
texts of ASCII or Latin letters, which is faster, and in Unicode classes for others. Texts that hold the string of a token added to the vocabulary, and all texts of
vocabularies of another kind, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Words kept by a worker, some 200 bytes each; later ones are encoded each time. Common words come early.
CACHED_WORDS = 600_000
#: The pattern of byte-level vocabularies, with ranges of letters and in Unicode classes.
RANGE_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?[{0}]+| ?[0-9]+| ?[^\s0-9{0}]+|\s+(?!\S)|\s+"
ASCII, LATIN = "A-Za-z", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
UNICODE_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_vocabulary() -> str:
    """Path of the byte-level BPE vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Ids of words as little-endian 32-bit bytes; a missing word is encoded by the vocabulary's model."""

    _letters = _byte_letters()

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters))]).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


def _cut_by_words(tokenizer) -> bool:
    """Whether the vocabulary is a byte-level BPE that cuts by the usual pattern and changes no text before."""
    told = json.loads(tokenizer.to_str())
    cut = told["pre_tokenizer"] or {}
    return not told["normalizer"] and told["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)


class Encoder:
    """Encodes texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model) if _cut_by_words(self.tokenizer) else None
        self.ascii, self.latin = (re.compile(RANGE_WORDS.format(x), re.ASCII).findall for x in (ASCII, LATIN))
        self.is_latin = re.compile(f"[\\x00-\\x7f{LATIN}]*").fullmatch
        self.unicode = regex.compile(UNICODE_WORDS).findall

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words is None or any(map(text.__contains__, self.added)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        cut = self.ascii if text.isascii() else self.latin if self.is_latin(text) else self.unicode
        return b"".join(map(self.words.__getitem__, cut(text)))


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(vocabulary)


def encoded(texts: Iterable[str | None], vocabulary: str, end_id: int) -> Iterator[bytes]:
    """Ids of each text (null: empty) and the end id behind them."""
    encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
    for text in texts:
        yield encode(text) + end


def crc(ids: bytes | memoryview) -> int:
    """Unsigned CRC-32 of ids in their stored form."""
    return zlib.crc32(ids)
