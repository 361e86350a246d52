"""Token ids of whole texts with a published vocabulary file."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from string import punctuation

END_ID = 2
#: Entries of a worker's word cache before it starts anew, keeping the former ones for look-ups, and the longest word it keeps.
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
#: White space to Python that is none to the vocabulary; letters whose small form depends on their place or is no single letter.
ODD_SPACE, ODD_LOWER = re.compile("[\x1c-\x1f]"), re.compile("[\u03a3\u0130]")
#: What the vocabulary's special tokens, whose letters count as they are, start with.
SPECIAL = "<|"
PROBE = "Two Words, sp\u00e9cial\tOnes. it's 42 x-y end!?%"


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, filled by the tokenizers library on demand.

    For a vocabulary that splits texts at white space before it merges anything
    and lowers letters, a text's ids are its words' ids one after the other, and
    a word of letters needs no more than the merges. Whether the vocabulary is of
    that kind is tried out first; with any other one, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.older: dict[str, bytes] = {}
        self.by_word = self.encoded(PROBE) == b"".join(map(self.__getitem__, PROBE.split()))

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, word: str) -> bytes:
        """The ids of a word of small letters: merges alone."""
        if not word.isascii():
            word = self.letters.pre_tokenize_str(word)[0][0]
        return array("I", [token.id for token in self.tokenizer.model.tokenize(word)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids, worth = self.older.get(word), True
        if ids is None:
            bare = word.rstrip(punctuation)
            small = bare.lower()
            if not bare.isalpha() or not bare.isascii() and (unicodedata.normalize("NFC", bare) != bare or ODD_LOWER.search(bare)):
                ids = self.encoded(word)
            elif small == word:
                ids = self.merged(word)
            else:  # letters and closing marks are merged apart
                worth = small in self or small in self.older  # forms of rare words would only crowd the cache
                ids = self[small] + (self[word[len(bare) :]] if bare != word else b"")
        if worth and len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        """The ids of a text (null: empty) and the end id."""
        text = text or ""
        if not self.by_word or ODD_SPACE.search(text):
            return self.encoded(text) + END_BYTES
        if SPECIAL not in text and unicodedata.is_normalized("NFC", text) and not ODD_LOWER.search(text):
            text = text.lower()  # as the vocabulary does, so that fewer forms are looked up
        return b"".join(map(self.__getitem__, text.split())) + END_BYTES


END_BYTES = END_ID.to_bytes(4, "little")
_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's cache for a vocabulary file, kept from task to task."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def texts_of(batches: Iterator, column: str = "text", slice_rows: int = 256) -> Iterator:
    """Slices of Arrow batches with their texts as Python strings, so that few texts are alive at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, slice_rows):
            part = batch.slice(at, slice_rows)
            yield part, part.column(column).to_pylist()
