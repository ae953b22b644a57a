"""Token ids of whole texts from a public tokenizer file, with the pieces between blanks remembered.

The tokenizer never joins across white space, nor across the borders of letter, digit and symbol runs, so a text's ids are the ids of
its runs one after the other; a run goes to the tokenizer's model in the byte-level letters of its vocabulary.  Two bounded caches per Python worker (words, runs) save most of the work; a word outside the
plain Latin range, or one with a special token's string, is encoded as it is, and so is a text with control blanks, on which
the libraries differ.
"""

from __future__ import annotations

import array
import itertools

import numpy as np
import regex

from webloom.llm import textops as X

_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ODD_BLANKS = regex.compile("[\x1c-\x1f]")
_MARKS = ".,;:!?#$%&*"
MAX_WORDS, MAX_RUNS = 300_000, 1_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next letter from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


def _runs(word: str) -> list[str]:
    """The word's letter, digit and symbol runs."""
    core = word.rstrip(_MARKS)
    if core.isalpha():
        return [core, word[len(core) :]] if len(core) < len(word) else [core]
    return _RUNS.findall(word)


class WordTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def plainly(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """A run's ids from the tokenizer's model alone: it is in lower case and holds no border."""
        ids = [t.id for t in self.tokenizer.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]
        return array.array("I", ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Makes sure that all of the words are remembered."""
        if len(self.words) + len(words) > MAX_WORDS:
            self.words.clear()
        if len(self.runs) > MAX_RUNS:
            self.runs.clear()
        runs = self.runs
        for w in words:
            if "<|" in w or max(w) >= "ɐ" or "İ" in w:
                self.words[w] = self.plainly(w)
                continue
            parts = []
            for r in _runs(w.lower()):
                ids = runs.get(r)
                if ids is None:
                    ids = runs[r] = self._run(r)
                parts.append(ids)
            self.words[w] = b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        split = [None if _ODD_BLANKS.search(t) else t.split() for t in texts]
        known = self.words
        new = set(itertools.chain.from_iterable(w for w in split if w is not None)).difference(known)
        if len(new) + len(known) > MAX_WORDS:
            known.clear()
            new = set(itertools.chain.from_iterable(w for w in split if w is not None))
        self.learn(new)
        get = known.__getitem__
        return [self.plainly(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]


_HELD: dict[str, WordTokens] = {}
X.CACHES.append(_HELD)


def word_tokens(path: str) -> WordTokens:
    """The worker's own tokenizer for a file; its caches live until the worker turns to other work."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = WordTokens(path)
    return _HELD[path]
