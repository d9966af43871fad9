"""Whole-text encoding with a ``tokenizers`` file, memoised by chunk.

The library spends most of its time splitting and normalising the same words again and again.
A text is cut here at places where its pre-tokenizer cuts anyway, each distinct chunk goes through
the library once per worker, and the chunks' ids are joined.

Cuts, by the pre-tokenizer that the file names:

* byte level with its own pattern: before a single space that precedes a non-space, and around a
  single newline. The pattern starts a new token there whatever stands around it.
* one that drops white space: at spaces and newlines.
* any other: no cut; the library gets whole texts. It also gets any text whole that may hold the
  string of an added token (``<|endoftext|>``, say), which it turns into that token's id.

A chunk that is a plain word (Latin-1 letters) with punctuation behind it is two pre-tokens; the
word goes to the library's model directly, one by one, which skips its normaliser, its splitter and
the places of tokens.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Texts that are encoded together (few, so that their chunks are still in the processor's cache when they are looked up again), and the longest chunk and number of chunks kept.
SLICE, KEEP_CHARS, KEEP_CHUNKS = 32, 48, 500_000
PUNCTUATION = ".,!?;:*$%&#|"

_ODD_SPACE = re.compile(r"\s(?:\s|$)")
_BEFORE_SPACE = re.compile(r"(?= \S)")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _cut_rule(spec: dict) -> str:
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "before_space"
    first = (pre.get("pretokenizers") or [{}])[0]
    if first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed":
        return "drop_space"
    return "whole"


def _before_space(text: str) -> list[str]:
    if "\0" in text or _ODD_SPACE.search(text):
        return _BEFORE_SPACE.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def _drop_space(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Encoder:
    """Turns texts into ids as little-endian unsigned 32-bit bytes. None counts as an empty text."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rule = _cut_rule(spec)
        begins = {t["content"][:2].lower() for t in spec.get("added_tokens", [])}
        self.may_add = re.compile("|".join(map(re.escape, sorted(begins))), re.IGNORECASE).search if begins else lambda text: None
        self.lower = "Lowercase" in str(spec.get("normalizer"))
        self.cut = {"before_space": _before_space, "drop_space": _drop_space, "whole": lambda text: [text]}[self.rule]
        self.letters = byte_letters()
        self.plain = re.compile((" ?" if self.rule == "before_space" else "") + "[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.kept: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for this file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _any_ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _as_letters(self, words: list[str]) -> list[str]:
        """Words in the byte-level alphabet. Those in ASCII differ by their space only and change together."""
        plain = "\n".join([w for w in words if w.isascii()]).replace(" ", "Ġ").split("\n")
        if len(plain) == len(words) and words[0].isascii():
            return plain
        changed = iter(plain)
        return [next(changed) if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids: list[int] = []
        ends, tokenize = [], self.model.tokenize
        for word in self._as_letters("\n".join(words).lower().split("\n") if self.lower else words):
            ids += [t.id for t in tokenize(word)]
            ends.append(4 * len(ids))
        joined = np.array(ids, "<u4").tobytes()
        return [joined[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not kept yet."""
        if self.rule == "whole":
            chunks = list(new)
            return dict(zip(chunks, self._any_ids(chunks)))
        kept, plain = self.kept, self.plain
        bare = list(filter(plain, new))
        parts = [(c, c.rstrip(PUNCTUATION)) for c in new.difference(bare)]
        words = {w for _, w in parts if plain(w)}
        fresh = [*bare, *(w for w in words if w not in new and w not in kept)]
        found = dict(zip(fresh, self._word_ids(fresh)))
        others = list({c[len(w) :] if w in words else c for c, w in parts})
        rest = dict(zip(others, self._any_ids(others)))
        found.update([(c, (found.get(w) or kept[w]) + rest[c[len(w) :]] if w in words else rest[c]) for c, w in parts])
        return found

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        texts = list(texts)
        for at in range(0, len(texts), SLICE):
            run = texts[at : at + SLICE]
            whole = [i for i, t in enumerate(run) if t and self.may_add(t)]
            whole_ids = dict(zip(whole, self._any_ids([run[i] for i in whole])))
            cut = [self.cut(t) if t and i not in whole_ids else [] for i, t in enumerate(run)]
            if len(self.kept) > KEEP_CHUNKS:
                self.kept = {}  # a new one: encodings side by side still read the old one
            known = self.kept
            learnt = self._learn(set(chain.from_iterable(cut)).difference(known))
            long = {c: learnt.pop(c) for c in [c for c in learnt if len(c) > KEEP_CHARS]}
            known.update(learnt)
            for i, chunks in enumerate(cut):
                if i in whole_ids:
                    yield whole_ids[i]
                elif long:
                    yield b"".join([known[c] if c in known else long[c] for c in chunks])
                else:
                    yield b"".join(map(known.__getitem__, chunks))
