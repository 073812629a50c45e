"""Texts cut where no tokenizer merge can cross, and a bounded memory of what each cut gives.

A byte-level or word-end pre-tokenizer never lets a token span the change from
a visible character to white space, nor from a letter to what is none, so white
space plus the word behind it is encoded alike wherever it stands. Texts repeat such units often; each is
encoded once for as long as the memory holds it.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .common import UNICODE_SPACE

_S = UNICODE_SPACE
_LETTERS, _AFTER = "a-zß-öø-ÿ", r"(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|\Z)"
#: Byte-level: white space and letters before ASCII that is no letter, one line break before a visible character, or white space and what is visible behind it.
BYTE_UNIT = re.compile(f"[{_S}]*[A-ZÀ-ÖØ-Þ{_LETTERS}]+{_AFTER}|\n(?=[^{_S}])|[{_S}]*[^{_S}]+|[{_S}]+")
#: With word ends: lower-case letters before ASCII that is no letter, or what is visible; white space gives no token.
WORD_UNIT = re.compile(f"[{_LETTERS}]+{_AFTER}|[^{_S}]+")


class IdMemory:
    """Ids of units, held in one flat array; emptied when `limit` units are in it."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self):
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.lens, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, units: list[str]) -> None:
        flat, lens = self.encode(units)
        n, to = len(self.place), self.used + len(flat)
        while to > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(units) > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.flat[self.used : to] = flat
        self.lens[n : n + len(units)] = lens
        self.starts[n : n + len(units)] = self.used + lens.cumsum() - lens
        self.used = to
        self.place.update(zip(units, range(n, n + len(units)), strict=True))

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has."""
        distinct = set(units)
        new = distinct.difference(self.place)
        if new and len(new) + len(self.place) > self.limit:
            self._empty()
            new = distinct
        if new:
            self._add(list(new))
        at = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        lens = self.lens[at]
        ends = lens.cumsum()
        return self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)], lens


class Encoder:
    """Ids by the tokenizers library; plain words are encoded in one string, cut again where a token begins or ends a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.word_ends = bool(model["end_of_word_suffix"])
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word, or begin one behind a space
        for token, i in model["vocab"].items():
            self.edge[i] = token.endswith(model["end_of_word_suffix"]) if self.word_ends else token.startswith("Ġ")

    def units(self, text: str) -> list[str]:
        if not self.word_ends:
            return BYTE_UNIT.findall(text)
        # its normalizer lowers each character for itself; only these two are lowered otherwise by Python
        return WORD_UNIT.findall(text if "Σ" in text or "İ" in text else text.lower())

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorts `units` in place, plain words first, and gives their ids."""
        plain = [u for u in units if (u.isalpha() if self.word_ends else u[0] == " " and u[1:].isalpha())]
        known = set(plain)
        rest = [u for u in units if u not in known]
        units[:] = plain + rest
        if plain:
            flat = np.array(self.tokenizer.encode_batch_fast([(" " if self.word_ends else "").join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.edge[flat])
            lens = np.diff(np.r_[-1, at] if self.word_ends else np.r_[at, len(flat)])
            if len(lens) != len(plain) or lens.sum() != len(flat):
                flat, lens = self._each(plain)
        else:
            flat, lens = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if rest:
            more, each = self._each(rest)
            flat, lens = np.concatenate([flat, more]), np.concatenate([lens, each])
        return flat, lens


_memories: dict[str, IdMemory] = {}


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, and the number of ids of each text."""
    if path not in _memories:
        _memories[path] = IdMemory(Encoder(path))
    memory = _memories[path]  # this worker's own
    units = [memory.encode.units(x) for x in texts]
    counts = np.fromiter(map(len, units), np.int64, len(units))
    flat, lens = memory.ids(list(chain.from_iterable(units)))
    ends = np.concatenate([[0], lens.cumsum()])[np.concatenate([[0], counts.cumsum()])]
    return flat, np.diff(ends)
