"""Token ids of whole texts by a public tokenizer file, with one tokenizer call per distinct pre-token.

The tokenizer splits a text into letter runs, single digits, contractions and runs of other characters, and encodes
each by itself. Those pieces are found here on arrays of code points, and each distinct piece is encoded once by the
tokenizer. A text with any character outside ``_KNOWN`` (where lower case or class could differ between libraries), not
in composed form, or with a special token's string is given to the tokenizer whole, so ids are its own in every case.
"""

from __future__ import annotations

import json
import os
import sys
import types
import unicodedata

import numpy as np
import pandas as pd

from .words import _BASE, _INVERSE, _powers, mix64

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
#: Distinct pieces a worker process remembers (about 100 MB); beyond it the memory starts anew.
REMEMBERED = 1_500_000


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(0x10000, _ODD, dtype=np.uint8)
    lower = np.arange(0x10000, dtype=np.uint32)
    for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        ch = chr(c)
        cat = unicodedata.category(ch)
        low = ch.lower()
        if ch.isspace():
            kind[c] = _SPACE
        elif len(low) == 1 and ord(low) < 0x10000 and cat[0] != "C" and unicodedata.normalize("NFC", ch) == ch:
            kind[c] = _LETTER if cat[0] == "L" else _DIGIT if cat[0] == "N" else _OTHER
            lower[c] = ord(low)
    return kind, lower


class TokenCounter:
    """Ids of texts; keeps the pieces it has met, in one task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for pieces that are split and in lower case already
        with open(path) as f:
            plain = json.load(f)
        plain |= {"normalizer": None, "added_tokens": [], "post_processor": None}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.kind, self.lower = _classes()
        self.value = mix64(self.lower.astype(np.uint64) + np.uint64(0x51ED270B))
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _plain(self, pieces):
        return [e.ids for e in self.plain.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, hashes, pieces):
        """Encode new pieces in one call: joined by spaces, each ends with an end-of-word token."""
        got = np.array(self._plain([" ".join(pieces)])[0], dtype=np.uint32)
        last = np.flatnonzero(self.ends[got])
        if len(last) != len(pieces):  # a piece the joined call splits otherwise: encode each by itself
            each = self._plain(pieces)
            got = np.array([i for e in each for i in e], dtype=np.uint32)
            last = np.cumsum([len(e) for e in each]) - 1
        first = np.concatenate([[0], last[:-1] + 1]) + len(self.ids)
        size = last + 1 + len(self.ids) - first
        self.ids = np.concatenate([self.ids, got])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first, self.size = np.insert(self.first, at, first), np.insert(self.size, at, size)

    def _fast(self, code: np.ndarray, at: np.ndarray):
        """(ids, bounds) for code points of texts that need no special care."""
        kind = self.kind[code]
        low = self.lower[code]
        cut = np.zeros(len(code) + 1, dtype=bool)
        cut[at] = True
        change = np.empty(len(code), dtype=bool)
        change[:1] = True
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        change |= cut[:-1]
        # contractions: an apostrophe that begins a run, then s t m d or re ve ll, in the same text
        for p in np.flatnonzero((low == 39) & change).tolist():
            tail = low[p + 1:p + 3].tobytes().decode("utf-32-le")
            size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
            if size and not cut[p + 1:p + 1 + size].any():
                change[p + 1] = False
                if size == 2:
                    change[p + 2] = False
                if p + 1 + size < len(code):
                    change[p + 1 + size] = True
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(code))
        real = kind[starts] != _SPACE
        starts, ends = starts[real], ends[real]
        h = _code_hashes(self.value[code], starts, ends)
        which, distinct = pd.factorize(h)
        order = np.argsort(distinct)
        distinct = distinct[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[which]
        where = np.empty(len(order), np.int64)
        where[which] = np.arange(len(which))
        new = np.ones(len(distinct), dtype=bool)
        if len(self.hashes):
            spot = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            new = self.hashes[spot] != distinct
        if new.any():
            if len(self.hashes) + new.sum() > REMEMBERED:
                self._forget()
                new[:] = True
            text = low.tobytes()
            pieces = [text[4 * a:4 * b].decode("utf-32-le") for a, b in
                      zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            self._learn(distinct[new], pieces)
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        spot = np.searchsorted(self.hashes, distinct)[which]
        first, size = self.first[spot], self.size[spot]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, at)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        fast, codes = [], []
        for i, text in enumerate(texts):
            code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            odd = len(code) and (code.max() >= 0x10000 or (self.kind[code] == _ODD).any())
            if odd or any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                fast.append(i)
                codes.append(code)
        if fast:
            at = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
            ids, bounds = self._fast(np.concatenate(codes), at)
            for k, i in enumerate(fast):
                out[i] = ids[bounds[k]:bounds[k + 1]]
        return out


def counter(path: str) -> TokenCounter:
    """The worker process's counter: what it remembers serves all its tasks."""
    kept = sys.modules.setdefault("_sheaf_token_counters", types.ModuleType("_sheaf_token_counters")).__dict__
    if path not in kept:
        kept[path] = TokenCounter(path)
    return kept[path]


def _code_hashes(value, starts, ends):
    n = len(value)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value * _powers(_BASE, n)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix64(h + (ends - starts).astype(np.uint64))
