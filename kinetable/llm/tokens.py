"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once per worker.

The tokenizer composes, lower-cases and splits inside runs of non-space characters only, and always splits between an ASCII
letter and an ASCII mark other than the apostrophe.  So the ids of a text are the ids of its words cut at white space and
at those places, in order.  Words are found, looked up and expanded to ids as arrays.
"""

from __future__ import annotations

import ctypes
import gc
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .hashing import Words, utf8

JOIN = 100


class WordEncoder:
    """Ids as unsigned 32-bit arrays.  ``bound`` limits the remembered words; a full memory starts afresh."""

    def __init__(self, path: str, bound: int = 600_000, ordinary: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.ordinary = ordinary
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bound = bound
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0
        self.at, self.size = np.empty(1 << 14, "i8"), np.empty(1 << 14, "i8")

    def _store(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(self.row), len(ids)
        while n + len(keys) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = ids
        self.size[n : n + len(keys)] = sizes
        self.at[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.row.update(zip(keys, range(n, n + len(keys))))

    def _learn(self, keys: list[int], words: list[str]) -> None:
        """Encode and remember.  Words of letters only are one piece by rule; joined, they encode faster."""
        odd = [i for i, w in enumerate(words) if not w.isalpha()]
        whole = [i for i, w in enumerate(words) if w.isalpha()]
        if whole:
            chunks = [" ".join([words[i] for i in whole[k : k + JOIN]]) for k in range(0, len(whole), JOIN)]
            codes = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
            ids = np.concatenate([np.array(code.ids, "<u4") for code in codes])
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) == len(whole):
                self._store([keys[i] for i in whole], ids, np.diff(stops, prepend=0))
            else:
                odd += whole
        if odd:
            codes = [code.ids for code in self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)]
            self._store([keys[i] for i in odd], np.array([i for c in codes for i in c], "<u4"), np.fromiter(map(len, codes), "i8", len(codes)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the bounds of each text in it."""
        named = [] if self.ordinary else [i for i, t in enumerate(texts) if isinstance(t, str) and any(s in t for s in self.special)]
        if not named:
            return self._encode(texts)
        ids, bounds = self._encode(["" if i in set(named) else t for i, t in enumerate(texts)])
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in named:  # a special token's own string is one token
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(utf8(texts), lower=True, marks=True)
        keys, where, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.row) > self.bound:
            self.forget()
        key_list = keys.tolist()
        fresh = [i for i, k in enumerate(key_list) if k not in self.row]
        if fresh:
            data = words.data.tobytes()
            a, b = words.start[where[fresh]].tolist(), words.end[where[fresh]].tolist()
            self._learn([key_list[i] for i in fresh], [data[i:j].decode() for i, j in zip(a, b)])
        rows = np.fromiter(map(self.row.__getitem__, key_list), "i8", len(key_list))[back]
        sizes = self.size[rows]
        stops = np.cumsum(sizes)
        place = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.at[rows] - (stops - sizes), sizes)
        return self.flat[place], np.concatenate(([0], stops))[words.first]


def slices(texts: list[str | None], most: int = 1 << 21):
    """Index ranges of texts with about ``most`` characters each; a longer text is alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if isinstance(t, str) else 0
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size + 1
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers outlive their tasks, and the next stage runs beside what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


@lru_cache(maxsize=4)
def encoder(path: str, ordinary: bool = False) -> WordEncoder:
    return WordEncoder(path, ordinary=ordinary)
