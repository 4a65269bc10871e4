"""Token ids of whole texts with a public tokenizer file; equal chunks are encoded once.

Whatever stands around, the byte-level BPE splits a text before a blank that follows a character
other than white space, between a letter or digit and ASCII punctuation or a line break after it, and
before and after a line break that a letter or digit follows (white space before that break is a word
of its own, without it). Texts are cut there (only where the characters are sure to be of these kinds;
cutting less never changes the ids), equal chunks of a slice are found by Arrow, and only chunks
that are not in a cache of bounded size reach the tokenizer.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import text_bytes

END_ID = 0
# Of a worker's cache: a chunk counts its text, its ids and what its entry takes.
CACHE_BYTES = 112 << 20
ENTRY_BYTES = 200
# Of text encoded together: repeats within it are found before the cache is asked.
SLICE_BYTES = 3 << 20
# Chunks that go to the tokenizer at once: what it returns holds some hundred bytes a token besides the ids.
LEARNT_CHUNKS = 1 << 14

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[9:14] = True
_MARK = _BREAK.copy()
_MARK[33:127] = True
_MARK &= ~_WORD


def _cuts(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Starts of chunks: wherever a split is certain, and at every text that is not empty.

    ``whole``: numbers of texts that stay uncut.
    """
    before, here = data[:-1], data[1:]
    # Of two bytes after 0xC3 all are letters but 0x97 and 0xB7, and none is white space.
    latin = np.zeros(len(before), bool)
    latin[1:] = (before[1:] >= 128) & (before[:-1] == 0xC3)
    word = _WORD[before] | (latin & (before != 0x97) & (before != 0xB7))
    visible = ((before > 32) & (before < 128)) | latin
    cut = np.zeros(len(data) + 1, bool)
    last = _BREAK[before] & _WORD[here]  # the last of a run of white space
    last[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False  # a run at a text's end stays whole
    cut[1:-1] = ((here == 32) & visible) | (word & _MARK[here]) | last
    cut[:-2] |= last
    for i in whole.tolist():
        cut[bounds[i] : bounds[i + 1]] = False
    cut[bounds] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    def _learn(self, chunks: list[str]) -> None:
        # One call for all: chunks go in as words of one text, which are never merged.
        encoded = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        sizes = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(chunks))
        n, total = len(self.known), len(ids)
        while len(self.first) < n + len(chunks):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.first[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.count[n : n + len(chunks)] = sizes
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.held += sum(map(len, chunks)) + 4 * total + ENTRY_BYTES * len(chunks)
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        data, bounds = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # A special token's name in a text is found before anything is split.
        named = np.zeros(len(texts), bool)
        for name in self.names:
            named |= pc.fill_null(pc.match_substring(texts, name), False).to_numpy(zero_copy_only=False)
        starts = _cuts(data, bounds, np.flatnonzero(named))
        offsets = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > CACHE_BYTES:
            self._clear()
        # One look-up a chunk; those not found get the numbers that follow, in their order.
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        number[new] = len(self.known) + np.arange(len(new))
        for i in range(0, len(new), LEARNT_CHUNKS):
            self._learn([words[at] for at in new[i : i + LEARNT_CHUNKS].tolist()])
        place = number[coded.indices.to_numpy()]
        counts = self.count[place]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[place] - (ends - counts), counts)
        at += np.arange(len(at))
        ids = self.ids[at]
        totals = np.concatenate(([0], ends))[np.searchsorted(starts, bounds)]
        return ids, np.diff(totals)
