"""Ids of whole texts by a ``tokenizers`` file, with the ids of their parts kept between texts.

The byte-level pre-tokenizer always cuts at a single space, and around a single
newline, that stands between two other characters. So texts are cut there, each
distinct part goes through the tokenizer once, and its ids are reused. A text
with white space in another place is encoded by one plain call.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_NEWLINE = "\n"
# A part that may be encoded alone: no white space at its ends (that of Unicode), but for a newline put in front.
_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ALONE = f"^\n?[^{_SPACE}]((?s:.*)[^{_SPACE}])?$"

# New parts that one call of the tokenizer takes: it needs some 100 bytes for each byte of text.
LEARN_PARTS = 10_000


class _Numbers:
    """Numbers of keys (64-bit hashes): a large sorted table and a small one for the newest."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        order = np.argsort(keys)
        self.tables = [(keys[order], order.astype(np.int32)), (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32))]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each of some ascending keys, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, number in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = number[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Gives new ascending keys the next numbers."""
        new = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        self.tables[1] = _merged(self.tables[1], (keys, new))
        if len(self.tables[1][0]) > 200_000:
            self.tables = [_merged(*self.tables), (keys[:0], new[:0])]
        return new.astype(np.int64)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


class TextEncoder:
    """Encodes batches of texts; of ``max_parts`` parts it keeps those that come most.

    A part is known by the 64-bit hash of its text, and takes about 40 bytes.
    """

    def __init__(self, path: str, max_parts: int = 1_000_000, step_bytes: int = 2 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._max, self._step = max_parts, step_bytes
        # Bytes that each token stands for: a token of this vocabulary has a character for each byte.
        added = {i: t.content for i, t in self._tok.get_added_tokens_decoder().items()}
        vocab = self._tok.get_vocab()
        self._bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self._bytes[i] = len(added[i].encode()) if i in added else len(token)
        self._numbers = _Numbers(np.empty(0, dtype=np.uint64))
        self._flat, self._used = np.empty(0, dtype=np.uint16 if len(self._bytes) <= 1 << 16 else np.uint32), 0
        self._key, self._at, self._len, self._hits = (np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int32, np.int32))

    def plain(self, text: str) -> np.ndarray:
        enc = self._tok.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.asarray(enc.ids, dtype=np.uint32)

    def _thin(self) -> None:
        """Keeps the parts that most steps had since the last time, less than half of all."""
        hits = self._hits[:self._numbers.n]
        stay = np.flatnonzero(hits > max(1, np.median(hits) if len(hits) else 1))
        lens = np.maximum(self._len[stay], 0)
        ends = np.cumsum(lens, dtype=np.int64)
        self._flat, self._used = self._flat[_ranges(self._at[stay], lens, ends)], int(lens.sum())
        self._key, self._at, self._len, self._hits = self._key[stay], ends - lens, self._len[stay], np.zeros(len(stay), dtype=np.int32)
        self._numbers = _Numbers(self._key)

    def _learn(self, keys: np.ndarray, new: pa.Array) -> np.ndarray:
        """Encodes new parts by few calls and returns their numbers; length -1 marks one that can't be encoded alone.

        A part without a newline in front has a space there.
        """
        numbers = self._numbers.add(keys)
        n = self._numbers.n
        self._key, self._at, self._len, self._hits = (_room(a, n) for a in (self._key, self._at, self._len, self._hits))
        self._key[numbers], self._hits[numbers], self._len[numbers] = keys, 0, -1
        alone = pc.match_substring_regex(new, _ALONE)
        good = numbers[alone.to_numpy(zero_copy_only=False)]
        if not len(good):
            return numbers
        new = new.filter(alone)
        texts = pc.if_else(pc.starts_with(new, _NEWLINE), new, pc.binary_join_element_wise("", new, " "))
        bounds = [*range(0, len(texts), LEARN_PARTS), len(texts)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts), "")
        ids = np.concatenate([self.plain(some.as_py()) for some in joined])
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        last = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(sizes), side="left") + 1
        first = np.concatenate([[0], last[:-1]])
        self._flat = _room(self._flat, self._used + len(ids))
        self._flat[self._used:self._used + len(ids)] = ids
        self._at[good], self._len[good] = self._used + first, last - first
        self._used += len(ids)
        return numbers

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); a null text is an empty one."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + self._step, side="right")))
            if ends[stop - 1] - done > 2 * self._step:  # one long text
                pieces, spaced = self._pieces(texts[start].as_py())
                for k, piece in enumerate(pieces):
                    ids, n = self._some(pa.array([piece]), spaced and k > 0)
                    out += ids
                    counts[start] += int(n[0])
            else:
                ids, n = self._some(texts.slice(start, stop - start), False)
                out += ids
                counts[start:stop] = n
            start = stop
        return (np.concatenate(out) if out else np.empty(0, dtype=np.uint32)), counts

    def _pieces(self, text: str) -> tuple[list[str], bool]:
        """A long text cut at spaces where the pre-tokenizer cuts too (the space goes with what follows)."""
        pieces, start = [], 0
        while len(text) - start > self._step:
            cut = _SAFE_CUT.search(text, start + self._step // 2)
            if cut is None:
                break
            pieces.append(text[start:cut.start()])
            start = cut.end()
        return [*pieces, text[start:]], True

    def _some(self, texts: pa.Array, spaced: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """``encode`` of a step of texts; ``spaced``: a space that was cut off stands before each."""
        if spaced:
            parts = pc.split_pattern(pc.replace_substring(texts, _NEWLINE, " \n"), " ")
        else:
            parts = pc.split_pattern(pc.binary_join_element_wise(_NEWLINE, pc.replace_substring(texts, _NEWLINE, " \n"), ""), " ")
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary
        if self._numbers.n + len(names) > self._max:
            self._thin()
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, names.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(names))
        order = np.argsort(keys)
        number = self._numbers.get(keys[order])
        missed = np.flatnonzero(number < 0)
        if len(missed):
            number[missed] = self._learn(keys[order[missed]], names.take(pa.array(order[missed])))
        self._hits[number] += 1
        at = np.empty(len(names), dtype=np.int64)
        at[order] = number
        at = at[coded.indices.to_numpy()]
        start, lens = self._at[at], self._len[at].astype(np.int64)
        bounds = parts.offsets.to_numpy().astype(np.int64)
        begins, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        odd = np.minimum.reduceat(lens, begins) < 0
        if not spaced:  # the newline put in front isn't in the text
            start[begins] += 1
            lens[begins] -= 1
        for j in np.flatnonzero(odd):
            lens[begins[j]:ends[j]] = 0
        upto = np.concatenate([[0], np.cumsum(lens)])
        flat = self._flat[_ranges(start, lens, upto[1:])].astype(np.uint32)
        counts = upto[ends] - upto[begins]
        if not odd.any():
            return [flat], counts
        out, pos = [], 0
        for j, text in enumerate(texts):
            if odd[j]:
                ids = self.plain(" " + text.as_py() if spaced else text.as_py())
                counts[j] = len(ids)
                out.append(ids)
            else:
                out.append(flat[pos:pos + counts[j]])
                pos += int(counts[j])
        return out, counts


def _ranges(start: np.ndarray, lens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, in a row; ``ends`` are the sums of the lengths."""
    return np.repeat(start - ends + lens, lens) + np.arange(int(ends[-1]) if len(ends) else 0)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder in each Python worker."""
    return TextEncoder(path)
