"""Token ids of whole texts with a public byte-level BPE file: each distinct pre-token is encoded once per task and looked up after that.

The split into pre-tokens (contractions, letters, numbers, other signs, each with one leading blank, and white space) is
done for many texts at once on arrays of code points. The class of a code point is asked of the tokenizer itself,
so ids are those that the tokenizer gives for the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

from stepframe.llm.words import mix, powers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CHUNK = 1 << 19
MAX_CACHED = 1 << 20
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# A pre-token always begins at a blank between two of these, so a very long text may be cut there.
_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class Encoder:
    """Ids of texts; `encode` gives them one after another with the number for each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._classes = np.full(0x110000, _UNKNOWN, np.uint8)
        vocabulary = self._tokenizer.get_vocab()
        self._blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self._blank[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
        self._line_feed = vocabulary["Ċ"]
        self._clear()

    def _clear(self) -> None:
        self._slots = np.zeros(4 * MAX_CACHED, np.uint64)
        self._places = np.zeros(4 * MAX_CACHED, np.int32)
        self._pool, self._used = np.zeros(1 << 20, np.int32), 0
        self._first, self._length, self._cached = np.zeros(2 * MAX_CACHED, np.int64), np.zeros(2 * MAX_CACHED, np.int64), 0

    def _classify(self, points: np.ndarray) -> np.ndarray:
        kinds = self._classes[points]
        if (kinds == _UNKNOWN).any():
            split = self._tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kinds == _UNKNOWN]).tolist():
                one = [kind for kind, probe in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(split(probe + chr(p))) == 1]
                self._classes[p] = one[0] if one else _SPACE
            kinds = self._classes[points]
        return kinds

    def _starts(self, points: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; edges: where texts begin, and the end."""
        n = len(points)
        text_start = np.zeros(n + 1, bool)
        text_start[edges] = True
        new_run = np.ones(n + 1, bool)
        new_run[1:n] = kinds[1:] != kinds[:-1]
        new_run |= text_start
        space = kinds == _SPACE
        # The blank before a run belongs to it; other white space before a run stands alone, what is before that together.
        last_space = space & new_run[1:] & ~text_start[1:]
        start = new_run[:n] | last_space
        after_blank = np.zeros(n, bool)
        after_blank[1:] = last_space[:-1] & (points[:-1] == 32)
        start &= ~after_blank
        quotes = np.flatnonzero((points == 39) & start & new_run[1:] & ~text_start[1:])
        for p in quotes.tolist():
            end = int(edges[np.searchsorted(edges, p, side="right")])
            if kinds[p + 1] != _LETTER:
                continue
            tail = "".join(map(chr, points[p + 1:min(p + 3, end)].tolist()))
            size = 3 if tail in ("re", "ve", "ll") else 2 if tail[0] in "stmd" else 0
            if size:
                start[p + 1] = False
                if p + size < end:
                    start[p + size] = True
        return np.flatnonzero(start)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the cache, -1 if it has none."""
        mask = np.uint64(len(self._slots) - 1)
        at = (keys & mask).astype(np.int64)
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            seen = self._slots[at]
            hit = seen == keys[rest]
            found[rest[hit]] = self._places[at[hit]]
            go = ~hit & (seen != 0)
            rest, at = rest[go], (at[go] + 1) & (len(self._slots) - 1)
        return found

    def _ids_of(self, spans: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens and how many each has. Words, all with a leading blank or all without, go as one text.

        A word's first id is then the only one that begins with a blank; words without one are set apart by line feeds.
        """
        if not words:
            ids = [x.ids for x in self._tokenizer.encode_batch_fast(spans, add_special_tokens=False)]
            return np.array([y for x in ids for y in x], np.int32), np.array([len(x) for x in ids], np.int64)
        blank = spans[0][0] == " "
        ids = np.array(self._tokenizer.encode("".join(spans) if blank else "\n" + "\n".join(spans), add_special_tokens=False).ids, np.int32)
        first = np.flatnonzero(self._blank[ids] if blank else ids == self._line_feed)
        lengths = np.diff(np.append(first, len(ids)))
        if len(first) != len(spans):
            raise ValueError("the vocabulary isn't byte-level BPE with one id for a line feed")
        return (ids, lengths) if blank else (np.delete(ids, first), lengths - 1)

    def _insert(self, keys: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._used:self._used + len(flat)] = flat
        places = np.arange(self._cached, self._cached + len(keys))
        if len(places) and places[-1] >= len(self._first):
            self._first, self._length = (np.concatenate([x, np.zeros(len(keys) + len(x), np.int64)]) for x in (self._first, self._length))
        self._first[places] = self._used + np.cumsum(lengths) - lengths
        self._length[places] = lengths
        self._used += len(flat)
        self._cached += len(keys)
        if 2 * self._cached > len(self._slots):
            old, kept = self._slots[self._slots != 0], self._places[self._slots != 0]
            self._slots, self._places = np.zeros(4 * len(self._slots), np.uint64), np.zeros(4 * len(self._places), np.int32)
            self._place(old, kept)
        self._place(keys, places.astype(np.int32))

    def _place(self, keys: np.ndarray, places: np.ndarray) -> None:
        at = (keys & np.uint64(len(self._slots) - 1)).astype(np.int64)
        while len(keys):
            free = self._slots[at] == 0
            self._slots[at[free]] = keys[free]
            done = self._slots[at] == keys
            self._places[at[done]] = places[done]
            keys, places, at = keys[~done], places[~done], (at[~done] + 1) & (len(self._slots) - 1)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        edges = np.cumsum([0] + [len(x) for x in texts])
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self._classify(points)
        start = self._starts(points, kinds, edges[:-1] if edges[-1] == 0 else edges)
        end = np.append(start[1:], len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(points)), out=total[1:])
        keys = mix((total[end] - total[start]) * powers(_BASE_INVERSE, len(points))[start])
        keys[keys == 0] = 1
        if self._cached > MAX_CACHED:
            self._clear()
        places = self._find(keys)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            spans = [joined[a:b] for a, b in zip(start[missing[first]].tolist(), end[missing[first]].tolist())]
            letters = kinds[end[missing[first]] - 1] == _LETTER
            blank = points[start[missing[first]]] == 32
            plain = letters & (blank | (kinds[start[missing[first]]] == _LETTER))
            for group in (plain & blank, plain & ~blank, ~plain):
                own = np.flatnonzero(group)
                self._insert(new[own], *self._ids_of([spans[k] for k in own.tolist()], bool(plain[own[0]]) if len(own) else False))
            places[missing] = self._find(keys[missing])
        lengths = self._length[places]
        ends = np.cumsum(lengths)
        ids = self._pool[np.repeat(self._first[places] - (ends - lengths), lengths) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])[np.searchsorted(start, edges)]
        return ids, np.diff(before)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            while len(text) > CHUNK and (cut := _CUT.search(text, CHUNK)):
                parts.append(text[:cut.start()])
                owner.append(i)
                text = text[cut.start():]
            parts.append(text)
            owner.append(i)
        counts, ids, at = np.zeros(len(texts), np.int64), [], 0
        while at < len(parts):
            size, to = 0, at
            while to < len(parts) and (to == at or size + len(parts[to]) <= CHUNK):
                size += len(parts[to])
                to += 1
            got, n = self._encode(parts[at:to])
            ids.append(got)
            np.add.at(counts, owner[at:to], n)
            at = to
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts
