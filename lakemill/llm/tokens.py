"""Token ids of whole texts, vectorised over a batch, with a bounded table per worker.

A unit is a run of ASCII white space with the word after it. A byte-level
pre-tokeniser never joins a word to the white space behind it, so a text's ids
are those of its units, one after another. (The exception is a word ending in
a white-space character beyond ASCII; such texts are one unit.) Units are found
by hash in a table of known ids; only unknown ones are encoded.

The vocabulary is given as ranks. They are the same vocabulary as the JSON file
of the `tokenizers` library; tests hold the ids of both against each other.
"""

from __future__ import annotations

import base64

import numpy as np

from .wordhash import Words

#: When a worker's table holds so many units or ids, it starts anew.
TABLE_UNITS, TABLE_IDS = 1 << 21, 1 << 24
_SLOTS = 1 << 22


class Encoder:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._encode = encoding._core_bpe.encode_ordinary
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)
        self._clear()

    def _clear(self) -> None:
        self._slot_key = np.zeros(_SLOTS, np.uint64)
        self._slot_unit = np.full(_SLOTS, -1, np.int32)
        self._ids = np.empty(1 << 16, np.uint32)
        self._start = np.zeros(1 << 12, np.int64)
        self._units = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Unit numbers of the keys, -1 where unknown."""
        out = np.full(len(keys), -1, np.int32)
        open_, slot = np.arange(len(keys)), (keys >> np.uint64(42)).astype(np.int64)
        while len(open_):
            unit = self._slot_unit[slot]
            same = (unit >= 0) & (self._slot_key[slot] == keys[open_])
            out[open_[same]] = unit[same]
            more = (unit >= 0) & ~same
            open_, slot = open_[more], (slot[more] + 1) & (_SLOTS - 1)
        return out

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = len(keys), int(self._start[self._units])
        while len(self._start) < self._units + n + 1:
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
        while len(self._ids) < used + len(ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        self._ids[used : used + len(ids)] = ids
        self._start[self._units + 1 : self._units + n + 1] = used + np.cumsum(lengths)
        number = np.arange(self._units, self._units + n, dtype=np.int32)
        self._units += n
        open_, slot = np.arange(n), (keys >> np.uint64(42)).astype(np.int64)
        while len(open_):
            free = self._slot_unit[slot] < 0
            self._slot_unit[slot[free]] = number[open_[free]]
            self._slot_key[slot[free]] = keys[open_[free]]
            lost = self._slot_unit[slot] != number[open_]
            open_, slot = open_[lost], (slot[lost] + 1) & (_SLOTS - 1)

    def _learn(self, raw: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> None:
        """Encodes unknown units: those that may stand in one text at once, the others one by one."""
        view = memoryview(raw.tobytes() if not raw.flags.c_contiguous else raw)
        many = np.flatnonzero(~alone)
        for i in range(0, len(many), 20_000):
            some = many[i : i + 20_000]
            text = b"".join([view[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]).decode()
            ids = np.array(self._encode(text), np.uint32)
            stop = np.cumsum(self._bytes[ids])
            upto = np.searchsorted(stop, np.cumsum(end[some] - start[some]), "left") + 1
            self._add(keys[some], ids, np.diff(upto, prepend=0))
        for k in np.flatnonzero(alone).tolist():
            ids = np.array(self._encode(bytes(view[start[k] : end[k]]).decode()), np.uint32)
            self._add(keys[k : k + 1], ids, np.array([len(ids)]))

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n+1 offsets of the texts in them."""
        if self._units > TABLE_UNITS or self._start[self._units] > TABLE_IDS:
            self._clear()
        words = Words(raw, offsets)
        n = len(offsets) - 1
        first, last = words.first[:-1], words.first[1:]
        start = np.empty(len(words.end), np.int64)
        start[1:] = words.end[:-1]
        has = first < last
        start[first[has]] = offsets[:-1][has]
        end = words.end
        odd = self._odd_end(raw, start, end)
        doc = np.repeat(np.arange(n), last - first)
        whole = np.zeros(n, bool)
        whole[doc[odd]] = True
        # white space behind the last word, or a text of white space only, or an odd text: a unit of its own
        tail_start = np.where(has, words.end[np.maximum(last - 1, 0)] if len(words.end) else 0, offsets[:-1])
        tail_start = np.where(whole, offsets[:-1], tail_start)
        tail = tail_start < offsets[1:]
        keep = ~whole[doc]
        u_doc = np.concatenate([doc[keep], np.flatnonzero(tail)])
        u_start = np.concatenate([start[keep], tail_start[tail]])
        u_end = np.concatenate([end[keep], offsets[1:][tail]])
        order = np.lexsort((u_start, u_doc)) if tail.any() else slice(None)
        u_doc, u_start, u_end = u_doc[order], u_start[order], u_end[order]
        if not len(u_doc):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        keys = words.spans(u_start, u_end)
        unit = self._find(keys)
        new = np.flatnonzero(unit < 0)
        if len(new):
            _, pick = np.unique(keys[new], return_index=True)
            pick = new[pick]
            lead, close = raw[u_start[pick]], raw[u_end[pick] - 1]
            space = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
            alone = ~space(lead) | space(close) | (close >= 128) & whole[u_doc[pick]]
            self._learn(raw, keys[pick], u_start[pick], u_end[pick], alone)
            unit[new] = self._find(keys[new])
        begin = self._start[unit]
        length = self._start[unit + 1] - begin
        upto = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])
        per_doc = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(u_doc, weights=length, minlength=n).astype(np.int64), out=per_doc[1:])
        return self._ids[at], per_doc

    @staticmethod
    def _odd_end(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Units ending in white space beyond ASCII (U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000)."""
        at = np.flatnonzero(raw[end - 1] >= 128) if len(end) else np.empty(0, np.int64)
        c = raw[end[at] - 1]
        b = raw[end[at] - 2]
        a = raw[np.maximum(end[at] - 3, 0)]
        odd = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        return at[odd]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The one encoder of this process for that vocabulary."""
    if (ranks_path, pattern) not in _encoders:
        _encoders[ranks_path, pattern] = Encoder(ranks_path, pattern)
    return _encoders[ranks_path, pattern]
