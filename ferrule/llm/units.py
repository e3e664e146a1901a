"""Encoding of whole texts by the units of a tokenizer, each encoded once a worker.

Some tokenizers drop white space and cut a text into runs of letters, single digits and
runs of marks before anything else; their ids of a text are the ids of these units side
by side. Units are found on the bytes of many texts at once, named by a 128-bit hash,
and looked up in a bounded table; only new ones go through the tokenizer. A
white-space separated piece with anything unusual in it (an apostrophe before a letter,
control characters, letters beyond Cyrillic, marks beyond ASCII) is one unit. A
tokenizer that cuts in another way encodes whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import bytewise as bw

#: Units a worker remembers before it starts anew: about 60 bytes each.
KNOWN_UNITS = 1_500_000
#: Units that one string holds on its way through the tokenizer.
JOINED = 500
#: Letters below this code point have been letters, and nothing that composes, since Unicode 7.
STABLE = "԰"
# The cut of the tokenizers whose units stand alone.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[:32] = _CLASS[127] = _ODD
_CLASS[np.flatnonzero(bw.SPACE)] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Clash(Exception):
    """Two units share a 64-bit hash and differ in the other."""


class Encoder:
    def __init__(self, path: str, known: int = KNOWN_UNITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.specials = [x["content"].encode() for x in added]
        alone = spec.get("normalizer") == NORMALIZER and before[0].get("pattern") == {"Regex": CUT} and [x.get("type") for x in before] == ["Split", "ByteLevel"] and not before[1].get("add_prefix_space")
        self.by_units = alone and spec["model"].get("end_of_word_suffix") == WORD_END and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in added)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(WORD_END)]] = True
        self.limit = known
        self._forget()

    def _forget(self) -> None:
        self.names = np.zeros((2, 0), np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a byte buffer, equal to the tokenizer's own."""
        n = len(offsets) - 1
        body = raw.tobytes()
        of = lambda i: body[int(offsets[i]) : int(offsets[i + 1])]
        if not self.by_units:
            return [self.whole(of(i).decode("utf-8", "replace")) for i in range(n)]
        try:
            ids, count = self._units(raw, offsets)
        except Clash:
            self._forget()
            return [self.whole(of(i).decode("utf-8", "replace")) for i in range(n)]
        out = np.split(ids, np.cumsum(count)[:-1]) if n else []
        if any(x in body for x in self.specials):
            for i in range(n):
                if any(x in of(i) for x in self.specials):
                    out[i] = self.whole(of(i).decode("utf-8", "replace"))
        return out

    def _units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        lower, kind = _LOWER[raw], _CLASS[raw]
        edge = np.zeros(len(raw) + 1, bool)  # a text begins
        edge[offsets] = True
        edge = edge[:-1]
        cut = edge | (kind == _DIGIT)
        cut[1:] |= kind[1:] != kind[:-1]
        cuts = np.flatnonzero(cut)
        stop = np.concatenate((cuts[1:], [len(raw)]))
        ink = kind[cuts] != _SPACE
        start, stop = cuts[ink], stop[ink]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        first = edge[start] | (kind[start - 1] == _SPACE)
        first[0] = True
        piece = np.cumsum(first) - 1
        odd = kind == _ODD
        quote = np.flatnonzero((raw[:-1] == 0x27) & (kind[1:] == _LETTER) & ~edge[1:])
        odd = np.concatenate((np.flatnonzero(odd), quote))
        strange = np.zeros(piece[-1] + 1, bool)
        strange[piece[np.searchsorted(start, odd, "right") - 1]] = True

        entry = np.full(len(start), -1, np.int64)
        plain = np.flatnonzero(~strange[piece])
        names = self._names(lower, start[plain], stop[plain])
        room = len(names[0]) + len(start)
        if len(self.size) + room > 2 * self.limit or len(self.size) > self.limit:
            self._forget()
        found = self._find(names, lower, start[plain], stop[plain], alone=True)
        lone = self.size[found] >= 0
        strange[piece[plain[~lone]]] = True
        entry[plain] = found
        # strange pieces: the first unit stands for the piece, the others for nothing
        units = np.flatnonzero(strange[piece])
        if len(units):
            entry[units] = -1
            lead = units[first[units]]
            last = np.concatenate((np.flatnonzero(first)[1:], [len(start)]))[piece[lead]] - 1
            lo, hi = start[lead], stop[last]
            mine = self._names(raw, lo, hi)
            mine ^= np.uint64(0x5BD1E9955BD1E995)  # not the name of the same bytes as a unit
            # the table moves when it learns: look the plain units up again afterwards
            self._find(mine, raw, lo, hi, alone=False)
            rest = np.flatnonzero(~strange[piece])
            entry[rest] = self._find(self._names(lower, start[rest], stop[rest]), lower, start[rest], stop[rest], alone=True)
            entry[lead] = self._find(mine, raw, lo, hi, alone=False)
        some = entry >= 0
        begin, size = self.start[entry[some]], self.size[entry[some]].astype(np.int64)
        text = np.searchsorted(offsets, start[some], "right") - 1
        return self.ids[bw.runs(begin, size)], np.bincount(text, size, n).astype(np.int64)

    @staticmethod
    def _names(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return np.stack([bw.span_hash(data, start, stop), bw.span_hash(data, start, stop, 1)]) if len(start) else np.zeros((2, 0), np.uint64)

    def _find(self, names: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray, alone: bool) -> np.ndarray:
        """Entries of spans of data, new ones learnt; an entry of size -1 is no unit of its own."""
        a, back = np.unique(names[0], return_inverse=True)
        where = np.empty(len(a), np.int64)
        where[back] = np.arange(len(back))  # one span of each name
        if (names[0][where][back] != names[0]).any() or (names[1][where][back] != names[1]).any():
            raise Clash
        at = np.searchsorted(self.names[0], a)
        have = np.zeros(len(a), bool)
        inside = at < len(self.size)
        have[inside] = self.names[0][at[inside]] == a[inside]
        same = have.copy()
        same[have] = self.names[1][at[have]] == names[1][where[have]]
        if (have & ~same).any():
            raise Clash
        new = np.flatnonzero(~have)
        if len(new):
            sizes, ids = self._learn(data, start[where[new]], stop[where[new]], alone)
            begin = self.used + np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.names = np.stack([np.insert(self.names[0], at[new], a[new]), np.insert(self.names[1], at[new], names[1][where[new]])])
            self.start = np.insert(self.start, at[new], begin)
            self.size = np.insert(self.size, at[new], sizes.astype(np.int32))
            at = np.searchsorted(self.names[0], a)
        return at[back]

    def _learn(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """(size of each, ids of all) of new spans of data; alone: spans that are no units get size -1."""
        body = data.tobytes()
        spans = [body[s:e] for s, e in zip(start.tolist(), stop.tolist())]
        sizes = np.zeros(len(spans), np.int64)
        if not alone:
            every = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in spans], add_special_tokens=False)]
            sizes[:] = [len(x) for x in every]
            return sizes, np.array([i for x in every for i in x], np.uint32)
        good = [i for i, x in enumerate(spans) if x.isascii() or _simple(x)]
        sizes[:] = -1
        texts = [b" ".join([spans[i] for i in good[k : k + JOINED]]).decode("utf-8") for k in range(0, len(good), JOINED)]
        out = []
        for k, got in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            part = good[k * JOINED : (k + 1) * JOINED]
            ids = np.array(got.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and (not len(ids) or last[-1] == len(ids) - 1):
                sizes[part] = np.diff(np.concatenate(([-1], last)))
                out.append(ids)
                continue
            for i in part:
                ids = self.whole(spans[i].decode("utf-8"))
                sizes[i] = len(ids)
                out.append(ids)
        return sizes, np.concatenate(out) if out else np.zeros(0, np.uint32)


def _simple(span: bytes) -> bool:
    text = span.decode("utf-8", "replace")
    return text.isalpha() and max(text) < STABLE
