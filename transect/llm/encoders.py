"""The tokenizers library over units of text that it would split anyway, each distinct unit encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

_CACHED_UNITS, _LONG_UNIT, _GROUP_CHARS = 600_000, 200, 1 << 15
_MARKS = ".,;:!?#$%&*)]\""
_loaded: dict[tuple, UnitEncoder] = {}


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit numbers of whole texts, equal to the library's own encoding of them."""

    #: Characters that some engines take for white space.
    _invisible = re.compile("[\u180e\u200b\ufeff]")

    def __init__(self, path: str, byte_level: bool):
        self.tokenizer, self.byte_level = load(path), byte_level
        # a special token between units keeps them apart within one call
        marks = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = marks[0] if marks else None
        size = self.tokenizer.get_vocab_size()
        #: of a byte-level vocabulary: whether an id's piece begins with a space
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)]) if byte_level else None
        self.tails: dict[str, bytes] = {}
        self.steady: dict[str, bool] = {}
        self.first: dict[str, bytes] = {}  # units as they are
        self.later: dict[str, bytes] = {"": b""}  # units after one space, which a byte-level vocabulary has in its pieces
        self.line_end = self.whole(["\n"])[0]

    @classmethod
    def of(cls, path: str, byte_level: bool) -> UnitEncoder:
        if (path, byte_level) not in _loaded:
            _loaded[path, byte_level] = cls(path, byte_level)
        return _loaded[path, byte_level]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, units: list[str], prefix: str) -> list[bytes]:
        """As whole, for many short texts with a prefix, in one call."""
        if not units:
            return []
        if prefix == " " and self.opens is not None and "" not in units:
            # no unit has a space, or other white space at its ends: a piece begins with the space before each, and no other
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(units) and starts[0] == 0:
                data, starts = ids.tobytes(), (4 * starts).tolist()
                return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        elif self.mark and not any("<|" in u for u in units):
            number, mark = self.mark
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join([prefix + u for u in units]) + mark], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == number)
            if mark.startswith("<|") and len(ends) == len(units):
                data, ends = ids.tobytes(), (4 * ends).tolist()
                return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)]
        return self.whole([prefix + u for u in units])

    def _known(self, cache: dict[str, bytes], units: set[str], prefix: str) -> list[str]:
        """Sees to it that cache has all units; returns those that aren't to stay in it.

        Letters or digits and the marks after them are different pieces, so a word before marks is encoded as the word itself;
        but not where the vocabulary's normalizer makes more than one letter of the last one, such as a letter and a combining mark.
        """
        if len(cache) > _CACHED_UNITS:
            for u in list(cache)[_CACHED_UNITS // 2 :]:  # what came first is mostly what comes often
                del cache[u]
        new = units.difference(cache)
        if not new:
            return []
        joined, needed, long = [], [], []
        for u in new:
            if len(u) > _LONG_UNIT:
                long.append(u)
            if u[-1:] in _MARKS and (word := u.rstrip(_MARKS)) and self._ends_a_piece(word[-1]):
                joined.append((u, word))
                if word not in cache and word not in new:
                    needed.append(word)
                    if len(word) > _LONG_UNIT:
                        long.append(word)
            else:
                needed.append(u)
        needed = list(dict.fromkeys(needed))
        cache.update(zip(needed, self._apart(needed, prefix), strict=True))
        tails = self.tails
        for u, word in joined:
            tail = u[len(word) :]
            if tail not in tails:
                if len(tails) > 50_000:
                    tails.clear()
                tails[tail] = self.whole([tail])[0]
            cache[u] = cache[word] + tails[tail]
        return long

    def _ends_a_piece(self, last: str) -> bool:
        if last.isascii():
            return last.isalnum()
        if last not in self.steady:
            normalizer = self.tokenizer.normalizer
            became = normalizer.normalize_str(last) if normalizer else last
            self.steady[last] = last.isalnum() and len(became) == 1 and became.isalnum()
        return self.steady[last]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts are taken together up to some size, so that what is new in them is encoded in one call."""
        one = self._by_spaces if self.byte_level else self._by_words
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > _GROUP_CHARS:
                out += one(group)
                group, size = [], 0
        return out + one(group) if group else out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """For vocabularies that drop white space: no piece spans a space or a line end."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        long = self._known(self.first, set().union(*cut), "")
        get = self.first.__getitem__
        out = [b"".join(map(get, units)) for units in cut]
        for u in dict.fromkeys(long):
            del self.first[u]
        return out

    def _by_spaces(self, texts: list[str]) -> list[bytes]:
        """For byte-level vocabularies: a piece begins at every space or line end that has no white space beside it.

        Texts with any other white space, or with white space next to white space or at an end, are encoded whole: their
        units joined by single spaces are not the text.
        """
        cut: list[list[str] | None] = []
        for text in texts:
            flat = text.replace("\n", " ")
            units = flat.split()
            odd = not units or " ".join(units) != flat or not text.isascii() and self._invisible.search(text)
            cut.append(None if odd else units)
        # units that begin a line, and where
        heads: list[list[tuple[int, str]]] = []
        for text, units in zip(texts, cut, strict=True):
            own = []
            if units is not None:
                at = 0
                for line in text.split("\n"):
                    own.append((at, units[at]))
                    units[at] = ""
                    at += line.count(" ") + 1
            heads.append(own)
        long = self._known(self.first, {h for own in heads for _, h in own}, ""), self._known(self.later, set().union(*[u for u in cut if u is not None]), " ")
        odd = iter(self.whole([t for t, units in zip(texts, cut, strict=True) if units is None]))
        get, out = self.later.__getitem__, []
        for units, own in zip(cut, heads, strict=True):
            if units is None:
                out.append(next(odd))
                continue
            parts = list(map(get, units))
            for k, (at, head) in enumerate(own):
                parts[at] = self.line_end + self.first[head] if k else self.first[head]
            out.append(b"".join(parts))
        for cache, found in zip((self.first, self.later), long, strict=True):
            for u in dict.fromkeys(found):
                del cache[u]
        return out


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()
