"""Tokenising whole texts with a given tokenizer file, by pieces that repeat.

The pre-tokenizers this is for never make a token that spans a single space between two visible characters, so a
text may be cut there and each piece encoded alone. Pieces repeat a lot: a worker keeps the ids of those that it met
first, as bytes of little-endian unsigned 32-bit integers; words of letters that it hasn't kept go to the library's model,
everything else to the whole tokenizer. Texts with other characters than those known to be safe to cut at go to the library whole.

Byte-level tokenizers: plain texts are cut with numpy, a few MB at once, and their words are looked up together in a table whose keys are
the words themselves.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Visible in every Unicode version, neither white space nor able to compose or change case across a space.
_SEEN = "!-~¡-¬®-ʯ"
_ODD = re.compile(f"[^{_SEEN} \n]")
_LOOSE = ("  ", " \n", "\n ", "\n\n")
_CUT = re.compile(f"(?<=[{_SEEN}]) (?=[{_SEEN}])")
#: Letters, then signs that are no letters, digits, white space or apostrophes (which may begin a contraction).
_TAILED = re.compile("(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
_KEPT, _KEPT_PARTS, _KEPT_WORDS = 250_000, 700_000, 1 << 21  # pieces, parts of them, and words of the table that a worker keeps
#: Bytes that a text in Latin-1 may have to be cut at any single space.
_PLAIN = bytes([10, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)])

_SPAN = 1 << 22  # characters that are cut at once, about
#: What a byte of a plain text is: a letter as in _TAILED, a sign that may follow letters, something else, or a separator: space,
#: line feed, or the zero byte between two texts.
_LETTER, _SIGN, _OTHER, _SEP = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
_CLASS[[0, 10, 32]] = _SEP
#: What stands before a part: a space, a line feed, a text's start, or letters (the part is signs).
_SPACED, _FED, _FRESH, _AFTER = range(4)
_WORD = 15  # characters of a key; its last byte tells what stands before
_MASK = [np.array([(1 << 8 * min(max(n - skip, 0), 8)) - 1 for n in range(_WORD + 1)], dtype=np.uint64) for skip in (0, 8)]


def _byte_chars() -> list[str]:
    """The character that byte-level pre-tokenizers write for each byte: itself if visible, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(free)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


def _loose(text: str) -> bool:
    """Whether a space or line feed of the text has no visible character on one side."""
    return text[:1] in " \n" or text[-1:] in " \n" or any(x in text for x in _LOOSE)


class Pieces:
    """encode(texts) gives each text's ids as bytes, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        ids = lambda text: self._tok.encode(text, add_special_tokens=False).ids
        self._dropped = ids(" \n") == [] and ids("a b\nc") == ids("a") + ids("b") + ids("c")
        self._lead = "" if self._dropped else " "
        self._model = self._tok.model
        self._feed = self._whole("\n")
        self._first = {t[0] for t in special}
        self._words = _Words(_KEPT_WORDS)
        self._kept, self._parts, self._tails = _Kept(self._learn, _KEPT), _Kept(self._letters, _KEPT_PARTS), _Kept(self._whole, 20_000)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, core: str, lead: str | None = None) -> bytes:
        """Ids of one pre-token of letters, from the tokenizer's model alone: the steps before it change nothing else.
        A core that begins a line has the line feed's id first and no space."""
        head, lead = b"", self._lead if lead is None else lead
        if core[0] == "\n":
            core, head, lead = core[1:], self._feed, ""
        chars = (lead and "Ġ") + core if core.isascii() else "".join(map(_BYTE_CHARS.__getitem__, (lead + core).encode()))
        return head + b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(chars)])

    def _learn(self, w: str) -> bytes:
        """Ids of a piece that was not kept. Letters and the signs after them are separate pre-tokens, so a piece of
        that form is put together from its two parts, which repeat far more often than the piece."""
        m = _TAILED.fullmatch(w)
        if m is None:
            return self._feed + self._whole(w[1:]) if w[:1] == "\n" and not w[1:2].isspace() else self._whole(self._lead + w)
        core, tail = m.groups()
        ids = self._parts[core.lower() if self._dropped else core]
        return ids + self._tails[tail] if tail else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if self._dropped:
            return [self._one(t) for t in texts]
        out: list = [None] * len(texts)
        plain, where = [], []
        for i, t in enumerate(texts):
            raw = self._plain(t)
            if raw is None:
                out[i] = self._one(t)
            else:
                plain.append(raw)
                where.append(i)
        for i, ids in zip(where, self._together(plain), strict=True):
            out[i] = ids
        return out

    def _plain(self, text: str) -> bytes | None:
        """The text in Latin-1, if it may be cut at every space and line feed."""
        if _loose(text) or self._has_special(text):
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, _PLAIN) else raw

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts."""
        if not texts:
            return []
        data = b"\0".join([b"", *texts, b""])
        a, ids, starts, n = 0, [], [], 0
        while a < len(data) - 1:
            b = data.find(b" ", a + _SPAN)
            b = b if b >= 0 else len(data) - 1
            some, start = self._span(data[a : b + 1])
            ids.append(some.tobytes())
            starts += (start + n).tolist()
            n += len(some)
            a = b
        raw = b"".join(ids)
        return [raw[4 * x : 4 * y] for x, y in zip(starts, [*starts[1:], n], strict=True)]

    def _span(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """data: pieces, each with the separator before it, and a last separator. Their ids, and where those of each text start.

        A piece is letters and signs after them, two parts that are looked up in the table, or it is looked up alone."""
        buf = np.frombuffer(data, np.uint8)
        kind = _CLASS.take(buf)
        at = np.flatnonzero(kind)  # all but letters
        kind = kind.take(at)
        sep = np.flatnonzero(kind == _SEP)
        first, last = sep[:-1] + 1, sep[1:]  # a piece's first place in `at`, if it has another than letters, and its end
        start, mid, end = at.take(sep[:-1]) + 1, at.take(first), at.take(last)
        lead = buf.take(start - 1)
        others = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        fits = (end - mid == last - first) & (others.take(last) == others.take(first)) & (mid > start) & (mid - start <= _WORD) & (end - mid <= _WORD)
        before = np.where(lead == 32, _SPACED, np.where(lead == 10, _FED, _FRESH))
        # Two parts for each piece, the second may be empty; a piece that doesn't fit is its own first part.
        begin, size = np.stack([start, mid], axis=1).ravel(), np.stack([mid - start, end - mid], axis=1).ravel()
        which = np.stack([before, np.full(len(mid), _AFTER)], axis=1).ravel()
        place, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        use = np.flatnonzero(np.repeat(fits, 2) & (size > 0))
        place[use], count[use] = self._words.find(data, begin.take(use), size.take(use), which.take(use), self._part)
        alone = np.flatnonzero(~fits)
        if len(alone):
            raws = [self._alone(data[s:e].decode("latin-1"), b) for s, e, b in zip(start[alone].tolist(), end[alone].tolist(), before[alone].tolist(), strict=True)]
            count[2 * alone] = n = np.array([len(r) // 4 for r in raws])
            place[2 * alone] = self._words.lay(np.frombuffer(b"".join(raws), "<u4")) + np.cumsum(n) - n
        ends = np.cumsum(count)
        total = int(ends[-1])
        ids = self._words.ids.take(np.arange(total) + np.repeat(place - (ends - count), count))
        return ids, (ends - count)[2 * np.flatnonzero(before == _FRESH)]

    def _part(self, part: str, before: int) -> bytes:
        if before == _AFTER:
            return self._tails[part]
        return self._letters("\n" + part if before == _FED else part, "" if before == _FRESH else self._lead)

    def _alone(self, piece: str, before: int) -> bytes:
        return self._whole(piece) if before == _FRESH else self._kept["\n" + piece if before == _FED else piece]

    def _has_special(self, text: str) -> bool:
        return self._special is not None and any(c in text for c in self._first) and self._special.search(text) is not None

    def _one(self, text: str) -> bytes:
        if self._has_special(text):
            return self._whole(text)
        try:
            odd = bool(text.encode("latin-1").translate(None, _PLAIN))
        except UnicodeEncodeError:
            odd = _ODD.search(text) is not None
        get = self._kept.__getitem__
        if self._dropped:
            return b"".join(map(get, _CUT.split(text) if odd else text.split()))
        words = _CUT.split(text) if odd or _loose(text) else text.replace("\n", " \n").split(" ")
        head = self._whole(words[0]) if words[0] else b""
        return head + b"".join(map(get, words[1:]))


class _Kept(dict):
    """What `make` gives for a key, kept for the first `most` keys."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self._make, self._most = make, most

    def __missing__(self, key: str) -> bytes:
        out = self._make(key)
        if len(self) < self._most and len(key) < 48:
            self[key] = out
        return out


class _Words:
    """Ids of short parts of texts, found for many parts at once. A key is the part's bytes and what stands before it, two unsigned
    64-bit integers, so parts are told apart exactly. The first `most` parts are kept; others have their ids in `ids` until `find` is
    called again.

    Slots hold numbers of parts (the first free slot from a hash on); `_low`, `_high` and `_at` go by these numbers, in the order in which
    parts were met, so that frequent ones lie together."""

    def __init__(self, most: int):
        self._most, self._n, self._laid = most, 0, 0
        self.ids = np.zeros(1 << 12, dtype=np.uint32)
        self._low = self._high = self._at = np.zeros(0, np.uint64)
        self._grow(10)

    def _grow(self, bits: int) -> None:
        """Room for half as many parts as there are slots."""
        self._bits, n = bits, self._n
        self._slots = np.full(1 << bits, -1, dtype=np.int32)
        low, high, at = self._low, self._high, self._at
        self._low, self._high, self._at = np.zeros(1 << bits - 1, np.uint64), np.zeros(1 << bits - 1, np.uint64), np.zeros((1 << bits - 1) + 1, np.int64)
        if n:
            self._low[:n], self._high[:n], self._at[: n + 1] = low[:n], high[:n], at[: n + 1]
            self._put(0, n)

    def _hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15)
        h ^= high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(64 - self._bits)
        return h.view(np.int64)

    def _put(self, a: int, b: int) -> None:
        part, slot = np.arange(a, b, dtype=np.int32), self._hash(self._low[a:b], self._high[a:b])
        while len(part):
            free = self._slots.take(slot) < 0
            self._slots[slot[free]] = part[free]
            lost = self._slots.take(slot) != part
            part, slot = part[lost], slot[lost] + 1 & len(self._slots) - 1

    def _search(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot = self._hash(low, high)
        out = self._slots.take(slot)
        left = np.flatnonzero((out >= 0) & ~((self._low.take(out, mode="wrap") == low) & (self._high.take(out, mode="wrap") == high)))
        slot = slot.take(left)
        while len(left):
            slot = slot + 1 & len(self._slots) - 1
            got = self._slots.take(slot)
            out[left] = got
            more = (got >= 0) & ~((self._low.take(got, mode="wrap") == low.take(left)) & (self._high.take(got, mode="wrap") == high.take(left)))
            left, slot = left[more], slot[more]
        return out

    def lay(self, some: np.ndarray) -> int:
        """Where `some` now lies in `ids`, behind what lies there."""
        a, b = self._laid, self._laid + len(some)
        if b > len(self.ids):
            self.ids = np.concatenate([self.ids[:a], np.zeros(2 * b - a, np.uint32)])
        self.ids[a:b] = some
        self._laid = b
        return a

    def find(self, data: bytes, start: np.ndarray, size: np.ndarray, before: np.ndarray, make: Callable[[str, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the parts data[start : start + size] lie in `ids`, and how many there are."""
        self._laid = int(self._at[self._n])  # ids of parts that weren't kept go
        padded = data + bytes(16)
        key = np.ndarray((len(data),), "V16", padded, strides=(1,))[start].view("<u8").reshape(-1, 2)
        low, high = key[:, 0] & _MASK[0].take(size), key[:, 1] & _MASK[1].take(size)
        high |= before.astype(np.uint64) << np.uint64(56)
        number = self._search(low, high)
        place, count = self._at.take(number, mode="wrap"), self._at.take(number + 1)
        count -= place
        new = np.flatnonzero(number < 0)
        if len(new):
            seen: dict = {}
            raws, firsts, of = [], [], []
            for i, s, n, b in zip(new.tolist(), start[new].tolist(), size[new].tolist(), before[new].tolist(), strict=True):
                part = data[s : s + n], b
                k = seen.get(part)
                if k is None:
                    k = seen[part] = len(raws)
                    raws.append(make(part[0].decode("latin-1"), b))
                    firsts.append(i)
                of.append(k)
            many = np.array([len(r) // 4 for r in raws])
            ends = np.cumsum(many) + self._laid
            self.lay(np.frombuffer(b"".join(raws), "<u4"))
            place[new], count[new] = (ends - many).take(of), many.take(of)
            a, b = self._n, min(self._n + len(raws), self._most)
            while b > len(self._low):
                self._grow(self._bits + 1)
            kept = firsts[: b - a]
            self._low[a:b], self._high[a:b], self._at[a + 1 : b + 1], self._n = low[kept], high[kept], ends[: b - a], b
            self._put(a, b)
        return place, count


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One per worker process and tokenizer file."""
    return Pieces(path)


def blocks(texts: list[str], most: int = 1 << 21):
    """Runs of (start, texts) of about `most` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
