"""Words of texts apart from how they are written and set, as 64-bit hashes.

``words`` gives the words of one text as strings; ``tokens`` hashes those of
many texts in vector operations. A character is folded by a table that is
filled as characters come: its compatibility decomposition without marks, in
one case. Texts with a character that folds into several take the way of
``words``, so both always agree.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import regex

_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|h\d|td|tr|table|blockquote|pre|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_INVISIBLE = re.compile("[​-‏⁠﻿\xad‪-‮]")
#: A word broken at the end of a line, the next of which may be quoted.
_BROKEN = re.compile(r"(?<=\w)[-‐][ \t]*(?:\r\n?|[\n\x0b\x0c\x85  ])[ \t>|]*(?=\w)")
#: What any such break has, quick to look for.
_MAY_BREAK = re.compile(r"-[ \t]*[\r\n\x0b\x0c\x85\u2028\u2029]")
_MARKS = regex.compile(r"\p{Mn}+")
_WORD = re.compile(r"[^\W_]+")

#: Folded code of a character, or one of these.
_BREAK, _UNKNOWN, _DROP, _SEVERAL, _END = 0, -1, -2, -3, -4
_END_OF_TEXT = "\x1e"
#: Characters folded at a time; a longer text is folded by itself.
_AT_ONCE = 100_000

_codes = np.full(0x110000, _UNKNOWN, np.int32)
_codes[ord(_END_OF_TEXT)] = _END


def _plain(text: str) -> str:
    """The text without markup and joined at broken line ends."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if _MAY_BREAK.search(text) or "‐" in text:
        text = _BROKEN.sub("", text)
    return text


def _folded(text: str) -> str:
    return text.casefold() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()


def words(text: str | None) -> list[str]:
    """The words of a text apart from how they are written and set."""
    return _WORD.findall(_folded(_plain(text))) if text else []


def _code(char: str) -> int:
    folded = _folded(char)
    if not folded or _INVISIBLE.match(char):
        return _DROP
    if len(folded) > 1:
        return _SEVERAL
    return ord(folded) if folded.isalnum() else _BREAK


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(plain: list[str], forced: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(hashes, words of each text, texts with characters that fold into several)."""
    chars = np.frombuffer((_END_OF_TEXT.join(plain) + _END_OF_TEXT).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _codes[chars]
    if (codes == _UNKNOWN).any():
        for c in np.unique(chars[codes == _UNKNOWN]).tolist():
            _codes[c] = _code(chr(c))
        codes = _codes[chars]
    several: list[int] = []
    at = np.flatnonzero(codes == _SEVERAL)
    if len(at):
        if forced:
            codes[at] = chars[at]
        else:
            several = np.unique(np.searchsorted(np.flatnonzero(codes == _END), at)).tolist()
    if (codes == _DROP).any():
        codes = codes[codes != _DROP]
    inside = np.zeros(len(codes) + 1, np.int8)
    np.greater(codes, 0, out=inside[1:].view(bool))
    # The last character ends a text, so every word has an end.
    step = np.diff(inside)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.uint64) - np.repeat(first, lengths).astype(np.uint64)
    with np.errstate(over="ignore"):
        place <<= np.uint64(21)
        place += codes[codes > 0].view(np.uint32)
        place *= np.uint64(0x9E3779B97F4A7C15)
        place ^= place >> np.uint64(32)
        place *= np.uint64(0xD6E8FEB86659FD93)
        place ^= place >> np.uint64(29)
        sums = np.add.reduceat(place, first) if len(first) else np.empty(0, np.uint64)
        hashes = _mix(sums)
    owner = np.searchsorted(np.flatnonzero(codes == _END), starts)
    return hashes, np.bincount(owner, minlength=len(plain)), several


def tokens(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the hashes of text i's words are ``hashes[bounds[i]:bounds[i + 1]]``."""
    parts, counts = [], []
    at = 0
    while at < len(texts):
        plain, size = [], 0
        while at < len(texts) and (not plain or size + len(texts[at] or "") <= _AT_ONCE):
            text = texts[at]
            plain.append(_plain(text).replace(_END_OF_TEXT, " ") if text else "")
            size += len(plain[-1])
            at += 1
        hashes, n, several = _hashed(plain, False)
        if several:
            bounds = np.concatenate([[0], np.cumsum(n)])
            own, n_own, _ = _hashed([" ".join(_WORD.findall(_folded(plain[i]))) for i in several], True)
            pieces, done = [], 0
            for i, h in zip(several, np.split(own, np.cumsum(n_own)[:-1])):
                pieces += [hashes[bounds[done] : bounds[i]], h]
                done = i + 1
            hashes = np.concatenate([*pieces, hashes[bounds[done] :]])
            n[several] = n_own
        parts.append(hashes)
        counts.append(n)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words, one for each word that begins one."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out
