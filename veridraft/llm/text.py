"""Reading texts alike: encoding and spacing variants mean nothing."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

_INVISIBLE = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u00ad")
_MARKS = re.compile("[\u0300-\u036f]+")
_SPACES = re.compile("[\u2028\u2029\t]")
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});")
WORD = re.compile(r"[^\W_]+")


def clean(text: str) -> str:
    """Composed, with HTML entities resolved, without invisible characters, with plain spaces and
    line ends. NULL and non-strings read as empty."""
    if not isinstance(text, str):
        return ""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if not text.isascii():
        for c in _INVISIBLE:
            if c in text:
                text = text.replace(c, "")
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    if "\t" in text or "\u2028" in text:
        text = _SPACES.sub(" ", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text


def _western_folds() -> bytes:
    table = bytearray(range(256))
    for b in range(256):
        try:
            plain = _MARKS.sub("", unicodedata.normalize("NFKD", bytes([b]).decode("cp1252"))).lower()
            if len(plain) == 1:
                table[b] = plain.encode("cp1252")[0]
        except UnicodeError:
            pass
    return bytes(table)


#: Bytes of Western texts to bytes of their folded forms.
WESTERN = _western_folds()


def fold(text: str) -> str:
    """Lower case without accents, of a cleaned text."""
    try:
        return text.encode("cp1252").translate(WESTERN).decode("cp1252")
    except UnicodeError:
        pass
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


_WESTERN_MASKED = bytes(ord("0") if 48 <= b <= 57 else b for b in WESTERN)
_DIGIT = re.compile(r"\d")


def fold_masked(text: str) -> str:
    """``fold`` with every digit read as 0."""
    try:
        return text.encode("cp1252").translate(_WESTERN_MASKED).decode("cp1252")
    except UnicodeError:
        return _DIGIT.sub("0", fold(text))


#: The same, with a space for whatever is no letter or digit.
_WESTERN_WORDS = bytes(b if bytes([b]).decode("cp1252", "replace").isalnum() else 32 for b in WESTERN)


def folded_words(text: str) -> list[str]:
    """Folded runs of letters and digits of a cleaned text."""
    try:
        return text.encode("cp1252").translate(_WESTERN_WORDS).decode("cp1252").split()
    except UnicodeError:
        return WORD.findall(fold(text))


def words(text: str) -> list[str]:
    """Folded runs of letters and digits."""
    return folded_words(clean(text))


_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)*]*\s+|\s*\n\s*")


def sentences(text: str) -> list[str]:
    """Pieces of a cleaned text between sentence ends and line ends."""
    return [s for s in _SENTENCE.split(text.strip()) if s]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))
