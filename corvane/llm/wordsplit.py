"""Splitting text for the word-end vocabulary: NFC, white space, lower case, then word pattern.

The rules are those that the vocabulary file declares. White-space-separated chunks are
independent of each other, so callers cache whatever they derive from a chunk.
"""

from __future__ import annotations

import re
import unicodedata

import regex

#: The vocabulary file's split pattern.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD = regex.compile(WORD_PATTERN)
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Ranges of letters and numbers of later Unicode versions that the tokenizer takes for neither.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CF, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Ranges of capitals that Python has no lower form for but the tokenizer has, and the first lower one.
LATER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_LATER = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
_LOWER = {c: chr(low + c - a) for a, b, low in LATER_CAPITALS for c in range(a, b + 1)}
#: All of these lie above; a single range is searched much faster than many.
_HIGH = re.compile("[\u0558-\U0010ffff]")
_ODD = re.compile(f"[{_LATER}{''.join(map(chr, _LOWER))}]")
_WORD_OF_ODD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|[^\s[[\p{{L}}\p{{N}}]--[{_LATER}]]]+")
_SPACE = regex.compile(r"\s+")
#: str.split() takes these for spaces, Unicode's White_Space property does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """The text's pieces between white space."""
    if _SEPARATORS.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def words(chunk: str) -> list[str]:
    """The lower-cased words of one chunk; the capital sigma has one lower form here."""
    if chunk.isascii():
        if chunk.isalpha():
            return [chunk.lower()]
        if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
            return [chunk[:-1].lower(), chunk[-1]]
        if chunk.isprintable():
            return _ASCII_WORD.findall(chunk.lower())
        return _WORD.findall(chunk.lower())
    folded = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
    if _HIGH.search(folded) and _ODD.search(folded):
        return _WORD_OF_ODD.findall(folded.translate(_LOWER))
    return _WORD.findall(folded)
