"""Arrow text as numpy code-point arrays, with character tables built by rule.

Every operator of this package that looks at characters works on whole Arrow
batches: the strings of a batch become one uint32 array, a table gather gives
each character its class bits, and all later steps are array operations.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Code points above this bound share the last entry of every table.
LIMIT = 0x20000

UPPER, LOWER, CASELESS, DIGIT = 1, 2, 4, 8
SPACE, MARK, HIDDEN, TERM = 16, 32, 64, 128
THAI, CJK, LATIN, CYRILLIC = 256, 512, 1024, 2048
GREEK, ARABIC, DEVANAGARI, SYMBOL = 4096, 8192, 16384, 32768
LETTER = UPPER | LOWER | CASELESS

# Letters of other scripts that look like a Latin letter.
CYRILLIC_LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝҮүӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwYyl"))
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϳϲ", "ABEZHIKMNOPTYXvojc"))
LOOKS = CYRILLIC_LOOKS | GREEK_LOOKS
# Characters that show nothing though they are no format characters.
HIDDEN_CODES = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10))
# Format characters that do show.
VISIBLE_FORMATS = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD)
# Marks that can end a sentence.
TERM_CHARS = ".!?…‼⁇⁈⁉。．！？।॥؟۔｡"


def _flags(cp: int) -> int:
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in HIDDEN_CODES or kind == "Cf" and cp not in VISIBLE_FORMATS:
        return HIDDEN
    out = TERM if ch in TERM_CHARS else 0
    if ch.isspace():
        return out | SPACE
    if kind[0] == "M":
        out |= MARK
    elif kind == "Lu" or kind == "Lt":
        out |= UPPER
    elif kind == "Ll":
        out |= LOWER
    elif kind[0] == "L":
        out |= CASELESS
    elif kind == "Nd":
        out |= DIGIT
    elif kind[0] in "PS":
        out |= SYMBOL
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0xFB00 <= cp < 0xFB07 or 0xFF21 <= cp < 0xFF5B:
        out |= LATIN if out & LETTER else 0
    elif 0x300 <= cp < 0x370:
        pass
    elif 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        out |= GREEK
    elif 0x400 <= cp < 0x530:
        out |= CYRILLIC
    elif 0x600 <= cp < 0x780 or 0xFB50 <= cp < 0xFE00 or 0xFE70 <= cp < 0xFEFF:
        out |= ARABIC
    elif 0x900 <= cp < 0x980:
        out |= DEVANAGARI
    elif 0xE00 <= cp < 0xE80:
        out |= THAI
    elif 0x2E80 <= cp < 0x3000 or 0x3005 <= cp < 0x3008 or 0x3040 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00 or 0xFF66 <= cp < 0xFFA0:
        out |= CJK
    return out


@functools.cache
def class_table() -> np.ndarray:
    """uint16 class bits per code point."""
    out = np.zeros(LIMIT + 1, np.uint16)
    out[:LIMIT] = [0 if 0x3400 <= c < 0xD800 or 0xD800 <= c < 0xF900 else _flags(c) for c in range(LIMIT)]
    out[0x3400:0xA000] = CASELESS | CJK
    out[0xAC00:0xD7A4] = CASELESS
    out[LIMIT] = CASELESS | CJK
    return out


def _skeleton(ch: str) -> str:
    """First character of the compatibility form, without marks, in lower case, with Latin looks."""
    base = unicodedata.normalize("NFKD", ch)[0]
    base = LOOKS.get(base, base)
    low = base.lower()
    return LOOKS.get(low, low)[0] if len(low) == 1 else base


@functools.cache
def fold_table() -> np.ndarray:
    """uint32 folded code point per code point: one look, one case, no marks."""
    out = np.arange(LIMIT + 1, dtype=np.uint32)
    spans = [(0, 0x590), (0x1D00, 0x2100), (0x2100, 0x2190), (0x2460, 0x2500), (0x2E80, 0x3000), (0xF900, 0xFB07), (0xFE30, 0xFE70), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)]
    for a, b in spans:
        for cp in range(a, b):
            if not 0xD800 <= cp < 0xE000:
                out[cp] = ord(_skeleton(chr(cp)))
    return out


def fold_word(word: str) -> list[int]:
    """The folded letters of a word, for tables of words."""
    table = fold_table()
    return [int(table[min(ord(c), LIMIT)]) for c in unicodedata.normalize("NFC", word)]


def join_codes(texts: list[str | None], sep: str = "\x1e") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with one separator after each, and each text's start.

    ``starts`` has one entry more than there are texts; text k occupies
    ``codes[starts[k] : starts[k + 1] - 1]``. Nulls count as empty.
    """
    texts = [t or "" for t in texts]
    joined = sep.join(texts) + sep
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=starts[1:])
    return codes, starts


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows whose lengths sum to about ``most``; a longer row stands alone."""
    out, begin, total = [], 0, 0
    for k, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            out.append((begin, k))
            begin, total = k, 0
        total += n
    if begin < len(lengths):
        out.append((begin, len(lengths)))
    return out


def clip(codes: np.ndarray) -> np.ndarray:
    return np.minimum(codes, LIMIT)
