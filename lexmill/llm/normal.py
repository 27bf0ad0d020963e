"""One consistent form for text that looks the same: the characters of equal look made equal.

Arrow text is copied to one code-point array per batch. Table gathers map wide
and presentation forms, spaces and hyphens to their plain character and drop
characters that show nothing; expansion offsets write ligatures out; combining
marks are put in canonical order and composed by searching pairs in a table;
and letters of a word are brought to the word's script. There is no call per
row or per character. Only rows with a character that may need attention are
touched.

The consistent form is composed, has plain spaces and hyphens, and within a
word letters of one script. An identifier (``ascii_only``) is plain ASCII but
for the section sign. Marks with a look of their own stay: curly quotes,
dashes, ellipses, ordinal signs, CJK punctuation; so do joiners after a
Devanagari virama.

Defined results: null stays null and is never changed; empty text stays empty;
a letter that no rule names stays as it is; applying the form twice changes
nothing more.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import codepoints as cp

# Full-width punctuation of CJK typesetting, which keeps its own look.
CJK_MARKS = "！＂＇（），－．／：；？［＼］＿｛｜｝～｟｠｡｢｣､･"
# Other characters of equal look.
EQUAL_LOOKS = {"\u2010": "-", "\u2011": "-", "\u06a9": "\u0643", "\u06cc": "\u064a"}
#: Compatibility mappings whose two sides look alike.
ALIKE = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")
BATCH_CHARS = 1 << 20
VIRAMA = 0x094D
# First Hangul syllable and the bases of its leading, vowel and trailing letters.
HANGUL, HANGUL_L, HANGUL_V, HANGUL_T = 0xAC00, 0x1100, 0x1161, 0x11A7


def _replacement(c: int) -> str | None:
    """What a code point becomes by itself; None if it stays."""
    ch = chr(c)
    if ch in EQUAL_LOOKS:
        return EQUAL_LOOKS[ch]
    if ch in CJK_MARKS:
        return None
    kind = unicodedata.category(ch)
    if kind == "Zs" and ch != " ":
        return " "
    if kind == "Cc" and not ch.isspace():
        return ""
    how = unicodedata.decomposition(ch)
    tag = how.split(" ")[0] if how.startswith("<") else ""
    if tag in ALIKE or tag == "<compat>" and (0xFB00 <= c < 0xFB07 or 0xFB13 <= c < 0xFB18 or 0x2E80 <= c < 0x2FE0 or 0x0132 <= c < 0x0134 or 0x01C4 <= c < 0x01CD):
        got = unicodedata.normalize("NFKC", ch)
        return got if got != ch and not got.startswith(" ") else None
    got = unicodedata.normalize("NFC", ch)
    return got if got != ch else None


class Tables:
    """Lookup tables over code points, built by rule from the character database."""

    def __init__(self) -> None:
        n = cp.LIMIT + 1
        self.kinds = cp.class_table()
        self.length = np.ones(n, np.uint8)
        self.base = np.zeros(n, np.int32)
        self.mapped = np.zeros(n, bool)
        flat: list[int] = []
        self.ccc = np.zeros(n, np.uint8)
        decomposed: dict[int, str] = {}
        pairs: dict[int, int] = {}
        for c in range(n - 1):
            if 0x3400 <= c < 0xF900:
                continue
            ch = chr(c)
            got = "" if self.kinds[c] & cp.HIDDEN else _replacement(c)
            if got is not None:
                self.mapped[c] = True
                self.length[c], self.base[c] = len(got), len(flat)
                flat += map(ord, got)
            self.ccc[c] = unicodedata.combining(ch)
            how = unicodedata.decomposition(ch)
            if how and not how.startswith("<"):
                decomposed[c] = unicodedata.normalize("NFD", ch)
                parts = [int(x, 16) for x in how.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                    pairs[(parts[0] << 21) | parts[1]] = c
        self.flat = np.array(flat, np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        #: Characters of no combining class that join the character before them: vowel parts and Hangul letters.
        self.joins = np.zeros(n, bool)
        self.joins[[k & 0x1FFFFF for k in pairs if not self.ccc[k & 0x1FFFFF]]] = True
        self.joins[HANGUL_V : HANGUL_V + 21] = self.joins[HANGUL_T + 1 : HANGUL_T + 28] = True
        self.d_length = np.ones(n, np.uint8)
        self.d_base = np.zeros(n, np.int32)
        d_flat: list[int] = []
        for c, s in decomposed.items():
            self.d_length[c], self.d_base[c] = len(s), len(d_flat)
            d_flat += map(ord, s)
        self.d_flat = np.array(d_flat, np.uint32)
        to_latin, to_cyrillic, to_greek = (np.arange(n, dtype=np.uint32) for _ in range(3))
        for looks, back in ((cp.CYRILLIC_LOOKS, to_cyrillic), (cp.GREEK_LOOKS, to_greek)):
            for a, b in looks.items():
                to_latin[ord(a)] = ord(b)
                if back[ord(b)] == ord(b):
                    back[ord(b)] = ord(a)
        for a in cp.GREEK_LOOKS:
            to_cyrillic[ord(a)] = to_cyrillic[to_latin[ord(a)]] if to_cyrillic[to_latin[ord(a)]] != to_latin[ord(a)] else ord(a)
        for a in cp.CYRILLIC_LOOKS:
            to_greek[ord(a)] = to_greek[to_latin[ord(a)]] if to_greek[to_latin[ord(a)]] != to_latin[ord(a)] else ord(a)
        self.to = (to_latin, to_cyrillic, to_greek)
        self.alike = (to_cyrillic != np.arange(n)) | (to_greek != np.arange(n)) | (to_latin != np.arange(n))
        #: Characters for which a row is looked at.
        self.flag = self.mapped | (self.ccc > 0) | self.joins | ((self.kinds & (cp.CYRILLIC | cp.GREEK)) > 0)
        self.ascii = to_latin.copy()
        for c in (*range(0x2010, 0x2016), 0x2212):
            self.ascii[c] = 0x2D
        for c in (*range(0xFF01, 0xFF5F),):
            self.ascii[c] = c - 0xFEE0


@functools.cache
def tables() -> Tables:
    return Tables()


def _expand(codes: np.ndarray, source: np.ndarray, length: np.ndarray, base: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the table's characters in place of ``codes[which]``."""
    n = np.where(which, length[codes], 1).astype(np.int64)
    offset = np.cumsum(n) - n
    out = np.repeat(codes, n)
    at = np.flatnonzero(which)
    for k in range(int(n[at].max()) if len(at) else 0):
        more = at[n[at] > k]
        out[offset[more] + k] = flat[base[codes[more]] + k]
    return out, np.repeat(source, n)


def _compose(codes: np.ndarray, source: np.ndarray, t: Tables, dirty: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of combining marks."""
    ccc = t.ccc[np.minimum(codes, cp.LIMIT)]
    if not ccc.any():
        return codes, source
    before, was, codes = codes, source, codes.copy()
    mark_next = np.zeros(len(codes), bool)
    mark_next[:-1] = ccc[1:] > 0
    clipped = np.minimum(codes, cp.LIMIT)
    which = mark_next & (t.d_length[clipped] > 1)
    if which.any():
        codes, source = _expand(clipped, source, t.d_length, t.d_base, t.d_flat, which)
        ccc = t.ccc[codes]
    # Bubble marks into canonical order: as many passes as the longest run of marks needs.
    while True:
        swap = np.flatnonzero((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0))
        if not len(swap):
            break
        swap = swap[np.concatenate([[True], np.diff(swap) > 1])]
        codes[swap], codes[swap + 1] = codes[swap + 1].copy(), codes[swap].copy()
        ccc[swap], ccc[swap + 1] = ccc[swap + 1].copy(), ccc[swap].copy()
    # Compose: each pass joins, per starter, the first mark that is not blocked.
    alive = np.ones(len(codes), bool)
    tried = np.zeros(len(codes), bool)
    while True:
        idx = np.flatnonzero(alive)
        c, k = codes[idx], ccc[idx]
        starter = np.maximum.accumulate(np.where(k == 0, np.arange(len(idx)), 0))
        m = np.flatnonzero((k > 0) & ~tried[idx])
        # A mark is blocked by an earlier mark of its class that stayed.
        m = m[(m == 0) | (k[np.maximum(m - 1, 0)] != k[m]) | (starter[m] == m - 1)]
        if not len(m):
            rest = np.flatnonzero((k > 0) & ~tried[idx])
            if not len(rest):
                break
            tried[idx[rest]] = True
            continue
        first = np.concatenate([[True], starter[m[1:]] != starter[m[:-1]]])
        m = m[first]
        key = (c[starter[m]].astype(np.int64) << 21) | c[m]
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = t.pair_keys[at] == key
        codes[idx[starter[m[hit]]]] = t.pair_to[at[hit]]
        alive[idx[m[hit]]] = False
        tried[idx[m]] = True
    codes, source = codes[alive], source[alive]
    if len(codes) != len(before):
        dirty.append(np.setdiff1d(was, source))
        kept = np.isin(was, source)
        same = before[kept]
        if len(same) == len(codes):
            dirty.append(source[same != codes])
        else:
            dirty.append(source)
    else:
        dirty.append(source[before != codes])
    return codes, source


def _join_starters(codes: np.ndarray, source: np.ndarray, t: Tables, dirty: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vowel parts and Hangul letters of no combining class composed with the character right before them."""
    while True:
        b = np.flatnonzero(t.joins[np.minimum(codes, cp.LIMIT)])
        b = b[b > 0]
        if not len(b):
            return codes, source
        one, two = codes[b - 1].astype(np.int64), codes[b].astype(np.int64)
        key = (one << 21) | two
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        made = np.where(t.pair_keys[at] == key, t.pair_to[at].astype(np.int64), 0)
        syllable, tail = HANGUL + ((one - HANGUL_L) * 21 + two - HANGUL_V) * 28, one + two - HANGUL_T
        made = np.where((one >= HANGUL_L) & (one < HANGUL_L + 19) & (two >= HANGUL_V) & (two < HANGUL_V + 21), syllable, made)
        made = np.where((one >= HANGUL) & (one < HANGUL + 11172) & ((one - HANGUL) % 28 == 0) & (two > HANGUL_T) & (two < HANGUL_T + 28), tail, made)
        hit = made > 0
        # Of a run of such characters the first goes first.
        hit &= ~np.concatenate([[False], hit[:-1] & (np.diff(b) == 1)])
        if not hit.any():
            return codes, source
        codes = codes.copy()
        codes[b[hit] - 1] = made[hit]
        dirty += [source[b[hit]], source[b[hit] - 1]]
        keep = np.ones(len(codes), bool)
        keep[b[hit]] = False
        codes, source = codes[keep], source[keep]


def _one_script(codes: np.ndarray, source: np.ndarray, t: Tables, dirty: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Letters of each word brought to the word's script."""
    kind = t.kinds[np.minimum(codes, cp.LIMIT)]
    foreign = (kind & (cp.CYRILLIC | cp.GREEK)) > 0
    if not foreign.any():
        return codes
    letter = ((kind & (cp.LETTER | cp.MARK)) > 0) & ~ends
    head = letter & ~np.concatenate([[False], letter[:-1]])
    word = np.cumsum(head) - 1
    n_words = int(word[-1]) + 1 if len(word) else 0
    at = np.flatnonzero(letter)
    w = word[at]
    latin = (kind[at] & cp.LATIN) > 0
    cyr = (kind[at] & cp.CYRILLIC) > 0
    greek = (kind[at] & cp.GREEK) > 0
    alike = t.alike[codes[at]]
    # Latin letters without a look-alike in any script are Latin for sure, and so on.
    own = [np.bincount(w[f & ~alike], minlength=n_words) for f in (latin, cyr, greek)]
    total = [np.bincount(w[f], minlength=n_words) for f in (latin, cyr, greek)]
    has = sum((x > 0).astype(np.int8) for x in total)
    score = np.stack([o * 100 + x for o, x in zip(own, total)])
    target = score.argmax(0)
    mixed = has > 1
    # A word of look-alikes only says nothing by itself: its neighbours do.
    sure = np.where(own[0] > 0, 0, np.where(own[1] > 0, 1, np.where(own[2] > 0, 2, -1)))
    open_word = sure < 0
    lone = open_word & (has == 1) & (total[0] == 0)
    if (lone | open_word & mixed).any():
        row = np.cumsum(ends)[np.flatnonzero(head)]
        known = np.where(sure >= 0, np.arange(n_words), -1)
        left = np.concatenate([[-1], np.maximum.accumulate(known)[:-1]])
        right = np.minimum.accumulate(np.where(known >= 0, known, n_words)[::-1])[::-1]
        right = np.concatenate([right[1:], [n_words]])
        ok_left = (left >= 0) & (row[np.maximum(left, 0)] == row)
        ok_right = (right < n_words) & (row[np.minimum(right, n_words - 1)] == row)
        on_left = np.where(ok_left, sure[np.maximum(left, 0)], -1)
        on_right = np.where(ok_right, sure[np.minimum(right, n_words - 1)], -1)
        near = np.where(on_left < 0, on_right, np.where((on_right < 0) | (on_left == on_right), on_left, -1))
        # A whole word of another script is a disguise only among Latin words.
        mixed |= lone & (near == 0)
        target = np.where(open_word & mixed & (near >= 0), near, target)
    change = mixed[w]
    out = codes.copy()
    for k in range(3):
        sel = at[change & (target[w] == k)]
        out[sel] = t.to[k][codes[sel]]
    dirty.append(source[out != codes])
    return out


def normalise(texts: list[str | None], ascii_only: bool = False) -> tuple[list[str | None], np.ndarray]:
    """The consistent form of each text, and whether it differs."""
    t = tables()
    raw, starts = cp.join_codes(texts, "\n")
    clipped = np.minimum(raw, cp.LIMIT)
    ends = starts[1:] - 1
    flag = t.flag[clipped]
    if ascii_only:
        flag = flag | (raw > 127) & (raw != 0xA7)
    rows = np.unique(np.searchsorted(starts, np.flatnonzero(flag), "right") - 1)
    changed = np.zeros(len(texts), bool)
    if not len(rows):
        return texts, changed
    some = [texts[k] for k in rows]
    codes, starts = cp.join_codes(some, "\n")
    codes = codes.copy()
    source = np.arange(len(codes))
    ends = starts[1:] - 1
    is_end = np.zeros(len(codes), bool)
    is_end[ends] = True
    dirty: list[np.ndarray] = []
    clipped = np.minimum(codes, cp.LIMIT)
    which = t.mapped[clipped]
    # Joiners after a virama belong to the spelling.
    joiner = (codes == 0x200C) | (codes == 0x200D)
    if joiner.any():
        # Other hidden characters may stand between the two.
        shown = ((t.kinds[clipped] & cp.HIDDEN) == 0) | is_end
        prior = np.concatenate([[0], np.maximum.accumulate(np.where(shown, np.arange(len(codes)), 0))[:-1]])
        after = np.minimum.accumulate(np.where(shown, np.arange(len(codes)), len(codes) - 1)[::-1])[::-1]
        spelt = joiner & (codes[prior] == VIRAMA) & (prior == source - 1) & ((t.kinds[np.minimum(codes[after], cp.LIMIT)] & cp.DEVANAGARI) > 0)
        which &= ~spelt
    dirty.append(source[which])
    if which.any():
        codes, source = _expand(codes, source, t.length, t.base, t.flat, which & (codes < cp.LIMIT))
    codes, source = _compose(codes, source, t, dirty)
    codes, source = _join_starters(codes, source, t, dirty)
    end_now = is_end[source]
    codes = _one_script(codes, source, t, dirty, end_now)
    codes, source = _compose(codes, source, t, dirty)
    end_now = is_end[source]
    if ascii_only:
        low = np.where(codes < cp.LIMIT, t.ascii[np.minimum(codes, cp.LIMIT)], codes)
        dirty.append(source[(low != codes) & ~end_now])
        codes = low.astype(np.uint32)
    hit = np.unique(np.searchsorted(starts, np.concatenate(dirty), "right") - 1) if dirty else np.zeros(0, np.int64)
    pieces = codes.astype("<u4").tobytes().decode("utf-32-le")
    cut = np.flatnonzero(end_now)
    begin = np.concatenate([[0], cut[:-1] + 1])
    out = list(texts)
    for k in hit.tolist():
        new = pieces[begin[k] : cut[k]]
        if new != some[k]:
            out[rows[k]] = new
            changed[rows[k]] = True
    return out, changed


def normalise_fields(df: DataFrame, id_cols: list[str], fields: dict[str, bool], only_changed: bool = False) -> DataFrame:
    """One row per record and field: ids, ``field``, ``form`` (the consistent form) and ``changed``.

    ``fields`` maps a text column to whether it is an identifier, held to ASCII.
    Narrow: no shuffle; ``only_changed`` returns changed rows alone.
    """
    names = list(fields)
    source = df.select(*id_cols, *[F.col(c).alias(f"__{c}") for c in names])
    k_ids = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, name in enumerate(names):
                texts = batch.column(k_ids + j).to_pylist()
                lengths = np.fromiter((len(x) if x else 0 for x in texts), np.int64, len(texts))
                for a, b in cp.slices(lengths, BATCH_CHARS):
                    form, changed = normalise(texts[a:b], fields[name])
                    keep = np.flatnonzero(changed) if only_changed else np.arange(b - a)
                    at = pa.array(keep + a)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(at) for k in range(k_ids)], pa.array([name] * len(keep), pa.string()), pa.array([form[k] for k in keep], pa.string()), pa.array(changed[keep])],
                        names=[*id_cols, "field", "form", "changed"],
                    )

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:k_ids])
    return source.mapInArrow(run, f"{schema}, field string, form string, changed boolean")
