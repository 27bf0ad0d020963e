"""Text quality statistics per document, with fixed-threshold rules and a kind.

All figures come from array operations over whole Arrow batches: characters,
space-separated tokens and lines are counted by gathers and segmented sums.
Line statistics are the shares of characters in list entries, table rows and
lines without sense.

Fixed thresholds on the figures are the rules; those that a document fails are
listed by name in ``failures``. The rules on word count, mean word length,
symbols, bullets, ellipses, alphabetic words and common words follow the
published ones for web text (Rae et al. 2021); the others are this module's. A
document that fails one of the rules of ``KIND_RULES`` is no running prose: its
``kind`` is the one whose lines hold most characters, and ``reason`` names the
statistic that holds most of these, or the rule on words that makes all of it
junk.

Defined results: null and blank texts have no row; a text of one line is judged
as one line; ties between kinds go to junk, then table, then list; repeated
rows give repeated equal rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import codepoints as cp

# Frequent words of the languages; Chinese and Japanese are counted by character, Thai has no words to count.
COMMON = """
the of to and in a is for by at on that this be as or from was were are with any its shall must no not it an which has have been will under if
de la le les et du des à un une en que qui dans par pour sur au aux est ne pas se ou ce cette son sa
der die das und von zu den mit im am ist auf bei für nicht ein eine einer nach vom zum dem des wird wer es sind
i w z na do nie o oraz się przez od od dnia że jest za po przed kto ze
el los las del y al con se por para no lo una su es más
os da do dos das o e a ao com não em no na nos nas até um uma pelo
и в не на с по к из о что от для при или за у его как это до
के का की में है और से को पर यह ने कि हैं या एक
في من على أن إلى عن مع هذا هذه التي الذي أو ما لا كل
的 了 在 是 不 和 有 之 其 与 为 或 の は に を が と で し て た
"""
# Marks that open a list entry.
BULLETS = "•-–—*·●▪◦‣○■□▸►✓"

#: Share of a document's characters that decides its kind.
DECISIVE = 0.5
#: Longest list entry and table row cell count rule.
ENTRY_CHARS, ROW_SEPARATORS = 140, 2
#: Least share of a line's characters in plausible words, and most in broken single letters.
WORDY, SINGLES, BROKEN_PAIRS = 0.35, 0.45, 0.10
#: Bounds of an unmarked list: entries, their mean and longest length.
PLAIN_LINES, PLAIN_MEAN, PLAIN_LONGEST = 4, 70, 110
#: Repetition: so few distinct words among at least so many.
FEW_WORDS, MANY_WORDS = 12, 24
#: Published thresholds.
WORDS_MIN, WORDS_MAX, MEAN_WORD_MIN, MEAN_WORD_MAX = 50, 100_000, 3.0, 10.0
SYMBOL_MAX, BULLET_MAX, ELLIPSIS_MAX, ALPHA_MIN, COMMON_MIN = 0.1, 0.9, 0.3, 0.8, 2

KINDS = ("list", "table", "junk")
#: Rules of which a document that is no running prose fails one at least.
KIND_RULES = ("not_prose", "repetition", "gibberish")
#: What makes lines no prose, by kind.
REASONS = {"list": ("marked_entries", "plain_entries"), "table": ("cells",), "junk": ("broken_encoding", "spaced_letters", "senseless_lines")}
BATCH_CHARS = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "n_words long, n_distinct_words long, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines long, bullet_share double, ellipsis_share double,"
    " end_punct_share double, alpha_word_share double, common_word_share double, list_share double, table_share double, junk_share double, kind string, reason string, failures array<string>"
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(cp.LIMIT + 1, bool)
    out[[ord(c) for c in chars]] = True
    return out


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    kinds, fold = cp.class_table(), cp.fold_table()
    vowel = _mask("aeiouy")[np.minimum(fold, cp.LIMIT)]
    high = np.zeros(cp.LIMIT + 1, bool)
    high[0x80:0x250] = high[0x2010:0x2123] = True
    high[[0xA0, 0xFFFD, 0xAD]] = [False, True, False]
    high[0x201C:0x201F] = high[0x2018:0x201B] = False
    return {"kinds": kinds, "fold": fold, "vowel": vowel & ((kinds & cp.LETTER) > 0), "high": high, "bullet": _mask(BULLETS), "close": _mask("\"'”’»)]」』“"), "term": _mask(".!?…。！？।؟:;"), "end": _mask(".!?…。！？।؟")}


@functools.cache
def _common_hashes() -> np.ndarray:
    out = []
    for w in COMMON.split():
        h = 0
        for k, c in enumerate(cp.fold_word(w)):
            h = (h + (c + 1) * pow(int(_M), k + 1, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
        out.append(h)
    return np.unique(np.array(out, np.uint64))


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _M, np.uint64))


def _sums(flags: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags.astype(np.int32), heads) if len(heads) else np.zeros(0, np.int32)


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Figures of each text as arrays; ``blank`` marks texts without any."""
    t = _tables()
    codes, starts = cp.join_codes(texts, "\n")
    codes = cp.clip(codes)
    kind = t["kinds"][codes]
    n = len(codes)
    n_docs = len(texts)
    doc_end = starts[1:] - 1
    newline = codes == 10
    newline[doc_end] = True
    hidden = (kind & cp.HIDDEN) > 0
    space = (kind & cp.SPACE) > 0
    letter = (kind & cp.LETTER) > 0
    digit = (kind & cp.DIGIT) > 0
    cased = (kind & (cp.UPPER | cp.LOWER)) > 0
    caseless = ((kind & cp.CASELESS) > 0) | ((kind & cp.MARK) > 0) & ~hidden
    solid = ~space & ~hidden

    # Lines: head at the first character after a newline; the newline closes it.
    line_end = np.flatnonzero(newline)
    line_head = np.concatenate([[0], line_end[:-1] + 1])
    line_doc = np.searchsorted(starts, line_head, "right") - 1
    n_solid = _sums(solid, line_head)
    full = n_solid > 0

    # Tokens: runs between spaces.
    tok_char = solid | hidden & ~space
    tok_char[newline] = False
    edge = np.flatnonzero(tok_char[1:] & ~tok_char[:-1]) + 1
    tok = np.concatenate([[0], edge]) if tok_char[0] else edge
    tok_line = np.searchsorted(line_end, tok)
    tok_doc = line_doc[tok_line]
    after = np.append(tok[1:], n)
    # Segmented sums over [tok, next tok) hold the spaces between, which count nothing.
    s = lambda f: _sums(f & tok_char, tok)
    t_len, t_cased, t_caseless, t_digit = s(solid), s(cased), s(caseless), s(digit)
    t_vowel = s(t["vowel"][codes])
    other_in = t_len - t_cased - t_caseless - t_digit
    latin = t_cased > 0
    # A plausible word: letters with little else, a vowel, not endless, digits apart.
    word = ((t_cased >= 2) & (t_vowel > 0) | (t_cased == 2) & (t_digit == 0)) & (t_digit == 0) & (t_len <= 30) & (other_in <= np.maximum(2, t_len // 3))
    upper_in = s((kind & cp.UPPER) > 0)
    mixed = (upper_in > 1) & (upper_in < t_cased) & (t_cased > 6)
    word &= ~mixed
    word |= (t_caseless > 0) & (t_caseless >= t_len * 0.25)
    single = (t_len == 1) & (t_cased == 1)
    per_line = lambda w: np.bincount(tok_line, w, len(line_head))
    l_tokens, l_word_chars = per_line(None), per_line(np.where(word, t_len, 0))
    l_latin, l_single = per_line(latin), per_line(single)
    l_digit_chars = per_line(t_digit)

    # Words as letters only, folded, for common words and repetition.
    fold = t["fold"][codes].astype(np.uint64)
    w_char = letter | (kind & cp.MARK).astype(bool)
    big = (kind & (cp.CJK | cp.THAI)) > 0
    w_char &= ~newline
    w_edge = w_char & ~np.concatenate([[False], w_char[:-1]]) | w_char & big
    w_head = np.flatnonzero(w_edge)
    if len(w_head):
        gap = np.flatnonzero(w_char)
        owner = np.cumsum(w_edge)[gap] - 1
        place = np.minimum(gap - w_head[owner], 63)
        w_hash = np.zeros(len(w_head), np.uint64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        w_hash = np.add.reduceat((fold[gap] + np.uint64(1)) * _powers(64)[place], first)
        w_len = np.bincount(owner, minlength=len(w_head))
        w_doc = np.searchsorted(starts, w_head, "right") - 1
        table = _common_hashes()
        common = table[np.minimum(np.searchsorted(table, w_hash), len(table) - 1)] == w_hash
        w_latin = (kind[w_head] & cp.LATIN) > 0
        n_words = np.bincount(w_doc, minlength=n_docs)
        n_latin = np.bincount(w_doc, w_latin, n_docs)
        n_common = np.bincount(w_doc, common, n_docs)
        word_chars = np.bincount(w_doc, w_len, n_docs)
        key = w_hash * np.uint64(n_docs + 1) + w_doc.astype(np.uint64)
        distinct = np.bincount((w_doc[np.unique(key, return_index=True)[1]]), minlength=n_docs)
        vowelless = np.bincount(w_doc, w_latin & (w_len >= 3) & (np.add.reduceat(t["vowel"][codes[gap]].astype(np.int32), first) == 0), n_docs)
        longer = np.bincount(w_doc, w_latin & (w_len >= 3), n_docs)
    else:
        n_words = n_latin = n_common = word_chars = distinct = vowelless = longer = np.zeros(n_docs)

    # Figures of lines.
    first_tok = np.searchsorted(tok, line_head)
    first_tok = np.minimum(first_tok, max(len(tok) - 1, 0))
    has = full & (l_tokens > 0)
    lead = np.where(has, tok[first_tok] if len(tok) else 0, 0)
    lead_len = np.where(has, t_len[first_tok] if len(tok) else 0, 0)
    last_solid = np.maximum.accumulate(np.where(solid & ~newline, np.arange(n), 0))[line_end]
    tail = last_solid
    for _ in range(2):
        tail = np.where(t["close"][codes[tail]] & (tail > line_head), tail - 1, tail)
    ends_text = t["end"][codes[tail]] & full
    # Pairs of neighbouring characters that only a broken encoding puts together.
    high = t["high"][codes] | (codes == 0xFFFD)
    pair = high & np.concatenate([[False], high[:-1]])
    l_pair = _sums(pair, line_head)
    pipes, tabs, semis = _sums(codes == 124, line_head), _sums(codes == 9, line_head), _sums(codes == 59, line_head)
    commas = _sums(codes == 44, line_head)
    wide = space & ~newline & np.concatenate([[False], space[:-1] & ~newline[:-1]])
    wide &= ~np.concatenate([[False], wide[:-1]])
    # Two spaces after a sentence's end are typing, not a column.
    second = np.flatnonzero(wide)
    typed = ((kind[np.maximum(second - 2, 0)] & cp.TERM) > 0) & ~space[np.minimum(second + 1, n - 1)]
    wide[second[typed]] = False
    wides = _sums(wide, line_head)
    # Prose whose every space was doubled has no columns either.
    wides = np.where((wides >= 9) & (l_tokens < 1.3 * (wides + 1)), 0, wides)

    c0, c1 = codes[lead], codes[np.minimum(lead + 1, n - 1)]
    inner = codes[np.minimum(lead + np.maximum(lead_len - 1, 0), n - 1)]
    bullet = has & (lead_len == 1) & t["bullet"][c0] & (l_tokens > 1)
    short = lead_len <= 5
    numbered = has & short & (lead_len >= 2) & ((inner == 46) | (inner == 41)) & (l_tokens > 1) & (digit[lead] | (c0 == 40) | letter[lead] & (lead_len == 2) & ((inner == 41) | (kind[lead] & cp.LOWER).astype(bool)))
    head_mark = has & (c0 == 35) & ((c1 == 35) | (c1 == 32))
    marked = (bullet | numbered) & (n_solid <= ENTRY_CHARS)
    # A numbered line with no neighbour of its kind is a heading.
    real = np.flatnonzero(full)
    near = np.zeros(len(real), bool)
    pairs = marked[real[1:]] & marked[real[:-1]] & (line_doc[real[1:]] == line_doc[real[:-1]])
    near[1:] |= pairs
    near[:-1] |= pairs
    entry = marked.copy()
    entry[real] &= near

    # Lines that would have taken the next line's first word were not wrapped.
    doc_line = np.arange(len(line_head))
    nxt = np.minimum(doc_line + 1, len(line_head) - 1)
    prev = np.maximum(doc_line - 1, 0)
    with_next = full & full[nxt] & (line_doc[nxt] == line_doc) & (nxt != doc_line)
    with_prev = full & full[prev] & (line_doc[prev] == line_doc) & (prev != doc_line)
    paragraph = np.cumsum(~with_prev) - 1
    length = line_end - line_head
    width = np.zeros(paragraph[-1] + 1 if len(paragraph) else 0, np.int64)
    np.maximum.at(width, paragraph, length)
    next_len = lead_len[nxt]
    loose = with_next & (length + 1 + next_len <= width[paragraph] - 2)
    lines_in = np.bincount(paragraph, full)
    loose_in = np.bincount(paragraph, loose)
    first_kind = kind[lead]
    starts_low = (first_kind & cp.LOWER) > 0
    fragment = full & (~ends_text | starts_low) & ~head_mark & (n_solid <= ENTRY_CHARS)
    fragments_in = np.bincount(paragraph, fragment)
    # An unmarked list: several unwrapped lines of which most are no sentences.
    stop = ((kind & cp.TERM) > 0) & ~newline
    inside = stop[:-2] & space[1:-1] & ((kind[2:] & cp.UPPER) > 0) if n > 2 else np.zeros(0, bool)
    inside_in = np.bincount(paragraph, _sums(np.concatenate([inside, np.zeros(n - len(inside), bool)]), line_head))
    mean_in = np.bincount(paragraph, length * full) / np.maximum(lines_in, 1)
    plain_list = (lines_in >= PLAIN_LINES) & (loose_in >= 0.4 * (lines_in - 1)) & (fragments_in >= 0.5 * lines_in) & (mean_in <= PLAIN_MEAN) & (width <= PLAIN_LONGEST) & (inside_in <= 0.1 * lines_in)
    plain = full & plain_list[paragraph] & ~head_mark & (n_solid <= ENTRY_CHARS)

    wordy = l_word_chars / np.maximum(n_solid, 1)
    row = full & ((pipes >= ROW_SEPARATORS) | (tabs >= ROW_SEPARATORS) | (wides >= ROW_SEPARATORS) | (semis >= 3) & ~ends_text | (commas >= 3) & ~ends_text & (lines_in[paragraph] >= 3) & (loose_in[paragraph] >= 0.4 * (lines_in[paragraph] - 1)))
    # A single gap makes a row where most neighbours have one too.
    one = full & ((wides == 1) | (tabs == 1) | (pipes == 1))
    one_in = np.bincount(paragraph, one)
    row |= one & (lines_in[paragraph] >= 3) & (one_in[paragraph] >= 0.6 * lines_in[paragraph]) & (length <= ENTRY_CHARS)
    broken = full & (l_pair > BROKEN_PAIRS * n_solid) & (n_solid >= 8)
    spaced = full & (l_latin >= 10) & (l_single > SINGLES * l_latin)
    no_text = full & (n_solid >= 8) & (_sums((letter | digit | caseless) & ~newline, line_head) < WORDY * n_solid)
    strong = (pipes >= ROW_SEPARATORS) | (tabs >= ROW_SEPARATORS) | (semis >= 3)
    hexes = row & ~strong & (wordy < WORDY) & (l_tokens >= 8) & (n_solid <= 3.5 * l_tokens)
    senseless = full & (wordy < WORDY) & ~row & (n_solid >= 8) | hexes | no_text
    dump = full & (wordy < 0.2) & ~row & ~entry
    junk_line = broken | spaced | senseless & ~entry | dump & (n_solid >= 8)
    table_line = row & ~junk_line
    list_line = (entry | plain) & ~junk_line & ~table_line

    by_doc = lambda w: np.bincount(line_doc, np.where(full, w, 0), n_docs)
    chars = by_doc(n_solid)
    causes = {
        "marked_entries": entry & list_line, "plain_entries": list_line & ~entry, "cells": table_line,
        "broken_encoding": broken, "spaced_letters": spaced & ~broken, "senseless_lines": junk_line & ~broken & ~spaced,
    }
    safe = np.maximum(chars, 1)
    junk, rows, items = by_doc(n_solid * junk_line) / safe, by_doc(n_solid * table_line) / safe, by_doc(n_solid * list_line) / safe
    repeats = (n_words >= MANY_WORDS) & ((distinct <= FEW_WORDS) | (distinct <= 30) & (n_words >= 25 * distinct))
    gibberish = (longer >= 10) & (vowelless > 0.5 * longer) | (n_latin >= 40) & (n_latin > 0.9 * n_words) & (n_common < 0.01 * n_latin) & (rows + items < DECISIVE)
    junk = np.where(repeats | gibberish, 1.0, junk)
    rows, items = np.where(junk >= 1, 0, rows), np.where(junk >= 1, 0, items)
    none = junk + rows + items > DECISIVE
    choice = np.where((junk >= rows) & (junk >= items), 2, np.where(rows >= items, 1, 0))
    parts = {name: by_doc(n_solid * line) for name, line in causes.items()}
    reason = np.full(n_docs, None, object)
    for k, of in enumerate(KINDS):
        mine = np.flatnonzero(none & (choice == k))
        most = np.stack([parts[x][mine] for x in REASONS[of]]).argmax(0)
        reason[mine] = np.array(REASONS[of], object)[most]
    reason[none & gibberish], reason[none & repeats] = "gibberish", "repetition"
    n_lines = np.bincount(line_doc, full, n_docs)
    lines = np.maximum(n_lines, 1)
    ellipsis = (codes[last_solid] == 0x2026) | (codes[last_solid] == 46) & (codes[np.maximum(last_solid - 1, 0)] == 46)
    tokens = np.bincount(tok_doc, minlength=n_docs)
    alpha = np.bincount(tok_doc, (t_cased + t_caseless) > 0, n_docs) / np.maximum(tokens, 1)
    hash_marks = _sums(codes == 35, line_head)
    symbols = by_doc(hash_marks) + np.bincount(line_doc, ellipsis & full, n_docs)
    return {
        "blank": chars == 0, "n_words": n_words.astype(np.int64), "n_distinct_words": distinct.astype(np.int64), "mean_word_length": word_chars / np.maximum(n_words, 1), "symbol_ratio": symbols / np.maximum(n_words, 1),
        "digit_ratio": np.bincount(tok_doc, t_digit, n_docs) / safe, "n_lines": n_lines.astype(np.int64), "bullet_share": np.bincount(line_doc, bullet, n_docs) / lines, "ellipsis_share": np.bincount(line_doc, ellipsis & full, n_docs) / lines,
        "end_punct_share": np.bincount(line_doc, ends_text, n_docs) / lines, "alpha_word_share": alpha, "common_word_share": n_common / np.maximum(n_words, 1), "n_common": n_common,
        "list_share": items, "table_share": rows, "junk_share": junk, "kind": np.where(none, choice, -1), "reason": reason, "not_prose": none, "repeats": repeats, "gibberish": gibberish, "n_latin": n_latin,
    }


def failures(s: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    """Each rule's name and the texts that fail it."""
    return [
        ("too_few_words", s["n_words"] < WORDS_MIN), ("too_many_words", s["n_words"] > WORDS_MAX),
        ("short_words", s["mean_word_length"] < MEAN_WORD_MIN), ("long_words", s["mean_word_length"] > MEAN_WORD_MAX),
        ("symbols", s["symbol_ratio"] > SYMBOL_MAX), ("bullets", s["bullet_share"] > BULLET_MAX), ("ellipses", s["ellipsis_share"] > ELLIPSIS_MAX),
        ("few_alphabetic_words", s["alpha_word_share"] < ALPHA_MIN), ("few_common_words", s["n_common"] < COMMON_MIN),
        ("not_prose", s["not_prose"]), ("repetition", s["repeats"]), ("gibberish", s["gibberish"]),
        ("mostly_list", s["list_share"] > DECISIVE), ("mostly_table", s["table_share"] > DECISIVE), ("mostly_junk", s["junk_share"] > DECISIVE),
    ]


def not_prose(figures: DataFrame) -> DataFrame:
    """The documents that fail a rule on kinds of text, with the rules they fail."""
    rules = F.array(*map(F.lit, KIND_RULES))
    return figures.where(F.arrays_overlap("failures", rules)).withColumn("failed", F.array_intersect("failures", rules))


def text_quality(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """One row of figures per text that is not blank; a narrow operator without shuffle."""
    source = df.where(F.col(text_col).isNotNull()).select(*id_cols, F.col(text_col).alias("__text"))
    k_ids = len(id_cols)
    fields = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(k_ids).to_pylist()
            for a, b in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_CHARS):
                s = statistics(texts[a:b])
                keep = np.flatnonzero(~s["blank"])
                rules = failures(s)
                why = pa.array([[name for name, bad in rules if bad[k]] for k in keep], pa.list_(pa.string()))
                kinds = pa.array([None if k < 0 else KINDS[k] for k in s["kind"][keep]], pa.string())
                cols = [pa.array(s[f][keep]) for f in fields[:-3]]
                reasons = pa.array(s["reason"][keep].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(keep + a)) for k in range(k_ids)], *cols, kinds, reasons, why], names=[*id_cols, *fields])

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:k_ids])
    return source.mapInArrow(run, f"{schema}, {SCHEMA}")
