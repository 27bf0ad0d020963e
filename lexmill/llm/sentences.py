"""Sentence boundaries in any of the corpus languages and scripts.

The boundary rules are compiled into a finite transducer. Its input symbols are
the few characters that can matter: quotation marks and brackets, marks that
can end a sentence, and spaces between Thai letters. Its state says which
quotation or bracket is open; ``transducer.states_after`` runs it over chunks
of any length as composed state-transition functions. A mark emits a boundary
if nothing is open and its context class, found by array gathers from word
tables, allows one.

Defined results: null, empty and blank texts have no sentences; a text without
any boundary is one sentence; repeated rows give the same spans, returned once.
Spans are code-point offsets into the text as it stands.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import codepoints as cp
from lexmill.llm.transducer import states_after

# Words before whose full stop no sentence ends.
TITLES = """
sp z mr mrs ms dr prof capt col gen lt sgt hon rev st mme mlle mm me pr sr sra srta dra d dna eng exmo exma hr fr hrn frl ing dipl
mec hab mgr inz lek adw p pp pkt art arts ust lit par para paras § s ss cl cll sec sect sched ch chap vol no nos nr núm num pt fig figs
ex exh reg rn abs nr vgl ggf ca bzw sog z.b d.h u.a i.d.r z.t o.ä i.v.m i.e e.g cf approx appr aprox excl incl ref v vs c t al ed eds
págs pág pag cláus cláu apdo ap inc. zob por tj tzw sygn godz ok m.in np ul al nr poz rozdz tel proc im см п пп ст т.е т.д т.п г-н г-жа проф д-р
тыс руб млн млрд им ул д стр гл разд jan feb mar apr jun jul aug sep sept oct nov dec janv févr juil déc ene abr ago dic fev out dez
ดร พ.ศ د أ م डॉ श्री रु सं कु
"""
# Words whose full stop may also end the sentence.
ENDINGS = """
ltd inc corp co llc l.l.c plc llp esq jr sr. etc ff seq usw ss sq a.m p.m u.s u.k u.n e.u s.a s.l s.c n.v b.v s.p.a s.r.l s.a.s s.a.r.l
sp.k c.v r.l o.o e.k a.g k.g ltda ltée ltee soc gmbh oyj oy ab bros d.c
"""
# Words that begin sentences, for text where case says nothing.
STARTERS = """
the a an in as under save subject according nothing fees for interest see no it delivery neither where was has have is does did do which who
what this that these those if on at each any all unless when he she we they there however cf dr mr ms prof capt
la le les l un une à sous selon aux chaque qui rien quelle advenant voir il elle en dans pour si ce cette
der die das am vgl nach wer wird hat wir jede im bei das höhere
z od zob por według kto czy każda klauzula opłata odsetki pozostałe zgodnie aneks strony doręczenie w
el los las salvo según conforme cualquiera quién véase se o os segundo nos qualquer quem não queiram
с начиная остальные кто каждая проценты в сумма
"""
# Nouns that a single letter may close.
LETTERED = "schedule annexe annex appendix exhibit anlage anexo anexe allegato załącznik załącznika приложение приложения class klasse classe group part section clause tab annexes lot"
# Words before an ordinal number.
ORDINAL_AFTER = "am vom den der im zum dem das des bis ab beim"
# Month names after an ordinal number.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner"
# Words that carry a sentence on after a mark.
CARRY_ON = "and or but und oder et ou mais y e ni o i oraz lub и или а asked said"
# Thai openings that carry a statement on after a space, and Thai titles.
THAI_CARRY_ON = "และ หรือ แต่ ซึ่ง โดย เพื่อ ทั้งนี้ ของ"
THAI_TITLES = "นาย นาง นางสาว คุณ"
# Last two letters of the Thai month names.
THAI_MONTH_ENDS = "คม ยน ธ์"

#: Longest word of the tables; a longer one stands in none of them.
WORD = 16
#: Words that may precede the year's abbreviation in an opening date.
OPENING_DATE_WORDS = 5
#: Characters worked on at once.
BATCH_CHARS = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hash(points: Iterable[int]) -> int:
    """Hash of a word as the backward array scan computes it, last letter first."""
    h = 0
    for c in points:
        h = ((h + int(c) + 1) * int(_MULT)) & 0xFFFFFFFFFFFFFFFF
    return h


def _forward(words: str) -> np.ndarray:
    return np.unique(np.array([_hash(cp.fold_word(w)) for w in words.split()], np.uint64))


def _backward(words: Iterable[str]) -> np.ndarray:
    return np.unique(np.array([_hash(reversed(cp.fold_word(w))) for w in words], np.uint64))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


# Symbols of the transducer: an opener or closer of each kind, both, or the end of a text.
_LOW, _HIGH, _RIGHT, _ANGLE_O, _ANGLE_C, _CORNER_O, _CORNER_C, _PLAIN, _TICK_O, _TICK_C, _PAREN_O, _PAREN_C, _RESET, _HIGH_DEAD = range(14)
_OPEN_HIGH, _OPEN_LOW, _OPEN_ANGLE, _OPEN_CORNER, _OPEN_PLAIN, _OPEN_TICK, _OPEN_PAREN = range(1, 8)


@functools.cache
def _table() -> np.ndarray:
    t = np.tile(np.arange(8, dtype=np.uint8), (14, 1))
    t[_LOW, 0] = _OPEN_LOW
    t[_HIGH, 0] = _OPEN_HIGH
    t[_HIGH, _OPEN_LOW] = 0
    t[_HIGH_DEAD, _OPEN_LOW] = 0
    t[_RIGHT, _OPEN_HIGH] = t[_RIGHT, _OPEN_LOW] = 0
    t[_ANGLE_O, 0], t[_ANGLE_C, _OPEN_ANGLE] = _OPEN_ANGLE, 0
    t[_CORNER_O, 0], t[_CORNER_C, _OPEN_CORNER] = _OPEN_CORNER, 0
    t[_PLAIN, 0], t[_PLAIN, _OPEN_PLAIN] = _OPEN_PLAIN, 0
    t[_TICK_O, 0], t[_TICK_C, _OPEN_TICK] = _OPEN_TICK, 0
    t[_PAREN_O, 0], t[_PAREN_C, _OPEN_PAREN] = _OPEN_PAREN, 0
    t[_RESET, :] = 0
    return t


@functools.cache
def _symbols() -> np.ndarray:
    """int8 symbol per code point, -1 for characters that are none."""
    out = np.full(cp.LIMIT + 1, -1, np.int8)
    for chars, sym in (("„‚", _LOW), ("“", _HIGH), ("”", _RIGHT), ("«", _ANGLE_O), ("»", _ANGLE_C), ("「『", _CORNER_O), ("」』", _CORNER_C), ('"＂', _PLAIN), ("'‘’", _TICK_O), ("(（[", _PAREN_O), (")）]", _PAREN_C)):
        for c in chars:
            out[ord(c)] = sym
    return out


@functools.cache
def _member(chars: str) -> np.ndarray:
    out = np.zeros(cp.LIMIT + 1, bool)
    out[[ord(c) for c in chars]] = True
    return out


class _Runs:
    """Ends of runs of marked places, of any length, by binary search among the places that are not marked."""

    def __init__(self, marked: np.ndarray):
        self.free = np.flatnonzero(~marked)
        self.n = len(marked)

    def after(self, p: np.ndarray) -> np.ndarray:
        """The first place from ``p`` on that is not marked."""
        return np.append(self.free, self.n)[np.searchsorted(self.free, p)]

    def before(self, p: np.ndarray) -> np.ndarray:
        """The place after the last one up to ``p`` that is not marked."""
        return np.concatenate([[-1], self.free])[np.searchsorted(self.free, p, "right")] + 1


class Splitter:
    """Cut positions for batches of texts; ``guards`` adds abbreviations of a lexicon."""

    def __init__(self, guards: Iterable[str] = ()):
        self.classes, self.fold, self.symbols = cp.class_table(), cp.fold_table(), _symbols()
        extra = [g.strip().rstrip(".") for g in guards if g and g.strip().rstrip(".")]
        self.never = _backward([*TITLES.split(), *extra])
        self.maybe = _backward(ENDINGS.split())
        self.lettered = _backward(LETTERED.split())
        self.ordinal = _backward(ORDINAL_AFTER.split())
        self.et = _backward("et i y e".split())
        self.sp = _backward("sp e".split())
        self.starters, self.carry, self.months = _forward(STARTERS), _forward(CARRY_ON), _forward(MONTHS)
        self.thai_titles = _backward(THAI_TITLES.split())

    def _back(self, at: np.ndarray, runs: _Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, length and dots of the words that end just before ``at``."""
        h, live, p = np.zeros(len(at), np.uint64), np.arange(len(at)), at - 1
        head = np.where(at > 0, np.minimum(runs.before(at - 1), at), at)
        n = at - head
        dots = self.stops[at] - self.stops[head]
        for _ in range(WORD):
            ok = p >= head[live]
            live, p = live[ok], p[ok]
            if not len(live):
                break
            h[live] = (h[live] + self.folded[p] + np.uint64(1)) * _MULT
            p = p - 1
        h[n > WORD] = 0
        return h, n, dots

    def _ahead(self, at: np.ndarray) -> np.ndarray:
        h, live, p = np.zeros(len(at), np.uint64), np.arange(len(at)), at
        for _ in range(WORD):
            ok = (p < self.n) & ((self.kind[np.minimum(p, self.n - 1)] & cp.LETTER) > 0)
            live, p = live[ok], p[ok]
            if not len(live):
                break
            h[live] = (h[live] + self.folded[p] + np.uint64(1)) * _MULT
            p = p + 1
        return h

    def cuts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of every sentence, and the starts of the texts in the joined array."""
        raw, starts = cp.join_codes(texts)
        raw = cp.clip(raw)
        kinds = self.classes[raw]
        ends = starts[1:] - 1
        kinds[ends] = 0
        solid = np.flatnonzero((kinds & cp.SPACE) == 0)
        solid_kind = np.ones(len(raw), bool)
        solid_kind[ends] = False
        solid = solid[solid_kind[solid]]
        if not len(solid):
            none = np.zeros(0, np.int64)
            return none, none, none, starts
        # Characters that show nothing, and marks on Latin, Greek and Cyrillic letters, say nothing about boundaries.
        skip = ((kinds & cp.HIDDEN) > 0) | ((kinds & cp.MARK) > 0) & (raw < 0x370)
        self.where = np.flatnonzero(~skip)
        codes = raw[self.where]
        self.kind = kinds[self.where]
        self.n = len(codes)
        is_end = np.zeros(len(raw), bool)
        is_end[ends] = True
        is_end = is_end[self.where]
        self.folded = self.fold[codes].astype(np.uint64)
        cut = np.sort(self._boundaries(codes, is_end))
        cut = self.where[np.minimum(cut, self.n - 1)]
        edges = np.unique(np.concatenate([starts[:-1], cut, [len(raw)]]))
        first = np.searchsorted(solid, edges[:-1])
        last = np.searchsorted(solid, edges[1:]) - 1
        full = last >= first
        begin, end = solid[first[full]], solid[last[full]] + 1
        row = np.searchsorted(starts, begin, "right") - 1
        return row, begin - starts[row], end - starts[row], starts

    def _boundaries(self, codes: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        kind, n = self.kind, self.n
        at_most = lambda p: np.minimum(p, n - 1)
        k_at = lambda p: kind[np.clip(p, 0, n - 1)]
        c_at = lambda p: codes[np.clip(p, 0, n - 1)]
        letter = (kind & cp.LETTER) > 0
        word = letter | ((kind & (cp.DIGIT | cp.MARK)) > 0)
        dotted = word | (codes == 46) | (codes == 45)
        dotted_runs, word_runs = _Runs(dotted), _Runs(word)
        self.stops = np.concatenate([[0], np.cumsum(codes == 46)])
        spaces = _Runs(((kind & cp.SPACE) > 0) & ~is_end)

        # The transducer over quotation marks and brackets.
        sym = self.symbols[codes]
        sym[is_end] = _RESET
        ev = np.flatnonzero(sym >= 0)
        s = sym[ev].astype(np.int64)
        before, after = np.maximum(ev - 1, 0), at_most(ev + 1)
        tick = s == _TICK_O
        word_before = (word[before] & ~is_end[before]) & (ev > 0)
        joined = word_before & word[after]
        s[tick & word_before | tick & ((kind[before] & cp.SYMBOL) > 0) & ~word[after]] = _TICK_C
        keep = ~(tick & joined)
        ev, s = ev[keep], s[keep]
        row_end = ev[s == _RESET]
        mine = row_end[np.searchsorted(row_end, ev)]
        for opener, closers in ((_LOW, (_HIGH, _RIGHT)), (_HIGH, (_RIGHT,)), (_ANGLE_O, (_ANGLE_C,)), (_CORNER_O, (_CORNER_C,)), (_TICK_O, (_TICK_C,)), (_PAREN_O, (_PAREN_C,)), (_PLAIN, (_PLAIN,))):
            which = np.flatnonzero(s == opener)
            if len(which):
                close = np.append(ev[np.isin(s, closers)], n + 1)
                dead = close[np.searchsorted(close, ev[which], "right")] > mine[which]
                # A mark without a partner opens nothing; it may still close.
                if opener == _PLAIN:
                    continue
                s[which[dead]] = _HIGH_DEAD if opener == _HIGH else _PAREN_C if opener == _PAREN_O else _RIGHT if opener == _LOW else _TICK_C
        plain = np.flatnonzero(s == _PLAIN)
        if len(plain):  # the last of an odd number of straight marks opens nothing
            rows, counts = np.unique(mine[plain], return_counts=True)
            odd = rows[counts % 2 == 1]
            last = np.searchsorted(mine[plain], odd, "right") - 1
            s[plain[last]] = _TICK_C
        state = states_after(s, _table())
        prior = np.concatenate([[0], state[:-1]]).astype(np.uint8)
        closing = np.zeros(n, bool)
        closing[ev[(prior > 0) & (state == 0) & (s != _RESET)]] = True
        closing |= _member(")]}）】」』")[codes]

        # Marks that can end a sentence: the last of each run.
        term = (kind & cp.TERM) > 0
        i = np.flatnonzero(term)
        i = i[~term[at_most(i + 1)] | is_end[at_most(i + 1)]]
        out = []
        if len(i):
            first = _Runs(term).before(i)
            q = _Runs(closing).after(i + 1)
            # A closing angle mark may stand after a space.
            gap = (k_at(q) & cp.SPACE) > 0
            far = gap & (c_at(q + 1) == 0xBB) & closing[at_most(q + 1)]
            q = np.where(far, q + 2, q)
            closed = q > i + 1
            r = spaces.after(q)
            gap = r > q
            r = at_most(r)
            open_state = np.concatenate([[0], state])[np.searchsorted(ev, q - 1, "right")]
            x = r.copy()
            for _ in range(2):
                x = np.where(((k_at(x) & (cp.LETTER | cp.DIGIT)) == 0) & ((self.symbols[c_at(x)] >= 0) & (c_at(x) != 0x29) | _member("¿¡")[c_at(x)] | (x > r) & ((k_at(x) & cp.SPACE) > 0)) & ~is_end[at_most(x)], x + 1, x)
            x = at_most(x)
            nk, nc = kind[x], codes[x]
            opener = x > r
            upper, lower = (nk & cp.UPPER) > 0, (nk & cp.LOWER) > 0
            digit, caseless = (nk & cp.DIGIT) > 0, (nk & cp.CASELESS) > 0
            begins = upper | caseless | digit
            mark = codes[i]
            dot = (mark == 0x2E) | (mark == 0x2026) | (mark == 0xFF0E)
            full = _member("。！？।॥‼⁇⁈⁉｡")[mark]
            dots = (i - first + 1 > 1) & (codes[first] == 0x2E) | (mark == 0x2026)

            live = np.flatnonzero(begins & ~is_end[r] & (open_state == 0))
            i, first, q, r, x, closed, gap, nk, opener, upper, lower, digit, caseless, begins, mark, dot, full, dots, open_state = (a[live] for a in (i, first, q, r, x, closed, gap, nk, opener, upper, lower, digit, caseless, begins, mark, dot, full, dots, open_state))

            h, length, inner = self._back(first, dotted_runs)
            # Two sentences with nothing between them: the word is what follows the inner stop.
            h2, length2, _ = self._back(first, word_runs)
            at = first - length2 - 1
            apart = (inner > 0) & (length2 > 0) & (c_at(at) == 46) & ((k_at(first - 1) & cp.LETTER) > 0) & (((k_at(at - 1) & cp.DIGIT) > 0) | letter[np.maximum(at - 1, 0)] & letter[np.maximum(at - 2, 0)] & letter[np.maximum(at - 3, 0)])
            h, length, inner = np.where(apart, h2, h), np.where(apart, length2, length), np.where(apart, 0, inner)
            tok = first - length
            start_kind, last_kind = k_at(tok), k_at(first - 1)
            others = np.concatenate([[0], np.cumsum(((kind & cp.DIGIT) == 0) & (codes != 46))])
            number = (others[first] == others[tok]) & (length > 0) & ((last_kind & cp.DIGIT) > 0)
            single = (length == 1) & ((last_kind & cp.LETTER) > 0)
            gap_before = (k_at(tok - 1) & cp.SPACE) > 0
            prior_end = tok - 1 - (c_at(tok - 2) == 46)
            hp, _, _ = self._back(np.maximum(prior_end, 0), dotted_runs)
            at_start = (tok == 0) | is_end[np.clip(tok - 1, 0, n - 1)] | gap_before & is_end[np.clip(tok - 2, 0, n - 1)]
            low_first = self.folded[np.clip(first - 1, 0, n - 1)]

            never, maybe = _among(h, self.never), _among(h, self.maybe)
            spk = single & (low_first == ord("k")) & _among(hp, self.sp)
            ander = single & np.isin(low_first, (ord("s"), ord("n"))) & _among(hp, self.et)
            letters_dots = (inner > 0) & ((last_kind & cp.LETTER) > 0)
            maybe |= spk | ander
            never |= single & ~spk & ~ander & ~_among(hp, self.lettered)
            never |= letters_dots & ~maybe & (length <= 2 * inner + 3)
            never |= number & at_start
            never |= number & _among(hp, self.ordinal) & (length <= 2) & gap_before
            nh = self._ahead(x)
            never |= number & (length <= 2) & _among(nh, self.months)
            never &= ~maybe
            year = single & np.isin(low_first, (ord("r"), int(self.fold[ord("г")]))) & gap_before & ((k_at(tok - 2) & cp.DIGIT) > 0)
            never &= ~year

            # Text in capitals: only words that begin sentences tell a boundary.
            shout = ((k_at(x) & cp.UPPER) > 0) & ((k_at(x + 1) & cp.UPPER) > 0) & ((k_at(first - 1) & (cp.UPPER | cp.DIGIT)) > 0) & (((k_at(first - 2) & (cp.UPPER | cp.DIGIT)) > 0) | (inner > 0) | single)
            starter, carry = _among(nh, self.starters), _among(nh, self.carry)

            upper_next = upper | (opener & ~lower & ~digit)
            # A stop, by what follows.
            dot_ok = dots & upper_next | dot & ~dots & upper_next & ~never
            dot_ok &= ~(shout & (maybe | year | closed) & ~starter)
            dot_ok &= ~(shout & carry)
            wordy = (length >= 4) & ((last_kind & cp.LOWER) > 0) & ~never & ~maybe
            dot_ok |= dot & digit & gap & (wordy | closed)
            no_gap_ok = ((kind[at_most(x + 1)] & (cp.LOWER | cp.CASELESS)) > 0) | opener | (((kind[at_most(x + 1)] & cp.SPACE) > 0) | _member("'’")[c_at(x + 1)]) & (length >= 3)
            dot_ok &= gap | closed | caseless | no_gap_ok & ((length >= 2) | number)
            # Scripts without case.
            latin_before = (last_kind & (cp.LATIN | cp.CYRILLIC)) > 0
            plain_stop = np.where(latin_before, ~never & ~maybe & (length >= 3), ~never & (gap | ((nk & cp.CJK) > 0)) & ((length > 3) | number | closed | ((last_kind & cp.ARABIC) > 0) & (length > 1) | ((last_kind & (cp.LETTER | cp.DIGIT)) == 0)))
            plain_stop &= ~(number & ~gap)
            dot_ok = np.where(caseless & dot, plain_stop, dot_ok)
            # Exclamation and question marks.
            bang = ~dot & ~full & ((upper | caseless) | digit & gap) & ~(shout & closed & ~starter) & (gap | closed | upper | caseless)
            # Full-width marks end a sentence whatever follows, but for a quotation that the sentence reports.
            wide = full & ~(closed & (c_at(q) == 0x3068))
            yes = dot & dot_ok | bang | wide
            out = [q[yes & ~year]]
            open_dates = np.flatnonzero(yes & year)
            if len(open_dates):
                gaps = np.flatnonzero(((kind[1:] & cp.SPACE) > 0) & ((kind[:-1] & cp.SPACE) == 0)) + 1
                sure = np.unique(np.concatenate([[0], np.flatnonzero(is_end) + 1, out[0]]))
                p = tok[open_dates]
                begin = sure[np.searchsorted(sure, p, "right") - 1]
                words = np.searchsorted(gaps, p) - np.searchsorted(gaps, begin + 1)
                out.append(q[open_dates[(words > OPENING_DATE_WORDS) & ~carry[open_dates]]])

        # Thai: a space where a new statement begins.
        thai = (kind & cp.THAI) > 0
        if thai.any():
            s0 = np.flatnonzero(((kind & cp.SPACE) > 0) & ~is_end)
            s0 = s0[(s0 > 0) & ((kind[np.maximum(s0 - 1, 0)] & cp.SPACE) == 0)]
            r = at_most(spaces.after(s0 + 1))
            x = np.where(np.isin(codes[r], (0xAB, 0x201C, 0x201E, 0x22, 0xBF, 0xA1)), r + 1, r)
            x = np.where((k_at(x) & cp.SPACE) > 0, x + 1, x)
            x = at_most(x)
            prev_thai = thai[s0 - 1]
            h, length, _ = self._back(s0, word_runs)
            is_year = (length == 4) & (self.folded[np.maximum(s0 - 4, 0)] == ord("2")) & (self.folded[np.maximum(s0 - 3, 0)] == ord("5"))
            for k in range(1, 5):
                is_year &= (k_at(s0 - k) & cp.DIGIT) > 0
            month = np.zeros(len(s0), bool)
            for a, b in THAI_MONTH_ENDS.split():
                month |= (c_at(s0 - 6) == ord(b)) & (c_at(s0 - 7) == ord(a))
            is_year &= month & ((k_at(s0 - 5) & cp.SPACE) > 0)
            next_ok = thai[r] | ((kind[x] & cp.UPPER) > 0) | ((kind[x] & cp.CASELESS) > 0)
            carries = np.zeros(len(s0), bool)
            for w in THAI_CARRY_ON.split():
                same = np.ones(len(s0), bool)
                for k, ch in enumerate(w):
                    same &= c_at(r + k) == ord(ch)
                carries |= same
            # An open bracket or quotation holds its statements together.
            quiet = np.concatenate([[0], state])[np.searchsorted(ev, s0, "right")] == 0
            yes = (prev_thai & ~_among(h, self.thai_titles) | is_year) & next_ok & ~carries & ~is_end[r] & quiet
            out.append(s0[yes])
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@functools.cache
def splitter(guards: tuple[str, ...] = ()) -> Splitter:
    return Splitter(guards)


def lexicon_guards(lexicons: DataFrame) -> tuple[str, ...]:
    """Abbreviation guards of the lexicons, a table of one row per language.

    Patterns are not used: they split at semicolons and lack most languages.
    """
    rows = lexicons.select(F.explode("abbreviation_guards").alias("g")).where("g is not null").distinct().sort("g").collect()
    return tuple(r.g for r in rows)


def split_sentences(df: DataFrame, id_cols: list[str], text_col: str = "text", guards: tuple[str, ...] = ()) -> DataFrame:
    """One row per sentence: the id columns, ``sent_start`` and ``sent_end``.

    Narrow: no shuffle until the final removal of repeated rows, which moves
    ids and offsets only, never text.
    """
    source = df.where(F.col(text_col).isNotNull()).select(*id_cols, F.col(text_col).alias("__text"))
    names = [*id_cols, "sent_start", "sent_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(guards)
        for batch in batches:
            texts = batch.column(len(id_cols)).to_pylist()
            for a, b in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_CHARS):
                row, begin, end, _ = split.cuts(texts[a:b])
                ids = [batch.column(k).take(pa.array(row + a)) for k in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=names)

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[: len(id_cols)])
    return source.mapInArrow(run, f"{schema}, sent_start int, sent_end int").distinct()
