"""Language of documents and of one-language stretches by cross-parsing entropy.

A bounded sample of labelled text per language is cleaned of wrong labels and
made into one suffix automaton per language. A sentence is parsed greedily
against each automaton: a phrase is the longest match from its start, and the
language whose automaton needs the fewest phrases, normalised by the logarithm
of its training length, wins. All sentences of a batch are parsed in lock step
as array gathers, against all languages at once. Languages whose training text
is in another script than the sentence are no candidates, since every
character of it would be a phrase of its own; that count, one phrase a letter,
stands for all of them and for languages without any text.

Defined results: null and blank texts, and texts without letters, have no
language; sentences in a script of which no language has text are ``und``, with
confidence 0; a tie goes to the language of the label if that is among the best,
else to the first in alphabetical order; confidence is 1 - best / second, where
one phrase a letter is the last candidate.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.llm import codepoints as cp
from lexmill.llm.sentences import BATCH_CHARS, splitter

# Codes and names of each language.
NOTATIONS = {
    "ar": "ar ara arabic العربية",
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ja": "ja jpn japanese 日本語",
    "pl": "pl pol polish polski",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "th": "th tha thai ไทย ภาษาไทย",
    "zh": "zh zho chi chinese 中文 汉语 漢語",
}
CODES = {name: code for code, names in NOTATIONS.items() for name in names.split()}

#: Bound of the training sample: blocks drawn, and characters kept, of each language.
SAMPLE_ROWS = 700
TRAIN_CHARS = 24000
#: Cells of a table of next states; an alphabet that needs more is looked up by sorted keys, which takes a hundredth of the memory.
DENSE_CELLS = 1 << 25
#: Longest text taken into the sample, so that its size is bounded in bytes too.
SAMPLE_TEXT = 4000
#: Language of sentences in a script of which no language has text.
UNKNOWN = "und"
#: A script other than Latin decides if it has this share of a sentence's letters; names are often Latin.
SCRIPT_SHARE = 0.25
#: A language is in a document if it holds this share of the characters.
DOCUMENT_SHARE = 0.2
#: A sentence whose best language leads by less takes its neighbour's language if that is nearly as good.
WEAK_LEAD = 0.08

SCRIPTS = (cp.LATIN, cp.CYRILLIC, cp.GREEK, cp.ARABIC, cp.DEVANAGARI, cp.THAI, cp.CJK)


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any notation; null if it names no language."""
    low = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.split(low, "[-_]").getItem(0)))


@functools.cache
def _letters() -> np.ndarray:
    """Folded letter per code point: lower case, Latin look-alikes as Latin, marks kept; 0 for other characters."""
    kinds = cp.class_table()
    out = np.zeros(cp.LIMIT + 1, np.uint32)
    for c in np.flatnonzero((kinds & (cp.LETTER | cp.MARK)) > 0).tolist():
        low = chr(c).lower()
        if cp.CYRILLIC_LOOKS.get(chr(c)) or cp.GREEK_LOOKS.get(chr(c)):
            low = cp.LOOKS[chr(c)].lower()
        elif 0xFF21 <= c < 0xFF5B:
            low = chr(c - 0xFEE0).lower()
        out[c] = ord(low[0])
    return out


@functools.cache
def _script_index() -> np.ndarray:
    """Place in SCRIPTS plus one per code point, one more for letters of other scripts; 0 for other characters."""
    kinds = cp.class_table()
    out = np.where((kinds & cp.LETTER) > 0, len(SCRIPTS) + 1, 0).astype(np.uint8)
    for k, bit in enumerate(SCRIPTS):
        out[((kinds & bit) > 0) & ((kinds & (cp.LETTER | cp.MARK)) > 0)] = k + 1
    return out


def _edges(text: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a symbol list: the next state by symbol, for each state; 1 is the root, 0 none."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def automaton(text: list[int], size: int) -> np.ndarray:
    """Suffix automaton of a symbol list: ``out[state, symbol]`` is the next state, 0 none; 1 is the root."""
    nxt = _edges(text)
    out = np.zeros((len(nxt), size), np.int32)
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            out[s, c] = t
    return out


class Steps:
    """Next states of several automata, numbered on: an array for small alphabets, sorted keys for those of thousands of signs."""

    def __init__(self, texts: Iterable[list[int]], size: int):
        bases, keys, values, base = [], [], [], 0
        # One automaton at a time is held as dictionaries, which take much more room than their arrays.
        for text in texts:
            machine = _edges(text)
            n = sum(map(len, machine))
            state = np.repeat(np.arange(base, base + len(machine), dtype=np.int64), np.fromiter(map(len, machine), np.int64, len(machine)))
            keys.append(state * size + np.fromiter((c for e in machine for c in e), np.int64, n))
            values.append(np.fromiter((t for e in machine for t in e.values()), np.int64, n) + base)
            bases.append(base)
            base += len(machine)
            del machine
        self.bases = np.array(bases, np.int64)
        self.keys, self.values = np.concatenate(keys), np.concatenate(values).astype(np.int32)
        self.dense = None
        if base * size <= DENSE_CELLS:
            self.dense = np.zeros(base * size, np.int32)
            self.dense[self.keys] = self.values
        else:
            order = np.argsort(self.keys)
            self.keys, self.values = self.keys[order], self.values[order]

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """Next state of each ``state * size + symbol``, 0 for none."""
        if self.dense is not None:
            return self.dense[at]
        spot = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[spot] == at, self.values[spot], 0)


class Model:
    """Automata per script, built once in each worker from the bounded training text."""

    def __init__(self, texts: dict[str, str]):
        letters, scripts = _letters(), _script_index()
        self.by_script: dict[int, list[str]] = defaultdict(list)
        symbols = Counter()
        folded = {}
        for lang, text in sorted(texts.items()):
            raw = cp.clip(np.frombuffer(text.encode("utf-32-le"), np.uint32))
            counts = np.bincount(scripts[raw], minlength=len(SCRIPTS) + 2)
            script = self._script(counts[None, 1:])[0]
            self.by_script[int(script)].append(lang)
            folded[lang] = letters[raw]
            symbols.update(folded[lang].tolist())
        self.langs = sorted(texts)
        self.script_counts = scripts
        self.tables: dict[int, tuple] = {}
        for script, langs in self.by_script.items():
            used = Counter()
            for lang in langs:
                used.update(folded[lang].tolist())
            order = [c for c, _ in used.most_common() if c]
            of = np.full(cp.LIMIT + 1, 1, np.uint16)  # 1: a letter no language has
            known = np.zeros(cp.LIMIT + 1, np.uint16)
            for k, c in enumerate(order):
                known[c] = k + 2
            of = np.where(letters > 0, np.where(known[letters] > 0, known[letters], 1), 0).astype(np.uint16)
            size = len(order) + 2

            def sequence(lang: str) -> list[int]:
                seq = of[cp.clip(np.frombuffer(texts[lang].encode("utf-32-le"), np.uint32))]
                return seq[~((seq == 0) & (np.concatenate([[1], seq[:-1]]) == 0))].tolist()

            steps = Steps(map(sequence, langs), size)
            norm = np.array([math.log(max(len(texts[lang]), 2)) for lang in langs])
            self.tables[script] = (langs, of, size, steps, steps.bases, norm)

    @staticmethod
    def _script(counts: np.ndarray) -> np.ndarray:
        """Script of each row of letter counts, -1 for no letters."""
        total = counts.sum(1)
        other = counts[:, 1:].argmax(1) + 1
        share = counts[np.arange(len(counts)), other] / np.maximum(total, 1)
        return np.where(total == 0, -1, np.where(share >= SCRIPT_SHARE, other, 0))

    def phrases(self, script: int, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Phrases that each language of the script needs for each span; last, one for each letter and gap."""
        langs, of, size, table, bases, _ = self.tables[script]
        seq = of[codes]
        # Runs of characters that are no letters count as one.
        keep = np.ones(len(seq), bool)
        keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
        place = np.concatenate([[0], np.cumsum(keep)])
        seq = seq[keep].astype(np.int64)
        b, e = place[begin], place[end]
        order = np.argsort(b - e, kind="stable")
        b, n = b[order], (e - b)[order]
        count = np.zeros((len(langs), len(b)), np.int32)
        root = (bases + 1)[:, None]
        first = table(root * size + np.arange(size)[None, :])
        first = np.where(first == 0, root, first)
        state = np.repeat(root, len(b), 1)
        live = len(b)
        for t in range(int(n[0]) if len(n) else 0):
            while live and n[live - 1] <= t:
                live -= 1
            s = seq[b[:live] + t]
            state = state[:, :live]
            step = table(state * size + s)
            miss = step == 0
            count[:, :live] += miss
            state = np.where(miss, first[:, s], step).astype(np.int64)
        out = np.empty((len(b), len(langs) + 1), np.float64)
        out[order, :-1] = count.T + 1
        out[order, -1] = n
        return out

    def classify(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, hint: list[str | None]) -> tuple[np.ndarray, np.ndarray, list]:
        """Language of each span (index into ``langs``, -1 none, their number if no language has the script), its confidence, and the scores by script."""
        index = {lang: k for k, lang in enumerate(self.langs)}
        scripts = self.script_counts[codes]
        counts = np.zeros((len(begin), len(SCRIPTS) + 1), np.int64)
        for k in range(len(SCRIPTS) + 1):
            if k == 0 or (scripts == k + 1).any():
                total = np.concatenate([[0], np.cumsum(scripts == k + 1)])
                counts[:, k] = total[end] - total[begin]
        script = self._script(counts)
        lang, sure = np.where(script < 0, -1, len(self.langs)), np.zeros(len(begin))
        scores = np.full((len(begin), len(self.langs)), np.inf)
        for s in np.unique(script):
            which = np.flatnonzero(script == s)
            langs = self.by_script.get(int(s), [])
            if s < 0 or not langs:
                continue
            norm = self.tables[int(s)][5]
            got = self.phrases(int(s), codes, begin[which], end[which])
            letters = got[:, -1] * norm.mean()
            got = got[:, :-1] * norm[None, :]
            cols = np.array([index[x] for x in langs])
            scores[which[:, None], cols[None, :]] = got
            best = got.min(1)
            second = np.minimum(np.partition(got, 1, axis=1)[:, 1], letters) if len(langs) > 1 else letters
            second = np.maximum(second, best)
            lang[which] = cols[got.argmin(1)]
            sure[which] = 1 - best / second
            for k in np.flatnonzero(second == best).tolist():
                h = index.get(hint[which[k]] or "")
                if h is not None and scores[which[k], h] == best[k]:
                    lang[which[k]] = h
        return lang, sure, scores


@functools.lru_cache(4)
def model(texts: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(texts))


def _trigrams(s: str) -> Iterable[str]:
    s = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in s.lower()).split())} "
    return (s[k : k + 3] for k in range(len(s) - 2))


def clean_sample(rows: list[tuple[str, str]]) -> dict[str, str]:
    """Training text per language from (label, text) rows of which some labels are wrong.

    Trigram frequencies outvote the minority of wrong labels; sentences whose
    label they contradict are left out, twice.
    """
    split = splitter()
    kept: list[tuple[str, str]] = []
    for lang, text in rows:
        _, begin, end, _ = split.cuts([text])
        kept += [(lang, text[a:b]) for a, b in zip(begin, end)]
    number: dict[str, int] = {}
    grams = [[number.setdefault(g, len(number)) for g in _trigrams(s)] for _, s in kept]
    kept, grams = [k for k, g in zip(kept, grams) if g], [g for g in grams if g]
    langs = sorted({lang for lang, _ in kept})
    own = np.array([langs.index(lang) for lang, _ in kept], np.int64)
    sizes = np.array([len(g) for g in grams], np.int64)
    flat = np.array([x for g in grams for x in g], np.int64)
    of, first = np.repeat(np.arange(len(kept)), sizes), np.cumsum(sizes) - sizes
    good = np.ones(len(kept), bool)
    for _ in range(2 if len(kept) else 0):
        use = good[of]
        total = np.bincount(flat[use] * len(langs) + own[of[use]], minlength=len(number) * len(langs)).reshape(-1, len(langs))
        weight = np.log((total + 0.1) / (total.sum(0) + 2000))
        score = np.add.reduceat(weight[flat], first)
        good = score[np.arange(len(kept)), own] >= score.max(1)
    use = np.flatnonzero(good).tolist()
    out: dict[str, list[str]] = defaultdict(list)
    size: Counter = Counter()
    for k in use:
        lang, text = kept[k]
        if size[lang] < TRAIN_CHARS:
            out[lang].append(text)
            size[lang] += len(text)
    return {lang: "\n".join(parts) for lang, parts in out.items()}


def fit(blocks: DataFrame, label: str = "lang", text: str = "text", key: tuple[str, ...] = ("doc_id", "idx")) -> tuple[tuple[str, str], ...]:
    """Training text per language from at most about SAMPLE_ROWS labelled rows of each.

    The sample is drawn by a hash of the key, so it is the same in every run;
    its size does not grow with the table, and a rare language has as much as
    a frequent one where it has so many rows.
    """
    rows = blocks.select(label_code(F.col(label)).alias("l"), F.col(text).alias("t"), F.xxhash64(*key).alias("h")).where(F.col("l").isNotNull() & F.length("t").between(20, SAMPLE_TEXT))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ()
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, SAMPLE_ROWS / n) * (1 << 20)) + 1)])
    rows = rows.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("l"))).collect()
    rows.sort(key=lambda r: (r.l, r.h, r.t))
    budget: Counter = Counter()
    picked = []
    for r in rows:
        if budget[r.l] < 2 * TRAIN_CHARS:
            picked.append((r.l, r.t))
            budget[r.l] += len(r.t)
    return tuple(sorted(clean_sample(picked).items()))


def language_stretches(df: DataFrame, id_cols: list[str], trained: tuple[tuple[str, str], ...], text_col: str = "text", label_col: str = "lang", unknown: bool = True) -> DataFrame:
    """One row per stretch of neighbouring sentences in one language.

    Columns: the ids, ``label`` (two-letter code or null), ``seg_no``, ``lang``,
    ``seg_start``, ``seg_end``, ``n_chars`` and ``confidence``. Narrow. Without
    ``unknown`` sentences of no known language are passed over.
    """
    source = df.where(F.col(text_col).isNotNull()).select(*id_cols, label_code(F.col(label_col)).alias("__label"), F.col(text_col).alias("__text"))
    names = [*id_cols, "label", "seg_no", "lang", "seg_start", "seg_end", "n_chars", "confidence"]
    k_ids = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, m = splitter(), model(trained)
        lang_names = pa.array([*m.langs, UNKNOWN])
        for batch in batches:
            texts, labels = batch.column(k_ids + 1).to_pylist(), batch.column(k_ids).to_pylist()
            for a, b in cp.slices(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_CHARS):
                part = texts[a:b]
                row, begin, end, starts = split.cuts(part)
                if not len(row):
                    continue
                codes = cp.clip(cp.join_codes(part)[0])
                lang, sure, scores = m.classify(codes, starts[row] + begin, starts[row] + end, [labels[a + r] for r in row])
                # Weak sentences follow a neighbour that is nearly as good; those without letters follow any.
                first = np.concatenate([[True], row[1:] != row[:-1]])
                final = np.concatenate([row[1:] != row[:-1], [True]])
                weak = np.flatnonzero((sure < WEAK_LEAD) & (lang < len(m.langs)) & ~(first & final))
                for k in weak.tolist():
                    for other in ([k - 1] if not first[k] else []) + ([k + 1] if not final[k] else []):
                        near = lang[other]
                        if 0 <= near < len(m.langs) and (lang[k] < 0 or scores[k, near] <= scores[k].min() * (1 + WEAK_LEAD)):
                            lang[k] = near
                            break
                known = (lang >= 0) & (unknown | (lang < len(m.langs)))
                row, begin, end, lang, sure = row[known], begin[known], end[known], lang[known], sure[known]
                if not len(row):
                    continue
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])])
                head = np.flatnonzero(new)
                tail = np.concatenate([head[1:], [len(row)]]) - 1
                seg_row = row[head]
                opens = np.concatenate([[True], seg_row[1:] != seg_row[:-1]])
                number = np.arange(len(head)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
                weight = (end - begin).astype(np.float64)
                trust = np.add.reduceat(sure * weight, head) / np.add.reduceat(weight, head)
                at = pa.array(seg_row + a)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(at) for k in range(k_ids + 1)], pa.array(number.astype(np.int32)), lang_names.take(pa.array(lang[head])), pa.array(begin[head].astype(np.int32)), pa.array(end[tail].astype(np.int32)), pa.array((end[tail] - begin[head]).astype(np.int32)), pa.array(trust)],
                    names=names,
                )

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:k_ids])
    return source.mapInArrow(run, f"{schema}, label string, seg_no int, lang string, seg_start int, seg_end int, n_chars int, confidence double")


def document_languages(stretches: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Languages in each document in order of first appearance, with their share and confidence.

    ``stretches`` has each stretch once. Sums per document and language are
    taken before the shuffle, so a document with most of the rows is no hot group.
    """
    sums = stretches.groupBy(doc_col, "lang").agg(F.sum("n_chars").alias("n_chars"), F.min(F.struct("idx", "seg_no")).alias("__at"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("confidence"))
    w = Window.partitionBy(doc_col)  # at most one row per language
    shares = sums.withColumn("share", F.col("n_chars") / F.sum("n_chars").over(w)).where(F.col("share") >= DOCUMENT_SHARE)
    return shares.withColumn("seg_no", (F.row_number().over(w.orderBy("__at")) - 1).cast("int")).drop("__at")


def relabel(blocks: DataFrame, documents: DataFrame, cut) -> DataFrame:
    """Blocks and documents whose label is missing, wrong or hides a mix, with their languages.

    ``cut`` writes the stretches to the shared folder, as both halves read them.
    """
    seen = language_stretches(blocks, ["doc_id", "idx"], fit(blocks), unknown=False).dropDuplicates(["doc_id", "idx", "seg_no"])
    seen = cut(seen)
    several = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "idx")) > 1
    of_blocks = seen.withColumn("__several", several).where(F.col("label").isNull() | (F.col("label") != F.col("lang")) | F.col("__several"))
    of_blocks = of_blocks.select("doc_id", "idx", "seg_no", "lang", "confidence")
    langs = document_languages(seen)
    labels = documents.select("doc_id", label_code(F.col("lang")).alias("__label"))
    joined = langs.join(labels, "doc_id", "left")
    per_doc = Window.partitionBy("doc_id")
    hit = F.max((F.col("__label") == F.col("lang")).cast("int")).over(per_doc)
    count = F.count(F.lit(1)).over(per_doc)
    of_docs = joined.withColumn("__hit", F.coalesce(hit, F.lit(0))).withColumn("__n", count).where("__hit = 0 or __n > 1")
    of_docs = of_docs.select("doc_id", F.lit(-1).alias("idx"), "seg_no", "lang", "confidence")
    return of_blocks.unionByName(of_docs)
