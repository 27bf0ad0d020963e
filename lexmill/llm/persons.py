"""Names of people and companies as typed, taken apart into comparable pieces."""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

# Short forms of given names, and given names as such.
GIVEN = {
    "aleksandra": "ola olka", "alexander": "alex sandy al", "alejandro": "", "anna": "ania", "antonio": "toni", "barbara": "basia", "catherine": "cathy kate", "charles": "charlie", "concepcion": "concha conchita",
    "david": "dave", "dolores": "lola", "dorothy": "dot", "edward": "ed eddie ned ted", "elisabeth": "lisbeth elsbeth", "elizabeth": "liz beth eliza lizzie betty", "etienne": "", "francisco": "paco pancho", "frederic": "fred",
    "friederike": "rike", "genevieve": "ginette", "guillaume": "guy", "gunther": "", "helene": "", "henry": "harry", "ignacio": "nacho", "james": "jim jimmy", "jean-baptiste": "jb", "johannes": "hannes", "john": "jack johnny",
    "jose": "pepe", "jose luis": "pepe", "joseph": "joe", "jurgen": "", "katarzyna": "kasia", "katherine": "kathy", "krzysztof": "krzys", "lukasz": "", "malgorzata": "gosia", "margaret": "maggie peg peggy meg", "marie-claude": "mc",
    "michael": "mike", "oscar": "", "philippe": "", "richard": "dick rick", "robert": "bob rob bobby", "stanislaw": "staszek stach", "susannah": "sue sukie susan", "thomas": "tom tommy", "ulrike": "ulli uli", "veronique": "vero",
    "victoria": "vicky tori", "wilhelm": "willi", "william": "bill will billy", "wojciech": "wojtek", "zofia": "zosia",
}
# Titles before a name.
TITLES = frozenset("dr prof professor mr mrs ms me mme mlle m sir hon ing dipl mgr hab mec ra frau herr hr sr sra don doña dona d".split())
# Entries that stand for unnamed further authors.
OTHERS = frozenset(["et al", "et alii", "i in", "u a", "and others", "y otros", "et autres", "inni", "und andere", "e outros", "others"])
# Legal forms of companies in their spellings, without spaces and stops.
FORMS = {
    "inc": "inc incorporated", "corp": "corp corporation", "ltd": "ltd limited", "llc": "llc limitedliabilitycompany", "gmbh": "gmbh gesellschaftmbh gesellschaftmitbeschrankterhaftung", "sa": "sa societeanonyme spolkaakcyjna",
    "ltee": "ltee limitee", "spzoo": "spzoo spolkazoo spolkazograniczonaodpowiedzialnoscia", "plc": "plc publiclimitedcompany", "sarl": "sarl", "sas": "sas", "ag": "ag aktiengesellschaft", "llp": "llp", "bv": "bv", "nv": "nv", "sl": "sl", "spk": "spk",
    "spa": "spa societaperazioni", "srl": "srl", "oy": "oy oyj osakeyhtio", "ab": "ab aktiebolag", "aps": "aps", "pty": "pty ptyltd proprietarylimited", "kg": "kg kommanditgesellschaft", "gmbhcokg": "gmbhcokg", "lp": "lp limitedpartnership", "kk": "kk", "pte": "pte pteltd", "snc": "snc", "sca": "sca", "kft": "kft", "doo": "doo", "ooo": "ooo",
}
# Business words of companies and their short forms, without spaces and stops.
BUSINESS = {
    "assetmanagement": "assetmanagement assetmgmt assetmgt", "capitalpartners": "capitalpartners cappartners capptnrs", "distribution": "distribution distrib distr", "energy": "energy", "financialservices": "financialservices finsvcs finservices financialsvcs",
    "foods": "foods", "holdings": "holdings hldgs", "insurance": "insurance ins", "internationaltrading": "internationaltrading intltrading", "logistics": "logistics log", "mining": "mining", "realty": "realty", "shipping": "shipping shpg",
    "software": "software", "technologies": "technologies tech", "transport": "transport transp",
}


class Person(NamedTuple):
    surname: str
    given: str
    initial: str
    middle: str
    written: bool
    #: The surname with umlauts typed as two letters left so.
    spelled: str = ""


class Company(NamedTuple):
    core: str
    business: str
    serial: str
    form: str


def fold(text: str) -> str:
    """Lower case without marks, strokes and look-alikes."""
    text = unicodedata.normalize("NFKD", text.replace("ł", "l").replace("Ł", "L").replace("ø", "o").replace("Ø", "O").replace("ß", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def close(a: str, b: str) -> bool:
    """At most one letter replaced, left out, added or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (k + 1 < len(a) and a[k] == b[k + 1] and a[k + 1] == b[k] and a[k + 2 :] == b[k + 2 :])
    return a[k:] == b[k + 1 :]


@functools.cache
def _given_forms() -> dict[str, str]:
    out = {}
    for name, short in GIVEN.items():
        if " " not in name:
            out[name] = name
        for s in short.split():
            out.setdefault(s, name if " " not in name else name)
    out["luis"], out["joseluis"] = "luis", "jose luis"
    out["mariaclaude"] = out["marieclaude"] = "marie-claude"
    out["jeanbaptiste"] = "jean-baptiste"
    return out


@functools.lru_cache(1 << 16)
def given_name(word: str) -> str | None:
    """The full given name a typed word stands for, if it is one."""
    forms = _given_forms()
    if word in forms:
        return forms[word]
    if len(word) >= 4:
        near = sorted({full for form, full in forms.items() if len(form) >= 4 and close(form, word)})
        if near:
            return near[0]
    return None


def _stands_out(lengths: list[int]) -> bool:
    """One word is much longer than the others, as surnames are beside misspelt given names."""
    *_, second, first = sorted([0, *lengths])
    return first >= 9 and first >= second + 3


def _clean(typed: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[​-‏⁠﻿­\"“”„]", "", typed)).strip()


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:[-'’‑][^\W\d_]+)*", text)


def _low(word: str) -> str:
    return fold(word).replace("’", "'").replace("‑", "-")


def _untitled(ws: list[str]) -> list[str]:
    while len(ws) > 1 and _low(ws[0]) in TITLES and len(ws[0]) > 1:
        ws = ws[1:]
    return ws


def name_parts(typed: str) -> tuple[list[str], list[str], list[str]]:
    """Folded words that a comma tells to be surnames, those it tells to be given names, and those it does not tell."""
    front, _, back = _clean(typed).partition(",")
    first, second = [[_low(w) for w in _untitled(_words(x)) if len(_low(w).replace("-", "")) > 2] for x in (front, back)]
    if _words(back):
        return first, second, []
    return [], [], first if len(_words(front)) > 1 else []


@functools.lru_cache(1 << 17)
def parse_person(typed: str, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> Person | None:
    """Surname, full given name if written out, initials; None for unnamed others and blanks.

    ``given`` and ``family`` are those of its words that other names show to be such.
    """
    text = _clean(typed)
    plain = re.sub(r"[^\w]+", " ", fold(text)).strip()
    if not plain or plain in OTHERS:
        return None
    front, comma, back = text.partition(",")
    words, low, strip = _words, _low, _untitled
    is_given = lambda w: w in given or w not in family and given_name(w) is not None

    if comma and words(back):
        last, rest = strip(words(front)), words(back)
    else:
        ws = strip(words(front))
        if len(ws) == 1:
            last, rest = ws, []
        else:
            shouted = [k for k, w in enumerate(ws) if len(w) > 3 and w.isupper()]
            long = [k for k, w in enumerate(ws) if len(low(w).replace("-", "")) > 2]
            names = [k for k in long if not is_given(low(ws[k]))]
            known = [k for k in names if low(ws[k]) in family]
            names = known if len(known) == 1 else names
            if shouted and len(shouted) < len(long):
                pick = shouted[0]
            elif len(names) == 1:
                pick = names[0]
            elif names and (len(names) < len(long) or _stands_out([len(ws[k]) for k in names])):
                pick = max(names, key=lambda k: (len(ws[k]), k))
            elif long:
                pick = long[-1]
            else:
                pick = max(range(len(ws)), key=lambda k: len(ws[k]))
            last, rest = [ws[pick]], [w for k, w in enumerate(ws) if k != pick]
    # Umlauts are also typed as two letters.
    spelled = "".join(low(w) for w in last).replace("-", "").replace("'", "")
    surname = re.sub("([aou])e", r"\1", spelled)
    rest = [low(w) for w in rest if low(w) not in TITLES or len(w) == 1]
    if not rest:
        return Person(surname, "", "", "", False, spelled)
    full = [w for w in rest if len(w.replace("-", "")) > 2 or given_name(w) and len(w) > 1 and "-" not in w]
    full = [w for w in full if not re.fullmatch(r"[a-z](-[a-z])+", w)]
    if full:
        names = [given_name(w) or w for w in full]
        first = names[0]
        if first == "jose luis" or names[:2] == ["jose", "luis"]:
            first, names = "jose luis", names[2:] if names[:2] == ["jose", "luis"] else names[1:]
        elif len(full) > 1 and given_name("".join(full)) in ("jean-baptiste", "marie-claude", "jose luis"):
            first, names = given_name("".join(full)), []
        else:
            names = names[1:]
        short = [w[0] for w in rest if len(w) == 1]
        return Person(surname, first, first[0], short[0] if short else "", True, spelled)
    letters = [c for w in rest for c in re.findall(r"[a-z]", w)]
    return Person(surname, "", letters[0] if letters else "", "".join(letters[1:2]), False, spelled)


@functools.cache
def _spellings(which: str) -> list[tuple[str, str]]:
    table = FORMS if which == "form" else BUSINESS
    return sorted(((s, name) for name, forms in table.items() for s in forms.split()), key=lambda x: -len(x[0]))


def _tail(text: str, which: str, least: int = 5) -> tuple[str, str]:
    """Text without the form or business word it ends with, and that word."""
    for s, name in _spellings(which):
        if text.endswith(s) and len(text) > len(s):
            return text[: -len(s)], name
    for s, name in _spellings(which):
        if len(s) >= least:
            for n in (len(s), len(s) - 1, len(s) + 1):
                if len(text) > n and close(text[-n:], s):
                    return text[:-n], name
    return text, ""


def _head(text: str, least: int = 5) -> tuple[str, str]:
    for s, name in _spellings("business"):
        if len(s) >= least and text.startswith(s) and len(text) > len(s) + 2:
            return text[len(s) :], name
    for s, name in _spellings("business"):
        if len(s) >= least:
            for n in (len(s), len(s) - 1, len(s) + 1):
                if len(text) > n + 2 and close(text[:n], s):
                    return text[n:], name
    return text, ""


@functools.lru_cache(1 << 17)
def parse_company(typed: str) -> Company | None:
    """Core name, business word, serial number and legal form; '' where missing."""
    text = fold(re.sub(r"[​-‏⁠﻿­\"“”„]", "", typed))
    text = re.sub(r"\s+", " ", text).strip()
    serial = ""
    m = re.search(r"(?:\(\s*(\d{1,3})\s*\)|\bn[o°º]?\.?\s*(\d{1,3})\b)", text)
    if m:
        serial = (m.group(1) or m.group(2)).lstrip("0")
        text = text[: m.start()] + " " + text[m.end() :]
    text = re.sub(r"^the\s+", "", text.strip())
    squeezed = re.sub(r"[^a-z0-9]", "", text)
    if not squeezed:
        return None
    words = [re.sub(r"[^a-z0-9]", "", w) for w in re.split(r"[\s,]+", text)]
    words = [w for w in words if w]
    # The legal form is the longest run of closing words that spells one, else with a typing error.
    form, body = "", words
    for exact in (True, False):
        for n in (5, 4, 3, 2, 1):
            if len(words) > n and not form:
                tail = "".join(words[-n:])
                form = next((name for s, name in _spellings("form") if tail == s or not exact and len(s) >= 6 and close(tail, s)), "")
                if form:
                    body = words[:-n]
    # The business word stands at either end, as whole words, or run together with the name.
    core = business = ""
    for exact in (True, False):
        for n in (3, 2, 1):
            for side, rest in ((body[-n:], body[:-n]), (body[:n], body[n:])):
                if rest and not business:
                    word = "".join(side)
                    business = next((name for s, name in _spellings("business") if word == s or not exact and len(s) >= 5 and close(word, s)), "")
                    core = "".join(rest) if business else ""
    if not business:
        rest = "".join(body)
        core, business = _tail(rest, "business", 5)
        if not business:
            core, business = _head(rest)
    if business and len(core) < 3:
        core, business = "".join(body), ""
    return Company(core, business, serial, form)
