"""Variant spellings of people and companies linked by merge-and-rematch resolution.

Each distinct name is parsed once, with what all other names tell about its
words (``forms``). Mentions that parse alike become one profile at once, so a
name with a third of all rows costs one profile per spelling. Then, round by
round:

* profiles are blocked by every spelling they hold and by each spelling with
  one letter left out, which finds every pair one typing error apart; pairs of
  spellings are found once, later rounds add those of new spellings alone; a
  spelling moves to the best of its blocks that is as frequent or more so, if
  that is far more frequent or their fields agree;
* the profiles under one name are merged where their given names, initials,
  affiliations, numbers, jurisdictions and legal forms agree, and the merged
  profile holds the union of them; only names that gained a profile are
  settled anew;
* merged profiles re-enter blocking with all their spellings, and with their
  registration numbers, until a round merges nothing.

Under a name, the profiles of one affiliation or number are settled first, each
affiliation apart. Profiles without one then meet the different sets of given
names, initials and jurisdictions that these have, not each of them, so a name
that many people share stays small.

A mention that fits several people of one name is left alone, unless another
record of the same work names one of them.

Defined results: null and blank names and entries for unnamed further authors
are no mentions; repeated rows count once; a null field agrees with any value;
ties go to the larger profile, then the smaller key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from lexmill.llm.forms import given_forms, word_hints
from lexmill.llm.persons import close, parse_company, parse_person

Cut = Callable[[DataFrame], DataFrame]


def _counted(df: DataFrame, cut: Cut) -> tuple[DataFrame, int]:
    """The table written, and its number of rows, counted as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


#: Without agreement, another spelling must stand this many times for each mention of this one but the first.
FREQUENT = 2
#: Letters of a shape from which it stands without an affiliation or number.
SHORT = 3
#: Letters of a given name from which one typing error is forgiven.
GIVEN_TYPO = 5
#: Mentions of an entity in one portion; larger entities are paired portion by portion, each a key of its own.
PORTION = 256

_PIECES = ["cls", "core", "ctx", "ini", "soft", "mid", "spelled"]


def _parse(kind: str, typed: str | None, what: str | None, given: frozenset, family: frozenset) -> tuple | None:
    """Class, comparable core, context, initial, soft field, middle initial and unfolded core of a mention."""
    if typed is None or not typed.strip():
        return None
    company = parse_company(typed) if kind == "party" else None
    is_company = kind == "party" and (what == "organisation" or what != "person" and company is not None and bool(company.form or company.business or company.serial))
    if is_company and company is not None:
        return ("party-o", company.core, f"{company.business}|{company.serial}", "", company.form, "", company.core)
    person = parse_person(typed, given, family)
    if person is None or not person.surname:
        return None
    return ("party-p" if kind == "party" else "author", person.surname, "", person.initial, person.given, person.middle, person.spelled)


def _clean(col):
    return F.nullif(F.trim(F.regexp_replace(F.lower(col), r"\s+", " ")), F.lit(""))


def mentions(parties: DataFrame, refs: DataFrame) -> DataFrame:
    """``kind, id, pos`` and the parsed pieces of every mention, each once."""
    p = parties.where("party_id IS NOT NULL").groupBy("party_id").agg(F.min(F.struct("name", "type", "reg_no", "jurisdiction")).alias("r"))
    p = p.select(F.lit("party").alias("kind"), F.col("party_id").alias("id"), F.lit(0).alias("pos"), F.col("r.name").alias("typed"), F.col("r.type").alias("what"), _clean(F.col("r.reg_no")).alias("strong"), _clean(F.col("r.jurisdiction")).alias("place"))
    one = refs.where("ref_id IS NOT NULL").dropDuplicates(["ref_id"])
    a = one.select(F.col("ref_id").alias("id"), F.posexplode("authors").alias("pos", "typed"), F.col("author_affils").alias("affils"))
    a = a.select(F.lit("author").alias("kind"), "id", "pos", "typed", F.lit(None).cast("string").alias("what"), _clean(F.get("affils", F.col("pos"))).alias("strong"), F.lit(None).cast("string").alias("place"))
    every = p.unionByName(a).where("typed IS NOT NULL").withColumn("what", F.coalesce("what", F.lit("")))

    @F.pandas_udf(", ".join(f"{c} string" for c in _PIECES))
    def parse(kind: pd.Series, typed: pd.Series, what: pd.Series, given: pd.Series, family: pd.Series) -> pd.DataFrame:
        none = (None,) * len(_PIECES)
        bag = lambda x: frozenset(x) if x is not None else frozenset()
        return pd.DataFrame([_parse(k, t, w, bag(g), bag(f)) or none for k, t, w, g, f in zip(kind, typed, what, given, family)], columns=_PIECES)

    # Each different name is parsed once.
    names = every.groupBy("kind", "typed", "what").agg(F.count(F.lit(1)).alias("n"))
    hints = word_hints(names.where("what <> 'organisation'").groupBy("typed").agg(F.sum("n").alias("n")))
    parsed = names.join(hints, "typed", "left").select("kind", "typed", "what", parse("kind", "typed", "what", "given", "family").alias("x")).select("kind", "typed", "what", "x.*").where("cls IS NOT NULL")
    return every.join(parsed, ["kind", "typed", "what"]).drop("typed", "what")


def _shapes(core):
    """The spelling itself and every form of it with one letter left out."""
    n = F.length(core)
    return F.array_distinct(F.concat(F.array(core), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.substring(core, F.lit(1), k - 1), F.substring(core, k + 1, n)))))


_BLOCK = ["cls", "ctx", "ini"]


def spelling_forms(names: DataFrame, places: DataFrame) -> DataFrame:
    """``cls, ctx, ini, form, at``: every spelling of every name, folded and as typed; short ones also once per affiliation or number."""
    forms = names.select(*_BLOCK, "core", F.explode(F.array_distinct(F.concat("spells", F.array("core")))).alias("form"))
    # What is left of a short name says little: there the affiliation or number is part of the block.
    short = forms.where(F.length("form") <= SHORT).join(places, [*_BLOCK, "core"]).select(*_BLOCK, "form", F.col("strong").alias("at"))
    return forms.select(*_BLOCK, "form", F.lit("").alias("at")).unionByName(short).distinct()


def near_spellings(new: DataFrame, every: DataFrame) -> DataFrame:
    """``cls, ctx, ini, form, near``: spellings alike or one typing error apart, of which the first is in ``new``.

    The spellings that share a shape are at most its places times the letters there are, so no block is large.
    """
    shaped = lambda df: df.withColumn("shape", F.explode(_shapes(F.col("form")))).where("shape <> '' AND (at <> '') = (length(shape) < %d)" % SHORT)
    pairs = shaped(new).join(shaped(every).withColumnRenamed("form", "near"), [*_BLOCK, "shape", "at"]).where((F.col("form") != F.col("near")) & (F.abs(F.length("form") - F.length("near")) <= 1))
    # Letters at two places differ in some pairs that share a shape: keep one typing error only.
    swapped = (F.length("form") == F.length("near")) & (F.levenshtein("form", "near") == 2) & (F.array_sort(F.split("form", "")) == F.array_sort(F.split("near", "")))
    pairs = pairs.where((F.levenshtein("form", "near") <= 1) | swapped)
    return pairs.select(*_BLOCK, "form", "near").unionByName(new.select(*_BLOCK, "form", F.col("form").alias("near"))).distinct()


def canonical_names(names: DataFrame, places: DataFrame, near: DataFrame, cut: Cut) -> DataFrame | None:
    """Names moved to others at least as frequent: ``cls, ctx, ini, core, to``; None if there is none.

    ``names`` has ``cls, ctx, ini, core, n, softs, placed, spells``, one row
    per name; ``spells`` are its forms, folded and as typed, and two are near
    if any of their forms are. ``places`` has a row for each affiliation or
    number of a name. Every name is a candidate, whatever its count; it moves to
    one whose fields do not clash, if that is FREQUENT times as frequent, shares
    an affiliation or number, or knows all of its given names or legal forms.
    """
    held = names.select(*_BLOCK, "core", F.explode(F.array_distinct(F.concat("spells", F.array("core")))).alias("form"))
    other = held.withColumnRenamed("core", "to")
    pairs = held.join(near, [*_BLOCK, "form"]).drop("form").join(other.withColumnRenamed("form", "near"), [*_BLOCK, "near"]).drop("near").where("core <> to").distinct()
    stats = names.select(*_BLOCK, "core", "n", "softs", "placed")
    pairs = pairs.join(stats, [*_BLOCK, "core"]).join(stats.select(*_BLOCK, *[F.col(c).alias(x) for c, x in (("core", "to"), ("n", "to_n"), ("softs", "to_softs"), ("placed", "to_placed"))]), [*_BLOCK, "to"])
    pairs = pairs.where((F.col("to_n") > F.col("n")) | (F.col("to_n") == F.col("n")) & (F.col("to") < F.col("core")))
    shares = lambda a, b: F.arrays_overlap(F.col(a), F.col(b))
    known = (F.size("softs") > 0) & (F.size("to_softs") > 0)
    clash = known & ~F.coalesce(shares("softs", "to_softs"), F.lit(False))
    # The soft field of people is the given name, of companies the legal form: neither may clash.
    pairs = cut(pairs.where(~clash))
    # Places in common are looked up from those of the rarer name, so a name of many places is never carried along.
    own = pairs.where("placed AND to_placed").select(*_BLOCK, "core", "to").join(places, [*_BLOCK, "core"])
    common = own.join(places.withColumnRenamed("core", "to"), [*_BLOCK, "to", "strong"], "left_semi").select(*_BLOCK, "core", "to").distinct().withColumn("proof", F.lit(1))
    pairs = pairs.join(common, [*_BLOCK, "core", "to"], "left").withColumn("proof", F.coalesce("proof", F.lit(0)))
    pairs = pairs.where("proof = 1 OR NOT (placed AND to_placed)")
    proof = F.col("proof")
    soft = F.coalesce(shares("softs", "to_softs"), F.lit(False)).cast("int")
    # Two frequent spellings are often two names: that some given name occurs under both says nothing then.
    sure = (F.size("softs") > 0) & (F.size(F.array_except("softs", "to_softs")) == 0)
    pairs = pairs.where((proof == 1) | sure | (F.col("to_n") >= FREQUENT * (F.col("n") - 1)))
    best = pairs.groupBy(*_BLOCK, "core").agg(F.max_by("to", F.struct(proof.alias("a"), soft.alias("b"), F.col("to_n").alias("c"), F.col("to").alias("d"))).alias("to"))
    best, moved = _counted(best, cut)
    if not moved:
        return None
    # A leader that itself moves passes its followers on.
    again = best.select(*_BLOCK, F.col("core").alias("to"), F.col("to").alias("next"))
    return best.join(again, [*_BLOCK, "to"], "left").select(*_BLOCK, "core", F.coalesce("next", "to").alias("to"))


def _given_fit(a: str, b: str) -> bool:
    """One is missing, the other's beginning, or one typing error away."""
    return not a or not b or a == b or a.startswith((b + " ", b + "-")) or b.startswith((a + " ", a + "-")) or min(len(a), len(b)) >= GIVEN_TYPO and close(a, b)


def _second(given: str) -> str:
    parts = given.replace("-", " ").split()
    return parts[1][0] if len(parts) > 1 else ""


def _mid_fit(mids: set, givens: set, mid: str, given: str) -> bool:
    """Middle initials agree; the second half of a compound given name is none."""
    seconds = {_second(g) for g in givens | {given}} - {""}
    own = {m for m in mids if m} - seconds
    return not mid or mid in seconds or not own or mid in own


class _Cluster:
    """What profiles that merged hold: ``many`` of them hold just this, told by ``part``."""

    def __init__(self, part: str, givens=(), mids=(), places=(), many: int = 1, n: int = 0) -> None:
        self.part, self.many, self.n = part, many, n
        self.givens, self.mids, self.places = set(givens), set(mids), set(places)
        self.rows: list[int] = []

    def fits(self, other: _Cluster, person: bool) -> bool:
        if self.places and other.places and not self.places & other.places:
            return False
        if person:
            return all(_given_fit(a, b) for a in self.givens for b in other.givens) and all(_mid_fit(self.mids, self.givens | other.givens, m, "") for m in other.mids)
        return not self.givens or not other.givens or bool(self.givens & other.givens)

    def take(self, other: _Cluster) -> None:
        self.n += other.n
        self.rows += other.rows
        self.givens |= other.givens
        self.mids |= other.mids
        self.places |= other.places


def _order(c: _Cluster) -> tuple:
    """The most telling first."""
    return (-len(c.givens), -len(c.mids), -len(c.places), -c.n, sorted(c.givens), sorted(c.mids), sorted(c.places))


def settle_strong(rows: list[tuple], person: bool) -> list[int]:
    """Cluster number of each profile (given or form, middle, place, n) under one name and one affiliation or number."""
    profiles = [_Cluster("", *[{x} - {""} for x in r[:3]], n=r[3]) for r in rows]
    for k, c in enumerate(profiles):
        c.rows = [k]
    clusters: list[_Cluster] = []
    for p in sorted(profiles, key=_order):
        fit = next((c for c in clusters if c.fits(p, person)), None)
        if fit:
            fit.take(p)
        else:
            clusters.append(p)
    out = [0] * len(rows)
    for n, c in enumerate(clusters):
        for k in c.rows:
            out[k] = n
    return out


def settle_loose(clusters: list[_Cluster], loose: list[_Cluster], person: bool) -> dict[str, tuple[str, bool]]:
    """Part and certainty of each loose profile under one name.

    Merged profiles are matched again with what they have learned until none
    fits one cluster alone.
    """
    out: dict[str, tuple[str, bool]] = {}
    loose = sorted(loose, key=_order)
    moved = True
    while moved and loose:
        moved, rest = False, []
        for g in loose:
            fit = [c for c in clusters if c.fits(g, person)]
            many = sum(c.many for c in fit)
            if many == 1:
                fit[0].take(g)
                out[g.part] = (fit[0].part, True)
                moved = True
            elif not fit:
                clusters.append(g)
                out[g.part] = (g.part, True)
                moved = True
            else:
                rest.append(g)
        loose = rest
    return out | {g.part: (g.part, False) for g in loose}


_NAME = ["cls", "name", "ctx", "ini"]


def _streamed(df: DataFrame, keys: list[str], schema: str, done: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``done`` run over the rows of each key, one key after the other as sorted rows pass; the keys are the first columns."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    k = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                if held and held[0][:k] != r[:k]:
                    out += done(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(done(held), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _settled(profiles: DataFrame, cut: Cut) -> DataFrame:
    """The profiles with ``part`` and ``sure``: to which of the entities under its name each falls."""
    keys = [*_NAME, "strong"]
    own = profiles.select(*keys, "pid", "soft", "mid", F.coalesce("place", F.lit("")).alias("place"), "n")
    strong = own.where("strong IS NOT NULL")

    def by_strong(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return [(rows[0][5], 0)]
        return list(zip([r[5] for r in rows], settle_strong([r[6:] for r in rows], rows[0][0] != "party-o")))

    at = _streamed(strong, keys, "pid string, number int", by_strong)
    strong = cut(strong.join(at, "pid").withColumn("part", F.concat(F.lit("s"), "strong", F.lit("|"), F.col("number").cast("string"))))
    held = lambda c: F.array_sort(F.array_remove(F.collect_set(c), "")).alias(c)
    # Different people of a name that show the same are one row, with their number.
    shown = strong.groupBy(*_NAME, "part").agg(held("soft"), held("mid"), held("place"), F.sum("n").alias("n"))
    shown = shown.groupBy(*_NAME, "soft", "mid", "place").agg(F.count(F.lit(1)).cast("int").alias("many"), F.min("part").alias("part"), F.sum("n").alias("n"))
    bag = lambda c: F.when(F.col(c) != "", F.array(c)).otherwise(F.array().cast("array<string>")).alias(c)
    loose = own.where("strong IS NULL").withColumn("part", F.concat_ws("|", F.lit("l"), "soft", "mid", "place"))
    alike = loose.groupBy(*_NAME, "soft", "mid", "place", "part").agg(F.sum("n").alias("n")).select(*_NAME, bag("soft"), bag("mid"), bag("place"), F.lit(0).alias("many"), "part", "n")

    def by_name(rows: list[tuple]) -> list[tuple]:
        made = [(r[7], _Cluster(r[8], r[4], r[5], r[6], max(r[7], 1), r[9])) for r in rows]
        got = settle_loose([c for many, c in made if many], [c for many, c in made if not many], rows[0][0] != "party-o")
        return [(*rows[0][:4], part, *where) for part, where in got.items()]

    met = alike.select(*_NAME).distinct()
    rows = shown.join(met, _NAME, "left_semi").unionByName(alike)
    to = _streamed(rows, _NAME, "cls string, name string, ctx string, ini string, part string, to string, sure boolean", by_name)
    loose = loose.join(to, [*_NAME, "part"]).select("pid", F.col("to").alias("part"), "sure")
    return profiles.join(strong.select("pid", "part", F.lit(True).alias("sure")).unionByName(loose), "pid")


def _entities(settled: DataFrame) -> DataFrame:
    """The settled profiles with their entity; companies under one number are one company, however far their spellings."""
    named = settled.withColumn("entity", F.concat_ws("|", *_NAME, "part"))
    numbered = named.where("cls = 'party-o' AND strong IS NOT NULL").groupBy("strong").agg(F.min("entity").alias("low"), F.max("entity").alias("high")).where("low <> high")
    renamed = named.where("cls = 'party-o' AND strong IS NOT NULL").join(numbered, "strong").where("entity <> low").groupBy("entity").agg(F.min("low").alias("low"))
    return named.join(renamed, "entity", "left").withColumn("entity", F.coalesce("low", "entity")).drop("low")


def _learned(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the entities of each name have learned: ``cls, ctx, ini, core, n, softs, placed, spells``, and ``cls, ctx, ini, core, strong``."""
    key = ["cls", "ctx", "ini", "name"]
    known = placed.groupBy("entity").agg(F.collect_set("soft").alias("softs"), F.max(F.col("strong").isNotNull()).alias("placed"), F.array_union(F.collect_set("core"), F.collect_set("spelled")).alias("spells"))
    held = placed.groupBy(*key, "entity").agg(F.sum("n").alias("n")).join(known, "entity")
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    names = held.groupBy(*key).agg(F.sum("n").alias("n"), F.array_remove(union("softs"), "").alias("softs"), F.max("placed").alias("placed"), union("spells").alias("spells"))
    at = placed.where("strong IS NOT NULL").select("entity", "strong").distinct()
    places = placed.select(*key, "entity").distinct().join(at, "entity").select(*key, "strong").distinct()
    return names.withColumnRenamed("name", "core"), places.withColumnRenamed("name", "core")


_PROFILE = ["cls", "core", "spelled", "ctx", "ini", "soft", "mid", "strong", "place"]


def _profiles(found: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Mentions with their profile's id, and the profiles: mentions that agree in every piece are one."""
    pid = F.substring(F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("\x02")) for c in _PROFILE]), 256), 1, 32)
    found = cut(found.withColumn("pid", pid).withColumnRenamed("pid", "pid0"))
    typed = cut(found.groupBy(F.col("pid0"), *_PROFILE).agg(F.count(F.lit(1)).alias("n")))
    # Given names that stand for others, learned from people of one surname and affiliation.
    people = typed.where("cls <> 'party-o'")
    told = people.join(given_forms(people).withColumnRenamed("form", "soft"), "soft").select("pid0", "stands_for")
    profiles = typed.join(told, "pid0", "left").withColumn("soft", F.coalesce("stands_for", "soft")).withColumn("ini", F.when(F.col("stands_for").isNotNull(), F.substring("stands_for", 1, 1)).otherwise(F.col("ini"))).drop("stands_for")
    profiles = cut(profiles.withColumn("pid", pid))
    at = profiles.select("pid0", "pid")
    profiles = profiles.groupBy("pid", *_PROFILE).agg(F.sum("n").alias("n"))
    return found.join(at, "pid0").select("kind", "id", "pos", "pid"), cut(profiles.withColumn("name", F.col("core")))


def resolve(found: DataFrame, cut: Cut, works: DataFrame | None = None) -> DataFrame:
    """``kind, id, pos, entity`` of every mention; ``works`` (``ref_id, work``) settles unsure authors.

    Rounds end as soon as no name moves. Each move leaves one name less,
    and goes to a name later in one order, so they do end.
    """
    members, profiles = _profiles(found, cut)
    settled = cut(_settled(profiles, cut))
    seen = near = None
    while True:
        placed = cut(_entities(settled))
        names, places = map(cut, _learned(placed))
        forms = spelling_forms(names, places)
        if seen is None:
            seen = cut(forms)
            near = cut(near_spellings(seen, seen))
        else:
            new, more = _counted(forms.join(seen, [*_BLOCK, "form", "at"], "left_anti"), cut)
            if more:
                seen = cut(seen.unionByName(new))
                found = near_spellings(new, seen)
                near = cut(near.unionByName(found).unionByName(found.select(*_BLOCK, F.col("near").alias("form"), F.col("form").alias("near"))).distinct())
        moves = canonical_names(names, places, near, cut)
        if moves is None:
            break
        moves = cut(moves)
        moved = settled.join(moves.select(*_BLOCK, F.col("core").alias("name"), "to"), [*_BLOCK, "name"], "left").withColumn("name", F.coalesce("to", "name")).drop("to")
        # Only names that gained a profile are settled anew.
        touched = moves.select("cls", F.col("to").alias("name"), "ctx", "ini").distinct()
        again = cut(moved.join(touched, _NAME, "left_semi").drop("part", "sure"))
        settled = cut(moved.join(touched, _NAME, "left_anti").unionByName(_settled(again, cut)))
    placed = cut(members.join(placed.select("pid", "name", "ini", "sure", "entity"), "pid").drop("pid"))
    if works is not None:
        # An unsure author is the one this work's other records name.
        at = works.select(F.col("ref_id").alias("id"), "work")
        authors = placed.where("kind = 'author'").join(at, "id")
        sure = authors.where("sure").groupBy("work", "name", "ini").agg(F.min("entity").alias("e0"), F.max("entity").alias("e1")).where("e0 = e1")
        hint = authors.where("NOT sure").join(sure, ["work", "name", "ini"]).select("kind", "id", "pos", F.col("e0").alias("hint"))
        placed = placed.join(hint, ["kind", "id", "pos"], "left")
        # Unsure records of one work mean the same person at least among themselves.
        among = authors.where("NOT sure").select("kind", "id", "pos", F.concat_ws("|", F.lit("w"), F.col("work").cast("string"), "name", "ini").alias("alone"))
        placed = placed.join(among, ["kind", "id", "pos"], "left")
    else:
        placed = placed.withColumn("hint", F.lit(None).cast("string")).withColumn("alone", F.lit(None).cast("string"))
    own = F.concat_ws("|", F.lit("m"), F.col("kind"), F.col("id").cast("string"), F.col("pos").cast("string"))
    return placed.select("kind", "id", "pos", F.when(F.col("sure"), F.col("entity")).otherwise(F.coalesce("hint", "alone", own)).alias("entity"))


def mention_pairs(resolved: DataFrame) -> DataFrame:
    """Every pair of mentions of one entity, the smaller (id, pos) first.

    One side is dealt into portions of about PORTION mentions and the other
    repeated for each, so the pairs of a hot entity are made by many tasks.
    """
    many = resolved.groupBy("kind", "entity").count().where("count > 1").select("kind", "entity", F.ceil(F.col("count") / PORTION).cast("int").alias("portions"))
    members = resolved.join(many, ["kind", "entity"])
    left = members.select("kind", "entity", F.col("id").alias("id_a"), F.col("pos").alias("pos_a"), F.pmod(F.xxhash64("id", "pos"), F.col("portions")).cast("int").alias("portion"))
    right = members.select("kind", "entity", F.col("id").alias("id_b"), F.col("pos").alias("pos_b"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    later = (F.col("id_a") < F.col("id_b")) | (F.col("id_a") == F.col("id_b")) & (F.col("pos_a") < F.col("pos_b"))
    return left.join(right, ["kind", "entity", "portion"]).where(later).select("kind", "id_a", "pos_a", "id_b", "pos_b")
