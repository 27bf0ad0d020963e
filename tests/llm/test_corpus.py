"""Language, leaks, packing, identities and works on small fixtures and against brute force."""

import datetime as dt
import random

import numpy as np
import pytest

from lexmill.llm.identity import _Cluster, mention_pairs, mentions, resolve, settle_loose, settle_strong
from lexmill.llm.language import Model, automaton, clean_sample, document_languages, language_stretches, relabel
from lexmill.llm.leaks import Index, find_leaks, remove_leaks, words
from lexmill.llm.packing import pack_documents, sum_of_squares
from lexmill.llm.persons import close, parse_company, parse_person
from lexmill.llm.sentences import Splitter
from lexmill.llm.works import best_records, consensus, distance, merged_records, records, work_groups

EN = "The Buyer shall deliver the goods to the Seller before the end of the month. Neither party is liable for delay caused by strikes. Interest accrues from the date of payment. "
FR = "Le Preneur doit remettre les documents au Bailleur avant la fin du mois. Chaque partie peut résilier la convention moyennant un préavis. Les intérêts courent à compter du paiement. "
RU = "Каждая сторона вправе расторгнуть договор, уведомив другую. Отсрочка предоставлена не будет! "
ZH = "任何一方均可提前书面通知解除合同。不得再次延期！"
JA = "各当事者は書面による通知で契約を解除できる。延期は認められない！"
TRAINED = tuple(sorted({"en": EN * 3, "fr": FR * 3, "ru": RU * 3, "zh": ZH * 5, "ja": JA * 5}.items()))


def test_automaton_knows_every_substring():
    text = [1, 2, 1, 3, 2, 1, 2]
    t = automaton(text, 5)
    subs = {tuple(text[a:b]) for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
    r = random.Random(1)
    for _ in range(400):
        w = [r.randrange(1, 5) for _ in range(r.randrange(1, 5))]
        state = 1
        for c in w:
            state = t[state, c] if state else 0
        assert (state > 0) == (tuple(w) in subs)


def test_phrases_equal_a_greedy_parse():
    m = Model(dict(TRAINED))
    langs, of, _, _, _, _ = m.tables[0]
    text = "The party shall remettre the goods, Neither goods au Bailleur."
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = m.phrases(0, codes, np.array([0]), np.array([len(text)]))[0]

    def sequence(s):
        out = []
        for c in s:
            v = int(of[ord(c)])
            if not (v == 0 and out and out[-1] == 0):
                out.append(v)
        return out

    for k, lang in enumerate(langs):
        train, seq = sequence(dict(TRAINED)[lang]), sequence(text)
        known = lambda w: w[0] != 1 and f",{','.join(map(str, w))}," in f",{','.join(map(str, train))},"
        count, phrase = 1, []
        for v in seq:
            if known([*phrase, v]):
                phrase.append(v)
            else:
                count, phrase = count + 1, [v] if known([v]) else []
        assert got[k] == count
    assert got[langs.index("en")] < got[langs.index("fr")]


def test_held_out_language():
    m = Model(dict(TRAINED))
    tests = [("The Seller shall deliver the documents before payment.", "en"), ("Le Bailleur doit remettre le paiement avant la fin.", "fr"), ("Отсрочка вправе договор.", "ru"), ("提前通知不得延期。", "zh"), ("契約は認められない。", "ja"), ("2020 §", None)]
    for text, want in tests:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x20000)
        lang, sure, _ = m.classify(codes, np.array([0]), np.array([len(text)]), [None])
        assert (m.langs[lang[0]] if lang[0] >= 0 else None) == want and 0 <= sure[0] <= 1


def test_wrong_labels_are_outvoted():
    rows = [("en", EN)] * 8 + [("fr", FR)] * 8 + [("en", FR)] * 2 + [("fr", EN)] * 2
    got = clean_sample(rows)
    assert "Preneur" not in got["en"] and "Buyer" not in got["fr"]


def test_stretches_and_relabelling(spark, cut):
    rows = [(1, 0, "en", EN), (1, 0, "en", EN), (1, 1, "FR", FR), (2, 0, None, FR), (2, 1, "en", EN + FR), (3, 0, "en", None), (4, 0, "en", "1234"), (5, 0, "zzz", RU)]
    rows += [(k, 0, lang, t) for k in range(10, 40) for lang, t in (("en", EN), ("fr", FR), ("ru", RU))][::1]
    blocks = spark.createDataFrame([(a, b + (k % 3 if a >= 10 else 0), c, d, "x") for k, (a, b, c, d) in enumerate(rows)], "doc_id long, idx int, lang string, text string, label string")
    out = language_stretches(blocks.where("doc_id < 6"), ["doc_id", "idx"], TRAINED).dropDuplicates(["doc_id", "idx", "seg_no"])
    got = {(r.doc_id, r.idx, r.seg_no): (r.label, r.lang) for r in out.collect()}
    assert got == {(1, 0, 0): ("en", "en"), (1, 1, 0): ("fr", "fr"), (2, 0, 0): (None, "fr"), (2, 1, 0): ("en", "en"), (2, 1, 1): ("en", "fr"), (5, 0, 0): (None, "ru")}
    docs = {r.doc_id: r.lang for r in document_languages(out).where("seg_no = 0").collect()}
    assert docs == {1: "en", 2: "fr", 5: "ru"}
    documents = spark.createDataFrame([(1, "en"), (2, "fr"), (5, "ru")], "doc_id long, lang string")
    cases = {(r.doc_id, r.idx, r.seg_no, r.lang) for r in relabel(blocks, documents, cut).where("doc_id < 6").collect()}
    assert cases == {(2, 0, 0, "fr"), (2, 1, 0, "en"), (2, 1, 1, "fr"), (5, 0, 0, "ru"), (1, -1, 0, "en"), (1, -1, 1, "fr"), (2, -1, 0, "fr"), (2, -1, 1, "en")}


PASSAGE = "Wexpokhyr stored the clay whistles in a stable behind Tharvilist and paid 821 crowns in late autumn. Then a dam breach spoiled roughly 322 of the clay whistles, as Cinbarxan admitted in late autumn to nobody in particular at the inn."


def brute(passage, text, run=15):
    a, b = words([passage])[0].tolist(), words([text])[0].tolist()
    return max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0) >= run


def test_leaks_equal_brute_force():
    index = Index([(1, "passage", PASSAGE), (1, "question", "Who pays?"), (2, "passage", PASSAGE.replace("clay", "tin"))])
    tokens = PASSAGE.split()
    r = random.Random(3)
    for n in (5, 10, 14, 15, 16, 25):
        at = r.randrange(0, len(tokens) - n)
        text = "Before this there was another story. " + " ".join(tokens[at : at + n]) + " And after it one more."
        assert (1 in {i for _, i, *_ in index.scan([text])}) == brute(PASSAGE, text)


@pytest.mark.parametrize("change", [str.upper, lambda t: t.replace(" ", "\n"), lambda t: t.replace("breach", "bre-\nach"), lambda t: t.replace("a", "а"), lambda t: t.replace(" ", " "), lambda t: t.replace(",", " -"), lambda t: t.replace("whistles", "whis­tles")])
def test_leaks_in_disguise(change):
    assert [i for _, i, *_ in Index([(1, "passage", PASSAGE)]).scan(["x", change(PASSAGE)])] == [1]


def test_replaced_words():
    tokens = PASSAGE.split()
    six = " ".join("other" if k % 6 == 3 else w for k, w in enumerate(tokens))
    three = " ".join("other" if k % 3 == 1 else w for k, w in enumerate(tokens))
    index = Index([(1, "passage", PASSAGE)])
    assert index.scan([six]) and not index.scan([three])


def test_leak_rows_and_removal(spark):
    docs = spark.createDataFrame([(1, f"Before. {PASSAGE} After.", 9), (2, "clean", 9), (3, None, 9), (4, "", 9), (5, PASSAGE * 3000, 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, PASSAGE, None, "a"), (7, PASSAGE, None, "a"), (8, None, None, None)], "item_id long, passage string, question string, answer string")
    leaks = find_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == {(1, 7), (5, 7)}
    cleaned = {r.doc_id: r.text for r in remove_leaks(docs.where("doc_id < 5"), leaks).collect()}
    assert cleaned[1].split() == ["Before.", ".", "After."] and cleaned[2] == "clean" and cleaned[3] is None
    assert find_leaks(docs, items.where("false")).count() == 0


def squares(sizes, capacity):
    """The rule word by word: the level, or a new container, with the least sum of squared counts."""
    levels, out = [], []
    for s in sizes:
        best = None
        for b, at in [*enumerate(levels), (len(levels), 0)]:
            if at + s <= capacity:
                after = [*levels, 0]
                after[b] = at + s
                counts = np.bincount([x for x in after if 0 < x < capacity], minlength=1)
                key = (int((counts**2).sum()), -at)
                if best is None or key < best[0]:
                    best = (key, b, at)
        _, b, at = best
        if b == len(levels):
            levels.append(0)
        levels[b] += s
        out.append(at)
    return out, levels


def test_packing_equals_the_rule():
    r = random.Random(5)
    for capacity in (10, 37):
        sizes = [r.randrange(1, capacity + 1) for _ in range(80)]
        box, offset = sum_of_squares(np.array(sizes), capacity)
        want, levels = squares(sizes, capacity)
        assert offset.tolist() == want and sorted(np.bincount(box, sizes).astype(int)) == sorted(levels)


def test_packing_rows(spark, cut):
    docs = spark.createDataFrame([(k, "word " * (k % 50 + 1), "s") for k in range(300)] + [(300, "word " * 5000, "s"), (301, None, "s"), (302, "", "s"), (1, "word " * 2, "s")], "doc_id long, text string, shard string")
    specs = spark.createDataFrame([("a", 64), ("b", 1000), ("a", 64), ("c", None)], "pack_name string, capacity_tokens int")
    rows = pack_documents(docs, specs, cut, shard_docs=1000).collect()
    fill, held = {}, {}
    for x in rows:
        fill[x.pack_name, x.container] = fill.get((x.pack_name, x.container), 0) + x.n_tokens
        held.setdefault((x.pack_name, x.doc_id), []).append((x.token_start, x.n_tokens))
    assert all(n <= {"a": 64, "b": 1000}[p] for (p, _), n in fill.items())
    assert {d for _, d in held} == set(range(301)) and len({p for p, _ in held}) == 2
    for (p, d), parts in held.items():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert len(parts) == 1 or sum(n for _, n in parts) > {"a": 64, "b": 1000}[p]
    used = sum(n for (p, _), n in fill.items() if p == "a") / (64 * sum(p == "a" for p, _ in fill))
    assert used > 0.9


def test_names():
    assert parse_person("Vosvosfirński, A. G.")[:4] == ("vosvosfirnski", "", "a", "g")
    assert parse_person("Ola VOSVOSFIRŃSKI")[1] == "aleksandra" and parse_person("et al.") is None and parse_person(" ") is None
    assert parse_company('"The Foo Fin. Svcs. (2), Incorporated"') == ("foo", "financialservices", "2", "inc")
    assert close("abc", "abc") and close("abc", "acb") and close("abc", "ab") and close("abc", "axc") and not close("abc", "cba")


def test_one_name_several_people():
    assert settle_strong([("frederic", "", "", 3), ("", "", "", 1), ("guillaume", "", "", 2), ("frederik", "", "", 1)], True) == [0, 0, 1, 0]
    x, y = _Cluster("x", ["frederic"], n=4), _Cluster("y", ["frederic"], n=2)
    got = settle_loose([x, y], [_Cluster("a"), _Cluster("b", ["guillaume"]), _Cluster("c", ["guillaume"], ["p"])], True)
    assert got == {"a": ("a", False), "b": ("c", True), "c": ("c", True)}
    # People who show the same are one row with their number.
    assert settle_loose([_Cluster("x", ["anna"], many=2)], [_Cluster("a", ["anna"])], True) == {"a": ("a", False)}


def test_given_names_that_stand_for_one_another_are_learned(spark, cut):
    """Names that no table holds: short forms and the order of words are learned from the other names."""
    surnames = ["Torzelhunwick", "Kasscudelby", "Meierhof", "Vilrudsen", "Xavikor"]
    typed = []
    for s in surnames:
        typed += [(f"{s}, Zorbalin", f"At {s}")] * 3 + [(f"{s}, Zobi", f"At {s}")]
    typed += [("Zobi Torzelhunwick", "At Torzelhunwick"), ("Meierhof Zorbalin", "At Meierhof"), ("Zorbalin Quellmundi", "Here"), ("Zobi Quellmundi", "Here")]
    got = by_name(spark, cut, typed)
    assert [len(g) for g in got] == [5, 4, 5, 4, 4, 2]


def tables(spark):
    parties = [(1, "Foo Shipping Inc.", "organisation", "CA", "R1"), (2, "FOO SHIPPING INCORPORATED", "organisation", None, None), (3, "Foo Shiping Inc", "organisation", "CA", None), (4, "Foo Shipping No. 2 Inc.", "organisation", "CA", "R2"), (5, "Foo Foods Inc.", "organisation", "CA", None), (6, None, None, None, None), (7, "Anna Zelby", "person", None, None), (8, "Zelby, A.", "person", None, None), (8, "Zelby, A.", "person", None, None)]
    t = dt.datetime(2024, 1, 1)
    refs = [
        (1, "Good faith in sales: lessons", ["Karl Norbert Xavik", "et al."], ["U", None], 2001, "10.5555/a.1", ["hal"], t), (2, "GOOD FAITH IN SALES: LESSONS", ["Xavik, K."], [None], 2001, "https://doi.org/10.5555/A.1", ["crossref"], t), (2, "GOOD FAITH IN SALES: LESSONS", ["Xavik, K."], [None], 2001, "https://doi.org/10.5555/A.1", ["crossref"], t),
        (3, "Good faith in sales", ["K. Xavik", "Anna Molly"], None, 2001, "10.5555/", None, t), (4, "Good faith in sales: lessons", ["K. Xavik"], None, 2007, "10.5555/a.1b", [], t), (5, None, None, None, None, None, None, None), (6, "", [], [], 1999, "n/a", ["hal"], t),
    ]
    return (
        spark.createDataFrame([(*p, "x") for p in parties], "party_id long, name string, type string, jurisdiction string, reg_no string, entity string"),
        spark.createDataFrame([(*x, "x") for x in refs], "ref_id long, title string, authors array<string>, author_affils array<string>, year int, doi string, sources array<string>, retrieved_at timestamp, work string"),
        spark.createDataFrame([("crossref", 1), ("hal", 2)], "source string, trust_rank int"),
    )


def test_identity_rows(spark, cut):
    parties, refs, _ = tables(spark)
    works = work_groups(cut(records(refs)), cut)
    pairs = {tuple(r) for r in mention_pairs(resolve(mentions(parties, refs), cut, works)).collect()}
    assert {p[1::2] for p in pairs if p[0] == "party"} == {(1, 2), (1, 3), (2, 3), (7, 8)}
    assert {p[1:] for p in pairs if p[0] == "author"} >= {(1, 0, 2, 0), (1, 0, 3, 0), (2, 0, 3, 0)}
    assert mention_pairs(resolve(mentions(parties.where("false"), refs.where("false")), cut, works)).count() == 0


def by_name(spark, cut, typed):
    """Mentions of each entity, by reference: ``typed`` are (author, affiliation)."""
    rows = [(k, [a], [f]) for k, (a, f) in enumerate(typed)]
    refs = spark.createDataFrame(rows, "ref_id long, authors array<string>, author_affils array<string>")
    parties = spark.createDataFrame([], "party_id long, name string, type string, reg_no string, jurisdiction string")
    out = {}
    for r in resolve(mentions(parties, refs), cut).collect():
        out.setdefault(r.entity, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_a_typing_error_made_twice_is_linked(spark, cut):
    typed = [("Torzelhunwick, V.", "Law, Lamgwen")] * 12 + [("TOREZLHUNWICK, V.", "Law, Lamgwen"), ("Torezlhunwick V", None)]
    assert by_name(spark, cut, typed) == [list(range(14))]
    # Two frequent names that agree in nothing stay two.
    typed = [("Meierhof, Thomas", None)] * 5 + [("Meyerhof, Thomas", None), ("Meyerhof, Tobias", None)] * 2
    got = by_name(spark, cut, typed)
    assert not any(min(g) < 5 <= max(g) for g in got)


def test_a_typing_error_in_an_umlaut_or_a_short_name_is_linked(spark, cut):
    law, sea = "Law, Lamgwen", "Sea, Vilrud"
    typed = [("Kasscudelby, T.", law)] * 3 + [("Kasscduelby, T.", law)] + [("Sorfirdyseau, J.", sea)] * 3 + [("Sorfirdyaeau, J.", sea)]
    typed += [("Orb, K.", law)] * 3 + [("Orv, K.", law), ("Orx, K.", sea)]
    assert by_name(spark, cut, typed) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12]]


def test_no_link_is_lost_when_rows_come_twice(spark, cut):
    law, sea = "Law, Lamgwen", "Sea, Vilrud"
    typed = [("Kasscudelby, T.", law)] * 3 + [("Kasscduelby, T.", law), ("Kasscudelby, Thomas", None), ("Kascudelby, Tom", law), ("Kasscudelby, U.", sea)]
    once = by_name(spark, cut, typed)
    assert once == [[0, 1, 2, 3, 4, 5], [6]]
    assert by_name(spark, cut, typed * 2) == [[*g, *(k + 7 for k in g)] for g in once]


def test_a_name_of_many_people_is_settled_by_what_they_show(spark, cut):
    typed = [(f"Orbinsky, {g}", f"Place {k}") for k in range(400) for g in ("Anna", "A.")] + [("Orbinsky, Anna", None), ("Orbinsky, Zoltan", None)]
    got = by_name(spark, cut, typed)
    assert sorted(map(len, got)) == [1] * 2 + [2] * 400


def test_merged_profiles_rematch_with_all_they_hold(spark, cut):
    # The last spelling is two letters from the name, one from a variant that moved rounds before.
    law = "Law, Lamgwen"
    typed = [("Torzelhunwick, V.", law)] * 9 + [("Torzelhunwik, V.", law)] * 2 + [("Torzelhuwik, V.", law)]
    assert by_name(spark, cut, typed) == [list(range(12))]
    # Seven rounds and more: each spelling is one letter from the next only.
    word = "abcdefghijklmnopqrst"
    typed = [("".join("z" if j < k else c for j, c in enumerate(word)).capitalize() + ", V.", law) for k in range(10) for _ in range(2**k)]
    assert len(by_name(spark, cut, typed)) == 1
    # A company under one number learns the other form, by which a third spelling no longer clashes.
    parties = [(1, "Foobarix Shipping Ltd", "R1"), (2, "Foobarix Shipping Ltd", "R1"), (3, "Zuloquent Shipping Inc", "R1"), (4, "Foobarx Shipping Inc", None)]
    parties = spark.createDataFrame([(k, n, "organisation", r, None) for k, n, r in parties], "party_id long, name string, type string, reg_no string, jurisdiction string")
    refs = spark.createDataFrame([], "ref_id long, authors array<string>, author_affils array<string>")
    assert len({r.entity for r in resolve(mentions(parties, refs), cut).collect()}) == 1


def test_work_rows(spark, cut):
    _, refs, trust = tables(spark)
    got = {tuple(r) for r in best_records(refs, trust, cut).collect()}
    assert got == {(1, "title", 1), (1, "authors", 3), (1, "doi", 2)}
    merged = merged_records(refs, trust, cut).collect()
    assert len(merged) == 4 and [(m.sources, m.n_records) for m in merged if m.group_ref_id == 1] == [(["crossref", "hal"], 3)]
    assert best_records(refs.where("false"), trust, cut).count() == 0


def test_consensus_and_distance():
    votes = [(["a", "b", "c"], 1.0), (["a", "x", "c"], 1.0), (["a", "b", "c", "d"], 1.0), (["a", "b"], 0.25)]
    assert consensus(votes)[:3] == ["a", "b", "c"] and distance(["a", "b"], ["a", "c", "b"]) == 1 and consensus([]) == []
    assert Splitter().cuts([None, ""])[0].tolist() == []


def test_passages_of_one_template_all_leak():
    r = random.Random(4)
    base = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)]
    items = []
    for k in range(60):
        copy = list(base)
        for p in r.sample(range(30), 2):
            copy[p] = f"own{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + p % 26)}"
        items.append((k, "passage", " ".join(copy)))
    index = Index(items)
    for k, (_, _, text) in enumerate(items):
        changed = text.split()
        changed[3] = changed[17] = "other"
        assert k in {item for _, item, *_ in index.scan(["Before it. " + " ".join(changed) + " after it."])}


def test_short_passages_and_scripts_without_spaces():
    zh = "任何一方均可提前书面通知对方解除本合同并要求赔偿因此造成的全部直接损失不得再次延期履行"
    index = Index([(1, "passage", "rebus sic stantibus"), (2, "passage", "estoppel"), (3, "question", "rebus sic stantibus"), (4, "passage", zh), (5, "question", zh)])
    got = lambda t: sorted({item for _, item, *_ in index.scan([t])})
    assert got("The maxim Rebus, sic\nstantibus applies.") == [1]
    assert got("rebus sic other stantibus") == [] and got("Es-\n          toppel is pleaded") == [2]
    assert got("双方同意" + zh + "，另有约定除外") == [4, 5]
    assert got("双方同意" + zh[:20] + "，另有约定除外") == []


def test_votes_of_many_spellings_go_by_portions(spark, cut, monkeypatch):
    from lexmill.llm import works

    monkeypatch.setattr(works, "VOTE_PORTION", 8)
    r = random.Random(2)
    base = "good faith in sales of goods lessons from two codes".split()
    rows = []
    for k in range(100):
        t = list(base)
        t[r.randrange(len(t))] = f"x{k}"
        rows.append((1, " ".join(t), 1.0))
    values = spark.createDataFrame([*rows, (2, "short one", 1.0)], "work long, key string, weight double")
    assert {r.work: r.voted for r in works.title_votes(values, cut).collect()} == {1: " ".join(base), 2: "short one"}


def test_titles_cut_very_short_and_records_alone(spark, cut):
    t = dt.datetime(2024, 1, 1)
    refs = [(1, "Law of seas", ["Xavik, K."], None, 2001, None, ["hal"], t), (2, "Law of…", ["Xavik, K."], None, 2001, None, ["hal"], t), (3, "Other things", ["Molly, A."], None, 2002, "10.5555/b.1", None, t), (4, None, None, None, None, None, None, None)]
    refs = spark.createDataFrame(refs, "ref_id long, title string, authors array<string>, author_affils array<string>, year int, doi string, sources array<string>, retrieved_at timestamp")
    trust = spark.createDataFrame([("hal", 1), ("hal", 2), (None, 3)], "source string, trust_rank int")
    merged = {r.group_ref_id: (r.title, r.n_records) for r in merged_records(refs, trust, cut).collect()}
    assert merged == {1: ("Law of seas", 2), 3: ("Other things", 1), 4: (None, 1)}


def test_every_script_meets_an_automaton_and_unknown_ones_stay(spark):
    m = Model(dict(TRAINED))
    codes = np.frombuffer("Каждая сторона вправе расторгнуть договор.".encode("utf-32-le"), np.uint32)
    other = np.frombuffer("Щоб юнкер Гаврюха зʼїв їжу, ґаздиня ждала.".encode("utf-32-le"), np.uint32)
    (own,), (far,) = (m.classify(c, np.array([0]), np.array([len(c)]), [None])[1] for c in (codes, other))
    assert 0 < far < own < 1
    blocks = spark.createDataFrame([(1, 0, None, "우리는 계약을 해지할 수 있다."), (1, 1, "en", "The Buyer shall deliver the goods. 우리는 계약을 해지한다.")], "doc_id long, idx int, lang string, text string")
    rows = sorted((r.idx, r.seg_no, r.lang, r.confidence > 0) for r in language_stretches(blocks, ["doc_id", "idx"], TRAINED).collect())
    assert rows == [(0, 0, "und", False), (1, 0, "en", True), (1, 1, "und", False)]


def test_a_rare_language_is_learned(spark):
    from lexmill.llm.language import fit

    rows = [(k, 0, "en", EN) for k in range(3000)] + [(k, 0, "fra", FR) for k in range(3000, 3003)]
    assert {lang for lang, _ in fit(spark.createDataFrame(rows, "doc_id long, idx int, lang string, text string"))} == {"en", "fr"}
    assert fit(spark.createDataFrame([], "doc_id long, idx int, lang string, text string")) == ()


def test_steps_by_sorted_keys_equal_the_array(monkeypatch):
    from lexmill.llm import language

    dense = Model(dict(TRAINED))
    monkeypatch.setattr(language, "DENSE_CELLS", 0)
    sparse = Model(dict(TRAINED))
    for script, text in ((0, EN[:90] + FR[:60]), (6, ZH + JA)):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.array([len(text) // 2, len(text)])
        assert (dense.phrases(script, codes, np.array([0, 3]), ends) == sparse.phrases(script, codes, np.array([0, 3]), ends)).all()
