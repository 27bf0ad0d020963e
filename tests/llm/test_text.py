"""Sentences, the consistent form and text quality on known cases and against brute force."""

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lexmill.llm import codepoints as cp
from lexmill.llm.normal import normalise, normalise_fields
from lexmill.llm.quality import KINDS, statistics, text_quality
from lexmill.llm.sentences import Splitter, split_sentences
from lexmill.llm.transducer import prefix_compose, states_after


def sentences(text):
    row, begin, end, _ = Splitter().cuts([text, "other."])
    return [text[a:b] for r, a, b in zip(row, begin, end) if r == 0]


@given(st.lists(st.integers(0, 3), max_size=400), st.integers(1, 70))
@settings(max_examples=40, deadline=None)
def test_chunked_transducer_equals_a_walk(symbols, chunk):
    table = np.array([[0, 2, 1], [1, 1, 1], [2, 0, 0], [0, 1, 2]])
    state, want = 0, []
    for s in symbols:
        state = table[s][state]
        want.append(state)
    assert states_after(np.array(symbols, np.int64), table, chunk).tolist() == want


def test_prefix_scan_composes_in_order():
    maps = np.array([[1, 2, 0], [0, 0, 1], [2, 1, 0]], np.uint8)
    want = [maps[0], maps[1][maps[0]], maps[2][maps[1][maps[0]]]]
    assert (prefix_compose(maps) == np.array(want)).all()


CASES = [
    ["See Mr. Smith, Esq., in No. 5.", "Go!", "Who pays?"],
    ["“Who bears it? Not us!” was the reply.", "Next."],
    ["Der Satz stieg auf 1,25 %.", "Am 3. Verhandlungstag kam er am 27. Februar 2027."],
    ["Od dnia 7 grudnia 2024 r. Najemca płaci do dnia 3 maja 2025 r.", "Z zastrzeżeniem § 4 ust. 1 koniec."],
    ["三輪部長は「届いていません。取り消してください。」と書いた。", "延期は認められない！"],
    ["谁承担风险？", "费经理写道：“没有收到。请取消。”", "不得延期！"],
    ["« Pourquoi ? », demanda M. Vernoy.", "Le taux est de 5,3 % !"],
    ["ผู้เช่าตกลงไม่เปิดเผยเป็นเวลา 82 เดือน", "ศาลยกคำร้อง"],
    ["كتب د. ريحان رسالة.", "من يتحمل الخطر؟"],
    ["श्री मानक ने लिखा, \"माल नहीं मिला। रद्द करें।\"", "और समय नहीं!"],
    ["HE SAID, \"WAS IT EVER INSPECTED?\" AND NOBODY ANSWERED.", "THE END."],
    ["It ended...", "Then it began."],
    ["1. The first term; the second: and\nthe third."],
]


@pytest.mark.parametrize("want", CASES)
def test_known_boundaries(want):
    glue = "" if ord(want[0][0]) > 0x3000 else " "
    assert sentences(glue.join(want)) == want


def test_no_gap_and_spaces():
    assert sentences("It is done.The end is near.") == ["It is done.", "The end is near."]
    assert sentences("  One.  Two.  ") == ["One.", "Two."]
    assert sentences("") == [] and sentences(" \n ") == [] and sentences("no mark") == ["no mark"]


@given(st.text(alphabet="ab .!?\"'“”«»。A1\n​ก", max_size=60))
@settings(max_examples=150, deadline=None)
def test_sentences_cover_the_text(text):
    row, begin, end, _ = Splitter().cuts([text])
    covered = "".join(text[a:b] for a, b in zip(begin, end))
    assert "".join(covered.split()) == "".join(text.split())
    assert all(a < b for a, b in zip(begin, end)) and list(begin) == sorted(begin)


def test_sentence_rows(spark):
    long = "Word word. " * 200_000
    df = spark.createDataFrame([(1, 0, "A. B is here. C is.", 7), (1, 0, "A. B is here. C is.", 7), (2, 0, None, 7), (3, 1, "", 7), (4, 0, long, 7)], "doc_id long, idx int, text string, sent_start int")
    out = split_sentences(df, ["doc_id", "idx"])
    assert out.columns == ["doc_id", "idx", "sent_start", "sent_end"]
    assert out.where("doc_id = 1").count() == 2 and out.where("doc_id in (2, 3)").count() == 0 and out.where("doc_id = 4").count() == 200_000
    assert split_sentences(df.where("false"), ["doc_id", "idx"]).count() == 0


@given(st.text(alphabet=st.characters(codec="utf-8", categories=["Ll", "Lu", "Mn", "Lo"], max_codepoint=0x1FFF), max_size=12))
@settings(max_examples=300, deadline=None)
def test_form_is_composed_and_stable(text):
    (form, _), _ = normalise([text, "x"])
    assert form == unicodedata.normalize("NFC", form)
    (again, _), changed = normalise([form, "x"])
    assert again == form and not changed[0]


@given(st.text(alphabet="aeioucnszAEỌ̧̨̀́̂̃̄̈", max_size=10))
@settings(max_examples=300, deadline=None)
def test_marks_compose_as_the_standard_says(text):
    assert normalise([text])[0][0] == unicodedata.normalize("NFC", text)


def test_form_of_known_cases():
    cases = {"Ｌｔｄ １２": "Ltd 12", "10 000": "10 000", "ﬁn": "fin", "wо​rd": "word", "Прилoжение": "Приложение", "⼀⽅": "一方", "non‑stop": "non-stop", "کی": "كي"}
    form, changed = normalise(list(cases))
    assert form == list(cases.values()) and changed.all()
    kept = ["“a” – b… n.º 5 、。「」（）：", "श्रीमान्‌जी", "Приложение с А. В.", "", None]
    form, changed = normalise(kept)
    assert form == kept and not changed.any()
    assert normalise(["ｐ１.０", "§2#1", "р3"], True)[0] == ["p1.0", "§2#1", "p3"]


def test_form_rows(spark):
    df = spark.createDataFrame([(1, "a b", None, "f"), (2, None, "b２", "f"), (3, "plain", "p1", "f")], "doc_id long, text string, anchor string, form string")
    out = normalise_fields(df, ["doc_id"], {"text": False, "anchor": True}, only_changed=True)
    assert {(r.doc_id, r.field, r.form) for r in out.collect()} == {(1, "text", "a b"), (2, "anchor", "b2")}
    assert normalise_fields(df, ["doc_id"], {"text": False, "anchor": True}).count() == 6


ITEMS = ["proof of payment,", "signed copy of the share register", "approval by the board;", "list of pending claims", "consent of the landlord, 3 May 2020", "release of the pledge.", "updated table of signatories", "evidence that insurance is in force"]
PROSE = "The parties acknowledge that the equipment was inspected before signing and found to be in good order. The Buyer shall pay."


@pytest.mark.parametrize(
    "text, kind",
    [
        (PROSE, None), (PROSE.upper(), None), (PROSE.lower(), None), (PROSE.replace(" ", "\n", 3), None), ("双方确认，签署之前已经查验交接记录。任何一方均可解除合同。", None), ("Стороны подтверждают, что осмотрели товар до подписания договора и нашли его в порядке.", None),
        ("\n".join(f"{k}. {w}" for k, w in enumerate(ITEMS, 1)), "list"), ("\n".join(f"• {w}" for w in ITEMS), "list"), ("\n".join(ITEMS), "list"),
        *[("\n".join(sep.join([f"Wolsel{k} LLC", ITEMS[k].split(",")[0], f"20{k}1-02-03", "open"]) for k in range(6)), "table") for sep in (" | ", "\t", "       ", ";")],
        ("asdf " * 60, "junk"), ("aGVsbG8gd29ybGQ0NzE2YWJjZGVm" * 8, "junk"), ("00000010  4b 76 09 1b 07 fa eb d6 e8 99 8d dd\n" * 9, "junk"), ("Ð¡ ÑÑÐ¾Ð¼ Ð¿ÐµÑÐµÐ´Ð°ÑÑ ÐºÐ¾Ð´ Ð½Ðµ" * 4, "junk"),
        ("T h e B u y e r s h a l l d e l i v e r a l l g o o d s t o t h e S e l l e r n o w", "junk"), ("xvz kjgh wrtp qsdf bnmk lpzr vcxw tgbh plmk wsdr frtg hjkn" * 2, "junk"),
    ],
)
def test_kinds(text, kind):
    s = statistics([text, PROSE])
    assert (KINDS[s["kind"][0]] if s["kind"][0] >= 0 else None) == kind and s["kind"][1] == -1


def test_quality_rows(spark):
    df = spark.createDataFrame([(1, PROSE, "x"), (1, PROSE, "x"), (2, None, "x"), (3, " \n", "x"), (4, "word " * 300_000, "x")], "doc_id long, text string, kind string")
    rows = text_quality(df, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 4]
    one = next(r for r in rows if r.doc_id == 1)
    assert one.n_words == len(PROSE.split()) and "too_few_words" in one.failures and one.kind is None
    assert next(r for r in rows if r.doc_id == 4).kind == "junk" and text_quality(df.where("false"), ["doc_id"]).count() == 0


def test_tables_of_characters():
    kinds = cp.class_table()
    assert kinds[ord("A")] & cp.UPPER and kinds[0x200B] & cp.HIDDEN and kinds[ord("ก")] & cp.THAI and kinds[ord("。")] & cp.TERM
    codes, starts = cp.join_codes(["ab", None, "c"])
    assert starts.tolist() == [0, 3, 4, 6] and len(codes) == 6
    assert cp.slices(np.array([5, 5, 50, 1]), 10) == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("n", [1, 2, 5, 9, 12, 40, 3000])
def test_gaps_marks_and_closers_of_any_length(n):
    got = lambda t: [t[a:b] for a, b in zip(*Splitter().cuts([t])[1:3])]
    assert got("It ends now." + " " * n + "The second one.") == ["It ends now.", "The second one."]
    assert got("It ends now" + "!" * n + " The second one.") == ["It ends now" + "!" * n, "The second one."]
    assert got("It ends now." + ")" * n + " The second one.") == ["It ends now." + ")" * n, "The second one."]
    assert got("สัญญานี้มีผลใช้บังคับ" + " " * n + "คู่สัญญาต้องปฏิบัติตาม") == ["สัญญานี้มีผลใช้บังคับ", "คู่สัญญาต้องปฏิบัติตาม"]


def test_every_document_that_is_no_prose_has_its_rule_and_reason(spark):
    from lexmill.llm.quality import KIND_RULES, REASONS, not_prose

    docs = spark.createDataFrame([(1, "- one item\n- two items\n- three items\n"), (2, "a | b | c\nd | e | f\n"), (3, "na " * 200), (4, "The Buyer shall pay the price in full before the end of the month."), (5, "x7#q 9$%k @@1z ~~3 q0q0 %%% 8zz #### zz9"), (6, None), (7, " \n ")], "doc_id long, text string")
    figures = text_quality(docs, ["doc_id"])
    got = {r.doc_id: (r.kind, r.reason, set(r.failed)) for r in not_prose(figures).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "list", 2: "table", 3: "junk", 5: "junk"}
    assert got[1][1] == "marked_entries" and got[2][1] == "cells" and got[3][1] == "repetition"
    for kind, reason, failed in got.values():
        assert failed <= set(KIND_RULES) and failed and reason in (*REASONS[kind], "repetition", "gibberish")
    assert {r.doc_id for r in figures.where("kind IS NOT NULL").collect()} == set(got)


def test_line_figures_equal_sql(spark):
    from lexmill.llm import queries
    from tests.compare import DATA, duck_rows, spark_rows

    for name, sql in queries.oracle_sql().items():
        assert spark_rows(queries.queries()[name](spark, DATA)) == duck_rows(sql)


def test_letters_without_a_class_compose_too():
    texts = ["각", "한글", "ொர", "ೋ", "각x", "ᅡᆨ", "áᅡ", "ဦ", "plain"]
    form, changed = normalise(texts)
    assert form == [unicodedata.normalize("NFC", t) for t in texts]
    assert changed.tolist() == [f != t for f, t in zip(form, texts)]
