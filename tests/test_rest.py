"""Rules of the patch gate and of grading, each with a patch that passes and one that fails."""

from lexmill.plans import rest
from tests.compare import DATA


def test_each_gate_rule_fires_where_it_should(spark):
    got = {}
    for r in rest.h28_gate_rules(spark, DATA).collect():
        got.setdefault(r.id, set()).add(r.rule)
    want = {2: {"V1"}, 3: {"V1"}, 4: {"V2"}, 5: {"V3"}, 6: {"V4"}, 7: {"V5"}, 8: {"V5"}, 10: {"V6"}, 12: {"V7"}, 13: {"V7"}, 15: {"V8"}, 16: {"V9"}, 18: {"V1"}}
    assert got == want
    assert not {1, 9, 11, 14, 17} & set(got)


def test_grading(spark):
    ok = {r.id: r.ok for r in rest.h29_patch_grading(spark, DATA).collect()}
    assert ok == {"x1": True, "x2": True, "x3": True, "x4": True, "x5": True, "x6": False, "x7": True, "x8": False, "x9": False, "n1": True, "n2": False}
    (s,) = rest.a19_grading_score(spark, DATA).collect()
    assert (s.required_pass, s.required_total, s.bonus_pass, s.bonus_total, s.violations) == (5, 6, 1, 3, 1)


def test_segments_and_noops(spark):
    hits = {(r.para, r.seg, r.rule) for r in rest.h38_segment_shapes(spark, DATA).collect()}
    assert {(1, 1, "article_collision"), (2, 1, "binding_word"), (3, 1, "double_space"), (4, 1, "bare_article"), (4, 2, "double_article"), (5, 1, "camel_case"), (5, 2, "word_then_digit"), (5, 3, "digit_then_word"), (1, 3, "digit_at_boundary")} <= hits
    assert not any(p == 6 for p, _, _ in hits)
    kept = {r.id: (r.kept, r.pairs) for r in rest.h39_noop_fixpoint(spark, DATA).collect()}
    assert kept == {1: ("|r:x|", 1), 2: ("||", 2), 3: ("|r:y|", 0), 4: ("|i:new||r:z|", 0), 5: ("|i:c|", 2), 6: ("||", 0)}


def test_folded_lines_unfold_to_the_whole_title(spark):
    for r in rest.k5_folded_lines(spark, DATA).collect():
        assert all(len(x.encode()) <= rest.OCTETS for x in r.line.split("\r\n")) and "\r\n " not in r.line.replace("\r\n ", "")
