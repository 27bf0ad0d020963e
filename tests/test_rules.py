"""Every rule and frame has its case."""

from lexmill.plans import harvest, scanner
from tests.compare import DATA


def test_every_frame_has_a_sentence(spark):
    s = harvest.sentences(spark, DATA).where("doc_id < 0").cache()
    for op in sorted({f.op for f in harvest.FRAMES}):
        frames = [f for f in harvest.FRAMES if f.op == op]
        for lang in ("en", "fr"):
            got = {r.frame for r in harvest.candidates(s.where(f"lang = '{lang}'"), frames).collect()}
            missing = {f.frame for f in frames if f.lang == lang} - got
            assert not missing, (op, lang)
    got = {(r.frame) for r in harvest.named(s, harvest.NAMES).collect()}
    assert got == {f.frame for f in harvest.NAMES}


def test_scores_caps_and_names(spark):
    s = harvest.sentences(spark, DATA).where("doc_id < 0")
    case = {text: -(k + 1) for k, (_, _, text) in enumerate(harvest.CASES)}
    rows = {(r.doc_id, r.frame): r.score for r in harvest.candidates(s, harvest.FRAMES).collect()}
    assert rows[case["The Owner may object."], "veto_right"] == 44
    assert rows[case["Notice is deemed given."], "notice_communication"] == 44
    assert rows[case["The Borrower must maintain insurance, including without limitation fire cover."], "continuing_duty"] == 68 + 7 - 7
    assert rows[case["The Company shall cause its affiliates to deliver the records within 10 business days after Closing."], "procurement_duty"] == 80 + 7 + 6 + 5
    assert rows[case["In the event of a breach the Seller shall pay a fee."], "payment_flow"] == 50
    assert (case["The Buyer shall pay the purchase price as follows:"], "payment_flow") not in rows
    assert (case["Data is transferred via encryption."], "privacy_control") not in rows
    assert rows[case["A hearing will be convened on March 3, 2030."], "dated_occurrence"] == 44
    names = {(r.frame, r.name) for r in harvest.named(s, harvest.NAMES).collect()}
    assert {("defined_party_alias", "Northgate Acquisitions Corp"), ("defined_party_alias", "Alder Mills Ltd"), ("service_provider_listed", "Vaultline LLC"), ("held_by", "Gamma Partners LP")} <= names


def test_every_scanner_rule_has_its_line(spark):
    rows = scanner.all_findings(spark, DATA).where("NOT startswith(path, 'documents/')").collect()
    assert {r.rule for r in rows} == {rule.name for rules in scanner.CATEGORIES.values() for rule in rules}
    by = {(r.path, r.rule) for r in rows}
    lines = dict(enumerate(scanner.TREE["run.py"], 1))
    hit = lambda rule: {lines[r.line_no] for r in rows if r.path == "run.py" and r.rule == rule}
    assert not any("192.168" in x for x in hit("public_ipv4")) and any("8.8.4.4" in x for x in hit("public_ipv4"))
    assert hit("eval") == {"eval(user_input)"} and hit("suid_mode") == {"os.chmod(p, 0o4755)"} and hit("password") == {"password = 'hunter2hunter2'"}
    fenced = {(r.line_no, r.rule): (r.category, r.severity) for r in rows if r.path == "SKILL.md"}
    assert fenced[5, "override"] == ("PROMPT-IN-CODE-FENCE", 1) and fenced[2, "override"] == ("PROMPT", 2) and ("requirements.txt", "unpinned") in by
