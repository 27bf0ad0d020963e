"""Readers and writers on small and broken files."""

from lexmill.operators import patches, spans
from lexmill.plans.files import docx_fixture
from lexmill.sources import files as S, sinks as K


def test_broken_and_empty_files(spark):
    rows = [("a.docx", bytearray(b"no zip")), ("b.md", bytearray(b"")), ("c.txt", None), ("d", bytearray("Ünï\n\n- x".encode())), ("e.docx", bytearray(docx_fixture()))]
    got = S.parse_documents(spark.createDataFrame(rows, "path string, content binary")).collect()
    codes = {r.path: r.warnings for r in got}
    assert codes["a.docx"] == ["UNREADABLE"] and codes["b.md"] == ["EMPTY"] and codes["c.txt"] == ["EMPTY"] and codes["e.docx"] == []
    assert [(r.block_type, r.text) for r in got if r.path == "d"] == [("paragraph", "Ünï"), ("list_item", "x")]


def test_delimiters_and_lines():
    assert S.sniff_delimiter('"a,b";c;d') == ";" and S.sniff_delimiter("a") == "," and S.sniff_delimiter("a|b|c") == "|"
    long = "SUMMARY:" + "é" * 80
    folded = K.fold_line(long)
    assert folded.replace("\r\n ", "") == long and all(len(x.encode()) <= 75 for x in folded.split("\r\n"))


def test_tree_and_journal(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x").write_text("no")
    (tmp_path / "a.txt").write_text("yes")
    assert [(r.path.rsplit("/", 1)[1], r.code) for r in S.read_tree(spark, str(tmp_path)).collect()] == [("a.txt", None)]
    lines = spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,)], "value string")
    assert [r.a for r in S.journal_rows(lines, "a int").collect()] == [1]


def test_patches_and_edits():
    doc = {"a": [1, 2], "b/c": {"~": 0}}
    assert patches.get(doc, "/b~1c/~0") == 0
    assert patches.apply(doc, [{"op": "add", "path": "/a/1", "value": 9}, {"op": "remove", "path": "/a/0"}]) == {"a": [9, 2], "b/c": {"~": 0}}
    assert doc["a"] == [1, 2] and patches.check(doc, [{"op": "remove", "path": "/a/7"}]) == ["POINTER"]
    rules = [spans.EditRule("quotes", "quotes", ""), spans.EditRule("sp", " {2,}", " ")]
    text, ledger = spans.edits('a  "b"  c', rules)
    assert text == "a « b » c" and len(ledger) == 4
    assert spans.edits('say "b', rules)[0] == 'say "b' and spans.edits("a  b  c", rules, frozenset(["sp#2"]))[0] == "a b  c"
