"""Queries that do the whole job beside one that takes a slice."""

from pyspark.sql import functions as F

from lexmill.plans import catalog
from tests.compare import DATA

QUERIES = catalog.queries()


def test_index_holds_every_reference(spark):
    refs = spark.read.parquet(f"{DATA}/refs.parquet")
    want = {(r.source, r.ref_id) for r in refs.select("ref_id", F.explode("sources").alias("source")).collect()}
    rows = QUERIES["j11_postings"](spark, DATA).collect()
    got = [(r.source, int(k)) for r in rows for k in r.refs.split(",")]
    assert set(got) == want and len(got) == len(want) and max(len(r.refs.split(",")) for r in rows) <= 1024


def test_sentences_of_any_label_and_of_list_items(spark, tmp_path):
    rows = [(1, 0, "paragraph", "en"), (2, 0, "paragraph", "en-US"), (3, 0, "paragraph", None), (4, 0, "list_item", "en"), (5, 0, "heading", "en")]
    spark.createDataFrame([(*r, "The Buyer shall pay. The Seller agrees.") for r in rows], "doc_id long, idx int, block_type string, lang string, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.pos) for r in got("t1_plain_sentences")} == {(k, p) for k in (1, 2, 3, 4) for p in (1, 2)}
    assert {r.doc_id for r in got("h5_frame_candidates")} == {r.doc_id for r in got("u5_best_candidate")} == {1, 2, 3, 4}
    assert sum(r.n for r in got("h23_tier_decisions")) == len(got("h5_frame_candidates"))


def test_columns_of_any_number_and_titles_of_any_sign(spark, tmp_path):
    keys = [0, 1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 2**53 + 1, 2**63 - 1]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.n: (r.letters, r.back) for r in QUERIES["t21_column_letters"](spark, str(tmp_path)).collect()}
    assert all(got[k][1] == (k or None) for k in keys)
    assert [got[k][0] for k in keys[:10]] == [None, "A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "ZZZZ", "AAAAA"]
    spark.createDataFrame([(1, "a\\\\b {c} $~^")], "ref_id long, title string").write.parquet(f"{tmp_path}/refs.parquet")
    (row,) = QUERIES["t20_escapes"](spark, str(tmp_path)).where("ref_id = 1").collect()
    assert row.as_latex.count("textbackslash") == 2 and row.as_latex.endswith(r" \{c\} \$\textasciitilde{}\textasciicircum{}")


def test_all_citations_and_owners_of_a_block(spark, tmp_path):
    text = "Doe Ltd v. Roe and Foo Inc. v. Bar, 2004 SCC 12, [2010] EWCA Civ 7, 2003 CanLII 55; section 12(2) of the Sale of Goods Act; s. 14; Rule 5.1. "
    text += "The remaining 40.5% of the shares is held by Ann Zelby and the remaining 10% of the shares is held by Bob Orbin."
    spark.createDataFrame([(1, 0, text), (1, 0, text)], "doc_id long, idx int, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    got = {(r.kind, r.citation): r.cites for r in QUERIES["h16_every_citation"](spark, str(tmp_path)).collect()}
    assert got == {k: 1 for k in [("case", "Doe Ltd v. Roe"), ("case", "Foo Inc. v. Bar"), ("neutral", "2004 SCC 12"), ("neutral", "[2010] EWCA Civ 7"), ("canlii", "2003 CanLII 55"), ("act", "Sale of Goods Act"), ("statute_section", "section 12(2) of the Sale of Goods Act"), ("bare_section", "s. 14"), ("rule", "Rule 5.1")]}
    assert {(r.owner, r.share) for r in QUERIES["h13_every_owner"](spark, str(tmp_path)).collect()} == {("Ann Zelby", 40.5), ("Bob Orbin", 10.0)}
