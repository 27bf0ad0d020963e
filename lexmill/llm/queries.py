"""Queries of the operators in this package; ``queries()`` maps names to callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.session import cut_lineage, table


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph and list-item blocks with text that is not blank."""
    blocks = table(spark, sf_dir, "blocks").where(F.col("block_type").isin("paragraph", "list_item"))
    return blocks.where(F.col("text").rlike(r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every paragraph and list item, with their places."""
    from lexmill.llm.sentences import lexicon_guards, split_sentences

    guards = lexicon_guards(table(spark, sf_dir, "lexicons"))
    return split_sentences(text_blocks(spark, sf_dir), ["doc_id", "idx"], guards=guards)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mentions of the same person or company."""
    from lexmill.llm.identity import mention_pairs, mentions, resolve
    from lexmill.llm.works import records, work_groups

    refs = table(spark, sf_dir, "refs")
    works = work_groups(cut_lineage(records(refs)), cut_lineage)
    return mention_pairs(resolve(mentions(table(spark, sf_dir, "parties"), refs), cut_lineage, works))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with its entity, one row per mention."""
    from lexmill.llm.identity import mentions, resolve
    from lexmill.llm.works import records, work_groups

    refs = table(spark, sf_dir, "refs")
    works = work_groups(cut_lineage(records(refs)), cut_lineage)
    return resolve(mentions(table(spark, sf_dir, "parties"), refs), cut_lineage, works)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each work that supplies its title, authors and DOI."""
    from lexmill.llm.works import best_records

    return best_records(table(spark, sf_dir, "refs"), table(spark, sf_dir, "source_trust"), cut_lineage)


def p3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per work, sources united."""
    from lexmill.llm.works import merged_records

    return merged_records(table(spark, sf_dir, "refs"), table(spark, sf_dir, "source_trust"), cut_lineage)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose text or anchor differs from its consistent form."""
    from lexmill.llm.normal import normalise_fields

    blocks = table(spark, sf_dir, "blocks")
    return normalise_fields(blocks, ["doc_id", "idx"], {"text": False, "anchor": True}, only_changed=True).select("doc_id", "idx", "field").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of blocks and documents whose labels are missing, wrong or too few."""
    from lexmill.llm.language import relabel

    found = relabel(text_blocks(spark, sf_dir), table(spark, sf_dir, "documents"), cut_lineage)
    return found.select("doc_id", "idx", "seg_no", "lang")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a container, for each capacity."""
    from lexmill.llm.packing import VOCABULARY, pack_documents

    vocabulary = spark.conf.get("lexmill.vocabulary", VOCABULARY)
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"), cut_lineage, vocabulary=vocabulary)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a held-out test item, whole or in part."""
    from lexmill.llm.leaks import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for more than half of their characters no running prose."""
    from lexmill.llm.quality import not_prose, text_quality

    return not_prose(text_quality(table(spark, sf_dir, "documents"), ["doc_id"])).select("doc_id", "kind").distinct()


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, shares and failed rules of every document."""
    from lexmill.llm.quality import text_quality

    return text_quality(table(spark, sf_dir, "documents"), ["doc_id"])


def p9_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no running prose, by kind, reason and failed rule."""
    from lexmill.llm.quality import not_prose, text_quality

    rows = not_prose(text_quality(table(spark, sf_dir, "documents"), ["doc_id"]))
    return rows.select("kind", "reason", F.explode("failed").alias("rule")).groupBy("kind", "reason", "rule").agg(F.count(F.lit(1)).alias("documents"))


def p9_line_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text, and how many of them end in a sentence's mark or in an ellipsis."""
    from lexmill.llm.quality import text_quality

    rows = text_quality(table(spark, sf_dir, "documents"), ["doc_id"])
    number = lambda c: F.round(F.col(c) * F.col("n_lines")).cast("long")
    return rows.select("doc_id", "n_lines", number("end_punct_share").alias("ended"), number("ellipsis_share").alias("trailing"))


#: White space and characters that show nothing, as the operators take them.
_NOTHING = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"
P9_LINE_FIGURES_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, regexp_replace(line, '{_NOTHING}+$', '') AS line FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '[.!?…。！？।؟]["''”’»)\]」』“]{{0,2}}$') AND NOT regexp_matches(line, '^["''”’»)\]」』“]$')) AS ended,
  count(*) FILTER (regexp_matches(line, '(…|[.][.])$')) AS trailing
FROM s WHERE line <> '' GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_merged": p3_merged, "p4_found": p4_found, "p5_found": p5_found, "p7_pack": p7_pack, "p8_found": p8_found, "p9_found": p9_found, "p9_statistics": p9_statistics, "p9_reasons": p9_reasons, "p9_line_figures": p9_line_figures}


def oracle_sql() -> dict[str, str]:
    return {"p9_line_figures": P9_LINE_FIGURES_SQL}
