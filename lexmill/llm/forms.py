"""Which words of people's names are given names, and which of these are forms of one another, learned from all names.

A comma tells the surname from the given names; the counts of such names decide
about those without a comma. Given names that stand for one another are learned
from people of one surname and one affiliation: where a given name's companion
there is again and again the same one, it is a form of it.

Both tables grow with the number of different names only, and are joined, never
broadcast by hand or collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.persons import name_parts

#: People in whose names a companion must be seen, and its least share of all companions.
FORM_PEOPLE, FORM_SHARE = 2, 0.3


def word_hints(typed: DataFrame) -> DataFrame:
    """``typed, given, family``: the words of each name without a comma that others show to be one or the other.

    ``typed`` has each name once, in ``typed``, with the number of its mentions ``n``.
    """

    @F.pandas_udf("array<struct<word string, what int>>")
    def parts(names: pd.Series) -> pd.Series:
        def one(t):
            family, given, open_words = name_parts(t)
            return [{"word": w, "what": k} for k, ws in enumerate((open_words, given, family)) for w in dict.fromkeys(ws)]

        return names.map(one)

    words = typed.select("typed", F.explode(parts("typed")).alias("x")).select("typed", "x.*")
    known = words.where("what > 0").groupBy("word").agg(F.count_if(F.col("what") == 1).alias("as_given"), F.count_if(F.col("what") == 2).alias("as_family"))
    told = words.where("what = 0").join(known, "word")
    pick = lambda test: F.collect_set(F.when(test, F.col("word")))
    return told.groupBy("typed").agg(pick(F.col("as_given") > F.col("as_family")).alias("given"), pick(F.col("as_family") > F.col("as_given")).alias("family"))


def given_forms(profiles: DataFrame) -> DataFrame:
    """``form, stands_for``: given names that are forms of more frequent ones; ``profiles`` has ``core, strong, soft, n`` of people."""
    seen = profiles.where("strong IS NOT NULL AND soft <> '' AND core <> ''").groupBy("core", "strong", "soft").agg(F.sum("n").alias("n"))
    # Each name of a person beside the person's most frequent one, never all pairs.
    usual = seen.groupBy("core", "strong").agg(F.max_by("soft", F.struct("n", "soft")).alias("usual"), F.count(F.lit(1)).alias("k")).where("k > 1")
    beside = seen.join(usual, ["core", "strong"]).where("soft <> usual")
    pairs = beside.select(F.least("soft", "usual").alias("a"), F.greatest("soft", "usual").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("people"))
    both = pairs.select(F.col("a").alias("form"), F.col("b").alias("other"), "people").unionByName(pairs.select(F.col("b").alias("form"), F.col("a").alias("other"), "people"))
    total = seen.groupBy("soft").agg(F.count(F.lit(1)).alias("total"))
    rated = both.join(total.select(F.col("soft").alias("form"), F.col("total").alias("own")), "form").join(total.select(F.col("soft").alias("other"), F.col("total").alias("others")), "other")
    rated = rated.join(both.groupBy("form").agg(F.sum("people").alias("all_people")), "form").where((F.col("people") >= FORM_PEOPLE) & (F.col("people") >= FORM_SHARE * F.col("all_people")))
    up = rated.where((F.col("others") > F.col("own")) | (F.col("others") == F.col("own")) & (F.length("other") > F.length("form")) | (F.col("others") == F.col("own")) & (F.length("other") == F.length("form")) & (F.col("other") < F.col("form")))
    return up.groupBy("form").agg(F.max_by("other", F.struct("people", "others", "other")).alias("stands_for"))
