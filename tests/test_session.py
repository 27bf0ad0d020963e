"""Tables in the shared folder."""

import os

from lexmill import session


def test_tables_are_written_read_and_cleaned_up(spark):
    df = session.cut_lineage(spark.range(10))
    assert df.count() == 10 and session.cut_lineage(df.where("false")).count() == 0
    session.put_file(spark, f"{session.scratch(spark)}/a/b.txt", b"x")
    assert session.clean_up(spark) and not os.path.exists(session._tables(spark))
    assert session.cut_lineage(spark.range(3)).count() == 3
