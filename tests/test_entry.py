import __spark_entry__
from treelake.jobs import all_jobs


def test_every_core_query_has_sql_or_is_a_listing():
    assert set(all_jobs.QUERIES) - set(all_jobs.ORACLES) == {"discover_files"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
