import __spark_entry__ as entry


def test_queries_and_sql_agree():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert "related_documents" in names and "p6_found" in names
    assert all(callable(q) for q in names.values())
