from weftgraph.llm import queries


def test_names():
    names = queries.queries()
    assert set(queries.oracle_sql()) <= set(names)
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 10):
        assert any(k.startswith(f"p{n}_") for k in names)
