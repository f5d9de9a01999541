def test_entry_and_names(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 18
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "ratelens"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "ratelens.llm" not in path.read_text(), path
