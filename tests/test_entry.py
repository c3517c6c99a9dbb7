import __spark_entry__ as e


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries()) and "p5_found" in e.queries()


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns == ["citation", "doc_id", "source", "words", "tokens", "part"] and df.count() > 0
