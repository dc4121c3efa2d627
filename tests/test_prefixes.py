from glyphmill.operators import lexicon


def test_prefixes_of_many_lengths(spark):
    """More than 100 lengths of query: each finds its word."""
    word = "ab" * 60
    words = spark.createDataFrame([(word,), ("abc",), ("",)], "word string")
    queries = spark.createDataFrame([(word[:n],) for n in range(1, 121)], "query string")
    found = {(r.query, r.word) for r in lexicon.with_prefix(queries, words).collect()}
    assert found == {(word[:n], word) for n in range(1, 121)} | {("a", "abc"), ("ab", "abc")}
    assert lexicon.with_prefix(queries.limit(0), words).columns == ["query", "word", "place"]
