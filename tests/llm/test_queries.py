import os

import pytest

from touchline.llm.tokens import VOCABULARY, encoder, token_count
from touchline.plans import model_queries, operator_queries, problems

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_token_counts(spark):
    texts = ["", None, "a", "Hello, world! it's 2024", "x" * 100_000, "Καλημέρα κόσμε"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(token_count("t")).collect()]
    assert got == [None if t is None else len(encoder().encode_ordinary(t)) for t in texts]
    assert encoder().decode(encoder().encode_ordinary(texts[3])) == texts[3]


def test_names_are_distinct():
    from touchline.llm import queries

    names = [n for m in (problems, model_queries, operator_queries, queries) for n in m.QUERIES]
    assert len(names) == len(set(names))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
