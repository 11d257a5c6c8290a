import pytest
from pyspark.sql import types as T

from tessera.operators import cases


def test_inputs():
    good = ("text", ["a"], ["b"], {"node": 0.2, "chain": 0.8}, 5, 3)
    cases.check_inputs(*good)
    for i, bad in ((0, " "), (1, []), (2, []), (3, {"node": 0.5}), (3, {"node": 1.5, "chain": -0.5}), (4, 0), (5, 4)):
        with pytest.raises(ValueError):
            cases.check_inputs(*[bad if k == i else v for k, v in enumerate(good)])
    cases.check_pass_k(1, 1)
    for k, n in ((0, 1), (2, 1), (1, 0)):
        with pytest.raises(ValueError):
            cases.check_pass_k(k, n)


def test_tool_schema():
    def book(user_id: str, seats: int, insured: bool = False):
        """Books a seat."""

    text, schema = cases.tool_schema(book)
    assert text == "Books a seat." and [(f.name, f.dataType, f.nullable) for f in schema] == [("user_id", T.StringType(), False), ("seats", T.LongType(), False), ("insured", T.BooleanType(), True)]
