"""JSON pointers against a plain walk."""

import json

import pytest
from pyspark.sql import functions as F

from trivalent.operators import assembly

BODY = {"a/b": {"~": [1, {"x": None}, [2]], "": "e"}, "~1": 3, "0": {"1": 4}, "it's": {'say "hi"?': 5}, "back\\slash": {"dot.dot": [6]}, "a[0]": 7, "$": True, "": {"": 8}, "01": 9, "é ü": "10", "last\n": 11}
NOTHING = object()


def plain(value, pointer):
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            value = value.get(key, NOTHING)
        elif isinstance(value, list) and key.isascii() and key.isdigit() and key == str(int(key)) and int(key) < len(value):
            value = value[int(key)]
        else:
            return NOTHING
    return value


POINTERS = ["", "/", "//", "/a~1b", "/a~1b/~0", "/a~1b/~0/0", "/a~1b/~0/1/x", "/a~1b/~0/2/0", "/a~1b/~0/3", "/a~1b/~0/00", "/a~1b/~0/-", "/a~1b/~0/-1", "/a~1b/~0/99999999999", "/a~1b/", "/~01", "/0/1", "/0/0", "/it's", '/it\'s/say "hi"?', "/back\\slash/dot.dot/0",
            "/a[0]", "/$", "/01", "/1", "/é ü", "/last\n", "/a~1b/~0/²", "/none", "/~01/0", "/a~1b/~0/0/0"]


@pytest.mark.parametrize("body", [BODY, [BODY, "x"], "text", 12, None])
def test_pointers_lead_where_a_plain_walk_does(spark, body):
    df = spark.createDataFrame([(json.dumps(body),)], "j string")
    pointers = POINTERS + ["/0" + p for p in POINTERS]
    row = df.select(*[F.to_json(assembly.pointer("j", p)).alias(f"p{i}") for i, p in enumerate(pointers)]).first()
    for i, p in enumerate(pointers):
        want = plain(body, p)
        got = NOTHING if row[i] is None else json.loads(row[i])
        assert (got is NOTHING and want is NOTHING) or got == want or (want is None and got in (None, NOTHING)), p


def test_pointers_into_what_is_no_json_and_pointers_that_are_none(spark):
    df = spark.createDataFrame([("{",), (None,), ("",)], "j string")
    assert all(r[0] is None for r in df.select(assembly.pointer("j", "/a").cast("string")).collect())
    with pytest.raises(ValueError):
        assembly.pointer("j", "a/b")
