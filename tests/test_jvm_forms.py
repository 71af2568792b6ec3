"""Functions as compositions of built-in ones, against Python's own."""

import base64
import random

import pytest

from tessera.functions import udfs
from tessera.plans import dialect


def column(spark, expression, values, kind):
    spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").createOrReplaceTempView("jvm_forms")
    got = dialect.run(spark, "/none", f"SELECT k, {expression} AS r FROM jvm_forms")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    return [r["r"] for r in sorted(got.collect())]


def test_base32(spark):
    rng = random.Random(1)
    values = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(40), 500]]
    texts = [base64.b32encode(v).decode() for v in values]
    assert column(spark, "TO_BASE32(x)", [*values, None], "binary") == [*texts, None]
    assert [v if v is None else bytes(v) for v in column(spark, "FROM_BASE32(x)", [*texts, None], "string")] == [*values, None]


@pytest.mark.parametrize("text", ["A", "a=======", "AAAAAAA!", "MFRGG="])
def test_invalid_base32(spark, text):
    with pytest.raises(Exception, match="base 32"):
        column(spark, "FROM_BASE32(x)", [text], "string")


def test_code_points(spark):
    values = [[72, 105], [0xFEFF, 65], [0x1F600, 0, 0xE9], [], None, [0x10FFFF], [None, 66]]
    assert column(spark, "CODE_POINTS_TO_STRING(x)", values, "array<bigint>") == [None if v is None else "".join(chr(c) for c in v if c) for v in values]
    assert column(spark, "CHR(x)", [65, 0, 0xFEFF, 0x1F600], "bigint") == ["A", "", "\ufeff", "\U0001f600"]


@pytest.mark.parametrize("more,stops", [("", None), (", ' '", " "), (", '^-]'", "^-]"), (", ''", "")])
def test_initcap(spark, more, stops):
    values = ["hello wORLD", "a-b_c.d", "", "  two  spaces ", "été ÉTÉ ß", "tab\tnew\nline", "x^y]z-w", None, "o'neil (jr) [sr]"]
    assert column(spark, f"INITCAP(x{more})", values, "string") == [None if v is None else udfs.initcap(v, stops) for v in values]
