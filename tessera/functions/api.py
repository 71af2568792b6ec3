"""The dialect's functions for DataFrame code: ``call("SAFE_DIVIDE", "a", "b")`` is a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def call(name: str, *args) -> Column:
    """A function over expressions in the dialect; sessions need ``udfs.register`` for those Spark lacks."""
    from tessera.plans.translate import Translator

    t = Translator(f"{name}({', '.join(map(str, args))})")
    e = t.expr()
    t.done()
    return F.expr(str(e))


def expression(text: str) -> Column:
    """Any expression of the dialect."""
    from tessera.plans.translate import Translator

    t = Translator(text)
    e = t.expr()
    t.done()
    return F.expr(str(e))
