"""Row access policies: who may see which rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.translate import Translator


class AccessDenied(PermissionError):
    """The caller may not do this to a table with row policies."""


def require_all(engine, entry, what: str) -> None:
    """Copying or extracting a table as a whole needs the right to all its rows."""
    own = [p for p in entry.policies.values() if any(grants(g, engine.user) for g in p["grantees"])]
    if entry.policies and not any(p["filter"].strip().upper() == "TRUE" for p in own):
        raise AccessDenied(f"Access Denied: {what} needs access to all rows")


def grants(grantee: str, user: str) -> bool:
    """Whether a grantee such as ``user:a@x.org``, ``domain:x.org`` or ``allUsers`` takes a caller in."""
    kind, _, value = grantee.partition(":")
    if kind in ("allUsers",):
        return True
    if kind == "allAuthenticatedUsers":
        return bool(user)
    if kind == "domain":
        return user.lower().endswith("@" + value.lower())
    if kind in ("user", "serviceAccount", "group"):
        return value.lower() == user.lower()
    return False


def restrict(engine, df: DataFrame, entry) -> DataFrame:
    """The rows that any of the caller's policies lets through; with policies but none for the caller, no row."""
    if not entry.policies:
        return df
    own = [p["filter"] for p in entry.policies.values() if any(grants(g, engine.user) for g in p["grantees"])]
    if not own:
        return df.where(F.lit(False))
    tests = []
    for text in own:
        t = Translator(text, engine)
        tests.append(f"coalesce({t.expr()}, false)")
        t.done()
    return df.where(F.expr(" OR ".join(tests)))
