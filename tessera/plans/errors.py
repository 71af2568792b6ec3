"""What kind of error a failed statement is, in the warehouse's terms."""

from __future__ import annotations

from tessera.plans.lexer import SqlError
from tessera.sources.policies import AccessDenied
from tessera.sources.storage import Duplicate, NotFound

# Conditions of Spark that are not plain invalid queries.
NOT_FOUND = ("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_ROUTINE", "SCHEMA_NOT_FOUND", "PATH_NOT_FOUND")
DUPLICATE = ("TABLE_OR_VIEW_ALREADY_EXISTS", "SCHEMA_ALREADY_EXISTS", "ROUTINE_ALREADY_EXISTS", "PATH_ALREADY_EXISTS")
HTTP = {"invalid": 400, "invalidQuery": 400, "notFound": 404, "duplicate": 409, "accessDenied": 403}


def reason(error: BaseException) -> str:
    """notFound, duplicate, accessDenied, invalid (arguments) or invalidQuery."""
    if isinstance(error, NotFound):
        return "notFound"
    if isinstance(error, Duplicate):
        return "duplicate"
    if isinstance(error, AccessDenied):
        return "accessDenied"
    if isinstance(error, SqlError):
        return "invalidQuery"
    condition = (getattr(error, "getCondition", None) or getattr(error, "getErrorClass", lambda: ""))() or ""
    if condition.startswith(NOT_FOUND):
        return "notFound"
    if condition.startswith(DUPLICATE):
        return "duplicate"
    return "invalidQuery" if condition else "invalid"


def payload(error: BaseException) -> dict:
    """The body of an error response."""
    why, text = reason(error), str(error).split(" SQLSTATE")[0]
    return {"error": {"code": HTTP[why], "message": text, "errors": [{"message": text, "domain": "global", "reason": why}], "status": why}}
