"""callsift: HTTP-traffic analytics as composable Spark DataFrame operators.

Every operator is a plain function ``(df, ...params) -> DataFrame`` over the
canonical request schema in :mod:`callsift.schema`; nothing runs until the
caller triggers an action.
"""

from callsift.schema import REQUEST_SCHEMA, conform
from callsift.session import build_session

__all__ = ["REQUEST_SCHEMA", "build_session", "conform"]
