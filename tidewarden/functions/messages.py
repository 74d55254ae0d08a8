"""What a JSON-RPC line is: one Arrow pass parses it into a struct column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import jsons

#: method -> the kind of message it makes.
KINDS = {
    "tools/list": "tools_list_request",
    "notifications/tools/list_changed": "tools_changed",
    "notifications/prompts/list_changed": "prompts_changed",
    "notifications/resources/list_changed": "resources_changed",
}

MESSAGE = T.StructType([
    T.StructField("parsed", T.BooleanType()),  # whether the line is JSON
    T.StructField("id", T.StringType()),  # the id as JSON text, `null` without one
    T.StructField("method", T.StringType()),
    T.StructField("tool", T.StringType()),  # of tools/call
    T.StructField("kind", T.StringType()),  # one of KINDS' values, tools_list_response, or null
    T.StructField("target", T.StringType()),  # the text that is scanned
])


def describe(raw: str | None) -> dict[str, Any]:
    try:
        message = jsons.loads(raw or "")
        target = jsons.scan_target(raw or "")
    except (ValueError, RecursionError):
        return {"parsed": False, "id": None, "method": None, "tool": None, "kind": None, "target": None}
    fields = message if isinstance(message, dict) else {}
    method = fields.get("method") if isinstance(fields.get("method"), str) else None
    params = fields.get("params") if isinstance(fields.get("params"), dict) else {}
    name = params.get("name") if method == "tools/call" else None
    result = fields.get("result") if isinstance(fields.get("result"), dict) else {}
    kind = KINDS.get(method or "") or ("tools_list_response" if isinstance(result.get("tools"), list) else None)
    return {"parsed": True, "id": jsons.compact(fields.get("id")), "method": method, "tool": name if isinstance(name, str) else None, "kind": kind, "target": target}


@F.pandas_udf(MESSAGE)
def message(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The struct MESSAGE of a JSON line."""
    for batch in batches:
        yield pd.DataFrame([describe(x) for x in batch], columns=MESSAGE.names)
