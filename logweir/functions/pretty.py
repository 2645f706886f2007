"""Indented JSON, the one text form Spark cannot write itself."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _indent(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        # A lone surrogate, usual in text that was cut off, cannot be passed on as text.
        return json.dumps(json.loads(text), ensure_ascii=False, indent=2).encode("utf-8", "replace").decode()
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """JSON indented by two spaces; null stays null."""
    return texts.map(_indent)
