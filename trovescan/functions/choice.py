"""Reading the choice out of a response text, with Python's JSON rules.

The JVM parsers accept trailing text and other things that Python rejects, and
the error messages belong to the result, so these few lines run as an
Arrow-batched function over one row per query.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CHOICE = "valid boolean, selected_index int, parse_error string"


def lenient(content: str | None, hits: int) -> tuple[bool, int | None, str | None]:
    """Anything int() accepts counts as an index; what fails is noted."""
    valid, error, parsed = True, None, None
    try:
        parsed = json.loads(content or "")
    except (ValueError, RecursionError) as e:
        valid, error = False, f"json_parse_error: {e}"
    wish = parsed.get("index") if isinstance(parsed, dict) else None
    if wish is None:
        return valid, None, error
    try:
        place = int(wish)
    except (TypeError, ValueError, OverflowError) as e:
        return valid, None, f" cast_index_error:{e}"
    if 0 <= place < hits:
        return valid, place, error
    return valid, None, f" invalid_index:{wish}"


def strict(content: str | None, hits: int) -> tuple[bool, int | None, str | None]:
    """Only a JSON integer (or boolean) in range is an index; what fails is an error text."""
    try:
        parsed = json.loads(content)
    except (ValueError, TypeError, RecursionError) as e:
        return False, None, str(e)
    if not isinstance(parsed, dict):
        return True, None, f"'{type(parsed).__name__}' object has no attribute 'get'"
    wish = parsed.get("index")
    good = isinstance(wish, int) and 0 <= wish < hits
    return True, int(wish) if good else None, None


def choice(content: Column, hits: Column, mode: str = "lenient") -> Column:
    """Struct (valid, selected_index, parse_error) of a response over ``hits`` documents."""
    read = {"lenient": lenient, "strict": strict}[mode]

    @F.pandas_udf(_CHOICE)
    def read_all(texts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rows = [
            read(None if pd.isna(text) else text, int(count))
            for text, count in zip(texts, counts)
        ]
        found = pd.DataFrame(rows, columns=["valid", "selected_index", "parse_error"])
        return found.astype({"selected_index": "Int32", "parse_error": object})

    return read_all(content, hits)
