"""Fields of an event as text: envelope columns, and paths into its JSON document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numeric path segments that are resolved at most; each doubles the alternatives.
MOST_NUMERIC = 3
NUMBER = r"^-?[0-9]+(\.[0-9]+)?\z"


def event_time() -> Column:
    """The time an event is about: its own, else that of its arrival."""
    return F.coalesce("event_time", "received_at")


def _json_path(segments: list[tuple[str, bool]]) -> str:
    return "$" + "".join(f"[{s}]" if index else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s, index in segments)


def path_text(document: Column, path: str) -> Column:
    """Text at a dotted path of a JSON document; null where it is missing or JSON null.

    A segment of digits is an index in an array and a key in an object; a negative one counts from the
    end of an array. Objects and arrays read as their JSON text.
    """
    segments = path.split(".")
    numeric = [i for i, s in enumerate(segments) if s.isdigit()]
    if len(numeric) > MOST_NUMERIC:
        raise ValueError(f"more than {MOST_NUMERIC} numeric segments in {path!r}")
    for i, s in enumerate(segments):
        if s.startswith("-") and s[1:].isdigit():
            parent = path_text(document, ".".join(segments[:i])) if i else document
            items = F.from_json(parent, T.ArrayType(T.StringType()))
            item = F.coalesce(F.get(items, F.size(items) + F.lit(int(s))), F.get_json_object(parent, _json_path([(s, False)])))
            return path_text(item, ".".join(segments[i + 1 :])) if i + 1 < len(segments) else item
    alternatives = []
    for mask in range(1 << len(numeric)):
        as_index = {n for k, n in enumerate(numeric) if mask >> k & 1}
        alternatives.append(F.get_json_object(document, _json_path([(s, i in as_index) for i, s in enumerate(segments)])))
    return alternatives[0] if len(alternatives) == 1 else F.coalesce(*reversed(alternatives))


def field(name: str) -> Column:
    """A field as text: an envelope column by its query name, else a path of `parsed`; @path is always a path."""
    columns = {
        "_raw": F.col("raw"),
        "raw": F.col("raw"),
        "source_type": F.col("source_type"),
        "dataset": F.col("source_type"),
        "collector_id": F.col("collector_id"),
        "_id": F.col("id"),
        "_insert_time": F.col("received_at").cast("string"),
        "_time": event_time().cast("string"),
    }
    if name.startswith("@"):
        return path_text(F.col("parsed"), name[1:])
    return columns[name] if name in columns else path_text(F.col("parsed"), name)


def number(text: Column) -> Column:
    """The value of number-looking text, null for any other."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def default_alias(function: str, name: str | None) -> str:
    return function if name is None else f"{function}_{name.replace('.', '_')}"
