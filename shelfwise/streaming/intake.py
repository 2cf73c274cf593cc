"""JSON feedback intake: one event a line, with what is wrong with it.

Every line gives a row. Fields are read as text and cast one by one, so one of
the wrong type is told apart from a missing one and from a broken line; fields
that the schema doesn't know are passed over, missing ones are null. A line's
text stays with the event, and goes to the rejects with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Why a line is rejected before its event is looked at.
MALFORMED = "malformed"
BAD_TYPE = "bad_type"
MISSING_USER = "missing_user"
MISSING_BOOK = "missing_book"

_FIELDS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "book_id": "bigint", "event": "string", "rating_value": "int"}
_CORRUPT = "_corrupt_record"


def parse_feedback(lines: DataFrame) -> DataFrame:
    """(event_id, ts, user_id, book_id, event, rating_value, intake_reason, raw) of lines (value), batch or stream.

    ``intake_reason`` is null for a line whose event can be judged. A blank
    line, one that isn't a JSON object and a null are malformed. A number
    written as text counts as that number; an event without a time or an id is
    taken as the oldest.
    """
    schema = ", ".join(f"{name} string" for name in _FIELDS) + f", {_CORRUPT} string"
    x = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = lines.select(F.col("value").alias("raw"), x.alias("x"))
    cast = {name: F.expr(f"try_cast(x.{name} AS {kind})") for name, kind in _FIELDS.items()}
    wrong = F.lit(False)
    for name, kind in _FIELDS.items():
        nested = F.col(f"x.{name}").rlike(r"^\s*[\[{]") if kind == "string" else F.lit(False)
        wrong = wrong | (F.col(f"x.{name}").isNotNull() & (cast[name].isNull() | nested))
    # The parser reports nothing for a line that is only white space or a bare value.
    broken = F.col("x").isNull() | F.col(f"x.{_CORRUPT}").isNotNull() | ~F.coalesce(F.col("raw").rlike(r"^\s*\{"), F.lit(False))
    reason = (F.when(broken, F.lit(MALFORMED)).when(wrong, F.lit(BAD_TYPE))
              .when(F.col("x.user_id").isNull(), F.lit(MISSING_USER)).when(F.col("x.book_id").isNull(), F.lit(MISSING_BOOK)))
    return rows.select(*[F.when(~broken, c).alias(name) for name, c in cast.items()], reason.alias("intake_reason"), "raw")
