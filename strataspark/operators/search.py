"""Record search: one conjunction of pattern, type and id predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import contains, glob_to_like, like, parse_id_literal

LIMIT = 500


def search_records(
    records: DataFrame, query: str = "", record_type: str | None = None, editor_id: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """The first ``limit`` records, by type and id, that match all that is given.

    ``query`` is a part of the full name or editor id, or the form id itself;
    ``editor_id`` is a glob over the whole editor id. Case folds A-Z only.
    """
    found = records
    if record_type:
        found = found.where(F.col("record_type") == record_type)
    if editor_id:
        found = found.where(like(F.col("editor_id"), glob_to_like(editor_id)))
    if query:
        hit = contains(F.col("full_name"), query) | contains(F.col("editor_id"), query)
        number = parse_id_literal(query)
        if number is not None and -(1 << 63) <= number < 1 << 63:
            hit = hit | (F.col("form_id") == F.lit(number).cast("long"))
        found = found.where(hit)
    return found.orderBy("record_type", "form_id").limit(limit)
