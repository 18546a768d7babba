from qualitas.functions import grammar
from qualitas.functions.predicates import (
    as_text, is_present, is_number_like, to_number, parse_timestamp, is_likely_date,
    is_year_only, is_id_column, is_year_column, name_has_any,
)
from qualitas.functions.urls import is_public_url, is_valid_table_name
from qualitas.functions.text import percent_text, count_sentence

__all__ = [
    "grammar", "as_text", "is_present", "is_number_like", "to_number", "parse_timestamp",
    "is_likely_date", "is_year_only", "is_id_column", "is_year_column", "name_has_any",
    "is_public_url", "is_valid_table_name", "percent_text", "count_sentence",
]
