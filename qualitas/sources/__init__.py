from qualitas.sources.tables import TABLES, table, dirty_payments, load_dirty_payments
from qualitas.sources.readers import (
    read_csv, read_json_array, read_json_documents, read_table, read_jdbc, read_mongo,
)

__all__ = ["TABLES", "table", "dirty_payments", "load_dirty_payments", "read_csv",
           "read_json_array", "read_json_documents", "read_table", "read_jdbc", "read_mongo"]
