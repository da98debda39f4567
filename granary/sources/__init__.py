from granary.sources.ddl import TableStore
from granary.sources.parquet import TABLES, register_views, table

__all__ = ["TABLES", "TableStore", "register_views", "table"]
