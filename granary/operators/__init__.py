from granary.operators.relational import (
    aggregate,
    cross_join,
    empty,
    filter_rows,
    join,
    join_using,
    limit,
    natural_join,
    project,
    rename_columns,
    scan,
    sort,
    values,
)

__all__ = [
    "aggregate", "cross_join", "empty", "filter_rows", "join", "join_using", "limit", "natural_join", "project",
    "rename_columns", "scan", "sort", "values",
]
