from granary.functions.expr import col, count_all, count_rows_with, int_div, is_false, is_true, like, lit, not_distinct

__all__ = ["col", "count_all", "count_rows_with", "int_div", "is_false", "is_true", "like", "lit", "not_distinct"]
