"""Tabular ETL operators on Spark DataFrames."""

from .functions.expressions import column, differs
from .functions.skew import SkewPolicy
from .operators.aggregates import groupby_agg, groupby_reduce
from .operators.columns import (
    add_column,
    drop,
    fillna,
    nan_to_null,
    rename,
    select,
    update_where,
    where,
    with_column,
    with_columns,
    with_literal,
)
from .operators.filters import filter_rows
from .operators.joins import join
from .operators.ordering import limit, order_by
from .operators.setops import distinct, union, union_by_name
from .operators.windows import window
from .plans.jobs import run_job
from .plans.operations import apply_ops, require_columns
from .sources.paths import enriched_path, object_store_uri
from .sources.readers import NA_TOKENS, read_table
from .sources.writers import write_table

__all__ = [
    "NA_TOKENS",
    "SkewPolicy",
    "add_column",
    "apply_ops",
    "column",
    "differs",
    "distinct",
    "drop",
    "enriched_path",
    "fillna",
    "filter_rows",
    "groupby_agg",
    "groupby_reduce",
    "join",
    "limit",
    "nan_to_null",
    "object_store_uri",
    "order_by",
    "read_table",
    "rename",
    "require_columns",
    "run_job",
    "select",
    "union",
    "union_by_name",
    "update_where",
    "where",
    "window",
    "with_column",
    "with_columns",
    "with_literal",
    "write_table",
]
