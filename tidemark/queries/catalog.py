"""All registered queries."""

from tidemark.queries import label_queries, plan_queries, search_queries, table_queries, text_queries, trend_queries  # noqa: F401
from tidemark.queries.base import SPARK, SQL  # noqa: F401
