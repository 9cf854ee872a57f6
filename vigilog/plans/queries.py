"""All registered queries."""

from vigilog.plans import activity_queries, ingest_queries, source_queries, store_queries, story_queries, table_queries  # noqa: F401
from vigilog.plans.registry import QUERIES  # noqa: F401
