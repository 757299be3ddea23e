"""All registered queries, by importing the modules that register them."""

from listingscope.plans import queries_graph, queries_pages, queries_reports, queries_sources, queries_tables, queries_text  # noqa: F401
from listingscope.plans.registry import QUERIES, SQL  # noqa: F401
