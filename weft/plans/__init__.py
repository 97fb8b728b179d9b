"""Query plans over whole tables; importing this registers them."""

from . import change_queries, graph_queries, link_queries, record_queries, resolve_queries, source_queries, structure_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
