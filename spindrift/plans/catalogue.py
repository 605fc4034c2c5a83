"""All registered queries."""

from spindrift.plans import assembly_queries, ledger_queries, library_queries, planning_queries, recognizer_queries, similarity_queries, store_queries, stream_queries, text_queries, timeline_queries, wave_queries  # noqa: F401
from spindrift.plans.registry import ORACLES, QUERIES  # noqa: F401
