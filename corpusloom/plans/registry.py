"""All registered queries and their SQL oracles."""

from __future__ import annotations

from corpusloom.plans import (
    chat_queries,
    filter_queries,
    merge_queries,
    sampling_queries,
    score_queries,
    source_queries,
    translation_queries,
    vocab_queries,
)

MODULES = (
    source_queries, merge_queries, filter_queries, chat_queries, translation_queries, sampling_queries,
    vocab_queries, score_queries,
)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
