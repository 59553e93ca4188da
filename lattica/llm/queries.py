"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, minhash, quality, token_counts, token_files, toxicity, urls, warc

_MODULES = (urls, minhash, decontaminate, quality, bpe, toxicity, token_counts, warc, token_files, chat)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= getattr(_m, "ORACLE_SQL", {})
