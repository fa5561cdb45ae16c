"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from lattica.llm import chat, hmm, mixing, probminhash, quality, secrets, simhash, toxicity, warc, winnowing

OPERATORS = (mixing, toxicity, winnowing, quality, secrets, hmm, chat, warc, probminhash, simhash)
QUERIES = {name: query for module in OPERATORS for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in OPERATORS for name, sql in module.ORACLES.items()}
