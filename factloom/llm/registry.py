"""The training-data queries and their SQL."""

from . import bpe, chat, lines, mixing, neardup, negatives, neighbours, pipeline, quality, rank_bpe, search, sharding, tokens, toxicity

MODULES = (tokens, neighbours, toxicity, sharding, chat, quality, neardup, lines, mixing, bpe, search, rank_bpe, negatives)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": pipeline.run}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
