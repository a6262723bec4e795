"""From raw documents to token ids: toxicity, line dedup, near duplicates, source mix, byte-level BPE.

The stages are in ``factloom.llm.pipeline``; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.
"""

from factloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
