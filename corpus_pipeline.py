"""The stages of the corpus pipeline, for those who look for them at the top; they are in gnomon.llm.pipeline."""

from gnomon.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, exact_dedup, near_dedup, packing, run, secrets, toxicity

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "exact_dedup", "near_dedup", "packing", "run", "secrets", "toxicity"]
