"""Queries of the corpus operators and the SQL of those that SQL expresses."""

from __future__ import annotations

from gnomon.llm import backoff, exact, language, near, packing, pipeline, secrets, tokenfile, toxicity, transducer, vectors


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_minhash_near_dedup": near.op2_minhash_near_dedup,
        "op3_token_file": tokenfile.op3_token_file,
        "op4_nearest_neighbours": vectors.op4_nearest_neighbours,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_exact_dedup": exact.op7_exact_dedup,
        "op8_sentencepiece": transducer.op8_sentencepiece,
        "op9_lm_scoring": backoff.op9_lm_scoring,
        "op10_language_id": language.op10_language_id,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": near.OP2_SQL, "op4_nearest_neighbours": vectors.OP4_SQL, "op7_exact_dedup": exact.OP7_SQL, "op9_lm_scoring": backoff.OP9_SQL}
