"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame.

Where SQL cannot express an operator (hash partitions, trained models, tokenizers,
connected components, eigenvectors) it is tested against brute force, a library or
held-out labels in ``tests/llm``."""

from __future__ import annotations

from tankwise.llm.collocations import SQL as COLLOCATIONS_SQL
from tankwise.llm.collocations import op13_collocations
from tankwise.llm.decontaminate import op9_decontaminate
from tankwise.llm.external_shuffle import op10_external_shuffle
from tankwise.llm.licenses import op7_license_scan
from tankwise.llm.lm_score import op2_lm_score
from tankwise.llm.ngram_join import op1_ngram_join
from tankwise.llm.piece_codec import op5_piece_codec
from tankwise.llm.projection_forest import op3_projection_forest
from tankwise.llm.quality import op6_quality
from tankwise.llm.source_mix import SQL as SOURCE_MIX_SQL
from tankwise.llm.source_mix import op12_source_mix
from tankwise.llm.token_counts import op8_token_counts
from tankwise.llm.toxicity import op4_toxicity
from tankwise.llm.whitening import op11_whitening
from tankwise.plans.registry import prepare

ORACLE: dict[str, str] = {"op12_source_mix": SOURCE_MIX_SQL, "op13_collocations": COLLOCATIONS_SQL}


def _prepared(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {fn.__name__: _prepared(fn) for fn in (
    op1_ngram_join, op2_lm_score, op3_projection_forest, op4_toxicity, op5_piece_codec, op6_quality, op7_license_scan,
    op8_token_counts, op9_decontaminate, op10_external_shuffle, op11_whitening, op12_source_mix, op13_collocations,
)}
