"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bitpack import op12_bit_packing
from tessera.llm.bpe import op2_bpe_transducer
from tessera.llm.class_lm import op1_class_lm
from tessera.llm.hard_negatives import ORACLE_SQL as HARD_NEGATIVES_SQL
from tessera.llm.hard_negatives import op11_hard_negatives
from tessera.llm.jaccard_join import op6_jaccard_prefix_tree
from tessera.llm.language_id import op7_language_id
from tessera.llm.packing import op8_best_fit_packing
from tessera.llm.quality_rules import op9_quality_rules
from tessera.llm.substring_dedup import op10_fingerprint_index
from tessera.llm.suffix_dedup import op3_suffix_dedup
from tessera.llm.toxicity import op5_string_kernel_svm
from tessera.llm.vector_codes import op13_vector_codes
from tessera.llm.vector_codes import oracle_sql as vector_codes_sql
from tessera.llm.vector_search import op4_permutation_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_class_lm,
        op2_bpe_transducer,
        op3_suffix_dedup,
        op4_permutation_index,
        op5_string_kernel_svm,
        op6_jaccard_prefix_tree,
        op7_language_id,
        op8_best_fit_packing,
        op9_quality_rules,
        op10_fingerprint_index,
        op11_hard_negatives,
        op12_bit_packing,
        op13_vector_codes,
    )
}

#: The others cannot be written whole in SQL at this size; tests/llm holds them against brute force instead.
ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": HARD_NEGATIVES_SQL, "op13_vector_codes": vector_codes_sql()}
