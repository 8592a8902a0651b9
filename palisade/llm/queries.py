"""The queries of this subpackage, by name, and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm.collocations import op11_phrase_collocations
from palisade.llm.decontamination import op13_benchmark_decontamination
from palisade.llm.jaccard_join import op5_ngram_jaccard_join
from palisade.llm.language_id import op6_language_id
from palisade.llm.ogg_media import op4_ogg_media
from palisade.llm.oracles import OP5_SQL, OP8_SQL, OP11_SQL, OP13_SQL
from palisade.llm.packing import op10_vector_packing
from palisade.llm.periodic_runs import op12_periodic_runs
from palisade.llm.pii_surrogates import op7_pii_surrogates
from palisade.llm.prefix_bpe import op9_prefix_bpe
from palisade.llm.quality_rules import op2_quality_rules
from palisade.llm.secret_scan import op1_secret_scan
from palisade.llm.substring_dedup import op8_substring_dedup
from palisade.llm.toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_toxicity": op3_toxicity,
        "op4_ogg_media": op4_ogg_media,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_language_id": op6_language_id,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_prefix_bpe": op9_prefix_bpe,
        "op10_vector_packing": op10_vector_packing,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_benchmark_decontamination": op13_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard_join": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op11_phrase_collocations": OP11_SQL, "op13_benchmark_decontamination": OP13_SQL}
