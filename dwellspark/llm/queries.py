"""The queries of this subpackage by name, and DuckDB SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

from dwellspark.llm import decontamination, filter_audit, infilling, jaccard, substrings, vectors
from dwellspark.llm.bpe import op3_bpe
from dwellspark.llm.media_ogg import op10_ogg
from dwellspark.llm.packing import op5_packing
from dwellspark.llm.pii import op4_pii
from dwellspark.llm.quality import op1_quality
from dwellspark.llm.secrets_scan import op6_secrets
from dwellspark.llm.sharding import op8_shards

QUERIES = {
    "op1_quality": op1_quality,
    "op2_substrings": substrings.op2_substrings,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_vectors": vectors.op7_vectors,
    "op8_shards": op8_shards,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_ogg": op10_ogg,
    "op11_filters": filter_audit.op11_filters,
    "op12_infilling": infilling.op12_infilling,
    "op13_decontamination": decontamination.op13_decontamination,
}

ORACLES: dict[str, str] = {
    "op2_substrings": substrings.ORACLE,
    "op7_vectors": vectors.ORACLE,
    "op9_jaccard": jaccard.ORACLE,
    "op11_filters": filter_audit.ORACLE,
    "op12_infilling": infilling.ORACLE,
    "op13_decontamination": decontamination.ORACLE,
}
