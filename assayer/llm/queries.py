"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .conversation_trie import OP12_SQL, op12_conversation_trie
from .decontamination import OP11_SQL, op11_benchmark_decontamination
from .fingerprints import OP1_SQL, op1_fingerprints
from .media import op3_audio_features
from .mixing import op2_source_mixing
from .ngram_join import OP9_SQL, op9_ngram_join
from .packing import op6_best_fit_packing
from .pii import op4_personal_data
from .secrets import op10_secret_scan
from .spelling import OP13_SQL, op13_spelling_variants
from .suffix_dedup import OP5_SQL, op5_suffix_dedup
from .token_counts import op8_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_source_mixing,
        op3_audio_features,
        op4_personal_data,
        op5_suffix_dedup,
        op6_best_fit_packing,
        op7_toxicity,
        op8_token_counts,
        op9_ngram_join,
        op10_secret_scan,
        op11_benchmark_decontamination,
        op12_conversation_trie,
        op13_spelling_variants,
    )
}
ORACLE: dict[str, str] = {
    "op1_fingerprints": OP1_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op9_ngram_join": OP9_SQL,
    "op11_benchmark_decontamination": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
