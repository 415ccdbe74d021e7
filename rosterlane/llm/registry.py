"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import negatives, phrases
from .decontaminate import op2_decontaminate
from .lexicon import op12_bpe_lexicon
from .licenses import op4_licenses
from .mixing import op9_mixing
from .near_dup import op6_near_duplicates
from .negatives import op13_hard_negatives
from .phrases import op11_collocations
from .pii import op10_surrogates
from .quality import op1_quality
from .repeats import op5_repeats
from .token_files import op7_token_files
from .tokens import op3_token_counts
from .toxicity import op8_toxicity

QUERIES = {
    "op6_near_duplicates": op6_near_duplicates,
    "op3_token_counts": op3_token_counts,
    "op7_token_files": op7_token_files,
    "op1_quality": op1_quality,
    "op4_licenses": op4_licenses,
    "op9_mixing": op9_mixing,
    "op8_toxicity": op8_toxicity,
    "op10_surrogates": op10_surrogates,
    "op5_repeats": op5_repeats,
    "op2_decontaminate": op2_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_bpe_lexicon": op12_bpe_lexicon,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op11_collocations": phrases.ORACLE_SQL, "op13_hard_negatives": negatives.ORACLE_SQL}
