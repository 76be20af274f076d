"""The registered query of each operator, with its production parameters, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op6_ann
from .decontam import op10_decontamination
from .language import op5_language
from .lexical import OP12_SQL, op12_lexical_search
from .lm import op2_lm_score
from .mixing import OP9_SQL, op9_mixing
from .packing import op8_token_ids
from .phrases import OP11_SQL, op11_collocations
from .pii import op13_pii
from .quotes import OP7_SQL, op7_chat_quotes
from .secret_scan import op4_secrets
from .simhash import op1_simhash
from .token_count import op3_token_counts


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_lm_score": op2_lm_score,
        "op3_token_counts": op3_token_counts,
        "op4_secrets": op4_secrets,
        "op5_language": op5_language,
        "op6_ann": op6_ann,
        "op7_chat_quotes": op7_chat_quotes,
        "op8_token_ids": op8_token_ids,
        "op9_mixing": op9_mixing,
        "op10_decontamination": op10_decontamination,
        "op11_collocations": op11_collocations,
        "op12_lexical_search": op12_lexical_search,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_quotes": OP7_SQL, "op9_mixing": OP9_SQL, "op11_collocations": OP11_SQL,
            "op12_lexical_search": OP12_SQL}
