"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe import op3_bpe
from .cap_dedup import OP5_SQL, op5_cap_dedup
from .decontaminate import op9_decontaminate
from .html_text import op8_html_text
from .langid import op4_language_id
from .license_scan import op6_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .minhash import OP2_SQL, op2_minhash
from .suffix_dedup import OP1_SQL, op1_suffix_dedup
from .token_files import op7_token_files

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash": op2_minhash,
    "op3_bpe": op3_bpe,
    "op4_language_id": op4_language_id,
    "op5_cap_dedup": op5_cap_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_token_files": op7_token_files,
    "op8_html_text": op8_html_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
}

#: DuckDB SQL of those that SQL can express.
SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op2_minhash": OP2_SQL,
    "op5_cap_dedup": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
}
