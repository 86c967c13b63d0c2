"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from weftline.llm import collocations, hard_negatives, line_dedup, minhash_dedup
from weftline.llm.brown_lm import op8_brown_lm
from weftline.llm.decontaminate import op5_decontaminate
from weftline.llm.html_extract import op9_html_extract
from weftline.llm.language_id import op1_language_id
from weftline.llm.packing import op7_packing
from weftline.llm.quality_rules import op10_quality_rules
from weftline.llm.simhash import op4_simhash
from weftline.llm.substring_dedup import op2_substring_dedup
from weftline.llm.suffix_dedup import op6_suffix_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_brown_lm": op8_brown_lm,
    "op9_html_extract": op9_html_extract,
    "op10_quality_rules": op10_quality_rules,
    "op11_setsketch": minhash_dedup.op11_setsketch,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL: dict[str, str] = {"op3_line_dedup": line_dedup.SQL, "op11_setsketch": minhash_dedup.SQL, "op12_collocations": collocations.SQL, "op13_hard_negatives": hard_negatives.SQL}
