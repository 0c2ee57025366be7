"""The queries of this subpackage, with SQL where SQL can express them."""

from flowloom.llm.bpe import op10_bpe
from flowloom.llm.chat_format import OP1_SQL, op1_chat_formatting
from flowloom.llm.fertility import op9_fertility_rules
from flowloom.llm.langid import op7_language_id
from flowloom.llm.license_scan import op2_license_scan
from flowloom.llm.mixing import OP4_SQL, op4_mixing
from flowloom.llm.simhash import op5_simhash_near_dedup
from flowloom.llm.suffix_dedup import op3_suffix_dedup
from flowloom.llm.token_files import op8_token_files
from flowloom.llm.topk import OP6_SQL, op6_top_k

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_top_k": op6_top_k,
    "op7_language_id": op7_language_id,
    "op8_token_files": op8_token_files,
    "op9_fertility_rules": op9_fertility_rules,
    "op10_bpe": op10_bpe,
}
ORACLE_SQL = {"op1_chat_formatting": OP1_SQL, "op4_mixing": OP4_SQL, "op6_top_k": OP6_SQL}
