"""The corpus queries and their SQL."""

from sonoframe.llm.bpe import op6_bpe_round_trip
from sonoframe.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from sonoframe.llm.language_id import op8_language_id
from sonoframe.llm.license_scan import op10_license_scan
from sonoframe.llm.mixing import OP2_SQL, op2_source_mix
from sonoframe.llm.quality_classifier import op4_quality_classifier
from sonoframe.llm.quality_rules import OP9_SQL, op9_quality_rules
from sonoframe.llm.simhash import op5_simhash_near_dedup
from sonoframe.llm.token_store import op7_token_store
from sonoframe.llm.url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_url_filter": op3_url_filter,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_token_store": op7_token_store,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
}
SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op2_source_mix": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op9_quality_rules": OP9_SQL,
}
