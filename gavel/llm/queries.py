"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import exact_dedup, jaccard, licenses, mixing, neighbours, packing, quality, sharding, tokens, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_sharding": sharding.op6_sharding,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_nearest": neighbours.op8_nearest,
    "op9_packing": packing.op9_packing,
    "op10_token_counts": tokens.op10_token_counts,
}

ORACLE_SQL = {"op1_url_filter": url_filter.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE, "op7_jaccard_join": jaccard.ORACLE}
