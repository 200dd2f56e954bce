"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import ann, decontam, lines, packing, quality, secrets, sharding, simhash, substrings, urls

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_packing": packing.op2_packing,
    "op3_quality": quality.op3_quality,
    "op4_simhash": simhash.op4_simhash,
    "op5_sharding": sharding.op5_sharding,
    "op6_url_filter": urls.op6_url_filter,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_decontamination": decontam.op10_decontamination,
}

ORACLES = {
    "op6_url_filter": urls.ORACLE,
    "op9_line_dedup": lines.ORACLE,
}
