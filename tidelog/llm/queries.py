"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import decontaminate, gif, hilbert, language, licenses, near_dedup, pieces, token_files, urls, warc

QUERIES = {
    "op1_hilbert_shards": hilbert.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_language": language.op3,
    "op4_token_files": token_files.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_pieces": pieces.op6,
    "op7_url_rules": urls.op7,
    "op8_gif": gif.op8,
    "op9_licenses": licenses.op9,
    "op10_warc": warc.op10,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op7_url_rules": urls.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
}
