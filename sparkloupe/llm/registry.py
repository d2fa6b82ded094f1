"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, hnsw, language_id, licenses, mixing, pii_boost, secrets, simhash, suffix_dedup, warc

QUERIES = {
    "op1_hnsw": hnsw.op1_hnsw,
    "op2_language_id": language_id.op2_language_id,
    "op3_warc": warc.op3_warc,
    "op4_pii": pii_boost.op4_pii,
    "op5_licenses": licenses.op5_licenses,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontam": decontam.op7_decontam,
    "op8_secrets": secrets.op8_secrets,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES: dict[str, str] = {
    "op1_hnsw": hnsw.ORACLE,
    "op3_warc": warc.ORACLE,
    "op8_secrets": secrets.ORACLE,
}
