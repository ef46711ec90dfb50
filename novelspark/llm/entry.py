"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from importlib import import_module

#: name -> (module, attribute with the oracle SQL or None)
QUERIES = {
    "op1_toxicity": ("toxicity", None),
    "op2_fingerprint": ("fingerprint", None),
    "op3_sharding": ("sharding", "oracle"),
    "op4_ngram_jaccard": ("neardup", "ORACLE"),
    "op5_decontamination": ("decontaminate", None),
    "op6_chat": ("chat", "ORACLE"),
    "op7_token_counts": ("tokencount", None),
    "op8_mixing": ("mixing", "ORACLE"),
    "op9_token_files": ("tokenfile", None),
    "op10_quality": ("quality", None),
    "op11_lm_scoring": ("lm", None),
    "op12_centroids": ("centroids", "oracle"),
    "op13_collocations": ("phrases", None),
}


def queries():
    return {name: import_module(f"{__package__}.{module}").query for name, (module, _) in QUERIES.items()}


def oracle_sql():
    out = {}
    for name, (module, attribute) in QUERIES.items():
        if attribute:
            found = getattr(import_module(f"{__package__}.{module}"), attribute)
            out[name] = found() if callable(found) else found
    return out
