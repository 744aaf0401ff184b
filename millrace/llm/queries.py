"""The queries of this subpackage, and DuckDB's SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import importlib

#: query -> (module, its SQL's name or None)
_WHERE = {
    "op1_mixing": ("mixing", "ORACLE"),
    "op2_ngram_jaccard": ("jaccard", None),
    "op3_warc": ("warc", "ORACLE"),
    "op4_quality": ("quality", None),
    "op5_decontamination": ("decontaminate", "ORACLE"),
    "op6_brown_lm": ("brown", None),
    "op7_chat_format": ("chat", "ORACLE"),
    "op8_toxicity": ("toxicity", None),
    "op9_line_dedup": ("line_dedup", None),
    "op10_cover_tree": ("embedding", None),
    "op11_fill_in_middle": ("fim", "ORACLE"),
    "op12_merkle_manifest": ("merkle", "ORACLE"),
    "op13_best_fit_packing": ("packing", None),
}

_MODULES = {name: importlib.import_module(f"millrace.llm.{module}") for name, (module, _) in _WHERE.items()}
QUERIES = {name: getattr(module, name) for name, module in _MODULES.items()}
ORACLES = {name: getattr(_MODULES[name], sql) for name, (_, sql) in _WHERE.items() if sql}
