"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import functools
import importlib

from .common import modest

#: Query name and the module with the function of that name.
_MODULES = {
    "op1_bpe": "bpe",
    "op2_ngram_join": "ngram_join",
    "op3_warc": "warc",
    "op4_lm_scores": "suffix_tree",
    "op5_html_text": "html_text",
    "op6_decontaminate": "decontaminate",
    "op7_toxicity": "toxicity",
    "op8_line_dedup": "line_dedup",
    "op9_ann": "ann",
    "op10_language_id": "language",
}


def _modest(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        modest(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _modest(getattr(importlib.import_module(f"{__package__}.{module}"), name)) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup, warc

    return {"op3_warc": warc.OP3_SQL, "op8_line_dedup": line_dedup.OP8_SQL}
