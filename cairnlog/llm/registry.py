"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from cairnlog.llm.ann import op8_ann
from cairnlog.llm.bpe import op6_bpe
from cairnlog.llm.lm import op9_lm
from cairnlog.llm.minhash import op7_minhash
from cairnlog.llm.packing import op4_packing
from cairnlog.llm.pii import op5_pii
from cairnlog.llm.quality import op3_quality
from cairnlog.llm.rules import op2_quality_rules
from cairnlog.llm.sstable import op10_sstable
from cairnlog.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_minhash": op7_minhash,
    "op8_ann": op8_ann,
    "op9_lm": op9_lm,
    "op10_sstable": op10_sstable,
}
ORACLE_SQL: dict[str, str] = {}
