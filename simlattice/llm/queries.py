"""Registered queries of this package and the SQL they are checked with."""

from __future__ import annotations

from simlattice.llm.ann import op5_ann
from simlattice.llm.bpe import op10_bpe
from simlattice.llm.cotrain import op1_cotrain
from simlattice.llm.hosts import op6_hosts, op6_sql
from simlattice.llm.html import op8_html
from simlattice.llm.jaccard import op3_jaccard
from simlattice.llm.lm import op7_lm
from simlattice.llm.mixing import op4_mix, op4_sql
from simlattice.llm.negatives import op13_negatives, op13_sql
from simlattice.llm.pivots import op12_pivots, op12_sql
from simlattice.llm.rules import op2_rules, op2_sql
from simlattice.llm.toxicity import op9_toxicity
from simlattice.llm.whiten import op11_whiten

QUERIES = {
    "op1_cotrain": op1_cotrain,
    "op2_rules": op2_rules,
    "op3_jaccard": op3_jaccard,
    "op4_mix": op4_mix,
    "op5_ann": op5_ann,
    "op6_hosts": op6_hosts,
    "op7_lm": op7_lm,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_whiten": op11_whiten,
    "op12_pivots": op12_pivots,
    "op13_negatives": op13_negatives,
}

ORACLES = {"op2_rules": op2_sql(), "op4_mix": op4_sql(), "op6_hosts": op6_sql(), "op12_pivots": op12_sql(), "op13_negatives": op13_sql()}
