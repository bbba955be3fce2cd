"""The registered queries of this subpackage and, where SQL can express them, their twins."""

from __future__ import annotations

import corpus_pipeline
from lumentab.llm import align, decontaminate, jaccard, licenses, mixing, quality, secret_scan, simhash, spelling, substring, topk, toxicity, urls
from lumentab.llm.common import read

QUERIES = {
    "op1_substring_dedup": lambda s, d: substring.op1(read(s, d, "documents")),
    "op2_ngram_jaccard": lambda s, d: jaccard.op2(read(s, d, "documents")),
    "op3_mix_sources": lambda s, d: mixing.op3(read(s, d, "documents")),
    "op4_top_k": lambda s, d: topk.op4(read(s, d, "embeddings")),
    "op5_url_filter": lambda s, d: urls.op5(read(s, d, "pages")),
    "op6_secrets": lambda s, d: secret_scan.op6(read(s, d, "documents")),
    "op7_toxicity": lambda s, d: toxicity.op7(read(s, d, "documents"), read(s, d, "labels")),
    "op8_licenses": lambda s, d: licenses.op8(read(s, d, "documents")),
    "op9_quality": lambda s, d: quality.op9(read(s, d, "documents"), read(s, d, "labels")),
    "op10_decontaminate": lambda s, d: decontaminate.op10(read(s, d, "documents"), read(s, d, "benchmark")),
    "op11_spelling": lambda s, d: spelling.op11(read(s, d, "documents")),
    "op12_simhash": lambda s, d: simhash.op12(read(s, d, "documents")),
    "op13_align": lambda s, d: align.op13(read(s, d, "documents")),
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_top_k": topk.OP4_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
