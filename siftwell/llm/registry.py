"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from siftwell.llm import vectors, warc
from siftwell.llm.decontaminate import op6_decontaminate
from siftwell.llm.mixture import op7_mixture
from siftwell.llm.quality import op10_quality
from siftwell.llm.secrets import op3_secrets
from siftwell.llm.simhash import op4_simhash
from siftwell.llm.tokens import op8_tokens
from siftwell.llm.toxicity import op9_toxicity
from siftwell.llm.urls import op5_url_filter

QUERIES = {f.__name__: f for f in (warc.op1_warc, vectors.op2_near_vectors, op3_secrets, op4_simhash, op5_url_filter, op6_decontaminate, op7_mixture, op8_tokens, op9_toxicity, op10_quality)}
ORACLE: dict[str, str] = {"op1_warc": warc.ORACLE, "op2_near_vectors": vectors.ORACLE}
