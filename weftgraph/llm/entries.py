"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from weftgraph.llm.bpe import op12_bpe
from weftgraph.llm.centroids import OP11_SQL, op11_centroids
from weftgraph.llm.decontam import op7_decontam
from weftgraph.llm.exactdup import OP6_SQL, op6_exact
from weftgraph.llm.langid import op2_langid
from weftgraph.llm.mixing import op1_mix
from weftgraph.llm.neardup import op10_simhash
from weftgraph.llm.negatives import OP13_SQL, op13_negatives
from weftgraph.llm.quality import op5_quality
from weftgraph.llm.tokens import op3_tokens
from weftgraph.llm.toxicity import op9_toxicity
from weftgraph.llm.urlfilter import op4_urls
from weftgraph.llm.warc import OP8_SQL, op8_warc


def queries():
    found = (op1_mix, op2_langid, op3_tokens, op4_urls, op5_quality, op6_exact, op7_decontam, op8_warc, op9_toxicity, op10_simhash, op11_centroids, op12_bpe, op13_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact": OP6_SQL, "op8_warc": OP8_SQL, "op11_centroids": OP11_SQL, "op13_negatives": OP13_SQL}
