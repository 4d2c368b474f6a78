"""The queries of the corpus operators, and their SQL where SQL can state the result."""

from __future__ import annotations

from inkwell.llm.ann import op8_ann
from inkwell.llm.audit import OP11_SQL, op11_audit
from inkwell.llm.bpe import op2_bpe
from inkwell.llm.langid import op3_langid
from inkwell.llm.media import op1_media
from inkwell.llm.mixing import OP10_SQL, op10_mixing
from inkwell.llm.packing import op13_packing
from inkwell.llm.quality import op6_quality
from inkwell.llm.simhash import op4_simhash
from inkwell.llm.toxicity import op9_toxicity
from inkwell.llm.urlfilter import op5_urlfilter
from inkwell.llm.variants import OP12_SQL, op12_variants
from inkwell.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_media": op1_media,
    "op2_bpe": op2_bpe,
    "op3_langid": op3_langid,
    "op4_simhash": op4_simhash,
    "op5_urlfilter": op5_urlfilter,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_ann": op8_ann,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_audit": op11_audit,
    "op12_variants": op12_variants,
    "op13_packing": op13_packing,
}
ORACLES: dict[str, str] = {"op7_warc": OP7_SQL, "op10_mixing": OP10_SQL, "op11_audit": OP11_SQL, "op12_variants": OP12_SQL}
