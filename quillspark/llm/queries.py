"""The contract's queries, their SQL where there is any, and the operators they apply."""

from quillspark.llm import decontam, fingerprint, langid, mixing, neardup, pii, sufdedup, toxicity, urlfilter, warc

QUERIES = {
    "op1_sufdedup": sufdedup.op1_sufdedup,
    "op2_langid": langid.op2_langid,
    "op3_pii": pii.op3_pii,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_urlfilter": urlfilter.op6_urlfilter,
    "op7_neardup": neardup.op7_neardup,
    "op8_decontam": decontam.op8_decontam,
    "op9_mixing": mixing.op9_mixing,
    "op10_fingerprint": fingerprint.op10_fingerprint,
}
ORACLES = {"op8_decontam": decontam.OP8_SQL, "op6_urlfilter": urlfilter.OP6_SQL, "op9_mixing": mixing.OP9_SQL}
