"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, decontaminate, gnat, hmm, html, jaccard, langid, packing, pii, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_hmm": hmm.op2_hmm,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_langid": langid.op5_langid,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_secrets": secrets.op8_secrets,
    "secrets_shared": secrets.secrets_shared,
    "op9_html": html.op9_html,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_gnat": gnat.op11_gnat,
    "op12_pii": pii.op12_pii,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.SQL,
    "op8_secrets": secrets.SQL,
    "secrets_shared": secrets.SQL_SHARED,
    "op10_jaccard": jaccard.SQL,
    "op11_gnat": gnat.SQL,
    "op13_collocations": collocations.SQL,
}
