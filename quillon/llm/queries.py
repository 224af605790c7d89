"""The operators' queries over whole tables, and their SQL where it can express them."""

from . import decontamination, html, linededup, mixing, nearest, ngramjoin, phrases, prefixes, quality, secrets, suffixes, tokens, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_html": html.op2_html,
    "op3_suffixes": suffixes.op3_suffixes,
    "op4_secrets": secrets.op4_secrets,
    "op5_quality": quality.op5_quality,
    "op6_nearest": nearest.op6_nearest,
    "op7_ngramjoin": ngramjoin.op7_ngramjoin,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_linededup": linededup.op9_linededup,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_prefixes": prefixes.op11_prefixes,
    "op12_tokens": tokens.op12_tokens,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op3_suffixes": suffixes.ORACLE_SQL,
    "op7_ngramjoin": ngramjoin.ORACLE_SQL,
    "op10_decontamination": decontamination.ORACLE_SQL,
    "op11_prefixes": prefixes.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
