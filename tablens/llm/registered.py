"""The registered queries of the corpus operators and their DuckDB twins."""
from __future__ import annotations

import corpus_pipeline

from .blockjoin import SQL_NEAREST, op11_nearest_neighbours
from .convtrie import SQL_TRIE, op13_conversation_trie
from .decontam import op6_decontamination
from .mixing import SQL_MIX, op7_source_mix
from .neardup import SQL_MINHASH, op4_minhash_neardup
from .neighbours import SQL_VECTORS, op3_embedding_neardup
from .pagetext import op10_page_text
from .pii import op2_personal_data
from .quality import op5_quality
from .secrets import SQL_SECRETS, op1_secret_scan
from .spelling import SQL_SPELLING, op12_spelling_variants
from .toxicity import op8_toxicity
from .urlrules import SQL_URLS, op9_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_personal_data": op2_personal_data,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_source_mix": op7_source_mix,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_page_text": op10_page_text,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_trie": op13_conversation_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_secret_scan": SQL_SECRETS,
    "op3_embedding_neardup": SQL_VECTORS,
    "op4_minhash_neardup": SQL_MINHASH,
    "op7_source_mix": SQL_MIX,
    "op9_url_filter": SQL_URLS,
    "op11_nearest_neighbours": SQL_NEAREST,
    "op12_spelling_variants": SQL_SPELLING,
    "op13_conversation_trie": SQL_TRIE,
}
