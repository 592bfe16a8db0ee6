"""The queries of this subpackage and the SQL that says what they return."""

from __future__ import annotations

from aforo.llm.chat_format import OP2_SQL, op2_chat_format
from aforo.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from aforo.llm.decontaminate import op3_decontaminate
from aforo.llm.embedding_dedup import OP12_SQL, op12_embedding_dedup
from aforo.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from aforo.llm.merkle import OP11_SQL, op11_merkle_manifest
from aforo.llm.near_dedup import op5_near_dedup
from aforo.llm.pii import op9_pii
from aforo.llm.sentencepiece_codec import op1_sentencepiece
from aforo.llm.sharding import op10_sharding
from aforo.llm.suffix_dedup import op6_suffix_dedup
from aforo.llm.toxicity import op7_toxicity
from aforo.llm.url_filter import op4_url_filter

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_near_dedup": op5_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op2_chat_format": OP2_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_embedding_dedup": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
