"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, html_text, minhash, pieces, quality, secrets, sharding, toxicity, vector_dedup

QUERIES = {"op1_quality": quality.op1_quality, "op2_sentencepiece": pieces.op2_sentencepiece, "op3_minhash": minhash.op3_minhash, "op4_toxicity": toxicity.op4_toxicity, "op5_vectors": vector_dedup.op5_vectors, "op6_chat": chat.op6_chat, "op7_decontaminate": decontaminate.op7_decontaminate, "op8_secrets": secrets.op8_secrets, "op9_html": html_text.op9_html, "op10_sharding": sharding.op10_sharding}
SQL = {"op6_chat": chat.OP6_SQL}
