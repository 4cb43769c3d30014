"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import bpe, chat, compression, divergence, embeddings, fingerprints, lines, lm, minhash, mixing, quality, tokenfile, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash, "op2_bpe": bpe.op2_bpe, "op3_tokenfile": tokenfile.op3_tokenfile, "op4_chat": chat.op4_chat, "op5_lines": lines.op5_lines, "op6_embeddings": embeddings.op6_embeddings, "op7_quality": quality.op7_quality, "op8_warc": warc.op8_warc, "op9_mixing": mixing.op9_mixing, "op10_lm": lm.op10_lm, "op11_compression": compression.op11_compression, "op12_divergence": divergence.op12_divergence, "op13_fingerprints": fingerprints.op13_fingerprints,
}
ORACLES = {"op1_minhash": minhash.OP1_SQL, "op4_chat": chat.OP4_SQL, "op5_lines": lines.OP5_SQL, "op6_embeddings": embeddings.OP6_SQL, "op8_warc": warc.OP8_SQL, "op11_compression": compression.OP11_SQL, "op12_divergence": divergence.OP12_SQL}
