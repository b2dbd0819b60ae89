"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from cuelattice.llm import bpe, licences, media, negatives, packing, pii, prefixtrie, quality, secretscan, simhash, spotsigs, superminhash, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_packing": packing.op2_packing,
    "op3_spotsigs": spotsigs.op3_spotsigs,
    "op4_bpe": bpe.op4_bpe,
    "op5_simhash": simhash.op5_simhash,
    "op6_licences": licences.op6_licences,
    "op7_pii": pii.op7_pii,
    "op8_secrets": secretscan.op8_secrets,
    "op9_fixity": warc.op9_fixity,
    "op10_quality": quality.op10_quality,
    "op11_prefixtrie": prefixtrie.op11_prefixtrie,
    "op12_negatives": negatives.op12_negatives,
    "op13_superminhash": superminhash.op13_superminhash,
}

ORACLES: dict[str, str] = {"op6_licences": licences.oracle(), "op9_fixity": warc.oracle(), "op11_prefixtrie": prefixtrie.oracle(), "op12_negatives": negatives.oracle(), "op13_superminhash": superminhash.oracle()}
