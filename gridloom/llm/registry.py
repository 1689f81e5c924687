"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import clusters, collocations, counting, html, logbilinear, packing, quality, sampling, secrets, sharding, simhash, tokenfile, vectors

QUERIES = {
    "op1_kneser_ney_quality": quality.query,
    "op2_lattice_sampling": sampling.query,
    "op3_linear_grouping_packing": packing.query,
    "op7_hash_prefix_forest": vectors.query,
    "op8_bit_plane_token_files": tokenfile.query,
    "op4_forest_secret_scan": secrets.query,
    "op5_site_template_removal": html.query,
    "op6_jump_sharding": sharding.query,
    "op9_edit_aware_counts": counting.query,
    "op10_simhash_trie_dedup": simhash.query,
    "op11_annulus_clustering": clusters.query,
    "op12_log_bilinear_scores": logbilinear.query,
    "op13_sketched_collocations": collocations.query,
}

ORACLE_SQL: dict[str, str] = {"op11_annulus_clustering": clusters.SQL, "op13_sketched_collocations": collocations.SQL}
