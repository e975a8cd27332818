"""The opN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import centroids, codes, decontaminate, html, jaccard, licenses, packing, quality, rules, shards, suffixes, tokens, toxic

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_rans_tokens": tokens.QUERY,
        "op2_suffix_dedup": suffixes.QUERY,
        "op3_permutation_sharding": shards.QUERY,
        "op4_compression_classifier": quality.QUERY,
        "op5_rule_ledger": rules.QUERY,
        "op6_jaccard_join": jaccard.QUERY,
        "op7_boosted_html": html.QUERY,
        "op8_toxic_spans": toxic.QUERY,
        "op9_best_fit_packing": packing.QUERY,
        "op10_latent_decontamination": decontaminate.QUERY,
        "op11_slice_codes": codes.QUERY,
        "op12_subvector_centroids": centroids.QUERY,
        "op13_license_diagonals": licenses.QUERY,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_permutation_sharding": shards.sql(),
        "op5_rule_ledger": rules.SQL,
        "op11_slice_codes": codes.sql(),
        "op12_subvector_centroids": centroids.sql(),
        "op13_license_diagonals": licenses.sql(),
    }
