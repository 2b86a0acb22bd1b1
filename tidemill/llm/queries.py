"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemill.llm import chat, codes, fingerprints, licenses, manifest, mixing, neardup, packing, pii, quality, secrets, urls, vectors


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_chat_format": chat.op4_chat_format,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_url_filter": urls.op6_url_filter,
        "op7_packing": packing.op7_packing,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_personal_data": pii.op10_personal_data,
        "op11_near_vectors": vectors.op11_near_vectors,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_vector_codes": codes.op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": neardup.OP2_SQL, "op4_chat_format": chat.OP4_SQL, "op11_near_vectors": vectors.OP11_SQL, "op12_merkle_manifest": manifest.OP12_SQL, "op13_vector_codes": codes.OP13_SQL}
