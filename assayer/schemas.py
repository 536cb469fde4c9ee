"""Declared schemas of the tables the engine reads; nothing is inferred."""

from __future__ import annotations

CANDIDATE = "struct<text: string, source: string, type: string, candidate_uid: string>"

SCHEMAS: dict[str, str] = {
    "audit_manifest": "item_id string, triplet_id string, factor string, variant string, image_path string, scene_path string, question string, candidate_a string, candidate_b string, expected_preference string, seed long, render_seed long, qc_status string, qc_flags array<string>, matching_contract string, audit_dataset_version string, source_dir string",
    "static_manifest": "item_id string, question_id string, image_id string, image_path string, factor string, variant string, question string, gold_answer string, hard_negative string, candidate_a string, candidate_b string, expected_preference string, split string, dataset string",
    "downstream_manifest": f"item_id string, question_id string, image_id string, factor string, question string, gold string, gold_answer string, n_pool int, candidates array<{CANDIDATE}>, gold_index int, partial boolean, split string, dataset string",
    "judgments": "item_id string, triplet_id string, factor string, variant string, model_id string, raw_output string, parsed_preference string, score_a double, score_b double, margin double, latency_ms double, status string, candidate_a string, candidate_b string",
    "pairs": "schema_version string, pool_id string, item_id string, model_id string, factor string, dataset string, pair_key string, left_uid string, right_uid string, raw_output string, parsed_preference string, score_a double, score_b double, outcome string, status string",
    "selections": "pool_id string, item_id string, model_id string, factor string, dataset string, n int, status string, selected_uid string, gold_uid string, success boolean, utility_success boolean, scores map<string, double>, n_pairs int, ties int, semantic_abstentions int, tie_break_applied boolean",
    "scores": "pool_id string, model_id string, factor string, candidate_uid string, score double",
    "audit_metrics": "model_id string, factor string, n long, n_cond long, base_acc double, PFC double, PSC double, PFC_cond double, PSC_cond double",
    "static_metrics": "model_id string, factor string, A double, n long",
    "utility": "model_id string, factor string, N int, U double, n_pools long, semantic_abstention_rate double",
    "primary_table": "model_id string, factor string, family string, dataset string, A double, PFC double, PSC double, U double, n_static long, n_downstream long, primary_n int",
    "gqa_mapping": "question_id string, image_id string, split string, question string, answer string, types struct<structural: string, semantic: string, detailed: string>, factor string, mapping_source string, mapping_confidence string, hard_negative string, hard_negative_type string",
    "physical_sha": "split string, item_id string, factor string, carrier string, image_id string, image_path string, physical_image_id string",
    "qc_report": "triplet_id string, factor string, status string, flags array<string>",
    "model_registry": "model_id string, family string, checkpoint string, worker string, fast_track_primary boolean, status string",
    "scene_objects": "triplet_id string, variant string, object_id string, role string, shape string, color string, size string, material string, x double, y double, rotation double, pixel_coords array<double>, coords array<double>",
    "journal": "id string, x long",
    "status": "worker string, pid long, model string, stage string, done long, total long, observed_unix double",
}

FACTORS = ("count", "attribute", "presence", "spatial")
VARIANTS = ("base", "relevant", "irrelevant")
STATES = tuple(f"{b}{r}{i}" for b in (0, 1) for r in (0, 1) for i in (0, 1))
