"""Queries: operators applied to the given tables, with their SQL."""

from . import design, extra, labels, metrics, more, nested, patches, pools, rasters, sampling, scalars, selection, streams  # noqa: F401
from .registry import ORACLES, QUERIES

#: Integer columns of the SQL side that are to be 64 bits wide, as on the Spark side.
LONGS = {
    "c11_class_quantiles": "truth",
    "c12_aps_scores": "truth",
    "c19_threshold_labels": "label",
    "c1_cluster_weights": "label",
    "c20_precautionary": "label",
    "c44_leave_one_out_ensemble": "truth",
    "c48_deploy_threshold": "size",
    "c7_novelty": "label",
    "c8_bald": "truth",
    "io11_manifest": "n",
    "io4_geojson": "lat",
    "j11_feature_attach": "mask",
    "j14_neighbour_purity": "label",
    "j21_draw_covariates": "p_size",
    "j23_pixel_join": "a b",
    "m17_set_metrics": "truth",
    "m1_per_class": "cls",
    "m22_centroids": "label",
    "m24_curve_slopes": "truth",
    "m27_label_state": "cls",
    "m29_confident_joint": "truth conf",
    "m30_fold_counts": "truth",
    "m6_focus_metrics": "cls",
    "m8_stable_confusions": "truth",
    "m9_confusion_rates": "truth pred",
    "p19_map_class": "cls",
    "p25_growing_season": "first last offset",
    "p32_posterior_scores": "truth",
    "p33_set_size": "size",
    "p36_blend": "truth",
    "p37_gated_label": "truth label",
    "p38_cost_argmax": "label",
    "p39_restricted_argmax": "label",
    "p40_change_codes": "code",
    "p42_severity": "delta",
    "p46_coverage_gap": "g",
    "r10_built_shares": "year",
    "r10_patch_features": "year",
    "r10_pooled_cells": "year",
    "r15_point_evidence": "modal",
    "r19_pixel_median": "col",
    "r1_class_iou": "code",
    "r20_map_agreement": "code",
    "r23_pixel_features": "map_id",
    "r24_aligned_bands": "code",
    "s32_grouped_folds": "truth",
    "u6_disjoint_draws": "shared",
    "w7_zscore": "n_regionkey",
}
for _name, _columns in LONGS.items():
    _casts = ", ".join(f'"{c}"::bigint as "{c}"' for c in _columns.split())
    ORACLES[_name] = f"select * replace ({_casts}) from ({ORACLES[_name]})"
