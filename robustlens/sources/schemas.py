"""Declared schemas of the exchanged files; nothing is inferred at scale."""
PERTURBATION = "STRUCT<name: STRING, family: STRING, severity: INT, accuracy_drop: DOUBLE, loglik_drift: DOUBLE>"
LEVEL = f"STRUCT<csem: DOUBLE, cprompt: DOUBLE, clean_correct: INT, perturbations: ARRAY<{PERTURBATION}>>"
RECORD = f"rec_id BIGINT, rec_no INT, item_id BIGINT, levels MAP<STRING, {LEVEL}>"

BOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
FRAME = f"STRUCT<image: STRING, mask: ARRAY<INT>, instance_id: INT, boxes: ARRAY<{BOX}>, gt_boxes_all: ARRAY<{BOX}>, gt_masks_all: ARRAY<ARRAY<INT>>>"
MANIFEST = f"id STRING, split STRING, text_prompt STRING, concept STRING, concept_present BOOLEAN, frames ARRAY<{FRAME}>"

COCO = ("images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT>>, "
        "annotations ARRAY<STRUCT<image_id: BIGINT, category_id: INT, area: DOUBLE, bbox: ARRAY<DOUBLE>>>, "
        "categories ARRAY<STRUCT<id: INT, name: STRING, supercategory: STRING>>")

SCENE_OBJECT = "STRUCT<name: STRING, attributes: ARRAY<STRING>, relations: ARRAY<STRUCT<name: STRING, object: STRING>>>"
SCENE_GRAPH = f"image_id STRING, objects MAP<STRING, {SCENE_OBJECT}>"
SYNTHETIC_SCENE = ("image_index BIGINT, objects ARRAY<STRUCT<size: STRING, color: STRING, material: STRING, shape: STRING>>, "
                   "relationships MAP<STRING, ARRAY<ARRAY<INT>>>")

FILTER_RECORD = "image_id BIGINT, levels MAP<STRING, STRUCT<W_t: ARRAY<DOUBLE>, layer_groups: MAP<STRING, STRUCT<W_t: ARRAY<DOUBLE>>>>>"
RUN_SUMMARY = "config STRUCT<model: STRUCT<primary: STRING>>, per_level MAP<STRING, STRUCT<clean_accuracy: DOUBLE, perturbed_accuracy: DOUBLE, n: BIGINT>>"
