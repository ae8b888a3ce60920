"""Schemas of the tables that the data plane reads and writes (DDL; every field may be null)."""

SPLIT = "id string, classification boolean, batch_name string"
ENRICHED = "video_id string, summary string, layout_category string, is_sludge boolean"
MANIFEST = "video_id string, batch string, frame_path string, time_s double, classification boolean, is_sludge boolean, layout_category string, summary string, split string"
TEST_MANIFEST = "video_id string, batch string, frame_path string, split string, classification boolean, layout_category string, enriched_summary string"
REPLY = "struct<sludge:string,layout:string,description:string,explanation:string>"
TEACHER = f"frame_path string, video_id string, split string, time_s double, gt_classification boolean, gt_is_sludge boolean, gt_layout string, teacher_raw string, teacher {REPLY}"
CROSS = "frame_path string, video_id string, split_source string, gt_is_sludge boolean, teacher_sludge string, teacher_layout string, teacher_desc string, judge_sludge string, judge_reason string, judge_raw string"
CONVERSATION = "id string, image string, conversations array<struct<from:string,value:string>>, _meta struct<split:string,task:string,layout:string,is_sludge:boolean>"
FEATURES = "image string, idx long, ok boolean, features array<array<float>>"
FEATURES_META = "num_query_tokens int, hidden_size int, dtype string, count long, failed long, bundle string"
FEATURES_FAILED = "idx long"
LOSS_LOG = "step long, epoch double, wall_s double, loss double, grad_norm double, learning_rate double, eval_loss double"
EVALUATED = "frame_path string, video_id string, gt boolean, layout string, reply string, error string"
