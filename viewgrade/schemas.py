"""Declared schemas; JSON is never inferred, as view maps have data-dependent keys."""

SAMPLES = """sample_id string, dataset string, split string, sequence_frame string, question_id string, question_type string,
 subtask_type string, uav_id string, question string, options string, correct_answer string,
 uav_paths map<string,string>, distorted_uav_paths map<string,string>,
 distortion_info struct<type:string,category:string,level:int,intensity:double,seed:bigint>,
 vlm_scores map<string,double>, cognitive_score double"""
MODEL_DETAILS = "sample_id string, model string, prompt string, ref_answer string, dist_answer string, bleu double, rouge_l double, cider double"
TASKS = "task_id string, file_path string, chunk_id int, start int, end int, status string, retry_count int, updated_at timestamp"
