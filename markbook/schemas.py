"""Explicit schemas of the tables the operators take. Nothing is ever inferred."""

from __future__ import annotations

POINT = "struct<point_id:bigint,point_text:string,weight:double,aliases:array<string>>"
POINT_DETAIL = (
    "struct<point_id:bigint,hit_status:string,matched_alias:string,extracted_span:string,"
    "confidence:double,similarity:double,point_score:double,source:string>"
)
POINT_LABEL = (
    "struct<point_id:bigint,hit:boolean,hit_type:string,extracted_span:string,confidence:double,"
    "partial_credit:double,rationale:string>"
)
ALIGN = "struct<start:int,end:int,matched_text:string,strategy:string>"

QUESTIONS = (
    "question_id string, project_id string, content string, subject string, total_score double, "
    "standard_answer_text string, config_status string"
)
PROJECTS = (
    "project_id string, name string, description string, subject string, created_at timestamp, status string"
)
CONFIGS = (
    f"question_id string, total_score double, subject string, points array<{POINT}>, "
    "thresholds struct<similarity_high:double,similarity_low:double>, "
    "meta struct<parsed_by:string,parsed_at:string,confirmed_by_teacher:boolean>"
)
ANSWERS = (
    "answer_id string, question_id string, student_id string, class_name string, answer_text string, "
    "source string, ocr_text string"
)
RESULTS = (
    "answer_id string, question_id string, student_id string, class_name string, total_score double, "
    f"max_score double, rating string, point_details array<{POINT_DETAIL}>, ocr_confidence double"
)
LABELS = (
    "sample_id string, origin string, expert_total double, expert_step_label double, "
    "labels struct<question_id:string,student_answer:string,"
    "point_labels:array<struct<point_id:bigint,hit:boolean,hit_type:string,extracted_span:string,"
    f"confidence:double,partial_credit:double,rationale:string,align:{ALIGN}>>,"
    "labeling_meta:struct<model:string,temperature:double,self_consistency_votes:int,labeled_at:string>>"
)
ITEMS = (
    "source string, subject string, stage string, qid string, type string, question string, "
    "material string, choices map<string,string>, answer_letter string, answer_text string, "
    "explanation string, difficulty string, split string, note string"
)
SPANS = (
    "id string, question_id string, origin string, context string, query string, "
    "query_aliases array<string>, point_weight double, answer string, answer_start int, answer_end int, "
    "is_impossible boolean, hit_type string, split string"
)
PAIRS = (
    "question_id string, origin string, sentence1 string, sentence2 string, score double, source string, "
    "split string"
)
OCR_LINES = "question_id string, text string, box array<array<double>>, score double"
SEED_ITEMS = (
    "id string, question string, reference string, total double, manual_label string, "
    "steps array<struct<response:string,label:string>>"
)
SPAN_PREDICTIONS = "answer_id string, candidate string, has_answer_prob double, start int, end int"
SIMILARITIES = "answer_id string, point_text string, cosine double"
