"""Schemas of the relations. Readers are given them; nothing is inferred."""

QUESTIONS = "id string, question string, options map<string,string>, label string, medical_task string, body_system string, question_type string, images array<string>, image_paths array<string>"
CASE_IMAGES = (
    "u_id string, image_idx int, image_path string, uid_n_images bigint, title string, case_diagnosis string, differential_diagnosis string, modality string, plane string, "
    "location string, age string, sex string, history string, exam string, findings string, disease_discussion string"
)
CASE_TEXT = "pdf_path string, page_number int, text string"
SOURCE = "struct<u_id:string,rank:int,similarity:double,n_attached_images:int>"
RESULTS = (
    "qid string, condition string, gold string, predicted string, correct boolean, primary_parser string, predicted_official string, predicted_strict string, predicted_lenient string, "
    "predicted_boxed string, correct_official boolean, correct_strict boolean, correct_lenient boolean, correct_boxed boolean, raw_output string, body_system string, medical_task string, "
    f"question_type string, n_question_images int, n_retrieved_images int, ctx_chars int, sources array<{SOURCE}>"
)
