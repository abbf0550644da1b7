"""Schemas of files that are read with a declared shape."""

TENANT = "id int, name string, description string, created_at timestamp"
USER = (
    "id long, username string, real_name string, role string, clearance_level int, tenant_id int, status int, "
    "created_at timestamp"
)
CATEGORY = "id long, name string, parent_id long, sort_order int"
DOCUMENT = (
    "id long, title string, content string, file_name string, file_size long, file_hash string, file_type string, "
    "category_id long, tenant_id int, status string, upload_by long, doc_level string, min_level int, "
    "view_count long, created_at timestamp"
)
ACL = "document_id long, user_id long, granted_by long, created_at timestamp"
QA_HISTORY = (
    "id long, user_id long, conversation_id long, question string, answer string, documents string, "
    "model_used string, token_count long, created_at timestamp"
)
CONVERSATION = "id long, user_id long, title string, created_at timestamp, updated_at timestamp"
FEEDBACK = "id long, history_id long, user_id long, rating int, reason string, created_at timestamp"
LOGIN_LOG = (
    "id long, user_id long, username string, ip_address string, login_status int, login_message string, created_at timestamp"
)
MODEL_CONFIG = "id long, model_type string, model_name string, is_active int, pending_rebuild int"
ELEMENTS = "doc_id long, elements array<struct<kind:string,text:string,page:int>>"

GOLDEN = (
    "question string, answer string, relevant_doc_ids array<string>, key_id array<string>, note string, "
    "tags array<string>, must_contain array<string>"
)
BANK = "version string, note string, questions array<struct<id:string,type:string,q:string,trap:boolean,reference:string>>"

# Allowed words of the enumerated columns.
ENUMS = {
    "role": ["admin", "user"],
    "status": ["pending", "processing", "completed", "failed"],
    "doc_level": ["public", "private"],
}
