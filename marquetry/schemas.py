"""Fixed schemas of the entities the engine works on (column names and types are part of the data contract)."""

from __future__ import annotations

from pyspark.sql import types as T

# The persistent relations, one DDL line each.
TABLES = {
    "users": "id string, username string, email string, password_hash string, full_name string, role string, created_at timestamp, last_login timestamp",
    "analyses": "id string, user_id string, language string, code string, clone_percentage double, cyclomatic_complexity double, maintainability_index double, execution_time_ms int, created_at timestamp, clones_json string, suggestions_json string",
    "sections": "id string, name string, instructor_id string, created_at timestamp",
    "students": "id string, name string, email string, section_id string, submissions int, created_at timestamp",
    "uploaded_files": "id string, user_id string, name string, size int, file_type string, content string, created_at timestamp",
    "history_entries": "id string, user_id string, entry_type string, description string, status string, created_at timestamp",
}

# Transient relations that arrive as JSON text.
JSON_RELATIONS = {
    "student_results": "array<struct<fileName:string,studentName:string,studentEmail:string,clonePercentage:double,complexity:double,maintainability:double,date:string,section:string>>",
    "saved_sections": "array<struct<id:string,name:string,instructor:string,students:array<struct<name:string,email:string,submissions:int>>>>",
    "activity": "array<struct<id:string,type:string,icon:string,description:string,time:string,status:string>>",
    "clones": "array<struct<clone_type:int,similarity:double,locations:array<struct<start_line:int,end_line:int>>>>",
    "messages": "array<struct<`from`:string,text:string,ts:bigint>>",
}


def schema(name: str) -> T.StructType:
    """StructType of a persistent relation; KeyError for unknown names."""
    return T.StructType.fromDDL(TABLES[name])
