"""Schemas of the JSON records; open objects stay JSON text, so a new key never changes a schema."""

MESSAGE = "struct<role:string,content:string>"
TOOL = "struct<name:string,description:string,inputSchema:string,annotations:struct<category:string>>"
TRAJECTORY = (
    "registry string, level int, query_type string, query string, correct_tool string, predicted_tool string, "
    f"messages array<{MESSAGE}>, final_answer string, turns int, source string, registry_size int, tools array<string>, "
    "augmentation string, reject_stage int, reject_reason string"
)
QUERY = "query string, category string, difficulty string, expected_tool string"
TRUTH = "query string, expected_tool string, expected_params string"
