"""Fixed schemas of the files."""

from __future__ import annotations

PASSAGE_TSV = "id string, text string, title string"
METADATA = "id string, title string, text string"
CONTEXT = "struct<passage_id:string,id:string,title:string,text:string,score:double>"
QA = "example_id string, question string, short_answers array<string>, context string"
BI_ENCODER = f"question string, answers array<string>, positive_ctxs array<{CONTEXT}>, negative_ctxs array<{CONTEXT}>, hard_negative_ctxs array<{CONTEXT}>"
SPARSE_DOC = "struct<id:string,title:string,text:string,sparse_score:double>"
SPARSE_RESULT = f"original_question string, original_answers array<string>, example_id string, sparse_retrieved_docs array<{SPARSE_DOC}>"
