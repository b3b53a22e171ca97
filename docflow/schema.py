"""Schemas of the tables that docflow reads and writes; none is inferred."""

from __future__ import annotations

PROVENANCE = "array<struct<page_no:int,page:int,bbox:struct<l:double,t:double,r:double,b:double>>>"
ELEMENT = f"struct<self_ref:string,text:string,level:int,page:int,page_no:int,prov:{PROVENANCE}>"
TABLE = (
    f"struct<self_ref:string,label:string,bbox:map<string,double>,prov:{PROVENANCE},data:struct<grid:array<array<struct<text:string>>>,"
    "table_cells:array<struct<text:string,start_row_offset_idx:int,start_col_offset_idx:int>>>>"
)
#: A layout file beside a document.
LAYOUT = f"struct<texts:array<{ELEMENT}>,tables:array<{TABLE}>,figures:array<{ELEMENT}>,body:struct<children:array<struct<`$ref`:string>>>>"
CHUNK = (
    "chunk_id string, doc_id string, chunk_type string, content string, word_count int, section_path array<string>, page int, "
    "regions array<string>, metrics array<string>, time_periods array<string>, dates array<string>, orgs array<string>, "
    "time_context struct<start:string,end:string,granularity:string>, product_version string, folder_path array<string>, "
    "structural_metadata struct<element_type:string,element_level:int,page_number:int,is_heading:boolean,matching_method:string,matching_confidence:double>, "
    "embedding array<float>"
)
TOC_ENTRY = "struct<level:int,title:string,page:int,section_id:string,line_number:int,confidence:double>"
CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
HISTORY = "timestamp string, query string, answer string, tokens_used int, context_length int"
PROCESSED = f"total_chunks int, chunks array<struct<{', '.join(x.replace(' ', ':', 1) for x in CHUNK.replace('struct<', 'struct<').split(', '))}>>"
