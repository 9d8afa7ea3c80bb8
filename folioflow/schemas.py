"""Row types of documents, elements, fragments and chunks."""

from __future__ import annotations

BOX = "struct<x:double,y:double,width:double,height:double>"
ITEM = "struct<text:string,level:int,bullet:string>"
CELL = "struct<text:string,row_span:int,col_span:int,is_header:boolean>"
DOCS = (
    "doc_id long, format string, title string, author string, subject string, keywords array<string>, creator string, producer string, "
    "custom map<string,string>, page_count int, warnings array<struct<code:string,message:string>>"
)
ELEMENT = (
    f"struct<page:int,pos:int,type:string,text:string,level:int,ordered:boolean,items:array<{ITEM}>,rows:array<array<{CELL}>>,alt_text:string>"
)
ELEMENTS = (
    f"doc_id long, page int, pos int, type string, text string, level int, ordered boolean, items array<{ITEM}>, rows array<array<{CELL}>>, alt_text string"
)
FRAGMENTS = (
    "doc_id long, page int, seq int, text string, x double, y double, width double, height double, font_name string, font_size double"
)
CHUNKS = (
    "doc_id long, id string, text string, text_with_context string, document_title string, section_path array<string>, section_title string, "
    "heading_level int, page_start int, page_end int, chunk_index int, total_chunks int, level string, element_types array<string>, has_table boolean, "
    "has_list boolean, has_image boolean, char_count int, word_count int, estimated_tokens int"
)
FIELDS = ("page", "pos", "type", "text", "level", "ordered", "items", "rows", "alt_text")
