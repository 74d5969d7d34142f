"""Schemas of the engine's tables, as DDL."""

ELEMENT_TYPES = ("paragraph", "title", "list", "table", "image", "formula", "row", "slide", "metadata")

ELEMENTS = (
    "id string, category string, doc_path string, doc_id string, source_type string, page int, elem_order int, bbox array<double>, element_type string, "
    "text string, html string, media_path string, headings_path array<string>, parents array<string>, metadata map<string,string>"
)
CHUNKS = (
    "id string, category string, doc_id string, doc_path string, doc_key string, text string, token_len int, char_len int, chunk_index int, from_order int, to_order int, "
    "page_from int, page_to int, heading_path array<string>, element_types array<string>, media_refs array<string>"
)
NODES = "id string, type string, name string, path string, level int, importance double, category string, element_count bigint, heading string, page int, elem_order int, text_length int, has_media boolean"
EDGES = "src string, dst string, rel string, weight double"
