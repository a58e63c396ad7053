"""Schemas and fixed values of the document tables."""

from __future__ import annotations

BLOB = "doc_id string, filename string, content_type string, content binary"
DETECTED = "filename string, kind string, extension string, content_type string, source string, error string"
RUN = "struct<idx:int,text:string,rpr:string>"
INLINE = "struct<kind:string,text:string,rpr:string,element:string>"
PARAGRAPH = (
    "doc_id string, story_rank int, i1 int, i2 int, i3 int, local_idx int, paragraph_index int, segment_no int, container_id string, part string,"
    f" visible_text string, runs array<{RUN}>, inline array<{INLINE}>, error string"
)
SEGMENT = "doc_id string, id string, text string, part string, index int, container_id string, paragraph_index int, run_indices array<int>"
EDIT = "doc_id string, seq int, container_id string, id string, text string, start_offset int, end_offset int"
PDF_CHAR = "doc_id string, page int, block int, line int, ord int, c string, x0 double, y0 double, x1 double, y1 double"
OUTPUT = "doc_id string, filename string, content_type string, data binary, error string"

# Media types by extension, and the messages of the error rows.
DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PDF_MIME = "application/pdf"
TXT_MIME = "text/plain; charset=utf-8"
MD_MIME = "text/markdown; charset=utf-8"
TEXT_MIME_BY_EXTENSION = {
    ".txt": TXT_MIME,
    ".md": MD_MIME,
    ".markdown": MD_MIME,
    ".csv": "text/csv; charset=utf-8",
    ".json": "application/json; charset=utf-8",
    ".xml": "application/xml; charset=utf-8",
    ".html": "text/html; charset=utf-8",
    ".htm": "text/html; charset=utf-8",
    ".log": TXT_MIME,
    ".rtf": "application/rtf; charset=utf-8",
}
ERROR_EMPTY = "Pusty plik."
ERROR_TYPE = "Nieobsługiwany typ dokumentu."
ERROR_DOCX = "Nie udało się odczytać DOCX."
ERROR_PDF = "Nie udało się odczytać PDF."
ERROR_PDF_OCR = "PDF nie ma warstwy tekstowej. Ten plik wymaga OCR."
ERROR_PDF_SAVE = "Nie udało się zapisać PDF."
ERROR_PDF_PAGES = "Nie udało się zapisać PDF: zmieniła się liczba stron."
OUTPUT_INFIX = "anonimizowany"
SNIFF_BYTES = 4096
