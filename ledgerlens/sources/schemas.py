"""Schemas of the tables and files; nothing is inferred."""

from __future__ import annotations

DOCUMENTS = "doc_id long, doc_name string, company string, cik string, doc_type string, fiscal_year int, period_end date, filing_date date, source_path string, pdf_pages int, ingested_at timestamp"
CHUNKS = "chunk_id long, doc_id long, kind string, item_section string, heading_trail array<string>, page_start int, page_end int, table_ordinal int, text string, embedding array<float>"
FACTS = "fact_id long, doc_id long, chunk_id long, table_ordinal int, row_label string, column_label string, period_end date, value_raw string, value decimal(38,6), parenthesized boolean, signed decimal(38,6), scale string, unit string, page int, fact_text string, embedding array<float>"
QUESTIONS = "financebench_id string, question string, answer string, company string, doc_name string, evidence array<struct<doc_name string, evidence_text string, evidence_text_full_page string, evidence_page_num int>>"
CONVERTED = "pages map<string, struct<size struct<height double>>>, tables array<struct<prov array<struct<page_no int, bbox struct<t double, b double, coord_origin string>>>, data struct<num_rows int, num_cols int, table_cells array<struct<text string, column_header boolean, start_row_offset_idx int, start_col_offset_idx int>>>>>, texts array<struct<text string, label string, prov array<struct<page_no int>>>>"
