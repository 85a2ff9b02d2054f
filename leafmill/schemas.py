"""Explicit schemas of every table."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
BOX = _struct(x0=D, y0=D, x1=D, y1=D)
SPAN = _struct(text=S, size=D, font=S, bold=B, italic=B, bbox=BOX)
RAW_LINE = _struct(page=I, page_width=D, page_height=D, line_ord=I, column=I, block_index=I, bbox=BOX, spans=T.ArrayType(SPAN))
PARAGRAPH = _struct(book_id=S, ordinal=I, text=S, size=D, bold=B, x0=D, column=I, pages=T.ArrayType(I))
TOC = _struct(book_id=S, level=I, title=S, page=I)
BLOCK = _struct(id=S, kind=S, level=I, text=S, chapter_id=S, source_pages=T.ArrayType(I), footnote_refs=T.ArrayType(S), lang=S, translate=B, matter=S, meta=T.MapType(S, S))
CHAPTER = _struct(id=S, title=S, number=I, level=I, block_ids=T.ArrayType(S), start_page=I)
IMAGE = _struct(id=S, page=I, bbox=BOX, width=I, height=I, path=S, caption_block_id=S)
DOCUMENT = _struct(version=I, title=S, source_lang=S, target_lang=S, blocks=T.ArrayType(BLOCK), chapters=T.ArrayType(CHAPTER), images=T.ArrayType(IMAGE), metadata=T.MapType(S, S))
TERM = _struct(source=S, target=S, kind=S, note=S, locked=B, occurrences=L)
FINDING = _struct(segment_id=S, check=S, severity=S, detail=S)
SCORE = _struct(segment_id=S, completeness=I, accuracy=I, terminology=I, fluency=I, formatting=I, confidence=D)
ISSUE = _struct(segment_id=S, dimension=S, severity=S, source_excerpt=S, translation_excerpt=S, explanation=S, description=S, suggested_fix=S)
JUDGEMENT = _struct(scores=T.ArrayType(SCORE), issues=T.ArrayType(ISSUE), notes=S)
JOB = _struct(id=S, source_path=S, source_sha256=S, source_lang=S, target_lang=S, config_json=S, status=S, created_at=T.TimestampType(), updated_at=T.TimestampType())
SEGMENT = _struct(job_id=S, segment_id=S, chapter_id=S, ordinal=I, kind=S, source_text=S, final_text=S, final_score=D, status=S, needs_review=B)
ATTEMPT = _struct(id=L, job_id=S, segment_id=S, batch_id=L, attempt_no=I, model=S, params_json=S, output_text=S, latency_ms=I, created_at=T.TimestampType())
EVALUATION = _struct(id=L, attempt_id=L, evaluator_model=S, scores_json=S, issues_json=S, composite=D, passed=B, created_at=T.TimestampType())
USAGE = _struct(id=L, job_id=S, ts=T.TimestampType(), model=S, endpoint=S, prompt_tokens=L, completion_tokens=L, cost_usd=D)

# Closed sets.
BLOCK_KINDS = ("paragraph", "heading", "blockquote", "list_item", "verse", "dialogue", "scene_break", "page_break", "footnote", "figure_caption", "table", "caption")
TERM_KINDS = ("character", "place", "organization", "title", "invented", "honorific", "other")
PENDING = ("pending", "failed", "translating", "evaluating")
