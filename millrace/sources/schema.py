"""Schemas and error codes."""

from __future__ import annotations

FILES = "path string, modificationTime timestamp, length bigint, content binary"
DETECTED = "struct<category:string,format:string,confidence:double,label:string,reason:string>"
METADATA = "struct<engine:string,fallbacks_used:array<string>,duration_ms:bigint,size_bytes:bigint,ocr:struct<mean_confidence:double>>"
RESULT = f"id string, file_name string, detected {DETECTED}, markdown string, metadata {METADATA}, warnings array<string>, created_at timestamp, status string, error struct<code:string,message:string>"

CATEGORIES = ("document", "image", "audio", "video", "text", "unsupported", "unknown")
ERROR_CODES = ("too-large", "encrypted", "empty", "timeout", "worker-error", "internal", "unhandled", "unexpected", "MODEL_DOWNLOAD")
MAX_FILE_SIZE = 512 << 20
