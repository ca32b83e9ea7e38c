"""The registered tools: every data operator a user can name, as functions from frames to a frame."""

from __future__ import annotations

from ..operators import diff, extraction, geometry, html_blocks, layout, review, segments
from .registry import Registry, Tool


def default_registry() -> Registry:
    def tool(name: str, executor, *surfaces: str, accepts: tuple[str, ...] = ("text",)) -> Tool:
        return Tool(name, "1.0.0", surfaces or ("launcher",), (), accepts, ("table",), executor)

    return Registry(
        [
            tool("text-extract", extraction.extract_information),
            tool("text-entities", extraction.extract_entities),
            tool("text-key-values", extraction.extract_key_values),
            tool("text-tables", extraction.extract_tables),
            tool("text-outline", extraction.extract_sections),
            tool("text-compare", diff.diff_stats),
            tool("text-review", review.review),
            tool("text-translate-segments", segments.translation_segments),
            tool("pages-summarize-chunks", segments.chunk_pages),
            tool("html-blocks", html_blocks.page_blocks, accepts=("text/html",)),
            tool("pages-to-tables", layout.page_tables),
            tool("pages-to-markdown", layout.pages_to_markdown),
            tool("pages-to-paragraphs", layout.page_paragraphs),
            tool("pages-labels", geometry.page_labels),
        ]
    )
