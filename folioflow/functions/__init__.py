"""Column functions. `register(spark)` makes them known to SQL where they have a name there."""

from folioflow.functions.color import cmyk_to_rgb, exponential, matrix_apply, matrix_concat, sampled, stitching
from folioflow.functions.text import (
    block_standard_role,
    decode_utf16be,
    font_style,
    inline_role,
    is_garbled,
    is_page_number,
    list_marker,
    normalize_for_repeat,
    normalize_whitespace,
    pdfdoc_decode,
    text_similarity,
)

__all__ = [
    "block_standard_role",
    "cmyk_to_rgb",
    "decode_utf16be",
    "exponential",
    "font_style",
    "inline_role",
    "is_garbled",
    "is_page_number",
    "list_marker",
    "matrix_apply",
    "matrix_concat",
    "normalize_for_repeat",
    "normalize_whitespace",
    "pdfdoc_decode",
    "sampled",
    "stitching",
    "text_similarity",
]
