"""Widths of the standard fonts."""

import pytest

from folioflow.pdf import metrics
from folioflow.pdf.fonts import STANDARD_14


def test_widths():
    assert all(len(t) == 95 for t in metrics.TABLES.values()) and len(STANDARD_14) == 14
    assert metrics.measure("Courier", "any", 10) == 18 and metrics.glyph_width("Helvetica", "A") == 667 and metrics.glyph_width("Times-Bold", "W") == 1000
    assert metrics.glyph_width("Helvetica", "É") == metrics.glyph_width("Helvetica", "E") and metrics.glyph_width("Nope", "A") == 0
    assert metrics.measure("Helvetica", "Hello", 12) == pytest.approx((722 + 556 + 222 + 222 + 556) * 12 / 1000)
    assert metrics.font_dictionary("Courier")["BaseFont"] == "Courier"
