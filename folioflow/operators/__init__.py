"""Operators over tables of runs, lines, blocks, structure elements, checks and OCR words."""
