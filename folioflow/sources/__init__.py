"""Reading and writing document files as tables."""
