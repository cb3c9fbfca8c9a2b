"""The byte layer: objects, files, filters, encryption, fonts, content streams and the writer. No Spark in here."""
