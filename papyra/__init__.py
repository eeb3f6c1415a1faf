"""papyra: document-extraction and document-query analytics expressed as Spark DataFrames."""
