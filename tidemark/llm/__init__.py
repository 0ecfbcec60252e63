"""Operators for training-data pipelines: linking, language, fusion, transcripts, tokens, mixing, safety."""
