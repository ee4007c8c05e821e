"""Analysis of source files by language: comments and strings, definitions, scopes, imports.

``analysis.analyse`` is what Arrow batches call; ``registry.register`` adds a language.
"""
