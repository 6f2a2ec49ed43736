"""Luau text to rows: a lexer, a parser and one extractor, all in plain Python."""
