"""Lexers and grammars by file extension."""
