"""Grammar-driven parsing of text into trees, on Spark."""

from .api import Converter, compile, compile_string, generate, generate_string, generate_string_to_file, generate_to_file
from .errors import Diagnostic, GrammarError, LexError, ParseError, ParsingFailed, Span, ValidationError
from .plans.grammar import Grammar

__version__ = "0.1.0"

__all__ = [
    "Converter", "Diagnostic", "Grammar", "GrammarError", "LexError", "ParseError", "ParsingFailed", "Span", "ValidationError",
    "compile", "compile_string", "generate", "generate_string", "generate_string_to_file", "generate_to_file",
]
