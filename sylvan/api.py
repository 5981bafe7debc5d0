"""Compile grammars and convert single texts on the driver; for tables, see
:mod:`sylvan.operators.parse`."""

from __future__ import annotations

from typing import TextIO

from .errors import GrammarError, ParsingFailed, ValidationError
from .functions.writers import format_name, write_tree_to
from .operators.kernel import Outcome
from .plans.grammar import Grammar, parse_to_json
from .sources.files import compile_file, read_file, require_utf8
from .sources.sinks import serialize_execution, serialize_tree, write_file

__all__ = [
    "Converter", "GrammarError", "ParsingFailed", "ValidationError", "compile", "compile_file", "compile_grammar", "compile_string", "execute",
    "execute_and_serialize", "execute_tree", "generate", "generate_string", "generate_string_to_file", "generate_to_file", "parse_and_run",
    "parse_to_json", "run_grammar", "run_grammar_xml", "run_grammar_yaml", "serialize_execution", "serialize_tree", "serialize_tree_to_writer",
]


class Converter:
    """A compiled grammar with the methods for single texts."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar

    def execute(self, text: str, grammar: str = "input") -> Outcome:
        """Run over a text with everything recorded."""
        return self.grammar.machine().run(text, grammar, record=True)

    def _run(self, text: str, fmt: str, grammar: str) -> str:
        return serialize_execution(self.execute(text, grammar), fmt)

    def run(self, text: str, grammar: str = "input") -> str:
        return self._run(text, "json", grammar)

    def run_xml(self, text: str, grammar: str = "input") -> str:
        return self._run(text, "xml", grammar)

    def run_yaml(self, text: str, grammar: str = "input") -> str:
        return self._run(text, "yaml", grammar)

    def generate_string(self, input: str, format: str = "json", grammar: str = "input") -> str:
        fmt = format_name(format)
        return serialize_tree(self.grammar.machine().run(input, grammar), fmt)

    def generate(self, input_file: str, format: str = "json", grammar: str = "input", encoding: str = "utf-8") -> str:
        require_utf8(encoding)
        return self.generate_string(read_file(input_file), format, grammar)

    def generate_to_file(self, input_file: str, output_file: str, format: str = "json", grammar: str = "input") -> None:
        write_file(self.generate(input_file, format, grammar), output_file)

    def generate_string_to_file(self, input: str, output_file: str, format: str = "json", grammar: str = "input") -> None:
        write_file(self.generate_string(input, format, grammar), output_file)


def compile_string(syntax: str, *, preserve_case: bool = False, search_window: int | None = None) -> Converter:
    return Converter(Grammar.compile(syntax, preserve_case=preserve_case, search_window=search_window))


compile_grammar = compile_string


def compile(syntax_file: str, encoding: str = "utf-8", *, preserve_case: bool = False, search_window: int | None = None) -> Converter:
    return Converter(compile_file(syntax_file, encoding, preserve_case=preserve_case, search_window=search_window))


def generate(converter: Converter, input_file: str, format: str = "xml", encoding: str = "utf-8") -> str:
    return converter.generate(input_file, format=format, encoding=encoding)


def generate_to_file(converter: Converter, input_file: str, output_file: str, format: str = "xml", in_encoding: str = "utf-8", out_encoding: str = "utf-8") -> None:
    require_utf8(in_encoding)
    require_utf8(out_encoding)
    converter.generate_to_file(input_file, output_file, format=format)


def generate_string(converter: Converter, input: str, format: str = "xml") -> str:
    return converter.generate_string(input, format=format)


def generate_string_to_file(converter: Converter, input: str, output_file: str, format: str = "xml", out_encoding: str = "utf-8") -> None:
    require_utf8(out_encoding)
    converter.generate_string_to_file(input, output_file, format=format)


def execute(syntax: str, grammar: str, text: str) -> Outcome:
    return compile_string(syntax).execute(text, grammar)


def execute_tree(syntax: str, grammar: str, text: str) -> Outcome:
    """A run of which only the tree and the error are recorded."""
    return compile_string(syntax).grammar.machine().run(text, grammar)


def execute_and_serialize(syntax: str, grammar: str, text: str, format: str = "json") -> str:
    return serialize_tree(execute_tree(syntax, grammar, text), format)


def serialize_tree_to_writer(run: Outcome, format: str, writer: TextIO) -> None:
    """Write a tree to an open stream as it is serialized, never holding all
    of its output; a run that failed is an error, and nothing is written."""
    if run.error is not None:
        raise ParsingFailed(run.error)
    write_tree_to(run.tree.root, format_name(format), writer)


def parse_and_run(syntax: str, grammar: str, text: str) -> str:
    """Compile, run, and give the whole log as JSON, the grammar's warnings among its diagnostics."""
    converter = compile_string(syntax)
    run = converter.execute(text, grammar)
    run.diagnostics += [(d.severity, d.message) for d in converter.grammar.diagnostics]
    return serialize_execution(run, "json")


def run_grammar(syntax: str, text: str, grammar: str = "input") -> str:
    return compile_string(syntax).run(text, grammar)


def run_grammar_xml(syntax: str, text: str, grammar: str = "input") -> str:
    return compile_string(syntax).run_xml(text, grammar)


def run_grammar_yaml(syntax: str, text: str, grammar: str = "input") -> str:
    return compile_string(syntax).run_yaml(text, grammar)
