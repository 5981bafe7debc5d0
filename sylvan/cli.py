"""Convert files on the driver: ``python -m sylvan.cli -s SYNTAX [FILE...]``."""

from __future__ import annotations

import argparse
import os
import sys

from .api import compile as compile_converter
from .errors import ParsingFailed


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sylvan", description="Convert text to JSON, XML or YAML by a grammar.")
    p.add_argument("-s", "--syntax", required=True, help="the grammar")
    p.add_argument("-f", "--format", default="xml", choices=("xml", "json", "yaml", "yml"))
    p.add_argument("-g", "--grammar", default="input", help="the grammar to begin with")
    p.add_argument("--preserve-case", action="store_true", help="keep the case of names in paths")
    p.add_argument("--search-window", type=int, metavar="N", help="bytes that one pattern can span")
    p.add_argument("files", nargs="*", metavar="FILE", help="inputs, in order; standard input if there are none")
    return p


def main(argv: list[str] | None = None) -> int:
    """0; or 1 at the first input that fails, whose predecessors' output stays."""
    args = _parser().parse_args(argv)
    try:
        converter = compile_converter(args.syntax, preserve_case=args.preserve_case, search_window=args.search_window)
        for name in args.files or [None]:
            if name is None:
                out = converter.generate_string(sys.stdin.buffer.read().decode("utf-8"), args.format, args.grammar)
            else:
                out = converter.generate(name, args.format, args.grammar)
            sys.stdout.write(out)
        sys.stdout.flush()
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    except (ParsingFailed, RuntimeError, ValueError, OSError) as e:
        sys.stdout.flush()
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
