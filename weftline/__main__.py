"""``python -m weftline explain --model package.module:NAME``: the plan of a model, without any data."""

from __future__ import annotations

import argparse
import importlib
import sys

from weftline.errors import WeftlineError
from weftline.plans.graph import explain


def main(args: list[str]) -> int:
    """0: done; 1: the model can't be read or resolved; 2: wrong usage."""
    parser = argparse.ArgumentParser(prog="weftline")
    commands = parser.add_subparsers(dest="command", required=True)
    plan = commands.add_parser("explain", help="insertion order, deferred references and skipped constructs")
    plan.add_argument("--model", required=True, help="package.module:NAME of a model source, or of a callable that makes one")
    try:
        given = parser.parse_args(args)
    except SystemExit as end:
        return int(end.code or 0)
    module, _, name = given.model.partition(":")
    try:
        source = getattr(importlib.import_module(module), name)
        source = source if hasattr(source, "entities") and not isinstance(source, type) else source()
        sys.stdout.write(explain(source, getattr(source, "skipped", ())).report())
    except (WeftlineError, ImportError, AttributeError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
