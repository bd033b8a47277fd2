"""Statements from a file or from the keyboard: python -m tidemill.shell FOLDER [FILE]."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from tidemill.dialect import tokenize
from tidemill.engine import DataFolder, open_url
from tidemill.errors import EngineError
from tidemill.types import Kind, TimeSeriesTable

HELP = r"""\d TABLE  columns of a table, with error bounds and expressions
\dt       tables
\h        this text
\q        leave
Anything else is a statement, to the end of the line."""


def split(text: str) -> list[str]:
    """The statements of a text, which semicolons end; those in strings and comments don't count."""
    found, start = [], 0
    for token in tokenize(text):
        if token.text == ";" and token.kind == "sign":
            found.append(text[start : token.start])
            start = token.end
    return [s.strip() for s in [*found, text[start:]] if tokenize(s)]


def describe(folder: DataFolder, name: str) -> list[str]:
    table = folder.table(name)
    lines = []
    bounds = {c.name: c for c in table.columns} if isinstance(table, TimeSeriesTable) else {}
    for field in table.query_schema.fields:
        extra = ""
        if field.name in bounds and bounds[field.name].kind is Kind.FIELD:
            column = bounds[field.name]
            extra = f", generated as {column.expression}" if column.expression else f", error bound {column.bound}"
        lines.append(f"{field.name}: {field.dataType.simpleString()}{extra}")
    return lines


def run(folder: DataFolder, line: str) -> list[str]:
    """The answer to a command or statement, line by line."""
    words = line.split()
    if words[:1] == ["\\dt"]:
        return folder.tables()
    if words[:1] == ["\\d"] and len(words) == 2:
        return describe(folder, words[1])
    if words[:1] == ["\\h"] or line.startswith("\\"):
        return HELP.splitlines()
    result = folder.sql(line)
    if not result.columns or result.columns == ["done"]:
        return []
    # What is shown is limited, what is computed isn't.
    shown = result.limit(1001).collect()
    lines = ["\t".join(result.columns), *("\t".join(str(x) for x in r) for r in shown[:1000])]
    return lines + (["... more rows"] if len(shown) > 1000 else [])


def serve(folder: DataFolder, lines: Iterable[str], stop: bool = False) -> None:
    for line in lines:
        line = line.strip()
        if line == "\\q":
            break
        if not line:
            continue
        try:
            print("\n".join(run(folder, line)))
        except EngineError as error:
            print(error)
            if stop:
                raise


def main(args: list[str]) -> None:
    if not args:
        raise SystemExit(__doc__)
    folder = open_url(SparkSession.builder.getOrCreate(), args[0])
    if len(args) > 1:
        with open(args[1]) as file:
            serve(folder, split(file.read()), stop=True)
    else:
        serve(folder, sys.stdin)


if __name__ == "__main__":
    main(sys.argv[1:])
