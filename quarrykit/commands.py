"""A small command language, its prompt, and the server.

    python -m quarrykit.commands --dataset PATH [--create] --repl
    python -m quarrykit.commands --dataset PATH [--create] --execute COMMAND ...
    python -m quarrykit.commands --dataset PATH [--host HOST] [--port PORT]
"""

from __future__ import annotations

import argparse
import logging
import re
import sys
from collections.abc import Iterator

from .dataset import Dataset, DatasetBuilder, create, open
from .metrics import set_log_level
from .plans.sqltext import SqlError, significant, tokenize

HELP = """ATTACH 'path' [TO JOIN 'name']      add a source, or add it to a join
[INNER|LEFT|RIGHT|FULL [OUTER]] JOIN 'path' AS name ON condition
FILTER WHERE condition
SELECT ...                           run a query
REMOVE COLUMN name | RENAME COLUMN old TO new
INDEX column | DROP INDEX column | REINDEX
CREATE VIEW name AS SELECT ... | RENAME VIEW old TO new | DROP VIEW name
SET NAME 'name' | SET DESCRIPTION 'text'
COMMIT 'message' | RESET | UNDO
SHOW [LIMIT n] | COUNT | SCHEMA | EXPLAIN | HISTORY | STATUS | CLEAR | HELP | EXIT"""
LEVELS = {"ui": "INFO", "trace": "DEBUG", "debug": "DEBUG", "info": "INFO", "warn": "WARNING", "error": "ERROR"}
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
STRING = r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")"""


def _text(literal: str) -> str:
    body = re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), literal[1:-1], flags=re.S)
    return body.replace("''", "'") if literal[0] == "'" else body


def _name(word: str) -> str:
    return _text(word) if word[0] in "'\"" else word


def _one(statement: str) -> str:
    statement = re.sub(r"--[^\n]*(?:\n|\Z)", " ", statement).strip()
    tokens = significant(tokenize(statement))
    ends = [i for i, t in enumerate(tokens) if t.text == ";"]
    if ends and ends[0] < len(tokens) - 1:
        raise SqlError("one statement at a time")
    statement = statement.rstrip("; \n\t")
    if not statement:
        raise SqlError("empty command")
    return statement


NAME = rf"({STRING[1:-1]}|[\w.\-@]+)"
COMMANDS: list[tuple[str, object]] = [
    (rf"FILTER\s+WHERE\s+(.+)", lambda d, p, c: d.filter(c, p)),
    (rf"ATTACH\s+{STRING}\s+TO\s+JOIN\s+{NAME}", lambda d, p, path, name: d.attach_to_join(_name(name), _text(path))),
    (rf"ATTACH\s+{STRING}(?:\s+AS\s+\w+)?(?:\s+WITH\s*\(.*\))?", lambda d, p, path: d.attach(_text(path))),
    (
        rf"(?:(INNER|LEFT|RIGHT|FULL|OUTER)\s+)?(?:OUTER\s+)?JOIN\s+{STRING}\s+AS\s+{NAME}\s+ON\s+(.+)",
        lambda d, p, how, path, name, on: d.join(_name(name), _text(path), on, (how or "inner").lower()),
    ),
    (r"REINDEX(?:\s+ON\s+.+)?", lambda d, p: d.reindex()),
    (rf"(?:CREATE\s+)?INDEX\s+(?:ON\s+)?{NAME}", lambda d, p, c: d.index(_name(c))),
    (rf"DROP\s+INDEX\s+{NAME}", lambda d, p, c: d.drop_index(_name(c))),
    (rf"CREATE\s+VIEW\s+{NAME}\s+AS\s+(SELECT\s.+)", lambda d, p, name, sql: d.create_view(_name(name), d.select(sql, p))),
    (rf"RENAME\s+VIEW\s+{NAME}\s+TO\s+{NAME}", lambda d, p, a, b: d.rename_view(_name(a), _name(b))),
    (rf"DROP\s+VIEW\s+{NAME}", lambda d, p, a: d.drop_view(_name(a))),
    (rf"(?:REMOVE|DROP)\s+COLUMN\s+{NAME}", lambda d, p, c: d.remove_column(_name(c))),
    (rf"RENAME\s+COLUMN\s+{NAME}\s+TO\s+{NAME}", lambda d, p, a, b: d.rename_column(_name(a), _name(b))),
    (rf"SET\s+NAME\s+{STRING}", lambda d, p, x: d.set_name(_text(x))),
    (rf"SET\s+DESCRIPTION\s+{STRING}", lambda d, p, x: d.set_description(_text(x))),
    (rf"COMMIT\s+{STRING}", lambda d, p, x: d.commit(_text(x))),
    (r"RESET", lambda d, p: d.reset()),
    (r"UNDO", lambda d, p: d.undo()),
    (r"((?:SELECT|WITH)\s.+)", lambda d, p, sql: d.select(sql, p)),
]
_COMPILED = [(re.compile(pattern + r"\s*\Z", re.I | re.S), run) for pattern, run in COMMANDS]


def execute(dataset: DatasetBuilder, statement: str, params: list | None = None) -> DatasetBuilder:
    """Runs one command. Gives the dataset, or for a SELECT a new one with the query's rows."""
    statement = _one(statement)
    for pattern, run in _COMPILED:
        m = pattern.match(statement)
        if m:
            return run(dataset, params, *m.groups())
    raise SqlError(f"Unsupported statement: {statement.split(None, 1)[0]}")


def answer(dataset: DatasetBuilder, line: str) -> str:
    """What the prompt shows for a line."""
    words = line.strip().rstrip(";").split()
    first = words[0].upper() if words else ""
    if first == "HELP":
        return HELP
    if first == "CLEAR":
        return "\033[2J\033[H"
    if first == "SCHEMA":
        return str(dataset.schema)
    if first == "COUNT":
        return str(dataset.num_rows)
    if first == "EXPLAIN":
        return dataset.explain()
    if first == "HISTORY":
        return "\n".join(f"{c.timestamp} {c.author}: {c.message}" for c in dataset.history()) or "No commits"
    if first == "STATUS":
        return str(dataset.status())
    if first == "SHOW":
        n = int(words[2]) if len(words) > 2 and words[1].upper() == "LIMIT" else 10
        return dataset.dataframe._show_string(n)
    out = execute(dataset, line)
    return "OK" if out is dataset else out.dataframe._show_string(20)


def completions(dataset: Dataset, text: str) -> list[str]:
    """What may follow at the prompt: words of commands, names of columns and views, that begin so."""
    words = {w for line in HELP.splitlines() for w in re.findall(r"\b[A-Z]{2,}\b", line)}
    try:
        words |= {*dataset.dataframe.columns, *dataset.views().values()}
    except Exception:  # noqa: BLE001  rows that can't be read have no columns to offer
        pass
    return sorted(w for w in words if w.upper().startswith(text.upper()))


def prompt(dataset: Dataset) -> Iterator[str]:
    """Lines from the terminal, with completion where readline is there, or from what is piped in."""
    if not sys.stdin.isatty():
        yield from sys.stdin
        return
    try:
        import readline

        readline.set_completer(lambda text, i: [*completions(dataset, text), None][i])
        readline.parse_and_bind("tab: complete")
    except ImportError:
        pass
    while True:
        try:
            yield input("> ")
        except EOFError:
            return


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrykit", description="A prompt for a dataset with --repl or --execute, else its Arrow Flight server.")
    parser.add_argument("--dataset", required=True)
    parser.add_argument("--create", action="store_true", help="make a new dataset if there is none")
    parser.add_argument("--repl", action="store_true", help="read commands from the terminal")
    parser.add_argument("--execute", action="append", default=[], help="run this command; may be repeated")
    parser.add_argument("--host", default="127.0.0.1", help="the server has no authentication: name other addresses with care")
    parser.add_argument("--port", type=int, default=50051)
    parser.add_argument("--log-level", choices=sorted(LEVELS), default="ui")
    got = parser.parse_args(arguments)
    logging.basicConfig(format="%(message)s" if got.log_level == "ui" else "%(asctime)s %(levelname)s %(name)s: %(message)s")
    set_log_level(LEVELS[got.log_level])
    try:
        dataset = open(got.dataset).extend()
    except FileNotFoundError:
        if not got.create:
            raise
        dataset = create(got.dataset)
    if not (got.repl or got.execute):
        from . import flight

        print(f"Serving {got.dataset} at grpc://{got.host}:{got.port}")
        flight.serve(dataset, got.host, got.port).serve()
        return 0
    for line in got.execute or prompt(dataset):
        if line.strip().upper().rstrip(";") in ("EXIT", "QUIT"):
            break
        if not line.strip():
            continue
        try:
            print(answer(dataset, line))
        except Exception as e:  # noqa: BLE001  the prompt goes on
            print(f"Error: {e}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
