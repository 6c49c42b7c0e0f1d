"""Which source column a column comes from, by replaying the log."""

from __future__ import annotations

from typing import TYPE_CHECKING

from .sqltext import Token, complete, significant, split_arguments, tokenize

if TYPE_CHECKING:
    from .pruning import Bound
    from .state import State


ENDS = {"GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "WINDOW", "QUALIFY", "UNION", "INTERSECT", "EXCEPT", "WHERE"}


def _plain_name(t: Token) -> str | None:
    return t.text[1:-1] if t.kind == "name" else t.text if t.kind == "word" else None


def _plain_select(sql: str) -> tuple[dict[str, str] | None, str | None]:
    """Of a query over ``bundle`` alone: output names to columns (None: all, unchanged), and its WHERE. Of
    any other query: no columns, no WHERE."""
    tokens = significant(tokenize(complete(sql)))
    words = [t.upper for t in tokens]
    if words[0] != "SELECT" or words.count("SELECT") != 1 or words.count("FROM") != 1 or "JOIN" in words or "DISTINCT" in words:
        return {}, None
    source = words.index("FROM")
    rest = source + 2
    if tokens[source + 1].text != "bundle" or (rest < len(tokens) and words[rest] not in ENDS):
        return {}, None
    where = None
    if rest < len(tokens) and words[rest] == "WHERE":
        end = next((i for i in range(rest + 1, len(tokens)) if words[i] in ENDS), len(tokens))
        where = " ".join(t.text for t in tokens[rest + 1 : end])
    listed = tokens[1:source]
    if [t.text for t in listed] == ["*"]:
        return None, where
    names: dict[str, str] = {}
    for item in split_arguments(listed):
        if len(item) == 1 and _plain_name(item[0]):
            names[_plain_name(item[0])] = _plain_name(item[0])
        elif len(item) in (2, 3) and _plain_name(item[0]) and _plain_name(item[-1]) and (len(item) == 2 or item[1].upper == "AS"):
            names[_plain_name(item[-1])] = _plain_name(item[0])
    return names, where


def source_column(state: State, column: str) -> str | None:
    """The base pack's column behind a column of the data; None for a computed one."""
    base = state.packs[state.base][0].struct() if state.base and state.packs[state.base] else None
    if base is None:
        return None
    now = {c: c for c in base.names}
    for op in state.operations:
        if op.type == "renameColumn" and op.old_name in now:
            now[op.new_name] = now.pop(op.old_name)
        elif op.type == "removeColumns":
            now = {k: v for k, v in now.items() if k not in op.names}
        elif op.type == "select":
            names, _ = _plain_select(op.sql)
            if names is not None:
                now = {out: now[c] for out, c in names.items() if c in now}
    return now.get(column)


def base_bounds(state: State) -> list[Bound]:
    """Bounds on source columns that every row of the result keeps: from filters before any select, and from
    the first select's WHERE."""
    from .pruning import bounds_of

    base = state.packs[state.base][0].struct()
    now = {c: c for c in base.names} if base else {}
    out = []
    for op in state.operations:
        if op.type == "renameColumn" and op.old_name in now:
            now[op.new_name] = now.pop(op.old_name)
        elif op.type == "removeColumns":
            now = {k: v for k, v in now.items() if k not in op.names}
        elif op.type == "filter":
            out += [b._replace(column=now[b.column]) for b in bounds_of(op.where_clause, list(op.parameters)) if b.column in now]
        elif op.type == "select":
            _, where = _plain_select(op.sql)
            if where:
                out += [b._replace(column=now[b.column]) for b in bounds_of(where, list(op.parameters)) if b.column in now]
            break
    return out
