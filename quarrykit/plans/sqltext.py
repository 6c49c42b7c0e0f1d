"""SQL text: tokens, parameters, and the spellings that Spark's parser doesn't know.

Everything works on tokens, so strings, quoted names and comments are never touched by mistake.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions.dialect import CALLS, RENAMED

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<param>\$\d+)
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<word>[^\W\d][\w$]*)
    |(?P<op>::|<=>|<=|>=|<>|!=|!~\*|!~|~\*|->|=>|\|\||.)""",
    re.X | re.S,
)
STARTS = {"SELECT", "WITH", "VALUES", "TABLE", "FROM", "("}
CLAUSES = {"WHERE", "GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "FETCH"}


class SqlError(ValueError):
    """Text that can't be run, and why."""


class Token(NamedTuple):
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m[0]) for m in TOKEN.finditer(sql)]


def significant(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind != "space"]


def render(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def _next(tokens: list[Token], i: int) -> int:
    """The index of the first token from i on that isn't space."""
    while i < len(tokens) and tokens[i].kind == "space":
        i += 1
    return i


def _close(tokens: list[Token], i: int) -> int:
    """The index of the bracket that closes the one at i."""
    pairs, depth = {"(": ")", "[": "]"}, 0
    opening, closing = tokens[i].text, pairs[tokens[i].text]
    for j in range(i, len(tokens)):
        depth += (tokens[j].text == opening and tokens[j].kind == "op") - (tokens[j].text == closing and tokens[j].kind == "op")
        if not depth:
            return j
    raise SqlError(f"unclosed {opening}")


def split_arguments(tokens: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text in "([" and t.kind == "op") - (t.text in ")]" and t.kind == "op")
        if t.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [] if out == [[]] or not significant(tokens) else out


def bind(sql: str, parameters: list) -> tuple[str, dict]:
    """$n becomes a named argument; the values stay values."""
    used: dict = {}
    out = []
    for t in tokenize(sql):
        if t.kind == "param":
            n = int(t.text[1:])
            if not 1 <= n <= len(parameters):
                raise SqlError(f"parameter {t.text} has no value: {len(parameters)} given")
            used[f"p{n}"] = parameters[n - 1]
            t = Token("op", f":p{n}")
        out.append(t)
    return render(out), used


def check_parameters(parameters: list | None) -> list:
    out = list(parameters or [])
    for p in out:
        if not (p is None or isinstance(p, (bool, int, float, str))):
            raise TypeError(f"parameters are bool, int, float, str or None, not {type(p).__name__}")
    return out


def _depths(tokens: list[Token]) -> list[int]:
    out, depth = [], 0
    for t in tokens:
        if t.kind == "op" and t.text == ")":
            depth -= 1
        out.append(depth)
        if t.kind == "op" and t.text == "(":
            depth += 1
    return out


def complete(sql: str, table: str = "bundle") -> str:
    """SELECT may be left out, and so may FROM: the table is then the data itself."""
    tokens = tokenize(sql.strip().rstrip(";"))
    i = _next(tokens, 0)
    if i == len(tokens):
        raise SqlError("empty SQL")
    if tokens[i].upper not in STARTS:
        tokens = [Token("word", "SELECT"), Token("space", " "), *tokens]
    i = _next(tokens, 0)
    if tokens[i].upper != "SELECT":
        return render(tokens)
    depth = _depths(tokens)
    if any(t.upper == "FROM" and d == 0 for t, d in zip(tokens, depth, strict=True)):
        return render(tokens)
    end = next((j for j in range(i + 1, len(tokens)) if depth[j] == 0 and tokens[j].upper in CLAUSES), len(tokens))
    listed = significant(tokens[i + 1 : end])
    names = any(
        t.kind == "name" or t.text == "*" or (t.kind == "word" and t.upper not in ("NULL", "TRUE", "FALSE", "AS", "INTERVAL", "DATE", "TIMESTAMP") and (k + 1 == len(listed) or listed[k + 1].text != "(") and (k == 0 or listed[k - 1].upper != "AS"))
        for k, t in enumerate(listed)
    )
    if not names and end == len(tokens):
        return render(tokens)
    return f"{render(tokens[:end]).rstrip()} FROM {table} {render(tokens[end:])}".rstrip()


def _order_items(tokens: list[Token]) -> list[Token]:
    """Gives every ORDER BY item its place for nulls: last when ascending, first when descending."""
    out, i, depth = [], 0, _depths(tokens)
    while i < len(tokens):
        t = tokens[i]
        by = _next(tokens, i + 1)
        if not (t.upper == "ORDER" and by < len(tokens) and tokens[by].upper == "BY"):
            out.append(t)
            i += 1
            continue
        before = significant(out)
        within = len(before) > 2 and [x.upper for x in before[-3:-1]] == ["WITHIN", "GROUP"]
        out += tokens[i : by + 1]
        level, i = depth[i], by + 1
        end = i
        while end < len(tokens) and depth[end] >= level and not (depth[end] == level and tokens[end].upper in ("LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "FETCH", "UNION", "INTERSECT", "EXCEPT")):
            end += 1
        items = split_arguments(tokens[i:end])
        for k, item in enumerate(items):
            item = _order_items(item)
            words = [x.upper for x in significant(item)]
            if not within and "NULLS" not in words and words != ["ALL"]:
                tail = len(item)
                while tail and item[tail - 1].kind == "space":
                    tail -= 1
                item = [*item[:tail], Token("word", " NULLS FIRST" if words and words[-1] == "DESC" else " NULLS LAST"), *item[tail:]]
            out += ([Token("op", ",")] if k else []) + item
        i = end
    return out


def _like_pattern(literal: str) -> str:
    body = "".join({"%": ".*", "_": "."}.get(c, c) for c in literal[1:-1])
    return f"'^(?:{body})$'"


def _spellings(tokens: list[Token]) -> list[Token]:
    """Functions, operators and literals by their Spark names."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        last = next((x for x in reversed(out) if x.kind != "space"), None)
        after = _next(tokens, i + 1)
        called = t.kind == "word" and after < len(tokens) and tokens[after].text == "("
        if called and t.text.lower() in CALLS | RENAMED.keys():
            end = _close(tokens, after)
            inside = _spellings(tokens[after + 1 : end])
            name = t.text.lower()
            over = _next(tokens, end + 1)
            windowed = over < len(tokens) and tokens[over].upper in ("OVER", "WITHIN", "FILTER")
            made = None
            if name in CALLS:
                made = CALLS[name]([render(a).strip() for a in split_arguments(inside)], windowed, last.upper if last else "")
            if made is None:
                out += [Token("word", RENAMED.get(name, t.text)), Token("op", "("), *inside, Token("op", ")")]
            else:
                out += [Token("word", made)]
            i = end + 1
            continue
        if t.text == "[" and (last is None or last.kind == "op" and last.text not in ")]" or last.upper in ("SELECT", "IN", "AND", "OR", "NOT", "WHERE", "THEN", "ELSE", "AS", "VALUES")):
            end = _close(tokens, i)
            out += [Token("word", "array"), Token("op", "("), *_spellings(tokens[i + 1 : end]), Token("op", ")")]
            i = end + 1
            continue
        if t.kind == "op" and t.text in ("~", "!~", "~*", "!~*") and last is not None and (last.kind in ("word", "name", "string") or last.text in ")]"):
            out.append(Token("word", " NOT RLIKE " if t.text[0] == "!" else " RLIKE "))
            if t.text.endswith("*"):
                out.append(Token("word", "'(?i)' || "))
            i += 1
            continue
        if t.upper == "SIMILAR" and after < len(tokens) and tokens[after].upper == "TO":
            pattern = _next(tokens, after + 1)
            if tokens[pattern].kind != "string":
                raise SqlError("SIMILAR TO needs a literal pattern")
            out.append(Token("word", f"RLIKE {_like_pattern(tokens[pattern].text)}"))
            i = pattern + 1
            continue
        if t.upper == "EXCLUDE" and last is not None and last.text == "*":
            out.append(Token("word", "EXCEPT"))
            if tokens[after].text != "(":
                out.append(Token("op", f"({tokens[after].text})"))
                i = after
            i += 1
            continue
        if t.kind == "word" and t.text in ("blocks", "packs", "public", "temp") and after < len(tokens) and tokens[after].text == ".":
            name = _next(tokens, after + 1)
            if tokens[name].text.startswith(("__block_", "__pack_")) or tokens[name].text == "bundle":
                i = name
                continue
        out.append(t)
        i += 1
    return out


def _clause(tokens: list[Token], depth: list[int], word: str, start: int = 0) -> int:
    return next((i for i in range(start, len(tokens)) if depth[i] == 0 and tokens[i].upper == word), -1)


def _qualify(tokens: list[Token]) -> list[Token]:
    """QUALIFY as a filter over a subquery, at any depth."""
    i = 0
    while i < len(tokens):
        if tokens[i].text == "(" and tokens[i].kind == "op":
            end = _close(tokens, i)
            inner = _qualify(tokens[i + 1 : end])
            tokens = [*tokens[: i + 1], *inner, *tokens[end:]]
            i += len(inner) + 1
        i += 1
    depth = _depths(tokens)
    q = _clause(tokens, depth, "QUALIFY")
    if q >= 0:
        start = next(i for i in range(q, -1, -1) if depth[i] == 0 and tokens[i].upper == "SELECT")
        source = _clause(tokens, depth, "FROM", start)
        end = next((i for i in range(q + 1, len(tokens)) if depth[i] == 0 and tokens[i].upper in ("ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT")), len(tokens))
        inner = f"{render(tokens[start:source]).rstrip()}, ({render(tokens[q + 1 : end]).strip()}) AS __qualified {render(tokens[source:q])}"
        return tokenize(f"{render(tokens[:start])}SELECT * EXCEPT (__qualified) FROM ({inner}) WHERE __qualified {render(tokens[end:])}")
    return _distinct_on(tokens, depth)


def _distinct_on(tokens: list[Token], depth: list[int]) -> list[Token]:
    """DISTINCT ON keeps the first row, in the ORDER BY's order, of each key."""
    for i, t in enumerate(tokens):
        on = _next(tokens, i + 1)
        if t.upper == "DISTINCT" and depth[i] == 0 and on < len(tokens) and tokens[on].upper == "ON":
            open_ = _next(tokens, on + 1)
            close = _close(tokens, open_)
            start = next(k for k in range(i, -1, -1) if tokens[k].upper == "SELECT")
            source = _clause(tokens, depth, "FROM", close)
            order = _clause(tokens, depth, "ORDER", source)
            end = next((k for k in range(max(order, source) + 1, len(tokens)) if depth[k] == 0 and tokens[k].upper in ("LIMIT", "OFFSET")), len(tokens))
            keys = render(tokens[open_ + 1 : close])
            by = render(tokens[order:end]) if order >= 0 else f"ORDER BY {keys}"
            body = render(tokens[source : order if order >= 0 else end])
            inner = f"SELECT {render(tokens[close + 1 : source]).strip()}, row_number() OVER (PARTITION BY {keys} {by}) AS __nth {body}"
            return tokenize(f"{render(tokens[:start])}SELECT * EXCEPT (__nth) FROM ({inner}) WHERE __nth = 1 {render(tokens[end:])}")
    return tokens


AFTER_FROM = {"GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT"}


def _groups(tokens: list[Token]) -> list[Token]:
    """A GROUPS frame as a RANGE frame over the peers' ranks, which a subquery in place of the source adds; at any
    depth, in queries over one source without GROUP BY."""
    i = 0
    while i < len(tokens):
        if tokens[i].text == "(" and tokens[i].kind == "op":
            end = _close(tokens, i)
            inner = _groups(tokens[i + 1 : end])
            tokens = [*tokens[: i + 1], *inner, *tokens[end:]]
            i += len(inner) + 1
        i += 1
    depth = _depths(tokens)

    def framed(i: int) -> bool:
        after = _next(tokens, i + 1)
        return tokens[i].upper == "GROUPS" and depth[i] == 1 and after < len(tokens) and (tokens[after].kind == "number" or tokens[after].upper in ("BETWEEN", "UNBOUNDED", "CURRENT"))

    frames = [i for i in range(len(tokens)) if framed(i)]
    if not frames:
        return tokens
    start = max((i for i in range(frames[0]) if depth[i] == 0 and tokens[i].upper == "SELECT"), default=-1)
    source = _clause(tokens, depth, "FROM", max(start, 0))
    if start < 0 or source < 0:
        raise SqlError("a GROUPS frame needs a SELECT with a FROM")
    end = next((i for i in range(source, len(tokens)) if depth[i] == 0 and tokens[i].upper in AFTER_FROM), len(tokens))
    rest = next((i for i in range(end, len(tokens)) if depth[i] == 0 and tokens[i].upper in ("UNION", "INTERSECT", "EXCEPT")), len(tokens))
    where = _clause(tokens, depth, "WHERE", source)
    named = significant(tokens[source + 1 : where if 0 <= where < end else end])
    words = {t.upper for t, d in zip(tokens[start:rest], depth[start:rest], strict=True) if d == 0}
    if words & {"GROUP", "HAVING", "JOIN", "DISTINCT"} or any(t.text == "," for t in named[_close(named, 0) if named[0].text == "(" else 0 :]):
        raise SqlError("a GROUPS frame is only supported over one source, without GROUP BY and DISTINCT: put the rest in a subquery")
    alias = named[-1].text if named[-1].kind in ("word", "name") else "__source"
    own = [i for i in frames if start < i < rest]
    ranks, out, at = [], [], start
    for k, i in enumerate(own):
        open_ = max(j for j in range(i) if depth[j] == 0 and tokens[j].text == "(")
        order = next((j for j in range(open_, i) if depth[j] == 1 and tokens[j].upper == "ORDER"), None)
        if order is None:
            raise SqlError("a GROUPS frame needs an ORDER BY")
        ranks.append(f"dense_rank() OVER ({render(tokens[open_ + 1 : i])}) AS __peers_{k}")
        out += [*tokens[at:order], Token("word", f"ORDER BY __peers_{k} RANGE")]
        at = i + 1
    body = [*out, *tokens[at:rest]]
    level = _depths(body)
    source = _clause(body, level, "FROM")
    last = next((i for i in range(source, len(body)) if level[i] == 0 and body[i].upper in AFTER_FROM), len(body))
    listed = [Token("word", f"* EXCEPT ({', '.join(f'__peers_{k}' for k in range(len(own)))})") if t.text == "*" and d == 0 and not significant(body[:j])[-1].kind == "number" and significant(body[:j])[-1].upper in ("SELECT", ",") else t for j, (t, d) in enumerate(zip(body[:source], level[:source], strict=True))]
    text = f"{render(listed).rstrip()} FROM (SELECT *, {', '.join(ranks)} {render(body[source:last]).rstrip()}) {alias} {render(body[last:])}"
    return [*tokens[:start], *tokenize(text), *_groups(tokens[rest:])]


def translate(sql: str) -> str:
    """The text that Spark's parser gets."""
    return render(_qualify(_groups(_order_items(_spellings(tokenize(sql))))))


def union_by_name(sql: str) -> list[tuple[str, bool]] | None:
    """The parts of a top-level UNION [ALL] BY NAME, each with whether ALL joins it to those before; or None."""
    tokens = tokenize(sql)
    depth, cuts = _depths(tokens), []
    for i, t in enumerate(tokens):
        if t.upper == "UNION" and depth[i] == 0:
            j = _next(tokens, i + 1)
            all_ = tokens[j].upper == "ALL"
            j = _next(tokens, j + 1) if all_ else j
            k = _next(tokens, j + 1)
            if k < len(tokens) and tokens[j].upper == "BY" and tokens[k].upper == "NAME":
                cuts.append((i, k + 1, all_))
    if not cuts:
        return None
    edges = [0, *(c[1] for c in cuts)]
    ends = [*(c[0] for c in cuts), len(tokens)]
    alls = [True, *(c[2] for c in cuts)]
    return [(render(tokens[a:b]).strip(), x) for a, b, x in zip(edges, ends, alls, strict=True)]
