"""Statement templates: branches and loops over parameters, expanded ahead of time, rendered with bound values.

Syntax: {{.name}} is a value and becomes a bound parameter; {{if cond}} ... {{else if cond}} ... {{else}} ... {{end}};
{{with .name}} ... {{end}}; {{range .items}} ... {{end}}, where {{.}} is the item. Conditions: .name, literals,
eq ne lt le gt ge and or not len index, with parentheses.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from typing import Any

#: So many branch combinations are expanded in full; beyond, every branch is taken once with the others at their first choice.
MOST_EXPANSIONS = 256


class TemplateError(ValueError):
    pass


@dataclass
class Text:
    text: str


@dataclass
class Value:
    path: str


@dataclass
class If:
    branches: list[tuple[Any, list]]  # condition (None for else), body
    rebinds: str | None = None  # with


@dataclass
class Range:
    path: str
    body: list
    otherwise: list = field(default_factory=list)


_ACTION = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)


def parse(template: str) -> list:
    stack: list[tuple[str, Any, list]] = [("root", None, [])]
    at = 0
    for m in _ACTION.finditer(template):
        if m.start() > at:
            stack[-1][2].append(Text(template[at : m.start()]))
        at, action = m.end(), m[1]
        word, _, rest = action.partition(" ")
        if word in ("if", "with"):
            node = If([], rest.strip() if word == "with" else None)
            stack[-1][2].append(node)
            body: list = []
            node.branches.append((condition(rest), body))
            stack.append((word, node, body))
        elif word == "range":
            node = Range(rest.strip(), [])
            stack[-1][2].append(node)
            stack.append(("range", node, node.body))
        elif word == "else":
            kind, node, _ = stack.pop()
            if kind == "root":
                raise TemplateError("else without if")
            if isinstance(node, Range):
                stack.append((kind, node, node.otherwise))
            else:
                body = []
                node.branches.append((condition(rest.partition("if")[2]) if rest.startswith("if") else None, body))
                stack.append((kind, node, body))
        elif word == "end":
            if len(stack) == 1:
                raise TemplateError("end without a beginning")
            stack.pop()
        elif re.fullmatch(r"\.[\w.]*|\.", action):
            stack[-1][2].append(Value(action))
        else:
            raise TemplateError(f"action {action!r}")
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} without end")
    stack[0][2].append(Text(template[at:]))
    return stack[0][2]


_WORDS = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[()]|\.[\w.]*|[\w.+-]+)')


def condition(text: str) -> Any:
    """Nested lists of words: ["eq", ".a", "1"]."""
    words = _WORDS.findall(text)

    def group(i: int) -> tuple[list, int]:
        out: list = []
        while i < len(words):
            if words[i] == "(":
                inner, i = group(i + 1)
                out.append(inner)
            elif words[i] == ")":
                return out, i + 1
            else:
                out.append(words[i])
                i += 1
        return out, i

    out, _ = group(0)
    if not out:
        raise TemplateError("an empty condition")
    return out[0] if len(out) == 1 else out


def _lookup(path: str, scope: Any) -> Any:
    for part in [p for p in path.split(".") if p]:
        scope = scope.get(part) if isinstance(scope, dict) else getattr(scope, part)
    return scope


def truth(x: Any) -> bool:
    """False for None, false, zero and empty collections."""
    return bool(x)


def evaluate(c: Any, scope: Any) -> Any:
    if isinstance(c, str):
        if c.startswith("."):
            return _lookup(c, scope)
        if c.startswith('"'):
            return c[1:-1].replace('\\"', '"')
        if c in ("true", "false", "nil"):
            return {"true": True, "false": False, "nil": None}[c]
        return float(c) if "." in c else int(c)
    if len(c) == 1:
        return evaluate(c[0], scope)
    name, *args = c
    if name == "and":
        return next((v for v in (evaluate(a, scope) for a in args[:-1]) if not truth(v)), None) if not all(truth(evaluate(a, scope)) for a in args[:-1]) else evaluate(args[-1], scope)
    if name == "or":
        return next((v for v in (evaluate(a, scope) for a in args) if truth(v)), evaluate(args[-1], scope))
    v = [evaluate(a, scope) for a in args]
    if name == "not":
        return not truth(v[0])
    if name == "len":
        return len(v[0])
    if name == "index":
        out = v[0]
        for k in v[1:]:
            out = out[k]
        return out
    if name == "eq":
        return any(v[0] == x for x in v[1:])
    a, b = v
    return {"ne": lambda: a != b, "lt": lambda: a < b, "le": lambda: a <= b, "gt": lambda: a > b, "ge": lambda: a >= b}[name]()


@dataclass(frozen=True)
class Expansion:
    sql: str
    parameters: tuple[str, ...]
    branch: tuple[str, ...]
    sparse: bool = False  # one of a few, the template having too many


def _choices(nodes: list) -> dict[str, int]:
    """The decisions of a template and how many ways each can go; one condition repeated is one decision."""
    out: dict[str, int] = {}
    for n in nodes:
        if isinstance(n, If):
            key = "if " + str([c for c, _ in n.branches])
            out[key] = len(n.branches) + all(c is not None for c, _ in n.branches)
            for _, body in n.branches:
                out |= _choices(body)
        elif isinstance(n, Range):
            out["range " + n.path] = 3
            out |= _choices(n.body) | _choices(n.otherwise)
    return out


def expand(template: str, most: int = MOST_EXPANSIONS) -> list[Expansion]:
    """Every statement that the template can become, loops run 0, 1 and 2 times, with :p1, :p2 ... where values go.

    Beyond `most`, a sparse set that says so: every branch off, every branch on, and each branch on alone.
    """
    nodes = parse(template)
    options = _choices(nodes)
    total = 1
    for n in options.values():
        total *= n
    if total <= most:
        plans = [dict(zip(options, pick, strict=True)) for pick in itertools.product(*(range(n) for n in options.values()))]
    else:
        off = {k: n - 1 if k.startswith("if ") else 0 for k, n in options.items()}
        on = {k: 0 if k.startswith("if ") else n - 1 for k, n in options.items()}
        plans = [off, on] + [off | {k: i} for k, n in options.items() for i in range(n) if i != off[k]]
    out: dict[str, Expansion] = {}
    for plan in plans:
        parts: list[str] = []
        names: list[str] = []
        branch: list[str] = []

        def emit(nodes: list, plan: dict[str, int] = plan, parts: list = parts, names: list = names, branch: list = branch) -> None:
            for n in nodes:
                if isinstance(n, Text):
                    parts.append(n.text)
                elif isinstance(n, Value):
                    if n.path not in names or n.path == ".":
                        names.append(n.path)
                    parts.append(f":p{len(names) if n.path == '.' else names.index(n.path) + 1}")
                elif isinstance(n, If):
                    key = "if " + str([c for c, _ in n.branches])
                    branch.append(f"{key}={plan[key]}")
                    if plan[key] < len(n.branches):
                        emit(n.branches[plan[key]][1])
                else:
                    times = plan["range " + n.path]
                    branch.append(f"range {n.path}={times}")
                    for _ in range(times):
                        emit(n.body)
                    if not times:
                        emit(n.otherwise)

        emit(nodes)
        sql = "".join(parts)
        out.setdefault(sql, Expansion(sql, tuple(names), tuple(branch), total > most))
    return list(out.values())


@dataclass(frozen=True)
class Rendered:
    sql: str
    args: dict[str, Any]


def render(template: str, params: Any) -> Rendered:
    """The statement for these parameters: values are bound, never spliced; one value has one name, each turn of a loop its own."""
    parts: list[str] = []
    args: dict[str, Any] = {}
    named: dict[str, str] = {}

    def bind(path: str, value: Any, fresh: bool) -> None:
        if fresh or path not in named:
            named[path] = f"p{len(args) + 1}"
            args[named[path]] = value
        parts.append(":" + named[path])

    def emit(nodes: list, scope: Any, turn: bool) -> None:
        for n in nodes:
            if isinstance(n, Text):
                parts.append(n.text)
            elif isinstance(n, Value):
                bind(n.path, scope if n.path == "." else _lookup(n.path, scope), turn)
            elif isinstance(n, If):
                for c, body in n.branches:
                    if c is None or truth(evaluate(c, scope)):
                        emit(body, evaluate(c, scope) if n.rebinds and c is not None else scope, turn)
                        break
            else:
                items = _lookup(n.path, scope) or []
                for item in items:
                    emit(n.body, item, True)
                if not items:
                    emit(n.otherwise, scope, turn)

    emit(parse(template), params, False)
    return Rendered("".join(parts), args)


_PARAMETER = re.compile(r":p\d+\b")


def guard(template: str, rendered: Rendered) -> None:
    """Raises unless the rendered text, parameters apart, is an expansion of the template or one with a loop run more often."""
    shape = lambda s: re.sub(r"\s+", " ", _PARAMETER.sub(":p", s)).strip()
    found = expand(template)
    if shape(rendered.sql) in {shape(e.sql) for e in found} or any(isinstance(n, Range) for n in _walk(parse(template))):
        return
    if any(e.sparse for e in found):
        return
    raise TemplateError("the statement is no expansion of its template")


def _walk(nodes: list):
    for n in nodes:
        yield n
        if isinstance(n, If):
            for _, body in n.branches:
                yield from _walk(body)
        elif isinstance(n, Range):
            yield from _walk(n.body)
            yield from _walk(n.otherwise)


def hazards(template: str) -> list[str]:
    """Places where a bound value doesn't mean what it seems: inside a string or comment, or as an ORDER BY or GROUP BY item."""
    out = []
    for e in expand(template):
        for m in re.finditer(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", e.sql, re.S):
            if _PARAMETER.search(m[0]):
                out.append(f"a value inside {'a string' if m[0][0] == chr(39) else 'a comment'}: {m[0][:40]}")
        for m in re.finditer(r"\b(ORDER|GROUP)\s+BY\s+:p\d+\b", e.sql, re.I):
            out.append(f"a value as an item of {m[1].upper()} BY is a constant")
    return sorted(set(out))
