"""A small sandboxed template language for conversations, compiled to closures.

``compile_template`` parses the source into a syntax tree, folds constants
(literal expressions, branches with a constant condition, neighbouring text) and
generates Python closures. Rendering writes to a sink: pieces of text, and a flag
that says whether they lie between generation markers (the loss mask).

    {{ expr }}                                output
    {% for m in turns %} .. {% endfor %}      loop over the conversation's turns
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = e %}
    {% generation %} .. {% endgeneration %}   generation markers
    {# comment #}

Expressions: string, integer and boolean literals, none, names, ``a.b`` and
``a["b"]`` (dictionary keys only: no attribute, call or index of a Python object is
reachable), ``loop.first/last/index/index0``, ``+ == != < <= > >= and or not in``,
``~`` (joins as text), parentheses, and filters ``|trim |upper |lower |length
|escape |escape_role``. ``{%-`` and ``-%}`` strip white space beside a tag.
"""

from __future__ import annotations

import re
from typing import Callable, Iterable

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|=]))""")
TAG = re.compile(r"\{%-?(.*?)-?%\}|\{\{-?(.*?)-?\}\}|\{#-?.*?-?#\}", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template's source is wrong."""


# ---------------------------------------------------------------- expressions

class Expression:
    """Recursive-descent parser of one expression into tuples."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, value=None):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return text if value is None else text == value and kind in ("op", "name")

    def take(self, value=None):
        if self.at >= len(self.tokens) or value is not None and not self.peek(value):
            raise TemplateError(f"expected {value or 'an expression'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def either(self):
        left = self.both()
        while self.peek("or"):
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negation()
        while self.peek("and"):
            self.take()
            left = ("and", left, self.negation())
        return left

    def negation(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negation())
        return self.comparison()

    def comparison(self):
        left = self.sum()
        while self.peek() in ("==", "!=", "<", "<=", ">", ">=", "in") and self.tokens[self.at][0] != "str":
            op = self.take()[1]
            left = ("compare", op, left, self.sum())
        return left

    def sum(self):
        left = self.filtered()
        while self.peek("+") or self.peek("~"):
            op = self.take()[1]
            left = ("join" if op == "~" else "add", left, self.filtered())
        return left

    def filtered(self):
        tree = self.primary()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def primary(self):
        kind, text = self.take()
        if kind == "num":
            tree = ("value", int(text))
        elif kind == "str":
            tree = ("value", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif text == "(":
            tree = self.either()
            self.take(")")
        elif kind == "name":
            constant = {"true": True, "false": False, "none": None}
            tree = ("value", constant[text.lower()]) if text.lower() in constant else ("name", text)
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek(".") or self.peek("["):
            if self.take()[1] == ".":
                kind, key = self.take()
                if kind != "name":
                    raise TemplateError(f"expected a key after '.', found {key!r}")
                tree = ("key", tree, ("value", key))
            else:
                tree = ("key", tree, self.either())
                self.take("]")
        return tree


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


CONTROL = re.compile(r"\\|### |</turn>")
ROLE_CONTROL = re.compile(r"[\\:\n]|### |</turn>")


def escape(text) -> str:
    """A backslash before each backslash and control string."""
    return CONTROL.sub(lambda m: "\\" + m[0], as_text(text))


def escape_role(text) -> str:
    """As ``escape``; also before ``:`` and line ends, which close a role."""
    return ROLE_CONTROL.sub(lambda m: "\\" + m[0], as_text(text))


def unescape(text: str) -> str:
    """Undoes ``escape`` and ``escape_role``."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: as_text(x).strip(), "upper": lambda x: as_text(x).upper(), "lower": lambda x: as_text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0, "escape": escape, "escape_role": escape_role,
}
COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def key_of(holder, key):
    return holder.get(key) if isinstance(holder, dict) else None


def evaluator(tree) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind = tree[0]
    if kind == "value":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "not":
        a = evaluator(tree[1])
        return lambda env: not a(env)
    if kind == "filter":
        f, a = FILTERS[tree[1]], evaluator(tree[2])
        return lambda env: f(a(env))
    if kind == "compare":
        f, a, b = COMPARE[tree[1]], evaluator(tree[2]), evaluator(tree[3])
        return lambda env: f(a(env), b(env))
    a, b = evaluator(tree[1]), evaluator(tree[2])
    return {"or": lambda env: a(env) or b(env), "and": lambda env: a(env) and b(env), "key": lambda env: key_of(a(env), b(env)),
            "add": lambda env: a(env) + b(env), "join": lambda env: as_text(a(env)) + as_text(b(env))}[kind]


def fold(tree):
    """The expression with its constant parts evaluated."""
    if tree[0] in ("value", "name"):
        return tree
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in tree)
    if all(x[0] == "value" for x in parts[1:] if isinstance(x, tuple)):
        try:
            return ("value", evaluator(parts)({}))
        except TypeError as wrong:
            raise TemplateError(str(wrong)) from wrong
    return parts


# ------------------------------------------------------------------ statements

def split_source(source: str):
    """Text and tags: ("text", s), ("out", s), ("tag", s)."""
    at, strip = 0, False
    for m in TAG.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if m[0][2] == "-" else text
        strip, at = m[0][-3] == "-", m.end()
        if m[1] is not None:
            yield "tag", m[1].strip()
        elif m[2] is not None:
            yield "out", m[2].strip()
    yield "text", source[at:].lstrip() if strip else source[at:]


def parse(source: str):
    """The syntax tree, a list of nodes."""
    parts = list(split_source(source))
    at = 0

    def block(*ends):
        nonlocal at
        nodes = []
        while at < len(parts):
            kind, text = parts[at]
            at += 1
            if kind == "text":
                nodes.append(("text", text))
                continue
            if kind == "out":
                nodes.append(("out", Expression(text).whole()))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return nodes, word, rest
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read loop {text!r}")
                nodes.append(("for", m[1], Expression(m[2]).whole(), block("endfor")[0]))
            elif word == "if":
                arms, rest_of = [], rest
                while True:
                    test = Expression(rest_of).whole() if rest_of is not None else ("value", True)
                    body, end, rest_of = block("elif", "else", "endif")
                    arms.append((test, body))
                    if end == "endif":
                        break
                    rest_of = None if end == "else" else rest_of
                nodes.append(("if", arms))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"cannot set {name!r}")
                nodes.append(("set", name.strip(), Expression(value).whole()))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, None, None

    return block()[0]


def fold_nodes(nodes):
    """Constant output becomes text, constant branches go, neighbouring text joins."""
    out: list = []
    for node in nodes:
        if node[0] == "out":
            tree = fold(node[1])
            node = ("text", as_text(tree[1])) if tree[0] == "value" else ("out", tree)
        elif node[0] == "for":
            node = ("for", node[1], fold(node[2]), fold_nodes(node[3]))
        elif node[0] == "set":
            node = ("set", node[1], fold(node[2]))
        elif node[0] == "generation":
            node = ("generation", fold_nodes(node[1]))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                test = fold(test)
                if test[0] == "value" and not test[1]:
                    continue
                arms.append((test, fold_nodes(body)))
                if test[0] == "value":
                    break
            if not arms:
                continue
            if arms[0][0][0] == "value":
                for inner in arms[0][1]:
                    _append(out, inner)
                continue
            node = ("if", arms)
        _append(out, node)
    return out


def _append(out, node):
    if node[0] == "text":
        if not node[1]:
            return
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
            return
    out.append(node)


Emit = Callable[[str, bool], None]


def generate(nodes, masked: bool = False) -> Callable[[dict, Emit], None]:
    """One closure that runs the nodes in order."""
    steps = [_statement(node, masked) for node in nodes]

    def run(env, emit):
        for step in steps:
            step(env, emit)

    return run


def _statement(node, masked):
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, emit: emit(text, masked)
    if kind == "out":
        value = evaluator(node[1])
        return lambda env, emit: emit(as_text(value(env)), masked)
    if kind == "set":
        name, given = node[1], evaluator(node[2])

        def assign(env, emit):
            env[name] = given(env)

        return assign
    if kind == "generation":
        return generate(node[1], True)
    if kind == "if":
        arms = [(evaluator(test), generate(body, masked)) for test, body in node[1]]

        def branch(env, emit):
            for test, body in arms:
                if test(env):
                    return body(env, emit)

        return branch
    name, over, body = node[1], evaluator(node[2]), generate(node[3], masked)

    def loop(env, emit):
        shadowed = {k: env[k] for k in (name, "loop") if k in env}
        index, following = 0, iter(over(env) or ())
        item = next(following, loop)  # one item ahead, so that a stream of turns knows its last
        while item is not loop:
            ahead = next(following, loop)
            env[name] = item
            env["loop"] = {"first": index == 0, "last": ahead is loop, "index0": index, "index": index + 1}
            body(env, emit)
            item, index = ahead, index + 1
        env.pop(name, None)
        env.pop("loop", None)
        env.update(shadowed)

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict], Emit], None]:
    """``render(turns, emit)``: turns may be a stream; emit(text, masked) gets the
    output piece by piece."""
    body = generate(fold_nodes(parse(source)))

    def render(turns, emit):
        body({"turns": turns}, emit)

    return render
