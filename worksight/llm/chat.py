"""Chat formatting with compiled templates.

A small sandboxed template language is parsed into a syntax tree, constants are folded,
and the tree becomes nested Python closures. Rendering streams: a loop over `messages`
takes one message at a time, so a conversation of any length needs little memory.

    text {{ expression }} {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% for m in messages %}..{% endfor %}   {% set name = e %}
    {% generation %}..{% endgeneration %}   marks what a model learns to write
    {# comment #}

Expressions have strings, integers, true, false, none, names, m.role or m["role"],
loop.first, loop.index, == != < <= > >= in not and or, + and ~, and the filters trim,
upper, lower, length, escape and default(x). There are no calls and no other attributes,
so a template reaches nothing but its variables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import partitions


class TemplateError(ValueError):
    """The template can't be parsed, or asks for what the sandbox doesn't have."""


#: Control strings all begin with <| and texts never do once escaped: a backslash goes
#: between, one more than were there.
ESCAPED, UNESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return ESCAPED.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"<\1|", text) if "<" in text else text


FILTERS: dict[str, Callable] = {"trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "length": len, "escape": lambda v: escape(str(v)), "default": lambda v, other: other if v is None else v}
BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: shown(a) + shown(b)}
TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+~|().\[\],=]))""")
INSIDE = r"""((?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^"'])*?)"""
TAG = re.compile(rf"\{{\{{-?{INSIDE}-?\}}\}}|\{{%-?{INSIDE}-?%\}}|\{{#.*?#\}}", re.S)
LOOP = ("index", "index0", "first")
BACKSLASHED = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}


def shown(value) -> str:
    return "" if value is None else str(value)


class Expression:
    """Parser of one expression; trees are tuples whose first item names the kind."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, value: str | None = None) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or value not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"{value or kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            tree = ("binary", sign, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while sign := self.take("+", "~"):
            tree = ("binary", sign, tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.single()
        while self.take("|"):
            name, extra = self.need("name"), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.take("("):
                extra = [self.either()]
                self.need("sign", ")")
            tree = ("filter", name, tree, extra)
        return tree

    def single(self) -> tuple:
        if self.take("("):
            tree = self.either()
            self.need("sign", ")")
        elif self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        else:
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind == "text":
                tree = ("const", re.sub(r"\\(.)", lambda m: BACKSLASHED.get(m[1], m[1]), value[1:-1], flags=re.S))
            elif kind == "number":
                tree = ("const", int(value))
            elif kind == "name":
                tree = ("const", CONSTANTS[value]) if value in CONSTANTS else ("name", value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.take("."):
                name = self.need("name")
                if tree == ("name", "loop") and name not in LOOP:
                    raise TemplateError(f"no loop.{name}; loops run over streams and know {', '.join(LOOP)}")
                tree = ("item", tree, ("const", name))
            elif self.take("["):
                tree = ("item", tree, self.either())
                self.need("sign", "]")
            else:
                return tree


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    root: list[tuple] = []
    open_tags: list[tuple[str, list[tuple], tuple | None]] = [("", root, None)]
    at = 0
    for m in [*TAG.finditer(source), None]:
        body = open_tags[-1][1]
        text = source[at : m.start() if m else None]
        # A minus inside a tag takes away the white space beside it.
        text = text.lstrip() if at and source[at - 3 : at - 2] == "-" else text
        text = text.rstrip() if m and m[0][2] == "-" else text
        if "{{" in text or "{%" in text:
            raise TemplateError("a tag isn't closed")
        if text:
            body.append(("text", text))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            body.append(("show", Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            kind, _, node = open_tags[-1]
            if word == "if":
                node = ("if", [[Expression(rest).whole(), []]], [])
                body.append(node)
                open_tags.append(("if", node[1][0][1], node))
            elif word == "elif" and kind == "if":
                node[1].append([Expression(rest).whole(), []])
                open_tags[-1] = ("if", node[1][-1][1], node)
            elif word == "else" and kind == "if":
                open_tags[-1] = ("else", node[2], node)
            elif word == "for":
                e = Expression(rest)
                name = e.need("name")
                e.need("name", "in")
                node = ("for", name, e.whole(), [])
                body.append(node)
                open_tags.append(("for", node[3], node))
            elif word == "set":
                e = Expression(rest)
                name = e.need("name")
                e.need("sign", "=")
                body.append(("set", name, e.whole()))
            elif word == "generation":
                node = ("generation", [])
                body.append(node)
                open_tags.append(("generation", node[1], node))
            elif (word, kind) in (("endif", "if"), ("endif", "else"), ("endfor", "for"), ("endgeneration", "generation")):
                open_tags.pop()
            else:
                raise TemplateError(f"unexpected {{% {word} %}}")
    if len(open_tags) > 1:
        raise TemplateError(f"{{% {open_tags[-1][0]} %}} isn't closed")
    return root


def fold(tree: tuple) -> tuple:
    """An expression with its constant parts computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    parts = [fold(x) if isinstance(x, tuple) else [fold(y) for y in x] if isinstance(x, list) else x for x in tree[1:]]
    below = [y for x in parts for y in (x if isinstance(x, list) else [x]) if isinstance(y, tuple)]
    folded = (kind, *parts)
    if all(x[0] == "const" for x in below):
        try:
            return ("const", closure(folded)({}))
        except (TypeError, KeyError, IndexError):
            return folded
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return folded


def closure(tree: tuple) -> Callable[[dict], object]:
    """A function of the variables that computes a folded expression."""
    match tree:
        case ("const", value):
            return lambda scope: value
        case ("name", name):
            return lambda scope: scope.get(name)
        case ("item", of, key):
            of, key = closure(of), closure(key)

            def item(scope):
                value = of(scope)
                return value.get(key(scope)) if isinstance(value, dict) else None

            return item
        case ("binary", sign, left, right):
            f, left, right = BINARY[sign], closure(left), closure(right)
            return lambda scope: f(left(scope), right(scope))
        case ("filter", name, of, extra):
            f, of, extra = FILTERS[name], closure(of), [closure(x) for x in extra]
            return lambda scope: f(of(scope), *[x(scope) for x in extra])
        case ("not", of):
            of = closure(of)
            return lambda scope: not of(scope)
        case ("and", left, right):
            left, right = closure(left), closure(right)
            return lambda scope: left(scope) and right(scope)
        case ("or", left, right):
            left, right = closure(left), closure(right)
            return lambda scope: left(scope) or right(scope)
    raise TemplateError(f"no expression {tree[0]}")


Emit = Iterator[tuple[str, bool]]


def body_closure(nodes: list[tuple]) -> Callable[[dict, bool], Emit]:
    steps = [step for node in nodes for step in [node_closure(node)] if step]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, learned: bool) -> Emit:
        for step in steps:
            yield from step(scope, learned)

    return run


def node_closure(node: tuple) -> Callable[[dict, bool], Emit] | None:
    match node:
        case ("text", text):
            return lambda scope, learned: iter(((text, learned),))
        case ("show", tree):
            tree = fold(tree)
            if tree[0] == "const":
                return node_closure(("text", shown(tree[1])))
            value = closure(tree)
            return lambda scope, learned: iter(((shown(value(scope)), learned),))
        case ("set", name, tree):
            value = closure(fold(tree))

            def put(scope: dict, learned: bool) -> Emit:
                scope[name] = value(scope)
                return iter(())

            return put
        case ("generation", nodes):
            run = body_closure(nodes)
            return lambda scope, learned: run(scope, True)
        case ("if", branches, otherwise):
            folded = [(fold(tree), nodes) for tree, nodes in branches]
            tests = [(closure(tree), body_closure(nodes)) for tree, nodes in folded if tree[0] != "const" or tree[1]]
            last = body_closure(otherwise)

            def choose(scope: dict, learned: bool) -> Emit:
                for test, run in tests:
                    if test(scope):
                        return run(scope, learned)
                return last(scope, learned)

            return choose
        case ("for", name, tree, nodes):
            value, run = closure(fold(tree)), body_closure(nodes)

            def loop(scope: dict, learned: bool) -> Emit:
                for i, item in enumerate(value(scope) or ()):
                    yield from run(scope | {name: item, "loop": {"first": i == 0, "index": i + 1, "index0": i}}, learned)

            return loop
    raise TemplateError(f"no statement {node[0]}")


def compile_template(source: str) -> Callable[..., Emit]:
    """A function that renders variables into pieces (text, under a generation marker).

    What an expression can't do with its values is a TemplateError, like a mistake in the source.
    """
    try:
        run = body_closure(parse(source))
    except (TypeError, AttributeError, ArithmeticError) as e:
        raise TemplateError(f"constants that don't go together: {e}") from e

    def render(**scope) -> Emit:
        try:
            yield from run(scope, False)
        except (TypeError, AttributeError, ArithmeticError) as e:
            raise TemplateError(f"values that don't go together: {e}") from e

    return render


#: The production template. `escape` keeps control strings out of texts and roles.
TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"
CONTROL = re.compile(r"<\|(turn|text|end)\|>")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of what TEMPLATE made, read from it alone."""
    parts = CONTROL.split(formatted)
    if parts[0] or parts[1::2] != ["turn", "text", "end"] * (len(parts) // 6):
        raise ValueError("not in the template's format")
    return [(unescape(parts[i + 2]), unescape(parts[i + 4])) for i in range(0, len(parts) - 1, 6)]


class Digests:
    """Reads a formatted conversation as it comes, keeping only the digests of what it says."""

    def __init__(self):
        self.turns = self.learned = self.loss = self.chars = 0
        self.said, self.loss_said, self.pending, self.marked = hashlib.sha256(), hashlib.sha256(), [], []

    def add(self, piece: str, learned: bool) -> None:
        self.chars += len(piece)
        self.pending.append(piece)
        if learned:
            self.marked.append(piece)
        if piece == "<|end|>" or piece.endswith("<|end|>"):
            self.turn()

    def turn(self) -> None:
        for role, text in turns_of("".join(self.pending)):
            self.turns += 1
            self.said.update(f"{role}\n{text}\n".encode())
        text = unescape("".join(self.marked))
        self.loss += len(text)
        self.loss_said.update(text.encode())
        self.pending, self.marked = [], []


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together and by turn; of one turn by role and text, null first."""
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    return conversations.select(*columns).repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans of every conversation (conv_id, turn, role, text).

    spans are [start, end) in code points under a generation marker, adjoining ones merged.
    Null texts are empty, a null role is an empty one, rows with a null conv_id are one
    conversation, and repeated rows are turns of their own. Each conversation must fit in
    a task's memory here; `format_digests` needs no such room.
    """
    return ordered(conversations).mapInArrow(lambda batches: rendered(batches, template, whole=True), "conv_id long, formatted string, spans array<array<long>>")


def format_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Renders by TEMPLATE as format_conversations does and reads everything back from the
    output as it is written, turn by turn. Empty in, empty out.
    """
    return ordered(conversations).mapInArrow(lambda batches: rendered(batches, TEMPLATE, whole=False), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def rendered(batches: Iterator[pa.RecordBatch], template: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """Renders the conversations of a partition, each as its rows come."""
    render = compile_template(template)
    schema = pa.schema([("conv_id", pa.int64()), *([("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))] if whole else [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])])
    rows = ((c, {"role": r or "", "text": t}) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    waiting = next(rows, None)

    def messages(conv_id) -> Iterator[dict]:
        nonlocal waiting
        while waiting is not None and waiting[0] == conv_id:
            message = waiting[1]
            waiting = next(rows, None)
            yield message

    out: list[tuple] = []
    held = 0
    while waiting is not None:
        conv_id = waiting[0]
        turns = messages(conv_id)
        if whole:
            text, spans, at = [], [], 0
            for piece, learned in render(messages=turns):
                if learned and piece:
                    if spans and spans[-1][1] == at:
                        spans[-1][1] = at + len(piece)
                    else:
                        spans.append([at, at + len(piece)])
                text.append(piece)
                at += len(piece)
            out.append((conv_id, "".join(text), spans))
            held += at
        else:
            d = Digests()
            for piece, learned in render(messages=turns):
                d.add(piece, learned)
            out.append((conv_id, d.turns, d.said.hexdigest(), d.loss, d.loss_said.hexdigest(), d.chars))
            held += 200
        for _ in turns:  # what the template left out
            pass
        if held > 1 << 22 or waiting is None:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out, held = [], 0
