"""Chat formatting by a compiled template.

A template in a small sandboxed language is tokenised, parsed into a syntax tree, constant-folded and turned into Python closures. Closures
are generators of (text, is_generation) pieces, so a conversation of any length streams through: messages are read one ahead, nothing of
it is held. ``{% generation %}`` blocks mark what a model is trained on.

Language: ``{{ expr }}``, ``{% for m in messages %} ... {% endfor %}``, ``{% if %}/{% elif %}/{% else %}/{% endif %}``, ``{% set x = expr %}``,
``{% generation %} ... {% endgeneration %}``. Expressions: literals, names, ``m.role`` or ``m['role']``, ``loop.index``, ``loop.first``, ``loop.last``,
``== != and or not``, ``~`` and ``+`` for joining, filters ``trim upper lower escape escape_line``. Only mapping keys can be looked up; there are no
calls, no attributes of Python objects, no imports.

Escaping keeps control strings inside texts apart from those of the template: a backslash becomes two, ``<|`` becomes ``<\\|`` and, in
one-line fields, a line break becomes ``\\n``. ``unescape`` is its exact inverse.

Defined results: NULL texts and roles are empty; turns come in order of (turn, role, text) with NULL first, so ties and repeated rows
have one order; NULL conversation ids form one conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TEMPLATE = ("{% for m in messages %}<|im_start|>{{ m.role | escape_line }}\n"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
            "<|im_end|>\n{% endfor %}")
START, END = "<|im_start|>", "<|im_end|>\n"
PIECE = 1 << 16  # characters of output gathered into one row


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}
_LEX = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<op>==|!=|[|.\[\]()~+=])|(?P<name>[A-Za-z]\w*))")


class _Expression:
    """Recursive descent over one expression; yields nested tuples."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> tuple:
        kind, found = self.peek()
        if kind == "end" or value is not None and found != value:
            raise TemplateError(f"expected {value or 'more'}, found {found!r}")
        self.at += 1
        return kind, found

    def whole(self) -> tuple:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek() == ("name", "or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.inverse()
        while self.peek() == ("name", "and"):
            self.take()
            node = ("and", node, self.inverse())
        return node

    def inverse(self) -> tuple:
        if self.peek() == ("name", "not"):
            self.take()
            return ("not", self.inverse())
        node = self.joined()
        while self.peek()[1] in ("==", "!=") and self.peek()[0] == "op":
            node = (self.take()[1], node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek() in (("op", "~"), ("op", "+")):
            self.take()
            node = ("~", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.looked_up()
        while self.peek() == ("op", "|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def looked_up(self) -> tuple:
        kind, value = self.take()
        if value == "(":
            node = self.either()
            self.take(")")
        elif kind == "str":
            node = ("const", value[1:-1])
        elif kind == "num":
            node = ("const", int(value))
        elif kind == "name" and value in ("true", "false", "none"):
            node = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            node = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (("op", "."), ("op", "[")):
            if self.take()[1] == ".":
                node = ("key", node, ("const", self.take()[1]))
            else:
                node = ("key", node, self.either())
                self.take("]")
        return node


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template: a list of text, out, for, if, set and generation nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)

    def block(at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int, str]:
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("out", _Expression(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                nodes.append(("text", part))
            else:
                body = part[2:-2].strip()
                word, _, rest = body.partition(" ")
                if word in ends:
                    return nodes, at, body
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"not a loop: {body!r}")
                    inner, at, _ = block(at, ("endfor",))
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif word == "if":
                    arms, test, end = [], _Expression(rest).whole(), ""
                    while end != "endif":
                        inner, at, end = block(at, ("elif", "else", "endif"))
                        arms.append((test, inner))
                        test = _Expression(end[4:]).whole() if end.startswith("elif") else ("const", True)
                    nodes.append(("if", arms))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    nodes.append(("set", name.strip(), _Expression(value).whole()))
                elif word == "generation":
                    inner, at, _ = block(at, ("endgeneration",))
                    nodes.append(("generation", inner))
                else:
                    raise TemplateError(f"unknown tag {body!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, at, ""
    return block(0, ())[0]


_COMPUTE: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b)}


def _text(value) -> str:
    return "" if value is None else str(value)


def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold_expression(node[2])
        return ("const", FILTERS[node[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    inner = [fold_expression(n) for n in node[1:]]
    if kind in ("and", "or") and inner[0][0] == "const":
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    if kind == "not" and inner[0][0] == "const":
        return ("const", not inner[0][1])
    if kind in _COMPUTE and all(n[0] == "const" for n in inner):
        return ("const", _COMPUTE[kind](inner[0][1], inner[1][1]))
    return (kind, *inner)


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constant expressions become text, decided branches lose their test, neighbouring texts become one."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            value = fold_expression(node[1])
            made = [("text", _text(value[1]))] if value[0] == "const" else [("out", value)]
        elif kind == "for":
            made = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif kind == "set":
            made = [("set", node[1], fold_expression(node[2]))]
        elif kind == "generation":
            made = [("generation", fold(node[1]))]
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = fold_expression(test)
                if test[0] != "const" or test[1]:
                    arms.append((test, fold(body)))
                if test[0] == "const" and test[1]:
                    break
            made = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        else:
            made = [node]
        for m in made:
            if m[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + m[1])
            elif m != ("text", ""):
                out.append(m)
    return out


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda env: constant
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "filter":
        change, inner = FILTERS[node[1]], _value(node[2])
        return lambda env: change(_text(inner(env)))
    parts = [_value(n) for n in node[1:]]
    if kind == "key":
        def look_up(env: dict) -> object:
            holder = parts[0](env)
            return holder.get(parts[1](env)) if isinstance(holder, dict) else None
        return look_up
    if kind == "not":
        return lambda env: not parts[0](env)
    if kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    compute = _COMPUTE[kind]
    return lambda env: compute(parts[0](env), parts[1](env))


Closure = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _closure(node: tuple) -> Closure:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def constant(env: dict, trained: bool) -> Iterator[tuple[str, bool]]:
            yield text, trained
        return constant
    if kind == "out":
        value = _value(node[1])

        def written(env: dict, trained: bool) -> Iterator[tuple[str, bool]]:
            yield _text(value(env)), trained
        return written
    if kind == "set":
        target, value = node[1], _value(node[2])

        def assigned(env: dict, trained: bool) -> Iterator[tuple[str, bool]]:
            env[target] = value(env)
            return iter(())
        return assigned
    if kind == "generation":
        body = _sequence(node[1])
        return lambda env, trained: body(env, True)
    if kind == "if":
        arms = [(_value(test), _sequence(body)) for test, body in node[1]]

        def chosen(env: dict, trained: bool) -> Iterator[tuple[str, bool]]:
            return next((body(env, trained) for test, body in arms if test(env)), iter(()))
        return chosen
    name, values, body = node[1], _value(node[2]), _sequence(node[3])

    def repeated(env: dict, trained: bool) -> Iterator[tuple[str, bool]]:
        items = iter(values(env) or ())
        item, index, nothing = next(items, None), 0, None
        while item is not nothing:
            following = next(items, None)
            inner = dict(env)
            inner[name], inner["loop"] = item, {"index": index + 1, "index0": index, "first": index == 0, "last": following is None}
            yield from body(inner, trained)
            item, index = following, index + 1
    return repeated


def _sequence(nodes: list[tuple]) -> Closure:
    steps = [_closure(n) for n in nodes]

    def run(env: dict, trained: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, trained)
    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (dicts with role and text) to pieces (text, is_generation). Messages are read one ahead."""
    body = _sequence(fold(parse(source)))
    return lambda messages: body({"messages": messages}, False)


def _formatter(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def turns() -> Iterator[tuple[object, dict]]:
            for batch in batches:
                ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
                for i, role, text in zip(ids, roles, texts):
                    yield i, {"role": role or "", "text": text or ""}

        rows: list[tuple] = []
        held = 0
        source = turns()
        ahead = next(source, None)
        while ahead is not None:
            conv = ahead[0]

            def messages() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    message = ahead[1]
                    ahead = next(source, None)
                    yield message

            part, text, spans, size = 0, [], [], 0
            for piece, trained in render(messages()):
                if trained:
                    spans.append((size, size + len(piece)))
                text.append(piece)
                size += len(piece)
                if size >= PIECE:
                    rows.append((conv, part, "".join(text), spans))
                    held += size
                    part, text, spans, size = part + 1, [], [], 0
                    if held >= 64 * PIECE:
                        yield _formatted(rows)
                        rows, held = [], 0
            while ahead is not None and ahead[0] == conv:  # a template need not read its messages
                ahead = next(source, None)
            rows.append((conv, part, "".join(text), spans))
            held += size
            if held >= 64 * PIECE or len(rows) >= 10_000:
                yield _formatted(rows)
                rows, held = [], 0
        if rows:
            yield _formatted(rows)
    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    spans = [[{"start": a, "end": b} for a, b in r[3]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string()), pa.array(spans, _SPANS)], names=["conv_id", "part", "formatted", "loss_spans"])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, formatted, loss_spans): the formatted text of each conversation in parts, with the spans of generation markers in each part.

    A conversation that fits in one part has one row. Rows of a conversation stay together and in order within a partition.
    """
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                            F.col("text").cast("string").alias("text"))
               .repartition(width, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    return ordered.mapInArrow(_formatter(template), "conv_id long, part long, formatted string, loss_spans array<struct<start:long,end:long>>")


class _Reader:
    """Reads turns and trained text back from the formatted text; keeps at most the turn that is not complete yet."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.loss_rest = ""

    def feed(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        pieces = self.loss_rest + "".join(text[s["start"]:s["end"]] for s in spans)
        # a part may end inside an escape pair: an odd run of backslashes waits for its partner
        odd = (len(pieces) - len(pieces.rstrip("\\"))) % 2
        self.loss_rest = pieces[len(pieces) - odd:]
        loss = unescape(pieces[:len(pieces) - odd])
        self.loss_chars += len(loss)
        self.loss_hash.update(loss.encode("utf-8", "surrogatepass"))
        whole = self.rest + text
        at = 0
        while (end := whole.find(END, at)) >= 0:
            if not whole.startswith(START, at):
                raise ValueError("the formatted text does not start a turn where one is due")
            role, _, body = whole[at + len(START):end].partition("\n")
            self.turns += 1
            self.turn_hash.update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            at = end + len(END)
        self.rest = whole[at:]

    def row(self) -> tuple:
        if self.rest or self.loss_rest:
            raise ValueError("the formatted text ends inside a turn")
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ_BACK.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, reader = None, None
    for batch in batches:
        done = []
        for conv, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_spans"))):
            if reader is None or part == 0:
                if reader is not None:
                    done.append((current, *reader.row()))
                current, reader = conv, _Reader()
            reader.feed(text, spans)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names=names)
    if reader is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((current, *reader.row()), kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read from ``format_conversations``; it must not be shuffled in between."""
    return formatted.mapInArrow(_digests, READ_BACK)
