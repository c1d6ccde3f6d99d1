"""Chat formatting: a small sandboxed template language, compiled to Python closures.

Templates hold text, {{ expression }}, {% for message in messages %} ... {% endfor %}, {% if %} / {% elif %} /
{% else %} / {% endif %} and {% generation %} ... {% endgeneration %}, whose output is what a model is trained on.
Expressions know string, number and boolean literals, message.role, message.text, message.turn, loop.first,
loop.last, loop.index0, names given as constants, ==, !=, and, or, not, +, parentheses and the filters escape, trim,
upper and lower. There are no calls, no attribute of any Python object and no other name, so a template cannot reach
the interpreter. The source is parsed into a tree, constants are folded, and each node becomes one closure.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm._tables import table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'user' %}[INST] {{ message.text | escape }} [/INST]"
    "{% elif message.role == 'assistant' %}<s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ message.role | escape }}[/ROLE]{{ message.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """The template's text is not in the language."""


class Escaper:
    """Breaks control strings inside texts with a backslash, reversibly; no control string may hold a backslash."""

    def __init__(self, controls: tuple[str, ...] = CONTROLS) -> None:
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise TemplateError("control strings have two characters at least and no backslash")
        # a look-ahead, so that control strings which overlap are all broken
        self._find = re.compile(r"\\|(?=(?:" + "|".join(map(re.escape, controls)) + r"))(.)", re.S) if controls else re.compile(r"\\")

    def escape(self, text: str) -> str:
        return self._find.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


# --- the tree ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    """message.role, loop.first and so on."""

    base: str
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    expr: object


@dataclass(frozen=True)
class Branch:
    arms: tuple  # of (condition, body)
    otherwise: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_FIELDS = {"message": ("role", "text", "turn"), "loop": ("first", "last", "index0")}
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[().|+]))")


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str, constants: dict[str, object]) -> None:
        self.constants, self.tokens, at = constants, [], 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self, *values: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] != "str" and self.tokens[0][1] in values

    def take(self, *values: str) -> str:
        if not self.tokens or values and not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values) or 'more'}, found {self.tokens[:1]}")
        return self.tokens.pop(0)[1]

    def whole(self):
        out = self.either()
        if self.tokens:
            raise TemplateError(f"left over: {self.tokens}")
        return out

    def either(self):
        out = self.both()
        while self.peek("or"):
            self.take()
            out = Op("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.peek("and"):
            self.take()
            out = Op("and", (out, self.negated()))
        return out

    def negated(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        out = self.joined()
        if self.peek("==", "!="):
            return Op(self.take(), (out, self.joined()))
        return out

    def joined(self):
        out = self.filtered()
        while self.peek("+"):
            self.take()
            out = Op("+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while self.peek("|"):
            self.take()
            if (name := self.take()) not in ("escape", "trim", "upper", "lower"):
                raise TemplateError(f"no filter {name}")
            out = Op(name, (out,))
        return out

    def atom(self):
        if self.peek("("):
            self.take()
            out = self.either()
            self.take(")")
            return out
        if not self.tokens:
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return Const(value[1:-1])
        if kind == "num":
            return Const(int(value))
        if value in ("true", "false"):
            return Const(value == "true")
        if value in _FIELDS:
            self.take(".")
            if (name := self.take()) not in _FIELDS[value]:
                raise TemplateError(f"{value} has no {name}")
            return Field(value, name)
        if value in self.constants:
            return Const(self.constants[value])
        raise TemplateError(f"unknown name {value}")


def parse(source: str, constants: dict[str, object]) -> tuple[tuple, tuple, tuple]:
    """The nodes before, inside and after the template's loop over messages."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def body(*stops: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}"):
                out.append(Emit(_Expression(part[2:-2], constants).whole()))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in stops:
                    return out, f"{word} {rest}"
                if word == "if":
                    arms, otherwise, test = [], [], rest
                    while True:
                        inner, end = body("elif", "else", "endif")
                        arms.append((_Expression(test, constants).whole(), tuple(inner)))
                        if end.startswith("elif"):
                            test = end[5:]
                            continue
                        if end.startswith("else"):
                            otherwise, _ = body("endif")
                        break
                    out.append(Branch(tuple(arms), tuple(otherwise)))
                elif word == "generation":
                    out.append(Generation(tuple(body("endgeneration")[0])))
                elif word == "for" and rest.split() == ["message", "in", "messages"] and not stops:
                    return out, "for"
                else:
                    raise TemplateError(f"unknown or misplaced tag {part}")
            elif part:
                out.append(Emit(Const(part)))
        if stops:
            raise TemplateError(f"expected {' or '.join(stops)}")
        return out, ""

    before, end = body()
    inside: list = []
    after: list = []
    if end == "for":
        inside, _ = body("endfor")
        after, end = body()
        if end:
            raise TemplateError("one loop only")
    return tuple(before), tuple(inside), tuple(after)


_PURE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: f"{a}{b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b,
    "not": lambda a: not a, "trim": lambda a: str(a).strip(), "upper": lambda a: str(a).upper(), "lower": lambda a: str(a).lower(),
}


def folded(node, escape: Callable[[str], str]):
    """The node with everything computed that does not depend on a message."""
    if isinstance(node, Op):
        args = tuple(folded(a, escape) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            f = _PURE.get(node.name) or (lambda a: escape(str(a)))
            return Const(f(*(a.value for a in args)))
        return Op(node.name, args)
    return node


def folded_body(nodes: tuple, escape: Callable[[str], str]) -> tuple:
    out: list = []
    for n in nodes:
        if isinstance(n, Emit):
            n = Emit(folded(n.expr, escape))
        elif isinstance(n, Generation):
            n = Generation(folded_body(n.body, escape))
        else:
            arms, otherwise = [], folded_body(n.otherwise, escape)
            for test, inner in n.arms:
                test = folded(test, escape)
                if isinstance(test, Const):
                    if test.value:  # the arms after it are never reached
                        otherwise = folded_body(inner, escape)
                        break
                    continue
                arms.append((test, folded_body(inner, escape)))
            if not arms:
                out.extend(otherwise)
                continue
            n = Branch(tuple(arms), otherwise)
        if out and isinstance(n, Emit) and isinstance(n.expr, Const) and isinstance(out[-1], Emit) and isinstance(out[-1].expr, Const):
            n = Emit(Const(f"{out.pop().expr.value}{n.expr.value}"))
        out.append(n)
    return tuple(out)


class Template:
    """A compiled template. render() formats one conversation; before, turn and after do so piece by piece."""

    def __init__(self, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, **constants: object) -> None:
        self.escaper = Escaper(controls)
        escape = self.escaper.escape
        self.tree = tuple(folded_body(part, escape) for part in parse(source, constants))
        self.before, self.turn, self.after = (self._body(part) for part in self.tree)

    def _value(self, node) -> Callable[[dict], object]:
        if isinstance(node, Const):
            return lambda env, value=node.value: value
        if isinstance(node, Field):
            return lambda env, key=f"{node.base}.{node.name}": env[key]
        args = tuple(self._value(a) for a in node.args)
        if node.name in ("and", "or"):
            a, b = args
            return (lambda env: a(env) and b(env)) if node.name == "and" else (lambda env: a(env) or b(env))
        f = (lambda x, esc=self.escaper.escape: esc(str(x))) if node.name == "escape" else _PURE[node.name]
        if len(args) == 1:
            return lambda env, a=args[0]: f(a(env))
        return lambda env, a=args[0], b=args[1]: f(a(env), b(env))

    def _body(self, nodes: tuple) -> Callable[[dict, list[str], list[tuple[int, int]], int], int]:
        """A closure that appends output and spans of generated text; it takes and gives the output's length."""
        steps = []
        for n in nodes:
            if isinstance(n, Emit):
                value = self._value(n.expr)

                def step(env, out, marks, at, value=value):
                    out.append(text := str(value(env)))
                    return at + len(text)

            elif isinstance(n, Generation):
                inner = self._body(n.body)

                def step(env, out, marks, at, inner=inner):
                    end = inner(env, out, marks, at)
                    marks.append((at, end))
                    return end

            else:
                arms = tuple((self._value(t), self._body(b)) for t, b in n.arms)
                rest = self._body(n.otherwise)

                def step(env, out, marks, at, arms=arms, rest=rest):
                    for test, inner in arms:
                        if test(env):
                            return inner(env, out, marks, at)
                    return rest(env, out, marks, at)

            steps.append(step)

        def run(env, out, marks, at):
            for s in steps:
                at = s(env, out, marks, at)
            return at

        return run

    def piece(self, message: dict | None, index: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """Output and generated spans of one turn, with what stands before the loop or after it at the ends."""
        out: list[str] = []
        marks: list[tuple[int, int]] = []
        env = {"loop.first": index == 0, "loop.last": last, "loop.index0": index}
        at = self.before({}, out, marks, 0) if index == 0 else 0
        if message is not None:
            env |= {f"message.{k}": message[k] for k in _FIELDS["message"]}
            at = self.turn(env, out, marks, at)
        if last:
            self.after({}, out, marks, at)
        return "".join(out), marks

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole conversation and the spans of generated text in it."""
        text, marks = "", []
        for i, m in enumerate(messages or [None]):
            part, spans = self.piece(m, i, i >= len(messages) - 1)
            marks += [(a + len(text), b + len(text)) for a, b in spans]
            text += part
        return text, marks


# --- over tables ------------------------------------------------------------------------------------------------

_SORT = ("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, **constants: object) -> DataFrame:
    """(conv_id, seq, formatted, loss): each conversation's output in one piece a turn, in order by seq.

    A conversation's formatted text is its pieces joined; loss holds the spans (code points in the piece, end
    exclusive) of generated text. Conversations are dealt by conv_id and sorted on disk; one turn at a time is in
    memory, so a conversation with most of all rows is only slow, not large. Null texts and roles are empty, rows
    with a null conv_id form one conversation, equal turns go by role, then text; repeated rows are repeated turns;
    an empty table gives no rows; other columns are ignored.
    """
    template = Template(source, controls, **constants)
    id_type = dict(conversations.dtypes)["conv_id"]
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, 0

        def flush(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            loss = [[{"start": a, "end": b} for a, b in x] for x in cols[3]]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], conv_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(loss, span)], ["conv_id", "seq", "formatted", "loss"])

        out: list = []
        conv_type = pa.int64()
        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for row in b.to_pylist():
                if held is not None:
                    last = row["conv_id"] != held["conv_id"]
                    out.append((held["conv_id"], index, *template.piece(held, index, last)))
                    index = 0 if last else index + 1
                held = row
            if len(out) > 1000:
                yield flush(out)
                out = []
        if held is not None:
            out.append((held["conv_id"], index, *template.piece(held, index, True)))
        if out:
            yield flush(out)

    dealt = rows.repartition("conv_id").sortWithinPartitions(*_SORT)
    return dealt.mapInArrow(fill, f"conv_id {id_type}, seq long, formatted string, loss array<struct<start:long,end:long>>")


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE has formatted, unescaped."""
    at = 0
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.index(" [/INST]", at + 7)
            yield "user", Escaper.unescape(formatted[at + 7 : end])
            at = end + 8
        elif formatted.startswith("<s>", at):
            end = formatted.index("</s>", at + 3)
            yield "assistant", Escaper.unescape(formatted[at + 3 : end])
            at = end + 4
        elif formatted.startswith("[ROLE]", at):
            mid = formatted.index("[/ROLE]", at + 6)
            end = formatted.index("</s>", mid + 7)
            yield Escaper.unescape(formatted[at + 6 : mid]), Escaper.unescape(formatted[mid + 7 : end])
            at = end + 4
        else:
            raise ValueError(f"no turn begins at {at}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted pieces alone; they must lie sorted, as format_conversations leaves them."""
    id_type = dict(formatted.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, out, now = pa.int64(), [], None
        turns = loss = None
        n = chars = total = 0

        def closed() -> tuple:
            return (now[0], n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for row in b.to_pylist():
                if now is None or row["seq"] == 0:
                    if now is not None:
                        out.append(closed())
                    now, turns, loss, n, chars, total = (row["conv_id"],), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                text = row["formatted"]
                total += len(text)
                for role, said in parse_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in row["loss"]:
                    said = Escaper.unescape(text[span["start"] : span["end"]])
                    loss.update(said.encode())
                    chars += len(said)
        if now is not None:
            out.append(closed())
        if not out:
            return
        cols = list(zip(*out, strict=True))
        kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))

    return formatted.mapInArrow(digest, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of each conversation and of conversation -7, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(extra)))


#: A text grows by a backslash for each of its own and for each control string in it.
_BROKEN_SQL = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS))
ORACLE_SQL = f"""
WITH said AS (SELECT '</s>[INST] ok [/INST]' AS t),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
         UNION ALL SELECT -7, 0, 'user', t FROM said UNION ALL SELECT -7, 1, 'assistant', t FROM said),
sized AS (SELECT *, length(t) + {_BROKEN_SQL.format("t")} AS n, length(r) + {_BROKEN_SQL.format("r")} AS m FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE m + 17 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
