"""A Java front-end with expression grammar.

A recursive-descent parser whose rules are generators run by `trampoline`, so nesting is
bounded by memory and not by the interpreter's stack. What a rule can't read becomes an
ERROR node up to the next ; or block, so malformed text never raises. Every character lies
in exactly one leaf: white space and comments are put back where they stood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_LEX = re.compile(
    r"""(?P<spaces>\s+)|(?P<line_comment>//[^\n]*)|(?P<block_comment>/\*.*?\*/)|(?P<string_literal>\"{3}.*?\"{3}|"(?:[^"\\\n]|\\.)*")|(?P<character_literal>'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<number>0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"""
    r"""|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<punct>\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[-+*/%&|^=!<>]=|.)""",
    re.S,
)
#: Words of the language: fixed values.
PRIMITIVE = {"byte": "integral_type", "short": "integral_type", "int": "integral_type", "long": "integral_type", "char": "integral_type", "float": "floating_point_type", "double": "floating_point_type", "boolean": "boolean_type", "void": "void_type"}
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = frozenset(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package "
    "private protected public return static strictfp super switch synchronized this throw throws transient try volatile while true false null".split()
) | PRIMITIVE.keys()
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
#: Binary operators from weakest to strongest.
LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">=", "instanceof"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]
STRENGTH = {op: i for i, ops in enumerate(LEVELS) for op in ops}
LITERALS = {"string_literal", "character_literal", "number"}
TRIVIA = {"spaces", "line_comment", "block_comment"}
TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}


class Mismatch(Exception):
    """A rule can't read what comes next."""


def trampoline(rule):
    """Runs a generator that yields generators and receives their results, on an explicit stack."""
    stack, value, error = [rule], None, None
    while stack:
        try:
            step = stack[-1].throw(error) if error is not None else stack[-1].send(value)
            error = value = None
            stack.append(step)
        except StopIteration as done:
            stack.pop()
            value, error = done.value, None
        except Mismatch as failed:
            stack.pop()
            value, error = None, failed
    if error is not None:
        raise error
    return value


def node(kind: str, kids: list, role: str | None = None) -> list:
    """[type, role, children, first token, last token]; None among the children is left out."""
    kids = [k for k in kids if k is not None]
    return [kind, role, kids, kids[0][3] if kids else None, kids[-1][4] if kids else None]


def as_role(n: list | None, role: str) -> list | None:
    if n is not None:
        n[1] = role
    return n


class Parser:
    """Rules read from self.at on and return nodes; those that nest are generators."""

    def __init__(self, text: str):
        self.all = [(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(text)]
        self.code = [i for i, t in enumerate(self.all) if t[0] not in TRIVIA]
        self.kinds = [self.all[i][0] for i in self.code] + ["end"] * 4
        self.texts = [self.all[i][1] for i in self.code] + [""] * 4
        self.end, self.at = len(self.code), 0
        self.shut, open_ = {}, []
        for i in range(self.end):
            if self.kinds[i] == "punct":
                t = self.texts[i]
                if t in "([{":
                    open_.append(i)
                elif t in ")]}":
                    while open_ and self.texts[open_[-1]] + t not in ("()", "[]", "{}"):
                        open_.pop()
                    if open_:
                        self.shut[open_.pop()] = i

    # Tokens

    def peek(self, k: int = 0) -> str:
        """The text k tokens on; empty for literals, so that they equal no word or mark."""
        i = self.at + k
        return self.texts[i] if i < self.end and self.kinds[i] not in LITERALS else ""

    def is_name(self, i: int) -> bool:
        return i < self.end and self.kinds[i] == "word" and self.texts[i] not in KEYWORDS

    def take(self, kind: str | None = None, role: str | None = None, joined: int = 1) -> list:
        """A leaf of the next token, or of `joined` adjacent ones."""
        i = self.at
        if i >= self.end:
            raise Mismatch
        group, t = self.kinds[i], self.texts[i]
        if kind is None:
            if group == "word":
                kind = {"null": "null_literal"}.get(t, t) if t in KEYWORDS else "identifier"
            elif group == "number":
                low = t.lower()
                if low.startswith("0x"):
                    kind = "hex_floating_point_literal" if "p" in low or "." in low else "hex_integer_literal"
                elif low.startswith("0b"):
                    kind = "binary_integer_literal"
                elif any(c in low for c in ".e") or low[-1] in "fd":
                    kind = "decimal_floating_point_literal"
                else:
                    kind = "octal_integer_literal" if len(low.rstrip("l")) > 1 and low[0] == "0" else "decimal_integer_literal"
            else:
                kind = "".join(self.texts[i : i + joined]) if group == "punct" else group
        self.at += joined
        return [kind, role, None, i, i + joined - 1]

    def expect(self, text: str, role: str | None = None) -> list:
        if self.peek() != text:
            raise Mismatch
        return self.take(role=role)

    def name(self, role: str | None = None, kind: str = "identifier") -> list:
        if not self.is_name(self.at):
            raise Mismatch
        return self.take(kind, role)

    def operator(self) -> tuple[str, int]:
        """The operator that comes next and of how many tokens; > signs that touch are one."""
        t, n = self.peek(), 1
        if t == ">":
            while n < 4 and self.peek(n) in (">", ">=") and self.all[self.code[self.at + n - 1]][3] == self.all[self.code[self.at + n]][2]:
                n += 1
                if self.peek(n - 1) == ">=":
                    break
            t = "".join(self.texts[self.at : self.at + n])
        return t, n

    # Looking ahead without reading

    def scan_type(self, i: int, dims: bool = True) -> int:
        """The place after a type that begins at token i, or -1."""
        word = self.texts[i] if i < self.end and self.kinds[i] == "word" else ""
        if word in PRIMITIVE:
            i += 1
        elif self.is_name(i):
            while True:
                i += 1
                if i < self.end and self.texts[i] == "<":
                    depth = 0
                    while i < self.end:
                        t = self.texts[i]
                        depth += (t == "<") - (t == ">")
                        if not (t in "<>,.?&[]@" or self.is_name(i) or t in PRIMITIVE or t in ("extends", "super")) or self.kinds[i] in LITERALS:
                            return -1
                        i += 1
                        if not depth:
                            break
                    if depth:
                        return -1
                if i < self.end and self.texts[i] == "." and self.is_name(i + 1):
                    i += 1
                    continue
                break
        else:
            return -1
        while dims and i + 1 < self.end and self.texts[i] == "[" and self.texts[i + 1] == "]":
            i += 2
        return i

    def is_lambda(self) -> bool:
        if self.is_name(self.at):
            return self.peek(1) == "->"
        after = self.shut.get(self.at, -2) + 1 if self.peek() == "(" else -1
        return 0 < after < self.end and self.texts[after] == "->"

    def is_cast(self) -> bool:
        close = self.shut.get(self.at, -1)
        i = self.scan_type(self.at + 1)
        while i > 0 and i < close and self.texts[i] == "&":
            i = self.scan_type(i + 1)
        if close < 0 or i != close or close + 1 >= self.end:
            return False
        if self.texts[self.at + 1] in PRIMITIVE and self.texts[close - 1] != "]":
            return self.texts[close + 1] not in ".;,)]}?:=&|^*/%<>" or self.kinds[close + 1] in LITERALS
        t = self.texts[close + 1]
        return self.kinds[close + 1] in LITERALS or self.is_name(close + 1) or t in ("(", "!", "~", "this", "super", "new", "switch", "true", "false", "null") or t in PRIMITIVE

    def is_declaration(self) -> bool:
        i = self.scan_type(self.at)
        return i > 0 and self.is_name(i) and i + 1 < self.end and self.texts[i + 1] in ("=", ";", ",", ":", "[")

    # Names, types, modifiers

    def dotted(self, role: str | None = None, kind: str = "scoped_identifier") -> list:
        n = self.name()
        while self.peek() == "." and self.is_name(self.at + 1):
            n = node(kind, [as_role(n, "scope"), self.take(), self.name("name")])
        return as_role(n, role) if role else n

    def type_(self, role: str | None = None, dims: bool = True):
        marks = []
        while self.peek() == "@":
            marks.append((yield self.annotation()))
        if self.peek() in PRIMITIVE:
            n = self.take(PRIMITIVE[self.peek()])
        else:
            n = self.name(kind="type_identifier")
            while True:
                if self.peek() == "<":
                    n = node("generic_type", [n, (yield self.type_arguments())])
                if self.peek() == "." and self.is_name(self.at + 1):
                    n = node("scoped_type_identifier", [n, self.take(), self.name(kind="type_identifier")])
                    continue
                break
        if marks:
            n = node("annotated_type", [*marks, n])
        if dims and self.peek() == "[" and self.peek(1) == "]":
            n = node("array_type", [as_role(n, "element"), self.dimensions()])
        n[1] = role
        return n

    def dimensions(self) -> list:
        kids = []
        while self.peek() == "[" and self.peek(1) == "]":
            kids += [self.take(), self.take()]
        return node("dimensions", kids, "dimensions")

    def type_arguments(self, role: str | None = None):
        kids = [self.expect("<")]
        while self.peek() != ">":
            if self.peek() == "?":
                wild = [self.take()]
                if self.peek() in ("extends", "super"):
                    wild += [self.take(), (yield self.type_())]
                kids.append(node("wildcard", wild))
            else:
                kids.append((yield self.type_()))
            if self.peek() != ">":
                kids.append(self.expect(","))
        return node("type_arguments", [*kids, self.take()], role)

    def type_parameters(self):
        kids = [self.expect("<")]
        while self.peek() != ">":
            own = []
            while self.peek() == "@":
                own.append((yield self.annotation()))
            own.append(self.name(kind="type_identifier"))
            if self.peek() == "extends":
                bound = [self.take(), (yield self.type_())]
                while self.peek() == "&":
                    bound += [self.take(), (yield self.type_())]
                own.append(node("type_bound", bound))
            kids.append(node("type_parameter", own))
            if self.peek() != ">":
                kids.append(self.expect(","))
        return node("type_parameters", [*kids, self.take()], "type_parameters")

    def types(self):
        kids = [(yield self.type_())]
        while self.peek() in (",", "&"):
            kids += [self.take(), (yield self.type_())]
        return node("type_list", kids)

    def modifiers(self):
        kids = []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                kids.append((yield self.annotation()))
            elif self.peek() == "non" and self.peek(1) == "-" and self.peek(2) == "sealed":
                kids.append(self.take("non-sealed", joined=3))
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")) and not (self.peek() == "sealed" and self.peek(1) in ("=", ".", "(", ";")) and not (self.peek() == "synchronized" and self.peek(1) == "("):
                kids.append(self.take(self.peek()))
            else:
                return node("modifiers", kids) if kids else None

    def annotation(self):
        kids = [self.expect("@"), self.dotted("name")]
        if self.peek() != "(":
            return node("marker_annotation", kids)
        args = [self.take()]
        while self.peek() != ")":
            if self.is_name(self.at) and self.peek(1) == "=":
                args.append(node("element_value_pair", [self.name("key"), self.take(), as_role((yield self.element_value()), "value")]))
            else:
                args.append((yield self.element_value()))
            if self.peek() != ")":
                args.append(self.expect(","))
        return node("annotation", [*kids, node("annotation_argument_list", [*args, self.take()], "arguments")])

    def element_value(self):
        if self.peek() == "@":
            return (yield self.annotation())
        if self.peek() != "{":
            return (yield self.ternary())
        kids = [self.take()]
        while self.peek() != "}":
            kids.append((yield self.element_value()))
            if self.peek() != "}":
                kids.append(self.expect(","))
        return node("element_value_array_initializer", [*kids, self.take()])

    # Expressions

    def expression(self):
        if self.is_lambda():
            return (yield self.lambda_())
        left = yield self.ternary()
        op, n = self.operator()
        if op in ASSIGN:
            return node("assignment_expression", [as_role(left, "left"), self.take(op, "operator", n), as_role((yield self.expression()), "right")])
        return left

    def ternary(self):
        left = yield self.binary(0)
        if self.peek() != "?":
            return left
        kids = [as_role(left, "condition"), self.take(), as_role((yield self.expression()), "consequence"), self.expect(":")]
        return node("ternary_expression", [*kids, as_role((yield (self.lambda_() if self.is_lambda() else self.ternary())), "alternative")])

    def binary(self, least: int):
        left = yield self.unary()
        while True:
            op, n = self.operator()
            strength = STRENGTH.get(op, -1)
            if strength < least:
                return left
            left, sign = as_role(left, "left"), self.take(op, "operator" if op != "instanceof" else None, n)
            if op == "instanceof":
                final = self.take() if self.peek() == "final" else None
                kids = [left, sign, final, (yield self.type_("right"))]
                if self.peek() == "(":
                    kids[-1] = node("record_pattern", [as_role(kids[-1], None), (yield self.pattern_body())], "pattern")
                elif self.is_name(self.at):
                    kids.append(self.name("name"))
                left = node("instanceof_expression", kids)
            else:
                left = node("binary_expression", [left, sign, as_role((yield self.binary(strength + 1)), "right")])

    def pattern_body(self):
        kids = [self.expect("(")]
        while self.peek() != ")":
            kind = yield self.type_()
            part = [kind, (yield self.pattern_body())] if self.peek() == "(" else [kind, self.name()]
            kids.append(node("record_pattern" if len(part[1:]) and part[1][0] == "record_pattern_body" else "record_pattern_component", part))
            if self.peek() != ")":
                kids.append(self.expect(","))
        return node("record_pattern_body", [*kids, self.take()])

    def unary(self):
        t = self.peek()
        if t in ("+", "-", "!", "~"):
            return node("unary_expression", [self.take(role="operator"), as_role((yield self.unary()), "operand")])
        if t in ("++", "--"):
            return node("update_expression", [self.take(), (yield self.unary())])
        if t == "(" and not self.is_lambda() and self.is_cast():
            kids = [self.take(), (yield self.type_("type"))]
            while self.peek() == "&":
                kids += [self.take(), (yield self.type_("type"))]
            kids.append(self.expect(")"))
            return node("cast_expression", [*kids, as_role((yield (self.lambda_() if self.is_lambda() else self.unary())), "value")])
        return (yield self.postfix())

    def postfix(self):
        n = yield self.primary()
        while True:
            t = self.peek()
            if t == ".":
                dot = self.take()
                if self.peek() == "new":
                    inner = yield self.creation()
                    n = node(inner[0], [n, dot, *inner[2]])
                elif self.peek() == "class":
                    n = node("class_literal", [n, dot, self.take()])
                elif self.peek() in ("this", "super"):
                    n = node("field_access", [as_role(n, "object"), dot, self.take(role="field")])
                else:
                    given = (yield self.type_arguments("type_arguments")) if self.peek() == "<" else None
                    name = self.name()
                    if self.peek() == "(":
                        n = node("method_invocation", [as_role(n, "object"), dot, given, as_role(name, "name"), (yield self.arguments())])
                    else:
                        n = node("field_access", [as_role(n, "object"), dot, as_role(name, "field")])
            elif t == "[":
                n = node("array_access", [as_role(n, "array"), self.take(), as_role((yield self.expression()), "index"), self.expect("]")])
            elif t in ("++", "--"):
                n = node("update_expression", [n, self.take()])
            elif t == "::":
                kids = [n, self.take()]
                if self.peek() == "<":
                    kids.append((yield self.type_arguments()))
                n = node("method_reference", [*kids, self.take() if self.peek() == "new" else self.name()])
            else:
                return n

    def primary(self):
        t, i = self.peek(), self.at
        if self.kinds[i] in LITERALS or t in ("true", "false", "null", "super", "this"):
            return self.take()
        if t == "(":
            return (yield self.parenthesized())
        if t == "new":
            return (yield self.creation())
        if t == "switch":
            return (yield self.switch())
        if t in PRIMITIVE or (self.is_name(i) and self.peek(1) in ("<", "[", ".")):
            after = self.scan_type(i)
            follows = self.texts[after : after + 2] if after > 0 else []
            special = t in PRIMITIVE or self.texts[after - 1] in (">", "]")
            if special and after > 0 and (follows[0] == "::" or follows == [".", "class"]):
                kind = yield self.type_()
                return node("class_literal", [kind, self.take(), self.take()]) if self.peek() == "." else kind
        name = self.name()
        if self.peek() == "(":
            return node("method_invocation", [as_role(name, "name"), (yield self.arguments())])
        return name

    def parenthesized(self, role: str | None = None):
        return node("parenthesized_expression", [self.expect("("), (yield self.expression()), self.expect(")")], role)

    def arguments(self):
        kids = [self.expect("(")]
        while self.peek() != ")":
            kids.append((yield self.expression()))
            if self.peek() != ")":
                kids.append(self.expect(","))
        return node("argument_list", [*kids, self.take()], "arguments")

    def creation(self):
        kids = [self.expect("new")]
        while self.peek() == "@":
            kids.append((yield self.annotation()))
        if self.peek() == "<":
            kids.append((yield self.type_arguments("type_arguments")))
        kids.append((yield self.type_("type", dims=False)))
        if self.peek() == "(":
            kids.append((yield self.arguments()))
            if self.peek() == "{":
                kids.append((yield self.class_body("class_body", None)))
            return node("object_creation_expression", kids)
        while self.peek() == "[" and self.peek(1) != "]":
            kids.append(node("dimensions_expr", [self.take(), (yield self.expression()), self.expect("]")], "dimensions"))
        if self.peek() == "[":
            kids.append(self.dimensions())
        if self.peek() == "{":
            kids.append(as_role((yield self.array_initializer()), "value"))
        if len(kids) < 3:
            raise Mismatch
        return node("array_creation_expression", kids)

    def array_initializer(self):
        kids = [self.expect("{")]
        while self.peek() != "}":
            kids.append((yield self.value()))
            if self.peek() != "}":
                kids.append(self.expect(","))
        return node("array_initializer", [*kids, self.take()])

    def value(self):
        return (yield (self.array_initializer() if self.peek() == "{" else self.expression()))

    def lambda_(self):
        if self.peek() != "(":
            given = self.name("parameters")
        elif self.is_name(self.at + 1) and self.peek(2) in (",", ")"):
            kids = [self.take()]
            while self.peek() != ")":
                kids.append(self.name())
                if self.peek() != ")":
                    kids.append(self.expect(","))
            given = node("inferred_parameters", [*kids, self.take()], "parameters")
        else:
            given = yield self.parameters()
        arrow = self.expect("->")
        return node("lambda_expression", [given, arrow, as_role((yield (self.block() if self.peek() == "{" else self.expression())), "body")])

    # Statements

    def recover(self, start: int, stop: str = "}") -> list:
        """An ERROR node of the tokens from start to a ;, after a block, or before what closes the scope."""
        self.at, kids = start, []
        while self.at < self.end:
            t = self.peek()
            if t == stop and kids:
                break
            last = self.shut.get(self.at)
            block = t == "{"
            kids.append(self.take())
            if last is not None:
                while self.at <= last:
                    kids.append(self.take())
                if block:
                    break
            elif t in (";", "}"):
                break
        return node("ERROR", kids)

    def guarded(self, rule):
        start = self.at
        try:
            n = yield rule()
            if self.at > start:
                return n
        except Mismatch:
            pass
        return self.recover(start)

    def block(self, kind: str = "block", role: str | None = None):
        kids = [self.expect("{")]
        while self.peek() != "}":
            if self.at >= self.end:
                return node(kind, kids, role)
            kids.append((yield self.guarded(self.statement)))
        return node(kind, [*kids, self.take()], role)

    def local_variables(self, marks=None):
        kids = [marks, (yield self.type_("type"))]
        kids += yield self.declarators()
        return node("local_variable_declaration", [*kids, self.expect(";")])

    def declarators(self):
        kids = []
        while True:
            own = [self.name("name")]
            if self.peek() == "[":
                own.append(self.dimensions())
            if self.peek() == "=":
                own += [self.take(), as_role((yield self.value()), "value")]
            kids.append(node("variable_declarator", own, "declarator"))
            if self.peek() != ",":
                return kids
            kids.append(self.take())

    def statement(self):
        t = self.peek()
        rule = self.RULES.get(t)
        if rule is not None and not (t == "synchronized" and self.peek(1) != "("):
            return (yield rule(self))
        if t == "{":
            return (yield self.block())
        if t == ";":
            return self.take()
        if t == "yield" and (self.is_name(self.at + 1) or self.kinds[self.at + 1] in LITERALS or self.peek(1) in ("new", "switch", "-", "!", "this", "true", "false", "null")):
            return node("yield_statement", [self.take("yield"), (yield self.expression()), self.expect(";")])
        if self.is_name(self.at) and self.peek(1) == ":" and t != "default":
            return node("labeled_statement", [self.name(), self.take(), (yield self.statement())])
        if t in ("this", "super") and self.peek(1) == "(":
            return node("explicit_constructor_invocation", [self.take(role="constructor"), (yield self.arguments()), self.expect(";")])
        marks = yield self.modifiers()
        if self.declares_type():
            return (yield self.type_declaration(marks))
        if marks is not None or self.is_declaration():
            return (yield self.local_variables(marks))
        return node("expression_statement", [(yield self.expression()), self.expect(";")])

    def if_(self):
        kids = [self.take(), (yield self.parenthesized("condition")), as_role((yield self.guarded(self.statement)), "consequence")]
        if self.peek() == "else":
            kids += [self.take(), as_role((yield self.guarded(self.statement)), "alternative")]
        return node("if_statement", kids)

    def while_(self):
        return node("while_statement", [self.take(), (yield self.parenthesized("condition")), as_role((yield self.guarded(self.statement)), "body")])

    def do_(self):
        return node("do_statement", [self.take(), as_role((yield self.guarded(self.statement)), "body"), self.expect("while"), (yield self.parenthesized("condition")), self.expect(";")])

    def for_(self):
        kids = [self.take(), self.expect("(")]
        marks = yield self.modifiers()
        i = self.scan_type(self.at)
        if i > 0 and self.is_name(i) and self.texts[i + 1] == ":":
            kids += [marks, (yield self.type_("type")), self.name("name"), self.take(), as_role((yield self.expression()), "value"), self.expect(")")]
            return node("enhanced_for_statement", [*kids, as_role((yield self.guarded(self.statement)), "body")])
        if marks is not None or self.is_declaration():
            kids.append(as_role((yield self.local_variables(marks)), "init"))
        else:
            kids += yield self.expressions(";", "init")
            kids.append(self.expect(";"))
        if self.peek() != ";":
            kids.append(as_role((yield self.expression()), "condition"))
        kids.append(self.expect(";"))
        kids += yield self.expressions(")", "update")
        return node("for_statement", [*kids, self.expect(")"), as_role((yield self.guarded(self.statement)), "body")])

    def expressions(self, stop: str, role: str):
        kids = []
        while self.peek() != stop:
            kids.append(as_role((yield self.expression()), role))
            if self.peek() != stop:
                kids.append(self.expect(","))
        return kids

    def switch(self):
        kids = [self.take(), (yield self.parenthesized("condition"))]
        body = [self.expect("{")]
        while self.peek() != "}":
            if self.peek() not in ("case", "default"):
                if self.at >= self.end:
                    break
                body.append(self.recover(self.at))
                continue
            label = yield self.switch_label()
            if self.peek() == "->":
                rule = [label, self.take()]
                if self.peek() in ("{", "throw"):
                    rule.append((yield self.guarded(self.statement)))
                else:
                    rule.append(node("expression_statement", [(yield self.expression()), self.expect(";")]))
                body.append(node("switch_rule", rule))
                continue
            group = [label, self.expect(":")]
            while self.peek() in ("case", "default"):
                group += [(yield self.switch_label()), self.expect(":")]
            while self.peek() not in ("case", "default", "}") and self.at < self.end:
                group.append((yield self.guarded(self.statement)))
            body.append(node("switch_block_statement_group", group))
        if self.peek() == "}":
            body.append(self.take())
        return node("switch_expression", [*kids, node("switch_block", body, "body")])

    def switch_label(self):
        kids = [self.take()]
        while self.peek() not in (":", "->") and self.at < self.end:
            i = self.scan_type(self.at)
            if self.peek() == "default":
                kids.append(self.take())
            elif self.peek() == "when":
                kids.append(node("guard", [self.take("when"), (yield self.ternary())]))
            elif i > 0 and self.is_name(i) and self.texts[i] != "when":
                kids.append(node("pattern", [node("type_pattern", [(yield self.type_()), self.name()])]))
            elif i > 0 and self.texts[i] == "(" and kids[0][0] == "case":
                kids.append(node("pattern", [node("record_pattern", [(yield self.type_()), (yield self.pattern_body())])]))
            else:
                kids.append((yield self.ternary()))
            if self.peek() == ",":
                kids.append(self.take())
        return node("switch_label", kids)

    def try_(self):
        kids, kind = [self.take()], "try_statement"
        if self.peek() == "(":
            kind, given = "try_with_resources_statement", [self.take()]
            while self.peek() != ")":
                marks = yield self.modifiers()
                if marks is not None or self.is_declaration():
                    own = [marks, (yield self.type_("type")), self.name("name"), self.expect("="), as_role((yield self.expression()), "value")]
                else:
                    own = [(yield self.expression())]
                given.append(node("resource", own))
                if self.peek() == ";":
                    given.append(self.take())
                elif self.peek() != ")":
                    raise Mismatch
            kids.append(node("resource_specification", [*given, self.take()], "resources"))
        kids.append((yield self.block(role="body")))
        while self.peek() == "catch":
            own = [self.take(), self.expect("(")]
            marks = yield self.modifiers()
            caught = [(yield self.type_())]
            while self.peek() == "|":
                caught += [self.take(), (yield self.type_())]
            own.append(node("catch_formal_parameter", [marks, node("catch_type", caught), self.name("name")]))
            kids.append(node("catch_clause", [*own, self.expect(")"), (yield self.block(role="body"))]))
        if self.peek() == "finally":
            kids.append(node("finally_clause", [self.take(), (yield self.block())]))
        return node(kind, kids)

    def return_(self):
        kind = self.peek() + "_statement"
        kids = [self.take()]
        if self.peek() != ";":
            kids.append((yield self.expression()))
        return node(kind, [*kids, self.expect(";")])

    def jump(self):
        kind = self.peek() + "_statement"
        kids = [self.take(), self.name() if self.is_name(self.at) else None]
        return node(kind, [*kids, self.expect(";")])
        yield  # a rule like the others

    def assert_(self):
        kids = [self.take(), (yield self.expression())]
        if self.peek() == ":":
            kids += [self.take(), (yield self.expression())]
        return node("assert_statement", [*kids, self.expect(";")])

    def synchronized(self):
        return node("synchronized_statement", [self.take(), (yield self.parenthesized()), (yield self.block(role="body"))])

    RULES = {"if": if_, "while": while_, "do": do_, "for": for_, "switch": switch, "try": try_, "return": return_, "throw": return_, "break": jump, "continue": jump, "assert": assert_, "synchronized": synchronized}

    # Declarations

    def declares_type(self) -> bool:
        t = self.peek()
        if t == "@":
            return self.peek(1) == "interface"
        if t == "record":
            return self.is_name(self.at + 1) and self.peek(2) in ("(", "<")
        return t in TYPES

    def type_declaration(self, marks):
        if self.peek() == "@":
            kids = [marks, self.take("@interface", joined=2), self.name("name")]
            return node("annotation_type_declaration", [*kids, (yield self.class_body("annotation_type_body"))])
        word = self.peek()
        kids = [marks, self.take(word), self.name("name")]
        if self.peek() == "<":
            kids.append((yield self.type_parameters()))
        if word == "record":
            kids.append((yield self.parameters()))
        while self.peek() in ("extends", "implements", "permits"):
            clause = self.peek()
            sign = self.take(clause)
            if clause == "extends" and word == "class":
                kids.append(node("superclass", [sign, (yield self.type_())], "superclass"))
            else:
                kind, role = {"implements": ("super_interfaces", "interfaces"), "permits": ("permits", "permits")}.get(clause, ("extends_interfaces", None))
                kids.append(node(kind, [sign, (yield self.types())], role))
        if word == "enum":
            return node(TYPES[word], [*kids, (yield self.enum_body())])
        return node(TYPES[word], [*kids, (yield self.class_body("interface_body" if word == "interface" else "class_body"))])

    def enum_body(self):
        kids = [self.expect("{")]
        while self.is_name(self.at) or self.peek() == "@":
            own = [(yield self.modifiers()), self.name("name")]
            if self.peek() == "(":
                own.append((yield self.arguments()))
            if self.peek() == "{":
                own.append((yield self.class_body("class_body")))
            kids.append(node("enum_constant", own))
            if self.peek() == ",":
                kids.append(self.take())
        if self.peek() == ";":
            more = [self.take()]
            while self.peek() != "}" and self.at < self.end:
                more.append((yield self.guarded(self.member)))
            kids.append(node("enum_body_declarations", more))
        return node("enum_body", [*kids, self.expect("}")], "body")

    def class_body(self, kind: str, role: str | None = "body"):
        kids = [self.expect("{")]
        while self.peek() != "}":
            if self.at >= self.end:
                return node(kind, kids, role)
            kids.append((yield self.guarded(self.member)))
        return node(kind, [*kids, self.take()], role)

    def parameters(self):
        kids = [self.expect("(")]
        while self.peek() != ")":
            own = [(yield self.modifiers()), (yield self.type_("type"))]
            if self.peek() == "...":
                kids.append(node("spread_parameter", [*own, self.take(), node("variable_declarator", [self.name("name")])]))
            elif self.peek() == "this":
                kids.append(node("receiver_parameter", [*own, self.take()]))
            else:
                own.append(self.name("name"))
                if self.peek() == "[":
                    own.append(self.dimensions())
                kids.append(node("formal_parameter", own))
            if self.peek() != ")":
                kids.append(self.expect(","))
        return node("formal_parameters", [*kids, self.take()], "parameters")

    def member(self):
        if self.peek() == ";":
            return self.take()
        if self.peek() == "{":
            return (yield self.block())
        if self.peek() == "static" and self.peek(1) == "{":
            return node("static_initializer", [self.take(), (yield self.block())])
        marks = yield self.modifiers()
        if self.declares_type():
            return (yield self.type_declaration(marks))
        kids = [marks]
        if self.peek() == "<":
            kids.append((yield self.type_parameters()))
        if self.is_name(self.at) and self.peek(1) == "{":
            return node("compact_constructor_declaration", [*kids, self.name("name"), (yield self.block(role="body"))])
        if self.is_name(self.at) and self.peek(1) == "(":
            kids += [self.name("name"), (yield self.parameters())]
            kids.append((yield self.throws()))
            return node("constructor_declaration", [*kids, (yield self.block("constructor_body", "body"))])
        kids.append((yield self.type_("type")))
        if self.is_name(self.at) and self.peek(1) == "(":
            kids += [self.name("name"), (yield self.parameters())]
            if self.peek() == "[":
                kids.append(self.dimensions())
            kids.append((yield self.throws()))
            if self.peek() == "default":
                kids += [self.take(), as_role((yield self.element_value()), "value")]
            kids.append((yield self.block(role="body")) if self.peek() == "{" else self.expect(";"))
            return node("method_declaration", kids)
        kids += yield self.declarators()
        return node("field_declaration", [*kids, self.expect(";")])

    def throws(self):
        if self.peek() != "throws":
            return None
        return node("throws", [self.take(), *(yield self.types())[2]])

    def top(self):
        if self.peek() == ";":
            return self.take()
        if self.peek() == "import":
            kids = [self.take(), self.take() if self.peek() == "static" else None, self.dotted()]
            if self.peek() == ".":
                kids += [self.take(), self.take("asterisk")]
            return node("import_declaration", [*kids, self.expect(";")])
        marks = yield self.modifiers()
        if self.peek() == "package":
            return node("package_declaration", [marks, self.take(), self.dotted(), self.expect(";")])
        if self.declares_type():
            return (yield self.type_declaration(marks))
        # Snippets without a class: members and statements.
        self.at = marks[3] if marks is not None else self.at
        start = self.at
        try:
            return (yield self.statement())
        except Mismatch:
            self.at = start
            return (yield self.member())

    def program(self):
        kids = []
        while self.at < self.end:
            kids.append((yield self.guarded(self.top)))
        return kids


def java(text: str) -> Iterator[tuple]:
    """Nodes in pre-order as (depth, type, label, role, start, end); leaves reprint the text."""
    p = Parser(text)
    yield 0, "program", None, None, 0, len(text)
    done = 0  # tokens, trivia included, that are out

    def trivia(upto, depth):
        nonlocal done
        while done < upto:
            group, t, a, b = p.all[done]
            done += 1
            yield depth, group, t, None, a, b

    stack = [(k, 1) for k in reversed(trampoline(p.program()))]
    while stack:
        (kind, role, kids, first, last), depth = stack.pop()
        yield from trivia(p.code[first], depth)
        a, b = p.all[p.code[first]][2], p.all[p.code[last]][3]
        if kids is None:
            yield depth, kind, text[a:b], role, a, b
            done = p.code[last] + 1
        else:
            yield depth, kind, None, role, a, b
            stack += [(k, depth + 1) for k in reversed(kids)]
    yield from trivia(len(p.all), 1)
