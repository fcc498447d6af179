"""Front-ends: text -> tree. Each yields nodes in pre-order as (depth, type, label, role, start, end).

Offsets are code points. `start`/`end` delimit the node's text; leaves carry it as label.
Malformed input never raises: what can't be parsed becomes text.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from sylvan.sources.java import java, trampoline

Node = tuple[int, str, str | None, str | None, int, int]

#: Elements that never have content: fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Html(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.bare = False  # whether the last text ends with a reference that lacks its semicolon
        self.text, self.open, self.tags, self.nodes = text, [], Counter(), [["document", None, None, 0, len(text), 0]]
        self.feed(text)
        self.close()

    def at(self) -> int:
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def leaf(self, kind, label, start, end):
        self.nodes.append([kind, label, None, start, end, len(self.open) + 1])

    def handle_starttag(self, tag, attrs):
        start, raw = self.at(), self.get_starttag_text() or ""
        self.nodes.append([tag, None, None, start, len(self.text), len(self.open) + 1])
        self.open.append((tag, len(self.nodes) - 1))
        self.tags[tag] += 1
        for name, value in attrs:
            self.nodes.append(["attribute", f"{name}={value or ''}", name, start, start + len(raw), len(self.open) + 1])
        if tag in VOID:
            self.shut()[4] = start + len(raw)

    def shut(self) -> list:
        """The innermost open element's node; no longer open."""
        tag, i = self.open.pop()
        self.tags[tag] -= 1
        return self.nodes[i]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1][0] == tag:
            self.shut()[4] = self.at() + len(self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        if self.tags[tag]:
            while self.open:
                same = self.open[-1][0] == tag
                self.shut()[4] = self.at() + (len(tag) + 3 if same else 0)
                if same:
                    break

    def handle_data(self, data, bare=False):
        start, before = self.at(), self.nodes[-1]
        if (bare or self.bare or data[:1] == "&") and before[0] in ("text", "spaces") and before[4] == start and before[5] == len(self.open) + 1:
            before[1], before[4] = before[1] + data, start + len(data)
            before[0] = "text" if before[1].strip() else "spaces"
        else:
            self.leaf("text" if data.strip() else "spaces", data, start, start + len(data))
        self.bare = bare

    def handle_comment(self, data):
        self.leaf("comment", data, self.at(), self.at() + len(data) + 7)

    def handle_decl(self, decl):
        self.leaf("doctype", decl, self.at(), self.at() + len(decl) + 3)

    def handle_entityref(self, name, mark="&"):
        """A reference ends with a semicolon; without one it is part of the text around it."""
        start = self.at()
        end = start + len(mark) + len(name)
        if self.text[end : end + 1] == ";":
            self.leaf("entity", name, start, end + 1)
        else:
            self.handle_data(mark + name, bare=True)

    def handle_charref(self, name):
        self.handle_entityref(name, "&#")


def html(text: str) -> Iterator[Node]:
    """Elements, attributes, text, comments; unclosed elements end with their parent."""
    for kind, label, role, start, end, depth in _Html(text).nodes:
        yield depth, kind, label, role, start, min(end, len(text))


_JSON = re.compile(r"""(?P<space>[ \t\n\r]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<word>true|false|null)\b|(?P<mark>[\[\]{},:])""")


def json_tree(text: str) -> Iterator[Node]:
    """object / pair / array / string / number / true / false / null; invalid JSON is one ERROR leaf.

    A pair carries its key as label, a number its text. Nesting is bounded by memory only.
    """
    try:
        yield from map(tuple, _json_nodes(text))
    except ValueError:
        yield 0, "ERROR", text, None, 0, len(text)


def _json_nodes(text: str) -> list[list]:
    out, open_, at, wants = [], [], 0, "value"  # wants: value, first (value or ]), key, name (key or }), colon, next
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            raise ValueError(at)
        kind, t, start, at = m.lastgroup, m[0], m.start(), m.end()
        if kind == "space":
            continue
        depth, in_pair = len(open_), bool(open_) and out[open_[-1]][1] == "pair"
        if wants in ("value", "first") and (kind in ("string", "number", "word") or t in ("{", "[")):
            role = "value" if in_pair else None
            if kind == "mark":
                out.append([depth, "object" if t == "{" else "array", None, role, start, at])
                open_.append(len(out) - 1)
                wants = "name" if t == "{" else "first"
                continue
            label = json.loads(t) if kind == "string" else (t if kind == "number" else None)
            out.append([depth, t if kind == "word" else kind, label, role, start, at])
        elif kind == "string" and wants in ("key", "name"):
            out.append([depth, "pair", json.loads(t), None, start, at])
            open_.append(len(out) - 1)
            wants = "colon"
            continue
        elif t == ":" and wants == "colon":
            wants = "value"
            continue
        elif t == "," and wants == "next" and open_:
            wants = "key" if out[open_[-1]][1] == "object" else "value"
            continue
        elif t in ("}", "]") and open_ and wants in ("next", "name" if t == "}" else "first") and out[open_[-1]][1] == ("object" if t == "}" else "array"):
            out[open_.pop()][5] = at
        else:
            raise ValueError(start)
        if open_ and out[open_[-1]][1] == "pair":
            out[open_.pop()][5] = at
        wants = "next"
    if open_ or not out:
        raise ValueError(at)
    return out


_SEXP = re.compile(r"""\s+|[()]|"(?:[^"\\]|\\.)*"|[^\s()"]+""")


def sexp(text: str) -> Iterator[Node]:
    """(type "label" role: (child) ...): nested lists as typed nodes."""
    depth, role, wants_type = 0, None, False
    pending: list | None = None
    for m in _SEXP.finditer(text):
        t = m[0]
        if t.isspace():
            continue
        if t == "(":
            if pending:
                yield tuple(pending)
            pending, wants_type = None, True
        elif t == ")":
            if pending:
                yield tuple(pending)
                pending = None
            depth -= 1
        elif wants_type:
            pending, wants_type = [depth, t, None, role, m.start(), m.end()], False
            depth, role = depth + 1, None
        elif t.startswith('"') and pending:
            pending[2] = json.loads(t)
        elif t.endswith(":"):
            if pending:
                yield tuple(pending)
                pending = None
            role = t[:-1]
    if pending:
        yield tuple(pending)


_TOKENS = re.compile(
    r"""(?P<spaces>\s+)|(?P<line_comment>//[^\n]*)|(?P<block_comment>/\*.*?\*/)|(?P<string_literal>"(?:[^"\\\n]|\\.)*")|(?P<character_literal>'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<punct>.)""",
    re.S,
)
_C = re.compile(r"(?P<preprocessor>^[ \t]*\#(?:[^\n\\]|\\.)*)|" + _TOKENS.pattern, re.S | re.M)
#: Words of bracket languages with a role in the coarse grammar below: fixed values.
_TYPES = {
    "cpp": frozenset(("class", "struct", "enum", "union", "namespace")),
    "c": frozenset(("struct", "enum", "union")),
    "ts": frozenset(("class", "interface", "enum", "namespace", "function")),
}
_IMPORTS = {"cpp": ("using",), "c": (), "ts": ("import", "export")}
_PLAIN = frozenset("public private protected static final new import package void int boolean char long double float const using typedef let var async".split())
_CONTROL = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_expression", "try": "try_statement", "catch": "catch_clause", "case": "switch_label", "else": "else", "return": "return_statement", "throw": "throw_statement"}
_BRACKETS = {"{": ("block", "}"), "(": ("parenthesized", ")"), "[": ("brackets", "]")}


def brackets(text: str, lang: str) -> Iterator[Node]:
    """A coarse front-end: brackets nest, statements split at ; and blocks, tokens are leaves.

    Declarations are recognised by shape (class X {, name(...) {), so metrics and patterns on
    declarations, control flow, identifiers, literals, comments and white space work without
    a full grammar. Every character is in exactly one leaf, so leaves reprint the source.
    """
    types, imports = _TYPES[lang], _IMPORTS[lang]
    leaves = [(m.lastgroup, m[0], m.start(), m.end()) for m in (_C if lang in ("c", "cpp") else _TOKENS).finditer(text)]
    out: list[list] = []
    closed, waiting = {}, []  # ( -> its )
    for k, (group, t, *_) in enumerate(leaves):
        if group == "punct" and t in "([{":
            waiting.append(k)
        elif group == "punct" and t in ")]}" and waiting:
            closed[waiting.pop()] = k

    def emit(depth, kind, label, role, start, end):
        out.append([depth, kind, label, role, start, end])
        return out[-1]

    def leaf(i, depth, role=None):
        group, t, s, e = leaves[i]
        kind = {"word": "identifier", "punct": t, "number": "decimal_integer_literal"}.get(group, group)
        if group == "word" and (t in _CONTROL or t in types or t in _PLAIN):
            kind = t
        emit(depth, kind, t, role, s, e)

    def kind_of(i, end):
        """Type of the statement that begins at leaf i, by its words up to { or ;."""
        words, j = [], i
        while j < end:
            group, t = leaves[j][:2]
            if group == "punct" and t in "{;}":
                break
            if group not in ("spaces", "line_comment", "block_comment"):
                words.append(t)
            if group == "punct" and t in "([":
                if j not in closed:
                    break
                j = closed[j]
                words.append(leaves[j][1])
            j += 1
        if not words:
            return "statement"
        if words[0] in _CONTROL:
            return _CONTROL[words[0]]
        if words[0] in imports:
            return words[0] + "_declaration"
        if any(w in types for w in words):
            return next(w for w in words if w in types) + "_declaration"
        if "(" in words and j < end and leaves[j][1] == "{" and "=" not in words and words[-1] != "new":
            return "method_declaration"
        if "=" in words or (len(words) == 2 and j < end):
            return "variable_declaration"
        return "expression_statement"

    def sequence(i, depth, closer):
        """Statements up to closer; returns the place after it."""
        while i < len(leaves) and leaves[i][1] != closer:
            if leaves[i][0] in ("spaces", "line_comment", "block_comment", "preprocessor"):
                leaf(i, depth)
                i += 1
                continue
            kind = kind_of(i, len(leaves))
            node = emit(depth, kind, None, None, leaves[i][2], 0)
            named = None
            if kind.endswith("_declaration") and kind != "variable_declaration":
                named = next((j + 1 for j in range(i, len(leaves)) if leaves[j][1] in types), None) if kind != "method_declaration" else None
            while i < len(leaves) and leaves[i][1] != closer:
                group, t = leaves[i][:2]
                if group == "punct" and t in _BRACKETS:
                    inner, shut = _BRACKETS[t]
                    sub = emit(depth + 1, inner, None, "body" if t == "{" else None, leaves[i][2], 0)
                    leaf(i, depth + 2)
                    i = yield (sequence if t == "{" else tokens)(i + 1, depth + 2, shut)
                    if i < len(leaves):
                        leaf(i, depth + 2)
                        i += 1
                    sub[5] = leaves[min(i, len(leaves)) - 1][3]
                    if t == "{":
                        break
                    continue
                role = None
                if group == "word":
                    after = next((leaves[k][1] for k in range(i + 1, len(leaves)) if leaves[k][0] != "spaces"), "")
                    if (kind == "method_declaration" and after == "(") or (named is not None and i > named - 1 and t not in types):
                        role, named = "name", None
                leaf(i, depth + 1, role)
                i += 1
                if group == "punct" and t == ";":
                    break
            node[5] = leaves[i - 1][3]
        return i

    def tokens(i, depth, closer):
        while i < len(leaves) and leaves[i][1] != closer:
            if leaves[i][0] == "punct" and leaves[i][1] in _BRACKETS:
                inner, shut = _BRACKETS[leaves[i][1]]
                sub = emit(depth, inner, None, None, leaves[i][2], 0)
                leaf(i, depth + 1)
                i = yield (sequence if leaves[i][1] == "{" else tokens)(i + 1, depth + 1, shut)
                if i < len(leaves):
                    leaf(i, depth + 1)
                    i += 1
                sub[5] = leaves[min(i, len(leaves)) - 1][3]
            else:
                leaf(i, depth)
                i += 1
        return i

    emit(0, "program", None, None, 0, len(text))
    i = 0
    while i < len(leaves):
        i = trampoline(sequence(i, 1, None))
    yield from map(tuple, out)


def cpp(text: str) -> Iterator[Node]:
    """C++ by the coarse front-end; preprocessor lines are leaves."""
    return brackets(text, "cpp")


def c(text: str) -> Iterator[Node]:
    """C by the coarse front-end."""
    return brackets(text, "c")


def typescript(text: str) -> Iterator[Node]:
    """TypeScript by the coarse front-end."""
    return brackets(text, "ts")


_XML = re.compile(r"""<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<pi>.*?)\?>|<!(?P<decl>[^>]*)>|</(?P<end>[^\s>]+)\s*>|<(?P<tag>[^\s/>!?]+)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*?)(?P<self>/?)>|(?P<text>[^<]+|<)""", re.S)
_ATTR = re.compile(r"""([^\s=]+)\s*=\s*("[^"]*"|'[^']*')""")


def xml(text: str) -> Iterator[Node]:
    """Elements with a name child, attributes, text, comments; stray end tags are ERROR leaves."""
    nodes, open_, tags = [[0, "document", None, None, 0, len(text)]], [], Counter()
    for m in _XML.finditer(text):
        kind, depth, (a, b) = m.lastgroup, len(open_) + 1, m.span()
        if m["tag"] is not None:
            nodes.append([depth, "element", None, None, a, b])
            nodes.append([depth + 1, "tag_name", m["tag"], "name", a + 1, a + 1 + len(m["tag"])])
            for attr in _ATTR.finditer(m["attrs"]):
                nodes.append([depth + 1, "attribute", attr[2][1:-1], attr[1], m.start("attrs") + attr.start(), m.start("attrs") + attr.end()])
            if not m["self"]:
                tags[m["tag"]] += 1
                open_.append((m["tag"], len(nodes) - 2 - sum(1 for _ in _ATTR.finditer(m["attrs"]))))
        elif m["end"] is not None:
            if tags[m["end"]]:
                while True:
                    tag, i = open_.pop()
                    tags[tag] -= 1
                    nodes[i][5] = b
                    if tag == m["end"]:
                        break
            else:
                nodes.append([depth, "ERROR", m[0], None, a, b])
        else:
            name = {"pi": "instruction", "decl": "doctype"}.get(kind, kind)
            nodes.append([depth, "spaces" if kind == "text" and not m[0].strip() else name, m[kind], None, a, b])
    yield from map(tuple, nodes)


_MAKE = re.compile(r"(?P<comment>\#[^\n]*\n?)|(?P<rule>^[^\s#:=][^:=\n]*:(?![=])[^\n]*\n?(?:\t[^\n]*\n?)*)|(?P<assignment>^[^\s#:=][^:=\n]*[:?+]?=[^\n]*\n?)|(?P<spaces>\s+)|(?P<other>[^\n]*\n?)", re.M)


def makefile(text: str) -> Iterator[Node]:
    """Rules with target, prerequisites and recipe lines; assignments; comments."""
    yield 0, "makefile", None, None, 0, len(text)
    for m in _MAKE.finditer(text):
        if not m[0]:
            continue
        a, b = m.span()
        if m.lastgroup != "rule":
            yield 1, m.lastgroup, m[0], None, a, b
            continue
        yield 1, "rule", None, None, a, b
        head, _, recipe = m[0].partition("\n")
        target, _, needs = head.partition(":")
        for t in target.split():
            yield 2, "target", t, "name", a, a + len(target)
        for n in needs.split():
            yield 2, "prerequisite", n, None, a + len(target) + 1, a + len(head)
        for line in recipe.splitlines():
            yield 2, "recipe", line.strip(), None, a + len(head), b


_RUNS = re.compile(r"\s+|\S+")


def lines(text: str) -> Iterator[Node]:
    """document / line / (word | spaces): a tree for plain text that reprints it."""
    yield 0, "document", None, None, 0, len(text)
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        yield 1, "line", None, None, at, min(end + 1, len(text))
        runs = _RUNS.findall(line)
        kinds = ("spaces", "word") if line[:1].isspace() else ("word", "spaces")  # runs of both take turns
        for i, run in enumerate(runs):
            yield 2, kinds[i & 1], run, None, at, (at := at + len(run))
        if end < len(text):
            yield 2, "spaces", "\n", None, end, end + 1
        at = end + 1


FRONT_ENDS = {"html": html, "xml": xml, "json": json_tree, "sexp": sexp, "java": java, "cpp": cpp, "c": c, "ts": typescript, "make": makefile, "text": lines}
#: File name suffix -> front-end.
SUFFIXES = {".java": "java", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".h": "c", ".c": "c", ".ts": "ts", ".xml": "xml", ".html": "html", ".json": "json", "Makefile": "make", ".mk": "make"}
