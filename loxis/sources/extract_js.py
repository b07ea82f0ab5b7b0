"""Facts of JavaScript and TypeScript sources, by a parser of its own.

The parser makes a tree of statements and expressions; one walk over it writes the facts, with ids, places and the
scope that a name is declared in. Types are read over and told as text. What the parser doesn't know is skipped up
to the end of its statement; JSX is not known. Of a member access the name of the member is an expression too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from .extract import Facts, entity, extractor

#: The tables, and the kinds of statements, expressions, scopes and comments.
SCHEME = """
locations_default(unique int id: @location_default, int file: @file ref, int beginLine: int ref, int beginColumn: int ref, int endLine: int ref, int endColumn: int ref);
hasLocation(int locatableid: @locatable ref, int id: @location_default ref);
toplevels(unique int id: @toplevel, int kind: int ref);
stmts(unique int id: @stmt, int kind: int ref, int parent: @stmtparent ref, int idx: int ref);
exprs(unique int id: @expr, int kind: int ref, int parent: @exprparent ref, int idx: int ref);
literals(string value: string ref, int parent: @expr ref);
properties(unique int id: @property, int parent: @propertyparent ref, int idx: int ref, int kind: int ref);
variables(unique int id: @variable, string name: string ref, int scope: @scope ref);
scopes(unique int id: @scope, int kind: int ref);
functions(unique int id: @function, string name: string ref, int parent: @element ref);
classes(unique int id: @class, string name: string ref, int parent: @element ref);
imports(unique int id: @import, int parent: @element ref, string name: string ref, string path: string ref);
exports(unique int id: @export, int parent: @element ref);
comments(unique int id: @comment, int kind: int ref, int parent: @element ref, string text: string ref);
type_annotations(unique int id: @type_annotation, int parent: @element ref, string text: string ref);
interfaces(unique int id: @interface, string name: string ref, int parent: @element ref);
enums(unique int id: @enum, string name: string ref, int parent: @element ref);
type_aliases(unique int id: @type_alias, string name: string ref, int parent: @element ref);
decorators(unique int id: @decorator, string name: string ref, int parent: @element ref);
@stmtparent = @stmt | @toplevel | @function;
@exprparent = @expr | @stmt | @property | @toplevel | @function;
@propertyparent = @expr | @class | @interface;
@element = @file | @toplevel | @stmt | @expr | @property | @function | @class | @interface | @enum | @type_alias | @variable | @scope | @import | @export | @comment | @type_annotation | @decorator;
@locatable = @element | @location_default;
"""
EMPTY, BLOCK, EXPR, IF, LABELED, BREAK, CONTINUE, WITH, SWITCH, RETURN, THROW, TRY, WHILE, DO, FOR, FOR_IN, DEBUGGER, FUNCTION = range(18)
VAR, CASE, CATCH, FOR_OF, CONST, LET, CLASS, IMPORT, EXPORT_ALL, EXPORT_DEFAULT, EXPORT_NAMED, INTERFACE, ALIAS, ENUM = 18, 19, 20, 21, 22, 23, 26, 27, 28, 29, 30, 34, 35, 36
LABEL, NULL, BOOLEAN, NUMBER, STRING, REGEX, THIS, ARRAY, OBJECT, FUNCTION_EXPR, SEQUENCE, TERNARY, NEW, CALL, MEMBER, SUBSCRIPT = range(16)
DECLARATOR, ARROW, SPREAD, ARRAY_PATTERN, OBJECT_PATTERN, YIELD, TAGGED, TEMPLATE, ELEMENT, NAME, ACCESS, CLASS_EXPR, SUPER, AWAIT = 64, 65, 66, 67, 68, 69, 70, 71, 72, 78, 79, 80, 81, 92
UNARY = {"-": 16, "+": 17, "!": 18, "~": 19, "typeof": 20, "void": 21, "delete": 22}
BINARY = {"==": 23, "!=": 24, "===": 25, "!==": 26, "<": 27, "<=": 28, ">": 29, ">=": 30, "<<": 31, ">>": 32, ">>>": 33, "+": 34, "-": 35, "*": 36, "/": 37, "%": 38, "|": 39, "^": 40, "&": 41, "in": 42, "instanceof": 43, "&&": 44, "||": 45, "**": 87, "??": 107}
ASSIGN = {"=": 47, "+=": 48, "-=": 49, "*=": 50, "/=": 51, "%=": 52, "<<=": 53, ">>=": 54, ">>>=": 55, "|=": 56, "^=": 57, "&=": 58, "**=": 88}
UPDATE = {("++", True): 59, ("++", False): 60, ("--", True): 61, ("--", False): 62}
GLOBAL, FUNCTION_SCOPE, MODULE, BLOCK_SCOPE, CLASS_SCOPE = 0, 1, 3, 4, 8
VALUE, GETTER, SETTER = 0, 1, 2
#: Operators by precedence, the loosest first.
LEVELS = (("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "in", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"))
_TOKEN = re.compile(
    r"(?P<blank>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<number>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)n?)|(?P<name>[A-Za-z_$#][\w$]*)"
    r"|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    fresh: bool  # the first on its line


@dataclass
class Tree:
    """A statement or expression; kids by index; each hook gets its id and scope when the facts are written."""

    what: str
    kind: int
    begin: int
    end: int
    kids: list[tuple[int, Tree]] = field(default_factory=list)
    value: str | None = None
    hooks: list[Callable[[int, int], None]] = field(default_factory=list)
    block: bool = False
    pairs: list[Tree] = field(default_factory=list)  # of an object, its values


class _Unit:
    def __init__(self, path: str, text: str):
        self.path, self.file, self.text, self.typed = path, entity("file", path), text, path.endswith((".ts", ".tsx", ".mts", ".cts"))
        self.out: list[tuple[str, tuple]] = []
        self.serial: Counter[str] = Counter()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.top = entity(path, "js", "toplevel")
        self.tokens, self.at = self.scan(0, len(text))[0], 0

    # Tokens

    def scan(self, at: int, stop: int, inside: bool = False) -> tuple[list[Token], int]:
        """Tokens from a place on; inside a template, up to the brace that closes its substitution."""
        out, fresh, depth = [], True, 0
        while at < stop:
            before = out[-1] if out else None
            value = before is None or before.kind == "sign" and before.text not in (")", "]", "}") or before.text in _BEFORE_VALUE
            if self.text[at] == "`":
                end = self.template(at, stop)
                out.append(Token("template", self.text[at:end], at, fresh))
            elif value and self.text[at] == "/" and self.text[at + 1 : at + 2] not in ("/", "*") and (m := _REGEX.match(self.text, at)):
                end = m.end()
                out.append(Token("regex", m[0], at, fresh))
            else:
                m = _TOKEN.match(self.text, at)
                if m is None:
                    raise SyntaxError(f"unexpected {self.text[at]!r}")
                end = m.end()
                if m.lastgroup in ("blank", "comment"):
                    if m.lastgroup == "comment" and not inside:
                        self.comment(m)
                    fresh |= "\n" in m[0]
                    at = end
                    continue
                if inside and m[0] in "{}":
                    depth += 1 if m[0] == "{" else -1
                    if depth < 0:
                        break
                out.append(Token(m.lastgroup, m[0], at, fresh))
            fresh, at = False, end
        return [*out, Token("end", "", at, True)], at

    def template(self, at: int, stop: int) -> int:
        at += 1
        while at < stop and self.text[at] != "`":
            if self.text[at] == "\\":
                at += 1
            elif self.text.startswith("${", at):
                at = self.scan(at + 2, stop, inside=True)[1]
            at += 1
        return at + 1

    def comment(self, m: re.Match) -> None:
        own = self.new("comment")
        self.add("comments", own, int(m[0].startswith("/*")), self.top, m[0])
        self.place(own, m.start(), m.end())

    def peek(self, k: int = 0) -> str:
        t = self.tokens[min(self.at + k, len(self.tokens) - 1)]
        return t.text if t.kind in ("sign", "name") else ""

    def kind(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)].kind

    def take(self, want: str | None = None) -> str:
        t = self.tokens[self.at]
        if t.kind == "end" or want is not None and self.peek() != want:
            raise SyntaxError(f"expected {want}, found {t.text or 'the end'}")
        self.at += 1
        return t.text

    def skip(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.kind() != "name":
            raise SyntaxError(f"expected a name, found {self.tokens[self.at].text or 'the end'}")
        return self.take()

    def matching(self, k: int = 0) -> int:
        """Where the bracket that opens at k has closed."""
        depth = 0
        while self.kind(k) != "end":
            depth += (self.peek(k) in ("(", "[", "{")) - (self.peek(k) in (")", "]", "}"))
            k += 1
            if depth == 0:
                return k
        return k

    # Facts

    def new(self, kind: str) -> int:
        self.serial[kind] += 1
        return entity(self.path, "js", kind, self.serial[kind])

    def add(self, relation: str, *cells: object) -> None:
        self.out.append((relation, cells))

    def point(self, at: int) -> tuple[int, int]:
        low, high = 0, len(self.lines)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.lines[middle] <= at else (low, middle)
        return low + 1, at - self.lines[low] + 1

    def place(self, own: int, begin: int, end: int) -> None:
        (a, b), (c, d) = self.point(begin), self.point(max(begin, end - 1))
        where = entity(self.path, "location", a, b, c, d)
        self.add("locations_default", where, self.file, a, b, c, d)
        self.add("hasLocation", own, where)

    def located(self, own: int, begin: int, end: int) -> None:
        """By numbers of tokens."""
        last = self.tokens[max(begin, end - 1)]
        self.place(own, self.tokens[begin].at, last.at + len(last.text))

    def write(self, tree: Tree, parent: int, index: int, scope: int) -> None:
        own = self.new(tree.what)
        self.add("stmts" if tree.what == "stmt" else "exprs", own, tree.kind, parent, index)
        self.located(own, tree.begin, tree.end)
        if tree.value is not None:
            self.add("literals", tree.value, own)
        if tree.block:
            scope = self.scope(BLOCK_SCOPE)
        for hook in tree.hooks:
            hook(own, scope)
        for k, kid in tree.kids:
            self.write(kid, own, k, scope)

    def scope(self, kind: int) -> int:
        own = self.new("scope")
        self.add("scopes", own, kind)
        return own

    def variable(self, name: str, scope: int) -> None:
        self.add("variables", self.new("variable"), name, scope)

    def facts(self) -> Facts:
        module = any(t.kind == "name" and t.text in ("import", "export") and t.fresh for t in self.tokens)
        trees = []
        while self.kind() != "end":
            self.statement_or_skip(trees)
        self.add("toplevels", self.top, int(module))
        scope = self.scope(MODULE if module else GLOBAL)
        for k, tree in enumerate(trees):
            self.write(tree, self.top, k, scope)
        return iter(self.out)

    # Statements

    def statement_or_skip(self, into: list[Tree]) -> None:
        before = self.at
        try:
            into.append(self.statement())
        except SyntaxError:
            self.at = before
            while self.kind() != "end" and self.peek() not in (";", "}"):
                k = self.matching() if self.peek() in ("(", "[", "{") else 1
                self.at += 1 if self.kind(k) == "end" else k  # a bracket that nothing closes
                if self.tokens[self.at].fresh:
                    break
            self.skip(";")
            if self.at == before:
                self.at += 1

    def done(self) -> None:
        if not self.skip(";") and self.peek() != "}" and self.kind() != "end" and not self.tokens[self.at].fresh:
            raise SyntaxError(f"unexpected {self.tokens[self.at].text}")

    def stmt(self, kind: int, begin: int, *kids: Tree | None, **more) -> Tree:
        return Tree("stmt", kind, begin, self.at, [(k, t) for k, t in enumerate(kids) if t is not None], **more)

    def expr(self, kind: int, begin: int, *kids: Tree | None, **more) -> Tree:
        return Tree("expr", kind, begin, self.at, [(k, t) for k, t in enumerate(kids) if t is not None], **more)

    def block(self) -> Tree:
        begin, trees = self.at, []
        self.take("{")
        while not self.skip("}"):
            if self.kind() == "end":
                raise SyntaxError("a block without an end")
            self.statement_or_skip(trees)
        return self.stmt(BLOCK, begin, *trees, block=True)

    def condition(self) -> Tree:
        self.take("(")
        out = self.sequence()
        self.take(")")
        return out

    def statement(self) -> Tree:
        begin, word = self.at, self.peek()
        if word == "{":
            return self.block()
        if self.skip(";"):
            return self.stmt(EMPTY, begin)
        if word == "@":
            notes = self.decorators()
            self.skip("export")
            self.skip("default")
            return self.klass(begin, notes)
        if word in ("var", "const") and self.peek(1) != "enum" or word == "let" and (self.kind(1) == "name" or self.peek(1) in ("[", "{")):
            out = self.declaration()
            self.done()
            out.end = self.at
            return out
        if word == "function" or word == "async" and self.peek(1) == "function":
            hook = self.function(declared=True)
            return self.stmt(FUNCTION, begin, hooks=[hook])
        if word == "class" or word == "abstract" and self.peek(1) == "class":
            return self.klass(begin, [])
        known = {"if": self.if_, "for": self.for_, "while": self.while_, "do": self.do_, "switch": self.switch_, "return": self.jump, "throw": self.jump, "break": self.leave, "continue": self.leave, "try": self.try_, "with": self.with_, "debugger": self.leave, "import": self.import_, "export": self.export_}
        if word in known and not (word == "import" and self.peek(1) in ("(", ".")):
            self.at += 1
            return known[word](begin)
        if self.typed and (found := self.type_statement(begin)):
            return found
        if self.kind() == "name" and self.peek(1) == ":" and word not in ("case", "default"):
            label = self.expr(LABEL, begin, value=self.name())
            label.end = self.at
            self.take(":")
            return Tree("stmt", LABELED, begin, self.at, [(0, label), (1, self.statement())])
        value = self.sequence()
        self.done()
        return self.stmt(EXPR, begin, value)

    def if_(self, begin: int) -> Tree:
        test, then = self.condition(), self.statement()
        other = self.statement() if self.skip("else") else None
        # The test is an expression and the branches are statements: each kind is numbered from 0.
        return Tree("stmt", IF, begin, self.at, [(0, test), (0, then), *([(1, other)] if other else [])])

    def for_(self, begin: int) -> Tree:
        self.skip("await")
        self.take("(")
        first = None
        if self.peek() in ("var", "let", "const"):
            first = self.declaration(loop=True)
        elif self.peek() != ";":
            first = self.sequence(loop=True)
        if self.peek() in ("of", "in"):
            kind = FOR_OF if self.take() == "of" else FOR_IN
            over = self.sequence()
            self.take(")")
            return self.stmt(kind, begin, first, over, self.statement())
        self.take(";")
        test = None if self.peek() == ";" else self.sequence()
        self.take(";")
        step = None if self.peek() == ")" else self.sequence()
        self.take(")")
        return self.stmt(FOR, begin, first, test, step, self.statement())

    def while_(self, begin: int) -> Tree:
        return self.stmt(WHILE, begin, self.condition(), self.statement())

    def with_(self, begin: int) -> Tree:
        return self.stmt(WITH, begin, self.condition(), self.statement())

    def do_(self, begin: int) -> Tree:
        body = self.statement()
        self.take("while")
        test = self.condition()
        self.skip(";")
        return self.stmt(DO, begin, body, test)

    def switch_(self, begin: int) -> Tree:
        value, cases = self.condition(), []
        self.take("{")
        while not self.skip("}"):
            at, test, body = self.at, None, []
            if not self.skip("default"):
                self.take("case")
                test = self.sequence()
            self.take(":")
            while self.peek() not in ("case", "default", "}"):
                if self.kind() == "end":
                    raise SyntaxError("a switch without an end")
                self.statement_or_skip(body)
            cases.append(Tree("stmt", CASE, at, self.at, [*([(0, test)] if test else []), *enumerate(body)]))
        return Tree("stmt", SWITCH, begin, self.at, [(0, value), *enumerate(cases)])

    def jump(self, begin: int) -> Tree:
        kind = RETURN if self.tokens[begin].text == "return" else THROW
        value = None if self.peek() in (";", "}") or self.tokens[self.at].fresh else self.sequence()
        self.done()
        return self.stmt(kind, begin, value)

    def leave(self, begin: int) -> Tree:
        kind = {"break": BREAK, "continue": CONTINUE, "debugger": DEBUGGER}[self.tokens[begin].text]
        if self.kind() == "name" and not self.tokens[self.at].fresh:
            self.take()
        self.done()
        return self.stmt(kind, begin)

    def try_(self, begin: int) -> Tree:
        kids: list[tuple[int, Tree]] = [(0, self.block())]
        if self.peek() == "catch":
            at, names = self.at, []
            self.take()
            if self.skip("("):
                names = self.bound()[1]
                self.annotation()
                self.take(")")
            body = self.block()
            kids.append((1, self.stmt(CATCH, at, body, hooks=[lambda own, scope: [self.variable(n, scope) for n in names] and None])))
        if self.skip("finally"):
            kids.append((2, self.block()))
        return Tree("stmt", TRY, begin, self.at, kids)

    def import_(self, begin: int) -> Tree:
        names, path = [], ""
        self.skip("type") if self.typed and self.peek(1) != "from" else None
        while self.kind() not in ("string", "end"):
            if self.skip("*"):
                self.take("as")
                names.append(f"* as {self.name()}")
            elif self.skip("{"):
                while not self.skip("}"):
                    self.skip("type") if self.typed and self.kind(1) == "name" and self.peek(1) != "as" else None
                    names.append(self.take())
                    if self.skip("as"):
                        self.name()
                    self.skip(",")
            elif not self.skip("from", ","):
                names.append(self.name())
        path = self.take()[1:-1]
        if self.skip("with", "assert"):
            self.at += self.matching()
        self.done()
        return self.stmt(IMPORT, begin, hooks=[lambda own, scope: self.add("imports", self.new("import"), own, ", ".join(names) or path, path)])

    def export_(self, begin: int) -> Tree:
        hook = lambda own, scope: self.add("exports", self.new("export"), own)
        if self.skip("default"):
            if self.peek() in ("function", "class", "abstract") or self.peek() == "async" and self.peek(1) == "function":
                inner = self.statement()
            else:
                inner = self.assignment()
                self.done()
            return self.stmt(EXPORT_DEFAULT, begin, inner, hooks=[hook])
        if self.peek() in ("*", "{") or self.peek() == "type" and self.peek(1) == "{":
            kind = EXPORT_ALL if self.peek() == "*" else EXPORT_NAMED
            while self.kind() != "end" and self.peek() != ";" and not (self.tokens[self.at].fresh and self.peek() != "from"):
                self.at += self.matching() if self.peek() == "{" else 1
            self.skip(";")
            return self.stmt(kind, begin, hooks=[hook])
        return self.stmt(EXPORT_NAMED, begin, self.statement(), hooks=[hook])

    def declaration(self, loop: bool = False) -> Tree:
        begin, kind, kids = self.at, {"var": VAR, "const": CONST, "let": LET}[self.take()], []
        while True:
            at = self.at
            pattern, names = self.bound()
            self.skip("!")
            note = self.annotation()
            value = self.assignment(loop) if self.skip("=") else None
            hooks = [lambda own, scope, names=names: [self.variable(n, scope) for n in names] and None, *self.noted(note)]
            kids.append(self.expr(DECLARATOR, at, pattern, value, hooks=hooks))
            if not self.skip(","):
                return self.stmt(kind, begin, *kids)

    def bound(self) -> tuple[Tree, list[str]]:
        """A name or a pattern, and the names that it declares."""
        begin = self.at
        if self.peek() in ("[", "{"):
            tree = self.primary()
            self.as_pattern(tree)
            return tree, self.names_in(tree)
        name = self.name()
        return self.expr(NAME, begin, value=name), [name]

    def as_pattern(self, tree: Tree) -> None:
        tree.kind = {ARRAY: ARRAY_PATTERN, OBJECT: OBJECT_PATTERN}.get(tree.kind, tree.kind)
        for _, kid in tree.kids:
            self.as_pattern(kid)
        for p in tree.pairs:
            self.as_pattern(p)

    def names_in(self, tree: Tree) -> list[str]:
        if tree.kind == ACCESS:
            return [tree.value or ""]
        if tree.kind == ASSIGN["="]:
            return self.names_in(tree.kids[0][1])
        if tree.kind == OBJECT_PATTERN:
            return [n for p in tree.pairs for n in self.names_in(p)]
        if tree.kind in (ARRAY_PATTERN, SPREAD):
            return [n for _, kid in tree.kids for n in self.names_in(kid)]
        return []

    # Functions and classes

    def function(self, declared: bool = False, name: str | None = None) -> Callable[[int, int], None]:
        """From the word `function`, or from the parameters of a method of this name; the hook writes it."""
        begin = self.at
        if name is None:
            self.skip("async")
            self.take("function")
            self.skip("*")
            name = self.name() if self.kind() == "name" else ""
        self.type_parameters()
        names, notes = self.parameters()
        result = self.annotation()
        body = self.block() if self.peek() == "{" else None
        if body is None:
            self.done()
        return self.made(begin, self.at, name, names, notes, result, body, declared)

    def made(self, begin: int, end: int, name: str, names: list[str], notes: list[str], result: str | None, body: Tree | None, declared: bool = False) -> Callable[[int, int], None]:
        def hook(own: int, scope: int) -> None:
            f, inner = self.new("function"), self.scope(FUNCTION_SCOPE)
            self.add("functions", f, name, scope)
            self.located(f, begin, end)
            if declared and name:
                self.variable(name, scope)
            for n in names:
                self.variable(n, inner)
            for note in [*notes, *([result] if result else [])]:
                self.add("type_annotations", self.new("type_annotation"), f, note)
            if body is not None:
                self.write(body, f, 0, inner)

        return hook

    def parameters(self) -> tuple[list[str], list[str]]:
        names, notes = [], []
        self.take("(")
        while not self.skip(")"):
            self.decorators()
            while self.peek() in ("public", "private", "protected", "readonly") and self.kind(1) == "name":
                self.take()
            self.skip("...")
            names += self.bound()[1]
            self.skip("?")
            if note := self.annotation():
                notes.append(note)
            if self.skip("="):
                self.assignment()
            if not self.skip(",") and self.peek() != ")":
                raise SyntaxError("expected a parameter")
        return names, notes

    def decorators(self) -> list[str]:
        out = []
        while self.skip("@"):
            words = [self.name()]
            while self.skip("."):
                words.append(self.name())
            out.append(".".join(words))
            if self.peek() == "(":
                self.at += self.matching()
        return out

    def klass(self, begin: int, notes: list[str]) -> Tree:
        hook = self.class_body(notes, declared=True)
        return self.stmt(CLASS, begin, hooks=[hook])

    def class_body(self, notes: list[str], declared: bool = False) -> Callable[[int, int], None]:
        begin = self.at
        self.skip("abstract")
        self.take("class")
        name = self.name() if self.kind() == "name" and self.peek() not in ("extends", "implements") else ""
        self.type_parameters()
        if self.skip("extends"):
            self.postfix()
            self.type_parameters()
        if self.skip("implements"):
            while self.peek() != "{":
                self.type()
                self.skip(",")
        members: list[tuple[int, Callable[[int, int], None] | Tree | None, list[str]]] = []
        self.take("{")
        while not self.skip("}"):
            if self.skip(";"):
                continue
            own = self.decorators()
            kind, member = self.member()
            members.append((kind, member, own))
        end = self.at

        def hook(own: int, scope: int) -> None:
            c, inner = self.new("class"), self.scope(CLASS_SCOPE)
            self.add("classes", c, name, own)
            self.located(c, begin, end)
            if declared and name:
                self.variable(name, scope)
            for n in notes:
                self.add("decorators", self.new("decorator"), n, c)
            for k, (kind, member, notes_) in enumerate(members):
                p = self.new("property")
                self.add("properties", p, c, k, kind)
                for n in notes_:
                    self.add("decorators", self.new("decorator"), n, p)
                if isinstance(member, Tree):
                    for j, kid in member.kids:
                        self.write(kid, p, j, inner)
                elif member is not None:
                    member(p, inner)

        return hook

    def member(self) -> tuple[int, Callable[[int, int], None] | Tree | None]:
        """A method as its hook, a field as a tree of its name and value."""
        kind = VALUE
        while self.peek() in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "declare", "override") and (self.kind(1) in ("name", "string", "number") or self.peek(1) in ("[", "*", "{")):
            kind = {"get": GETTER, "set": SETTER}.get(self.take(), kind)
        self.skip("*")
        if self.peek() == "{":
            self.at += self.matching()
            return VALUE, None
        begin = self.at
        if self.skip("["):
            key = self.assignment()
            self.take("]")
            word = ""
        else:
            word = self.take()
            key = self.expr(STRING if word[0] in "\"'" else NUMBER if word[0].isdigit() else LABEL, begin, value=word)
        self.skip("?")
        self.skip("!")
        if self.peek() in ("(", "<"):
            return kind, self.function(name=word.strip("\"'"))
        note = self.annotation()
        value = self.assignment() if self.skip("=") else None
        self.done()
        return kind, self.expr(OBJECT, begin, key, value, hooks=self.noted(note))

    # Types

    def noted(self, note: str | None) -> list[Callable[[int, int], None]]:
        return [lambda own, scope: self.add("type_annotations", self.new("type_annotation"), own, note)] if note else []

    def annotation(self) -> str | None:
        """The text of a type behind a colon, if one stands here in TypeScript."""
        return self.type() if self.typed and self.skip(":") else None

    def type_parameters(self) -> None:
        if self.typed and self.peek() == "<":
            self.angles()

    def angles(self) -> None:
        depth = 0
        while self.kind() != "end":
            word = self.peek()
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(word, 0)
            self.at += self.matching() if word in ("(", "[", "{") else 1
            if depth <= 0:
                return

    def type(self) -> str:
        begin = self.at
        while True:
            self.skip("|", "&")
            while self.peek() in ("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract") and self.kind(1) in ("name",) or self.peek() == "new":
                self.take()
            if self.peek() in ("(", "[", "{"):
                self.at += self.matching()
                if self.skip("=>"):
                    self.type()
            elif self.peek() == "<":
                self.angles()
                continue
            elif self.kind() in ("string", "number", "template", "name") or self.peek() == "-":
                self.skip("-")
                self.take()
                while self.peek() == "." and self.kind(1) == "name":
                    self.at += 2
                if self.peek() == "<":
                    self.angles()
            else:
                raise SyntaxError(f"expected a type, found {self.tokens[self.at].text or 'the end'}")
            while self.peek() == "[" and not self.tokens[self.at].fresh:
                self.at += self.matching()
            if self.skip("is"):
                continue
            if self.peek() == "extends":
                self.take()
                self.type()
                if self.skip("?"):
                    self.type()
                    self.take(":")
                    continue
            if self.peek() not in ("|", "&"):
                last = self.tokens[self.at - 1]
                return self.text[self.tokens[begin].at : last.at + len(last.text)]

    def type_statement(self, begin: int) -> Tree | None:
        word = self.peek()
        if word in ("declare",) and self.kind(1) == "name":
            self.take()
            return self.statement()
        if word == "const" and self.peek(1) == "enum":
            self.take()
            word = "enum"
        tables = {"interface": ("interfaces", "interface", INTERFACE), "enum": ("enums", "enum", ENUM), "type": ("type_aliases", "type_alias", ALIAS)}
        if word not in tables or self.kind(1) != "name":
            return None
        relation, what, kind = tables[self.take()]
        name = self.name()
        self.type_parameters()
        if kind == ALIAS:
            self.take("=")
            self.type()
            self.done()
        else:
            while self.peek() != "{":
                self.take()
            self.at += self.matching()
        return self.stmt(kind, begin, hooks=[lambda own, scope: self.add(relation, self.new(what), name, own)])

    # Expressions

    def sequence(self, loop: bool = False) -> Tree:
        begin, left = self.at, self.assignment(loop)
        while self.skip(","):
            left = self.expr(SEQUENCE, begin, left, self.assignment(loop))
        return left

    def is_arrow(self) -> bool:
        k = 1 if self.peek() == "async" and (self.kind(1) == "name" or self.peek(1) in ("(", "<")) else 0
        if self.typed and self.peek(k) == "<":
            while self.kind(k) != "end" and self.peek(k) not in ("(", "=", ";"):
                k += 1
        if self.peek(k) != "(":
            return self.kind(k) == "name" and self.peek(k + 1) == "=>"
        k = self.matching(k)
        if self.typed and self.peek(k) == ":":
            before = self.at
            try:
                self.at += k + 1
                self.type()
                return self.peek() == "=>"
            except SyntaxError:
                return False
            finally:
                self.at = before
        return self.peek(k) == "=>"

    def arrow(self) -> Tree:
        begin = self.at
        if self.peek() == "async" and self.peek(1) != "=>":
            self.take()
        self.type_parameters()
        names, notes = ([self.name()], []) if self.kind() == "name" else self.parameters()
        result = self.annotation()
        self.take("=>")
        body = self.block() if self.peek() == "{" else self.assignment()
        return self.expr(ARROW, begin, hooks=[self.made(begin, self.at, "", names, notes, result, body)])

    def assignment(self, loop: bool = False) -> Tree:
        begin = self.at
        if self.is_arrow():
            return self.arrow()
        if self.peek() == "yield":
            self.take()
            self.skip("*")
            value = None if self.peek() in (")", "]", "}", ",", ";", ":") or self.tokens[self.at].fresh else self.assignment(loop)
            return self.expr(YIELD, begin, value)
        left = self.binary(0, loop)
        if self.skip("?"):
            then = self.assignment()
            self.take(":")
            return self.expr(TERNARY, begin, left, then, self.assignment(loop))
        word = self.peek()
        if word in ASSIGN or word in ("&&=", "||=", "??="):
            self.take()
            if word == "=" and left.kind in (ARRAY, OBJECT):
                self.as_pattern(left)
            return self.expr(ASSIGN.get(word, ASSIGN["="]), begin, left, self.assignment(loop))
        return left

    def binary(self, level: int, loop: bool) -> Tree:
        if level == len(LEVELS):
            return self.power(loop)
        begin, left = self.at, self.binary(level + 1, loop)
        while self.peek() in LEVELS[level] and not (loop and self.peek() == "in"):
            word = self.take()
            left = self.expr(BINARY[word], begin, left, self.binary(level + 1, loop))
        while self.typed and level == 7 and self.peek() in ("as", "satisfies") and not self.tokens[self.at].fresh:
            self.take()
            self.type()
        return left

    def power(self, loop: bool) -> Tree:
        begin, left = self.at, self.unary()
        if self.skip("**"):
            return self.expr(BINARY["**"], begin, left, self.power(loop))
        return left

    def unary(self) -> Tree:
        begin, word = self.at, self.peek()
        if word in UNARY:
            self.take()
            return self.expr(UNARY[word], begin, self.unary())
        if word in ("++", "--"):
            self.take()
            return self.expr(UPDATE[word, True], begin, self.unary())
        if word == "await" and (self.kind(1) in ("name", "string", "number", "template") or self.peek(1) in ("(", "[", "{")):
            self.take()
            return self.expr(AWAIT, begin, self.unary())
        out = self.postfix()
        if self.peek() in ("++", "--") and not self.tokens[self.at].fresh:
            return self.expr(UPDATE[self.take(), False], begin, out)
        return out

    def arguments(self) -> list[Tree]:
        out = []
        self.take("(")
        while not self.skip(")"):
            out.append(self.spread())
            if not self.skip(",") and self.peek() != ")":
                raise SyntaxError("expected an argument")
        return out

    def spread(self) -> Tree:
        begin = self.at
        return self.expr(SPREAD, begin, self.assignment()) if self.skip("...") else self.assignment()

    def generic_call(self) -> bool:
        """Whether type arguments and then a call stand here."""
        if not self.typed or self.peek() != "<":
            return False
        k, depth = 0, 0
        while self.kind(k) in ("name", "string", "number") or self.peek(k) in ("<", ">", ">>", ",", ".", "|", "&", "[", "]", "{", "}", ":"):
            depth += {"<": 1, ">": -1, ">>": -2}.get(self.peek(k), 0)
            k += 1
            if depth <= 0:
                return self.peek(k) == "("
        return False

    def postfix(self) -> Tree:
        begin = self.at
        if self.peek() == "new" and self.peek(1) != ".":
            self.take()
            target = self.callee()
            if self.generic_call():
                self.angles()
            out = self.expr(NEW, begin, target, *(self.arguments() if self.peek() == "(" else ()))
        else:
            out = self.primary()
        while True:
            word = self.peek()
            if word in (".", "?.") and (self.kind(1) == "name"):
                self.take()
                at = self.at
                label = self.expr(LABEL, at, value=self.take())
                label.end = self.at
                out = self.expr(MEMBER, begin, out, label)
            elif word == "?." and self.peek(1) in ("(", "["):
                self.take()
            elif word == "[":
                self.take()
                index = self.sequence()
                self.take("]")
                out = self.expr(SUBSCRIPT, begin, out, index)
            elif word == "(":
                out = self.expr(CALL, begin, out, *self.arguments())
            elif self.kind() == "template":
                out = self.expr(TAGGED, begin, out, self.primary())
            elif word == "!" and self.typed and not self.tokens[self.at].fresh and self.peek(1) != "=":
                self.take()
            elif self.generic_call():
                self.angles()
            else:
                return out

    def callee(self) -> Tree:
        """What is called by new: members, but no call."""
        begin, out = self.at, self.postfix() if self.peek() == "new" else self.primary()
        while self.peek() in (".", "["):
            if self.skip("."):
                at = self.at
                label = self.expr(LABEL, at, value=self.name())
                label.end = self.at
                out = self.expr(MEMBER, begin, out, label)
            else:
                self.take("[")
                index = self.sequence()
                self.take("]")
                out = self.expr(SUBSCRIPT, begin, out, index)
        return out

    def primary(self) -> Tree:
        begin, kind, word = self.at, self.kind(), self.tokens[self.at].text
        if kind in ("string", "number", "regex"):
            self.take()
            return self.expr({"string": STRING, "number": NUMBER, "regex": REGEX}[kind], begin, value=word)
        if kind == "template":
            return self.template_parts(begin)
        if word == "(":
            self.take()
            out = self.sequence()
            self.take(")")
            return out
        if word == "[":
            self.take()
            items = []
            while not self.skip("]"):
                if self.skip(","):
                    continue
                items.append(self.spread())
                if not self.skip(",") and self.peek() != "]":
                    raise SyntaxError("expected an element")
            return self.expr(ARRAY, begin, *items)
        if word == "{":
            return self.object()
        if word == "function" or word == "async" and self.peek(1) == "function":
            return self.expr(FUNCTION_EXPR, begin, hooks=[self.function()])
        if word == "class":
            return self.expr(CLASS_EXPR, begin, hooks=[self.class_body([])])
        if kind != "name":
            raise SyntaxError(f"expected an expression, found {word or 'the end'}")
        self.take()
        known = {"this": THIS, "super": SUPER, "null": NULL, "true": BOOLEAN, "false": BOOLEAN}
        return self.expr(known.get(word, ACCESS), begin, value=word)

    def template_parts(self, begin: int) -> Tree:
        """Its substitutions, each parsed as an expression of its own."""
        token, kids = self.tokens[self.at], []
        self.at += 1
        at, stop = token.at + 1, token.at + len(token.text) - 1
        outer = self.tokens, self.at
        while at < stop:
            if self.text[at] == "\\":
                at += 2
            elif self.text.startswith("${", at):
                inner, at = self.scan(at + 2, stop, inside=True)
                first = len(outer[0])
                # Trees know tokens by number: those of a substitution go behind the others.
                outer[0].extend(inner)
                self.tokens, self.at = outer[0], first
                try:
                    value = self.sequence()
                    kids.append(Tree("expr", ELEMENT, first, self.at, [(0, value)]))
                finally:
                    self.tokens, self.at = outer
                at += 1
            else:
                at += 1
        return Tree("expr", TEMPLATE, begin, begin + 1, list(enumerate(kids)))

    def object(self) -> Tree:
        begin, rows = self.at, []
        pairs: list[Tree] = []
        self.take("{")
        while not self.skip("}"):
            at = self.at
            if self.peek() == "...":
                tree = self.spread()
                pairs.append(tree)
                rows.append(("spread", tree))
            elif self.kind() == "name" and self.peek(1) in (",", "}", "="):
                tree = self.expr(ACCESS, at, value=self.take())
                if self.skip("="):
                    tree = self.expr(ASSIGN["="], at, tree, self.assignment())
                pairs.append(tree)
                rows.append(("short", tree))
            else:
                is_pair = (self.kind() in ("name", "string", "number") and self.peek(1) == ":") or self.peek() == "[" and self.peek(self.matching()) == ":"
                if is_pair:
                    if self.skip("["):
                        key = self.assignment()
                        self.take("]")
                    else:
                        kind = {"name": LABEL, "string": STRING, "number": NUMBER}[self.kind()]
                        key = self.expr(kind, at, value=self.take())
                    self.take(":")
                    value = self.assignment()
                    pairs.append(value)
                    rows.append(("pair", (key, value)))
                else:
                    kind, member = self.member()
                    rows.append(("member", (kind, member)))
            if not self.skip(",") and self.peek() != "}":
                raise SyntaxError("expected a property")

        def hook(own: int, scope: int) -> None:
            for k, (what, x) in enumerate(rows):
                if what == "spread":
                    self.write(x, own, k, scope)
                    continue
                p = self.new("property")
                self.add("properties", p, own, k, x[0] if what == "member" else VALUE)
                if what == "short":
                    self.write(x, p, 0, scope)
                elif what == "pair":
                    self.write(x[0], p, 0, scope)
                    self.write(x[1], p, 1, scope)
                elif x[1] is not None and not isinstance(x[1], Tree):
                    x[1](p, scope)

        out = self.expr(OBJECT, begin, hooks=[hook])
        out.pairs = pairs
        return out


@extractor("javascript", SCHEME)
def extract_js(path: str, text: str) -> Facts:
    """A file that ends within a string, a template or a comment gives no facts of its own."""
    yield from _Unit(path, text).facts()
