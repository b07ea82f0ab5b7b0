"""Facts of Java sources, by a parser of its own: types, members, statements and expressions of the language's core.

Arguments of generic types are read over; type parameters, annotations and what the compiler adds (default
constructors, members of enums) are told. A member that the parser doesn't know is skipped up to its end. Ids are
hashes of the file's path and of a serial number in it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from .extract import Facts, entity, extractor

#: The tables, and the kinds of statements and expressions.
SCHEME = """
packages(unique int id: @package, string nodeName: string ref);
cupackage(unique int id: @file ref, int packageid: @package ref);
classes_or_interfaces(unique int id: @classorinterface, string nodeName: string ref, int parentid: @package ref, int sourceid: @classorinterface ref);
isInterface(unique int id: @classorinterface ref);
isRecord(unique int id: @classorinterface ref);
isEnumType(int classid: @classorinterface ref);
isAnnotType(int interfaceid: @classorinterface ref);
isEnumConst(int fieldid: @field ref);
extendsReftype(int id1: @classorinterface ref, int id2: @classorinterface ref);
implInterface(int id1: @classorinterface ref, int id2: @classorinterface ref);
enclInReftype(unique int child: @classorinterface ref, int parent: @classorinterface ref);
fields(unique int id: @field, string nodeName: string ref, string typeName: string ref, int parentid: @classorinterface ref);
methods(unique int id: @method, string nodeName: string ref, string signature: string ref, string typeName: string ref, int parentid: @classorinterface ref, int sourceid: @method ref);
constrs(unique int id: @constructor, string nodeName: string ref, string signature: string ref, string typeName: string ref, int parentid: @classorinterface ref, int sourceid: @constructor ref);
#keyset[parentid,pos]
params(unique int id: @param, string typeName: string ref, int pos: int ref, int parentid: @callable ref, int sourceid: @param ref);
paramName(unique int id: @param ref, string nodeName: string ref);
isVarargsParam(int param: @param ref);
localvars(unique int id: @localvar, string nodeName: string ref, string typeName: string ref, int parentid: @element ref);
modifiers(unique int id: @modifier, string nodeName: string ref);
hasModifier(int id1: @modifiable ref, int id2: @modifier ref);
imports(unique int id: @import, int holder: @element ref, string name: string ref, int kind: int ref);
#keyset[parent,idx]
stmts(unique int id: @stmt, int kind: int ref, int parent: @element ref, int idx: int ref, int bodydecl: @callable ref);
#keyset[parent,idx]
exprs(unique int id: @expr, int kind: int ref, string typeName: string ref, int parent: @element ref, int idx: int ref);
callableEnclosingExpr(unique int id: @expr ref, int callable_id: @callable ref);
declaresMember(int parentid: @classorinterface ref, int memberid: @member ref);
namestrings(string name: string ref, string value: string ref, int parent: @element ref);
isDefConstr(unique int id: @constructor ref);
annotations(unique int id: @annotation, int parentid: @element ref, string typeName: string ref);
#keyset[parentid,pos]
typeVars(unique int id: @typevariable, string nodeName: string ref, int pos: int ref, int parentid: @element ref);
#keyset[parentid,pos]
typeBounds(unique int id: @typebound, string typeName: string ref, int pos: int ref, int parentid: @typevariable ref);
compiler_generated(unique int id: @element ref, int kind: int ref);
@callable = @method | @constructor;
@variable = @field | @localvar | @param;
@member = @field | @method | @constructor;
@modifiable = @member | @classorinterface;
@element = @package | @classorinterface | @member | @param | @localvar | @stmt | @expr | @import | @file;
"""
BLOCK, IF, FOR, EACH, WHILE, DO, TRY, SWITCH, RETURN, THROW, BREAK, CONTINUE, EMPTY, EXPR, LABELED, ASSERT, LOCAL, CASE, CATCH = 0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 21, 22
ARRAY_ACCESS, ARRAY_CREATION, ARRAY_INIT, CAST, NEW, CONDITIONAL, INSTANCEOF, DECL, THIS, SUPER, ACCESS, CALL, TYPE, LAMBDA = 1, 2, 3, 51, 52, 53, 55, 56, 58, 59, 60, 61, 62, 68
ASSIGNMENT = {"=": 4, "+=": 5, "-=": 6, "*=": 7, "/=": 8, "%=": 9, "&=": 10, "|=": 11, "^=": 12, "<<=": 13, ">>=": 14, ">>>=": 15}
BINARY = {"*": 24, "/": 25, "%": 26, "+": 27, "-": 28, "<<": 29, ">>": 30, ">>>": 31, "&": 32, "|": 33, "^": 34, "&&": 35, "||": 36, "<": 37, ">": 38, "<=": 39, ">=": 40, "==": 41, "!=": 42}
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"))
POSTFIX, PREFIX = {"++": 43, "--": 44}, {"++": 45, "--": 46, "-": 47, "+": 48, "~": 49, "!": 50}
BOOLEAN, INT, LONG, FLOAT, DOUBLE, CHAR, STRING, NULL = 16, 17, 18, 19, 20, 21, 22, 23
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
PRIMITIVES = {"boolean", "byte", "char", "double", "float", "int", "long", "short", "void"}
_WORDS = {"return", "throw", "new", "case", "else", "instanceof", "assert", "break", "continue", "if", "for", "while", "do", "switch", "try", "this", "super", "yield"}
_TOKEN = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\")|(?P<char>'(?:[^'\\\n]|\\.)*')|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<name>[A-Za-z_$]\w*)|(?P<sign>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|<<|&&|\|\||[<>=!+\-*/%&|^]=|[{}()\[\];,.:?~!<>=+\-*/%&|^@])|(?P<other>.)", re.DOTALL)


@dataclass
class Token:
    kind: str
    text: str


@extractor("java", SCHEME)
def extract_java(path: str, text: str) -> Facts:
    yield from _Unit(path, text).facts()


class _Unit:
    def __init__(self, path: str, text: str):
        self.path, self.file = path, entity("file", path)
        self.tokens = [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"] + [Token("end", "")]
        self.out: list[tuple[str, tuple]] = []
        self.serial: Counter[str] = Counter()
        self.at, self.callable, self.package, self.supers = 0, 0, "", []
        self.names: dict[str, int] = {}
        self.constructed: set[int] = set()

    def new(self, kind: str) -> int:
        self.serial[kind] += 1
        return entity(self.path, "java", kind, self.serial[kind])

    def add(self, relation: str, *cells: object) -> None:
        self.out.append((relation, cells))

    # Tokens

    def peek(self, k: int = 0) -> str:
        t = self.tokens[min(self.at + k, len(self.tokens) - 1)]
        return t.text if t.kind not in ("string", "char") else '"'

    def kind(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)].kind

    def take(self, want: str | None = None) -> str:
        t = self.tokens[self.at]
        if t.kind == "end" or (want is not None and t.text != want):
            raise SyntaxError(f"expected {want}, found {t.text or 'the end'}")
        self.at += 1
        return t.text

    def name(self) -> str:
        if self.kind() != "name":
            raise SyntaxError(f"expected a name, found {self.peek() or 'the end'}")
        return self.take()

    def skip(self, want: str) -> bool:
        if self.peek() == want:
            self.at += 1
            return True
        return False

    def group(self) -> None:
        depth = 0
        while self.kind() != "end":
            t = self.take()
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            if depth == 0:
                return

    def angles(self, k: int = 0) -> int:
        """Where generic arguments that begin at k end, or k if there are none."""
        if self.peek(k) != "<":
            return k
        depth, j = 0, k
        while self.kind(j) != "end":
            t = self.peek(j)
            depth += (t == "<") - (t == ">")
            if t not in ("<", ">", ",", ".", "?", "&", "[", "]", "@") and self.kind(j) != "name":
                return k
            j += 1
            if depth == 0:
                return j
        return k

    def type_end(self, k: int = 0) -> int:
        """Where a type that begins at k ends, or k if none does."""
        if self.kind(k) != "name" or self.peek(k) in _WORDS:
            return k
        j = self.angles(k + 1)
        while self.peek(j) == "." and self.kind(j + 1) == "name":
            j = self.angles(j + 2)
        while self.peek(j) == "[" and self.peek(j + 1) == "]":
            j += 2
        return j

    def type(self) -> str:
        end = self.type_end()
        if end == 0:
            raise SyntaxError(f"expected a type, found {self.peek()}")
        words = [self.peek(k) for k in range(end)]
        self.at += end
        depth, out = 0, []
        for w in words:
            depth += w == "<"
            if depth == 0:
                out.append(w)
            depth -= w == ">"
        return "".join(out)

    def notes(self) -> list[str]:
        """Modifiers and, with their sign, annotations."""
        out = []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.take()
                out.append(f"@{self.type()}")
                if self.peek() == "(":
                    self.group()
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                out.append(self.take())
            elif self.peek() == "non" and self.peek(1) == "-":
                self.at += 3
            else:
                return out

    def modified(self, own: int, notes: list[str]) -> None:
        for n in notes:
            if n.startswith("@"):
                self.add("annotations", self.new("annotation"), own, n[1:])
                continue
            self.add("modifiers", entity("modifier", n), n)
            self.add("hasModifier", own, entity("modifier", n))

    def type_parameters(self) -> list[tuple[str, list[str]]]:
        """Names with their bounds; none if no angle bracket stands here."""
        end, out = self.at + self.angles(), []
        if self.skip("<"):
            while self.at < end - 1:
                self.notes()
                out.append((self.name(), []))
                while self.peek() in ("extends", "&"):
                    self.take()
                    out[-1][1].append(self.type())
                self.skip(",")
            self.at = end
        return out

    def generic(self, own: int, parameters: list[tuple[str, list[str]]]) -> None:
        for k, (name, bounds) in enumerate(parameters):
            v = self.new("typevariable")
            self.add("typeVars", v, name, k, own)
            for j, t in enumerate(bounds):
                self.add("typeBounds", self.new("typebound"), t, j, v)

    def generated(self, relation: str, own: int, name: str, types: str, kind: str, notes: list[str]) -> int:
        """A member that the compiler adds."""
        m = self.new("callable")
        self.add(relation, m, name, f"{name}({types})", kind, own, m)
        self.add("declaresMember", own, m)
        self.add("compiler_generated", m, 1)
        self.modified(m, notes)
        return m

    # Declarations

    def facts(self) -> Facts:
        while self.kind() != "end":
            before = self.at
            try:
                self.top()
            except SyntaxError:
                self.recover()
            if self.at == before:
                self.at += 1
        for own, relation, name in self.supers:
            self.add(relation, own, self.names.get(name) or entity("class", name))
        return iter(self.out)

    def recover(self) -> None:
        while self.kind() != "end" and self.peek() not in (";", "}"):
            if self.peek() == "{":
                self.group()
                return
            self.at += 1
        self.at += self.kind() != "end"

    def top(self) -> None:
        if self.skip("package"):
            self.package = self.type()
            self.take(";")
            return
        if self.skip("import"):
            self.skip("static")
            name = self.type()
            whole = self.skip(".") and self.skip("*")
            self.take(";")
            self.add("imports", self.new("import"), self.file, name, 2 if whole else 1)
            return
        if not self.skip(";"):
            self.class_like(self.notes(), 0)

    def class_like(self, notes: list[str], outer: int) -> None:
        self.skip("@")
        word, name = self.take(), self.name()
        if word not in ("class", "interface", "enum", "record"):
            raise SyntaxError(f"unexpected {word}")
        own, home = self.new("class"), entity("package", self.package)
        self.names[name] = own
        self.add("packages", home, self.package)
        self.add("cupackage", self.file, home)
        self.add("classes_or_interfaces", own, name, home, own)
        self.modified(own, notes)
        if outer:
            self.add("enclInReftype", own, outer)
        if word != "class":
            self.add({"interface": "isInterface", "enum": "isEnumType", "record": "isRecord"}[word], own)
        self.generic(own, self.type_parameters())
        if word == "record":
            for t, n, more in self.parameters():
                self.field(own, n, t, ["private", "final", *more])
        while self.peek() in ("extends", "implements", "permits"):
            clause = self.take()
            while True:
                t = self.type()
                if clause != "permits":
                    self.supers.append((own, "extendsReftype" if clause == "extends" else "implInterface", t))
                if not self.skip(","):
                    break
        self.take("{")
        if word == "enum":
            while self.kind() == "name" or self.peek() == "@":
                more = self.notes()
                f = self.field(own, self.name(), name, ["public", "static", "final", *more])
                self.add("isEnumConst", f)
                for opening in ("(", "{"):
                    if self.peek() == opening:
                        self.group()
                if not self.skip(","):
                    break
            self.skip(";")
        while not self.skip("}"):
            before = self.at
            try:
                self.member(own, name)
            except SyntaxError:
                self.callable = 0
                if self.kind() == "end":
                    raise
                self.recover()
            if self.at == before:
                self.at += 1
        if word == "enum":
            self.generated("methods", own, "values", "", f"{name}[]", ["public", "static"])
            self.generated("methods", own, "valueOf", "String", name, ["public", "static"])
            self.generated("constrs", own, name, "String, int", name, ["private"])
        elif word == "class" and own not in self.constructed:
            self.add("isDefConstr", self.generated("constrs", own, name, "", name, ["public"]))

    def field(self, own: int, name: str, kind: str, notes: list[str]) -> int:
        f = self.new("field")
        self.add("fields", f, name, kind, own)
        self.add("declaresMember", own, f)
        self.modified(f, notes)
        return f

    def member(self, own: int, name: str) -> None:
        if self.skip(";"):
            return
        notes = self.notes()
        if self.peek() == "{":
            self.group()
            return
        if self.peek() in ("class", "interface", "enum") or self.peek() == "@" or (self.peek() == "record" and self.kind(1) == "name" and self.peek(2) in ("(", "<")):
            self.class_like(notes, own)
            return
        variables = self.type_parameters()
        if self.peek() == name and self.peek(1) == "(":
            self.take()
            self.constructed.add(own)
            self.method(own, name, None, notes, variables)
            return
        kind, label = self.type(), self.name()
        if self.peek() == "(":
            self.method(own, label, kind, notes, variables)
            return
        while True:
            f = self.field(own, label, kind, notes)
            while self.skip("["):
                self.take("]")
            if self.skip("="):
                self.emit(self.initialiser(), 0, f)
            if not self.skip(","):
                break
            label = self.name()
        self.take(";")

    def parameters(self) -> list[tuple[str, str, list[str]]]:
        """Types, names, and modifiers and annotations."""
        out = []
        self.take("(")
        while not self.skip(")"):
            notes = self.notes()
            t = self.type()
            if self.skip("..."):
                t += "..."
            out.append((t, self.name(), notes))
            while self.skip("["):
                self.take("]")
            self.skip(",")
        return out

    def method(self, own: int, name: str, result: str | None, notes: list[str], variables: list[tuple[str, list[str]]]) -> None:
        m, params = self.new("callable"), self.parameters()
        signature = f"{name}({', '.join(t for t, *_ in params)})"
        self.add("constrs" if result is None else "methods", m, name, signature, result or name, own, m)
        self.generic(m, variables)
        self.add("declaresMember", own, m)
        self.modified(m, notes)
        for k, (t, n, more) in enumerate(params):
            p = self.new("param")
            self.modified(p, [x for x in more if x[0] == "@"])
            self.add("params", p, t, k, m, p)
            self.add("paramName", p, n)
            if t.endswith("..."):
                self.add("isVarargsParam", p)
        while self.skip("["):
            self.take("]")
        if self.skip("throws"):
            self.type()
            while self.skip(","):
                self.type()
        if self.skip("default"):
            self.emit(self.initialiser(), 0, m)
        if self.skip(";"):
            return
        self.callable = m
        self.statement(m, 0)
        self.callable = 0

    # Statements

    def statement(self, parent: int, index: int) -> int:
        own = self.new("stmt")
        kind = self.statement_of(own)
        self.add("stmts", own, kind, parent, index, self.callable)
        return own

    def block(self, own: int) -> None:
        self.take("{")
        k = 0
        while not self.skip("}"):
            before = self.at
            self.statement(own, k)
            k += 1
            if self.at == before:
                raise SyntaxError(f"unexpected {self.peek()}")

    def condition(self, own: int) -> None:
        self.take("(")
        self.emit(self.assignment(), 0, own)
        self.take(")")

    def statement_of(self, own: int) -> int:
        word = self.peek() if self.kind() in ("name", "sign") else ""
        if word == "{":
            self.block(own)
            return BLOCK
        if self.skip(";"):
            return EMPTY
        match word:
            case "if" | "while" | "synchronized":
                self.take()
                self.condition(own)
                self.statement(own, 1)
                if word == "if" and self.skip("else"):
                    self.statement(own, 2)
                return {"if": IF, "while": WHILE}.get(word, BLOCK)
            case "do":
                self.take()
                self.statement(own, 1)
                self.take("while")
                self.condition(own)
                self.take(";")
                return DO
            case "for":
                return self.loop(own)
            case "try":
                return self.attempt(own)
            case "switch":
                self.take()
                self.condition(own)
                self.block(own)
                return SWITCH
            case "case" | "default":
                self.take()
                k = 0
                while word == "case":
                    self.emit(self.conditional(), k, own)
                    k += 1
                    if not self.skip(","):
                        break
                if self.skip("->"):
                    self.statement(own, k)
                else:
                    self.take(":")
                return CASE
            case "return" | "throw" | "yield" | "assert" if not (word == "yield" and self.peek(1) in ("=", ".", "(")):
                self.take()
                k = 0
                while self.peek() != ";":
                    self.emit(self.assignment(), k, own)
                    k += 1
                    if not self.skip(":"):
                        break
                self.take(";")
                return {"return": RETURN, "throw": THROW, "assert": ASSERT}.get(word, RETURN)
            case "break" | "continue":
                self.take()
                if self.peek() != ";":
                    self.take()
                self.take(";")
                return BREAK if word == "break" else CONTINUE
            case "class" | "interface" | "enum":
                inner, self.callable = self.callable, 0
                self.class_like([], 0)
                self.callable = inner
                return LOCAL
        if self.kind() == "name" and self.peek(1) == ":":
            self.at += 2
            self.statement(own, 0)
            return LABELED
        self.notes() if word in ("final", "@") else None
        if self.local_ahead():
            self.locals(own)
            self.take(";")
            return LOCAL
        self.emit(self.assignment(), 0, own)
        self.take(";")
        return EXPR

    def local_ahead(self) -> bool:
        end = self.type_end()
        return end > 0 and self.kind(end) == "name" and self.peek(end) not in ("instanceof",) and self.peek(end + 1) in ("=", ";", ",", ":", "[", ")")

    def locals(self, own: int) -> None:
        kind, k = self.type(), 0
        while True:
            e, v, name = self.new("expr"), self.new("localvar"), self.name()
            self.add("exprs", e, DECL, kind, own, k)
            self.inside(e)
            self.add("namestrings", name, name, e)
            self.add("localvars", v, name, kind, self.callable)
            while self.skip("["):
                self.take("]")
            if self.skip("="):
                self.emit(self.initialiser(), 0, e)
            k += 1
            if not self.skip(","):
                return

    def loop(self, own: int) -> int:
        self.take()
        self.take("(")
        self.notes()
        kind = FOR
        if self.local_ahead():
            self.locals(own)
            if self.skip(":"):
                kind = EACH
                self.emit(self.assignment(), 1, own)
        elif self.peek() != ";":
            self.emit(self.assignment(), 0, own)
        if kind == FOR:
            k = 10
            for end in (";", ";", ")"):
                while self.peek() != end:
                    self.emit(self.assignment(), k, own)
                    k += 1
                    if not self.skip(","):
                        break
                if end == ";":
                    self.take(";")
        self.take(")")
        self.statement(own, 2)
        return kind

    def attempt(self, own: int) -> int:
        self.take()
        if self.skip("("):
            while not self.skip(")"):
                self.notes()
                if self.local_ahead():
                    self.locals(own)
                else:
                    self.emit(self.assignment(), 0, own)
                self.skip(";")
        self.statement(own, 1)
        k = 2
        while self.skip("catch"):
            c = self.new("stmt")
            self.add("stmts", c, CATCH, own, k, self.callable)
            self.take("(")
            self.notes()
            kind = self.type()
            while self.skip("|"):
                kind += "|" + self.type()
            self.add("localvars", self.new("localvar"), self.name(), kind, self.callable)
            self.take(")")
            self.statement(c, 0)
            k += 1
        if self.skip("finally"):
            self.statement(own, k)
        return TRY

    # Expressions, as trees of (kind, type, name, children)

    def inside(self, e: int) -> None:
        if self.callable:
            self.add("callableEnclosingExpr", e, self.callable)

    def emit(self, tree: tuple, index: int, parent: int) -> None:
        kind, type_name, name, children = tree
        own = self.new("expr")
        self.add("exprs", own, kind, type_name, parent, index)
        self.inside(own)
        if name is not None:
            self.add("namestrings", name, name, own)
        for k, c in enumerate(children):
            if callable(c):
                c(own, k)
            else:
                self.emit(c, k, own)

    def initialiser(self) -> tuple:
        if self.peek() != "{":
            return self.assignment()
        self.take()
        items = []
        while not self.skip("}"):
            items.append(self.initialiser())
            if self.peek() != "}":
                self.take(",")
        return ARRAY_INIT, "", None, items

    def assignment(self) -> tuple:
        if self.lambda_ahead():
            return self.function()
        left = self.conditional()
        if self.kind() == "sign" and self.peek() == ">" and self.peek(1) in (">=", ">"):
            return left
        if self.kind() == "sign" and self.peek() in ASSIGNMENT:
            return ASSIGNMENT[self.take()], left[1], None, [left, self.assignment()]
        return left

    def lambda_ahead(self) -> bool:
        if self.kind() == "name" and self.peek(1) == "->":
            return True
        if self.peek() != "(":
            return False
        depth, k = 0, 0
        while self.kind(k) != "end":
            depth += (self.peek(k) == "(") - (self.peek(k) == ")")
            k += 1
            if depth == 0:
                return self.peek(k) == "->"
        return False

    def function(self) -> tuple:
        if self.peek() == "(":
            self.group()
        else:
            self.take()
        self.take("->")
        if self.peek() == "{":
            begin = self.at
            self.group()
            end = self.at

            def body(own: int, k: int) -> None:
                self.at = begin
                self.statement(own, k)
                self.at = end

            # Statements need their parent's id, so the block is read again when the lambda has one.
            return LAMBDA, "", None, [lambda own, k: self.again(body, own, k)]
        return LAMBDA, "", None, [self.assignment()]

    def again(self, body, own: int, k: int) -> None:
        here = self.at
        body(own, k)
        self.at = here

    def conditional(self) -> tuple:
        left = self.binary(0)
        if self.skip("?"):
            then = self.assignment()
            self.take(":")
            return CONDITIONAL, then[1], None, [left, then, self.assignment()]
        return left

    def shift(self) -> str | None:
        """`>>` and `>>>` are signs of their own here only, as `>` closes generic arguments."""
        for op in (">>>", ">>"):
            if all(self.peek(k) == ">" for k in range(len(op))) and self.peek(len(op)) != ">=":
                return op
        return None

    def binary(self, level: int) -> tuple:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.kind() in ("sign", "name"):
            op = self.peek()
            if op == ">" and (s := self.shift()):
                op = s
            if op not in LEVELS[level]:
                return left
            self.at += len(op) if op in (">>", ">>>") else 1
            if op == "instanceof":
                self.notes()
                t = self.type()
                if self.kind() == "name" and self.peek() not in _WORDS:
                    self.add("localvars", self.new("localvar"), self.take(), t, self.callable)
                elif self.peek() == "(":
                    self.group()
                left = INSTANCEOF, "boolean", None, [left, (TYPE, t, t, [])]
            else:
                left = BINARY[op], "boolean" if level < 2 or level in (5, 6) else left[1], None, [left, self.binary(level + 1)]
        return left

    def cast_ahead(self) -> bool:
        if self.peek() != "(":
            return False
        end = self.type_end(1)
        if end == 1 or self.peek(end) != ")":
            return False
        return self.peek(1) in PRIMITIVES or self.kind(end + 1) in ("name", "string", "char", "number") and self.peek(end + 1) != "instanceof" or self.peek(end + 1) in ("(", "!", "~")

    def unary(self) -> tuple:
        if self.kind() == "sign" and self.peek() in PREFIX:
            op = self.take()
            inner = self.unary()
            return PREFIX[op], inner[1], None, [inner]
        if self.cast_ahead():
            self.take("(")
            t = self.type()
            self.take(")")
            return CAST, t, None, [(TYPE, t, t, []), self.function() if self.lambda_ahead() else self.unary()]
        out = self.primary()
        while self.kind() == "sign":
            if self.peek() in POSTFIX:
                out = POSTFIX[self.take()], out[1], None, [out]
            elif self.skip("["):
                place = self.assignment()
                self.take("]")
                out = ARRAY_ACCESS, out[1].removesuffix("[]"), None, [out, place]
            elif self.skip("."):
                self.at += self.angles()
                if self.peek() == "new":
                    out = self.creation()
                    continue
                name = self.name()
                if name in ("class", "this"):
                    out = (TYPE if name == "class" else THIS), "", None, [out]
                elif self.peek() == "(":
                    out = CALL, "", name, [out, *self.args()]
                else:
                    out = ACCESS, "", name, [out]
            elif self.skip("::"):
                out = LAMBDA, "", self.take(), [out]
            else:
                break
        return out

    def args(self) -> list[tuple]:
        out = []
        self.take("(")
        while not self.skip(")"):
            out.append(self.assignment())
            if self.peek() != ")":
                self.take(",")
        return out

    def creation(self) -> tuple:
        self.take("new")
        self.notes()
        end = self.angles(1)
        while self.peek(end) == "." and self.kind(end + 1) == "name":
            end = self.angles(end + 2)
        name = re.sub(r"<.*>", "", "".join(self.peek(k) for k in range(end)))
        self.at += end
        if self.peek() == "[":
            sizes = []
            dims = ""
            while self.skip("["):
                dims += "[]"
                if self.peek() != "]":
                    sizes.append(self.assignment())
                self.take("]")
            if self.peek() == "{":
                sizes.append(self.initialiser())
            return ARRAY_CREATION, name + dims, None, sizes
        out = NEW, name, None, self.args()
        if self.peek() == "{":
            self.group()
        return out

    def primary(self) -> tuple:
        t = self.tokens[self.at]
        if t.kind == "string":
            return STRING, "String", self.take().strip('"'), []
        if t.kind == "char":
            return CHAR, "char", self.take(), []
        if t.kind == "number":
            text = self.take().lower()
            kind, name = (INT, "int")
            if text.endswith("l"):
                kind, name = LONG, "long"
            elif not text.startswith("0x") and text.endswith("f"):
                kind, name = FLOAT, "float"
            elif not text.startswith("0x") and re.search(r"[.ed]", text):
                kind, name = DOUBLE, "double"
            return kind, name, text, []
        if self.skip("("):
            inner = self.assignment()
            self.take(")")
            return inner
        if t.kind != "name":
            raise SyntaxError(f"unexpected {t.text or 'the end'}")
        if t.text == "new":
            return self.creation()
        if t.text == "switch":
            raise SyntaxError("a switch as a value")
        if self.type_end() > 1 and self.peek(self.type_end()) == "::" or t.text in PRIMITIVES:
            name = self.type()
            return TYPE, name, name, []
        word = self.take()
        if word in ("true", "false"):
            return BOOLEAN, "boolean", word, []
        if word == "null":
            return NULL, "null", word, []
        if word in ("this", "super") and self.peek() != "(":
            return (THIS if word == "this" else SUPER), "", word, []
        if self.peek() == "(":
            return CALL, "", word, self.args()
        return ACCESS, "", word, []
