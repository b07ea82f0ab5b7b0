"""Facts of C sources, by a parser of its own: declarations, statements and expressions of the language's core.

Preprocessor lines other than includes are passed over, so code is taken as written. What the parser doesn't
know is skipped up to the next `;` or block.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from .extract import Facts, entity, extractor

#: The tables, and the kinds of statements, expressions and types.
SCHEME = """
locations_default(unique int id: @location_default, int file: @file ref, int beginLine: int ref, int beginColumn: int ref, int endLine: int ref, int endColumn: int ref);
functions(unique int id: @function, string name: string ref, int kind: int ref);
function_return_type(int id: @function ref, string return_type: string ref);
function_entry_point(int id: @function ref, unique int entry_point: @stmt ref);
#keyset[id, index]
params(int id: @function ref, int index: int ref, string name: string ref, string param_type: string ref);
globalvariables(unique int id: @globalvariable, string name: string ref, string global_type: string ref);
localvariables(unique int id: @localvariable, string name: string ref, string local_type: string ref);
usertypes(unique int id: @usertype, string name: string ref, int kind: int ref);
#keyset[parent, index]
fields(int parent: @usertype ref, int index: int ref, string name: string ref, string field_type: string ref);
enumconstants(unique int id: @enumconstant, int parent: @usertype ref, int index: int ref, string name: string ref, int location: @location_default ref);
stmts(unique int id: @stmt, int kind: int ref, int location: @location_default ref);
stmtparents(unique int id: @stmt ref, int index: int ref, int parent_id: @element ref);
if_then(unique int if_stmt: @stmt ref, int then_id: @stmt ref);
if_else(unique int if_stmt: @stmt ref, int else_id: @stmt ref);
while_body(unique int while_stmt: @stmt ref, int body_id: @stmt ref);
do_body(unique int do_stmt: @stmt ref, int body_id: @stmt ref);
#keyset[for_stmt]
for_body(int for_stmt: @stmt ref, int body_id: @stmt ref);
switch_body(unique int switch_stmt: @stmt ref, int body_id: @stmt ref);
exprs(unique int id: @expr, int kind: int ref, int location: @location_default ref);
exprparents(int expr_id: @expr ref, int child_index: int ref, int parent_id: @element ref);
valuetext(unique int id: @expr ref, string text: string ref);
comments(unique int id: @comment, string contents: string ref, int location: @location_default ref);
includes(unique int id: @include, int file: @file ref, string included: string ref);
element_location(int element: @element ref, int location: @location_default ref);
iscall(unique int caller: @expr ref, int kind: int ref);
enclosingfunction(unique int child: @element ref, int parent: @function ref);
@variable = @globalvariable | @localvariable;
@declaration = @function | @usertype | @variable | @enumconstant;
@element = @declaration | @stmt | @expr | @comment | @include;
"""
STRUCT, UNION, ENUM = 1, 3, 4
EXPR_STMT, IF, WHILE, GOTO, LABEL, RETURN, BLOCK, DO, FOR, CASE, SWITCH, DECLARATION, CONTINUE, BREAK = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 17, 27, 28
PREFIX = {"&": 2, "*": 4, "!": 13, "~": 14, "-": 15, "+": 16, "++": 20, "--": 21}
POSTFIX = {"++": 22, "--": 23}
BINARY = {"+": 25, "-": 26, "*": 27, "/": 28, "%": 29, "&": 39, "|": 40, "^": 41, "<<": 42, ">>": 43, "==": 44, "!=": 45, "<": 46, ">": 47, "<=": 48, ">=": 49, "&&": 65, "||": 66}
ASSIGNMENT = {"=": 52, "+=": 53, "-=": 54, "*=": 55, "/=": 56, "%=": 57, "&=": 58, "|=": 59, "^=": 60, "<<=": 61, ">>=": 62}
PARENTHESES, CONDITIONAL, COMMA, SUBSCRIPT, CALL, ACCESS, SIZEOF, LITERAL, CAST, FIELD = 12, 24, 67, 68, 74, 84, 93, 140, 141, 142
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
TYPE_WORDS = {"void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "bool", "const", "volatile", "static", "extern", "register", "inline", "auto", "restrict", "struct", "union", "enum", "size_t", "FILE"}
_STORAGE = {"static", "extern", "register", "inline", "auto"}
_TOKEN = re.compile(r"(?P<skip>\s+|\\\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<line>\#(?:[^\n\\]|\\.|\\\n)*)|(?P<string>L?\"(?:[^\"\\\n]|\\.)*\")|(?P<char>L?'(?:[^'\\\n]|\\.)*')|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<name>[A-Za-z_]\w*)|(?P<sign><<=|>>=|\.\.\.|->|\+\+|--|<<|>>|&&|\|\||[<>=!+\-*/%&|^]=|[{}()\[\];,.:?~!<>=+\-*/%&|^])|(?P<other>.)", re.DOTALL)


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int


@extractor("c", SCHEME)
def extract_c(path: str, text: str) -> Facts:
    yield from _Unit(path, text).facts()


class _Unit:
    def __init__(self, path: str, text: str):
        self.path, self.file = path, entity("file", path)
        self.out: list[tuple[str, tuple]] = []
        self.serial: Counter[str] = Counter()
        self.tokens: list[Token] = []
        self.types: set[str] = set(TYPE_WORDS)
        self.function = 0
        self.at = 0
        line, start = 1, 0
        for m in _TOKEN.finditer(text):
            t = Token(m.lastgroup, m[0], line, m.start() - start + 1)
            if m.lastgroup == "comment":
                self.add("comments", self.new("comment"), m[0], self.place(t, t))
            elif m.lastgroup == "line":
                if include := re.match(r"#\s*include\s*[<\"]([^>\"]+)", m[0]):
                    self.add("includes", self.new("include"), self.file, include[1])
            elif m.lastgroup != "skip":
                self.tokens.append(t)
            if (n := m[0].count("\n")) > 0:
                line, start = line + n, m.start() + m[0].rfind("\n") + 1
        self.tokens.append(Token("end", "", line, 1))

    # Output

    def new(self, kind: str) -> int:
        self.serial[kind] += 1
        return entity(self.path, "c", kind, self.serial[kind])

    def add(self, relation: str, *cells: object) -> None:
        self.out.append((relation, cells))

    def place(self, a: Token, b: Token) -> int:
        own = entity(self.path, "location", a.line, a.column, b.line, b.column + len(b.text) - 1)
        self.add("locations_default", own, self.file, a.line, a.column, b.line, b.column + len(b.text) - 1)
        return own

    def located(self, own: int, begin: int) -> int:
        where = self.place(self.tokens[begin], self.tokens[max(begin, self.at - 1)])
        self.add("element_location", own, where)
        return where

    def within(self, own: int) -> None:
        if self.function:
            self.add("enclosingfunction", own, self.function)

    # Tokens

    def peek(self, k: int = 0) -> str:
        t = self.tokens[min(self.at + k, len(self.tokens) - 1)]
        return t.text if t.kind not in ("string", "char") else '"'

    def kind(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)].kind

    def take(self, want: str | None = None) -> str:
        t = self.tokens[self.at]
        if t.kind == "end" or (want is not None and t.text != want):
            raise SyntaxError(f"line {t.line}: expected {want}, found {t.text or 'the end'}")
        self.at += 1
        return t.text

    def skip(self, want: str) -> bool:
        if self.peek() == want:
            self.at += 1
            return True
        return False

    def moved(self, before: int) -> None:
        """What a loop reads must take it on."""
        if self.at == before:
            raise SyntaxError(f"line {self.tokens[self.at].line}: unexpected {self.peek() or 'end'}")

    def skip_group(self) -> None:
        """Past a bracketed group that begins here."""
        depth = 0
        while self.kind() != "end":
            t = self.take()
            depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
            if depth == 0:
                return

    def recover(self) -> None:
        while self.kind() != "end" and self.peek() not in (";", "}"):
            if self.peek() in ("{", "(", "["):
                self.skip_group()
                if self.tokens[self.at - 1].text == "}":
                    return
            else:
                self.take()
        if self.kind() != "end":
            self.take()

    # Declarations

    def facts(self) -> Facts:
        while self.kind() != "end":
            begin = self.at
            try:
                self.external()
            except SyntaxError:
                self.function = 0
                self.at = max(self.at, begin)
                self.recover()
            if self.at == begin:
                self.at += 1
        return iter(self.out)

    def is_type(self, k: int = 0) -> bool:
        return self.kind(k) == "name" and self.peek(k) in self.types

    def begins_declaration(self) -> bool:
        if self.is_type():
            return True
        if self.kind() != "name":
            return False
        k = 1
        while self.peek(k) == "*":
            k += 1
        return self.kind(k) == "name" and self.peek(k) not in ("else",) and (k == 1 or self.peek(k + 1) in ("=", ";", ",", "[")) and self.peek() not in ("return", "goto", "case", "else", "sizeof")

    def specifiers(self) -> str:
        words = []
        while self.kind() == "name":
            w = self.peek()
            if w in ("struct", "union", "enum"):
                words.append(self.aggregate())
            elif w in self.types or not words and w != "typedef":
                self.take()
                if w not in _STORAGE:
                    words.append(w)
                    if w not in TYPE_WORDS and self.kind() == "name" and self.peek() not in self.types:
                        break
            else:
                break
        return " ".join(words) or "int"

    def aggregate(self) -> str:
        begin, word = self.at, self.take()
        name = self.take() if self.kind() == "name" else ""
        if self.peek() == "{":
            own = self.new("usertype")
            self.add("usertypes", own, name or f"(unnamed {word})", {"struct": STRUCT, "union": UNION, "enum": ENUM}[word])
            self.take("{")
            index = 0
            while not self.skip("}"):
                if word == "enum":
                    at = self.at
                    constant = self.take()
                    if self.skip("="):
                        self.assignment(0, -1, emit=False)
                    e = self.new("enumconstant")
                    self.add("enumconstants", e, own, index, constant, self.place(self.tokens[at], self.tokens[at]))
                    self.skip(",")
                    index += 1
                    continue
                base = self.specifiers()
                while not self.skip(";"):
                    before = self.at
                    kind, field, _ = self.declarator(base)
                    self.moved(before)
                    if self.skip(":"):
                        self.take()
                    self.add("fields", own, index, field, kind)
                    index += 1
                    self.skip(",")
            self.located(own, begin)
        return f"{word} {name}".strip()

    def declarator(self, base: str) -> tuple[str, str, list | None]:
        """The type, the name and, of a function, its parameters."""
        kind, params = base, None
        while self.peek() in ("*", "const", "volatile", "restrict"):
            if self.take() == "*":
                kind += " *"
        if self.peek() == "(" and self.peek(1) == "*":
            self.take("(")
            while self.skip("*") or self.skip("const"):
                pass
            name = self.take() if self.kind() == "name" else ""
            if self.peek() in ("[", "("):
                self.skip_group()
            self.take(")")
            if self.peek() == "(":
                self.skip_group()
            return f"{kind} (*)()", name, None
        name = self.take() if self.kind() == "name" else ""
        while self.peek() in ("[", "("):
            if self.peek() == "[":
                self.skip_group()
                kind += " []"
            else:
                self.take("(")
                params = []
                while not self.skip(")"):
                    if self.skip("..."):
                        params.append(("...", ""))
                    elif self.peek() == "void" and self.peek(1) == ")":
                        self.take()
                    else:
                        before = self.at
                        own = self.specifiers()
                        t, n, _ = self.declarator(own)
                        params.append((t, n))
                        self.moved(before)
                    self.skip(",")
        return kind, name, params

    def external(self) -> None:
        begin = self.at
        if self.skip(";"):
            return
        if self.skip("typedef"):
            base = self.specifiers()
            while not self.skip(";"):
                before = self.at
                _, name, _ = self.declarator(base)
                self.types.add(name)
                self.moved(before)
                self.skip(",")
            return
        base = self.specifiers()
        while not self.skip(";"):
            kind, name, params = self.declarator(base)
            if params is not None and self.peek() == "{":
                self.body(begin, kind, name, params)
                return
            if params is None and name:
                own = self.new("globalvariable")
                self.add("globalvariables", own, name, kind)
                if self.skip("="):
                    self.initialiser(own)
                self.located(own, begin)
            if not self.skip(",") and self.peek() != ";":
                raise SyntaxError(f"line {self.tokens[self.at].line}: a declaration goes on with {self.peek()}")

    def body(self, begin: int, kind: str, name: str, params: list) -> None:
        own = self.new("function")
        self.add("functions", own, name, 1)
        self.add("function_return_type", own, kind)
        for k, (t, n) in enumerate(params):
            self.add("params", own, k, n, t)
        self.function = own
        block = self.statement(own, 0)
        self.add("function_entry_point", own, block)
        self.function = 0
        self.located(own, begin)

    def initialiser(self, parent: int) -> None:
        if self.peek() == "{":
            self.skip_group()
        else:
            self.assignment(0, parent)

    # Statements

    def statement(self, parent: int, index: int) -> int:
        begin, word, own = self.at, self.peek(), self.new("stmt")
        kind = self.statement_of(word, own)
        where = self.located(own, begin)
        self.add("stmts", own, kind, where)
        self.add("stmtparents", own, index, parent)
        self.within(own)
        return own

    def condition(self, own: int, index: int = 0) -> None:
        self.take("(")
        self.expression(index, own)
        self.take(")")

    def statement_of(self, word: str, own: int) -> int:
        if word == "{":
            self.take()
            k = 0
            while not self.skip("}"):
                begin = self.at
                try:
                    self.statement(own, k)
                except SyntaxError:
                    if self.kind() == "end":
                        raise
                    self.at = max(self.at, begin)
                    self.recover()
                k += 1
            return BLOCK
        if self.kind() == "name":
            match word:
                case "if":
                    self.take()
                    self.condition(own)
                    self.add("if_then", own, self.statement(own, 1))
                    if self.skip("else"):
                        self.add("if_else", own, self.statement(own, 2))
                    return IF
                case "while" | "switch":
                    self.take()
                    self.condition(own)
                    self.add("while_body" if word == "while" else "switch_body", own, self.statement(own, 1))
                    return WHILE if word == "while" else SWITCH
                case "do":
                    self.take()
                    self.add("do_body", own, self.statement(own, 0))
                    self.take("while")
                    self.condition(own, 1)
                    self.take(";")
                    return DO
                case "for":
                    self.take()
                    self.take("(")
                    if self.peek() != ";":
                        self.statement(own, 0)
                    else:
                        self.take()
                    for k, end in ((1, ";"), (2, ")")):
                        if self.peek() != end:
                            self.expression(k, own)
                        self.take(end)
                    self.add("for_body", own, self.statement(own, 3))
                    return FOR
                case "return":
                    self.take()
                    if self.peek() != ";":
                        self.expression(0, own)
                    self.take(";")
                    return RETURN
                case "break" | "continue":
                    self.take()
                    self.take(";")
                    return BREAK if word == "break" else CONTINUE
                case "goto":
                    self.take()
                    self.take()
                    self.take(";")
                    return GOTO
                case "case" | "default":
                    self.take()
                    if word == "case":
                        self.conditional(0, own)
                    self.take(":")
                    return CASE
            if self.peek(1) == ":" and not self.is_type():
                self.take()
                self.take()
                return LABEL
            if self.begins_declaration():
                self.locals()
                return DECLARATION
        if self.skip(";"):
            return EXPR_STMT
        self.expression(0, own)
        self.take(";")
        return EXPR_STMT

    def locals(self) -> None:
        base = self.specifiers()
        while not self.skip(";"):
            begin = self.at
            kind, name, _ = self.declarator(base)
            own = self.new("localvariable")
            self.add("localvariables", own, name, kind)
            self.within(own)
            if self.skip("="):
                self.initialiser(own)
            self.located(own, begin)
            if not self.skip(",") and self.peek() != ";":
                raise SyntaxError(f"line {self.tokens[self.at].line}: a declaration goes on with {self.peek()}")

    # Expressions: built as trees first, as a parent is known after its first child

    def expression(self, index: int, parent: int) -> None:
        begin = self.at
        tree = self.tree_assignment()
        while self.peek() == ",":
            self.take()
            tree = self.node(begin, COMMA, [tree, self.tree_assignment()])
        self.emit(tree, index, parent)

    def assignment(self, index: int, parent: int, emit: bool = True) -> None:
        tree = self.tree_assignment()
        if emit:
            self.emit(tree, index, parent)

    def conditional(self, index: int, parent: int) -> None:
        self.emit(self.tree_conditional(), index, parent)

    def node(self, begin: int, kind: int, children: list, text: str | None = None) -> tuple:
        return begin, self.at - 1, kind, children, text

    def emit(self, tree: tuple, index: int, parent: int) -> None:
        begin, last, kind, children, text = tree
        own = self.new("expr")
        where = self.place(self.tokens[begin], self.tokens[last])
        self.add("exprs", own, kind, where)
        self.add("element_location", own, where)
        self.add("exprparents", own, index, parent)
        self.within(own)
        if text is not None:
            self.add("valuetext", own, text)
        if kind == CALL:
            self.add("iscall", own, 0)
        for k, c in enumerate(children):
            self.emit(c, k, own)

    def tree_assignment(self) -> tuple:
        begin, left = self.at, self.tree_conditional()
        if self.kind() == "sign" and self.peek() in ASSIGNMENT:
            op = self.take()
            return self.node(begin, ASSIGNMENT[op], [left, self.tree_assignment()])
        return left

    def tree_conditional(self) -> tuple:
        begin, left = self.at, self.tree_binary(0)
        if self.skip("?"):
            then = self.tree_assignment()
            self.take(":")
            return self.node(begin, CONDITIONAL, [left, then, self.tree_conditional()])
        return left

    def tree_binary(self, level: int) -> tuple:
        if level == len(LEVELS):
            return self.tree_unary()
        begin, left = self.at, self.tree_binary(level + 1)
        while self.kind() == "sign" and self.peek() in LEVELS[level]:
            op = self.take()
            left = self.node(begin, BINARY[op], [left, self.tree_binary(level + 1)])
        return left

    def is_cast(self) -> bool:
        if self.peek() != "(" or not self.is_type(1):
            return False
        k = 2
        while self.kind(k) == "name" or self.peek(k) == "*":
            k += 1
        return self.peek(k) == ")"

    def tree_unary(self) -> tuple:
        begin = self.at
        if self.kind() == "sign" and self.peek() in PREFIX:
            op = self.take()
            return self.node(begin, PREFIX[op], [self.tree_unary()])
        if self.peek() == "sizeof" and self.kind() == "name":
            self.take()
            if self.peek() == "(" and self.is_type(1):
                self.skip_group()
                return self.node(begin, SIZEOF, [])
            return self.node(begin, SIZEOF, [self.tree_unary()])
        if self.is_cast():
            self.skip_group()
            return self.node(begin, CAST, [self.tree_unary()])
        return self.tree_postfix()

    def tree_postfix(self) -> tuple:
        begin, out = self.at, self.tree_primary()
        while self.kind() == "sign":
            if self.skip("("):
                args = []
                while not self.skip(")"):
                    args.append(self.tree_assignment())
                    if self.peek() != ")":
                        self.take(",")
                out = self.node(begin, CALL, [out, *args])
            elif self.skip("["):
                place = self.tree_assignment()
                self.take("]")
                out = self.node(begin, SUBSCRIPT, [out, place])
            elif self.peek() in (".", "->"):
                self.take()
                name = self.take()
                out = self.node(begin, FIELD, [out], name)
            elif self.peek() in POSTFIX:
                op = self.take()
                out = self.node(begin, POSTFIX[op], [out])
            else:
                break
        return out

    def tree_primary(self) -> tuple:
        begin, t = self.at, self.tokens[self.at]
        if t.kind in ("string", "char", "number"):
            text = self.take()
            while t.kind == "string" and self.kind() == "string":
                text += self.take()
            return self.node(begin, LITERAL, [], text)
        if t.kind == "name":
            self.take()
            return self.node(begin, ACCESS, [], t.text)
        if self.skip("("):
            inner = self.tree_assignment()
            while self.skip(","):
                inner = self.node(begin, COMMA, [inner, self.tree_assignment()])
            self.take(")")
            return self.node(begin, PARENTHESES, [inner])
        raise SyntaxError(f"line {t.line}: unexpected {t.text or 'end'}")
