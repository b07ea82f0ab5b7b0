"""Facts of Python sources, from the standard library's own parser."""

from __future__ import annotations

import ast
import io
import tokenize
from collections import Counter

from .extract import Facts, entity, extractor

#: The tables, and the kinds of statements, expressions, parameters and imports.
SCHEME = """
locations_default(unique int id: @location_default, int file: @file ref, int beginLine: int ref, int beginColumn: int ref, int endLine: int ref, int endColumn: int ref);
hasLocation(int locatableid: @locatable ref, int id: @location_default ref);
py_Modules(unique int id: @py_Module, int kind: int ref, string name: string ref, int file: @file ref);
py_Functions(unique int id: @py_Function, string name: string ref, int parent: @py_scope ref, int idx: int ref);
py_function_is_async(unique int id: @py_Function ref);
py_Classes(unique int id: @py_Class, string name: string ref, int parent: @py_scope ref, int idx: int ref);
py_base_classes(int classid: @py_Class ref, int idx: int ref, string name: string ref);
#keyset[parent,idx]
py_stmts(unique int id: @py_stmt, int kind: int ref, int parent: @py_scope ref, int idx: int ref);
#keyset[parent,idx]
py_exprs(unique int id: @py_expr, int kind: int ref, int parent: @py_element ref, int idx: int ref);
#keyset[parentid,idx]
py_parameters(unique int id: @py_parameter, string name: string ref, int idx: int ref, int parentid: @py_Function ref, int kind: int ref);
py_parameter_defaults(unique int id: @py_parameter ref, string defaultText: string ref);
py_parameter_annotations(unique int id: @py_parameter ref, string annotationText: string ref);
py_variables(unique int id: @py_variable, string name: string ref, int scope: @py_scope ref);
py_imports(unique int id: @py_import, int kind: int ref, string moduleName: string ref, int parent: @py_scope ref, int idx: int ref);
py_import_names(int importid: @py_import ref, int idx: int ref, string name: string ref, string alias: string ref);
py_decorators(unique int id: @py_decorator, int parentid: @py_element ref, int idx: int ref, string text: string ref);
py_comments(unique int id: @py_comment, string contents: string ref, int location: @location_default ref);
py_scope_nesting(unique int inner: @py_scope ref, int outer: @py_scope ref);
py_expr_names(unique int id: @py_expr ref, string name: string ref);
py_expr_values(unique int id: @py_expr ref, string value: string ref);
@py_scope = @py_Module | @py_Function | @py_Class;
@py_element = @py_Module | @py_Function | @py_Class | @py_stmt | @py_expr | @py_import | @py_parameter | @py_variable | @py_decorator | @py_comment;
@locatable = @py_element | @file;
"""
STATEMENTS = {"Assign": 0, "Return": 1, "If": 2, "For": 3, "While": 4, "With": 5, "Try": 6, "TryStar": 6, "Raise": 7, "Import": 8, "ImportFrom": 8, "Pass": 9, "Break": 10, "Continue": 11, "Assert": 12, "Expr": 13, "Delete": 14, "Global": 15, "Nonlocal": 16, "AsyncFor": 17, "AsyncWith": 18, "Match": 19, "AugAssign": 20, "AnnAssign": 21}
EXPRESSIONS = {"Call": 0, "Attribute": 1, "Name": 2, "int": 3, "float": 4, "str": 5, "List": 6, "Dict": 7, "Tuple": 8, "Set": 9, "BinOp": 10, "UnaryOp": 11, "BoolOp": 12, "Compare": 13, "Subscript": 14, "Starred": 15, "Yield": 16, "YieldFrom": 16, "Await": 17, "Lambda": 18, "IfExp": 19, "ListComp": 20, "SetComp": 21, "DictComp": 22, "GeneratorExp": 23, "JoinedStr": 24, "NoneType": 25, "true": 26, "false": 27, "ellipsis": 28, "NamedExpr": 29, "Slice": 31, "keyword": 32}
POSITIONAL, KEYWORD, ARGS, KWARGS = 0, 1, 2, 3


@extractor("python", SCHEME)
def extract_python(path: str, text: str) -> Facts:
    yield from _File(path, text).facts()


class _File:
    def __init__(self, path: str, text: str):
        self.path, self.text, self.file = path, text, entity("file", path)
        self.out: list[tuple[str, tuple]] = []
        self.serial: Counter[str] = Counter()
        self.variables: set[tuple[int, str]] = set()
        self.members: Counter[int] = Counter()

    def new(self, kind: str) -> int:
        self.serial[kind] += 1
        return entity(self.path, kind, self.serial[kind])

    def add(self, relation: str, *cells: object) -> None:
        self.out.append((relation, cells))

    def facts(self) -> Facts:
        tree = ast.parse(self.text)
        module = self.new("module")
        self.add("py_Modules", module, 0, self.path.rsplit("/", 1)[-1].removesuffix(".py"), self.file)
        self.block(tree.body, module, module)
        self.comments()
        return iter(self.out)

    def located(self, own: int, line: int, column: int, end: int, end_column: int) -> int:
        place = entity(self.path, "location", line, column, end, end_column)
        self.add("locations_default", place, self.file, line, column, end, end_column)
        if own:
            self.add("hasLocation", own, place)
        return place

    def at(self, own: int, node: ast.AST) -> None:
        if hasattr(node, "lineno"):
            self.located(own, node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset)

    def comments(self) -> None:
        try:
            for t in tokenize.generate_tokens(io.StringIO(self.text).readline):
                if t.type == tokenize.COMMENT:
                    place = self.located(0, t.start[0], t.start[1] + 1, t.end[0], t.end[1])
                    self.add("py_comments", self.new("comment"), t.string, place)
        except (tokenize.TokenError, IndentationError):
            pass

    def block(self, body: list[ast.stmt], scope: int, parent: int) -> None:
        for node in body:
            self.statement(node, scope, parent)

    def next(self, parent: int) -> int:
        self.members[parent] += 1
        return self.members[parent] - 1

    def statement(self, node: ast.stmt, scope: int, parent: int) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return self.function(node, scope)
        if isinstance(node, ast.ClassDef):
            return self.klass(node, scope)
        own = self.new("stmt")
        self.add("py_stmts", own, STATEMENTS.get(type(node).__name__, 13), parent, self.next(parent))
        self.at(own, node)
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            self.imports(node, scope)
            return None
        k = 0
        for name, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.expr):
                    self.expression(x, own, k, scope)
                    k += 1
                elif isinstance(x, ast.stmt):
                    self.statement(x, scope, own)
                elif isinstance(x, (ast.ExceptHandler, ast.withitem, ast.match_case)):
                    k = self.part(x, own, k, scope)
        return None

    def part(self, node: ast.AST, own: int, k: int, scope: int) -> int:
        """Handlers, items of with and cases: their expressions and statements are the statement's."""
        if isinstance(node, ast.ExceptHandler) and node.name:
            self.variable(node.name, scope)
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.expr):
                self.expression(x, own, k, scope)
                k += 1
            elif isinstance(x, ast.stmt):
                self.statement(x, scope, own)
        return k

    def imports(self, node: ast.Import | ast.ImportFrom, scope: int) -> None:
        groups = [(0, a.name, [a]) for a in node.names] if isinstance(node, ast.Import) else [(1, "." * node.level + (node.module or ""), node.names)]
        for kind, module, names in groups:
            own = self.new("import")
            self.add("py_imports", own, kind, module, scope, self.next(scope))
            self.at(own, node)
            for k, a in enumerate(names):
                self.add("py_import_names", own, k, a.name, a.asname or "")

    def scoped(self, own: int, outer: int, node: ast.AST) -> None:
        self.add("py_scope_nesting", own, outer)
        self.at(own, node)
        for k, d in enumerate(node.decorator_list):
            mark = self.new("decorator")
            self.add("py_decorators", mark, own, k, ast.unparse(d))
            self.at(mark, d)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, scope: int) -> None:
        own = self.new("function")
        self.add("py_Functions", own, node.name, scope, self.next(scope))
        if isinstance(node, ast.AsyncFunctionDef):
            self.add("py_function_is_async", own)
        self.scoped(own, scope, node)
        self.parameters(node.args, own)
        self.block(node.body, own, own)

    def parameters(self, args: ast.arguments, own: int) -> None:
        plain = [*args.posonlyargs, *args.args]
        defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        every = [(a, POSITIONAL, x) for a, x in zip(plain, defaults)]
        every += [(args.vararg, ARGS, None)] * bool(args.vararg) + [(a, KEYWORD, x) for a, x in zip(args.kwonlyargs, args.kw_defaults)] + [(args.kwarg, KWARGS, None)] * bool(args.kwarg)
        for k, (a, kind, default) in enumerate(every):
            p = self.new("parameter")
            self.add("py_parameters", p, a.arg, k, own, kind)
            self.at(p, a)
            if default is not None:
                self.add("py_parameter_defaults", p, ast.unparse(default))
            if a.annotation is not None:
                self.add("py_parameter_annotations", p, ast.unparse(a.annotation))

    def klass(self, node: ast.ClassDef, scope: int) -> None:
        own = self.new("class")
        self.add("py_Classes", own, node.name, scope, self.next(scope))
        self.scoped(own, scope, node)
        for k, b in enumerate(node.bases):
            self.add("py_base_classes", own, k, ast.unparse(b))
        self.block(node.body, own, own)

    def variable(self, name: str, scope: int) -> None:
        if (scope, name) not in self.variables:
            self.variables.add((scope, name))
            self.add("py_variables", self.new("variable"), name, scope)

    def expression(self, node: ast.AST, parent: int, k: int, scope: int) -> None:
        own, kind = self.new("expr"), type(node).__name__
        if isinstance(node, ast.Constant):
            v = node.value
            kind = {True: "true", False: "false"}[v] if isinstance(v, bool) else "ellipsis" if v is ... else "float" if isinstance(v, complex) else "str" if isinstance(v, bytes) else type(v).__name__
            if isinstance(v, (int, float, str, bytes, complex)) and not isinstance(v, bool):
                self.add("py_expr_values", own, v if isinstance(v, str) else ast.unparse(node))
        self.add("py_exprs", own, EXPRESSIONS.get(kind, 10), parent, k)
        self.at(own, node)
        if isinstance(node, ast.Name):
            self.add("py_expr_names", own, node.id)
            if isinstance(node.ctx, ast.Store):
                self.variable(node.id, scope)
        elif isinstance(node, ast.Attribute):
            self.add("py_expr_names", own, node.attr)
        elif isinstance(node, ast.keyword) and node.arg:
            self.add("py_expr_names", own, node.arg)
        n = 0
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.expr, ast.keyword)):
                self.expression(x, own, n, scope)
                n += 1
            elif isinstance(x, ast.comprehension):
                for e in (x.target, x.iter, *x.ifs):
                    self.expression(e, own, n, scope)
                    n += 1
