"""Structure operators against Python's own parser on well-formed files."""

import ast

from tesserine.operators import ruleset, smells, structure
from tesserine.sources import snippets

SOURCES = {f"m{i}.py": s for i, s in enumerate(snippets.PY)}
SOURCES["multi.py"] = '''class A(B, metaclass=M):
    """Doc."""

    @staticmethod
    def one(a, b: Dict[str, int] = None, *args, c=1, **kw) -> str:
        for x in a:
            if x:
                while b:
                    pass
            # low comment
        return call(
            a,
        )

    def two(self, p, /, q):
        try:
            return 1
        except ValueError:
            return 2


def outer(n):
    def inner(m):
        if m and n or m:
            return 1
    return inner
'''


def parsed():
    for path, text in SOURCES.items():
        try:
            yield path, ast.parse(text)
        except SyntaxError:
            continue


def test_functions_match_the_parser(files):
    want = set()
    for path, tree in parsed():
        for n in ast.walk(tree):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                cc = 1 + sum(isinstance(c, ast.If | ast.For | ast.While | ast.ExceptHandler) for c in ast.walk(n))
                static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in n.decorator_list)
                want.add((path, n.name, n.lineno, n.end_lineno, cc, tuple(a.arg for a in n.args.args), static, isinstance(n, ast.AsyncFunctionDef)))
    good = {p for p, _ in parsed()}
    assert len(good) >= 10
    got = {(r.file_path, r.name, r.start_line, r.end_line, r.cyclomatic, tuple(r.parameters), r.is_static, r.is_async)
           for r in structure.functions_py(files(SOURCES)).collect() if r.file_path in good}
    assert got == want


def test_classes_match_the_parser(files):
    want = {(p, n.name, n.lineno, n.end_lineno, len(n.bases), sum(isinstance(b, ast.FunctionDef | ast.AsyncFunctionDef) for b in n.body))
            for p, tree in parsed() for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
    good = {p for p, _ in parsed()}
    got = {(r.file_path, r.name, r.start_line, r.end_line, r.inheritance_depth, r.method_count) for r in structure.classes_py(files(SOURCES)).collect() if r.file_path in good}
    assert got == want


def test_imports_match_the_parser(files):
    want = set()
    for p, tree in parsed():
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                want |= {(p, a.name) for a in n.names}
            elif isinstance(n, ast.ImportFrom):
                want |= {(p, f"{n.module}.{a.name}") for a in n.names}
    good = {p for p, _ in parsed()}
    assert {(r.file_path, r.module) for r in structure.imports_py(files(SOURCES)).collect() if r.file_path in good} == want


def test_cognitive_bounds(files):
    c = {r.file_path: r.cognitive for r in structure.cognitive_py(files({
        "plain.py": "def f():\n    return 1\n", "nested.py": "def f(a):\n    if a:\n        for x in a:\n            pass\n", "bool.py": "if a and b or c:\n    pass\n"})).collect()}
    assert c == {"plain.py": 0, "nested.py": 3, "bool.py": 3}


def test_smells(files, spark):
    got = {(r.owner, r.name) for r in smells.all_smells(files(SOURCES), ruleset.builtin(spark)).collect() if r.owner}
    assert {("many", "Long Method"), ("many", "Too Many Parameters"), ("Huge", "Deep Inheritance"), ("Huge", "Too Many Methods"), ("deep", "Deep Nesting"),
            ("branchy", "High Cyclomatic Complexity")} <= got


def test_brace_languages(files):
    f = files({"a.js": "\n".join(snippets.JS), "b.js": "function f() {\n" + "x;\n" * 10 + "}\n"})
    long = structure.long_function_js(f).collect()
    assert [(r.file_path, r.lines) for r in long] == [("a.js", 57)]
    assert {r.module for r in structure.imports_js(f).collect()} == {"react", "./util", "fs"}
    m = structure.file_metrics_js(files({"c.js": "// c\n\nif (a) {\n}\n"})).collect()[0]
    assert (m.total_lines, m.blank_lines, m.comment_lines, m.cyclomatic) == (5, 2, 1, 2)
