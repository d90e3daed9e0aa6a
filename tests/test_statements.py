"""Strings over several lines and open brackets, against Python's own parser."""

import ast

import pytest

from tesserine.operators import structure

SOURCES = {
    "docs.py": '''"""Module text.

for every reader
if they like: def not_code():
"""
import os


class Base(
    dict,
    object,
):
    """Class text
    class Inner:
        while it lasts
    """

    def run(
        self,
        first: int,
        second: str = "a, b",  # for later
        *,
        third: dict[str, int] | None = None,
    ) -> int:
        """Do it.

        for a in b
        if c
        """
        if first:
            for x in [
                y
                for y in range(10)
                if y
            ]:
                print(x)
        return 1

    def last(self):
        \'\'\'one's "text"
        while here
        \'\'\'


def short(a, b=(1, 2)): return a
''',
    "imports.py": """from typing import (
    List,
    Dict as D,  # for maps
)
from a.b import c, d
import e as f, g
text = "it's"
value = call(
    one,
    two)
def after(x): pass
""",
}


def outline(source):
    tree = ast.parse(source)
    functions = {(n.name, n.lineno, n.end_lineno, tuple(a.arg for a in n.args.args), n.returns.id if n.returns else None) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}
    classes = {(n.name, n.lineno, n.end_lineno, len(n.bases)) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
    modules = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
    modules += [f"{n.module}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names]
    return functions, classes, sorted(modules)


@pytest.mark.parametrize("name", list(SOURCES))
def test_outline_equals_the_parser(files, name):
    f = files({name: SOURCES[name]})
    functions, classes, modules = outline(SOURCES[name])
    assert {(r.name, r.start_line, r.end_line, tuple(r.parameters), r.return_type) for r in structure.functions_py(f).collect()} == functions
    assert {(r.name, r.start_line, r.end_line, r.inheritance_depth) for r in structure.classes_py(f).collect()} == classes
    assert sorted(r.module for r in structure.imports_py(f).collect()) == modules


def test_text_is_not_code(files):
    f = files({"docs.py": SOURCES["docs.py"]})
    cyclomatic = {r.name: r.cyclomatic for r in structure.functions_py(f).collect()}
    assert cyclomatic == {"run": 3, "last": 1, "short": 1}
    assert structure.file_metrics_py(f).first().cyclomatic == 3
    assert {r.cyclomatic for r in structure.file_facts(f).collect()} == {3}


def test_odd_texts(files):
    text = {"a.py": '"""never closed\nif x:\n', "b.py": "((((((\n)\nif y:\n  pass", "c.py": "", "d.py": "s = '''a'''\nif s: pass", "e.py": 'x = """' + 'a "quote" \\" b\n' * 3000 + '"""\nif x: pass', "f.py": "call(" + "a,\n" * 3000 + ")\nif x: pass"}
    got = {r.file_path: r.cyclomatic for r in structure.file_metrics_py(files(text)).collect()}
    assert got == {"a.py": 2, "b.py": 2, "c.py": 1, "d.py": 2, "e.py": 2, "f.py": 2}
