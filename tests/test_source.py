"""No module defines a name twice: the later definition would silently win."""

import ast
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_are_defined_once():
    kinds = (ast.FunctionDef, ast.ClassDef)
    for path in [*ROOT.glob("*.py"), *ROOT.glob("weft/**/*.py"), *ROOT.glob("tests/**/*.py")]:
        tree = ast.parse(path.read_text())
        for body in [tree.body, *(n.body for n in tree.body if isinstance(n, ast.ClassDef))]:
            twice = [k for k, n in Counter(x.name for x in body if isinstance(x, kinds)).items() if n > 1]
            assert not twice, (path, twice)
