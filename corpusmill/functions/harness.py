"""Programs that test a submission (P22): three templates with a place for the code. They print PASS_LINE only after every test passed.

A template is a column: the fixed text below with the row's data put in as one JSON literal, which Python reads as it is. Nothing is run here;
the program runs wherever the submission would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the submission's literal goes, and the line that says that all tests passed.
PLACE = "{{candidate_code}}"
PASS_LINE = "print('ALL TESTS PASSED')"
DATA = "@DATA@"

#: The submission is module ``solution``; the tests see its names and a stand-in of pytest. Runs test functions with their parameters and
#: fixtures, classes of tests and unittest cases.
PYTEST = '''import __future__
import ast
import contextlib
import inspect
import io
import itertools
import json
import math
import os
import re
import sys
import textwrap
import types
import typing
import unittest

candidate_code = {{candidate_code}}
DATA = json.loads(@DATA@)
STARTING_NAMES = "collections functools heapq itertools math".split()


class Skipped(Exception):
    pass


class Near:
    def __init__(self, wanted, rel, abs):
        self.wanted, self.rel, self.abs = wanted, rel, abs

    def __eq__(self, got):
        wanted = self.wanted
        if isinstance(wanted, dict):
            return isinstance(got, dict) and got.keys() == wanted.keys() and all(Near(v, self.rel, self.abs) == got[k] for k, v in wanted.items())
        if isinstance(wanted, (list, tuple)):
            return len(got) == len(wanted) and all(Near(v, self.rel, self.abs) == g for v, g in zip(wanted, got))
        try:
            return math.isclose(got, wanted, rel_tol=self.rel, abs_tol=self.abs)
        except TypeError:
            return got == wanted


@contextlib.contextmanager
def expecting(kind, match):
    seen = types.SimpleNamespace(value=None, type=None)
    try:
        yield seen
    except kind as error:
        seen.value, seen.type = error, type(error)
        if match is not None and not re.search(match, str(error)):
            raise AssertionError(f"{error!r} does not match {match!r}") from error
    else:
        raise AssertionError(f"{kind} was not raised")


def raises(kind, *call, match=None, **named):
    context = expecting(kind, match)
    if not call:
        return context
    with context:
        call[0](*call[1:], **named)


def skip(reason=""):
    raise Skipped(reason)


def fail(reason=""):
    raise AssertionError(reason)


def parametrize(names, rows, **_):
    names = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    sets = [dict(zip(names, [row] if len(names) == 1 else row)) for row in (getattr(r, "values_given", r) for r in rows)]

    def mark(function):
        function.row_sets = [*getattr(function, "row_sets", ()), sets]
        return function

    return mark


def one_row(*values, **_):
    return types.SimpleNamespace(values_given=values[0] if len(values) == 1 else values)


def fixture(function=None, **_):
    def mark(inner):
        inner.is_fixture = True
        return inner

    return mark(function) if callable(function) else mark


class Marks:
    parametrize = staticmethod(parametrize)

    def skip(self, *args, **_):
        def mark(function):
            function.skipped = True
            return function

        return mark(args[0]) if args and callable(args[0]) else mark

    def skipif(self, condition, **_):
        return self.skip() if condition else lambda function: function

    def __getattr__(self, name):
        return lambda *args, **_: args[0] if len(args) == 1 and callable(args[0]) else lambda function: function


class Patches:
    def __init__(self):
        self.undo = []

    def setattr(self, target, name, *value, **_):
        if isinstance(target, str):
            (target, name), value = target.rsplit(".", 1), (name,)
            target = sys.modules.get(target) or __import__(target, fromlist=["_"])
        old = getattr(target, name)
        self.undo.append(lambda: setattr(target, name, old))
        setattr(target, name, value[0])

    def setitem(self, target, key, value):
        had, old = key in target, target.get(key)
        self.undo.append(lambda: target.__setitem__(key, old) if had else target.pop(key, None))
        target[key] = value

    def setenv(self, key, value):
        self.setitem(os.environ, key, str(value))


class Printed:
    def __init__(self):
        self.out = io.StringIO()

    def readouterr(self):
        text = self.out.getvalue()
        self.out.seek(0), self.out.truncate()
        return types.SimpleNamespace(out=text, err="")


def module_of(name, source, names):
    module = types.ModuleType(name)
    vars(module).update({n: getattr(typing, n) for n in ("Any", "Callable", "Dict", "Iterable", "Iterator", "List", "Optional", "Sequence", "Set", "Tuple", "Union")})
    vars(module).update(names)
    sys.modules[name] = module
    exec(compile(source, name, "exec", flags=__future__.annotations.compiler_flag, dont_inherit=True), vars(module))
    return module


def parsed(code):
    try:
        compile(code, "solution", "exec", dont_inherit=True)
        return ast.parse(code)
    except (SyntaxError, ValueError):
        return None


def submitted():
    code = str(candidate_code or "").strip("\\n").rstrip()
    if not (DATA["complete"] and DATA["starter"].strip()):
        return code.strip()
    whole = parsed(code.strip())
    defined = {node.name for node in whole.body if hasattr(node, "name")} if whole else set()
    if defined & {*DATA["entry_points"], "Solution"} or defined and not DATA["entry_points"]:
        return code.strip()
    # The code is the body that the starter lacks, indented or not, or only from its second line on.
    bodies = [code, "    pass"] if code[:1].isspace() else [textwrap.indent(code, "    "), "    " + code, "    pass"]
    return next((text for body in bodies if parsed(text := DATA["starter"].rstrip() + "\\n" + body)), code)


def given(function, names, stack, known):
    """Arguments of a test: its parameters, else fixtures of the module, else those that every test may have."""
    out = {}
    for name, parameter in inspect.signature(function).parameters.items():
        if name in known:
            out[name] = known[name]
        elif getattr(names.get(name), "is_fixture", False):
            made = names[name](**given(names[name], names, stack, {}))
            if inspect.isgenerator(made):
                generator, made = made, next(made)
                stack.callback(lambda g=generator: next(g, None))
            out[name] = made
        elif name == "monkeypatch":
            patches = Patches()
            stack.callback(lambda p=patches: [undo() for undo in reversed(p.undo)])
            out[name] = patches
        elif name == "capsys":
            printed = Printed()
            stack.enter_context(contextlib.redirect_stdout(printed.out))
            out[name] = printed
        elif parameter.default is parameter.empty and parameter.kind not in (parameter.VAR_POSITIONAL, parameter.VAR_KEYWORD):
            raise AssertionError(f"no fixture {name}")
    return out


def run_one(function, names, around=()):
    done = 0
    for rows in itertools.product(*getattr(function, "row_sets", ())):
        with contextlib.ExitStack() as stack:
            for before, after in around:
                before()
                stack.callback(after)
            try:
                if not getattr(function, "skipped", False):
                    function(**given(function, names, stack, {k: v for row in rows for k, v in row.items()}))
            except (Skipped, unittest.SkipTest):
                pass
        done += 1
    return done


def run_all(names):
    done = 0
    for name, value in list(names.items()):
        if isinstance(value, type) and issubclass(value, unittest.TestCase) and value is not unittest.TestCase:
            result = unittest.TestResult()
            unittest.defaultTestLoader.loadTestsFromTestCase(value).run(result)
            if not result.wasSuccessful():
                raise AssertionError((result.errors + result.failures)[0][1])
            done += result.testsRun
        elif isinstance(value, type) and name.startswith("Test"):
            for method in [m for m in vars(value) if m.startswith("test")]:
                case = value()
                nothing = lambda *_: None
                done += run_one(getattr(case, method), names, [(getattr(case, "setup_method", nothing), getattr(case, "teardown_method", nothing))])
        elif name.startswith("test_") and callable(value):
            done += run_one(value, names)
    return done


pytest = types.ModuleType("pytest")
vars(pytest).update(raises=raises, approx=lambda wanted, rel=1e-6, abs=1e-12, **_: Near(wanted, rel, abs), mark=Marks(), param=one_row, fixture=fixture, skip=skip, fail=fail)
sys.modules["pytest"] = pytest
# What the submission prints is not what this program says.
with contextlib.redirect_stdout(io.StringIO()):
    solution = module_of("solution", submitted(), {n: __import__(n) for n in STARTING_NAMES})
    tests = module_of("tests_of_solution", DATA["tests"], {n: v for n, v in vars(solution).items() if not n.startswith("__")} | {"pytest": pytest})
    if not run_all(vars(tests)):
        raise AssertionError("there is no test")
'''

#: Each case is fed to the submission as a program of its own; outputs are compared without blanks at the ends of lines and of the text.
STDIN = '''import json
import pathlib
import subprocess
import sys
import tempfile

candidate_code = {{candidate_code}}
DATA = json.loads(@DATA@)


def plain(text):
    return "\\n".join(line.rstrip() for line in str(text).strip().splitlines())


with tempfile.TemporaryDirectory() as folder:
    program = pathlib.Path(folder, "program.py")
    program.write_text(candidate_code, encoding="utf-8")
    for number, case in enumerate(DATA["cases"]):
        run = subprocess.run([sys.executable, str(program)], input=str(case["input"]), text=True, capture_output=True, timeout=DATA["seconds"])
        if run.returncode:
            raise AssertionError(f"case {number} ended with {run.returncode}: {run.stderr[-1000:]}")
        if plain(run.stdout) != plain(case["output"]):
            raise AssertionError(f"case {number} gave {plain(run.stdout)!r} instead of {plain(case['output'])!r}")
'''

#: Each case calls the function, or the method of class Solution, and compares what it returns.
FUNCTION = '''import contextlib
import io
import json
import math
import typing

candidate_code = {{candidate_code}}
DATA = json.loads(@DATA@)


def run():
    names = {n: getattr(typing, n) for n in ("Any", "Dict", "List", "Optional", "Set", "Tuple")} | {"math": math, "__name__": "solution"}
    exec(compile(candidate_code, "solution", "exec", dont_inherit=True), names)
    called = None if DATA["in_class"] else names.get(DATA["entry_point"])
    if called is None:
        if "Solution" not in names:
            raise AssertionError("there is no " + ("class Solution" if DATA["in_class"] else f"function {DATA['entry_point']}"))
        called = getattr(names["Solution"](), DATA["entry_point"])
    for number, case in enumerate(DATA["cases"]):
        arguments = case["input"] if isinstance(case["input"], list) else [case["input"]]
        got = called(*arguments)
        if got != case["output"]:
            raise AssertionError(f"case {number} gave {got!r} instead of {case['output']!r}")


# What the submission prints is not what this program says.
with contextlib.redirect_stdout(io.StringIO()):
    run()
'''


def python_literal(c: Column) -> Column:
    """A text as a literal that both JSON and Python read (not byte-equal to Python's own spelling, Q16)."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def filled(template: str, data: Column) -> Column:
    """A template with its data, a JSON text, and the line that says that all tests passed."""
    head, tail = template.split(DATA)
    return F.concat(F.lit(head), python_literal(data), F.lit(f"{tail}\n{PASS_LINE}\n"))


def pytest_program(tests: Column, complete: Column, starter: Column, entry_points: Column) -> Column:
    """The template of exercises with pytest functions; with ``complete`` the code may be the body that the starter lacks."""
    return filled(PYTEST, F.to_json(F.struct(tests.alias("tests"), complete.alias("complete"), starter.alias("starter"), entry_points.alias("entry_points"))))


def _cases(cases: Column) -> Column:
    """An array of cases, whose input and output are JSON texts, as one JSON array."""
    each = F.transform(cases, lambda c: F.concat(F.lit('{"input": '), c["input"], F.lit(', "output": '), c["output"], F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def case_program(task_type: Column, cases: Column, entry_point: Column, in_class: Column, seconds: float = 10.0) -> Column:
    """The template of problems with cases: fed to a program (stdin) or given to a function."""
    fed = F.concat(F.lit(f'{{"seconds": {float(seconds)}, "cases": '), _cases(cases), F.lit("}"))
    called = F.concat(F.lit('{"entry_point": '), python_literal(entry_point), F.lit(', "in_class": '), in_class.cast("string"), F.lit(', "cases": '), _cases(cases), F.lit("}"))
    return F.when(task_type == "stdin", filled(STDIN, fed)).otherwise(filled(FUNCTION, called))
