"""The programs of the records, run in a process of their own on right and wrong submissions."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import harness, records
from corpusmill.functions.rules import at_least, drop_at_most, within


def passes(template, code):
    program = template.replace(harness.PLACE, repr(code))
    run = subprocess.run([sys.executable, "-"], input=program, text=True, capture_output=True, timeout=60)
    said = "ALL TESTS PASSED" in run.stdout
    assert not (said and run.returncode), run.stderr
    return said


TESTS = """
import pytest
import unittest
from solution import add

@pytest.fixture
def one():
    yield 1

@pytest.mark.parametrize("a, b", [(1, 2), (3, 4)])
def test_sum(a, b):
    assert add(a, b) == a + b

@pytest.mark.parametrize("a", [0, pytest.param(5)])
def test_fixture(one, a):
    assert add(one, a) == pytest.approx(a + 1.0)

def test_error():
    with pytest.raises(TypeError, match="unsupported|can only"):
        add(1, "x")

def test_printed(capsys, monkeypatch):
    monkeypatch.setenv("A_NAME", "b")
    print(add(1, 1))
    assert capsys.readouterr().out == "2\\n"

@pytest.mark.skip(reason="never")
def test_skipped():
    assert False

class TestMore:
    def setup_method(self):
        self.x = 2

    def test_method(self):
        assert add(self.x, 1) == 3

class Case(unittest.TestCase):
    def test_case(self):
        self.assertEqual(add(2, 2), 4)
""".replace("\\\\n", "\\n")
RIGHT, WRONG = "def add(a, b):\n    return a + b\n", "def add(a, b):\n    return a + b if a < 3 else 0\n"


def exercise(spark, **row):
    base = {"row_id": 1, "style": "instruct", "question": "Add two numbers. It's \u2028 \\ \"quoted\"", "test": TESTS, "gpt_pass_percentage": 0.5, "benchmark_similarity": 0.1, "question_id": "q", "subset": None, "gpt_difficulty": None}
    schema = "row_id long, style string, question string, test string, gpt_pass_percentage double, benchmark_similarity double, question_id string, subset string, gpt_difficulty string"
    df = spark.createDataFrame([base | row], schema)
    return df.withColumn("test_info", F.expr("array(named_struct('docstring', '', 'function_declaration', '', 'function_name', 'add'))"))


def test_pytest_program(spark):
    records_of = lambda df: records.rl_records(records.rl_decisions(df, None, ["instruct", "complete"], forbid=False)).first()
    row = records_of(exercise(spark))
    template = row["test_program_template"]
    assert row["template_chars"] == len(template) and row["num_tests"] == 7 and row["entry_point"] == "add"
    assert passes(template, RIGHT) and passes(template, '"""Sums."""\nfrom __future__ import annotations\n\n\n' + RIGHT.replace("a, b", "a: Later, b", 1)) and passes(template, RIGHT.replace("a, b", "a: Later, b", 1))
    for wrong in (WRONG, "", "def add(a, b:\n", "print('ALL TESTS PASSED')", "raise SystemExit(0)", "def add(a, b):\n    return str(a + b)"):
        assert not passes(template, wrong), wrong
    assert not passes(records_of(exercise(spark, test="def test_a(): pass\nx = 1")).test_program_template.replace("def test_a()", "def helper()"), RIGHT)
    # The code may be the body that the starter lacks, or the whole function.
    starter = records_of(exercise(spark, style="complete", question='def add(a: List[int], b):\n    """Sum."""\n'))["test_program_template"]
    assert passes(starter, "return a + b") and passes(starter, "    c = a + b\n    return c") and passes(starter, RIGHT) and not passes(starter, "return a - b")


PROBLEM = "problem string, tests string, starter_code string, func_name string, source string"


def problem(spark, tests, func_name=None, source="taco", **options):
    df = spark.createDataFrame([("Sum the numbers", tests if isinstance(tests, str) else json.dumps(tests), None, func_name, source)], PROBLEM)
    return records.problem_decisions(df, **options)


ADD = "def add(a, b):\n    return a + b"


@pytest.mark.parametrize(
    ("tests", "func_name", "source", "right", "wrong"),
    [
        ([{"input": "1 2\n", "output": "3\n"}, {"input": "2 2", "output": "4 \n\n"}], None, "taco", "a, b = map(int, input().split())\nprint(a + b)\nprint()", "print(3)"),
        ({"inputs": ["1 2\n"], "outputs": ["3\n"]}, None, "taco", "print(sum(map(int, input().split())))", "import sys\nprint(3)\nsys.exit(2)"),
        ({"fn_name": "add", "inputs": [[1, 2], [0, 0]], "outputs": [[3], [0]]}, None, "taco", ADD, "def add(a, b):\n    return 3"),
        ([{"type": "function_call", "fn_name": "add", "input": [1, 2], "output": [3]}], None, "taco", "class Solution:\n    def add(self, a: List[int], b):\n        return a + b", "def plus(a, b):\n    return a + b"),
        ([{"testtype": "functional", "input": "[1, 2]\n3", "output": "6"}], "add", "lcbv5", "class Solution:\n    def add(self, a, b):\n        return sum(a) + b", "def add(a, b):\n    return sum(a) + b"),
    ],
)
def test_case_programs(spark, tests, func_name, source, right, wrong):
    row = records.problem_records(problem(spark, tests, func_name, source)).first()
    assert row["template_chars"] == len(row["test_program_template"]) and row["num_tests"] == (len(tests) if isinstance(tests, list) else len(tests["inputs"]))
    assert passes(row["test_program_template"], right)
    assert not passes(row["test_program_template"], wrong) and not passes(row["test_program_template"], "")


def test_problem_reasons_and_samples(spark):
    many = [{"input": str(k), "output": str(k)} for k in range(10)]
    reason = lambda *args, **options: problem(spark, *args, **options).first()["reason"]
    row = problem(spark, many, max_cases=4).first()
    assert [json.loads(c["input"]) for c in row["cases"]] == ["0", "3", "6", "9"] and "'9'" not in row["template"]
    assert reason("not json") == "tests_json_error" and reason('"x"') == "unsupported_tests" and reason([]) == "too_few_tests"
    assert reason(many, min_template=10**6) == "easy_template_too_short" and reason(many, max_template=100) == "template_too_long" and reason(many, skip_stdin=True) == "skip_stdin"
    assert reason({"fn_name": "f", "inputs": [1], "outputs": [1]}, skip_functional=True) == "skip_functional" and reason(many, max_case=1) == "too_few_tests" and reason(many) == "kept"
    empty = spark.createDataFrame([], PROBLEM)
    assert records.problem_records(records.problem_decisions(empty)).count() == 0


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([("abc",), ("0.5",), (None,), ("NaN",), ("2",)], "x string")
    flags = df.select(within(F.col("x"), low=0.1).alias("w"), at_least(F.col("x"), 1.0).alias("a"), drop_at_most(F.col("x"), 1).alias("d")).collect()
    assert [tuple(r) for r in flags] == [(False, False, True), (True, False, False), (False, False, True), (True, False, False), (True, True, True)]
