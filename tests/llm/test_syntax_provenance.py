import random

import pytest

from corpusmill.llm import provenance, syntax

CHECK = syntax.make_checker()
GOOD = {
    "python": ['"""doc\n=======\n"""\nimport os\n\n\ndef f(x, *, y=1):\n    """<<<<<<< not a conflict"""\n    if x: return y\n    return {k: v for k, v in x.items()}  # (\n', "x = [1,\n     2]\n", "async def f():\n    return await g()\n", "@d\nclass A(B):\n    x: int = 0\n", "print('a' 'b')\nx = 0x1F + 1_000 + 1e5\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\n", "if a \\\n   and b:\n    pass\n", "# only a comment\n"],
    "javascript": ['"use strict";\nconst RX = /[{(]/g;\nconst f = async (x) => `a ${x} b`;\nfor (const [k, v] of m) { g(k, v / 2); }\nexport default f;\n', "class A extends B {\n  #x = 1;\n  get y() { return this.#x; }\n}\n", "if (a) return_(b); else c();\nlet s = 'it\\'s';\n", "/* { */ // (\n"],
    "java": ["/*\n=======\nTitle\n it's the {\n */\npackage a.b;\n\nimport java.util.*;\n\npublic class A<T> extends B {\n    char c = '{';\n    int f(int[] x) { return x[0]; }\n}\n", "@Deprecated\npublic final class X {}\nenum Y { A, B }\n"],
    "go": ['package main\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) F(x []int, m map[string]int) (int, error) {\n\treturn x[0], nil\n}\n\nvar x = `raw "`\nconst y = 1\n', "// c\npackage p\n\nfunc init() {\n\tfmt.Sprint(\"(\")\n}\n"],
    "c": ['#include <stdio.h>\n#define X(a) \\\n  don\'t\n\ntypedef struct s { int a; } s_t;\nstatic const int t[] = { 1, 2 };\n\nint main(void)\n{\n    printf("}%c", \'{\');\n    return 0;\n}\n', "u32 f(u32 x);\nlong g(struct s *p)\n{\n    return p->a;\n}\n"],
}
BAD = {
    "python": ["def f(x:\n    return x\n", "def f(x)\n    return x\n", "def f():\nreturn 1\n", "print 'x'\n", "x = 'abc\n", 'x = """abc\n', "if a:\n    b = 1\n<<<<<<< HEAD\n    c = 2\n=======\n    c = 3\n>>>>>>> other\n", "def f():\n", "Some words of prose here.\n", "version: 2\njobs:\n  - name: a b\n", "except E, e:\n    pass\n", "x = (1, 2]\n", "def f():\n        a = 1\n    b = 2\n", "x = 3 +\n", "function f() {\n  return 1;\n}\n"],
    "javascript": ["function f( {\n", "const x = `abc\n", "import os\n\ndef f(x):\n    return x\n", "const a = 1;\n=======\nconst a = 2;\n>>>>>>> x\n", "return (a + b;\n", "Just some text in here.\n", "<html></html>\n", "let x = ;\n", "const f = (x) =>\n"],
    "java": ["package a;\npublic class A {\n", "package main\n\nimport \"fmt\"\n", '"use strict";\nfunction f(a, b) { return a; }\n', "words and words\n", "public class A { String s = \"x; }\n"],
    "go": ["package main\n\nfunc f() {\n", "import os\n", "public class A {\n}\n", "package main\n\nfunc f(x int", 'package main\n\nvar s = "abc\n', "package a.b;\n\npublic class X {\n}\n"],
    "c": ["int main() {\n", "package main\n\nfunc f() int {\n\treturn 1\n}\n", "package a.b;\npublic class A { }\n", "prose in a file\n", "int f(int x)\n", "/* never closed\nint x;\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_accepts(language):
    for text in GOOD[language]:
        assert CHECK(language, text) is None or (language == "python" and syntax.python_accepts(text)), text


@pytest.mark.parametrize("language", BAD)
def test_rejects(language):
    for text in BAD[language]:
        assert CHECK(language, text) is not None, text
        assert language != "python" or not syntax.python_accepts(text), text


def test_python_agrees_with_the_compiler_on_mutations():
    rng = random.Random(11)
    missed = 0
    for _ in range(1500):
        text = rng.choice(GOOD["python"][:6])
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:at] if kind == 0 else text[:at] + text[at + 1 :] if kind == 1 else text[:at] + rng.choice("()[]{}:'\"\n ,=") + text[at:]
        missed += not syntax.python_accepts(text) and CHECK("python", text) is None
    assert missed <= 90


def test_long_text_is_quick():
    import time

    began = time.time()
    for language, text in (("python", "x = '" + "a" * 300_000), ("javascript", "a / b;" * 50_000), ("javascript", "//" * 100_000), ("c", "(" * 100_000), ("python", "[" * 50_000 + "]" * 50_000), ("go", "`" + "\\" * 200_000)):
        CHECK(language, text)
    assert time.time() - began < 20


def test_tables(spark):
    rows = [(1, "a/b", None, "x.py", "def f(:\n"), (2, "a/b", None, "x.PY ", "x = 1\n"), (3, None, None, "x.js", None), (4, None, None, None, "def f(:\n"), (5, "a/b", None, "x.txt", "((("), (6, "a/b", None, "y.py", " \n"), (7, None, "c/d", "z.go", "import os\n"), (7, None, "c/d", "z.go", "import os\n")]
    code = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, max_stars_repo_name string, repo_name string, max_stars_repo_path string, content string, defect string")
    kod = spark.createDataFrame([(1, "x = 1", "def t(:"), (2, None, "")], "row_id long, solution string, test string")
    found = sorted(tuple(r) for r in syntax.found_defects(code, kod).collect())
    assert found == [("code_files", 1, "content"), ("code_files", 7, "content"), ("code_files", 7, "content"), ("kodcode_v1", 1, "test")]
    rates = {(r["repo"], r["language"]): (r["n_checked"], r["n_broken"], r["rate"]) for r in syntax.defect_rates(code).collect()}
    assert rates == {("a/b", "python"): (2, 1, 0.5), ("c/d", "go"): (2, 2, 1.0)}
    assert syntax.found_defects(code.limit(0), kod.limit(0)).count() == 0


def test_lexer_accepts_the_standard_library():
    """Without the compiler's acquittal: the lexer and its rules alone reject no module that Python accepts."""
    import sysconfig
    from pathlib import Path

    check = syntax.make_checker()
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py")) + sorted(Path(sysconfig.get_paths()["stdlib"]).glob("[a-e]*/*.py"))
    texts = [(f.name, f.read_text(encoding="utf-8", errors="replace")) for f in files]
    valid = [(name, t) for name, t in texts if t.strip() and syntax.python_accepts(t)]
    rejected = [name for name, t in valid if check("python", t)]
    assert len(valid) > 150 and len(rejected) <= len(valid) // 100, rejected


def test_lexer_accepts_system_headers():
    from pathlib import Path

    check = syntax.make_checker()
    files = [f for folder in ("", "sys", "linux", "net") for f in sorted(Path("/usr/include", folder).glob("*.h"))]
    texts = [(str(f), f.read_text(encoding="utf-8", errors="replace")) for f in files]
    rejected = [name for name, t in texts if t.strip() and "__cplusplus" not in t and check("c", t)]
    assert len(rejected) <= len(texts) // 50, rejected


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("java", "class A { void f() { int x = ; } }"), ("java", "class A { void f() { foo(1 2); } }"), ("java", "class A { int f() { return x } }"), ("java", "class A { int f() { return (a + * b); } }"), ("java", "class A { int f() { g(a,); } }"),
        ("go", "package a\nfunc f() { x := }\n"), ("go", "package a\nfunc f() int { return g(1 2) }\n"), ("c", "int f() { return 1 +; }"), ("c", "int f() { int x = 3 return x; }"), ("c", "int f() { return x }"), ("javascript", "let a = foo(1 2);"), ("javascript", "const x = a &&;"),
    ],
)
def test_errors_inside_bodies(language, text):
    assert syntax.make_checker()(language, text)


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("java", "import java.util.*;\nenum A { X, Y,; int[] t = {1, 2}; int f(int... a) { for (;;) { x++; if (a == b) break; } return -1; } }"), ("go", "package a\nfunc f(c chan<- int, p *T) (int, error) {\n\tx := []int{1, 2,}\n\tc <- 1\n\treturn x[1:], nil\n}\n"),
        ("c", "#ifdef __cplusplus\nextern \"C\" {\n#endif\n#if A || \\\n  B\nint f(char *, int *p) { return p ? *p : 1; }\n#else\nint f(char *, int *p) {\n#endif\n#ifdef __cplusplus\n}\n#endif\nEND_DECLS\n"), ("javascript", "const f = (a = 1, b) => a++ + b--;\nfor (const x of [1, 2,]) { if (1 in x) y = x / 2; }\n"),
    ],
)
def test_valid_bodies(language, text):
    assert syntax.make_checker()(language, text) is None


HAND = "import os\n\n\ndef load_{0}(path, limit=3):\n    items = []\n    for name in sorted(os.listdir(path)):\n        if name.endswith('.txt') and len(items) < limit:\n            items.append(name)\n    return items\n\n\nclass {1}:\n    def __init__(self, value):\n        self.value = value\n\n    def grow(self, by):\n        self.value += by\n        return self.value\n"
LIBRARY = "# libfoo v1.2.3\n# Distributed under the permissive license of the libfoo authors; see NOTICE.\n" + HAND.format("foo", "Foo")


def test_labels(spark):
    rng = random.Random(1)
    getters = "package wire\n\n" + "".join(f"func (m *T) GetF{k}() int32 {{\n\treturn m.f{k}\n}}\n" for k in range(30))
    minified = "!function(e,t){" + "".join(f"var a{k}=b[{k}];if(c)d={k};" for k in range(80)) + "}(this);"
    blob = "DATA = [\n" + "".join(f"  {rng.random():.4f}, {rng.random():.4f},\n" for _ in range(80)) + "]\n"
    table = HAND.format("t", "T") + "\nSIZES = [1, 2, 3, 5, 8]\n"
    line = HAND.format("u", "U") + "\nWORDS = '" + "|".join(f"word{k}" for k in range(60)) + "'\n"
    mention = HAND.format("v", "V") + "\ndef write(out):\n    out.write('# Generated file. DO NOT EDIT.')  # vendored, minified\n"
    rows = [
        ("src/a.py", HAND.format("a", "A"), "handwritten"), ("src/b.py", "# Code generated by tool v1. DO NOT EDIT.\n" + HAND.format("b", "B"), "generated"), ("wire/c.go", getters, "generated"), ("web/d.js", minified, "minified"),
        ("src/e.py", blob, "blob"), ("lib/node_modules/x/f.py", HAND.format("f", "F"), "vendored"), ("utils/g.py", LIBRARY, "vendored"), ("app/h.py", LIBRARY.split("\n", 2)[2], "vendored"), ("codegen/i.py", table, "handwritten"), ("vendor_portal/j.py", line, "handwritten"),
        ("src/minify_k.py", mention, "handwritten"), ("src/l.py", HAND.format("a", "A"), "handwritten"), (None, HAND.format("m", "M"), "handwritten"), ("vendor/n.py", None, None), ("src/o.py", "  ", None),
    ]
    data = [(k, "o/r", None, path, text, "clash", 0.5) for k, (path, text, _) in enumerate(rows)] + [(100, None, None, None, HAND.format("z", "Z"), "c", 0.1)]
    df = spark.createDataFrame(data, "file_id long, max_stars_repo_name string, repo_name string, max_stars_repo_path string, content string, label string, e0 double")
    labels = {r["file_id"]: r["label"] for r in provenance.file_labels(df).collect()}
    assert labels == {k: want for k, (_, _, want) in enumerate(rows)} | {100: "handwritten"}
    by_level = {r["file_id"]: r["label"] for r in provenance.file_labels(df, max_dirs=0).collect()}
    assert by_level == labels
    # The copy in node_modules has nothing of its own that says so: its tree decides.
    own = {r["file_id"]: r["label"] for r in provenance.own_labels(df).collect()}
    assert own[5] == "handwritten" and labels[5] == "vendored"
    assert provenance.found_machine_made(df.limit(0)).count() == 0


def brute_beliefs(files):
    """Beliefs by summing over all labellings of a small tree."""
    import itertools
    import math

    dirs = sorted({"/".join(d.split("/")[:k]) for d, _ in files for k in range(len(d.split("/")) + 1)} | {""})
    dirs = [d for d in dict.fromkeys(dirs)]
    own = {}
    for d in dirs:
        last = d.split("/")[-1]
        row = [0.0] * 5
        for label, names in provenance.HINT_DIRS.items():
            row[provenance.LABELS.index(label)] = 0.7 if last in names.split() else 0.0
        row[3] = provenance.OBSERVED if last in provenance.VENDOR_DIRS.split() else 0.0
        own[d] = row
    totals = [[0.0] * 5 for _ in files]
    for states in itertools.product(range(5), repeat=len(dirs)):
        at = dict(zip(dirs, states))
        weight = math.prod(math.exp(own[d][at[d]]) * (provenance.PRIOR[at[d]] if d == "" else 1.0 if own[d][3] > 0 else provenance.DIRECTORIES[at[d.rpartition("/")[0]]][at[d]]) for d in dirs)
        terms = [[math.exp(e[k]) * provenance.COMPATIBLE[at[d]][k] for k in range(5)] for d, e in files]
        whole = weight * math.prod(sum(t) for t in terms)
        for f, t in enumerate(terms):
            for k in range(5):
                totals[f][k] += whole / sum(t) * t[k]
    return [[x / sum(row) for x in row] for row in totals]


def test_beliefs_are_exact(spark, monkeypatch):
    rng = random.Random(6)
    places = ["", "a", "a/gen", "vendor", "a"]
    files = [(d, [0.0] + [rng.uniform(-3, 3) for _ in range(4)]) for d in places]
    rows = [(k, "r", d, False, f"text {k}", e) for k, (d, e) in enumerate(files)]
    copies = [(100 + k, *row[1:]) for k, row in enumerate(rows)]  # a file crawled twice speaks once
    schema = "file_id long, repo string, dir string, blank boolean, body string, e array<double>"
    monkeypatch.setattr(provenance, "file_evidence", lambda code: spark.createDataFrame(rows + copies, schema))
    for max_dirs in (1000, 0):
        got = {r["file_id"]: [r[f"p_{x}"] for x in provenance.LABELS] for r in provenance.file_labels(None, max_dirs=max_dirs).collect()}
        for k, want in enumerate(brute_beliefs(files)):
            assert got[k] == pytest.approx(want, abs=1e-9) and got[100 + k] == got[k]


def test_very_long_files_take_linear_time():
    import time

    features, check = provenance.make_features(), syntax.make_checker()
    for text in ("#####\n" * 40_000 + "x = 1\n", "/" * 200_000, "x = [" + "1, " * 100_000 + "]\n", " " * 300_000 + "x", "(" * 100_000, "a b " * 50_000, "x = 1 /" + " " * 200_000 + ")", "/* " * 60_000, "return " * 40_000):
        for language in ("python", "javascript", "java", "go", "c"):
            began = time.perf_counter()
            features("a/b", language, text)
            check(language, text)
            assert time.perf_counter() - began < 8, (language, text[:20])


def test_trees_decide(spark):
    """Siblings, parents and grandparents label files that show nothing themselves; nothing else in the repository is touched."""
    plain = lambda k: HAND.format(f"p{k}", f"P{k}")
    noted = lambda k: LIBRARY.replace("load_foo", f"load_n{k}")
    rows = [("third_party/zlib/src/deep/a.py", plain(1), "vendored"), ("vendor/x.py", plain(2), "vendored"), ("src/x.py", plain(3), "handwritten")]
    rows += [(f"libs/kit/n{k}.py", noted(k), "vendored") for k in range(6)] + [("libs/kit/m.py", plain(4), "vendored")]
    rows += [("src/one.py", noted(9), "vendored"), ("src/y.py", plain(5), "handwritten"), ("src/z.py", plain(6), "handwritten"), ("libs/own.py", plain(7), "handwritten")]
    data = [(k, "o/r", None, path, text) for k, (path, text, _) in enumerate(rows)] + [(99, None, None, "vendor_x.py", plain(8))]
    df = spark.createDataFrame(data, "file_id long, max_stars_repo_name string, repo_name string, max_stars_repo_path string, content string")
    labels = {r["file_id"]: r["label"] for r in provenance.file_labels(df).collect()}
    assert labels == {k: want for k, (_, _, want) in enumerate(rows)} | {99: "handwritten"}
    own = {r["file_id"]: r["label"] for r in provenance.own_labels(df).collect()}
    assert [k for k in labels if labels[k] != own[k]] == [0, 1, 9]
    long = provenance.make_features()("a.py", "python", "# " + "word " * 3000 + "\n# Code generated by tool. DO NOT EDIT.\n" + plain(1))
    assert long[0][1] > 3
