"""Code functions on hand-written snippets, and sources on files."""

import json
import zipfile

from sparkassay.functions import code as K
from sparkassay.sources import files as FS

TEST = "import pytest as pt\n\ndef test_a():\n    assert f(1) == 2  # one\n    with pt.raises(ValueError):\n        f(-1)\n\nasync def test_b():\n    if True:\n        pass\n    elif False:\n        assert f('') is None\n"


def test_static_features():
    s = K.static_features(TEST)
    assert (s["num_test_functions"], s["num_async_test_functions"], s["num_asserts"], s["num_pytest_raises"]) == (2, 1, 2, 2)
    assert K.static_features(TEST, compat=False)["num_pytest_raises"] == 1
    assert (s["num_comments"], s["num_inline_comments"], s["logical_nesting_depth"], s["test_style"]) == (1, 1, 2, "pytest_function")
    bad = K.static_features("def x(:\n")
    assert not bad["ast_parse_pass"] and bad["ast_parse_error_type"] == "SyntaxError" and bad["num_asserts"] == 0


def test_odd_code_never_fails():
    for c in (None, "", "  \n", "def f(:\n", "if x:\n    a\n  b\n", "a\0b", "x = " + "(" * 300 + ")" * 300, "x" * 5000):
        for f in (K.static_features, K.logic_proxies, K.token_statistics, K.variants, K.discover, K.sites, K.runner_mode, K.segments, K.violation, K.parseable_prefix, K.normalise_generated, K.signature, K.doctests, K.is_check_harness):
            f(c)
        K.validity(c, "f")
        K.prune(c, "line 1")
        K.mutate(c, 0)


def test_logic_proxies():
    p = K.logic_proxies("def test_x(self):\n    with self.assertRaises(E):\n        f(0)\n    self.assertEqual(f(-1), '')\n")
    assert p["num_test_functions_with_checks"] == 1 and p["exception_signal_count"] == 2 and p["boundary_signal_count"] == 3
    assert K.logic_proxies("def (")["boundary_coverage"] is None


def test_validity():
    assert K.validity("", "f")["status"] == "empty_code"
    assert K.validity("def f(): pass", "f") == {"status": "invalid_redefines_target", "invalid": 1, "redefines_kind": "function", "missing_check": 0, "suspicious": 0}
    assert K.validity("def test(): f(1)", "f")["status"] == "weak_no_assert_like_check"
    assert K.validity("assert f(1)", "f")["status"] == "ok"
    assert K.validity("x = (", "f")["invalid"] == 0


def test_variants():
    code = "def test_a():\n    assert f(2) == 3\n\ndef test_empty():\n    assert f([]) is False\n"
    v = K.variants(code)
    assert [x["kind"] for x in v] == ["drop_targeted_test", "weaken_target_asserts", "keep_first_test_and_weaken_rest"][: len(v)]
    assert "test_empty" not in v[0]["code"] and "assert f([]) is not None" in v[1]["code"]
    assert K.variants("x = 1") == []


def test_mutation_sites():
    code = "def f(x):\n    if x > 0 and not x == 3:\n        return x + 1\n    return True\n"
    kinds = [s["kind"] for s in K.sites(code)]
    assert {"compare", "boolop", "unary", "binop", "constant", "return"} <= set(kinds)
    assert all(K.mutate(code, n) not in (None, code) for n in range(len(kinds)))
    assert K.mutate(code, 99) is None
    changed = {c: K.mutants(c)[0] for c in ("a < b", "a <= b", "a > b", "a >= b", "a * b", "a / b", "a // b", "a % b", "a in b", "not a", "True", "1.5", "x = 's'")}
    assert {c: m["code"].strip() for c, m in changed.items()} == {"a < b": "a <= b", "a <= b": "a < b", "a > b": "a >= b", "a >= b": "a > b", "a * b": "a + b", "a / b": "a * b", "a // b": "a / b", "a % b": "a + b", "a in b": "a not in b", "not a": "a", "True": "False", "1.5": "2.5", "x = 's'": "x = 'sx'"}
    assert changed["a < b"]["operator"] == "compare:lt->LtE"
    assert K.sites("''") == [] and K.sites("a ** b") == [] and len(K.sites("\n".join(["a + b"] * 50))) == 36
    # Both operators of a chain begin at the same place: the inner one changes, and equal programs stay once.
    assert [m["code"] for m in K.mutants("a * b + c")] == ["a - b + c\n", "a + b + c\n"]


def test_safety_policy():
    bad = {"import os.path": "import os.path", "import numpy": "import numpy", "from asyncio import Queue": "import asyncio", "import asyncio\nasyncio.create_task(f)": "call asyncio.create_task", "x.__class__": "attribute __class__", "help": "name help", "x.eval": "attribute eval", "pickle.loads(b)": "call pickle.loads"}
    assert {c: K.violation(c) for c in bad} == bad
    fine = ("import math, asyncio\nasyncio.run(f())", "from . import os", "x.__dict__", "a = 1", "from asyncio import sleep")
    assert [K.violation(c) for c in fine] == [None] * len(fine)
    assert K.violation("import mine.part", ("mine",)) is None


def test_discovery():
    d = {x["name"]: x for x in K.discover("class A:\n    @classmethod\n    def go(cls): pass\n    def __init__(self): pass\nasync def _h():\n    def deep(): pass\n")}
    assert d["A.go"]["kind"] == "method:class" and d["_h"]["kind"] == "asyncinternal" and d["_h.deep"]["effective"] == "_h" and "A.__init__" not in d


def test_text_helpers():
    assert K.fenced("a\n```python\nx\n```\n```\ndef test_q(): pass\n```") == "def test_q(): pass\n"
    assert K.signature("def f(self, a: dict[str, int] = {1: (2)},\n      *b) -> int:\n  pass") == {"signature": "def f(self, a: dict[str, int] = {1: (2)}, *b) -> int:", "arg_count": 2}
    assert K.top_imports("import a\n\nfrom b import c\ntext\nimport d") == ["import a", "from b import c"]
    assert K.parseable_prefix("def test_a():\n    assert 1\ndef broken(") == "def test_a():\n    assert 1"
    assert K.violation("import os.path") == "import os.path"
    assert K.doctests(">>> f(1)\n2\n") == [{"call": "f(1)", "expected": "2"}]
    assert K.assemble("def f(x):\n", "    return x\n", "f")["mode"] == "prompt_plus_body"
    assert K.prune("assert 1\nassert 2", "t.py:1: AssertionError") == "pass\nassert 2"


def test_udfs_in_sql(spark):
    K.register(spark)
    r = spark.sql("SELECT code_static_features('assert 1').num_asserts AS n, code_sites('return_ = 1')[0].kind AS k").first()
    assert (r.n, r.k) == (1, "constant")


def test_sources(spark, tmp_path):
    p = f"file://{tmp_path}"
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": [1, 2]}\n\n{"id": 2}\n')
    df = FS.read_jsonl(spark, f"{p}/a.jsonl", "id long, v array<long>", strict=True)
    assert df.count() == 2 and [r.raw_record_index for r in FS.with_record_index(df).collect()] == [1, 2]
    assert FS.read_jsonl(spark, f"{p}/none.jsonl", "id long", missing_ok=True).count() == 0
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1}, {"id": 2}, {"id": 3}]))
    assert FS.read_json_array(spark, f"{p}/b.json", "id long").count() == 3
    FS.write_csv(spark.createDataFrame([(1, 'a "q"\nb', [1])], "id int, t string, l array<int>"), f"{p}/c")
    back = FS.read_csv(spark, f"{p}/c").collect()
    assert [tuple(r) for r in back] == [("1", 'a "q"\nb', "[1]")]
    FS.write_jsonl(spark.createDataFrame([(1, float("nan"), None)], "id int, x double, y string"), f"{p}/d")
    assert json.loads("".join(x.read_text() for x in (tmp_path / "d").glob("part*"))) == {"id": 1, "x": None, "y": None}
    assert FS.first_existing(spark, [f"{p}/zzz", f"{p}/d"]) == f"{p}/d"
    FS.write_report(spark, {"n": 1}, f"{p}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.py", "x = 1")
        z.writestr("b.py", "0" * 3000)
    assert [r.name for r in FS.read_zip(spark, f"{p}/z.zip", max_ratio=1e9).collect()] == ["a.py", "b.py"]
    assert FS.read_zip(spark, f"{p}/z.zip", max_file=1000).first().error
