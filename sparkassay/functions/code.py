"""Functions over Python source: vectorised UDFs that parse each text once and return a struct or rows.

Blank code, syntax errors, odd indentation, NUL bytes and deep nesting give defined values, never an error.
"""

from __future__ import annotations

import ast
import io
import re
import textwrap
import tokenize
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_QUIET = {tokenize.COMMENT, tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
_BOUNDARY = re.compile(r"\b(empty|none|null|zero|negative|min|max|boundary|invalid)\b", re.I)
_EXCEPTION = re.compile(r"\b(raises?|exception|error|invalid|illegal|\w+error|fail|failure|throws?)\b", re.I)
_DEEP = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)


def parse(code: str | None) -> tuple[ast.Module | None, str | None, str | None]:
    """The tree, or the kind and message of what is wrong."""
    if not (code or "").strip():
        return None, "empty_code", "empty code"
    try:
        return ast.parse(code), None, None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, type(e).__name__, str(e)[:300]


def parse_check(code: str | None) -> dict:
    """Whether code parses, and the kind and message of what is wrong."""
    tree, kind, message = parse(code)
    return {"ok": tree is not None, "kind": kind, "message": message}


def token_statistics(code: str | None) -> dict:
    code = code or ""
    n = comments = inline = 0
    lines: set[int] = set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type == tokenize.COMMENT:
                comments += 1
                lines.add(t.start[0])
                inline += bool(t.line[: t.start[1]].strip())
            elif t.type not in _QUIET:
                n += 1
    except (tokenize.TokenError, SyntaxError):  # inconsistent dedent is a SyntaxError
        n = len(code.split())
    loc = sum(bool(x.strip()) for x in code.split("\n"))
    return {"char_length": len(code), "loc": loc, "token_length": n, "num_comments": comments, "num_comment_lines": len(lines), "num_inline_comments": inline, "comment_ratio": round(len(lines) / max(1, loc), 4)}


def _called(node: ast.AST) -> str:
    return ast.unparse(node.func) if isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute) else ""


def static_features(code: str | None, prefix: str = "test_", compat: bool = True, deep: tuple[type, ...] = _DEEP) -> dict:
    """Counts and flags of a test file. ``compat`` counts a ``with pytest.raises`` both as a context and as a call; ``deep`` syntax nests."""
    tree, kind, message = parse(code)
    count = dict.fromkeys(("num_test_functions", "num_async_test_functions", "num_asserts", "num_asserts_in_test_functions", "num_top_level_asserts", "num_try_except", "num_raise_statements", "num_pytest_raises", "num_exception_checks", "num_imports_in_test", "ast_node_count", "ast_max_depth", "logical_nesting_depth", "num_bare_expression_calls"), 0)
    modules, raisers = {"pytest"}, set()

    def is_raises(call: ast.AST) -> bool:
        name = _called(call)
        return name in raisers or "." in name and name.rsplit(".", 1)[1] == "raises" and name.rsplit(".", 1)[0] in modules

    def visit(node: ast.AST, depth: int, nesting: int, inside: bool) -> None:
        count["ast_node_count"] += 1
        count["ast_max_depth"] = max(count["ast_max_depth"], depth)
        if isinstance(node, ast.Import | ast.ImportFrom):
            count["num_imports_in_test"] += 1
            for a in node.names:
                if isinstance(node, ast.Import) and a.name == "pytest":
                    modules.add(a.asname or "pytest")
                elif isinstance(node, ast.ImportFrom) and node.module == "pytest" and a.name == "raises":
                    raisers.add(a.asname or "raises")
        elif isinstance(node, _FUNCTIONS) and node.name.startswith(prefix):
            count["num_test_functions"] += 1
            count["num_async_test_functions"] += isinstance(node, ast.AsyncFunctionDef)
            inside = True
        elif isinstance(node, ast.Assert):
            count["num_asserts"] += 1
            count["num_asserts_in_test_functions" if inside else "num_top_level_asserts"] += 1
        elif isinstance(node, ast.Raise):
            count["num_raise_statements"] += 1
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Call):
            count["num_bare_expression_calls"] += 1
        elif isinstance(node, ast.Call) and is_raises(node):
            count["num_pytest_raises"] += 1
            count["num_exception_checks"] += 1
        if isinstance(node, ast.Try) and node.handlers:
            count["num_try_except"] += 1
            count["num_exception_checks"] += 1
        if isinstance(node, ast.With | ast.AsyncWith) and compat:
            hits = sum(is_raises(i.context_expr) for i in node.items)
            count["num_pytest_raises"] += hits
            count["num_exception_checks"] += hits
        nesting += isinstance(node, deep)
        count["logical_nesting_depth"] = max(count["logical_nesting_depth"], nesting)
        for child in ast.iter_child_nodes(node):
            visit(child, depth + 1, nesting, inside)

    if tree is not None:
        try:
            visit(tree, 1, 0, False)
        except RecursionError as e:
            tree, kind, message = None, "RecursionError", str(e)
            count = dict.fromkeys(count, 0)
    tokens = token_statistics(code)
    n, asserts = count["num_test_functions"], count["num_asserts"]
    style = "mixed" if n and count["num_top_level_asserts"] else "pytest_function" if n else "top_level_assert" if count["num_top_level_asserts"] else "other_assertion_style" if asserts or count["num_exception_checks"] else "none"
    return tokens | count | {
        "ast_parse_pass": tree is not None,
        "ast_parse_error_type": kind,
        "ast_parse_error_msg": message,
        "has_test_function": n > 0,
        "has_assertions": asserts > 0,
        "has_pytest_raises": count["num_pytest_raises"] > 0,
        "avg_asserts_per_test_function": round(count["num_asserts_in_test_functions"] / n, 4) if n else 0.0,
        "assert_density": round(asserts / max(1, tokens["loc"]), 4),
        "surface_structural_complexity": round(count["logical_nesting_depth"] + 0.1 * n, 4),
        "test_style": style,
    }


def surface(code: str | None) -> dict:
    """Counts of a test file's surface: test functions by the prefix ``test``, and nesting without ``match``."""
    found = static_features((code or "").strip(), "test", deep=tuple(x for x in _DEEP if x is not ast.Match))
    return {k: found[k] for k in ("num_test_functions", "num_async_test_functions", "ast_node_count", "ast_max_depth", "logical_nesting_depth")} | {"ast_parse_pass": int(found["ast_parse_pass"])}


def logic_proxies(code: str | None) -> dict:
    """Test functions (prefix ``test``), those with a check, and boundary and exception signals; nulls for unparsable code."""
    names = ("num_test_functions", "num_test_functions_with_checks", "boundary_signal_count", "exception_signal_count", "TBC", "boundary_coverage", "exception_path_coverage")
    tree, _, _ = parse(code)
    if tree is None:
        return dict.fromkeys(names)

    def checks(node: ast.AST) -> int:
        """Exception checks: raising contexts and calls, and handlers; ``self.assertRaises`` as a context counts as both."""
        n = 0
        for x in ast.walk(node):
            if isinstance(x, ast.With | ast.AsyncWith):
                n += sum(_called(i.context_expr).endswith((".raises", ".assertRaises")) for i in x.items)
            elif isinstance(x, ast.Try) and x.handlers:
                n += 1
            elif isinstance(x, ast.Call) and _called(x) == "self.assertRaises":
                n += 1
        return n

    tests = [x for x in ast.walk(tree) if isinstance(x, _FUNCTIONS) and x.name.startswith("test")]
    checked = sum(bool(checks(t)) or any(isinstance(x, ast.Assert) or _called(x).startswith("self.assert") for x in ast.walk(t)) for t in tests)
    edges = sum(isinstance(x, ast.Constant) and (x.value is None or isinstance(x.value, bool | int | float) and x.value in (0, 1, -1) or x.value == "") for x in ast.walk(tree))
    empties = sum(isinstance(x, ast.List | ast.Tuple) and not x.elts or isinstance(x, ast.Dict) and not x.keys for x in ast.walk(tree))
    boundary, exceptions = edges + empties + len(_BOUNDARY.findall(code or "")), checks(tree)
    return dict(zip(names, (len(tests), checked, boundary, exceptions, round(checked / len(tests), 6) if tests else None, round(min(boundary / 3, 1), 6), round(min(float(exceptions), 1), 6)), strict=True))


def validity(code: str | None, entry: str | None) -> dict:
    """Whether a candidate can count: not empty, parsable, not redefining its target, and with some check."""
    tree, kind, _ = parse(code)
    out = {"status": "ok", "invalid": 0, "redefines_kind": None, "missing_check": 0, "suspicious": 0}
    if kind == "empty_code":
        return out | {"status": "empty_code", "invalid": 1}
    if tree is None:
        return out | {"status": "syntax_error"}
    for x in tree.body:
        if entry and isinstance(x, (*_FUNCTIONS, ast.ClassDef)) and x.name == entry:
            return out | {"status": "invalid_redefines_target", "invalid": 1, "redefines_kind": "class" if isinstance(x, ast.ClassDef) else "function"}
    if entry:
        alias = any(isinstance(x, ast.Assign) and isinstance(x.value, ast.Name) and x.value.id == entry for x in ast.walk(tree))
        wraps = any(isinstance(f, _FUNCTIONS) and any(_called(c) == entry for c in ast.walk(f)) for f in ast.walk(tree))
        out["suspicious"] = int(alias or wraps)
    if not any(isinstance(x, ast.Assert) or _called(x).endswith("raises") for x in ast.walk(tree)):
        out |= {"status": "weak_no_assert_like_check", "missing_check": 1}
    return out


def signature(code: str | None, entry: str | None = None) -> dict:
    """The first (or named) function's header, and its number of arguments without ``self`` and ``cls``."""
    for m in re.finditer(r"(?m)^[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", code or ""):
        if entry and m[1] != entry:
            continue
        depth, at = 1, m.end()
        while at < len(code) and depth:
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(code[at], 0)
            at += 1
        if depth:
            break
        tail = re.match(r"\s*(?:->\s*[^:\n]+)?:", code[at:])
        header = " ".join((code[m.start() : at] + (tail[0] if tail else "")).split())
        tree, _, _ = parse(header.rstrip(":") + ": pass")
        if tree is not None:
            a = tree.body[0].args
            names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.arg not in ("self", "cls")]
            return {"signature": header, "arg_count": len(names) + bool(a.vararg) + bool(a.kwarg)}
        return {"signature": header, "arg_count": None}
    return {"signature": None, "arg_count": None}


def top_imports(prompt: str | None) -> list[str]:
    """Import lines at the start of a prompt, up to the first other text."""
    out = []
    for x in (prompt or "").split("\n"):
        if re.match(r"(import|from)\s+\S", x.strip()):
            out.append(x.strip())
        elif x.strip():
            break
    return out


def runner_mode(code: str | None) -> dict:
    tree, _, _ = parse(code)
    if tree is None:
        return {"mode": "script", "top_level_asserts": 0}
    tests = any(isinstance(x, _FUNCTIONS) and x.name.startswith("test") or isinstance(x, ast.ClassDef) and x.name.startswith("Test") for x in tree.body)
    return {"mode": "pytest" if tests else "script", "top_level_asserts": sum(isinstance(x, ast.Assert) for x in tree.body)}


def is_full_function(code: str | None, entry: str | None) -> bool:
    """Whether a solution defines its entry point itself, rather than continuing a prompt."""
    tree, _, _ = parse(code)
    return tree is not None and any(isinstance(x, _FUNCTIONS) and x.name == entry for x in tree.body)


def assemble(prompt: str | None, solution: str | None, entry: str | None, imports: list[str] | None = None) -> dict:
    """A solution file: the solution alone if it is whole, else the prompt continued by it."""
    head = "\n".join(dict.fromkeys([*(imports or []), *top_imports(prompt)]))
    if is_full_function(solution, entry):
        return {"code": "\n\n".join(x for x in (head, solution) if x) + "\n", "mode": "full_function"}
    return {"code": "\n\n".join(x for x in ("\n".join(imports or []), (prompt or "") + (solution or "")) if x) + "\n", "mode": "prompt_plus_body"}


_TEST = re.compile(r"(?m)^[ \t]*(?:async\s+)?def\s+test[_a-zA-Z0-9]*\s*\(")


def has_test_signal(text: str) -> bool:
    """Whether a text has a test function and a check."""
    return bool(_TEST.search(text)) and ("assert " in text or "pytest.raises" in text)


def parseable_prefix(code: str | None) -> str | None:
    """Code that parses as it is, else its longest run of leading lines that parses and holds a test with a check; null if there is none."""
    if parse(code)[0] is not None:
        return code
    lines = (code or "").rstrip().splitlines()
    runs = ("\n".join(lines[:n]).rstrip() for n in range(len(lines) - 1, 0, -1))
    return next((x for x in runs if has_test_signal(x) and parse(x)[0] is not None), None)


def fenced(text: str | None) -> str | None:
    """The fenced block with a test function, else with an assertion, else the first; unfenced text as it is."""
    blocks = re.findall(r"```[a-zA-Z0-9_+-]*\n(.*?)```", text or "", re.S)
    if not blocks:
        return text
    return next((b for p in (r"\bdef\s+test", r"\bassert\b") for b in blocks if re.search(p, b)), blocks[0])


#: Marks that tokenizers leave for white space, and the module that generated imports name for the code under test: fixed values.
_MARKS = {"Ċ": "\n", "Ġ": " ", "ĉ": "\t"}
_PLACEHOLDER = "your_module"


def normalise_generated(text: str | None) -> str:
    """Generated text as test code.

    Tokenizer marks, fences, line ends, imports of the placeholder module, what stands before the first test (but for its
    imports) and after a main guard are removed; of what doesn't parse then the parseable prefix stays, if it has one.
    """
    x = (text or "").translate(str.maketrans(_MARKS))
    x = (fenced(x) or "").replace("\r\n", "\n").replace("\r", "\n")
    lines = [line for line in x.splitlines() if not re.match(rf"\s*from\s+{_PLACEHOLDER}\s+import\s+", line)]
    first = next((i for i, line in enumerate(lines) if _TEST.match(line)), None)
    if first is not None:
        lines = [line for line in lines[:first] if re.match(r"\s*(import|from)\s+", line) and _PLACEHOLDER not in line] + lines[first:]
    guard = next((i for i, line in enumerate(lines) if re.match(r"if\s+__name__\s*==\s*['\"]__main__['\"]\s*:", line)), len(lines))
    x = "\n".join(lines[:guard]).strip()
    return (parseable_prefix(x) or x).strip()


def variants(code: str | None) -> list[dict]:
    """Programmatic negative variants of a test file, each with its kind and number; repeats of a text are skipped."""
    tree, _, _ = parse(code)
    tests = [x for x in (tree.body if tree else []) if isinstance(x, ast.FunctionDef) and x.name.startswith("test")]
    if not tests:
        return []
    lines = code.split("\n")
    source = lambda t: "\n".join(lines[t.lineno - 1 : t.end_lineno])
    marks = ("None", "[]", "{}", '""', " 0", "-1", " 1", "pytest.raises")
    wanted = next((t for t in tests if _BOUNDARY.search(source(t)) or _EXCEPTION.search(source(t)) or any(m in source(t) for m in marks)), tests[-1])

    def without(*gone: ast.FunctionDef) -> str:
        drop = {n for t in gone for n in range((t.decorator_list[0].lineno if t.decorator_list else t.lineno), t.end_lineno + 1)}
        return "\n".join(x for n, x in enumerate(lines, 1) if n not in drop)

    def weaken(*of: ast.FunctionDef) -> str:
        out = list(lines)
        for t in of:
            for a in ast.walk(t):
                if isinstance(a, ast.Assert) and a.lineno == a.end_lineno:
                    left = a.test.left if isinstance(a.test, ast.Compare) else a.test
                    line = out[a.lineno - 1]
                    out[a.lineno - 1] = line[: len(line) - len(line.lstrip())] + f"assert {ast.unparse(left)} is not None"
        return "\n".join(out)

    made = []
    if len(tests) > 1:
        made.append(("drop_targeted_test", without(wanted)))
    made.append(("weaken_target_asserts", weaken(wanted)))
    if len(tests) > 1:
        made += [(f"drop_exception_like_{n}", without(t)) for n, t in enumerate([t for t in tests if _EXCEPTION.search(source(t))][:2], 1)]
        made.append(("keep_first_test_and_weaken_rest", weaken(*tests[1:])))
    seen, out = {code.strip()}, []
    for n, (kind, text) in enumerate(made, 1):
        if text.strip() not in seen:
            seen.add(text.strip())
            out.append({"variant": n, "kind": kind, "code": text})
    return out


def discover(code: str | None) -> list[dict]:
    """Functions of a file with scope and kind; dunders are left out, nested ones name the outermost callable around them."""
    tree, _, _ = parse(code)
    out: list[dict] = []

    def visit(node: ast.AST, scope: list[str], in_class: bool, outer: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                visit(x, [*scope, x.name], True, outer)
            elif isinstance(x, _FUNCTIONS):
                path = ".".join([*scope, x.name])
                if not (x.name.startswith("__") and x.name.endswith("__")):
                    kind = "async" * isinstance(x, ast.AsyncFunctionDef) + ("nested" if outer else "internal" if x.name.startswith("_") else "")
                    if in_class:
                        marks = {ast.unparse(d) for d in x.decorator_list}
                        kind += "method:" + ("static" if "staticmethod" in marks else "class" if "classmethod" in marks else "instance")
                    out.append({"name": path, "kind": kind or "function", "line": x.lineno, "effective": outer or path})
                visit(x, [*scope, x.name], False, outer or path)
            else:
                visit(x, scope, in_class, outer)

    if tree is not None:
        visit(tree, [], False, None)
    return out


#: What each operator is changed to: fixed values.
_COMPARE = {ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.LtE, ast.LtE: ast.Lt, ast.Gt: ast.GtE, ast.GtE: ast.Gt, ast.Is: ast.IsNot, ast.IsNot: ast.Is, ast.In: ast.NotIn, ast.NotIn: ast.In}
_BINARY = {ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.Add, ast.Div: ast.Mult, ast.FloorDiv: ast.Div, ast.Mod: ast.Add}
_BOOLEAN = {ast.And: ast.Or, ast.Or: ast.And}
#: The syntax of each kind of site.
_SITES = {"compare": ast.Compare, "binop": ast.BinOp, "boolop": ast.BoolOp, "unary": ast.UnaryOp, "constant": ast.Constant, "return": ast.Return}


def _change(x: ast.AST) -> tuple[str, str, object] | None:
    """Kind of site, what stands there, and what it is changed to: an operator's class or a value."""
    swap = lambda kind, op, table: (kind, type(op).__name__.lower(), table[type(op)]) if type(op) in table else None
    if isinstance(x, ast.Compare):
        return swap("compare", x.ops[0], _COMPARE)
    if isinstance(x, ast.BinOp):
        return swap("binop", x.op, _BINARY)
    if isinstance(x, ast.BoolOp):
        return swap("boolop", x.op, _BOOLEAN)
    if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not):
        return "unary", "not", "identity"
    if isinstance(x, ast.Constant):
        if isinstance(x.value, bool):
            return "constant", repr(x.value), not x.value
        if isinstance(x.value, int | float):
            return "constant", repr(x.value), x.value + 1
        if isinstance(x.value, str) and x.value:
            return "constant", repr(x.value), x.value + "x"
    return ("return", "value", None) if isinstance(x, ast.Return) and x.value is not None else None


def _found(tree: ast.AST | None, most: int | None) -> list[tuple[ast.AST, tuple]]:
    return [(x, c) for x in ast.walk(tree) if hasattr(x, "lineno") and (c := _change(x))][:most] if tree else []


def sites(code: str | None, most: int = 36) -> list[dict]:
    """Places to mutate, in breadth-first order, at most ``most``, with what stands there and what it becomes."""
    tree, _, _ = parse(code)
    name = lambda kind, new: new.__name__ if isinstance(new, type) else new if kind == "unary" else repr(new)
    return [{"site": n, "kind": kind, "line": x.lineno, "col": x.col_offset, "old": old, "new": name(kind, new)} for n, (x, (kind, old, new)) in enumerate(_found(tree, most))]


def mutate(code: str | None, site: int) -> str | None:
    """The code with one site changed; null if there is no such site.

    A site is a kind of syntax at a position; of several that begin there, such as a chain of operators, the innermost changes.
    """
    tree, _, _ = parse(code)
    found = _found(tree, None)
    if not 0 <= site < len(found):
        return None
    at, (kind, _, new) = found[site]
    same = [x for x in ast.walk(tree) if isinstance(x, _SITES[kind]) and (x.lineno, x.col_offset) == (at.lineno, at.col_offset)]
    x = same[-1]  # the walk goes inwards

    class Change(ast.NodeTransformer):
        def visit(self, node: ast.AST) -> ast.AST:
            if node is not x:
                return self.generic_visit(node)
            if kind == "compare":
                node.ops[0] = new()
            elif kind in ("binop", "boolop"):
                node.op = new()
            elif kind == "unary":
                return node.operand
            elif kind == "return":
                node.value = ast.Constant(None)
            else:
                node.value = new
            return node

    return ast.unparse(ast.fix_missing_locations(Change().visit(tree)))


def mutants(code: str | None, most: int = 36) -> list[dict]:
    """The distinct programs that the sites' changes give, other than the code itself."""
    seen, out = {code}, []
    for s in sites(code, most):
        text = mutate(code, s["site"])
        if text is not None and f"{text}\n" not in seen:
            seen.add(f"{text}\n")
            out.append({"site": s["site"], "operator": f"{s['kind']}:{s['old']}->{s['new']}", "code": f"{text}\n"})
    return out


#: The safety policy: names, modules and attributes that are forbidden, attributes that a module is limited to, and modules that may be imported. Fixed values.
BLOCKED_NAMES = ("eval", "exec", "open", "input", "compile", "__import__", "globals", "locals", "vars", "breakpoint", "help", "dir")
BLOCKED_MODULES = ("os", "sys", "subprocess", "socket", "pathlib", "shutil", "requests", "urllib", "http", "ftplib", "multiprocessing", "ctypes", "asyncio", "threading", "concurrent", "resource", "signal", "site", "importlib", "builtins", "pickle", "marshal", "shelve", "sqlite3", "tempfile", "mmap", "psutil")
BLOCKED_ATTRIBUTES = ("__subclasses__", "__globals__", "__code__", "__builtins__", "__import__", "__class__", "__mro__", "__base__", "__bases__", "__getattribute__")
LIMITED_MODULES = {"asyncio": ("sleep", "gather", "wait_for", "run")}
ALLOWED_MODULES = ("math", "re", "statistics", "itertools", "functools", "collections", "typing", "dataclasses", "decimal", "fractions", "heapq", "bisect", "string", "random", "enum", "operator", "asyncio")


def _forbidden(x: ast.AST, local: tuple[str, ...], trusted: bool) -> str | None:
    if isinstance(x, ast.Import):
        return next((f"import {a.name}" for a in x.names if a.name.split(".")[0] not in (*ALLOWED_MODULES, *local)), None)
    if isinstance(x, ast.ImportFrom) and not x.level:
        top = (x.module or "").split(".")[0]
        limits = None if trusted else LIMITED_MODULES.get(top)
        return f"import {x.module}" if top not in (*ALLOWED_MODULES, *local) or limits and any(a.name not in limits for a in x.names) else None
    if isinstance(x, ast.Name) and x.id in BLOCKED_NAMES:
        return f"name {x.id}"
    if isinstance(x, ast.Attribute):
        if x.attr in BLOCKED_NAMES + BLOCKED_ATTRIBUTES:
            return f"attribute {x.attr}"
        root = x.value
        while isinstance(root, ast.Attribute):
            root = root.value
        if not trusted and isinstance(root, ast.Name) and x.attr not in LIMITED_MODULES.get(root.id, (x.attr,)):
            return f"attribute {root.id}.{x.attr}"
    if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name) and not trusted:
        module = x.func.value.id
        if module in BLOCKED_MODULES and x.func.attr not in LIMITED_MODULES.get(module, ()):
            return f"call {module}.{x.func.attr}"
    return None


def violation(code: str | None, local: tuple[str, ...] = (), trusted: bool = False) -> str | None:
    """The first use of a module, name or attribute that the safety policy forbids; ``local`` modules may be imported."""
    tree, kind, _ = parse(code)
    if tree is None:
        return kind
    return next((v for x in ast.walk(tree) if (v := _forbidden(x, local, trusted))), None)


def doctests(text: str | None) -> list[dict]:
    """Pairs of call and expected value of the examples in a text."""
    import doctest

    try:
        return [{"call": e.source.strip(), "expected": e.want.strip()} for e in doctest.DocTestParser().get_examples(textwrap.dedent(text or ""))]
    except ValueError:
        return []


def segments(code: str | None) -> dict:
    """Top-level statements as set-up and assertions."""
    tree, _, _ = parse(code)
    body = tree.body if tree else []
    return {"setup": [ast.unparse(x) for x in body if not isinstance(x, ast.Assert)], "asserts": [ast.unparse(x) for x in body if isinstance(x, ast.Assert)]}


def is_check_harness(code: str | None) -> bool:
    tree, _, _ = parse(code)
    return tree is not None and any(isinstance(x, ast.FunctionDef) and x.name == "check" and len(x.args.args) == 1 for x in tree.body)


def prune(code: str | None, log: str | None) -> str | None:
    """The code without the single-line assertions at lines that the log names; null if nothing checks any more."""
    tree, _, _ = parse(code)
    if tree is None:
        return None
    bad = {int(n) for n in re.findall(r"(?:line |\.py:)(\d+)", log or "")}
    at = {x.lineno for x in ast.walk(tree) if isinstance(x, ast.Assert) and x.lineno == x.end_lineno}
    out = [x[: len(x) - len(x.lstrip())] + "pass" if n in bad & at else x for n, x in enumerate((code or "").split("\n"), 1)]
    return "\n".join(out) if at - bad else None


def _kind(v) -> str:
    return {bool: "boolean", int: "long", float: "double"}.get(type(v), "string")


def _struct(f, *sample) -> str:
    kinds = {"arg_count": "long", "TBC": "double"}
    return ", ".join(f"{k} {'array<string>' if isinstance(v, list) else kinds.get(k, _kind(v))}" for k, v in f(*sample).items())


_GOOD = "def test_a():\n    assert f(1) == 2\n"


def udfs() -> dict:
    """All code functions as UDFs, by name. Those with rows return arrays of structs, to be exploded."""
    scalar = {"static_features": (static_features, (_GOOD,)), "logic_proxies": (logic_proxies, (_GOOD,)), "token_statistics": (token_statistics, (_GOOD,))}

    def one(f, kind):
        @F.pandas_udf(kind)
        def udf(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([f(x) for x in s], columns=[p.split(" ")[0] for p in kind.split(", ")])

        return udf

    def two(f, kind):
        @F.pandas_udf(kind)
        def udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([f(x, y) for x, y in zip(a, b, strict=True)], columns=[p.split(" ")[0] for p in kind.split(", ")])

        return udf

    def three(f, kind):
        @F.pandas_udf(kind)
        def udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([f(x, y, z) for x, y, z in zip(a, b, c, strict=True)], columns=[p.split(" ")[0] for p in kind.split(", ")])

        return udf

    def plain(f, kind):
        @F.pandas_udf(kind)
        def udf(s: pd.Series) -> pd.Series:
            return pd.Series([f(x) for x in s], dtype=object)

        return udf

    def pair(f, kind):
        @F.pandas_udf(kind)
        def udf(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return udf

    out = {name: one(f, _struct(f, *sample)) for name, (f, sample) in scalar.items()}
    out |= {"validity": two(validity, "status string, invalid long, redefines_kind string, missing_check long, suspicious long"), "signature": two(signature, "signature string, arg_count long"), "runner_mode": one(runner_mode, "mode string, top_level_asserts long"), "parse_check": one(parse_check, "ok boolean, kind string, message string"), "surface": one(surface, "num_test_functions long, num_async_test_functions long, ast_node_count long, ast_max_depth long, logical_nesting_depth long, ast_parse_pass long")}
    out |= {"assemble": three(assemble, "code string, mode string")}
    out |= {"normalise_generated": plain(normalise_generated, "string"), "fenced": plain(fenced, "string"), "parseable_prefix": plain(parseable_prefix, "string"), "violation": plain(violation, "string"), "top_imports": plain(top_imports, "array<string>"), "is_check_harness": plain(is_check_harness, "boolean")}
    out |= {"is_full_function": pair(is_full_function, "boolean"), "prune": pair(prune, "string"), "mutate": pair(lambda c, n: mutate(c, int(n)), "string")}
    out |= {"variants": plain(variants, "array<struct<variant: long, kind: string, code: string>>"), "discover": plain(discover, "array<struct<name: string, kind: string, line: long, effective: string>>"), "sites": plain(sites, "array<struct<site: long, kind: string, line: long, col: long, old: string, new: string>>"), "mutants": plain(mutants, "array<struct<site: long, operator: string, code: string>>"), "doctests": plain(doctests, "array<struct<call: string, expected: string>>"), "segments": one(segments, "setup array<string>, asserts array<string>")}
    return out


def register(spark: SparkSession) -> None:
    """Makes the code functions callable from SQL, under their names with the prefix ``code_``."""
    for name, f in udfs().items():
        spark.udf.register(f"code_{name}", f)
