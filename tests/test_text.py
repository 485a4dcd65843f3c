import pytest
from pyspark.sql import functions as F

from strata.functions import coerce, ids
from strata.functions import text as X


def one(spark, column, **values):
    held = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(held.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in held.items())) if held else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def s(spark, f, value):
    return one(spark, f(F.col("s")), s=value)


def test_trim_handles_unicode_spaces(spark):
    assert s(spark, X.trim_ws, "\u3000 a b\u00a0\n") == "a b"


@pytest.mark.parametrize("text,most,want", [("ab한c", 4, "ab"), ("ab한c", 5, "ab한"), ("abc", 10, "abc"), ("한", 1, ""), ("abc", 0, "abc")])
def test_truncate_bytes(spark, text, most, want):
    assert s(spark, lambda c: X.truncate_bytes(c, most), text) == want


def test_headings(spark):
    text = "intro\n\n## Title here\nbody\n#tag\nmore"
    assert s(spark, X.first_heading, text) == "## Title here"
    assert s(spark, X.first_heading, "no heading") == ""
    assert s(spark, X.strip_headings, text) == "intro\n\nbody\nmore"
    assert s(spark, X.intro, text) == "intro"
    assert s(spark, X.intro, " all of it ") == "all of it"
    assert tuple(s(spark, X.split_heading, "# A\n\n b\nc ")) == ("# A", "b\nc")
    assert tuple(s(spark, X.split_heading, "a\nb")) == ("", "a\nb")


def test_snippet(spark):
    assert s(spark, lambda c: X.snippet(c, 20), " short ") == "short"
    assert s(spark, lambda c: X.snippet(c, 20), "One sentence. Another one follows") == "One sentence.…"
    assert s(spark, lambda c: X.snippet(c, 10), "word another third") == "word…"
    assert s(spark, lambda c: X.snippet(c, 5), "한국어한국어한국어") == "한국어한국…"


def test_breadcrumb_and_glossary(spark):
    assert one(spark, X.breadcrumb(F.col("a"), F.col("b")), a=" T ", b="") == "[문서: T] > [섹션: (section)]"
    assert s(spark, X.annotate_terms, "스마트 싱크") == "스마트 싱크 [en: smart sink sink]"
    assert s(spark, X.annotate_terms, "plain") == "plain"


def test_sentences_and_summaries(spark):
    assert s(spark, X.sentences, "One. Two!? \r\nThree。 ") == ["One", "Two", "Three"]
    assert one(spark, X.summary_of_section(F.col("a"), F.col("b"), F.col("c")), a="Doc", b="A > B", c="# H\nFirst one. Second. Third.") == "Doc | A > B — First one. Second"
    long = one(spark, X.summary_of_document(F.lit("T"), F.col("l")), l=["a" * 700, "b" * 700, "c"])
    assert long.startswith("T: a") and len(long) == 1200 and "c" not in long
    assert one(spark, X.summary_of_document(F.lit(""), F.col("l")), l=["", "x"]) == "x"


def test_names_paths_ratio(spark):
    for line, want in [("def _pg(x):", "_pg"), ("async def f(y)", "f"), ("func Register(s *S) int", "Register"), ("class A:", "A"), ("type T struct", "T"), ("  other words", "other")]:
        assert s(spark, X.declared_name, line) == want
    for path, want in [("a/b/c.md", "a/b"), ("c.md", "/"), ("/c.md", "/"), ("a\\b.md", "a"), ("", "/")]:
        assert s(spark, X.directory, path) == want
    assert s(spark, X.hangul_ratio, "한a") == 0.5
    assert s(spark, X.hangul_ratio, "") == 0
    assert s(spark, X.strip_hangul_end, "kubernetes는") == "kubernetes"
    assert s(spark, X.language_of_path, "x/Main.GO") == "go"
    assert s(spark, X.token_count, "") == 1 and s(spark, X.token_count, "a b") == 4


def test_tables_and_blocks(spark):
    assert s(spark, X.pipe_cells, "| a | b |") == ["a", "b"]
    assert s(spark, X.is_separator_row, "| --- | :-: |") and not s(spark, X.is_separator_row, "| -- | --- |") and not s(spark, X.is_separator_row, "---")
    assert s(spark, X.table_rows, "| a |\n|---|\n| 1 |\n| 2 |\nend") == ["| 1 |", "| 2 |"]
    assert s(spark, X.table_rows, "no table") == ["no table"] and s(spark, X.table_rows, "") == []
    assert s(spark, X.code_fragments, "```py\ndef f():\n\n    x\n```") == ["def f():", "    x"]
    fmt = X.format_block(F.lit("t1"), F.lit("table"), F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("l"))
    assert one(spark, fmt, l=["| 1 | 2 |"]) == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, X.join_rows(F.col("l"), F.lit("md")), l=["a", None, " ", "b"]) == "a\n\nb"
    assert one(spark, X.join_rows(F.col("l"), F.lit("code")), l=["a", "b"]) == "a\nb"


def test_clauses(spark):
    assert s(spark, X.clauses, "short, one") == ["short, one"]
    assert s(spark, X.clauses, "a, b, c") == ["a", "b", "c"]
    assert s(spark, X.clauses, "a | b") == ["a", "b"]
    assert s(spark, X.clauses, " ") == []


def test_keywords_and_ids(spark):
    import hashlib

    assert s(spark, X.keywords, "The Kubernetes-node node kubernetes-node abc storage_x") == ["kubernetes-node", "node", "storage_x"]
    for word in ("alpha", "beta", "gamma", "delta"):
        n = int.from_bytes(hashlib.sha256(f"kw:{word}".encode()).digest()[:8], "big", signed=True)
        assert s(spark, ids.keyword_id, f" {word.upper()} ") == abs(n)
    assert s(spark, ids.project_id, " . ") == 0 and s(spark, ids.project_id, "/a//b/") == s(spark, ids.project_id, "/a/./b")
    assert s(spark, ids.clean_path, "/a/../b/c/..") == "/b"
    h = bytearray(hashlib.sha256(b"x").digest()[:16])
    h[6], h[8] = h[6] & 15 | 0x50, h[8] & 63 | 0x80
    u = h.hex()
    assert s(spark, ids.uuid_of, "x") == f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}"


def test_settings_and_metadata(spark):
    r = coerce.resolve_settings({"VECTOR_PORT": "7000", "VECTOR_NAME": "v"}, {"VECTOR_HOST": "h", "VECTOR_PORT": "1"}, vector_name="")
    assert (r.host, r.port, r.vector_name, r.collection) == ("h", 7000, None, "strata")
    assert s(spark, coerce.flat_metadata, '{"a": 1, "b": null, "c": {"d": 2}}') == {"a": "1", "c": '{"d":2}'}
    assert s(spark, coerce.flat_metadata, "nonsense") == {}
    df = spark.sql("select map('project_id', '7') m union all select map('project_id', 'x') union all select map('a', 'b')")
    assert sorted(r["x"] for r in df.select(coerce.positive_project(F.col("m"), 3).alias("x")).collect()) == [3, 3, 7]
