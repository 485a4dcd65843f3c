"""Fixed cases of small functions: terms, parameters, settings, JSON, files."""

import pytest
from pyspark.sql import functions as F

from strata.functions import coerce, ids
from strata.functions import text as X
from strata.operators import rank
from strata.plans import service
from strata.sources import files
from strata.sources.scratch import write_bytes

TERMS = [("The user-id of an API?", "user-id user id api"), ("GraphDB에서 검색을 v1.2_beta", "graphdb v1.2_beta v1.2 beta"), ("to be or not", "be not"), ("", ""), ("a b cc-d", "cc-d cc"), ("한국어 검색", ""), ("(foo) [bar_baz] {x}", "foo bar_baz bar baz"), ("x", ""), ("-- ab--cd __", "ab--cd ab cd"), ("ab한국어cd", "ab한국어cd")]


def test_terms_natively_and_on_the_driver(spark):
    df = spark.createDataFrame([(q,) for q, _ in TERMS] + [(None,)], "q string").coalesce(1)
    got = [" ".join(r["t"]) for r in df.select(rank.terms(F.col("q")).alias("t")).collect()]
    assert got == [" ".join(rank.search_terms(q)) for q, _ in TERMS] + [""]
    assert got[:7] == [t for _, t in TERMS[:7]]


def test_parameters(spark):
    given = ["1", "7", "0", "101", "100", "x", None, " 12 ", "", "1.5", "+3", "-1"]
    df = spark.createDataFrame([(g,) for g in given], "g string").coalesce(1)
    rows = df.select(coerce.hits_wanted(F.col("g")).alias("n"), coerce.project_asked(F.col("g")).alias("p")).collect()
    assert [r["n"] for r in rows] == [service.checked_top_k(g) for g in given]

    def project(g):
        try:
            return service.checked_project(g), None
        except service.ServiceError as e:
            return None, e.code

    assert [(r["p"]["id"], r["p"]["error"]) for r in rows] == [project(g) for g in given]


def test_settings(spark):
    s = coerce.resolve_settings({"VECTOR_HOST": "meta", "VECTOR_PORT": " 1 "}, {"VECTOR_HOST": "env", "VECTOR_PORT": "2", "VECTOR_COLLECTION": "env"}, host="own", vector_name="")
    assert (s.host, s.port, s.collection, s.vector_name, s.embedding_model) == ("own", 1, "env", None, "text-embedding-3-small")
    assert coerce.first_set(None, "  ", "b", "c") == "b" and coerce.first_set("", default="d") == "d"
    assert ids.vector_size("text-embedding-3-large") == 3072 and ids.vector_size("x", 5) == 5
    df = spark.createDataFrame([({"project_id": p} if p else {}, m) for p, m in (("12", "text-embedding-3-large"), ("-3", "x"), ("x", None), (None, "text-embedding-ada-002"))], "m map<string,string>, n string").coalesce(1)
    assert [tuple(r) for r in df.select(coerce.positive_project(F.col("m"), 9), ids.vector_size_of(F.col("n"), 5)).collect()] == [(12, 3072), (9, 5), (9, 5), (9, 1536)]


def test_json(spark):
    rows = spark.createDataFrame([(1, '{"a": "x", "b": [1, 2]}', b"bytes \xc3\xa9"), (2, "not json", b"bad \xff"), (3, None, None), (4, "[1]", b"")], "id int, s string, b binary")
    got = sorted(rows.select("id", F.to_json(coerce.json_or_empty(F.col("s"))), F.try_element_at(coerce.flat_metadata(F.col("s")), F.lit("b")), X.decode_summary(F.col("b"))).collect())
    assert [tuple(r) for r in got] == [(1, '{"a":"x","b":[1,2]}', "[1,2]", "bytes é"), (2, "{}", None, "bad �"), (3, "{}", None, ""), (4, "[1]", None, "")]


PAGES = {"b/notes.md": b"---\ntitle: The notes\ntags: x\n---\n# One\ntext \xc3\xa9\n", "a-first_page.markdown": b"no head\n", "b/.git/hidden.md": b"# hidden\n", "code/main.py": b"import os\n", "code/main.go": b"package main\n", "b/deep/er/x.rs": b"fn main() {}\n", "b/skip.txt": b"not read\n", "b/broken.md": b"bytes \xff\xfe that are none\n"}


def test_files(spark, tmp_path):
    for name, data in PAGES.items():
        write_bytes(spark, f"{tmp_path}/{name}", data)
    meta = F.col("source_metadata")
    got = files.records(spark, str(tmp_path), 7).select(F.try_element_at(meta, F.lit("path")).alias("path"), "title", "content", F.try_element_at(meta, F.lit("tags")).alias("tags"), "domain").collect()
    assert sorted(map(tuple, got)) == [("a-first_page.markdown", "A First Page", "no head\n", None, "wiki"), ("b/broken.md", "Broken", "bytes �� that are none\n", None, "wiki"), ("b/deep/er/x.rs", "b/deep/er/x.rs", "fn main() {}\n", None, "code"), ("b/notes.md", "The notes", "# One\ntext é\n", "x", "wiki"), ("code/main.go", "code/main.go", "package main\n", None, "code"), ("code/main.py", "code/main.py", "import os\n", None, "code")]


@pytest.mark.parametrize("most", [1, 3])
def test_written_files(spark, tmp_path, most):
    df = spark.createDataFrame([(f"n{i}", f"line {i}\n\nend é") for i in range(most)], "name string, c string")
    files.write_texts(df, str(tmp_path / "w"), "name", "c", "page.md")
    got = {r["path"]: r["content"] for r in files.scan(spark, str(tmp_path / "w")).collect()}
    assert got == {f"name=n{i}/page.md": f"line {i}\n\nend é\n" for i in range(most)}
