import random

import pytest
from pyspark.sql import functions as F

from strata.operators import admin, code, context, graphs, markdown, rank, sentences


def split(spark, texts, how):
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", how(F.col("t")).alias("s")).collect()
    return [r["s"] for r in sorted(rows)]


def test_sentences_keep_protected_spans(spark):
    cases = [("See [a. b](c.d) now. Next", "[a. b](c.d)"), ("At https://x.y/z.html there. B", "https://x.y/z.html"), ("Use v1.2.3 here. B", "v1.2.3"), ("Steps 4.1.1~4.1.5 done. B", "4.1.1~4.1.5"), ("Edit core/main.go soon. B", "core/main.go"), ("Pi is 3.14 about. B", "3.14"), ("Some, e.g. this one. B", "e.g.")]
    for (_, span), out in zip(cases, split(spark, [t for t, _ in cases], sentences.masked_sentences), strict=True):
        assert sum(span in s for s in out) == 1 and len(out) == 2
    assert split(spark, ["A. B!\nC? ", None, "x4.1.1y", "1. First. 2. more", "", "4.1.1.1"], sentences.masked_sentences) == [["A", "B", "C"], [], ["x4.1", "1y"], ["1. First", "2", "more"], [], ["4.1", "1.1"]]
    keep = lambda t: sentences.masked_sentences(t, keep_ends=True)
    assert split(spark, ["A one. B two!\n\nC", None, "", "See a/b.md. [x. y](z) ok?  Yes"], keep) == [["A one.", "B two!", "C"], [], [], ["See a/b.md.", "[x. y](z) ok?", "Yes"]]


def brute(text):
    """Sentences without ends: spans over the whole text at once, chosen one after the other."""
    import regex

    t = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    found = []
    for pattern, before, after in [*sentences.SPANS, (r"(?m)^\s{0,3}[0-9]+\.(?=\s|\z)", "", "")]:
        for m in regex.finditer(pattern.replace(r"\z", r"\Z"), t):
            if not (before and regex.search(before, t[max(0, m.start() - 1) : m.start()])) and not (after and regex.search(after, t[m.end() : m.end() + 1])):
                found.append(m.span())
    taken = []
    for a, b in sorted(set(found), key=lambda x: (x[0] - x[1], x[0])):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
    kept = "".join("\0" if c in sentences.SIGNS and any(a <= i < b for a, b in taken) else c for i, c in enumerate(t))
    out, at = [], 0
    for part in regex.split("[.!?。！？…]", kept):
        out.append(t[at : at + len(part)].strip())
        at += len(part) + 1
    return [s for s in out if s]


def test_sentences_against_brute_force(spark):
    r = random.Random(8)
    pieces = ["word", "e.g.", "i.e.", "v1.2", "v10.20.3", "3.14", "1.2.3", "1.2.3.4", "2.0.1~2.0.9", "a/b.md", "é/x.py", "x.go.", "https://a.b/c", "https://[x](y. z)", "[t. u](v w)", "![i.](j.png)", "[", "](", "10.", " 2.", "\n3. item", "...", "。", "!", "?", "\n", "\n\n", "*", "~", "etc.", "Vv1.1", ".md", "x" * 40]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", ". ", "."]) for _ in range(r.randint(1, 14))) for _ in range(1500)] + ["no 1.2 " * 9000, "a.b" * 3000, "[" * 3000, "1.1" * 500]
    for t, got in zip(texts, split(spark, texts, sentences.masked_sentences), strict=True):
        assert got == brute(t), t[:300]


def test_segments(spark):
    texts = ["Dr. Smith met J. R. Ewing. He left... then came back! \"Go. Now.\" was said.", "One.) Two.\nThree", "No. 5 is in v1.2. Next", "한국어 문장. 다음\n줄", "mr. x. y", "Wait... What? Yes", None]
    got = split(spark, texts, sentences.language_aware)
    assert got == [["Dr. Smith met J. R. Ewing.", "He left... then came back!", "\"Go. Now.\"", "was said."], ["One.)", "Two.", "Three"], ["No. 5 is in v1.2.", "Next"], ["한국어 문장.", "다음\n줄"], ["mr. x.", "y"], ["Wait...", "What?", "Yes"], []]


DOC = "intro\n# A\ntext\n## B\nmore\n```\n# not a heading\n```\n### C\n# D\nlast"


def test_headings_sections(spark):
    df = spark.createDataFrame([(1, DOC), (2, "plain"), (3, None), (4, "")], "k int, c string")
    toc = {(r["k"], r["section_id"]): r for r in markdown.headings(df, "k", "c").collect()}
    assert [(toc[1, f"s{i}"]["path"], toc[1, f"s{i}"]["parent_section_id"]) for i in range(4)] == [("A", None), ("A > B", "s0"), ("A > B > C", "s1"), ("D", None)]
    assert markdown.headings(df, "k", "c", fence_aware=False).where("k = 1").count() == 5
    rows = sorted((r["k"], r["chunk_no"], r["section_id"], r["text"]) for r in markdown.sections(df, "k", "c").collect())
    assert [r[2] for r in rows if r[0] == 1] == ["root", "s0", "s1", "s2", "s3"]
    assert [r for r in rows if r[0] == 2] == [(2, 0, "root", "plain")] and not [r for r in rows if r[0] > 2]
    assert rows[2][3] == "## B\nmore\n```\n# not a heading\n```"


CHUNK = "k int, chunk_no int, section_id string, path string, level int, parent_section_id string, text string"


def test_structured_blocks(spark):
    text = "## S\nprose\n1. one\n   more\n2. two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter\n```go\nx\n"
    chunk = (1, 0, "s0", "S", 2, None, text)
    rows = [chunk, (1, 1, "s1", "S", 2, None, "1. x"), (1, 2, "s2", "", 2, None, "![a \"b\"](c/d.png)"), (2, 0, "root", "", 1, None, ""), (2, 1, "s0", "x", 1, None, None)]
    out = sorted(markdown.expand_blocks(spark.createDataFrame(rows, CHUNK), "k").collect(), key=lambda r: (r["k"], r["chunk_no"]))
    assert [(c["section_id"], c["section_type"], c["parent_section_id"]) for c in out] == [("s0", "heading", None), ("o1", "ordered", "s0"), ("t1", "table", "s0"), ("c1", "code", "s0"), ("s1", "heading", None), ("o2", "ordered", "s1"), ("s2", "heading", None), ("i1", "image", "s2"), ("root", "heading", None), ("s0", "heading", None)]
    assert out[0]["text"] == "## S\nprose\n\nafter" and out[1]["text"] == "1. one\nmore\n2. two"
    assert out[2]["metadata"] == '{"block_type": "table", "headers": ["a", "b"], "column_count": 2, "separator_row": "| --- | --- |"}' and out[3]["text"] == "```go\nx"
    assert out[3]["metadata"] == '{"block_type": "code", "language": "go"}' and out[7]["metadata"] == '{"block_type": "image", "alt": "a \\"b\\"", "url": "c/d.png"}' and out[7]["path"] == "i1" and out[5]["path"] == "S > o2"


def block_kinds(lines):
    """(kind, number) of each line, looking ahead from the line at which a block begins."""
    import re

    def is_table(k):
        cells = [c.strip() for c in re.sub(r"^\||\|$", "", lines[k + 1].replace(" ", "").strip()).split("|")] if k + 1 < len(lines) else []
        return "|" in lines[k] and k + 1 < len(lines) and "|" in lines[k + 1] and all(not c or re.fullmatch("[-:]{3,}", c) for c in cells)

    out, no, i = [], 0, 0
    starts = lambda k, *signs: lines[k].strip().startswith(signs)
    while i < len(lines):
        j = i + 1
        if starts(i, "```"):
            kind = "c"
            while j < len(lines) and not starts(j, "```"):
                j += 1
            j = min(j + 1, len(lines))
        elif re.match(r"!\[[^\]]*\]\([^)]+\)$", lines[i].strip()):
            kind = "i"
        elif is_table(i):
            kind, j = "t", i + 2
            while j < len(lines) and lines[j].strip() and "|" in lines[j]:
                j += 1
        elif re.match(r"\s{0,3}\d+\.\s+\S", lines[i]):
            kind = "o"
            while j < len(lines) and lines[j].strip() and not re.match(r"#{1,6}\s+\S", lines[j].strip()) and not starts(j, "```") and not re.match(r"!\[[^\]]*\]\([^)]+\)$", lines[j].strip()) and not is_table(j):
                j += 1
        else:
            kind = ""
        no += kind != ""
        out += [(kind, no if kind else 0)] * (j - i)
        i = j
    return out


def test_blocks_against_brute_force(spark):
    r = random.Random(3)
    some = ["prose", "", "```py", "```", "  ``` | x", "![a](b)", " ![a](b) ", "1. one", "   2. two", "    3. deep", "| a | b |", "| --- | :-: |", "|---|", "x | y", "--- | ---", "## head", "#no head", "1.x", "| | |"]
    bodies = [[r.choice(some) for _ in range(r.randint(1, 14))] for _ in range(900)]
    df = spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(bodies)], "i int, body string")
    got = {x["i"]: x["b"] for x in df.select("i", markdown.block_lines(F.col("body")).alias("b")).collect()}
    for i, lines in enumerate(bodies):
        want = block_kinds(lines) if lines != [""] else []
        assert [(x["kind"], x["no"]) for x in got[i]] == want, lines
        assert [x["line"] for x in got[i]] == (lines if want else [])


def pieces(s, most):
    """Cuts of a text, one place after the other from the far end of each window."""
    s, out, start = (s or "").strip(), [], 0
    while start < len(s):
        end = len(s)
        if end - start > most:
            end = start + most
            for e in range(start + most, start, -1):
                c, after = s[e - 1], s[e]
                if c in "\n,|;)}" or (c in ".!?" and after.isspace()) or (c == "-" and e - 2 >= start and s[e - 2] == "\n") or (c.isspace() and 2 * (e - start) >= most):
                    end = e
                    break
                if c in "({" and e - 1 > start:
                    end = e - 1
                    break
        out.append(s[start:end].strip())
        start = end
        while start < len(s) and s[start].isspace():
            start += 1
    return out


def test_fixed_chunks_against_brute_force(spark):
    r = random.Random(4)
    some = ["word", "a", "x" * 30, ",", ". ", ".", "! ", "\n", "\n-", "(", "{", ")", " ", "  ", "\t", "é", "😀", "|"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 400))) for _ in range(300)] + [None, "", " ", "x" * 25, "word " * 200 + ". " + "next " * 200, "x" * 50_000, "(" * 300]
    df = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    for most in (2, 10, 120):
        got = {x["i"]: x["p"] for x in df.select("i", markdown.cut_fixed(F.col("t"), most).alias("p")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pieces(t, most), (most, t)
    assert [(x["section_id"], x["text"]) for x in markdown.fixed_chunks(df.where("i = 303"), "i", "t", 10).collect()] == [("s0", "x" * 10), ("s1", "x" * 10), ("s2", "x" * 5)]


SOURCE = "import os\n\nasync def f(x):\n    return x\n\n\nclass A:\n    def m(self):\n        pass\n"


def test_code_round_trip(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, "x = 1"), (3, ""), (4, "\n\ndef g():\n  1")], "k int, c string")
    lines = code.code_lines(df, "k", "c")
    own = [(r["line_num"], r["node_type"], r["is_anchor"], r["parent_idx"]) for r in lines.where("k = 1").orderBy("line_num").collect()]
    assert own[0] == (1, "expression_statement", False, -1) and own[2][2] and own[3][3] == 2 and own[6][1] == "class_definition" and own[7] == (8, "expression_statement", False, 6)
    chunks = {(r["k"], r["section_id"]): r["title"] for r in code.code_chunks(df, lines, "k").collect()}
    assert chunks == {(1, "pre"): "", (1, "fn1"): "f", (1, "fn2"): "A", (2, "f1"): "", (3, "f0"): "", (4, "fn1"): "g"}
    restored = {r["k"]: r["content"] for r in code.restore_code(code.code_atoms(lines, "k"), "k").collect()}
    assert restored[1] == SOURCE[:-1] and restored[2] == "x = 1"
    atoms = code.code_atoms(lines, "k").where("k = 1 and embedded").count()
    assert atoms == 2


def test_search_terms():
    assert rank.search_terms("역할(Cinder, ost-stor-01) the 있는가 of") == ["cinder", "ost-stor-01", "ost", "stor", "01"]
    assert rank.search_terms("있는가 어디") == [] and not rank.technical("a")


def test_fusion(spark):
    dense = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7)], "l3_id string, score double")
    sparse = spark.createDataFrame([("c", 5.0), ("d", 4.0)], "l3_id string, score double")
    rows = rank.fuse(dense, sparse).collect()
    assert [r["l3_id"] for r in rows] == ["c", "a", "b", "d"] and rows[3]["score"] == 4.0 and rows[0]["score"] == 0.7
    assert [r["l3_id"] for r in rank.fuse(dense, sparse, alpha=0.0, limit=2).collect()] == ["c", "d"]
    assert [r["l3_id"] for r in rank.fuse(dense, sparse.limit(0)).collect()] == ["a", "b", "c"]
    assert rank.lexical_top(spark.createDataFrame([("a", "x")], "l3_id string, content string"), "있는가").count() == 0


def test_dense(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), (None, [1.0, 0.0])], "l3_id string, vector array<float>")
    assert [r["l3_id"] for r in rank.dense_top(df, [1.0, 0.0], 3).collect()] == ["a", "c", "b"]


def test_context_budget_and_neighbours(spark):
    atoms = spark.createDataFrame([("s", i * 1000, f"t{i}", f"id{i}") for i in range(6)] + [("s", 6000, "  ", "id6")], "l2_id string, sort_order int, content string, l3_id string")
    frame = {r["sort_order"]: r["surrounding_context"] for r in context.neighbour_frame(atoms).collect()}
    assert frame[0] == "t0\n\nt1\n\nt2" and frame[5000] == "t3\n\nt4\n\nt5"
    near = context.neighbours(atoms.where("sort_order = 2000"), atoms, 1500)
    assert sorted(r["n_content"] for r in near.collect()) == ["t1", "t2", "t3"]
    df = spark.createDataFrame([(["a b", "c", "d e f"],)], "t array<string>")
    for budget, want in [(0, 0), (4, 1), (6, 2), (100, 3)]:
        assert len(df.select(context.within_budget(F.col("t"), F.lit(budget)).alias("x")).first()["x"]) == want


def test_graph(spark):
    files = spark.createDataFrame([("f1", "a/x.md"), ("f2", "a/y.md"), ("f3", "b/z.md"), ("f4", "top.md")], "f string, p string").withColumn("pr", F.lit(1))
    edges = graphs.directory_edges(files, "f", "p", "pr")
    seeds = spark.createDataFrame([(1, "f1")], "project int, file string")
    assert [r["file"] for r in graphs.siblings(edges, seeds).collect()] == ["f2"]
    assert graphs.siblings(edges, spark.createDataFrame([(2, "f1")], "project int, file string")).count() == 0


def test_upserts_and_merkle(spark):
    import hashlib

    old = spark.createDataFrame([(1, "a", 5, 1), (2, "b", 6, 3)], "machine_id int, title string, project_id int, version int")
    new = spark.createDataFrame([(2, "B", None, 1), (3, "c", 7, 1)], "machine_id int, title string, project_id int, version int")
    assert sorted(map(tuple, admin.upsert_versions(old, new, "machine_id").collect())) == [(1, "a", 5, 1), (2, "B", 6, 4), (3, "c", 7, 1)]
    rows = [(1, m, hashlib.sha256(str(m).encode()).hexdigest()) for m in (3, -1, 2)]
    random.Random(1).shuffle(rows)
    h = hashlib.sha256()
    for _, m, x in sorted(rows, key=lambda r: r[1]):
        h.update(m.to_bytes(8, "big", signed=True) + bytes.fromhex(x))
    df = spark.createDataFrame(rows, "p int, m bigint, h string")
    for parts in (1, 8):
        assert admin.merkle(df.repartition(parts), "p", "m", "h").first()["content_hash"] == h.hexdigest()


def test_batches_of_queries(spark, monkeypatch):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "id int, v array<double>")
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    whole = sorted(map(tuple, rank.dense_top_each(rows, asked, 4, "id", "v").collect()))
    monkeypatch.setattr(rank, "BLOCK", 6)
    assert sorted(map(tuple, rank.dense_top_each(rows, asked, 4, "id", "v").collect())) == whole and len(whole) == 80


def test_summary(spark):
    log = spark.createDataFrame([("[md] x OK",), ("[code] y",), ("OK",)], "line string")
    assert tuple(admin.ingest_summary(log).first()) == (1, 1, 2)
    assert admin.rolled_up(spark.createDataFrame([("ok",)], "status string")).first()[0] == "ok"


@pytest.mark.parametrize("parts", [1, 8])
def test_chunk_hash_is_order_free(spark, parts):
    df = spark.createDataFrame([(1, f"s{i}", None, "heading", "p", f"t{i}") for i in range(9)], "k int, section_id string, parent_section_id string, section_type string, path string, text string")
    assert markdown.chunk_hash(df.repartition(parts), "k").first()["l2_child_hash"] == markdown.chunk_hash(df.coalesce(1), "k").first()["l2_child_hash"]
