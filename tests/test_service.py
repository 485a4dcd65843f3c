import time

import pytest
from pyspark.sql import functions as F

from strata.__main__ import main
from strata.plans import hierarchy, service
from strata.sources import files
from strata.sources.store import Store
from strata.streaming import ingest as streaming

PAGE = "---\ntitle: Alpha\nauthor: x\nnone:\n---\nintro line.\n# One\nKubernetes runs v1.2.3 of list.md. Second one! Second one!\n## Two\n| a | b |\n|---|---|\n| 1 | 2 |\n\n1. item\n2. more\n\n```py\nx = 1\n```\n![i](u.png)\n"
CODE = "import os\n\ndef f(x):\n    return x\n\nclass A:\n    pass\n"


@pytest.fixture(scope="module")
def wiki(tmp_path_factory):
    root = tmp_path_factory.mktemp("wiki")
    (root / "sub").mkdir()
    (root / ".git").mkdir()
    (root / "a-page.md").write_text(PAGE)
    (root / "sub" / "b_two.md").write_text("# Beta\nStorage nodes.\n")
    (root / "sub" / "c.md").write_bytes(b"# Gamma\nMore about storage \xff.\n")
    (root / ".git" / "z.md").write_text("# hidden\n")
    (root / "m.py").write_text(CODE)
    return root


@pytest.fixture(scope="module")
def store(spark, wiki, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    assert service.health(s)["status"] == "degraded"
    done = service.ingest(s, str(wiki))
    assert (done["written"], done["failed"], done["already_up_to_date"]) == (4, 0, False)
    return s


def test_files(spark, wiki):
    rows = {r["source_metadata"]["path"]: r for r in files.records(spark, str(wiki)).collect()}
    assert set(rows) == {"a-page.md", "sub/b_two.md", "sub/c.md", "m.py"}
    assert rows["a-page.md"]["title"] == "Alpha" and rows["a-page.md"]["source_metadata"] == {"author": "x", "path": "a-page.md"}
    assert rows["sub/b_two.md"]["title"] == "B Two" and rows["m.py"]["domain"] == "code" and "\ufffd" in rows["sub/c.md"]["content"]


def test_ingest_again_changes_nothing(store, wiki):
    before = store.read("l3").count()
    again = service.ingest(store, str(wiki))
    assert again["already_up_to_date"] and again["written"] == 0
    forced = service.ingest(store, str(wiki), force=True)
    assert forced["written"] == 0 and forced["skipped"] == 4 and store.read("l3").count() == before


def test_atoms(store):
    l2, l3 = store.read("l2"), store.read("l3")
    section = l2.where("path = 'One' and section_id = 's0'").first()
    atoms = [(r["sort_order"], r["content"], r["embedded"]) for r in l3.where(F.col("l2_id") == section["l2_id"]).orderBy("sort_order").collect()]
    assert atoms == [(0, "# One", False), (1000, "Kubernetes runs v1.2.3 of list.md", True), (2000, "Second one", True)]
    assert section["title_id"] is not None
    for child, parent, key in [("l3", "l2", "l2_id"), ("l2", "l1", "l1_id"), ("l3_vectors", "l3", "l3_id")]:
        assert store.read(child).join(store.read(parent).select(key), key, "left_anti").count() == 0
    assert l3.where("parent_id is not null").join(l3.select(F.col("l3_id").alias("parent_id")), "parent_id", "left_anti").count() == 0


def test_search(store):
    rows = service.search(store, "kubernetes list", detail="summary", top_k=2).collect()
    assert len(rows) == 2 and rows[0]["title"] == "Alpha" and "Kubernetes" in rows[0]["snippet"]
    pid = store.read("projects").first()["id"]
    how = service.Search(hybrid=True, reranker=lambda q: __import__("strata.operators.rank", fromlist=["x"]).overlap_score(q), expand=True)
    raw = service.retrieve(store, "storage nodes", pid, 1, how).collect()
    assert raw[0]["l1_title"] == "B Two" and raw[1]["source"] == "graph_expansion" and raw[1]["score"] is None and raw[1]["l1_title"] == "C"
    text = service.search(store, "storage", format="markdown", project_id=pid).first()["markdown"]
    assert text.startswith("### 1. ") and "\n\n---\n\n" in text
    assert service.search(store, "storage", project_id=12345).count() == 0
    for bad in ({"q": " "}, {"q": "x", "format": "xml"}, {"q": "x", "detail": "huge"}, {"q": "x", "fields": "nope"}, {"q": "x", "fields": " , "}, {"q": "x", "project_id": "one"}):
        with pytest.raises(service.ServiceError):
            service.search(store, **bad)
    assert service.chosen_fields("full", " score, L3_id ,score") == ["score", "l3_id"]
    assert [len(service.chosen_fields(d)) for d in ("summary", "standard", "full", "")] == [7, 12, 13, 13]
    assert service.checked_top_k("0") == 5 and service.checked_top_k("100") == 100 and service.checked_top_k("x") == 5


def test_restore(store):
    docs = {r["path"]: r["current_l1_id"] for r in store.read("documents").collect()}
    text = service.restore(store, l1_id=docs["a-page.md"]).first()["content"]
    assert text == "intro line\n\n# One\n\nKubernetes runs v1.2.3 of list.md Second one\n\n## Two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n1. item\n2. more\n\n```py\nx = 1\n```\n\n![i](u.png)"
    assert service.restore(store, l1_id=docs["m.py"]).first()["content"] == CODE[:-1]
    l2 = store.read("l2").where("section_id = 'fn1'").first()["l2_id"]
    assert service.restore(store, l2_id=l2).first()["content"].startswith("def f(x):")
    with pytest.raises(service.ServiceError):
        service.restore(store)
    assert service.restore(store, l1_id="none").count() == 0


def test_answer(store):
    def llm(q, messages):
        return [{"tool": "search", "arguments": {"query": "kubernetes"}}, {"tool": "answer", "arguments": {"text": "yes"}}][len(messages)]

    out = service.answer(store, "does it run?", llm)
    assert out["status"] == "answered" and out["turns"] == 2 and out["messages"][0]["result"]
    assert service.answer(store, "q", lambda q, m: {"tool": "none"}, turns=2)["status"] == "exhausted"
    assert service.answer(store, "q", lambda q, m: {"text": "plain"})["answer"] == "plain"


def test_unknown_domain_is_kept_as_failure(spark):
    records = hierarchy.records_of(spark, [("t", "c", {}, "odd", 0), ("u", "text. more", {}, "", 0)])
    built = hierarchy.build(records)
    assert built.failures.first()["error_message"] == "unknown domain: odd" and built.documents.count() == 1
    assert hierarchy.build(records.limit(0)).l3.count() == 0


def test_ids_do_not_depend_on_partitions(spark):
    records = hierarchy.records_of(spark, [(f"t{i}", f"# H\nOne {i}. Two.", {}, "wiki", 1) for i in range(20)])
    a, b = (sorted(r["l3_id"] for r in hierarchy.build(records.repartition(n)).l3.select("l3_id").collect()) for n in (1, 8))
    assert a == b and len(a) == 60


def test_cli_codes(spark, store, capsys):
    assert main([store.root, "search", "storage"], spark) == 0
    assert main([store.root, "search", " "], spark) == 2
    assert main([store.root, "search", "x", "--project-id", "99"], spark) == 3
    assert main([store.root, "restore", "--l1-id", "none"], spark) == 4
    assert main([store.root, "reset", "--dry-run"], spark) == 0
    capsys.readouterr()


def test_jobs():
    jobs = service.Jobs()
    a = jobs.submit(lambda: 7, "/p")
    assert jobs.submit(lambda: 8, " /p ") is a

    def boom():
        raise service.ServiceError("bad", "no")

    b = jobs.submit(boom, "/q", "key")
    for _ in range(100):
        if a.ended and b.ended:
            break
        time.sleep(0.02)
    assert (a.status, a.result, b.status, b.failure["code"]) == ("succeeded", 7, "failed", "bad") and jobs.get("hk:key") is b


def test_stream(spark, wiki, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        streaming.start(spark, str(wiki / "sub"), s, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r["title"] for r in s.read("documents").collect()) == ["B Two", "C"]


def test_reset_last(store):
    pid = store.read("projects").first()["id"]
    assert service.reset(store, pid, dry_run=True)["documents"] == 4 and store.read("l3").count() > 0
    service.reset(store, pid)
    assert store.read("l3").count() == 0 and store.read("l3_vectors").count() == 0 and store.read("keywords").count() > 0


def test_stream_takes_code(spark, tmp_path):
    """Code files too; nothing below a directory whose name starts with a dot."""
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "m.py").write_text(CODE)
    (tmp_path / "in" / "p.md").write_text("# P\ntext\n")
    (tmp_path / "in" / ".git" / "z.md").write_text("# hidden\n")
    s = Store(spark, str(tmp_path / "store"), buckets=2)
    streaming.start(spark, str(tmp_path / "in"), s, str(tmp_path / "ck")).awaitTermination(200)
    assert sorted((r["path"], r["source_type"]) for r in s.read("documents").collect()) == [("m.py", "code"), ("p.md", "md")]


def test_expansion_shows_heads_only(spark, tmp_path):
    """After a file changes, its old snapshot is no sibling, not even of itself."""
    s = Store(spark, str(tmp_path / "store"), buckets=2)
    rows = [("a", "# A\nred apples\n", {"path": "d/a.md"}, "", 5), ("b", "# B\ngreen pears\n", {"path": "d/b.md"}, "", 5)]
    service.ingest_records(s, hierarchy.records_of(spark, rows))
    service.ingest_records(s, hierarchy.records_of(spark, [("a", "# A\nred apples and plums\n", {"path": "d/a.md"}, "", 5)]))
    heads = {r["current_l1_id"] for r in s.read("documents").collect()}
    hits = service.retrieve(s, "red apples and plums", 5, 1, service.Search(expand=True)).collect()
    assert len(hits) == 2 and {h["l1_id"] for h in hits} == heads
    assert {r["version"] for r in s.read("documents").collect()} == {1, 2}


def test_merge_touches_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=8)
    rows = lambda ks, v: spark.createDataFrame([(k, f"{v}{k}") for k in ks], "machine_id bigint, canonical_name string")
    s.merge("keywords", rows(range(100), "a"))
    before = s._heads("keywords")[2]
    s.merge("keywords", rows([3], "b"))
    after = s._heads("keywords")[2]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["machine_id"]: r["canonical_name"] for r in s.read("keywords").collect()} == {k: f"{'b' if k == 3 else 'a'}{k}" for k in range(100)}


def test_reset_lets_a_folder_be_ingested_again(spark, wiki, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=2)
    first = service.ingest(s, str(wiki / "sub"))
    service.reset(s, first["project_id"])
    assert service.ingest(s, str(wiki / "sub"))["written"] == first["written"] == 2
