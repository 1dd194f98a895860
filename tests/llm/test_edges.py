"""Every operator on tables with nulls in any column, empty and long texts, repeated rows, clashing extra columns, and on empty tables."""

import pytest

from siltstone.llm import mixing, packing, pairs, passages, profiles, provenance, secrets, validity

LONG = "// this step only reads the list again\nlet a = 1;\n" * 8000
EXTRA = "kind string, units string, key string, lang string, part string, out string, k0 string, spans string, broken string, symbols string"
NULLS = (None,) * 10


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (1, "r", "a.js", "// der Dienst speichert die Zeilen der Tabelle\nfunction f() { return 1; }\n", *NULLS), (1, "r", "a.js", "// der Dienst speichert die Zeilen der Tabelle\nfunction f() { return 1; }\n", *("x",) * 10),
        (2, None, "b.js", "let a = ;\n", *NULLS), (3, "r", None, "x", *NULLS), (4, "r", "c.py", None, *NULLS), (5, "r", "d.py", "", *NULLS), (None, "r", "e.json", '{"password": "Morchel4008#tofu"}', *NULLS), (7, "r", "f.bin", "\x00퟿", *NULLS), (8, "r", "g.js", LONG, *NULLS),
    ]
    return spark.createDataFrame(rows, f"file_id bigint, repo string, path string, content string, {EXTRA}")


@pytest.fixture(scope="module")
def docs(spark):
    lines = {"en": "the service stores the rows of the table and reads the list again", "de": "der Dienst speichert die Zeilen der Tabelle und liest die Liste noch einmal"}
    rows = [(i, lines[c] * (1 + i % 3), c, "guide" if i % 2 else " Memo ", "x", "y") for i, c in enumerate(["en", "de"] * 6)]
    rows += [(50, None, "en", "guide", None, None), (51, "", None, None, None, None), (None, lines["de"], "English", "memo", None, None), (52, lines["de"] + "\n" + lines["en"], "", "memo", None, None), (53, "word " * 30_000, "xx", "guide", None, None), (3, lines["de"], "de", "guide", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tokens string, segment_no string")


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([("en", "English"), ("de", "German"), (None, None)], "code string, name string")


def test_origin(files):
    rows = provenance.classify_files(files).collect()
    assert sorted(r["file_id"] for r in rows if r["file_id"]) == [1, 1, 2, 5, 8] and all(r["kind"] is None for r in rows if r["file_id"] in (1, 2, 5))
    assert provenance.classify_files(files.where("false")).count() == 0


def test_validity(files):
    rows = [(r["file_id"], r["broken"]) for r in validity.judge_files(files).collect()]
    assert sorted(rows, key=str) == sorted([(1, False), (1, False), (2, True), (5, False), (None, False), (8, False)], key=str)
    rates = {(r["repo"], r["language"]): r["rate"] for r in validity.rates(validity.judge_files(files)).collect()}
    assert rates[None, "js"] == 1.0 and rates["r", "js"] == 0.0
    assert validity.judge_files(files.where("false")).count() == 0


def test_passages(spark, files, docs, codes):
    ends = spark.createDataFrame([(1, "p", None, 1), (2, None, "der Dienst speichert die Zeilen der Tabelle", 1), (3, "p", "", 1)], "row_id bigint, project string, description string, lang int")
    rows = passages.passages(files, ends, docs, codes)
    assert sorted(tuple(r) for r in passages.found(rows).collect()) == [("endpoint", 2, "de"), ("file", 1, "de")]
    assert len([r for r in rows.where("record_id = 8").collect()]) == 8000
    assert passages.passages(files, ends, docs.where("false"), codes).count() == 0
    assert passages.passages(files.where("false"), ends.where("false"), docs, codes).count() == 0


def test_credentials(spark, files):
    configs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "t074fRkKutTjcJ6uVQoIjs9seT0TexYm", "x"), (3, "t074fRkKutTjcJ6uVQoIjs9seT0TexYm", "x"), (None, "TODO", None)], "config_id bigint, apiKey string, found string")
    rows = sorted((r["record"], str(r["record_id"])) for r in secrets.found(files, configs).collect())
    assert rows == [("config", "3"), ("config", "3"), ("file", "None")]
    assert secrets.found(files.where("false"), configs.where("false")).count() == 0
    assert {r["content"] for r in secrets.redacted(files, configs).collect()} == {"REDACTED", '{"password": "REDACTED"}'}


def test_pairs(spark, files):
    field = "fields array<struct<name:string,type:string,required:boolean,description:string>>"
    types = spark.createDataFrame([(1, "r", "a.js", "User", "type", "Someone who may sign in here.", [("id", None, None, None), (None, None, None, None)], "x"), (2, None, None, None, None, None, None, None), (3, "r", "a.js", "A", None, "", [], None)], f"type_id bigint, repo string, filePath string, name string, kind string, description string, {field}, owner string")
    ends = spark.createDataFrame([("r", "a.js", ".f", "x"), (None, None, None, None)], "project string, filePath string, handler string, name string")
    rows = sorted(tuple(r) for r in pairs.found(files, ends, types).collect())
    assert rows == [("function", 1, "", "f"), ("handler", 1, "", "f"), ("type", 1, "", "User")]
    assert pairs.found(files.where("false"), ends.where("false"), types.where("false")).count() == 0
    assert {r["record"] for r in pairs.pairs(files, types).collect()} == {"function", "type"}


def test_declarations_document_their_definitions(spark):
    head = "/** Sums the rows of the given table. */\nint total(const int *rows, int n);\nint other(int n);\n"
    code = "int total(const int *rows, int n) {\n  return n;\n}\n\nint other(int n) {\n  return n;\n}\n"
    rows = [(1, "r", "a.h", head), (2, "r", "a.c", code), (3, None, "b.c", code)]
    types = spark.createDataFrame([], "type_id bigint, repo string, filePath string, name string, kind string, description string, fields array<struct<name:string,type:string,required:boolean,description:string>>")
    got = [(r["record_id"], r["name"], r["doc_from"]) for r in pairs.pairs(spark.createDataFrame(rows, "file_id bigint, repo string, path string, content string"), types).collect()]
    assert got == [(2, "total", "declaration")]


def test_found_takes_documented_declarations(spark):
    head = "/** Sums the rows of the given table. */\nint total(const int *rows, int n);\n/** Sums the rows of another table. */\nint other(long n);\nint both(int n);\n"
    code = "int total(const int *rows, int n) {\n  return n;\n}\n\nint other(int n) {\n  return n;\n}\n\n/** Counts the rows of both tables. */\nint both(int n) {\n  return n;\n}\n"
    files = spark.createDataFrame([(1, "r", "a.h", head), (2, "r", "a.c", code), (3, None, "b.c", code)], "file_id bigint, repo string, path string, content string")
    types = spark.createDataFrame([], "type_id bigint, repo string, filePath string, name string, kind string, description string, fields array<struct<name:string,type:string,required:boolean,description:string>>")
    ends = spark.createDataFrame([("r", "a.c", ".total")], "project string, filePath string, handler string")
    got = sorted(tuple(r) for r in pairs.found(files, ends, types).collect())
    assert got == [("function", 2, "", "both"), ("function", 2, "", "total"), ("function", 3, "", "both"), ("handler", 2, "", "total")]


def test_containers(spark, docs):
    kinds = spark.createDataFrame([("small", 16, "x"), ("none", None, None), ("zero", 0, None)], "container_kind string, capacity_tokens int, size string")
    rows = packing.pack_documents(docs, kinds).collect()
    assert {r["container_kind"] for r in rows} == {"small"}
    fill = {}
    for r in rows:
        if r["container_no"] is not None:
            fill[r["container_no"]] = fill.get(r["container_no"], 0) + r["tokens"]
    assert max(fill.values()) <= 16 and len([r for r in rows if r["doc_id"] == 53]) > 1000
    assert packing.pack_documents(docs.where("false"), kinds).count() == 0
    assert packing.pack_documents(docs, kinds.where("false")).count() == 0


def test_mixture(spark, docs, codes):
    targets = spark.createDataFrame([("Guide", 0.5, 2, "x"), ("memo", 0.5, 3, "y"), (None, 0.1, 1, None), ("gone", 0.2, None, None)], "source string, target_share double, max_repeats int, tokens string")
    rows = mixing.mix(docs, targets, codes).collect()
    assert {r["source"] for r in rows} == {"guide", "memo"} and all(r["copies"] >= 1 for r in rows)
    shares = {r["source"]: r["tokens"] for r in mixing.shares(mixing.mix(docs, targets, codes), targets.where("source is not null")).collect()}
    assert shares["gone"] == 0
    assert mixing.mix(docs.where("false"), targets, codes).count() == 0
    assert mixing.mix(docs, targets.where("false"), codes).count() == 0


def test_language_labels(docs, codes):
    rows = {(r["doc_id"], r["segment_no"]): r["lang"] for r in profiles.found(docs, codes).collect()}
    assert rows[52, 1] == "de" and rows[52, 2] == "en" and rows[None, 0] == "de" and (50, 0) not in rows and (51, 0) not in rows
    assert profiles.found(docs.where("false"), codes).count() == 0
    assert profiles.found(docs, codes.where("false")).count() == 0
