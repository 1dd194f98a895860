"""Operators of the core on small tables made by hand: nulls, empty tables, repeated rows, ties, clashing columns."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import collections, detect, extract, graph, memos, pages, search, versions
from siltstone.sources import files
from siltstone.streaming import watch

PARAM = "struct<name:string,type:string,required:boolean,defaultValue:string,description:string,location:string>"
ENDPOINTS = f"row_id bigint, project string, snapshot_no int, received_at timestamp, protocol string, httpMethod string, path string, operationType string, fieldName string, name string, handler string, handlerClass string, returnType string, serviceRef string, auth boolean, deprecated boolean, parameters array<{PARAM}>, filePath string"


def endpoint(i, no, path, params=(), project="p", name="n", handler="C.n", returns="User", **more):
    ps = [(n, t, r, None, None, None) for n, t, r in params] if params is not None else None
    row = {"row_id": i, "project": project, "snapshot_no": no, "received_at": datetime.datetime(2024, 1, 1), "protocol": "rest", "httpMethod": "GET", "path": path, "name": name, "handler": handler, "handlerClass": "C", "returnType": returns, "serviceRef": "UserService", "parameters": ps, "filePath": "src/a/b.ts"} | more
    return tuple(row.get(c.split()[0]) for c in ENDPOINTS.replace(PARAM, "x").split(", "))


@pytest.fixture(scope="module")
def endpoints(spark):
    rows = [
        endpoint(1, 1, "/a", [("id", "int", True), ("q", "string", False)]), endpoint(2, 1, "/b"), endpoint(3, 1, "/c", None),
        endpoint(4, 3, "/a", [("id", "int", True), ("q", "string", True), ("z", "int", True)], returns="User[]"), endpoint(5, 3, "/c"), endpoint(6, 3, "/d"), endpoint(7, 3, "/d"),
        endpoint(8, 1, "/x", project=None), endpoint(9, None, "/y"), endpoint(10, 2, None, project="q", httpMethod=None, name=None),
    ]
    return spark.createDataFrame(rows, ENDPOINTS)


def test_versions_meet_the_delivered_one_before(endpoints):
    rows = {r["id"]: r for r in versions.compare_endpoints(endpoints).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"GET:/a": "modified", "GET:/b": "removed", "GET:/c": "unchanged", "GET:/d": "added"}
    assert sorted((p["name"], p["status"]) for p in rows["GET:/a"]["params"]) == [("q", "modified"), ("z", "added")]
    assert versions.compare_endpoints(endpoints.where("false")).count() == 0


def test_breaking_changes_and_release_notes(endpoints):
    held, delivered = collections.held(endpoints), versions.versions(endpoints)
    found = (versions.compare_endpoints(endpoints), versions.compare_entities(collections.entities(held), delivered), versions.compare_types(collections.types(held), delivered))
    reasons = sorted((r["severity"], r["reason"]) for r in versions.breaking(*found).collect())
    assert reasons == [
        ("critical", "Endpoint removed: GET /b"), ("critical", "New required parameter: z (int)"), ("critical", "Parameter became required: q"),
        ("warning", "Column nullability changed: q"), ("warning", "Return type changed: User → User[]"),
    ]
    log = versions.change_log(found[0], found[1], versions.compare_services(collections.services(held), delivered))
    note = versions.release_notes(log).collect()[0]["note"]
    assert note.startswith("## [3]\n\n### Added\n\n- **Endpoint**: `n` - GET /d\n\n### Changed\n\n") and "return type: User → User[]; parameters: 2 → 3" in note and note.endswith("### Removed\n\n- **Endpoint**: `n` - GET /b\n\n")


def test_nested_lists_keep_the_last_of_a_name(spark):
    df = spark.createDataFrame([([("a", 1), ("a", 2), (None, 1)], [("a", 2), (None, 3)]), (None, []), ([], None)], "o array<struct<n:string,v:int>>, w array<struct<n:string,v:int>>")
    rows = [[tuple(x) for x in r[0]] for r in df.select(versions.nested(F.col("o"), F.col("w"), "n", ("v",))).collect()]
    assert rows == [[(None, "modified", 1, 3)], [], []]


def test_search_takes_words_titles_and_vectors(spark):
    docs = spark.createDataFrame([(1, "Order pages", "how orders are listed"), (2, "Other", "nothing of use"), (3, None, None), (4, "order", ""), (4, "order", "")], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(7, "order pages"), (8, ""), (9, None), (10, "the of")], "query bigint, text string")
    got = {(r["query"], r["doc_id"]): r["score"] for r in search.hybrid(docs.dropDuplicates(), asked).collect()}
    assert set(got) == {(7, 1), (7, 4)} and got[7, 1] > got[7, 4]
    boosts = {r["doc_id"]: r["boost"] for r in search.title_boosts(docs.dropDuplicates(), asked).collect()}
    assert boosts == {1: 1.0, 4: 0.5}
    assert [r["doc_id"] for r in search.hybrid(docs.dropDuplicates(), asked, only=F.col("doc_id") > 1).collect()] == [4]
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, None), (1, [0.0, 1.0])], "doc_id bigint, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query bigint, embedding array<double>")
    assert (7, 2) in {(r["query"], r["doc_id"]) for r in search.hybrid(docs.dropDuplicates(), asked, vectors, q).collect()}
    assert search.hybrid(docs.where("false"), asked).count() == 0


def test_long_title_words_are_met_too(spark):
    docs = spark.createDataFrame([(1, "x" * 30 + "needle" + "y" * 30, "")], "doc_id bigint, title string, content string")
    asked = spark.createDataFrame([(7, "needle")], "query bigint, text string")
    assert [r["boost"] for r in search.title_boosts(docs, asked).collect()] == [1.0]


def test_places_overlap(spark):
    docs = spark.createDataFrame([(1, "aaa b aa"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [(r["doc_id"], r["positions"]) for r in search.highlights(docs, ["aa", "b"]).collect()] == [(1, "1,2,7,5")]


def test_suggestions_keep_the_words_before(spark):
    docs = spark.createDataFrame([(1, "orders orchard"), (2, "orders"), (3, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "big or"), (8, "orders"), (9, "")], "query bigint, text string")
    got = [(r["query"], r["suggestion"]) for r in search.suggest(search.idf(search.postings(docs, "doc_id", "text"), docs), asked.where("query > 7")).collect()]
    assert got == []
    got = [r["suggestion"] for r in search.suggest(search.idf(search.postings(docs, "doc_id", "text"), docs), spark.createDataFrame([(7, "big orc")], "query bigint, text string")).collect()]
    assert got == ["big orchard"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("UserAPIController", "/users/{id}/:name", '---\ntitle: "A"\ntitle: B\nx\n---\nbody', "app/[id]/[...rest]/index.tsx"), (None, None, None, None)], "n string, p string, t string, f string")
    row, nulls = df.select(
        T.to_kebab(F.col("n")), T.to_snake(F.col("n")), T.snake_to_camel(F.lit("a_bc")), T.path_params(F.col("p")), T.front_matter(F.col("t")), T.body_of(F.col("t")), T.route_of_file(F.col("f")), T.format_bytes(F.lit(1536)), T.format_bytes(F.lit(0)),
        T.base_kind(F.lit("[1]")), T.tag_value(F.lit('json:"id,omitempty" gorm:"x"'), "json"), T.fill_template("{{a}} {{b}}", {"a": F.lit("1")}), T.segment_after(F.lit("src/components/a/b.ts"), "components"), T.node_id(F.lit("--")), T.slug(F.lit("Über ?")), T.unescape_html(F.lit("&lt;a&gt; &amp;lt;")),
    ).collect()
    assert list(row)[:13] == ["user-apicontroller", "user_a_p_i_controller", "ABc", ["id", "name"], {"title": "B"}, "body", "/app/:id/:rest*", "1.5 KB", "0 Bytes", "array", "id,omitempty", "1 {{b}}", "a"]
    assert row[13].startswith("node_") and row[14] == "ber-" and row[15] == "<a> &lt;"
    assert nulls[0] is None and nulls[4] is None and nulls[6] is None


SOURCES = {
    "a.py": 'router = APIRouter(prefix="/v1")\n@router.get("/x/{id}")\nasync def one(id: int, q: str = "") -> str:\n    pass\n\nclass Item(BaseModel):\n    id: int\n    name: str = ""\n\nclass U(Base):\n    __tablename__ = "users"\n    id = Column(Integer, primary_key=True)\n    posts = relationship("Post")\n',
    "A.java": '@RequestMapping("/api")\npublic class UserController {\n  @GetMapping("/users/{id}")\n  public List<User> get(@PathVariable Long id) {}\n  @DeleteMapping\n  public void drop() {}\n}\nrecord P(Map<String, Long> a, int b) {}\n@Entity\n@Table(name = "x")\npublic class E {\n  @Column(name = "n")\n  private String name;\n}\n',
    "a.ts": "@Controller('users')\nexport class UsersController {\n  constructor(private readonly repo: UserRepository, b: Log) {}\n  @Get(':id')\n  async one(@Param('id') id: string): Promise<User> {}\n}\nexport interface User {\n  id: string;\n  tags?: string[];\n}\n@Entity('users')\nexport class UserE {\n  @Column()\n  name: string;\n  @OneToMany(() => Post, p => p.user)\n  posts: Post[];\n}\n",
    "a.go": 'import "github.com/gin-gonic/gin"\nr := gin.New()\ng := r.Group("/v2")\ng.GET("/things/:id", h.Get)\n\ntype Thing struct {\n\tID int `json:"id" gorm:"primaryKey"`\n\tName string\n}\n\ntype Color int\n\nconst (\n\tRed Color = iota\n)\n',
    "a.php": "<?php\nRoute::get('/posts', [PostController::class, 'index']);\nclass A {\n  #[Route('/b/{id}', methods: ['POST'])]\n  public function make(string $x): void {}\n}\n",
    "a.c": '#include "own.h"\n#include <stdio.h>\n#include <curl/curl.h>\n#define MAX(a, b) ((a) > (b))\nstruct pair { int left; int right; };\nstatic int add_pair(struct pair *p) {\n}\n',
    "a.kt": '@RestController\nclass T(private val s: TService) {\n  @PostMapping("/t")\n  suspend fun make(x: String): T {}\n}\ndata class D(\n  val a: String,\n  val b: List<Int>,\n)\n',
    "a.graphql": "type Query {\n  users(first: Int): [User!]!\n  me: User\n}\nenum E {\n  A\n}\nunion U = A | B\n",
    "x.txt": "@Get('no')", "n.ts": None,
}


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(i, "r", p, c, i, "clash") for i, (p, c) in enumerate(SOURCES.items())] + [(99, None, None, "x", 1, "c")], "file_id bigint, repo string, path string, content string, ord bigint, rule string")


def test_routes_of_all_frameworks(sources):
    got = {(r["framework"], r["method"], r["path"], r["handler"]) for r in extract.endpoints(sources).collect()}
    assert got == {
        ("fastapi", "GET", "/v1/x/{id}", "one"), ("spring", "GET", "/api/users/{id}", "get"), ("spring", "DELETE", "/api", "drop"), ("nestjs", "GET", "/users/:id", "one"), ("gin", "GET", "/v2/things/:id", "h.Get"), ("laravel", "GET", "/posts", "PostController"),
        ("symfony", "POST", "/b/{id}", "make"), ("spring_kotlin", "POST", "/t", "make"), ("graphql", "Query", "users", "users"), ("graphql", "Query", "me", "me"),
    }
    assert extract.endpoints(sources.where("false")).count() == 0


def test_types_fields_entities_and_dependencies(sources):
    types = extract.extract(sources, extract.TYPES)
    names = {(r["rule"], r["b"]) for r in types.collect()}
    assert {("pydantic", "Item"), ("java_record", "P"), ("ts_interface", "User"), ("go_struct", "Thing"), ("go_iota", "Color"), ("c_struct", "pair"), ("c_macro", "MAX"), ("c_function", "add_pair"), ("kotlin_data", "D"), ("graphql_enum", "E"), ("graphql_union", "U"), ("php_class", "A")} <= names
    fields = {(r["name"], r["field"], r["type"]) for r in extract.fields(types).collect()}
    assert {("Item", "id", "int"), ("Item", "name", "str"), ("P", "a", "Map<String, Long>"), ("P", "b", "int"), ("User", "tags", "string[]"), ("Thing", "Name", "string"), ("pair", "left", "int"), ("D", "b", "List<Int>"), ("Query", "me", "User")} <= fields
    entities = {(r["rule"], r["a"], r["b"], r["c"]) for r in extract.extract(sources, extract.ENTITIES).collect()}
    assert {("sqlalchemy_table", "entity", "U", "users"), ("sqlalchemy_column", "column", "id", "Integer"), ("sqlalchemy_relation", "relation", "posts", "Post"), ("jpa_column", "column", "name", "String"), ("typeorm_entity", "entity", "UserE", "users"), ("typeorm_column", "column", "name", "string"), ("typeorm_relation", "relation", "OneToMany", "Post"), ("gorm", "column", "ID", "int")} <= entities
    deps = {(r["a"], r["b"]) for r in extract.extract(sources, extract.DEPENDENCIES).collect()}
    assert {("include", "own.h"), ("system", "curl/curl.h")} <= deps
    services = extract.extract(sources, extract.SERVICES)
    assert {(r["source"], r["target"]) for r in extract.injected(services).collect()} == {("UsersController", "UserRepository"), ("UsersController", "Log")}


def test_detection(sources):
    assert {r["framework"] for r in detect.frameworks(sources).collect()} >= {"Gin", "NestJS", "GraphQL", "Spring Boot (Kotlin)"}
    assert {r["language"]: r["percent"] for r in detect.languages(sources.where("path in ('a.py', 'a.ts', 'n.ts')")).collect()} == {"python": 33, "typescript": 67}
    first = [r["parser"] for r in detect.parsers(sources).where("rank = 1 and repo = 'r'").collect()]
    assert first == ["typescript-nestjs"]


def test_graph(spark, endpoints):
    held = collections.held(endpoints).where("snapshot_no = 3")
    services, entities = collections.services(held), collections.entities(held)
    assert [tuple(r) for r in graph.entity_services(services, entities).collect()] == [("p", "User", "C")]
    assert [tuple(r) for r in graph.degrees(graph.service_edges(services)).orderBy("node").collect()] == [("p", "C", 1, 0), ("p", "UserService", 0, 1)]
    code = graph.er_diagram(entities).collect()[0]
    assert code["edges"] == 1 and code["code"].splitlines()[0] == "erDiagram" and '    User ||--o{ User : "OneToMany"' in code["code"]
    assert graph.service_diagram(services).collect()[0]["code"] == 'flowchart TB\n    C["C<br/>1 methods"]'


def test_pages_and_sidebar(spark):
    rows = spark.createDataFrame([("p", "api/a.md", "A", 2), ("p", "api/b.md", "B", 0), ("p", "api/c.md", "C", None), ("p", "hooks/x.md", "X", 5), ("p", "other.md", "O", 1), ("p", None, "N", 1)], "project string, path string, title string, position int")
    got = [(r["section"], r["kind"], r["rank"], r["title"], r["section_position"]) for r in pages.sidebar(rows).orderBy("section", "rank").collect()]
    assert got == [("endpoints", "category", 1, "A", 10), ("endpoints", "category", 2, "B", 10), ("endpoints", "category", 3, "C", 10), ("services", "doc", 1, "X", 5)]
    docs = spark.createDataFrame([(1, "[a](./guide/) [b](guide/one.md#x) [c](https://x.y) [d](gone) [e](#top) [f](../sub)"), (2, None)], "doc_id bigint, text string")
    slugs = spark.createDataFrame([("guide/one",), ("guide/index",), ("sub/z",), ("sub/b",)], "slug string")
    assert {(r["link"], r["target"]) for r in pages.resolved(pages.links(docs), slugs).collect()} == {("./guide/", "guide/index"), ("guide/one.md", "guide/one"), ("gone", "index"), ("../sub", "sub/b")}


def test_memos(spark):
    schema = "page_id string, memo_id string, text string, created_at timestamp"
    t = datetime.datetime(2024, 1, 2)
    a = spark.createDataFrame([("x", "1", "old", t), ("x", "2", "b", None), (None, "3", "c", t)], schema)
    b = spark.createDataFrame([("x", "1", "new", t), ("y", "4", "d", t)], schema)
    assert [(r["page_id"], r["memo_id"], r["text"], r["position"]) for r in memos.merge(a, b).orderBy("page_id", "position").collect()] == [("x", "2", "b", 1), ("x", "1", "new", 2), ("y", "4", "d", 1)]
    assert {(r["memo_id"], r["text"]) for r in memos.displayed(a, b).collect()} == {("1", "new"), ("2", "b"), ("3", "c"), ("4", "d")}
    assert [r["memo_id"] for r in memos.imported(a, b).collect()] == ["4"]
    stores = spark.createDataFrame([('{"version":1,"memos":{"p":[{"id":"1","text":"t","createdAt":"2024-01-02T00:00:00Z"}]}}',), ('{"version":2,"memos":{}}',), ("x",), (None,)], "json string")
    assert [(r["page_id"], r["memo_id"]) for r in memos.parse(stores).collect()] == [("p", "1")]


def test_sources_and_sinks(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, content in (("a/x.ts", "let a"), ("a/node_modules/y.ts", "no"), ("b.py", "x = 1"), ("c.txt", "no"), ("docs/p.md", "---\ntitle: T\n---\n# H\n")):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(content)
    got = {(os.path.basename(r["path"]), r["language"]) for r in files.read_files(spark, str(tree)).collect()}
    assert got == {("x.ts", "typescript"), ("b.py", "python")}
    page = files.read_pages(spark, str(tree)).collect()[0]
    assert page["title"] == "T" and page["body"] == "# H\n"
    (tmp_path / "r.json").write_text('{"results": [{"endpoints": [{"name": "n", "parameters": []}], "types": []}]}')
    (tmp_path / "s.json").write_text('{"endpoints": [{"name": "m"}]}')
    both = files.merged([files.read_results(spark, str(tmp_path / "r.json")), files.read_results(spark, str(tmp_path / "s.json"))])
    assert sorted(r["name"] for r in both["endpoints"].collect()) == ["m", "n"]
    df = spark.createDataFrame([("api/a.md", "A", "## Head\ntext <b>x</b>")], "path string, title string, content string")
    files.write_search_index(df, str(tmp_path / "index"))
    row = spark.read.json(str(tmp_path / "index")).collect()[0]
    assert (row["slug"], row["text"], row["headings"]) == ("api/a", "## Head text x", ["Head"])
    files.write_pages(df, str(tmp_path / "pages"))
    assert spark.read.text(str(tmp_path / "pages"), wholetext=True).collect()[0]["path"] == "api/a.md"
    routed = files.routed(spark.createDataFrame([("src/a.ts",), ("b.java",), (None,)], "path string"), {"nest": "**/*.ts *.tsx", "spring": "*.{java,kt}"})
    assert {(r["path"], r["parser"]) for r in routed.collect()} == {("src/a.ts", "nest"), ("b.java", "spring")}


def test_bursts_collapse_on_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(10)), ("b", at(30)), ("c", None)], "path string, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = watch.watched(watch.file_stream(spark, str(tmp_path / "in"), events))
    watch.run_available(watch.bursts(stream, "path", gap="5 seconds"), str(tmp_path / "state"), str(tmp_path / "out"))
    got = sorted((r["path"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 2)]
    seen = []
    query = watch.rebuild_on_change(watch.file_stream(spark, str(tmp_path / "in"), events), lambda rows, _: seen.append(rows.count()), str(tmp_path / "state2"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 5


def test_domains_props_folders_and_merged_types(spark):
    eps = spark.createDataFrame([("p", "/orders/a", None), ("p", "/orders/b", None), ("p", None, "me"), ("p", None, None), (None, "/x", None)], "project string, path string, fieldName string")
    ents = spark.createDataFrame([("p", "Order"), ("p", "Zebra"), ("p", "Zebra")], "project string, name string")
    got = {(r["domain"], r["endpoints"], r["entities"]) for r in graph.domains(eps, ents).collect()}
    assert got == {("Orders", 2, 1), ("Other", 2, 1)}
    types = spark.createDataFrame([("p", "Card"), ("p", "CardProperty"), ("p", "CardProps"), ("p", "Box"), ("q", "BoxProps"), (None, None)], "project string, name string")
    assert [tuple(r) for r in graph.props_of(types).collect()] == [("p", "Card", "CardProps")]
    paths = spark.createDataFrame([("r", "src/a/x.ts"), ("r", "src/a/b/y.ts"), ("s", "x.ts"), ("t", None)], "repo string, path string")
    assert {tuple(r) for r in graph.common_folder(paths).collect()} == {("r", "src/a"), ("s", "")}
    field = "array<struct<name:string,type:string>>"
    rows = spark.createDataFrame([(2, "r", "T", [("a", "late"), ("c", "x")]), (1, "r", "T", [("a", "first"), ("b", None)]), (3, "r", "T", None), (4, "r", None, [("z", "z")])], f"type_id bigint, repo string, name string, fields {field}")
    assert [(r["field"], r["type"], r["place"]) for r in graph.merged_fields(rows).orderBy("place").collect()] == [("a", "first", 1), ("b", None, 2), ("c", "x", 3)]


def test_reports_ranks_and_heads(spark, endpoints):
    text = versions.report(versions.compare_endpoints(endpoints)).collect()[0]["report"]
    assert text.startswith("# API Changes: 3\n\n| Added | Removed | Modified |\n|---|---|---|\n| 1 | 1 | 1 |\n\n### ~ GET /a\n\n- Return type: `User` → `User[]`\n- Parameters:\n  - ~ `q`: string → string\n  - + `z`: n/a → int")
    hits = spark.createDataFrame([(7, 1, 0.9), (7, 2, 0.9), (8, 3, 0.2)], "query bigint, doc_id bigint, score double")
    assert sorted(tuple(r) for r in search.reranked(hits).collect()) == [(7, 1, 1.0), (7, 2, 0.5), (8, 3, 1.0)]
    few = search.with_fallback(hits.where("query = 8"), spark.createDataFrame([(8, 3, 0.9), (8, 4, 0.5), (8, 5, 0.3)], "query bigint, doc_id bigint, score double"))
    assert [tuple(r) for r in few.orderBy(F.desc("score")).collect()] == [(8, 4, 0.5), (8, 3, 0.2)]
    meta = spark.createDataFrame([("A & B", {"description": 'x "y"', "og_image": "i.png"}), ("C", None)], "title string, meta map<string,string>")
    one, two = (r[0] for r in meta.select(pages.head_tags(F.col("title"), F.col("meta"))).collect())
    assert "<title>A &amp; B</title>" in one and 'name="twitter:card" content="summary"' in one and 'content="x &quot;y&quot;"' in one and two.count("\n") == 2
    flat = endpoints.where("snapshot_no = 3").withColumn("id", F.col("path"))
    code = graph.sequence_diagram(flat).collect()[0]["code"]
    assert code.splitlines()[:4] == ["sequenceDiagram", "    participant Client", "    participant C", "    participant UserService"] and "    C-->>-Client: 200 OK" in code
