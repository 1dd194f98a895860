import json

from siltstone.operators import openapi

SPEC = {
    "openapi": "3.0.0",
    "paths": {
        "/users/{id}": {"get": {"operationId": "getUser", "tags": ["a"], "security": [{"k": []}], "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}], "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/User"}}}}}}},
        "/users": {"post": {"deprecated": True, "requestBody": {"required": True, "content": {"application/json": {"schema": {"$ref": "#/components/schemas/NewUser"}}}}, "responses": {"201": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/x/User"}}}}}}}, "options": {}},
    },
    "components": {"schemas": {
        "User": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "at": {"type": "string", "format": "date-time"}}},
        "NewUser": {"allOf": [{"$ref": "#/components/schemas/User"}, {"properties": {"at": {"type": "string"}, "name": {"type": "string"}}, "required": ["name"]}]}, "Color": {"type": "string", "enum": ["r", "g"]}, "Note": {"properties": {"text": {"type": "string"}}},
    }},
}


def test_operations_and_schemas(spark):
    files = spark.createDataFrame([(1, json.dumps(SPEC)), (2, None), (3, "{"), (4, '{"openapi": 1'), (5, '{"swagger": "2.0", "basePath": "/v1", "paths": {"/a": {"get": {"responses": {"200": {"schema": {"type": "string"}}}}}}}')], "file_id bigint, content string")
    docs = openapi.documents(files)
    rows = {(r["method"], r["path"]): r for r in openapi.operations(docs).collect()}
    assert set(rows) == {("GET", "/users/{id}"), ("POST", "/users"), ("GET", "/v1/a")}
    one, two = rows["GET", "/users/{id}"], rows["POST", "/users"]
    assert (one["name"], one["returnType"], one["auth"], one["tags"]) == ("getUser", "User", True, ["a"])
    assert [tuple(p) for p in one["parameters"]] == [("id", "string", True, "path")] and [tuple(p) for p in two["parameters"]] == [("body", "NewUser", True, "body")]
    assert (two["name"], two["returnType"], two["deprecated"]) == ("post /users", "User[]", True) and rows["GET", "/v1/a"]["returnType"] == "string"
    assert openapi.operations(docs, include_deprecated=False).count() == 2
    types = {r["name"]: (r["kind"], [tuple(f) for f in r["fields"]], r["values"]) for r in openapi.schemas(docs).collect()}
    assert types["User"][:2] == ("entity", [("id", "integer", True), ("at", "Date", False)])
    assert sorted(types["NewUser"][1]) == [("at", "string", False), ("id", "integer", True), ("name", "string", True)] and types["NewUser"][0] == "entity"
    assert types["Color"][0] == "enum" and types["Color"][2] == ["r", "g"] and types["Note"][0] == "object"
    assert openapi.operations(openapi.documents(files.where("false"))).count() == 0
