import random

from siltstone.llm import functions, grammar, labelled, lexing, mixing, packing, pairs, passages, profiles, prose, secrets, stages


def credentials(lang, text):
    spans, _ = lexing.lex(lang, text)
    found = secrets.find(lang, text, spans)
    return [text.count("\n", 0, c[0][0]) + 1 for c in found], secrets.redact(text, found)


def test_credentials_and_redaction():
    lines, text = credentials("py", 'a = 1\nAPI_KEY = "Lantern_La" + "ntern9786!"\nPASSWORD_FIELD = "user_password"\nurl = "https://<user>:<pass>@x.example/"\n')
    assert lines == [2]
    assert text.split("\n")[1] == 'API_KEY = "REDACTED" + ""'
    compile(text, "t", "exec")


def test_credentials_in_settings():
    lines, text = credentials("yaml", "kind: Secret\ndata:\n  token: Z2hwX241Y3RSbVR1QkRnQlV2MExadjlhclQwVTNRQkRSWTJETWlVNA==\n  password: ${SECRET}\n  about: none\n")
    assert lines == [3] and "token: REDACTED\n" in text
    assert credentials("json", '{"a": {"password": "<from vault>", "digest": "1c4100ce2c2abf3754f224e518facfca8abbdcd0"}}')[0] == []


def test_usable_keys():
    assert secrets.key_usable(' "t074fRkKutTjcJ6uVQoIjs9seT0TexYm"\n')
    assert secrets.key_usable("${AI_KEY:-sk-tLly49SFajAlkpeUmnXaxRicZoCBwkgCcBpmJhRX}")
    for v in (None, "", "sk-...", "TODO", "${AI_KEY}", "vault:kv/ai/key", "0" * 32, "sk-" + "x" * 40, "<your-key>", "process.env.KEY"):
        assert not secrets.key_usable(v)


def test_passages_join_comments_and_literals():
    text = '// eins zwei\n// drei vier\nconst a = "fünf " + "sechs \\u00fcber acht";\n'
    spans, _ = lexing.lex("js", text)
    assert [" ".join(t.split()) for t in passages.texts_of("js", text, spans)] == ["eins zwei drei vier", "fünf sechs über acht"]


def test_function_owner_and_documentation():
    text = "class A {\n  /** Sums the rows of the given table. */\n  total(rows) {\n    return rows.length;\n  }\n\n  // total\n  other() {}\n}\n"
    spans, _ = lexing.lex("js", text)
    found = {(f["owner"], f["name"]): f["doc"] for f in functions.extract("js", text, spans)}
    assert found[("A", "total")] == "Sums the rows of the given table."
    assert found[("A", "other")] is None


def test_trivial():
    assert prose.is_trivial(None, "x") and prose.is_trivial("Get user by id", "getUserById") and prose.is_trivial("TODO", "x")
    assert not prose.is_trivial("Loads the user and checks the state.", "getUser")


def test_packing_keeps_all_and_never_overfills():
    rng = random.Random(3)
    counts = {}
    for _ in range(3000):
        s = rng.choice([rng.randint(1, 100), rng.randint(1, 20), 100])
        counts[s] = counts.get(s, 0) + 1
    held, ranks = {}, {}
    for size, a, b, first, per in packing.plan(counts, 100):
        for r in range(a, b):
            held.setdefault(first + (r - a) // per, []).append(size)
            ranks.setdefault(size, []).append(r)
    assert all(sum(v) <= 100 for v in held.values())
    assert all(sorted(ranks[s]) == list(range(n)) for s, n in counts.items())
    total = sum(s * n for s, n in counts.items())
    assert len(held) <= 1.03 * -(-total // 100) + 1 and sorted(held) == list(range(len(held)))


def test_pack_splits_only_larger_documents(spark):
    sized = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, 5), (5, 5)], "doc_id bigint, tokens bigint")
    rows = packing.pack(sized, 10).collect()
    assert sorted((r["doc_id"], r["tokens"]) for r in rows) == [(1, 5), (1, 10), (1, 10), (2, 10), (3, 0), (4, 5), (5, 5)]
    assert len({r["container_no"] for r in rows if r["container_no"] is not None}) == 5
    assert packing.pack(sized.where("doc_id < 0"), 10).count() == 0


def test_budgets_go_to_siblings_first():
    leaves = [("a", "en", 100), ("a", "de", 10), ("b", "en", 1000), ("c", "en", 1000)]
    targets = {"a": (0.4, 1), "b": (0.3, 1), "c": (0.3, 1)}
    got = mixing.budgets(leaves, targets, 400, {"a": "x", "b": "x", "c": "y"})
    # What a can't take goes to b of its domain; c keeps its share.
    assert {k: round(v) for k, v in got.items()} == {("a", "en"): 100, ("a", "de"): 10, ("b", "en"): 170, ("c", "en"): 120}
    # A language that is full leaves its rest to the other languages of its source.
    got = mixing.budgets([("a", "en", 1000), ("a", "de", 10)], {"a": (1.0, 2)}, 900, {})
    assert round(got[("a", "de")]) == 20 and round(got[("a", "en")]) == 880


def test_plans_never_pass_the_cap():
    for total in (10, 150, 1000, 5000):
        for _, _, epochs, rest, _ in mixing.plan_of([("a", "en", 100), ("a", "de", 7), ("b", "en", 31)], {"a": (0.5, 2), "b": (0.5, 3)}, total, {}, 0.7):
            assert 0 <= epochs <= 3 and rest >= 0


def test_dominance_fixes_sets_of_two_and_three():
    # 9 goes with 1, 6 with 4 exactly; 7 and 3 exactly; nothing fits beside 10.
    for counts, capacity, want in (({10: 2, 9: 1, 1: 1, 6: 1, 4: 1}, 10, 4), ({5: 1, 3: 2, 2: 2}, 10, 2), ({50: 1, 30: 1, 20: 1, 26: 2}, 100, 2)):
        used = {first + (r - a) // per for _, a, b, first, per in packing.plan(counts, capacity) for r in range(a, b)}
        assert len(used) == want
    assert packing._dominant(50, [20, 26, 30, 50], {50: 1, 30: 1, 20: 1, 26: 1}, 100) == [50, 30, 20]
    assert packing._dominant(50, [1, 26, 30, 50], {50: 1, 30: 1, 1: 3, 26: 1}, 100) is None


LINES = [(t, c) for c, ts in {"en": ["the service stores the rows of the table", "this step only reads the list again"], "de": ["der Dienst speichert die Zeilen der Tabelle", "dieser Schritt liest nur die Liste noch einmal"], "ko": ["이 단계는 목록을 읽기만 하므로 여러 번 실행해도 안전합니다"]}.items() for t in ts * 3]


def test_profiles_and_segments():
    p = profiles.fit(LINES)
    text = "The service reads the table of the rows.\n\n```\nfor x in y: pass\n```\nDer Dienst liest die Zeilen der Liste.\n"
    assert [s[0] for s in profiles.segments_of(profiles.lines_of(p, text))][1:] == ["en", "de"]
    assert profiles.lines_of(p, "") == [] and profiles.segments_of([]) == []
    assert profiles.lines_of_all(p, []) == [] and profiles.lines_of_all(p, ["", "| a |", text]) == [[], [], profiles.lines_of(p, text)]


def test_prose_lines_leave_code_and_tables_out():
    assert labelled.prose_lines("---\ntitle: x\n---\n# Head of it\r\n| a | b |\n|---|---|\n```js\nlet a\n```\n<br>\n") == ["Head of it"]


def broken(lang, text):
    return grammar.broken(lexing.lexed(lang, text, grammar.note))


def test_broken_files():
    assert not broken("py", "def f():\n    return 1\n") and broken("py", "def f(:\n")
    assert not broken("json", '{"a": [1, 2]}') and broken("json", '{"a": [1, 2}')
    assert not broken("go", "package a\n\nfunc f() int {\n\treturn 1\n}\n") and broken("go", "package a\n\nfunc f() int {\n\treturn 1\n")


def test_noise_takes_only_the_piece_of_code_out_of_unspaced_text():
    for text, left in (
        ("夜間のジョブが出荷を28件ずつまとめて送ります", "夜間のジョブが出荷を 件ずつまとめて送ります"),
        ("設定はconfig/app.ymlから読み込まれます", "設定は から読み込まれます"),
        ("此方法读取userId并返回order_items列表", "此方法读取 并返回 列表"),
        ("请先调用/api/users再查询结果", "请先调用 再查询结果"),
        ("詳しくはhttps://a.example/xを参照してください", "詳しくは を参照してください"),
        ("재고는 28건씩 확인하여", "재고는  건씩 확인하여"),
        ("siehe die Größe2 in straße/weg heute", "siehe die   in   heute"),
    ):
        assert labelled.without_noise(text) == left
    assert labelled.prose_lines("夜間のジョブが28件ずつまとめて送ります\n") == ["夜間のジョブが 件ずつまとめて送ります"]


def test_no_file_is_skipped_for_want_of_a_hint():
    for lang, text in (
        ("ts", 'if (this.pin === "tofu-Morchel4008#") {}\n'),
        ("ts", 'const hmacKey = "tofu-Morchel4008#";\n'),
        ("py", 'signing_key = "tofu-Morchel4008#"\n'),
        ("py", 'x = "gh" + "p_n5ctRmTuBDgBuV0LzLv9arT0U3QDRS"\n'),
        ("js", f'const x = "{b"AIzaSyD4n5ctRmTuBDgBuV0LzLv9arT0U3QDR".hex()}";\n'),
    ):
        x = lexing.lexed(lang, text)
        assert [r[2] for r in secrets._file(1, "r", x)] == [1], text
        assert "REDACTED" in secrets._redacted(1, x)[0][1]


def test_list_entries_and_flow_scalars_of_settings():
    text = "db: {user: app, password: Lantern9786!x, 'port': 5}\nsecrets:\n  - plain\n  - Morchel4008#tofu # old\nother:\n  - {token: \"Hazel77-Kernel!\",\n     list: [a, b]}\nlast: {{ .Values.password2 }}\npin:\n- Walnut31!x\n"
    assert [(n, v) for n, _, _, v in secrets.config_values("yaml", text)] == [
        ("db.user", "app"), ("db.password", "Lantern9786!x"), ("db.port", "5"), ("secrets", "plain"), ("secrets", "Morchel4008#tofu"),
        ("other.token", "Hazel77-Kernel!"), ("other.list", "a"), ("other.list", "b"), ("last", "{{ .Values.password2 }}"), ("pin", "Walnut31!x"),
    ]
    assert all(text[a:b] == v for _, a, b, v in secrets.config_values("yaml", text))
    assert credentials("yaml", text)[0] == [1, 4, 6, 10]


def test_every_passage_has_a_row_and_files_have_shares(spark):
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(LINES)], "doc_id bigint, text string, lang string")
    codes = spark.createDataFrame([("en", "English"), ("de", "German"), ("ko", "Korean")], "code string, name string")
    text = "// der Dienst speichert die Zeilen der Tabelle\nlet a = 1;\n// dieser Schritt liest nur die Liste noch einmal\nlet b = 2;\n// the service stores the rows of the table\n"
    files = spark.createDataFrame([(1, "r", "a.js", text)], "file_id bigint, repo string, path string, content string")
    ends = spark.createDataFrame([(7, "r", "dieser Schritt liest nur die Liste")], "row_id bigint, project string, description string")
    rows = passages.passages(files, ends, docs, codes)
    got = sorted((r["record"], r["passage_no"], r["lang"], r["text"]) for r in rows.collect())
    assert [g[:3] for g in got] == [("endpoint", 0, "de"), ("file", 0, "de"), ("file", 1, "de"), ("file", 2, "en")]
    assert got[2][3] == "dieser Schritt liest nur die Liste noch einmal"
    shares = {(r["record"], r["lang"]): (r["passages"], r["letters"], r["share"]) for r in passages.record_shares(rows).collect()}
    letters = sum(c.isalpha() for c in "der Dienst speichert die Zeilen der Tabelle dieser Schritt liest nur die Liste noch einmal")
    assert shares[("file", "de")] == (2, letters, letters / sum(c.isalpha() for c in text))
    assert sorted(tuple(r) for r in passages.found(rows).collect()) == [("endpoint", 7, "de"), ("file", 1, "de")]


def test_only_the_credential_of_a_key_is_replaced(spark):
    for value, left in (
        ('process.env.AI_KEY || "BRZt5k2LxQ9vWm3e"', 'process.env.AI_KEY || "REDACTED"'),
        ("${AI_KEY:-sk-tLly49SFajAlkpeUmnXaxRicZoCBwkgCcBpmJhRX}", "${AI_KEY:-REDACTED}"),
        (' "t074fRkKutTjcJ6uVQoIjs9seT0TexYm"\n', ' "REDACTED"\n'),
        ("Bearer t074fRkKutTjcJ6uVQoIjs9seT0TexYm", "Bearer REDACTED"),
        ("process.env.KEY", "process.env.KEY"),
        (None, None),
    ):
        assert secrets.redact_key(value) == left
    files = spark.createDataFrame([(1, "a.py", 'API_KEY = "Lantern_Lantern9786!"\n')], "file_id bigint, path string, content string")
    configs = spark.createDataFrame([(5, "t074fRkKutTjcJ6uVQoIjs9seT0TexYm"), (6, None)], "config_id bigint, apiKey string")
    rows = sorted(tuple(r) for r in secrets.redacted(files, configs).collect())
    assert rows == [("config", 5, "REDACTED", 1), ("file", 1, 'API_KEY = "REDACTED"\n', 1)]


def test_functions_carry_their_code(spark):
    for lang, text, want in (
        ("js", "class A {\n  handle = async (x) => {\n    return '}';\n  };\n  static one = x => x + 1;\n  n = 4;\n}\nconst f = (a) =>\n  a\n    .b(1);\nlet g;\n", {("A", "handle"): "handle = async (x) => {\n    return '}';\n  }", ("A", "one"): "static one = x => x + 1", ("", "f"): "const f = (a) =>\n  a\n    .b(1)"}),
        ("py", 'class A:\n    def f(self):\n        s = """\nx\n"""\n        return (\n  1)\n\n    def g(self): return 2\nx = 1\n', {("A", "f"): 'def f(self):\n        s = """\nx\n"""\n        return (\n  1)', ("A", "g"): "def g(self): return 2"}),
        ("kt", "fun a(x: Int) = x +\n    1\nfun b() {\n}\n", {("", "a"): "fun a(x: Int) = x +\n    1", ("", "b"): "fun b() {\n}"}),
        ("go", "func (s *S) A() int {\n\treturn 1\n}\n", {("S", "A"): "func (s *S) A() int {\n\treturn 1\n}"}),
    ):
        spans, _ = lexing.lex(lang, text)
        assert {(f["owner"], f["name"]): text[f["from"] : f["to"]] for f in functions.extract(lang, text, spans)} == want
    js = "// Sums the rows of the given table.\nfunction total(rows) {\n  return 1;\n}\n"
    files = spark.createDataFrame([(1, "r", "src/a.js", js)], "file_id bigint, repo string, path string, content string")
    types = spark.createDataFrame([(4, "r", "a.ts", "interface", "User", "Someone who may sign in here.", [("id", "string", True, None)])], "type_id bigint, repo string, filePath string, kind string, name string, description string, fields array<struct<name:string,type:string,required:boolean,description:string>>")
    rows = sorted((r["record"], r["record_id"], r["name"], r["code"], r["doc"]) for r in pairs.pairs(files, types).collect())
    assert rows == [("function", 1, "total", js.split("\n", 1)[1].rstrip(), "Sums the rows of the given table."), ("type", 4, "User", "interface User {\n  id: string;\n}", "Someone who may sign in here.")]


def test_sources_end_within_a_document_of_their_budget(spark):
    import os

    from pyspark.sql import functions as F

    from siltstone.llm import labelled, sizes

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    docs, targets, codes = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "mix_targets", "lang_codes"))
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    plain = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), F.coalesce(labelled.code_of(F.col("lang"), labelled.names_of(codes)), F.lit("und")).alias("lang"), "text")
    sized = sizes.with_tokens(plain, "doc_id", "text", {"source": "string", "lang": "string"}).where("tokens > 0").collect()
    sized = [r for r in sized if r["source"] in wanted]
    leaves = {}
    for r in sized:
        leaves[r["source"], r["lang"]] = leaves.get((r["source"], r["lang"]), 0) + r["tokens"]
    budget = mixing.budgets([(s, c, n) for (s, c), n in leaves.items()], wanted, sum(leaves.values()), mixing.DOMAINS)
    rows = mixing.mix(docs, targets, codes).collect()
    assert all(r["copies"] <= wanted[r["source"]][1] for r in rows)
    for s in wanted:
        got = sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s)
        largest = max((r["tokens"] for r in sized if r["source"] == s), default=0)
        assert abs(got - sum(b for (x, _), b in budget.items() if x == s)) <= largest + 1, s


def test_static_functions_of_c_and_records_of_java():
    doc = "/** Sums the rows of the given table. */\n"
    c = f"static struct row rows[9];\n{doc}static int total_rows(const struct row *r, int n) {{\n  return sum(r);\n}}\n{doc}unsigned long *\nlast_row(void)\n{{\n}}\nint none(void);\n"
    java = f"interface M {{\n{doc}record Row(Map<String, Long> a, int b) {{}}\n{doc}default int total(int a) {{ return a; }}\n}}\n"
    for lang, text, want in (("c", c, [("total_rows", True), ("last_row", True), ("none", False)]), ("java", java, [("total", True)])):
        spans, _ = lexing.lex(lang, text)
        assert [(f["name"], f["body"]) for f in functions.extract(lang, text, spans)] == want
