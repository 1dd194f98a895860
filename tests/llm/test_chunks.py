"""Chunked lexing gives what one scan gives, wherever a text is cut; grammars on short files of each language."""

import time

import pytest

from siltstone.llm import functions, grammar, lexing, secrets, stages

SAMPLES = {
    "py": 'a = """x\n\'y\'\n"""\nb = \'\'\'\n"""\n\'\'\'\n# it\'s\nc = "a\\\nb" + \'#\'\ndef f(x):\n    return {\n  1: [2]}\n',
    "js": "/* a\n'b' */ const s = 'x';\nlet t = `a ${b ? `c\n${d}` : '}'}\n e`;\n// it's `\nlet r = x.split(/[/'`]+/g);\nf({\n a: `\n`,\n});\nlet q = html`<p>\n</p>`;\n",
    "ts": "/**\n * it's\n */\nexport const f = <T,>(x: T): T => `${x}\n`;\nnamespace A.B {\n  let y = '`';\n}\n",
    "java": 'class A {\n  /* "\n */ String s = """\n  it\'s "q" \\""" /* no */\n  """;\n  char c = \'"\'; // "\n  int[] a = {1,\n 2};\n}\n',
    "kt": 'val a = """\n /* " */ \n""""\n/* x /* y\n */ "\n z */\nfun f() = "${g("a")} \\" /*"\n/* 1 /* 2 /* 3\n*/ */\n\' */\nval c = \'"\'\n',
    "go": "package a\n\nvar s = `x\n\"/* `\n/* `\n*/\nfunc f() {\n\tr := '`'\n\t// it's `\n}\n",
    "php": "<p>it's</p>\n<?php\n$a = <<<EOT\n it's \"x\" /* \n  EOT;\n$b = 'x\ny' . \"z\n\\\"q\n\";\n/* '\n */ # it's ?> <b>\n'</b> <?php\n$c = <<<'END'\nEOT\nEND;\nfunction f() { return [1,\n2]; }\n",
    "c": '#define A(x) \\\n  "it\'s" x\n/* \n" */ int f(void) {\n  char *s = "a\\\nb"; // \'\n  return \'"\';\n}\n',
    "json": '{"a": [1,\n "x\\"y"],\n "b": {}}\n',
    "yaml": "a: \"x\n  y # z\"\nb: 'it''s\n  x' # c\nc: |\n  it's {x\n\n  \"q\nd:\n  - >-\n    don't\n  - e: it's\nf: [a, 'b\n   c', \"d\"]\ng: !!str \"x\ny\"\n",
    "graphql": '"""\nit\'s # x\n"""\ntype A {\n  # "\n  a(b: Int = 1): [String!]!\n}\n',
    "ini": "[a]\nb = it's # c\n; d\nexport e=1\n",
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_any_chunk_size_lexes_as_one_scan(lang):
    text = SAMPLES[lang]
    whole = lexing.lex(lang, text)
    one = grammar.join(lang, [grammar.note(lang, text, lexing.Piece(0, len(text), lexing.start_of(lang), lexing.Run(*whole)), True)])
    for size in range(1, len(text) + 1):
        pieces = lexing.pieces_of(lang, text, size)
        assert "".join(text[p.at : p.end] for p in pieces) == text
        spans, end = lexing.join_pieces(pieces)
        assert (spans, end) == whole, size
        assert grammar.join(lang, [grammar.note(lang, text, p, p.end == len(text)) for p in pieces]) == one, size


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_every_end_of_a_cut_off_file_is_the_same(lang):
    text = SAMPLES[lang]
    for n in range(1, len(text)):
        cut = text[:n]
        for size in (7, 40):
            assert lexing.join_pieces(lexing.pieces_of(lang, cut, size)) == lexing.lex(lang, cut), (n, size)


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_maps_compose_associatively(lang):
    text = SAMPLES[lang]
    ends = lexing.borders(lang, text, 20)
    states = lexing.states_of(lang, text)
    maps = [lexing.map_of(lexing.runs_of(lang, text, a, b, states, b == len(text))) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    for a, b, c in zip(maps, maps[1:], maps[2:], strict=False):
        assert lexing.compose(lexing.compose(a, b), c) == lexing.compose(a, lexing.compose(b, c))
    before = None
    for m, p in zip(maps, lexing.prefixes(maps), strict=True):
        assert p == before
        before = m if before is None else lexing.compose(before, m)


def test_long_lines_are_cut_within(monkeypatch):
    monkeypatch.setattr(lexing, "LONG_LINE", 8)
    text = "var a='x;y',b=/[;,]{1,2}/g,c=\"it's;\",d=`a;${e?{f:'`;'}:1};`;/* ; ' */g(h,{i:1}),j=k/l;m={};// ;,{ it's"
    for text in (text, text + "\nlet z = '`';\n"):
        whole = lexing.lex("js", text)
        for size in range(1, 60):
            pieces = lexing.pieces_of("js", text, size)
            assert lexing.join_pieces(pieces) == whole, size
    assert len(lexing.borders("js", text, 4)) > 5


def test_parts_of_huge_files_meet_again(spark):
    rows = [(i, f"r{i}", f"a.{'kt' if lang == 'kt' else lang}", SAMPLES[lang] * 6) for i, lang in enumerate(sorted(SAMPLES)) if lang not in ("ini",)]
    rows += [(90, None, "b.js", None), (91, "r", "c.js", ""), (92, "r", "d.bin", "x"), (1, "r1", rows[1][2], rows[1][3])]
    df = spark.createDataFrame(rows, "file_id int, repo string, path string, content string")
    fn = lambda i, repo, x: [(i, repo, x.lang, len(x.text), str(x.spans), x.end, grammar.join(x.lang, x.notes))]
    schema = "file_id int, repo string, lang string, n int, spans string, end string, summary string"
    whole, parts = (sorted(str(r) for r in stages.lexed_files(df, ["file_id", "repo"], fn, schema, sniff=False, note=grammar.note, chunk=40, part=p).collect()) for p in (1 << 18, 100))
    assert whole == parts and len(whole) == len(SAMPLES) - 1 + 2


VALID = {
    "js": ("const t = html`<p>${x}</p>`;\n", "async function* g() { for await (const x of y) { yield x; } }\n", "class A { #x = 1; static { init(); } get y() { return this.#x } }\n", "x = a ? b : c\ny = `n`\n"),
    "ts": ("namespace N.M { export const a = 1; }\n", "const f = <T,>(x: T): T => x;\n", "declare module 'x' { export function f(): void; }\n", "export abstract class A<T> extends B<T> implements C { private readonly x?: string; constructor(private a: A) { super(); } abstract f(): void; }\n"),
    "java": ("class A { int f(Object o) { return switch (o) { case Circle c when c.r > 0 -> 1; case null, default -> 0; }; } }\n", "enum A { X(1), Y(2); private final int v; A(int v) { this.v = v; } }\n", "@A(x = {1, 2}) public class B { Runnable r = () -> {}; int[] a = {1, 2}; }\n"),
    "php": ("<?php\nuse C\\{D, E as F};\n$f = fn($x) => $x ** 2;\n$y = match(true) { $a > 1 => 'x', default => 'y' };\n", "<?php\nenum A: string { case X = 'x'; public function f(): string { return $this->value; } }\n"),
    "graphql": ("directive @a(x: Int) repeatable on FIELD | OBJECT\n", "query Q($a: Int) { user(id: $a) { name friends { id } } }\n", "enum A { X Y }\ntype B { a: Int! @d b(c: Int = 1): [String!]! }\nunion U = A | B\n"),
    "c": ("typedef struct { int a; } T;\nstatic const int t[] = { [0] = 1, 2 };\nvoid (*f)(int);\nunsigned long x = (unsigned long)1;\n",),
    "kt": ("fun f(a: Int = 1): String = when (a) { 1 -> \"x\" else -> \"y\" }\nval x: Int\n    get() = 1\n",),
    "go": ("package a\n\nfunc f[T any](x T) (int, error) {\n\tfor i := 0; i < 3; i++ {\n\t}\n\tif x := g(); x > 0 {\n\t\treturn x, nil\n\t}\n\treturn 0, nil\n}\n",),
    "yaml": ("a:\n- b\n- c: 1\n  d: 2\ne: |\n  it's {x\nf: \"a: b\"\n", "- a\n- - b\n  - c\n", "x: [a, b,\n  c]\ny: {a: 1}\n? k\n: v\n"),
}
INVALID = {
    "java": ("class A { int x }\n", "class A { void f() { if x > 1 { } } }\n", "class A { int x = ; }\n", "class A { int f() { return 0 } }\n", "class A { void f() { g() } }\n"),
    "c": ("int a b;\n", "int f() { return 0 }\n", "int x = ;\n", "int f() { if x > 1 { } }\n"),
    "js": ("return => 1;\n", "let x = ;\n", "if x > 1 { }\n", "const a = [1, 2;\n", "function (a) { }\n", "let y = 1 2;\n"),
    "ts": ("let x: = 1;\n", "interface { a: b }\n"), "kt": ("val = 1\n", "fun f( {\n"), "php": ("<?php\n$x = ;\n", "<?php\nfunction f() { return 0 }\n", "<?php\nif $x > 1 { }\n"),
    "go": ("package a\n\nfunc f() {\n\tfor i := 0; i < 3 {\n\t}\n}\n", "package a\n\nfunc f() {\n\tx := := 1\n}\n", "package a\n\nvar = 1\n"),
    "graphql": ("type A { a }\n", "type A { a: }\n", "type { a: Int }\n"), "yaml": ("- a\nb: 1\n", "a: 1\n  b: 2\n", "a: [1, 2\n", "a: \"x\n"),
}


def test_grammars_take_valid_and_refuse_invalid_files():
    for want, group in ((False, VALID), (True, INVALID)):
        for lang, texts in group.items():
            for text in texts:
                assert grammar.broken(lexing.lexed(lang, text, grammar.note)) == want, (lang, text)


def test_time_is_linear_in_long_literals_and_files():
    def took(f):
        start = time.time()
        f()
        return time.time() - start

    for body in ("a" * 500_000, "ab." * 170_000, "password=abc1 " * 35_000, "-eyJ" * 120_000, "://a:" * 100_000):
        text = f'const token = "{body}";\n'
        spans, _ = lexing.lex("js", text)
        assert took(lambda: secrets.find("js", text, spans)) < 5  # noqa: B023
    js = "".join(f"class A{i} {{\n" + "".join(f"  /** Sums the rows of the table {j}. */\n  m{j}(a, b) {{ return a; }}\n" for j in range(10)) + "}\n" for i in range(1000))
    x = lexing.lexed("js", js)
    assert took(lambda: functions.extract("js", js, x.spans)) < 10
    assert took(lambda: grammar.summary("js", "(" * 20_000 + ")" * 20_000)) < 2
