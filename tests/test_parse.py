"""Functions and nodes of every language: pinned counts and the depth rules."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codestrata.operators import analysis
from codestrata.parse import registry
from codestrata.parse.braces import cut
from codestrata.parse.tokens import tokenize


def measured(language: str, text: str) -> dict[str, tuple[int, int, int, int]]:
    """Cyclomatic, cognitive, nesting and parameters by function name."""
    found, error = registry.parse_file(language, text)
    assert error is None, error
    out = {}
    for f in found:
        weighted = [d for t, d in f.nodes if t in ("Branch", "Loop", "Closure")]
        operators = sum(t == "Operator" for t, _ in f.nodes)
        out[f.name] = (1 + len(weighted) + operators, sum(1 + d for d in weighted) + operators, max((d for _, d in f.nodes), default=0), f.params)
    return out


CASES = [
    ("python", "def f(self, a, b=1, *c, d, **e):\n    if a and b or c:\n        pass\n    elif b:\n        for x in a:\n            pass\n    else:\n        try:\n            z = 1 if a else 2\n        except E:\n            pass\n    return lambda q: q or a\n", {"f": (9, 15, 2, 5), "<lambda>": (2, 1, 0, 1)}),
    ("python", "class A:\n    async def m(cls, x: int):\n        match x:\n            case 1:\n                pass\n            case _:\n                while x: pass\n", {"m": (5, 8, 2, 1)}),
    ("python", "def deep(x):\n" + "".join("    " * (i + 1) + f"if x > {i}:\n" for i in range(10)) + "    " * 11 + "pass\n", {"deep": (11, 55, 9, 1)}),
    ("go", "package p\n\nfunc (s *Store) Get(a, b int, c string) (int, error) {\n\tif a > 0 && b > 0 {\n\t\tfor range c {\n\t\t}\n\t} else if a < 0 {\n\t\treturn 1, nil\n\t}\n\tswitch a {\n\tcase 1:\n\t\tif b > 1 {\n\t\t}\n\tdefault:\n\t}\n\tf := func(x int) bool { return x > 0 || x < -5 }\n\treturn 0, nil\n}\n", {"(*Store).Get": (9, 14, 2, 3), "<anonymous>": (2, 1, 0, 1)}),
    ("go", "package p\n\nfunc Plain() {}\n\nfunc Gen[T any](x T) map[string]interface{} {\n\treturn nil\n}\n\ntype F func(int) error\n", {"Plain": (1, 0, 0, 0), "Gen": (1, 0, 0, 1)}),
    ("javascript", "function f(a, b = 2, ...c) { if (a && b) { return a ? 1 : 2 } else if (b) { for (const x of c) {} } switch (a) { case 1: break; default: break } }\nconst g = (x) => x ?? 1;\nconst h = async y => { try { y() } catch (e) {} };\nclass K { m(a) { while (a) a--; } get p() { return 1 } }\nconst o = { key: function () { return /a&&b/.test('x||y') } };\nobj.handler = () => `a ${b && c}`;\n", {"f": (7, 11, 2, 3), "g": (2, 1, 0, 1), "h": (2, 1, 0, 1), "m": (2, 1, 0, 1), "p": (1, 0, 0, 0), "key": (1, 0, 0, 0), "handler": (1, 0, 0, 0)}),
    ("typescript", "export class S { constructor(private a: A, public b?: B) {} go<T extends object>(x: T | null): Promise<void> { if (!x) { return; } for (const k in x) { if (k && (k === 'a' || k === 'b')) {} } const y = x ? true : false; } }\nconst add = (a: number, b: number): number => a + b;\n", {"constructor": (1, 0, 0, 2), "go": (7, 7, 2, 1), "add": (1, 0, 0, 2)}),
    ("java", "public class C { @Override public <T> int run(List<T> xs, int n) throws E { if (n > 0 || xs == null) { do { n--; } while (n > 0); } switch (n) { case 1: break; default: break; } try { xs.forEach(x -> print(x)); } catch (Exception e) { } return n > 1 ? 1 : 2; } }", {"run": (8, 10, 1, 2), "<lambda>": (1, 0, 0, 0)}),
    ("java", "record P(int x, int y) { P { if (x < 0) throw new E(); } int sum() { return x + y; } }", {"P": (2, 1, 0, 0), "sum": (1, 0, 0, 0)}),
    ("csharp", "class T { [Get] public int A(int x) { return x ?? 1; } public int B(int x) => x > 0 ? x : -x; void O() { void I(int y) { if (y == 0) return; } I(1); } public T(int a) : base(a) { foreach (var i in z) { } } void L() { xs.Select(x => x && y); } }", {"A": (2, 1, 0, 1), "B": (2, 1, 0, 1), "O": (2, 1, 0, 0), "I": (2, 1, 0, 1), "T": (2, 1, 0, 1), "L": (2, 1, 0, 0), "<lambda>": (2, 1, 0, 1)}),
    ("c_cpp", "#define M(x) if (x)\nint A::get(const int& a, char* b) const { if (a && b) { goto end; } switch (a) { case 1: for (;;) {} default: break; } end: return a ? 1 : 0; }\nstatic void g(void) { auto f = [&](int q) { return q || 1; }; }\n", {"A::get": (8, 12, 2, 2), "g": (3, 2, 1, 0), "<lambda>": (2, 1, 0, 1)}),
    ("php", "<?php\n#[Route]\nfunction f(#[In] R $r, $s = [1, 2]): ?int { if ($r and $s) { foreach ($s as $t) {} } elseif ($r) { } else { while (1) {} } switch ($s) { case 1: break; default: } $g = fn($x) => $x ?? 0; return $r ? 1 : 2; }\n", {"f": (11, 15, 1, 2), "<anonymous>": (3, 2, 1, 1)}),
    ("rust", "fn f<'a>(&self, x: &'a str, n: i32) -> Result<u8, E> { match n { 1 | 2 => { if x.is_empty() { loop {} } } _ if n > 3 && n < 9 => g()?, _ => 0 } let c = |a, b| a || b; Ok(1) }", {"f": (11, 22, 3, 2), "<closure>": (3, 2, 1, 0)}),
    ("kotlin", "fun f(a: Int, b: String = \"x\"): Int {\n  when (a) {\n    1 -> return 2\n    else -> { if (a > 1 && b != \"\") return 3 }\n  }\n  val c = b ?: \"\"\n  list.forEach { x -> for (i in x) {} }\n  try { g() } catch (e: E) { }\n  return 0\n}\nfun sq(x: Int) = if (x > 0) x else -x\n", {"f": (9, 13, 3, 2), "sq": (2, 1, 0, 1), "<lambda>": (3, 3, 1, 0)}),
    ("swift", "class A { init?(x: Int) { guard x > 0 else { return nil } } deinit { print(1) }\nfunc go<T>(_ a: T, b: Int) -> Int {\n  let c = b > 1 ? 2 : 3\n  repeat { b -= 1 } while b > 0\n  xs.map { $0 + 1 }\n  switch b {\n  case 1: return 1\n  default: break\n  }\n  return c ?? 0\n} }\n", {"init": (2, 1, 0, 1), "deinit": (1, 0, 0, 0), "go": (7, 8, 1, 2), "<closure>": (2, 1, 0, 0)}),
    ("ruby", "class A\n  def self.m(a, b: 1, *c)\n    return 1 unless a && b\n    if a then x end\n    begin\n      y\n    rescue E\n      z while q\n    end\n    c.each { |i| puts i if i or a }\n  end\n\n  def name = @name\n\n  def greet who, how = 1\n    case who\n    when 1 then 2\n    else 3\n    end\n  end\nend\n", {"m": (9, 12, 2, 3), "name": (1, 0, 0, 0), "greet": (2, 2, 1, 2), "<block>": (4, 4, 2, 3)}),
]


@pytest.mark.parametrize(("language", "text", "expected"), CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_functions(language, text, expected):
    assert measured(language, text) == expected


LONG = " | ".join(f"'{i}'" for i in range(40))
MANY = ", ".join(f"T{i} extends U{i}" for i in range(40))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("const f = (x: number): Promise<Map<string, number>> => { if (x) {} };", {"f": (2, 1, 0, 1)}),
        ("const f = (): { a: string, b: number } => { if (x) {} };", {"f": (2, 1, 0, 0)}),
        ("const f = (): [A, B] => x && y;", {"f": (2, 1, 0, 0)}),
        (f"const f = (a: A, b: B): {LONG} => a && b;", {"f": (2, 1, 0, 2)}),
        ("const f = (a: A): (b: B, c: C) => D => x && y;", {"f": (2, 1, 0, 1)}),
        ("const f = async <T extends Map<A, B>>(a: T): Promise<(b: B) => [A, B]> => a ?? x;", {"<anonymous>": (2, 1, 0, 1)}),
        ("const f = (x: T): T extends U ? { a: A } : x is B => x;", {"f": (1, 0, 0, 1)}),
        ("const o = { a: 1, k: (x): Map<A, B> => x || y };", {"<anonymous>": (2, 1, 0, 1)}),
        ("const f = c ? (a, d) : b => b;", {"<anonymous>": (1, 0, 0, 1)}),
        ("const f = c ? (a, d): B => a : e;", {"<anonymous>": (1, 0, 0, 2)}),
        ("class K { async m(a: A): Promise<Map<A, B>> { if (a) {} } n(): (a: A) => B { } }", {"m": (2, 1, 0, 1), "n": (1, 0, 0, 0)}),
        (f"function f<{MANY}>(a: T0): Map<A, B> {{ if (a) {{}} }}", {"f": (2, 1, 0, 1)}),
    ],
)
def test_result_types(text, expected):
    assert measured("typescript", text) == expected


def test_strings_and_comments_hold_no_code():
    for language, text in (("java", 'int f() { String s = "if (a && b) {"; /* if (x) { */ return 1; // while (1) {\n }'), ("go", "func f() int { s := `if a {` ; return 1 // if b {\n}\n"), ("rust", 'fn f() -> u8 { let s = r#"if { "# ; 1 /* if { */ }'), ("php", "<?php function f() { $s = 'if ($a) {'; # if {\n return 1; }")):
        assert [v[:2] for v in measured(language, text.replace("int f()", "int f()")).values()] == [(1, 0)], language


@pytest.mark.parametrize("language", sorted(registry.PARSERS))
def test_broken_text_ends(language):
    for text in ("", "}}}{{{((", "fn func def function fun f(", "if if if else ? : ?", "\u0000\ufffd日本", "class { def ( [ { \" '", "x" * 5000):
        registry.parse_file(language, text)


def test_tokens():
    assert [t.text for t in tokenize("rust", "0..10 a?.b 'a' 1.5")] == ["0", "..", "10", "a", "?.", "b", "'a'", "1.5"]
    assert cut("é" * 6000).endswith("...") and len(cut("é" * 6000).encode()) <= 10_003 and cut("ok") == "ok"


GO_DIRTY = "package main\n\nimport \"fmt\"\n\nfunc Deep(a, b, c int) int {\n\tif a > 0 {\n\t\tif b > 0 {\n\t\t\tif c > 0 {\n\t\t\t\treturn 1\n\t\t\t}\n\t\t} else {\n\t\t\tif c > 0 {\n\t\t\t\treturn 3\n\t\t\t}\n\t\t}\n\t} else {\n\t\tfor i := 0; i < 10; i++ {\n\t\t\tif i%2 == 0 {\n\t\t\t\tfmt.Println(i)\n\t\t\t} else {\n\t\t\t\tif i%3 == 0 {\n\t\t\t\t\tfmt.Println(\"fizz\")\n\t\t\t\t}\n\t\t\t}\n\t\t}\n\t}\n\treturn 0\n}\n"


def test_pipeline(spark):
    files = spark.createDataFrame([("/a/deep.go", GO_DIRTY), ("/b/ok.py", "def f(x):\n    return x\n"), ("/b/bad.py", "def f(:\n"), ("/c/notes.txt", "if"), ("/d/none.rb", None)], "path string, content string")
    measured_df, found, failed = analysis.analyze(files)
    got = {r["function_name"]: r for r in measured_df.collect()}
    deep = got["Deep"]
    assert (deep["cyclomatic_complexity"], deep["cognitive_complexity"], deep["nesting_depth"], deep["parameter_count"], deep["lines_of_code"], deep["severity"], deep["technical_debt_minutes"]) == (8, 18, 3, 3, 24, "high", 0)
    assert got["f"]["severity"] == "low" and set(got) == {"Deep", "f"}
    (finding,) = found.collect()
    assert (finding["path"], finding["line"], finding["severity"], finding["message"]) == ("/a/deep.go", 5, "high", "Function 'Deep' has complexity issues")
    assert finding["description"].endswith("Refactoring Suggestions:\n- [HIGH] Reduce Cognitive Complexity: Simplify the mental model required to understand this code")
    assert [r["message"].split(":")[0] for r in failed.collect()] == ["/b/bad.py could not be parsed"]
    parsed = registry.parse_files(files.withColumn("language", F.lit("go")).where("path like '%.go'"))
    from codestrata.functions.scoring import reduce_nodes

    nodes = registry.ast_nodes(parsed).drop("path")
    assert rows(reduce_nodes(parsed.select("function_ix"), nodes, ["function_ix"])) == [(0, 8, 18, 3)]


def test_udtf(spark):
    registry.register_udtf(spark)
    spark.createDataFrame([("python", "/x.py", "def f(a):\n    if a: pass\n")], "language string, path string, content string").createOrReplaceTempView("sources")
    assert rows(spark.sql("select p.function_name, size(p.nodes) from sources s, lateral parse_code(s.language, s.path, s.content) p")) == [("f", 1)]


def test_whole_tables_of_nodes(spark, tmp_path):
    """Nodes of small quantities count too; a function without nodes keeps its row."""
    from codestrata.plans.scoring_queries import registry as scored

    spark.createDataFrame([(1,), (2,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 1, 3.0), (1, 4, 26.0)], "l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert rows(scored.queries["cx_01_complexity_reduction"](spark, str(tmp_path)), "p_partkey", "cyclomatic", "cognitive", "nesting") == [(1, 3, 5, 3), (2, 1, 0, 0)]
