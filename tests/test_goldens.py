"""Whole scans of small trees with pinned results, and the depth of conditions."""

from __future__ import annotations

import pytest
from test_parse import measured

from codestrata import scan

GO_CLEAN = 'package main\n\nimport "os"\n\nfunc main() {\n\tos.Exit(0)\n}\n'
GO_DIRTY = """package main

import "log"

func Classify(x, y, z int) int {
	if x > 9 {
		if y > 9 {
			if z > 9 {
				return 8
			} else {
				return 7
			}
		} else {
			if z > 9 {
				return 6
			} else {
				return 5
			}
		}
	} else {
		for n := 0; n < 99; n++ {
			if n%5 == 0 {
				log.Println(n)
			} else {
				if n%7 == 0 {
					log.Println("seven")
				}
			}
		}
	}
	return 4
}
"""
TS_CLEAN = 'const place: string = "here";\nconsole.info(place);\n'
TS_DIRTY = """function nameOf(level: number): string {
    if (level > 7) {
        if (level < 8) {
            return "a";
        } else if (level < 9) {
            return "b";
        } else {
             if (level % 3 === 0) {
                 return "c";
             } else {
                 return "d";
             }
        }
    } else {
        switch(level) {
            case 4:
                return "e";
            case 5:
                return "f";
            case 6:
                return "g";
            default:
                return "h";
        }
    }
}
"""
PYTHON_DEEP = "def deep(x):\n" + "".join("    " * (n + 1) + f"if x > {n}:\n" for n in range(10)) + "    " * 11 + "return x\n"
NAMES = ("total_functions", "average_cyclomatic", "max_cyclomatic", "critical_count", "high_count", "debt_hours", "file_count", "total_loc")
GOLDENS = [
    ("main.go", GO_CLEAN, (1, 1, 1, 0, 0, 0, 1, 7), []),
    ("complex.go", GO_DIRTY, (1, 8, 8, 0, 1, 0, 1, 32), [("/complex.go", 5, "high", "Function 'Classify' has complexity issues")]),
    ("simple.ts", TS_CLEAN, (0, None, None, None, None, None, 1, 2), []),
    ("messy.ts", TS_DIRTY, (1, 8, 8, 0, 0, 0, 1, 26), []),
    ("deep.py", PYTHON_DEEP, (1, 11, 11, 1, 0, 0.5, 1, 12), [("/deep.py", 1, "critical", "Function 'deep' has high cyclomatic complexity of 11 (threshold: 10)")]),
]


@pytest.mark.parametrize(("name", "text", "metrics", "found"), GOLDENS)
def test_scan(spark, tmp_path, name, text, metrics, found):
    (tmp_path / name).write_text(text)
    report = scan.scan(spark, str(tmp_path))
    got = {k: v for _, k, v in report.metrics}
    assert tuple(got.get(n) for n in NAMES) == metrics
    rows = report.findings.collect()
    assert [(r["path"], r["line"], r["severity"], r["message"]) for r in rows] == found
    assert not report.failures and not report.warnings
    for r in rows:
        assert r["issue_type"] == "complexity" and r["category"] == "maintainability"
    if name == "complex.go":
        assert rows[0]["description"].split("\n")[1:] == [
            "Cyclomatic Complexity: 8", "Cognitive Complexity: 18", "Nesting Depth: 3", "Parameters: 3", "Lines of Code: 28", "Estimated Refactoring Time: 0 minutes", "", "Refactoring Suggestions:",
            "- [HIGH] Reduce Cognitive Complexity: Simplify the mental model required to understand this code",
        ]


def test_depths_of_goldens():
    assert measured("typescript", TS_DIRTY)["nameOf"] == (8, 19, 3, 1)
    assert measured("python", PYTHON_DEEP)["deep"] == (11, 55, 9, 1)


CONDITIONS = [
    ("java", "class C { int f(boolean a, boolean b) { return a && b ? 1 : 2; } }", (3, 2, 1, 2)),
    ("java", "class C { int f(boolean a, boolean b) { int x = a ? 1 : a || b ? 2 : 3; return b && a; } }", (5, 5, 2, 2)),
    ("java", "class C { int f(boolean a, boolean b) { g(a && b); if (a || b) return 1; return (a && b) || a ? 1 : 2; } }", (7, 6, 1, 2)),
    ("java", "class C { int f(int a, int b) { g(a > 1 && b > 1, a == 1 || b == 1 ? 1 : 2); return 0; } }", (4, 3, 1, 2)),
    ("javascript", "function f(a, b) { let x = a && b; return a ?? b ? x : b }", (4, 3, 1, 2)),
    ("javascript", "function f(a, b) { if (a && b) return b ? 1 : 2; while (a || b) b ? g() : h() }", (7, 8, 1, 2)),
    ("typescript", "function f(a: A, b: B) { const x: T = a && (b || a) ? 1 : 2; }", (4, 3, 1, 2)),
    ("csharp", "class T { int A(bool x, bool y) => x && y ? 1 : 2; }", (3, 2, 1, 2)),
    ("c_cpp", "int f(int a, int b) { return a && b ? 1 : 0; }", (3, 2, 1, 2)),
    ("php", "<?php function f($a, $b) { return $a && $b ? 1 : 2; }", (3, 2, 1, 2)),
    ("php", "<?php function f($a, $b) { $x = $a || $b ?: 2; }", (3, 2, 1, 2)),
    ("swift", "func f(a: Bool, b: Bool) -> Int {\n  let c = a || b\n  return a && b ? 1 : 2\n}\n", (4, 3, 1, 2)),
    ("ruby", "def f(a, b)\n  x = a && b\n  y = a || b ? 1 : 2\n  g(a && b, (a || b) ? 1 : 2)\nend\n", (7, 6, 1, 2)),
    ("python", "def f(a, b):\n    return 1 if a and b else 2\n", (3, 2, 1, 2)),
]


@pytest.mark.parametrize(("language", "text", "expected"), CONDITIONS)
def test_conditions_lie_deeper(language, text, expected):
    (got,) = measured(language, text).values()
    assert got == expected
