import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions.bindings import bindings
from tracewell.functions.splitting import Unsplit, css_spans, python_spans, script_spans, selectors, shell_spans, squeezed, units
from tracewell.functions.style_names import class_roles, style_names


def cut(text, spans):
    lines = text.split("\n")
    return [squeezed("\n".join(lines[a - 1 : b])) for a, b in spans]


def test_squeezing():
    assert squeezed("a  =\n 1") == "a = 1"
    assert squeezed('x = "a  b"') == 'x = "a  b"'
    assert squeezed('"""a\n b"""  c') == '"""a\\n b""" c'
    assert squeezed("`a\n  ${b}`") == "`a\\n  ${b}`"
    assert squeezed(r"'it\'s  so'  x") == r"'it\'s  so' x"
    assert squeezed("") == ""


@given(st.text(alphabet="ab \n\t;{}", max_size=60))
def test_squeezing_without_quotes_is_folding(text):
    assert squeezed(text) == " ".join(text.split())


def test_python():
    text = "import a\n\n@deco\n@other(1)\ndef f():\n    pass\nx = [\n 1,\n]\n"
    assert python_spans(text) == [(1, 1), (3, 6), (7, 9)]
    with pytest.raises(Unsplit):
        python_spans("def f(:\n")


def test_shell():
    text = '#!/bin/sh\n# note\nf() {\n  echo "}"\n}\nif true; then\n  ls\nfi\ncat <<EOF\nhi {\nEOF\nls \\\n  -l\n'
    assert shell_spans(text) == [(1, 1), (3, 5), (6, 8), (9, 11), (12, 13)]
    assert shell_spans("if a; then b; fi\nfor x in 1 2; do\n  echo 'fi\n#' # }\ndone; ls\nx=$((1<<2))\ncat <<<'y'\n") == [(1, 1), (2, 5), (6, 6), (7, 7)]
    assert shell_spans("a <<-'X' <<Y | b &&\nX {\n\tX\nif\nY\ncase $1 in\n  if) done=1 ;;\nesac\necho done if") == [(1, 5), (6, 8), (9, 9)]
    assert shell_spans("# only a note\n\n") == [] == shell_spans("")
    for bad in ("f() {\n", "}\n", "cat <<X\n", 'echo "a\n', "if x\n", "echo 'a"):
        with pytest.raises(Unsplit):
            shell_spans(bad)


def test_css():
    text = 'a { b: c }\n/* { */ @import "x;y";\n@media x {\n  .a, .b:is(.c, .d) { }\n  #e { content: "}" }\n}\n'
    assert css_spans(text) == [(1, 1), (2, 2), (3, 6)]
    assert selectors("@media x {\n  .a, .b:is(.c, .d) { }\n  #e { }\n}", 3) == [(1, ".a", 4), (2, ".b:is(.c, .d)", 4), (3, "#e", 5)]
    for bad in ("a { b", 'a { b: "c }', "a"):
        with pytest.raises(Unsplit):
            css_spans(bad)


@settings(max_examples=60)
@given(st.lists(st.sampled_from(["a{}", "@x y;", "/*{*/", '"}"', "\n", " ", ".b{c:d}"]), max_size=12))
def test_css_spans_are_ordered(parts):
    try:
        spans = css_spans("".join(parts))
    except Unsplit:
        return
    assert all(a <= b for a, b in spans) and spans == sorted(spans)


def test_script():
    text = """"use client";
import {
  b,
} from "./y";
// a note
export default function Page() {
  return <div className={`a-${b} {`}>it is {x ? <b/> : "}"}</div>;
}
const f = (x) => {
  return x;
}
const g = { a: 1 }
if (a) {
} else {
}
type T = {
  a: string
}
foo.bar()
  .baz();
@Deco()
class K { x = /[/}]/g; }
let q = a / b / c
"""
    assert cut(text, script_spans(text)) == [
        '"use client";',
        'import { b, } from "./y";',
        """export default function Page() { return <div className={`a-${b} {`}>it is {x ? <b/> : "}"}</div>; }""",
        "const f = (x) => { return x; }",
        "const g = { a: 1 }",
        "if (a) { } else { }",
        "type T = { a: string }",
        "foo.bar() .baz();",
        "@Deco() class K { x = /[/}]/g; }",
        "let q = a / b / c",
    ]
    for bad in ("function f( {", "const a = `x", "a = 'x\n", "}"):
        with pytest.raises(Unsplit):
            script_spans(bad)


def test_style_units_have_a_unit_per_name():
    got = list(units("a.css", ".a,\n.b { x: y }\nbody { z: w }\n"))
    assert [(f, t) for f, _, t, _ in got] == [(1, ".a { of the rule at 1-2 }"), (2, ".b { of the rule at 1-2 }"), (3, "body { z: w }")]
    assert got[2][3] == [(1, "body", 3)]


def test_roles():
    assert class_roles(".card .title:hover") == (["title"], ["card"])
    assert class_roles(".a:has(.b) > p") == (["b"], ["a"])
    assert class_roles(".a:not(.b)") == (["a"], [])
    assert class_roles(".a p") == (["a"], [])
    assert class_roles("  .a[href='.x y'].b > .c:is(.d .e, :not(.f)) ~ p::before ") == (["d", "e"], ["a", "b", "c"])
    assert class_roles("") == ([], []) == class_roles("p > q")
    assert style_names(".x .y { }", [".x .y", ".x"]) == [("class", "y", "subject"), ("class", "x", "subject")]
    assert style_names(":root { --x: 1; --y : 2 }", []) == [("variable", "--x", "subject"), ("variable", "--y", "subject")]
    assert style_names("@keyframes spin { }", []) == [("animation", "spin", "subject")]
    assert style_names("@import 'x';", []) == []


def test_bindings():
    assert [b[:4] for b in bindings("a.py", "from .m import (a as b, c)")] == [("from", "b", ".m", "a"), ("from", "c", ".m", "c")]
    assert next(bindings("a.py", "def f(): from m import x")) == ("from", "x", "m", "x", True)
    assert [b[:4] for b in bindings("a.ts", 'import D, { type A as B } from "./m"')] == [("named", "D", "./m", "(default)"), ("named", "B", "./m", "A")]
    assert [b[:4] for b in bindings("a.ts", 'export * from "./m"')] == [("export-star", None, "./m", None)]
    every = lambda file, text: [b[:4] for b in bindings(file, text)]
    assert every("a.py", "import a.b as c, d") == [("import", "c", "a.b", None)] and every("a.py", "import a.b") == [("import", "a", "a.b", None)]
    assert every("a.py", "from . import (x, y as z,) # w") == [("from", "x", ".", "x"), ("from", "z", ".", "y")] and every("a.py", "from m import *") == []
    assert every("a.py", "def f(): import os; from ..m import x, y return x") == [("import", "os", "os", None), ("from", "x", "..m", "x"), ("from", "y", "..m", "y")]
    assert every("a.py", '"""import x"""') == [] == every("a.py", "important = 1")
    assert every("a.ts", 'import * as n from "./m"') == [("star", "n", "./m", "n")] and every("a.ts", 'import "./m"') == []
    assert every("a.ts", 'import type { A, /* no */ B as C, } from "./m";') == [("named", "A", "./m", "A"), ("named", "C", "./m", "B")]
    assert every("a.ts", 'import type from "./m"') == [("named", "type", "./m", "(default)")]
    assert every("a.ts", 'export * as n from "./m"') == [("export-module", "n", "./m", "*")]
    assert every("a.ts", 'export { default as x, type Y } from "./m"') == [("export-from", None, "./m", None), ("export-named", "x", "./m", "default"), ("export-named", "Y", "./m", "Y")]
    assert every("a.ts", "export const a = { b: 1 };") == [] == every("a.ts", "export default { a };") == every("a.ts", "export {}")
    assert [b[:4] for b in bindings("a.ts", "export { a as b };")] == [("export-bare", "b", None, "a")]


def test_markup_apostrophes_open_no_string():
    assert script_spans("const a = <p>it's</p>;\nb();\n") == [(1, 1), (2, 2)]
