"""Source text to top-level statements: spans of lines, squeezed texts, selectors.

Every language has a scanner made of one token pattern and a short loop over
its tokens; offsets become lines by binary search in the line starts.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

Span = tuple[int, int]


class Unsplit(ValueError):
    """The text cannot be split; says why."""


class _Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


# --- squeezing -----------------------------------------------------------

_SQUEEZE = re.compile(
    r'''(?P<triple>"{3}|'{3})(?P<doc>.*?)(?P<close>(?P=triple)|\Z)|(?P<quote>["'`])(?:\\.|(?!(?P=quote)).)*(?:(?P=quote)|\Z)|(?P<gap>\s+)''',
    re.S,
)


def squeezed(text: str) -> str:
    """Runs of white space outside quotes become one blank; inside, only line
    breaks change, to a backslash and an n."""

    def put(m: re.Match) -> str:
        if m["gap"] is not None:
            return "" if m.start() == 0 else " "
        return m[0].replace("\n", "\\n")

    return _SQUEEZE.sub(put, text).strip()


# --- Python --------------------------------------------------------------


def python_spans(text: str) -> list[Span]:
    """Statements of the module body, decorators included."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError) as e:
        raise Unsplit(f"syntax error: {e}") from None
    return [(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]), n.end_lineno) for n in body]


# --- CSS -----------------------------------------------------------------

_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|(?P<string>"(?:\\.|[^"\\])*(?P<e1>"|\\?\Z)|'(?:\\.|[^'\\])*(?P<e2>'|\\?\Z))|(?P<mark>[{};])|(?P<other>[^\s{};"'/]+|/)""", re.S)


def css_spans(text: str) -> list[Span]:
    """Rules and at-rules at depth zero."""
    lines, out, first, depth = _Lines(text), [], None, 0
    for m in _CSS.finditer(text):
        if m["string"] is None and m["mark"] is None and m["other"] is None:
            continue
        if first is None:
            first = lines.of(m.start())
        if m["string"] is not None and not (m["e1"] in ('"',) or m["e2"] in ("'",)):
            raise Unsplit(f"unclosed string in what began on line {first}")
        ends = False
        if m["mark"] == "{":
            depth += 1
        elif m["mark"] == "}":
            depth = max(0, depth - 1)
            ends = depth == 0
        elif m["mark"] == ";":
            ends = depth == 0
        if ends:
            out.append((first, lines.of(m.start())))
            first = None
    if first is not None:
        raise Unsplit(f"unclosed block or rule that began on line {first}")
    return out


_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_PRELUDE = re.compile(r"""(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)|(?P<mark>[{};])""", re.S)


def selectors(text: str, first_line: int = 1) -> list[tuple[int, str, int]]:
    """(ordinal, selector, line) of a rule and of every rule nested in it; comments and strings are opaque."""
    clean = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines, out, begin, depth = _Lines(clean), [], 0, 0
    for m in _PRELUDE.finditer(clean):
        if m["mark"] == "{":
            prelude = clean[begin : m.start()]
            if not prelude.lstrip().startswith("@"):
                for at, piece in _pieces(prelude):
                    out.append((len(out) + 1, piece, first_line + lines.of(begin + at) - 1))
            depth, begin = depth + 1, m.end()
        elif m["mark"] == "}":
            depth, begin = depth - 1, m.end()
        elif m["mark"] == ";" and depth == 0:
            begin = m.end()
    return out


def _pieces(prelude: str) -> Iterator[tuple[int, str]]:
    """(offset, text) of the list's members: commas within ( ) or [ ] do not count."""
    begin = depth = 0
    for m in re.finditer(r"[(\[)\],]|\Z", prelude):
        if m[0] in ("(", "[") and m[0]:
            depth += 1
        elif m[0] in (")", "]") and m[0]:
            depth -= 1
        elif m[0] == "," and depth == 0 or not m[0]:
            piece = prelude[begin : m.start()]
            if piece.strip():
                yield begin + len(piece) - len(piece.lstrip()), piece.strip()
            begin = m.end()


# --- shell ---------------------------------------------------------------

# What opens a compound command, and what closes it.
_COMPOUND = {"if": "fi", "for": "done", "while": "done", "until": "done", "case": "esac"}
_SHELL = re.compile(
    r"""(?P<blank>[^\S\n]+|\\\r?\n)|(?P<newline>\n)|(?P<note>\#[^\n]*)|(?P<math>\(\([^\n]*?\)\)|<<<)"""
    r"""|(?P<here><<-?[ \t]*(?:"([\w./-]+)"|'([\w./-]+)'|([\w./-]+)))"""
    r"""|(?P<quoted>'[^']*(?:'|(?P<open1>\Z))|"(?:\\.|[^"\\])*(?:"|\\?(?P<open2>\Z)))"""
    r"""|(?P<brace>[{}])|(?P<mark>[;&|()!])|(?P<word>(?:\\.|[^\s;&|(){}'"\\\#<!])+)|(?P<other>.)""",
    re.S,
)
#: After these a command begins.
_LEADS = {"then", "do", "else", "elif", "{"}


def shell_spans(text: str) -> list[Span]:
    """Functions, compound commands, and commands with their continuations and here-documents.

    One pass over the tokens of the whole text. A statement ends with the line on
    which no brace, compound command or here-document is open any more.
    """
    lines, out, first, depth, at = _Lines(text), [], None, 0, 0
    compounds: list[str] = []
    heres: list[str] = []
    begins = True  # whether a word here is a command's name
    if m := re.match(r"[^\S\n]*#![^\n]*", text):
        out.append((1, 1))
        at = m.end()
    while at < len(text):
        m = _SHELL.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "newline":
            last = lines.of(m.start())
            while heres:
                if at >= len(text):
                    raise Unsplit("unterminated here-document at the end of the file")
                last, end = lines.of(at), (text.find("\n", at) + 1 or len(text) + 1) - 1
                if text[at:end].strip() == heres[0]:
                    heres.pop(0)
                at = end + 1
            if first is not None and not depth and not compounds:
                out.append((first, last))
                first = None
            begins = True
            continue
        if kind in ("blank", "note"):
            continue
        first = lines.of(m.start()) if first is None else first
        said = m[0]
        if kind == "quoted" and (m["open1"] is not None or m["open2"] is not None):
            raise Unsplit("unterminated quote at the end of the file")
        if kind == "here":
            heres.append(m[6] or m[7] or m[8])
        elif kind == "brace":
            depth += 1 if said == "{" else -1
            if depth < 0:
                raise Unsplit(f"unbalanced braces on line {lines.of(m.start())}")
        elif kind == "word" and begins:
            if said in _COMPOUND and not text.startswith(")", at):
                compounds.append(_COMPOUND[said])
            elif compounds and said == compounds[-1]:
                compounds.pop()
        begins = kind == "mark" or said in _LEADS
    if heres or depth or compounds:
        raise Unsplit(f"unterminated {'here-document' if heres else 'block'} at the end of the file")
    if first is not None:
        out.append((first, lines.of(len(text) - 1)))
    return out


# --- TypeScript and JavaScript ---------------------------------------------

_TS = re.compile(
    r"""(?P<skip>/\*.*?(?:\*/|\Z)|//[^\n]*|\s+)|(?P<string>"(?:\\.|[^"\\\n])*(?P<q1>")?|'(?:\\.|[^'\\\n])*(?P<q2>')?)|(?P<tick>`)|(?P<word>[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|\+\+|--|&&|\|\||\?\?|[-+*/%=<>!&|^~?:;,.@#(){}\[\]])|(?P<odd>.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_TICK = re.compile(r"\\.|`|\$\{", re.S)
#: A statement goes on after a line that ends so, or before one that begins so.
_GOES_ON_AFTER = set("= => + - * / % & | ^ && || ?? ? : , . ?. ( [ { < ! ~ @".split())
_GOES_ON_BEFORE = set("= => + * / % & | ^ && || ?? ? : , . ?. ( [ < > ) ] }".split())
_JOINS = {"extends", "implements", "from", "as", "satisfies", "instanceof", "in", "of", "else", "catch", "finally", "while"}
_OPENS = {"export", "default", "const", "let", "var", "import", "function", "class", "interface", "type", "enum", "namespace", "module", "declare", "abstract", "async", "await", "new", "return", "typeof", "void", "delete", "throw", "extends", "implements", "from", "as", "else", "try", "finally", "do"}
_BLOCKS = {"function", "class", "interface", "enum", "namespace", "module", "if", "for", "while", "switch", "try", "do", "else", "catch", "finally", "with", "global"}


def _template(text: str, at: int) -> int:
    """The end of a template literal whose backtick ends at `at`."""
    while m := _TICK.search(text, at):
        at = m.end()
        if m[0] == "`":
            return at
        if m[0] == "${":
            depth = 1
            while depth:
                t = _TS.match(text, at)
                if not t:
                    raise Unsplit("unterminated template")
                at = t.end()
                if t["tick"]:
                    at = _template(text, at)
                depth += (t["op"] == "{") - (t["op"] == "}")
    raise Unsplit("unterminated template")


def _markup(text: str, at: int) -> int:
    """The end of a JSX element that begins at `at`."""
    depth = 0
    while at < len(text):
        if text[at] == "{":
            nest = 0
            while True:
                t = _TS.match(text, at)
                if not t:
                    raise Unsplit("unterminated markup")
                at = _template(text, t.end()) if t["tick"] else t.end()
                nest += (t["op"] == "{") - (t["op"] == "}")
                if nest == 0:
                    break
        elif m := re.compile(r"</[^>]*>").match(text, at):
            depth, at = depth - 1, m.end()
        elif text[at] == "<":
            at += 1
            while at < len(text) and text[at] != ">" and not text.startswith("/>", at):
                if text[at] in "\"'":
                    at = text.find(text[at], at + 1) + 1 or len(text)
                elif text[at] == "{":
                    at = _markup_braces(text, at)
                else:
                    at += 1
            closed = text.startswith("/>", at)
            at += 2 if closed else 1
            depth += not closed
        else:
            at += 1
            continue
        if depth == 0:
            return at
    raise Unsplit("unterminated markup")


def _markup_braces(text: str, at: int) -> int:
    nest = 0
    while t := _TS.match(text, at):
        at = _template(text, t.end()) if t["tick"] else t.end()
        nest += (t["op"] == "{") - (t["op"] == "}")
        if nest == 0:
            return at
    raise Unsplit("unterminated markup")


def _script_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    at, last = 0, ""
    while at < len(text):
        value_before = bool(last) and (last in (")", "]", "}", "'") or (last[0].isalnum() or last[0] in "_$") and last not in _OPENS)
        if text[at] == "/" and not value_before and (m := _REGEX.match(text, at)):
            yield "'", at, m.end()
            at, last = m.end(), "'"
            continue
        if text[at] == "<" and not value_before and re.compile(r"<(?:[A-Za-z]|>)").match(text, at) and last in ("(", "=>", "return", "=", "?", ":", "&&", "||", ",", "[", "default"):
            try:
                end = _markup(text, at)
            except Unsplit:
                end = at + 1
            yield ("'", at, end) if end > at + 1 else ("<", at, end)
            at, last = end, "'" if end > at + 1 else "<"
            continue
        m = _TS.match(text, at)
        end = m.end()
        if m["tick"]:
            end = _template(text, end)
        if m["string"] is not None and not (m["q1"] or m["q2"]):
            raise Unsplit("unterminated string")
        if m["skip"] is None:
            last = "'" if m["tick"] or m["string"] is not None else m[0]
            yield last, at, end
        elif m[0].startswith("/*") and not m[0].endswith("*/"):
            raise Unsplit("unterminated comment")
        at = end


def script_spans(text: str) -> list[Span]:
    """Statements of a TypeScript or JavaScript module, by a boundary lexer.

    A statement ends with `;` at depth zero, with the brace that closes the body
    of a declaration or block, or with a line end where neither side can go on.
    Brackets that do not match and open literals make the text unsplit; finer
    grammar errors are not seen. Precomputed spans can be used instead.
    """
    lines, out, stack = _Lines(text), [], []
    words: list[str] = []
    first = last_end = None
    last = ""
    pairs = {")": "(", "]": "[", "}": "{"}

    def close() -> None:
        nonlocal first, words
        if first is not None:
            out.append((lines.of(first), lines.of(last_end - 1)))
        first, words = None, []

    tokens = list(_script_tokens(text))
    for i, (t, at, end) in enumerate(tokens):
        if not stack and first is not None and lines.of(at) > lines.of(last_end - 1):
            goes_on = last in _GOES_ON_AFTER or t in _GOES_ON_BEFORE or t in _JOINS and (t != "while" or words[:1] == ["do"]) or last in _OPENS or words[:1] == ["@"] and last != "}" or last == ")" and words[:1] and words[0] in ("if", "for", "while", "with")
            if not goes_on:
                close()
        if first is None:
            first = at
        if t in ("(", "[", "{"):
            stack.append(t)
        elif t in pairs:
            if not stack or stack.pop() != pairs[t]:
                raise Unsplit(f"unbalanced {t} on line {lines.of(at)}")
        last_end, last = end, t
        if stack:
            continue
        words.append(t)
        if t == ";":
            close()
        elif t == "}":
            heads = [w for w in words if w in _BLOCKS or w in ("=", "=>", "const", "let", "var", "type", "import")]
            following = tokens[i + 1][0] if i + 1 < len(tokens) else ""
            alone = words[0] == "}"  # a block of its own
            if (alone or heads and heads[0] in _BLOCKS) and following not in ("else", "catch", "finally") and not (words[0] == "do" and following == "while"):
                if following != ";":
                    close()
            elif words[:2] in (["export", "}"],) and following not in ("from", ";"):
                close()
    if stack:
        raise Unsplit(f"unclosed {stack[-1]} at the end of the file")
    close()
    return out


# --- files ----------------------------------------------------------------

SPLITTERS = {".py": python_spans, ".css": css_spans, ".sh": shell_spans} | dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), script_spans)


def units(path: str, text: str, spans: list[Span] | None = None) -> Iterator[tuple[int, int, str, list[tuple[int, str, int]]]]:
    """(first line, last line, squeezed text, selectors) of the file's statements, in order.

    A style rule with names of which any is a class or an id gives one unit per
    name, at the name's own line; other rules give one unit, whose selector is
    what stands before its brace. Raises Unsplit.
    """
    ext = next((e for e in SPLITTERS if path.lower().endswith(e)), None)
    if ext is None:
        raise Unsplit("no splitter for this extension")
    lines = text.split("\n")
    for first, last in SPLITTERS[ext](text) if spans is None else spans:
        raw = "\n".join(lines[first - 1 : last])
        said = squeezed(raw)
        if not said:
            continue
        if ext != ".css":
            yield first, last, said, []
            continue
        names = selectors(raw, first)
        if any("." in n or "#" in n for _, n, _ in names):
            for _, name, line in names:
                yield line, line, f"{squeezed(name)} {{ of the rule at {first}-{last} }}", [(1, squeezed(name), line)]
        else:
            yield first, last, said, [(1, said.split("{")[0].strip()[:120], first)]
