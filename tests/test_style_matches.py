"""Token joins against the boundary patterns that they stand for."""

import re

import numpy as np

from tracewell.operators import styles

EDGE = r"[A-Za-z0-9_-]"


def plain(name, line):
    """The first mode in which the line writes the name, by patterns."""
    bounded = lambda s: rf"(?<!{EDGE}){re.escape(s)}"
    if re.search(bounded(name) + rf"(?!{EDGE})", line):
        return "exact"
    if re.search(bounded(name) + rf"(?:--|__|-){EDGE}+", line):
        return "prefix"
    ends = {name[: m.end()] for j in ("-", "--", "__") for m in re.finditer(f"(?={j})", name) if m.start() > 0 for m in [re.compile(j).match(name, m.start())]}
    humps = [name[:i] for i in range(1, len(name)) if name[i].isupper() and not name[i - 1].isupper()]
    if any(re.search(bounded(s) + rf"(?!{EDGE})", line) for s in ends) or any(re.search(bounded(h) + r"\$\{", line) for h in humps):
        return "stem"
    return None


def test_modes_equal_patterns(spark):
    rng = np.random.default_rng(8)
    text = lambda letters, n: "".join(rng.choice(list(letters), n))
    names = sorted({c + text("abB-_", int(rng.integers(0, 6))) for c in "abab" for _ in range(20)})
    lines = [text("abB-_ $.{", int(rng.integers(1, 14))) for _ in range(600)]
    found = styles.matches(
        spark.createDataFrame([(i, "class", n, "subject") for i, n in enumerate(names)], "id long, kind string, name string, role string"),
        spark.createDataFrame([("f.ts", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string"),
    )
    got = {(r["name"], r["line_no"]): r["mode"] for r in found.collect()}
    want = {(n, i): m for n in names for i, x in enumerate(lines) if (m := plain(n, x))}
    assert len(want) > 300 and got == want
