"""Relations that the analysis keeps, as Spark schemas."""

from __future__ import annotations

#: What saved tables say of themselves.
CREATOR, VERSION = "tracewell", 2

STATEMENTS = "id long, file string, first_line int, last_line int, text string"
SELECTORS = "statement_id long, ordinal int, selector string, line int"
SPLIT_ERRORS = "file string, reason string"
LINKS = "source long, target long, kind string, origin string"
EDGES = "graph string, kind string, from_file string, from_line int, from_method string, from_label string, from_code string, to_file string, to_line int, to_method string, to_label string, to_code string"
EVENTS = "seq long, type string, id long, place string, inputs array<long>, outputs array<long>, unresolved boolean"

# The link kinds that carry need, and the end that the answer of a
# link is written at ("source": the needing one sends; "target": the needed one).
SENDER = {"CALL": "source", "REF": "target", "IS_CALL_FOR_IMPORT": "target", "LOADS": "source", "USES": "target", "STATED": "source"}
MACHINE_KINDS = ("CALL", "REF", "IS_CALL_FOR_IMPORT", "LOADS", "USES")
# Labels of places where a REF ends inside a statement.
LOCAL_LABELS = ("LOCAL", "METHOD_PARAMETER_IN", "METHOD_PARAMETER_OUT")
# Roles of a scope register.
ROLES = ("application", "test", "control", "migration", "generated", "dependency", "excluded")

PY = (".py",)
SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
STYLE = (".css",)
SHELL = (".sh",)
SUPPORTED = PY + SCRIPT + STYLE + SHELL
MACHINE_READABLE = PY + SCRIPT
DIRECTIVES = ('"use client";', "'use client';", '"use server";', "'use server';", '"use client"', "'use client'")
