"""Load links: what a file's loading proves about its statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.functions import columns as C
from tracewell.operators.copies import folder, lang, once
from tracewell.operators.graph import closure
from tracewell.runtime import materialize

# How imports are written, and what only names or documents.
PY_FROM = r"(?U)^from\s+([.\w]+)\s+import\s+(.+)$"
PY_IMPORT = r"(?U)^import\s+([.\w]+(?:\s*,\s*[.\w]+)*)"
TS_FROM = r"""\bfrom\s*["']([^"']+)["']"""
TS_BARE = r"""\bimport\s*["']([^"']+)["']"""
TS_CALL = r"""\b(?:require|import)\s*\(\s*["']([^"']+)["']"""
CSS_IMPORT = r"""@import\s+(?:url\(\s*)?["']([^"']+)["']"""
SH_SOURCE = r"""(?m)(?:^|[;&|]\s*)(?:source|\.)\s+["']?([^\s"';|&]+)"""
PY_ASSIGN = r"(?U)^[\w.,\s\[\]()]+(?::[^=]+)?=(?!=)"
PY_NAMING = ("def ", "class ", "import ", "from ", "@", '"""', "'''", "#", 'r"""', "r'''")
TS_NAMING = ("import ", "export ", "function ", "class ", "interface ", "type ", "enum ", "const ", "let ", "var ", "//", "/*", '"use client"', "'use client'", '"use server"', "'use server'")
TS_SILENT = ("/*", "//", "declare ", "namespace ", "module ")
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".css", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
TWINS = {".js": (".ts", ".tsx"), ".mjs": (".mts",), ".cjs": (".cts",), ".jsx": (".tsx",)}


def acts(file: Column, text: Column) -> Column:
    """whether a top-level statement does something by being loaded."""
    t = C.lstrip(text)
    python = F.when(t.startswith("from __future__ "), True).when(C.starts_any(t, PY_NAMING), False).otherwise(~t.rlike(PY_ASSIGN))
    shell = ~t.rlike(r"(?U)^(?:function\s+[A-Za-z_]\w*|[A-Za-z_]\w*\s*\(\))") & ~t.startswith("#")
    script = (
        F.when(C.starts_any(t, ('import "', "import '", "declare module", "declare global")), True)
        .when(C.starts_any(t, TS_NAMING), False)
        .otherwise(~C.starts_any(t, TS_SILENT))
    )
    return F.when(t == "", False).when(C.has_ext(file, S.PY), python).when(C.has_ext(file, S.SHELL), shell).otherwise(script)


def written_imports(statements: DataFrame) -> DataFrame:
    """X1 (id, file, written): every module or path that a statement loads, as written."""
    t = F.col("text")
    module = F.regexp_extract(t, PY_FROM, 1)
    head = F.when(module.endswith("."), module).otherwise(F.concat(module, F.lit(".")))
    listed = F.filter(F.regexp_extract_all(F.split(F.regexp_extract(t, PY_FROM, 2), "#")[0], F.lit(r"(?U)\w+"), F.lit(0)), lambda n: ~n.isin("import", "as"))
    from_names = F.concat(F.array(module), F.transform(listed, lambda n: F.concat(head, n)))
    plain = F.filter(F.transform(F.split(F.regexp_extract(t, PY_IMPORT, 1), ","), lambda m: F.trim(m)), lambda m: m != "")
    python = F.when(t.rlike(PY_FROM), from_names).otherwise(plain)
    script = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (TS_FROM, TS_BARE, TS_CALL)])
    found = (
        F.when(C.has_ext(F.col("file"), S.PY), python)
        .when(C.has_ext(F.col("file"), S.SCRIPT), script)
        .when(C.has_ext(F.col("file"), S.STYLE), F.regexp_extract_all(t, F.lit(CSS_IMPORT), F.lit(1)))
        .when(C.has_ext(F.col("file"), S.SHELL), F.regexp_extract_all(t, F.lit(SH_SOURCE), F.lit(1)))
    )
    return statements.select("id", "file", F.explode(found).alias("written"))


def module_index(files: DataFrame) -> DataFrame:
    """J3 (module, n, target): every dotted suffix of each Python file's path, with how many files carry it."""
    stem = F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), "/__init__$", "")
    parts = F.split(stem, "/")
    one = files.where(C.has_ext(F.col("file"), S.PY)).select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("module"))
    return one.groupBy("module").agg(F.count("*").alias("n"), F.min("file").alias("target"))


def python_candidates(written: Column, importer: Column) -> Column:
    """Paths that a relative Python import can mean."""
    dots = F.length(F.regexp_extract(written, r"^\.+", 0))
    rest = F.replace(F.regexp_replace(written, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.split(importer, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), "/")
    stem = F.when(rest == "", base).otherwise(F.trim(F.concat(base, F.lit("/"), rest), F.lit("/")))
    return F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))


def _forms(base: Column) -> Column:
    """The paths that a base path can mean, in the order in which the first that exists wins."""
    twins = F.array(base)
    for ext, others in TWINS.items():
        stem = F.regexp_replace(base, rf"\{ext}$", "")
        twins = F.when(base.endswith(ext), F.concat(F.array(base), F.array(*[F.concat(stem, F.lit(o)) for o in others]))).otherwise(twins)
    return F.flatten(F.transform(twins, lambda b: F.array(*[F.concat(b, F.lit(s)) for s in SUFFIXES])))


def _stated(written: Column, aliases: list[tuple[str, str]]) -> Column:
    """The bases that stated aliases, which are prefixes, give."""
    if not aliases:
        return F.array().cast("array<string>")
    bases = [F.when(written.startswith(a), F.concat(F.lit(d), F.substring(written, F.lit(len(a) + 1), F.length(written)))) for a, d in aliases]
    return F.filter(F.array(*bases), lambda b: b.isNotNull())


def script_candidates(written: Column, importer: Column, aliases: list[tuple[str, str]]) -> Column:
    """Paths that a relative or aliased script import can mean, in order."""
    bases = F.when(written.startswith("."), F.array(C.joined_path(C.dirname(importer), written))).otherwise(_stated(written, aliases))
    return F.array_distinct(F.flatten(F.transform(bases, _forms)))


def guessed_tails(written: Column, aliases: list[tuple[str, str]]) -> Column:
    """What can stand below any top folder for a specifier that no alias states and that begins with no letter or digit."""
    guess = ~written.startswith(".") & (F.size(_stated(written, aliases)) == 0) & ~written.rlike(r"^[\p{L}\p{N}]") & written.contains("/")
    return F.when(guess, F.array_distinct(_forms(F.regexp_extract(written, r"^[^/]*/(.*)$", 1))))


def path_candidates(written: Column, importer: Column, shell: bool) -> Column:
    """The path that a style import or a sourced script means; none for the network, absolute paths or variables."""
    never = (written.contains("$") | written.startswith("/")) if shell else C.starts_any(written, ("http://", "https://", "//"))
    return F.when(never, F.array().cast("array<string>")).otherwise(F.array(C.joined_path(C.dirname(importer), written)))


def resolved(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """imports(file, written, ...) with target, priority and verdict, one row per target.

    verdict: resolved, ambiguous (several files carry the module's name) or
    outside (no file); the latter two have one row without a target. priority orders
    a row's targets: by top folder where folders are guessed, then by form.
    """
    # all that an import means hangs on the importer's folder and language and on what is written
    mark = {"__folder": folder(F.col("file")), "__lang": lang(F.col("file"))}
    given = materialize(imports.withColumns(mark), "given")
    rows = given.groupBy(*mark, "written").agg(F.min("file").alias("file"))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "asked")
    f, w = F.col("file"), F.col("written")
    paths = (
        F.when(C.has_ext(f, S.PY), F.when(w.startswith("."), python_candidates(w, f)))
        .when(C.has_ext(f, S.SCRIPT), script_candidates(w, f, list(aliases)))
        .when(C.has_ext(f, S.STYLE), path_candidates(w, f, shell=False))
        .when(C.has_ext(f, S.SHELL), path_candidates(w, f, shell=True))
    )
    known = files.select(F.col("file").alias("target")).distinct()
    place = lambda root: F.struct(root.alias("root"), F.col("at").alias("at")).alias("priority")
    by_path = rows.select("__row", F.posexplode(paths).alias("at", "target")).join(known, "target").select("__row", place(F.lit("")), "target")
    below = known.where(F.col("target").contains("/")).select("target", F.regexp_extract("target", "^[^/]*", 0).alias("root"), F.regexp_extract("target", "^[^/]*/(.*)$", 1).alias("tail"))
    guessed = rows.where(C.has_ext(f, S.SCRIPT)).select("__row", F.posexplode(guessed_tails(w, list(aliases))).alias("at", "tail"))
    by_tail = guessed.join(below, "tail").select("__row", place(F.col("root")), "target")
    absolute = rows.where(C.has_ext(f, S.PY) & ~w.startswith(".")).select("__row", "written", F.lit(0).alias("at"))
    modules = module_index(files).select(F.col("module").alias("written"), F.when(F.col("n") == 1, F.col("target")).alias("target"))
    by_module = absolute.join(modules, "written").select("__row", place(F.lit("")), "target")
    hits = by_path.unionByName(by_tail).unionByName(by_module).withColumn("hit", F.lit(True))
    verdict = F.when(F.col("hit").isNull(), "outside").when(F.col("target").isNull(), "ambiguous").otherwise("resolved")
    hits = rows.select(*mark, "written", "__row").join(hits, "__row").drop("__row")
    return given.join(hits, [*mark, "written"], "left").withColumn("verdict", verdict).select(*imports.columns, "priority", "target", "verdict")


def unnamed_rules(statements: DataFrame, selectors: DataFrame) -> DataFrame:
    """F7 (id): style statements none of whose selectors holds a class or an id."""
    per = selectors.groupBy(F.col("statement_id").alias("id")).agg(F.bool_and(~F.col("selector").rlike("[.#]")).alias("bare"))
    return statements.where(C.has_ext(F.col("file"), S.STYLE)).select("id").join(per.where("bare"), "id", "left_semi")


def _imported(rows: DataFrame, texts: DataFrame, aliases: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(id, file, written, priority, target, verdict) of all imports, and (id, file, target) of those that load another file; each text is read once."""
    said = materialize(written_imports(texts.withColumnRenamed("said", "id")).select(F.col("id").alias("said"), "written"), "written")
    asked = rows.join(said, "said").select("id", "file", "written")
    found = materialize(resolved(asked, rows.select("file").distinct(), aliases), "imports")
    return found, materialize(found.where("verdict = 'resolved' and target <> file").select("id", "file", "target").distinct(), "into")


def loaded_files(statements: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """(file): files that another file loads; what load_graph gives as loaded, without its links."""
    return _loaded(_imported(*once(statements), aliases)[1])


def _loaded(into: DataFrame) -> DataFrame:
    return into.select(F.col("target").alias("file")).distinct()


def load_graph(statements: DataFrame, entries: DataFrame, selectors: DataFrame, aliases: list[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """Links (source, target, kind), imports with verdicts, loaded files, demoted entries.

    A file acts if one of its statements does, or if it imports a file that
    acts. Loading a file proves its acting statements and those of its imports
    that load acting files; of a sheet, its imports and its unnamed rules.
    """
    rows, texts = once(statements)
    found, into = _imported(rows, texts, aliases)
    bare = unnamed_rules(rows, selectors).withColumn("bare", F.lit(True))
    text = F.col("text")
    facts = texts.select("said", text.rlike(CSS_IMPORT).alias("sheet"), acts(F.col("file"), text).alias("acting"), C.strip(text).isin(*S.DIRECTIVES).alias("directive"))
    rows = rows.withColumn("style", F.col("lang") == "style").join(materialize(facts, "facts"), "said").join(bare, "id", "left")
    sheet = F.col("sheet") | F.coalesce("bare", F.lit(False))
    rows = rows.select("id", "file", "style", "acting", "directive", F.when(F.col("style"), sheet).otherwise(F.col("acting")).alias("acts"))
    rows = materialize(rows, "acts")
    own = rows.where("acts").select("file").distinct()
    acting = materialize(closure(own, into.select("target", "file"), "file", "target", "file").select("file"), "acting")
    detonating = into.join(acting.select(F.col("file").alias("target")), "target", "left_semi").select("id").distinct().withColumn("detonates", F.lit(True))
    loadable = materialize(rows.join(detonating, "id", "left").where("acts or (detonates and not style)").select("id", "file"), "loadable")
    links = into.select(F.col("id").alias("source"), F.col("target").alias("file")).join(loadable.withColumnRenamed("id", "target"), "file").where("source <> target")
    # entry files: their directives count only where something imports them
    here = entries.select("id").join(rows, "id")
    imported = into.select(F.col("target").alias("file")).distinct().withColumn("imported", F.lit(True))
    per = here.groupBy("file").agg(F.min("id").alias("first"), F.bool_and("directive").alias("only")).join(imported, "file", "left")
    fall = F.col("only") & F.col("imported").isNull()
    demoted = here.join(per.where(fall).select("file"), "file", "left_semi").select("id", "file", F.lit("directive in a file nothing imports").alias("reason"))
    started = per.where(~fall).select("file", "first").join(loadable.join(rows.where("style").select("id"), "id", "left_anti").withColumnRenamed("id", "target"), "file")
    sheets = per.where(~fall).join(rows.where("style"), "file").where("acting").select("first", F.col("id").alias("target"))
    first = started.select(F.col("first").alias("source"), "target").unionByName(sheets.select(F.col("first").alias("source"), "target")).where("source <> target")
    return {
        "links": links.select("source", "target").unionByName(first).distinct().withColumn("kind", F.lit("LOADS")),
        "imports": found,
        "loaded": _loaded(into),
        "demoted": demoted,
    }


def unresolved_heads(imports: DataFrame, top: int = 10) -> DataFrame:
    """A7 (head, imports): the commonest first pieces of what resolved to no file."""
    return imports.where("verdict = 'outside'").groupBy(F.substring(F.split("written", "/")[0], 1, 40).alias("head")).agg(F.count("*").alias("imports")).orderBy(F.desc("imports"), "head").limit(top)
