"""Declared dependencies, import edges, and what a change reaches through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import paths, text
from repoquarry.functions.rows import unfold
from repoquarry.operators.modules import file_edges
from repoquarry.operators.skew import spread
from repoquarry.session import cut_lineage

_ENTRY = "array<struct<package: string, version: string>>"


def _all(value: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(value, F.lit(regex), F.lit(group))


def _pair(package: Column, version: Column) -> Column:
    return F.struct(package.alias("package"), F.nullif(text.strip_text(version), F.lit("")).alias("version"))


def _by_regex(value: Column, regex: str) -> Column:
    """Entries of every match of a regex with the package in group 1 and the version in group 2."""
    return F.transform(_all(value, regex, 0), lambda m: _pair(F.regexp_extract(m, regex, 1), F.regexp_extract(m, regex, 2))).cast(_ENTRY)


_REQUIREMENT = r"([A-Za-z0-9][A-Za-z0-9._-]*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*((?:[=<>!~]=?=?[ \t]*[^\s;#,\"']+[ \t]*,?[ \t]*)*)"
# A line that is an address names no package.
_LINE_REQUIREMENT = rf"(?m)^[ \t]*(?![A-Za-z0-9+._-]*:){_REQUIREMENT}"
_QUOTED_REQUIREMENT = rf"[\"']{_REQUIREMENT}"
_TOML_PAIR = r"(?m)^[ \t]*\"?([A-Za-z0-9._-]+)\"?[ \t]*=[ \t]*(?:\{[^}\n]*?version[ \t]*=[ \t]*)?\"([^\"\n]*)\""
_GO_REQUIRE = r"(?m)^[ \t]*(?:require[ \t]+)?([\w.~-]+(?:\.[\w.~-]+)*/[\w./~-]+)[ \t]+(v[^\s]+)"
_CARGO_TABLE = r"(?m)^\[(?:target\.[^\]\n]+\.)?(?:dev-|build-)?dependencies\.([\w-]+)\][ \t]*\n(?:(?!\[)[^\n]*\n)*?[ \t]*version[ \t]*=[ \t]*\"([^\"\n]*)\""
_SETUP_CFG = r"(?m)^install_requires[ \t]*=[ \t]*([^\n]*(?:\n[ \t]+[^\n]*)*)"
_GEM = r"(?m)^[ \t]*gem[ \t]+['\"]([^'\"\n]+)['\"](?:[ \t]*,[ \t]*['\"]([^'\"\n]*)['\"])?"
_GRADLE = r"(?m)^[ \t]*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt|annotationProcessor)[ \t(]+['\"]([^:'\"\n]+:[^:'\"\n]+)(?::([^'\"\n]*))?['\"]"
_POM = r"(?s)<dependency>.*?</dependency>"
_POM_PROPERTIES = r"(?s)<properties>(.*?)</properties>"
_SETUP_PY = r"\b(?:install_requires|setup_requires|tests_require)\s*=\s*\[((?:[^\]\"']|\"[^\"]*\"|'[^']*')*)\]"
_DOTNET = r"(?s)<Package(?:Reference|Version)\b[^>]*?(?:/>|>.*?</Package(?:Reference|Version)>)"


def _toml_sections(value: Column, names: str) -> Column:
    """Bodies of the TOML tables with one of the names, joined."""
    return F.array_join(_all(value, rf"(?ms)^\[(?:{names})\][ \t]*\n(.*?)(?=^\[|\z)", 1), "\n")


def _json_maps(value: Column, fields: list[str]) -> Column:
    """Entries of objects that map packages to versions."""
    parsed = F.from_json(value, ", ".join(f"`{f}` map<string,string>" for f in fields))

    def entries(field: str) -> Column:
        return F.coalesce(
            F.transform(F.map_entries(parsed[field]), lambda e: _pair(e["key"], e["value"])).cast(_ENTRY), F.array().cast(_ENTRY)
        )

    return F.concat(*map(entries, fields))


def _package_json(value: Column) -> Column:
    return _json_maps(value, ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"])


def _tag(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1)


def _pom(value: Column) -> Column:
    """Declared versions; one that names a property of the same file has its value."""
    block = F.array_join(_all(value, _POM_PROPERTIES), "\n")
    properties = F.transform(
        _all(block, r"<[\w.-]+>[^<]*</", 0),
        lambda p: F.struct(F.regexp_extract(p, r"^<([\w.-]+)>", 1).alias("name"), F.regexp_extract(p, r">\s*([^<]*?)\s*<", 1).alias("value")),
    )

    def entry(b: Column, known: Column) -> Column:
        version = _tag(b, "version")
        name = F.regexp_extract(version, r"^\$\{(.+)\}$", 1)
        meant = F.try_element_at(F.filter(known, lambda p: p["name"] == name), F.lit(1))["value"]
        return _pair(F.concat_ws(":", _tag(b, "groupId"), _tag(b, "artifactId")), F.coalesce(meant, version))

    # A one-element array binds the properties, so they are found once.
    return F.transform(F.array(properties), lambda known: F.transform(_all(value, _POM, 0), lambda b: entry(b, known)))[0].cast(_ENTRY)


def _dotnet(value: Column) -> Column:
    def entry(b: Column) -> Column:
        version = F.regexp_extract(b, r"\bVersion=[\"']([^\"']*)[\"']", 1)
        return _pair(F.regexp_extract(b, r"\b(?:Include|Update)=[\"']([^\"']+)[\"']", 1), F.when(version != "", version).otherwise(_tag(b, "Version")))

    return F.filter(F.transform(_all(value, _DOTNET, 0), entry), lambda e: e["package"] != "").cast(_ENTRY)


def _pyproject(value: Column) -> Column:
    listed = F.array_join(_all(value, r"(?ms)^dependencies[ \t]*=[ \t]*\[(.*?)^?\][ \t]*$", 1), "\n")
    poetry = _toml_sections(value, r"tool\.poetry\.(?:dev-)?dependencies|tool\.poetry\.group\.[\w-]+\.dependencies")
    groups = _toml_sections(value, r"project\.optional-dependencies|dependency-groups")
    return F.concat(_by_regex(listed, _QUOTED_REQUIREMENT), _by_regex(groups, _QUOTED_REQUIREMENT), _by_regex(poetry, _TOML_PAIR))


def _visible(files: DataFrame, with_ignored: bool) -> DataFrame:
    """Hidden and installed files (node_modules, ...) say nothing about a repository's own declarations."""
    return files if with_ignored else files.filter(~paths.is_ignored("path"))


def dependency_manifest(files: DataFrame, with_ignored: bool = False) -> DataFrame:
    """`(repo_id, path, ecosystem, package, version)` declared in manifests; other files' contents are not looked at."""
    name, content = paths.file_name("path"), text.unix_lines("content")
    readers = [
        (name.rlike(r"^requirements.*\.txt$"), "python", _by_regex(content, _LINE_REQUIREMENT)),
        (name == "pyproject.toml", "python", _pyproject(content)),
        (name == "package.json", "javascript", _package_json(content)),
        (name == "Cargo.toml", "rust", F.concat(
            _by_regex(_toml_sections(content, r"(?:workspace\.|target\.[^\]\n]+\.)?(?:dev-|build-)?dependencies"), _TOML_PAIR), _by_regex(content, _CARGO_TABLE)
        )),
        (name == "go.mod", "go", _by_regex(content, _GO_REQUIRE)),
        (name == "pom.xml", "java", _pom(content)),
        (name == "Pipfile", "python", _by_regex(_toml_sections(content, "packages|dev-packages"), _TOML_PAIR)),
        (name == "setup.cfg", "python", _by_regex(F.array_join(_all(content, _SETUP_CFG), "\n"), _LINE_REQUIREMENT)),
        (name == "Gemfile", "ruby", _by_regex(content, _GEM)),
        (name == "composer.json", "php", _json_maps(content, ["require", "require-dev"])),
        (name.isin("build.gradle", "build.gradle.kts"), "java", _by_regex(content, _GRADLE)),
        (name == "setup.py", "python", _by_regex(F.array_join(_all(content, _SETUP_PY), "\n"), _QUOTED_REQUIREMENT)),
        (name.rlike(r"[.](cs|fs|vb)proj$|^Directory[.]Packages[.]props$"), "dotnet", _dotnet(content)),
    ]
    return _entries(_visible(files, with_ignored), readers)


def _entries(files: DataFrame, readers: list[tuple[Column, str, Column]]) -> DataFrame:
    """Entries of the files that one of the readers `(test of the name, ecosystem, entries of the content)` knows."""
    ecosystem, entries = F.lit(None).cast("string"), F.array().cast(_ENTRY)
    for test, eco, found in reversed(readers):
        ecosystem = F.when(test, F.lit(eco)).otherwise(ecosystem)
        entries = F.when(test, found).otherwise(entries)
    manifests = files.filter(reduce(lambda a, b: a | b, [test for test, _, _ in readers]))
    rows = unfold(manifests, ["repo_id", "path", ecosystem.alias("ecosystem")], entries, "entry")
    return rows.select("repo_id", "path", "ecosystem", "entry.package", "entry.version")


_LOCKED_TOML = r"(?m)^\[\[package\]\][ \t]*\nname[ \t]*=[ \t]*\"([^\"\n]+)\"[ \t]*\nversion[ \t]*=[ \t]*\"([^\"\n]+)\""
_GO_SUM = r"(?m)^(\S+) (v[^\s/]+) h1:"
_YARN = r"(?m)^\"?(@?[^@\s\"]+)@[^\n]*:[ \t]*\n[ \t]+version:?[ \t]+\"?([^\"\s]+)"
_GEM_LOCK = r"(?m)^ {4}([\w.-]+) \(([^)\n]+)\)[ \t]*$"


def _npm_lock(value: Column) -> Column:
    version = "map<string, struct<version: string>>"
    parsed = F.from_json(value, f"packages {version}, dependencies {version}")
    # Newer files list folders, of which the own one has no name; older ones list names.
    folders = F.filter(F.map_entries(parsed["packages"]), lambda e: F.contains(e["key"], F.lit("node_modules/")))
    newer = F.transform(folders, lambda e: _pair(F.regexp_extract(e["key"], r"^.*node_modules/(.+)$", 1), e["value"]["version"])).cast(_ENTRY)
    older = F.transform(F.map_entries(parsed["dependencies"]), lambda e: _pair(e["key"], e["value"]["version"])).cast(_ENTRY)
    return F.coalesce(newer, older, F.array().cast(_ENTRY))


def _pipfile_lock(value: Column) -> Column:
    version = "map<string, struct<version: string>>"
    parsed = F.from_json(value, f"`default` {version}, develop {version}")
    none = F.array().cast(_ENTRY)
    entries = [F.transform(F.map_entries(parsed[f]), lambda e: _pair(e["key"], F.regexp_replace(e["value"]["version"], "^==", ""))).cast(_ENTRY) for f in ("default", "develop")]
    return F.concat(*[F.coalesce(e, none) for e in entries])


def _composer_lock(value: Column) -> Column:
    listed = "array<struct<name: string, version: string>>"
    parsed = F.from_json(value, f"packages {listed}, `packages-dev` {listed}")
    none = F.array().cast(listed)
    both = F.concat(F.coalesce(parsed["packages"], none), F.coalesce(parsed["packages-dev"], none))
    return F.transform(both, lambda e: _pair(e["name"], e["version"])).cast(_ENTRY)


def locked_dependencies(files: DataFrame, with_ignored: bool = False) -> DataFrame:
    """`(repo_id, path, ecosystem, package, version)` as lock files resolve them, also what is needed indirectly."""
    name, content = paths.file_name("path"), text.unix_lines("content")
    readers = [
        (name == "poetry.lock", "python", _by_regex(content, _LOCKED_TOML)),
        (name == "Pipfile.lock", "python", _pipfile_lock(content)),
        (name == "package-lock.json", "javascript", _npm_lock(content)),
        (name == "yarn.lock", "javascript", _by_regex(content, _YARN)),
        (name == "Cargo.lock", "rust", _by_regex(content, _LOCKED_TOML)),
        (name == "go.sum", "go", _by_regex(content, _GO_SUM)),
        (name == "Gemfile.lock", "ruby", _by_regex(content, _GEM_LOCK)),
        (name == "composer.lock", "php", _composer_lock(content)),
    ]
    return _entries(_visible(files, with_ignored), readers).distinct()


def _first_words(lists: Column) -> Column:
    """Module names of import lists such as "a, b as c"."""
    names = F.flatten(F.transform(lists, lambda names: F.split(names, ",")))
    return F.filter(F.transform(names, lambda n: F.regexp_extract(n, r"^\s*([\w.]+)", 1)), lambda n: n != "")


def _from_names(content: Column) -> Column:
    """`pkg.name` of every `from pkg import name, ...`: a name may be a module of the package. Stars and aliases are left out."""
    lines = _all(content, r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n#;]+)", 0)

    def names(line: Column) -> Column:
        package = F.regexp_extract(line, r"from[ \t]+([\w.]+)", 1)
        listed = F.split(F.regexp_extract(line, r"(?s)import[ \t]+(.*)", 1), ",")
        words = F.filter(F.transform(listed, lambda n: F.regexp_extract(n, r"([\w]+)", 1)), lambda n: n != "")
        return F.transform(words, lambda n: F.concat(package, F.when(package.endswith("."), "").otherwise("."), n))

    return F.flatten(F.transform(lines, names))


def _jvm_names(names: Column) -> Column:
    """Names of imports, one for each name in braces; "_" at the end is the "*" of Scala."""

    def split(name: Column) -> Column:
        package, listed = F.regexp_extract(name, r"^(.*)\{", 1), F.regexp_extract(name, r"\{(.*)\}", 1)
        inner = F.transform(F.split(listed, ","), lambda n: F.concat(package, F.regexp_extract(n, r"([\w*]+)", 1)))
        return F.when(listed != "", inner).otherwise(F.array(F.regexp_replace(name, r"\.?\{.*$|\.$", "")))

    return F.transform(F.flatten(F.transform(names, split)), lambda n: F.regexp_replace(n, r"\._$", ".*"))


_RUST_PUBLIC = r"(?:pub(?:\([^)]*\))?[ \t]+)?"


def _unbraced(statements: Column) -> Column:
    """Paths of `use` statements, with what stands in (nested) braces written out."""
    group = r"^(.*?)([\w:]*)\{([^{}]*)\}(.*)$"

    def innermost(statement: Column) -> Column:
        part = lambda k: F.regexp_extract(statement, group, k)
        listed = F.transform(F.filter(F.split(part(3), ","), lambda n: n != ""), lambda n: F.concat(part(2), n))
        return F.when(statement.contains("{"), F.concat(part(1), F.array_join(listed, ","), part(4))).otherwise(statement)

    def whole(statement: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(statement, r"\s+as\s+\w+", ""), r"\s+", "")
        levels = F.split(bare, r"\{")  # one more than there are braces
        return F.filter(F.split(F.aggregate(levels, bare, lambda text, _: innermost(text)), ","), lambda n: n != "")

    return F.transform(F.flatten(F.transform(statements, whole)), lambda m: F.regexp_replace(m, "^::|:+$", ""))


def _imports(language: Column, content: Column) -> Column:
    go_blocks = F.array_join(_all(content, r"(?ms)^import[ \t]*\((.*?)\)", 1), "\n")
    by_language = [
        (["Python"], F.concat(
            _all(content, r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"),
            _from_names(content),
            _first_words(_all(content, r"(?m)^[ \t]*import[ \t]+([\w., \t]+)")),
        )),
        (["JavaScript", "TypeScript", "JSX", "TSX", "Vue"], _all(content, r"(?:\bfrom|\bimport|\brequire\(|\bimport\()\s*['\"]([^'\"\n]+)['\"]")),
        (["Java", "Kotlin", "Scala"], _jvm_names(_all(content, r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\*|\{[^}\n]*\})?)"))),
        (["Go"], F.concat(
            _all(content, r"(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?\"([^\"\n]+)\""),
            _all(go_blocks, r"\"([^\"\n]+)\""),
        )),
        (["C", "C++"], _all(content, r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]")),
        (["Rust"], F.concat(
            _unbraced(_all(content, rf"(?m)^[ \t]*{_RUST_PUBLIC}use[ \t]+([^;]+);")),
            F.transform(_all(content, rf"(?m)^[ \t]*{_RUST_PUBLIC}mod[ \t]+(\w+)[ \t]*;"), lambda m: F.concat(F.lit("self::"), m)),
        )),
        (["C#"], _all(content, r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;")),
        (["Ruby"], _all(content, r"(?m)^[ \t]*require(?:_relative)?[ \t]+['\"]([^'\"\n]+)['\"]")),
        (["PHP"], _all(content, r"(?m)^[ \t]*use[ \t]+([\w\\]+)")),
    ]
    found = F.array().cast("array<string>")
    for languages, modules in reversed(by_language):
        found = F.when(language.isin(languages), modules).otherwise(found)
    return F.array_distinct(found)


def import_edges(files: DataFrame, with_ignored: bool = False) -> DataFrame:
    """`(repo_id, path, language, module)`: modules each source file names in its import statements.

    For `from pkg import name` both `pkg` and `pkg.name` are given, as either may be the module. Texts are dealt to all tasks, as their
    expressions cost far more than reading them.
    """
    known = _visible(files, with_ignored).filter(paths.language_of("path").isNotNull())
    sources = spread(known.select("repo_id", "path", "content")).withColumn("language", paths.language_of("path"))
    modules = _imports(F.col("language"), text.unix_lines("content"))
    return unfold(sources, ["repo_id", "path", "language"], modules, "module")


def impact_from_code(changed: DataFrame, files: DataFrame) -> DataFrame:
    """`change_impact` on the import edges of the files themselves."""
    return change_impact(changed, file_edges(import_edges(files), files))


def change_impact(changed: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`(repo_id, path, depth)`: changed files (depth 0) and the files reaching them through imports.

    Breadth first until no new file is reached; only a caller's `max_depth` ends it earlier. The edges are stored once. Each round
    joins the files the round before has newly reached, which are distinct, and is checkpointed in the shared folder, so plans stay
    short and lost executors cost one round. A file imported everywhere is a hot key of the edges only; Spark splits it.
    """
    keys = ["repo_id", "path"]
    incoming = cut_lineage(edges.select("repo_id", F.col("dst").alias("path"), F.col("src")).distinct())
    frontier = cut_lineage(changed.select(*keys).distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = incoming.join(frontier.select(*keys), keys).select("repo_id", F.col("src").alias("path")).distinct()
        frontier = cut_lineage(step.join(reached.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % 16 == 0:
            reached = cut_lineage(reached)
    return reached


def docs_to_refresh(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """`(repo_id, report_id, inputs, stale_inputs, last_change)`: how stale each report is.

    `reports(repo_id, report_id, file_path, built_at)` has a row per input file. Changes are reduced to the newest one
    per file first, so a file changed very often meets each report once.
    """
    last = changes.groupBy("repo_id", "file_path").agg(F.max("ts").alias("changed_at"))
    # One file (a README) may be an input of very many reports: a hot key of one side only, which Spark splits.
    joined = reports.join(last, ["repo_id", "file_path"], "left")
    stale = F.col("changed_at") > F.col("built_at")
    return joined.groupBy("repo_id", "report_id").agg(
        F.count("*").alias("inputs"), F.count_if(stale).alias("stale_inputs"), F.max("changed_at").alias("last_change")
    )
