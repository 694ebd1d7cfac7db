"""Which file a module name means: joins on prefixes of names and suffixes of paths, the longest and nearest match winning.

A name asks for the end of a path ("app/util.py"). Every path is listed under each of its ends, and under each directory above the
root that the end leaves: the root itself and all directories around it. A file asks from its own directories. So the nearest
common directory of the file and the root is a key like any other, one equality join finds all candidates, and no root is guessed. For
each end, directory and kind of root one path is kept before the join, so files of the same name never meet all who import one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import paths, text
from repoquarry.functions.rows import unfold
from repoquarry.operators.skew import spread
from repoquarry.session import cut_lineage

SCRIPTS = ["JavaScript", "TypeScript", "JSX", "TSX", "Vue"]
JVM = ["Java", "Kotlin", "Scala"]

_ASKED = "array<struct<key: string, anchored: boolean, strict: boolean, rank: int>>"
_SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js"]
_JVM_ENDINGS = [".java", ".kt", ".scala"]
_FORMS = 16
"""More than the forms of one name; a rank is the number of matched parts times this, less the place of the form."""


def normal_path(path: Column) -> Column:
    """The path with "." and ".." parts resolved."""
    none = F.array().cast("array<string>")
    up = lambda parts: F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.aggregate(
        F.split(path, "/"), none, lambda parts, x: F.when(x == "..", up(parts)).when(x.isin(".", ""), parts).otherwise(F.array_append(parts, x))
    )
    return F.array_join(kept, "/")


def _directory(path: Column) -> Column:
    """Directory part, "" at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def _around(directory: Column) -> Column:
    """The directory and all around it, down from the root ""."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _forms(base: Column, endings: list[str], rank: Column | int, anchored: bool, strict: bool) -> Column:
    rank = F.lit(rank) if isinstance(rank, int) else rank
    return F.array(
        *[
            F.struct(F.concat(base, F.lit(e)).alias("key"), F.lit(anchored).alias("anchored"), F.lit(strict).alias("strict"), (rank * _FORMS - i).cast("int").alias("rank"))
            for i, e in enumerate(endings)
        ]
    ).cast(_ASKED)


def _exact(path: Column, endings: list[str], rank: Column | int = 1) -> Column:
    """Asks for the path itself, seen from the repository's root."""
    return F.transform(_forms(path, endings, rank, False, True), lambda a: a.withField("key", normal_path(a["key"])))


def _beginnings(parts: Column, build) -> Column:
    """What `build` asks for the first n parts, for every n."""
    return F.when(F.size(parts) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: build(F.array_join(F.slice(parts, F.lit(1), n), "/"), n)))).otherwise(
        F.array().cast(_ASKED)
    )


def _rust(path: Column, module: Column) -> Column:
    name = paths.file_name(path)
    top = name.isin("main.rs", "lib.rs", "mod.rs")
    own = F.when(top, _directory(path)).otherwise(F.regexp_replace(path, r"[.]rs$", ""))
    parts = F.split(module, "::")
    ups = F.size(F.filter(parts, lambda p: p == "super"))
    rest = F.filter(parts, lambda p: ~p.isin("crate", "self", "super", "*", ""))
    base = F.concat(own, F.lit("/"), F.repeat(F.lit("../"), ups))

    def near(inner: Column, n: Column) -> Column:
        return _exact(F.concat(base, inner), [".rs", "/mod.rs"], n + 1)

    def of_crate(inner: Column, n: Column) -> Column:
        return _forms(F.concat(F.lit("src/"), inner), [".rs", "/mod.rs"], n + 1, True, True)

    # What is no module of its own is an item of the module around it.
    around = normal_path(base)
    itself = F.when(ups > 0, _exact(around, [".rs", "/mod.rs", "/lib.rs", "/main.rs"])).otherwise(F.array().cast(_ASKED))
    return F.when(module.rlike("^(self|super)(::|$)"), F.concat(_beginnings(rest, near), itself)).when(
        module.startswith("crate::"), F.concat(_beginnings(rest, of_crate), _forms(F.lit("src/"), ["lib.rs", "main.rs"], 1, True, True))
    )


def _asked(language: Column, path: Column, module: Column) -> Column:
    """Ends of paths that a module may stand for. Strict ones must lie right below a directory around the file that names it."""
    own = F.concat(_directory(path), F.lit("/"))
    nested = F.replace(module, F.lit("."), F.lit("/"))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    climbed = F.concat(own, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/")))
    modules = [".py", "/__init__.py"]
    script = F.regexp_replace(module, r"^[@~]/", "")
    written = F.regexp_extract(module, r"^(.*)[.][cm]?jsx?$", 1)  # the compiled name of a TypeScript file
    backslashed = F.split(F.translate(F.regexp_replace(module, r"^\\", ""), "\\", "/"), "/")

    def php(n: Column) -> Column:
        kept = F.slice(backslashed, n, F.size(backslashed))
        return _forms(F.array_join(kept, "/"), [".php"], F.size(kept), True, False)

    ends = F.sequence(F.lit(1), F.greatest(F.size(backslashed) - 1, F.lit(1)))
    return (
        F.when((language == "Python") & (dots > 0), _exact(climbed, modules))
        # A single name says too little to be looked for in places no search path would lead to.
        .when((language == "Python") & ~module.contains("."), _forms(nested, modules, 1, True, True))
        .when(language == "Python", _forms(nested, modules, 1, True, False))
        .when(
            language.isin(SCRIPTS) & module.rlike(r"^\.\.?(/|$)"),
            F.concat(_exact(F.concat(own, module), _SCRIPT_ENDINGS, 2), F.when(written != "", _exact(F.concat(own, written), [".ts", ".tsx"])).otherwise(F.array().cast(_ASKED))),
        )
        .when(language.isin(SCRIPTS) & script.contains("/") & ~script.startswith("@"), _forms(script, _SCRIPT_ENDINGS, 1, True, False))
        .when(
            language.isin(JVM) & ~module.endswith("*"),
            F.concat(_forms(nested, _JVM_ENDINGS, 2, True, False), _forms(F.regexp_replace(nested, "/[^/]*$", ""), _JVM_ENDINGS, 1, True, False)),
        )
        .when(language.isin("C", "C++"), F.concat(_exact(F.concat(own, module), [""], 2), _forms(module, [""], 1, True, False)))
        .when(language == "Ruby", F.concat(_exact(F.concat(own, module), [".rb", ""], 2), _forms(module, [".rb"], 1, True, False)))
        .when(language == "Rust", _rust(path, module))
        .when((language == "PHP") & module.contains("\\"), F.flatten(F.transform(ends, php)))
        .otherwise(F.array().cast(_ASKED))
    )


def resolve(requests: DataFrame, places: DataFrame) -> DataFrame:
    """`(repo_id, src, module, place)`: of the places that meet a request the one of the highest rank, then below a directory around
    `src`, then with the longest directory in common, then of fewest directories, then first by name.

    Requests: `(repo_id, src, module, key, anchored, strict, rank)`; a request that is not anchored means the whole path. Places:
    `(repo_id, place)`.
    """
    wanted = requests.select("repo_id", "key").distinct()
    parts = F.split("place", "/")
    cut = lambda n: F.struct(
        F.array_join(F.slice(parts, F.lit(1), n), "/").alias("root"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("key")
    )
    ends = unfold(places.filter("place <> ''"), ["repo_id", "place"], F.transform(F.sequence(F.lit(0), F.size(parts) - 1), cut), "end")
    met = ends.select("repo_id", "place", "end.root", "end.key").join(wanted, ["repo_id", "key"], "left_semi")
    listed = unfold(met, ["repo_id", "place", "key", "root"], _around(F.col("root")), "anchor")
    fewest = F.struct(F.size(F.split("place", "/")), F.col("place"))
    index = listed.groupBy("repo_id", "anchor", "key", (F.col("anchor") == F.col("root")).alias("below")).agg(F.min_by("place", fewest).alias("place"))
    anchors = F.when(F.col("anchored"), _around(_directory(F.col("src")))).otherwise(F.array(F.lit("")))
    asked = unfold(requests, ["repo_id", "src", "module", "key", "strict", "rank"], anchors, "anchor")
    # A file imported everywhere is a hot key of the requests only; of each key there are two rows at most on the other side.
    found = asked.join(index, ["repo_id", "anchor", "key"]).filter(F.col("below") | ~F.col("strict"))
    best = F.struct((-F.col("rank")).alias("rank"), (~F.col("below")).alias("below"), (-F.length("anchor")).alias("anchor"), F.size(F.split("place", "/")).alias("depth"), F.col("place"))
    return found.groupBy("repo_id", "src", "module").agg(F.min(best).alias("best")).select("repo_id", "src", "module", "best.place")


def _by_name(edges: DataFrame, roots: DataFrame, separator: str) -> DataFrame:
    """The edges with the root `(repo_id, name, root)` whose name is the longest beginning of the module, and the parts behind it."""
    parts = F.split("module", separator)
    prefix = lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), separator).alias("name"), F.slice(parts, n + 1, F.size(parts)).alias("behind"))
    asked = unfold(edges, ["repo_id", "src", "module"], F.transform(F.sequence(F.lit(1), F.size(parts)), prefix), "begin")
    found = asked.select("repo_id", "src", "module", "begin.*").join(roots, ["repo_id", "name"])
    longest = F.max_by(F.struct("root", "behind"), F.length("name")).alias("at")
    return found.groupBy("repo_id", "src", "module").agg(longest).select("repo_id", "src", "module", "at.*")


_CRATE = r"(?m)^\[package\][ \t]*\n(?:(?!\[)[^\n]*\n)*?[ \t]*name[ \t]*=[ \t]*\"([^\"\n]+)\""
_GO_MODULE = r"(?m)^module[ \t]+\"?([^\s\"]+)"
_NAMESPACE = r"(?m)^[ \t]*namespace[ \t]+([\w.]+)"


def _declared(files: DataFrame) -> DataFrame:
    """`(repo_id, path, kind, name)`: names of crates, Go modules and C# namespaces, from the few files that declare any."""
    file, content = paths.file_name("path"), text.unix_lines("content")
    kind = F.when(file == "Cargo.toml", "crate").when(file == "go.mod", "go").when(paths.language_of("path") == "C#", "space")
    names = F.when(kind == "crate", F.array(F.translate(F.regexp_extract(content, _CRATE, 1), "-", "_"))).when(
        kind == "go", F.array(F.regexp_extract(content, _GO_MODULE, 1))
    ).otherwise(F.regexp_extract_all(content, F.lit(_NAMESPACE), F.lit(1)))
    rows = unfold(files.filter(kind.isNotNull()), ["repo_id", "path", kind.alias("kind")], F.array_distinct(names), "name")
    return rows.filter("name <> ''")


def _roots(declared: DataFrame, kind: str) -> DataFrame:
    """`(repo_id, name, root)`: the tree a name stands for; of several trees of one name the uppermost."""
    found = declared.filter(F.col("kind") == kind).select("repo_id", "name", _directory(F.col("path")).alias("root"))
    return found.groupBy("repo_id", "name").agg(F.min_by("root", F.struct(F.length("root"), F.col("root"))).alias("root"))


def _below(root: Column, behind: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(root), behind), lambda p: p != ""), "/")


def _in_directories(packages: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges to every source file that lies right in the directory (`place`) a package means."""
    return packages.join(sources.withColumn("place", _directory(F.col("dst"))), ["repo_id", "place"]).select("repo_id", "src", "dst")


def file_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """`(repo_id, src, dst)`: import edges whose module is a file of the same repository.

    * Modules of Python, classes of Java, Kotlin and Scala, includes of C and C++, required files of Ruby, classes of PHP and paths of
      JavaScript and TypeScript (also aliases as "@/") are ends of paths, resolved by `resolve`; relative ones are whole paths.
    * Rust: `crate::`, `self::`, `super::`, declared modules, and crates of the repository by the name in their Cargo.toml.
    * Go: packages below the module of a go.mod; an edge to each file of the package that is no test.
    * `a.b.*` of the JVM languages: every file of the package's nearest directory. C#: every file that declares the namespace.

    Ignored files are nobody's modules. Packages give as many edges as they have files.
    """
    visible = files.filter(~paths.is_ignored("path"))
    # Both are narrow and read several times; contents are read once for each of them.
    named = cut_lineage(edges.select("repo_id", F.col("path").alias("src"), "language", "module"))
    declared = cut_lineage(_declared(visible))
    # Paths are dealt to all tasks, as listing their ends costs far more than reading them.
    sources = cut_lineage(spread(visible.select("repo_id", F.col("path").alias("dst"))))
    asked = unfold(named, ["repo_id", "src", "module"], _asked(F.col("language"), F.col("src"), F.col("module")), "asked").select("repo_id", "src", "module", "asked.*")

    crates = _roots(declared, "crate")
    external = _by_name(named.filter((F.col("language") == "Rust") & ~F.col("module").rlike("^(crate|self|super)(::|$)")), crates, "::")
    source_root = F.concat_ws("/", F.nullif("root", F.lit("")), F.lit("src"))
    inner = F.filter("behind", lambda p: p != "*")
    of_crates = F.concat(
        _beginnings(inner, lambda begin, n: _exact(F.concat(source_root, F.lit("/"), begin), [".rs", "/mod.rs"], n + 1)), _exact(source_root, ["/lib.rs", "/main.rs"])
    )
    asked = asked.unionByName(unfold(external, ["repo_id", "src", "module"], of_crates, "asked").select("repo_id", "src", "module", "asked.*"))
    # Stored, as the expressions that ask are large and would be planned for every use.
    single = resolve(cut_lineage(asked), sources.withColumnRenamed("dst", "place")).select("repo_id", "src", F.col("place").alias("dst"))

    go_packages = _by_name(named.filter("language = 'Go'"), _roots(declared, "go"), "/").select("repo_id", "src", _below(F.col("root"), F.col("behind")).alias("place"))
    go_files = sources.filter(F.col("dst").endswith(".go") & ~F.col("dst").endswith("_test.go"))

    jvm_files = sources.filter(F.col("dst").rlike(r"[.](java|kt|scala)$"))
    wild = named.filter(F.col("language").isin(JVM) & F.col("module").endswith(".*"))
    package = F.replace(F.regexp_replace("module", r"[.][*]$", ""), F.lit("."), F.lit("/"))
    wild_asked = wild.select("repo_id", "src", "module", package.alias("key"), F.lit(True).alias("anchored"), F.lit(False).alias("strict"), F.lit(1).alias("rank"))
    wild_packages = resolve(wild_asked, jvm_files.select("repo_id", _directory(F.col("dst")).alias("place")).distinct())

    spaces = declared.filter("kind = 'space'").select("repo_id", F.col("path").alias("dst"), F.col("name").alias("module"))
    using = named.filter("language = 'C#'").join(spaces, ["repo_id", "module"]).select("repo_id", "src", "dst")

    found = single.unionByName(_in_directories(go_packages, go_files)).unionByName(_in_directories(wild_packages, jvm_files)).unionByName(using)
    return found.filter("src <> dst").distinct()
