"""Which file an import means, and renames of changed files, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repoquarry.operators import dependencies, modules, renames, snapshots


def _files(spark, tree, repo="r"):
    return spark.createDataFrame([(repo, p, c) for p, c in tree.items()], "repo_id string, path string, content string")


def _edges(spark, tree):
    files = _files(spark, tree)
    found = dependencies.file_edges(dependencies.import_edges(files), files)
    return sorted((r.src, r.dst) for r in found.collect())


@pytest.mark.parametrize(
    "tree,edges",
    [
        # Go: the longest module wins, tests are no part of a package.
        (
            {
                "go.mod": "module example.com/a\n", "x/x.go": "package x", "tools/go.mod": "module example.com/a/tools\n", "tools/gen/g.go": "package gen",
                "tools/gen/g_test.go": "package gen", "main.go": 'import (\n "example.com/a/x"\n "example.com/a/tools/gen"\n "os"\n)',
            },
            [("main.go", "tools/gen/g.go"), ("main.go", "x/x.go")],
        ),
        # Rust: declared modules, nested braces, crates by name.
        (
            {
                "app/Cargo.toml": '[package]\nname = "app"\n', "app/src/main.rs": "mod util;\nuse crate::{io, net::{self, tcp}};\nuse core_lib::deep::Thing;\n", "app/src/util.rs": "",
                "app/src/io.rs": "", "app/src/net/mod.rs": "use super::io::X;", "app/src/net/tcp.rs": "use super::Y;", "core/Cargo.toml": '[package]\nversion = "1"\nname = "core-lib"\n',
                "core/src/lib.rs": "", "core/src/deep.rs": "",
            },
            [
                ("app/src/main.rs", "app/src/io.rs"), ("app/src/main.rs", "app/src/net/mod.rs"), ("app/src/main.rs", "app/src/net/tcp.rs"), ("app/src/main.rs", "app/src/util.rs"),
                ("app/src/main.rs", "core/src/deep.rs"), ("app/src/net/mod.rs", "app/src/io.rs"), ("app/src/net/tcp.rs", "app/src/net/mod.rs"),
            ],
        ),
        # Java below a module; of equal ends the nearest root.
        (
            {
                "svc/src/main/java/p/A.java": "", "svc/src/test/java/p/ATest.java": "import p.A;\nimport static p.A.run;\n", "old/src/main/java/p/A.java": "",
                "old/src/main/java/q/B.java": "import p.*;",
            },
            [("old/src/main/java/q/B.java", "old/src/main/java/p/A.java"), ("svc/src/test/java/p/ATest.java", "svc/src/main/java/p/A.java")],
        ),
        # Python below any root; a single name only where a search path could lead.
        (
            {
                "backend/app/y.py": "", "backend/main.py": "from app.y import z\nimport os\nimport helper\n", "backend/helper.py": "", "lib/os.py": "", "jobs/run.py": "import app.y, helper",
                "backend/app/__init__.py": "from . import y", "backend/app/in/k.py": "from .. import y",
            },
            [
                ("backend/app/__init__.py", "backend/app/y.py"), ("backend/app/in/k.py", "backend/app/__init__.py"), ("backend/app/in/k.py", "backend/app/y.py"), ("backend/main.py", "backend/app/y.py"),
                ("backend/main.py", "backend/helper.py"), ("jobs/run.py", "backend/app/y.py"),
            ],
        ),
        # TypeScript: compiled names, index files, aliases; packages are no files.
        (
            {"web/a.ts": "import './b.js'; import x from './c'; import y from '@/ui/d'; import r from 'react'", "web/b.ts": "", "web/c/index.tsx": "", "web/src/ui/d.vue": "", "react.ts": ""},
            [("web/a.ts", "web/b.ts"), ("web/a.ts", "web/c/index.tsx"), ("web/a.ts", "web/src/ui/d.vue")],
        ),
        # C#: every file of the namespace; PHP: the longest end; C: own directory first; Ruby: required from lib.
        (
            {
                "A.cs": "namespace N.M;", "B.cs": "namespace N.M {\n}", "P.cs": "using N.M;\nusing System;", "src/Models/User.php": "", "Other/User.php": "", "w/i.php": "use App\\Models\\User;",
                "c/x.h": "", "c/m.c": '#include "x.h"\n#include "sub/y.h"', "x.h": "", "inc/sub/y.h": "", "lib/t/u.rb": "", "bin/r.rb": "require 't/u'",
            },
            [("P.cs", "A.cs"), ("P.cs", "B.cs"), ("bin/r.rb", "lib/t/u.rb"), ("c/m.c", "c/x.h"), ("c/m.c", "inc/sub/y.h"), ("w/i.php", "src/Models/User.php")],
        ),
        ({"k/src/A.scala": "import a.b.{C, D => E}\nimport a._", "k/src/a/b/C.scala": "", "k/src/a/b/D.scala": "", "k/src/a/F.kt": ""},
         [("k/src/A.scala", "k/src/a/F.kt"), ("k/src/A.scala", "k/src/a/b/C.scala"), ("k/src/A.scala", "k/src/a/b/D.scala")]),
    ],
)
def test_file_edges(spark, tree, edges):
    assert _edges(spark, tree) == sorted(edges)


def test_nearest_of_equal_ends(spark):
    """Every place against a plain choice: rank, below a directory around the file, longest common directory, fewest directories, name."""
    draw = random.Random(6)
    folder = lambda: "/".join(draw.choice("abc") for _ in range(draw.randrange(5)))
    join = lambda *parts: "/".join(p for p in parts if p)
    places = sorted({join(folder(), "m", draw.choice(["x.py", "y.py"])) for _ in range(60)})
    asked = [(join(folder(), f"s{i}.py"), draw.choice(["m/x.py", "m/y.py", "y.py"]), draw.random() < 0.3) for i in range(80)]
    requests = spark.createDataFrame([("r", s, k, k, True, strict, 1) for s, k, strict in asked], "repo_id string, src string, module string, key string, anchored boolean, strict boolean, rank int")
    found = {r.src: r.place for r in modules.resolve(requests, spark.createDataFrame([("r", p) for p in places], "repo_id string, place string")).collect()}
    for src, key, strict in asked:
        around = src.split("/")[:-1]
        choices = []
        for place in places:
            if place == key or place.endswith("/" + key):
                root = [p for p in place[: -len(key)].split("/") if p]
                common = next((i for i, (a, b) in enumerate(zip(root, around)) if a != b), min(len(root), len(around)))
                below = common == len(root)
                if below or not strict:
                    choices.append((not below, -len("/".join(around[:common])), len(place.split("/")), place))
        assert found.get(src) == (min(choices)[-1] if choices else None), (src, key, strict)


def test_chain_of_imports(spark):
    tree = {f"pkg/m{i}.py": f"from pkg.m{i + 1} import f" for i in range(12)}
    files = _files(spark, tree)
    reached = dependencies.impact_from_code(spark.createDataFrame([("r", "pkg/m11.py")], "repo_id string, path string"), files)
    assert {r.path: r.depth for r in reached.collect()} == {f"pkg/m{i}.py": 11 - i for i in range(12)}


def weights(text):
    found = Counter()
    for line in text.split("\n"):
        found[line] += len(line) + 1
    return found


def similarity(a, b):
    wa, wb = weights(a), weights(b)
    return sum(min(w, wb[line]) for line, w in wa.items()) / max(len(a) + 1, len(b) + 1)


def greedy(gone, new, threshold):
    name = lambda p: p.rpartition("/")[2]
    pairs = sorted((-similarity(a, b), name(p) != name(q), p, q) for p, a in gone.items() for q, b in new.items() if similarity(a, b) >= threshold)
    used, taken = set(), {}
    for far, _, p, q in pairs:
        if ("a", p) not in used and ("b", q) not in used:
            used |= {("a", p), ("b", q)}
            taken[q] = (p, -far)
    return taken


def test_renames_equal_greedy_choice(spark):
    draw = random.Random(11)
    common = ["}", "", "license line that all files share", "import os"]
    texts = []
    for i in range(40):
        lines = [draw.choice(common) if draw.random() < 0.5 else f"line {draw.randrange(60)} of file {i % 13}" for _ in range(draw.randrange(1, 25))]
        texts.append("\n".join(lines))
    gone = {f"old/f{i}.py": t for i, t in enumerate(texts)} | {"old/empty": "", "old/same1": "\n\n}", "old/same2": "}\n\n"}
    new = {}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        if i % 4:
            lines[draw.randrange(len(lines))] = f"changed {i}"
        if i % 3 == 0:
            lines.append("one more line at the end")
        new[f"new/f{i if i % 5 else i + 1}.py"] = "\n".join(lines)
    new |= {"new/same": "}\n\n}", "new/none": "x"}
    make = lambda d: spark.createDataFrame([("r", p, t) for p, t in d.items()] + [("r2", p, t) for p, t in list(d.items())[:6]] + [("r", "null" + p, None) for p in list(d)[:1]], "repo_id string, path string, content string")
    found = renames.match_one_to_one(renames.similar_files(make(gone), make(new), 0.5)).collect()
    assert {r.new: (r.old, r.similarity) for r in found if r.repo_id == "r"} == greedy(gone, new, 0.5)
    few = greedy(dict(list(gone.items())[:6]), dict(list(new.items())[:6]), 0.5)
    assert {r.new: (r.old, r.similarity) for r in found if r.repo_id == "r2"} == few


def test_diff_pairs_moved_and_changed_files(spark):
    body = "\n".join(f"line {i}" for i in range(20))
    make = lambda d: spark.createDataFrame([("r", p, t) for p, t in d.items()], "repo_id string, path string, content string").withColumn("blob", F.md5("content"))
    a = make({"src/a.py": body, "src/b.py": "x\n" + body, "keep": "1", "gone": "nothing like it", "same": "moved as it is"})
    b = make({"lib/a.py": body + "\nchanged", "keep": "2", "new": "something else", "other/same": "moved as it is"})
    found = rows(snapshots.diff_snapshots(a, b).select("file_path", "change_type", "old_path", F.round("similarity", 3)), "file_path")
    size = len(body) + 1
    assert found == [
        ("gone", "D", None, None), ("keep", "M", None, None), ("lib/a.py", "R", "src/a.py", round(size / (size + 8), 3)), ("new", "A", None, None),
        ("other/same", "R", "same", 1.0), ("src/b.py", "D", None, None),
    ]
    # Without contents only equal blobs are pairs.
    plain = rows(snapshots.diff_snapshots(a.drop("content"), b.drop("content")).select("file_path", "change_type"), "file_path")
    assert ("lib/a.py", "A") in plain and ("other/same", "R") in plain


def test_hot_lines_make_no_pairs(spark):
    """A license that all files share is in no prefix: candidates come from what is rare."""
    head = "\n".join(f"license {i}" for i in range(5))
    gone = {f"a{i}": head + "\n" + "\n".join(f"own {i} {k}" for k in range(30)) for i in range(60)}
    new = {f"b{i}": head + "\n" + "\n".join(f"own {i} {k}" for k in range(1, 30)) for i in range(60)}
    make = lambda d: spark.createDataFrame([("r", p, t) for p, t in d.items()], "repo_id string, path string, content string")
    pairs = renames.similar_files(make(gone), make(new), 0.5).collect()
    assert sorted((r.old, r.new) for r in pairs) == sorted((f"a{i}", f"b{i}") for i in range(60))
    assert re.match("a", pairs[0].old)
