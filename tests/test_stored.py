"""Stored indexes, cells of vectors, totals by differences, trees as a data source, tokens and manifests."""

from __future__ import annotations

import glob
import math
import os
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repoquarry.operators import cells, chunks, dependencies, quality, retractions, search, secrets, snapshots, stored_index
from repoquarry.sources import tree_source


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(200)]
    docs = [(f"r{i % 3}", f"p{i}", " ".join(draw.choices(words, k=draw.randrange(1, 80)))) for i in range(600)]
    docs += [("r0", "empty", ""), ("r0", "null", None), ("r1", "marks", "... !"), ("r9", "only", "W1, w1")]
    return docs, spark.createDataFrame(docs, "repo_id string, path string, content string").repartition(5)


@pytest.mark.parametrize("block,heads", [(4, 1), (128, 2)])
def test_stored_index_equals_scan(spark, texts, tmp_path, block, heads):
    _, docs = texts
    place = str(tmp_path / "index")
    stored_index.store_index(docs, place, block)
    for terms in (["w1", "w2", "W5"], ["w3"], ["w1", "nowhere"], ["nowhere"]):
        want = rows(search.search_docs(docs, terms, 7), "repo_id", "rank")
        assert rows(stored_index.search_index(spark, place, terms, 7, heads), "repo_id", "rank") == want
    assert rows(stored_index.search_index(spark, place, ["w1"], 10_000), "repo_id", "rank") == rows(search.search_docs(docs, ["w1"], 10_000), "repo_id", "rank")


def test_index_of_slices_equals_scan(spark, texts, tmp_path):
    place = str(tmp_path / "index")
    stored_index.store_index(texts[1], place, 16, rows_per_group=60)
    want = rows(search.search_docs(texts[1], ["w1", "w2"], 7), "repo_id", "rank")
    assert rows(stored_index.search_index(spark, place, ["w1", "w2"], 7), "repo_id", "rank") == want
    # Postings and sizes are all that stays on the disk.
    assert sorted(os.listdir(place)) == ["postings", "sizes"] and not glob.glob(f"{place}/postings/bucket=-1")


def test_only_wanted_buckets_are_read(spark, texts, tmp_path):
    place = str(tmp_path / "index")
    stored_index.store_index(texts[1], place)
    plan = stored_index._blocks(spark, place, ["w1", "w2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {f.split("bucket=")[1].split("/")[0] for f in stored_index._blocks(spark, place, ["w1", "w2"]).inputFiles()}
    assert len(files) <= len(glob.glob(f"{place}/postings/bucket=*"))
    read = stored_index._blocks(spark, place, ["w1", "w2"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in read}) <= 2


@pytest.mark.parametrize("phrase", ["w1 w2", "w1 w1", "w1 w1 w1", "W1 w3 w1", "w5", "none here"])
def test_phrases(spark, texts, tmp_path, phrase):
    data, docs = texts
    place = str(tmp_path / "index")
    stored_index.store_index(docs, place, 16)
    wanted = phrase.lower().split()
    found = {}
    for repo, path, text in data:
        words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
        n = sum(words[i : i + len(wanted)] == wanted for i in range(len(words)))
        if n:
            found.setdefault(repo, []).append((-n, path))
    want = [(repo, rank, path, -n) for repo, hits in sorted(found.items()) for rank, (n, path) in enumerate(sorted(hits)[:10], 1)]
    assert rows(stored_index.search_phrase(spark, place, phrase).select("repo_id", "rank", "path", "occurrences"), "repo_id", "rank") == want


def test_cells_equal_scan_and_open_few(spark):
    draw = random.Random(9)
    centers = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = [(f"r{i % 2}", i, [x + draw.gauss(0, 0.05) for x in centers[i % 12]]) for i in range(900)]
    vectors += [("r0", 1000 + i, list(vectors[0][2])) for i in range(20)] + [("r0", 2000, [0.0] * 8), ("r1", 2001, None), ("r7", 2002, [1.0] * 8)]
    stored = spark.createDataFrame(vectors, "repo_id string, chunk_id int, vector array<double>").repartition(4)
    asked = [(r, f"q{i}", [x + draw.gauss(0, 0.02) for x in centers[i % 12]]) for i in range(24) for r in ("r0", "r1")] + [("r7", "lonely", [1.0] + [0.0] * 7), ("r0", "zero", [0.0] * 8), ("r8", "nobody", [1.0] * 8)]
    queries = spark.createDataFrame(asked, "repo_id string, query_id string, vector array<double>")
    want = rows(chunks.top_k_similar(stored, queries, 5), "repo_id", "query_id", "rank")
    got, visited = cells.top_k_in_cells(queries, *cells.cell_index(stored, 16), 5)
    assert rows(got.select("repo_id", "query_id", "rank", "chunk_id", "similarity"), "repo_id", "query_id", "rank") == [
        (r.repo_id, r.query_id, r["rank"], r.chunk_id, r.similarity) for r in chunks.top_k_similar(stored, queries, 5).orderBy("repo_id", "query_id", "rank").collect()
    ]
    assert want
    opened = visited.filter("repo_id in ('r0', 'r1')").agg(F.avg(F.col("opened") / F.col("cells"))).first()[0]
    assert opened < 0.5


def test_totals_by_differences_after_three_snapshots(spark):
    draw = random.Random(2)
    names = [f"{d}f{i}.{e}" for d in ("", "src/", ".hidden/") for i in range(12) for e in ("py", "md", "bin", "go")]

    def snapshot():
        data = [(f"r{k}", n, "\n".join(draw.choice("abc") for _ in range(draw.randrange(1, 9)))) for k in range(3) for n in names if draw.random() < 0.6]
        return spark.createDataFrame(data, "repo_id string, path string, content string").withColumns({"blob": F.md5("content"), "size": F.length("content")})

    earlier = snapshot()
    stats = snapshots.file_stats(earlier)
    totals = retractions.language_totals(stats)
    for _ in range(3):
        later = snapshot()
        gone, fresh = retractions.changed_stats(stats, snapshots.diff_snapshots(earlier, later), later)
        totals, stats, earlier = retractions.retract(totals, gone, fresh), retractions.next_stats(stats, gone, fresh), later
        whole = retractions.language_totals(snapshots.file_stats(later))
        assert rows(totals, "repo_id", "language") == rows(whole, "repo_id", "language")
        assert rows(stats.select("repo_id", "path", "blob"), "repo_id", "path") == rows(later.select("repo_id", "path", "blob"), "repo_id", "path")
        totals = spark.createDataFrame(totals.collect(), totals.schema)
        stats = spark.createDataFrame(stats.collect(), stats.schema)
    profile = retractions.totals_profile(totals).filter("repo_id = 'r0'").first()
    assert profile.total_files == whole.filter("repo_id = 'r0'").agg(F.sum("files")).first()[0]
    assert profile.primary_language == profile.languages[0].language


def test_tree_source(spark, tmp_path):
    made = {"a/README.md": "# T", "a/src/__init__.py": "", "a/src/deep/er/_x.py": "é\n", "a/.git/config": "x", "a/node_modules/z.js": "1", "b/.env": "s", "b/m.go": "package m", "b/src/a b.py": "1"}
    files = spark.createDataFrame([(p.split("/", 1)[0], p.split("/", 1)[1], c) for p, c in made.items()] + [("b", "nothing", None)], "repo_id string, path string, content string")
    root = str(tmp_path / "trees")
    tree_source.write_trees(files.repartition(3), root)
    (tmp_path / "trees" / "b" / "bad.py").write_bytes(b"x\xff")
    got = {(r.repo_id, r.path): (r.content, r.size) for r in tree_source.read_trees(spark, root).collect()}
    shown = {k: v for k, v in made.items() if "/." not in f"/{k}" and "node_modules" not in k}
    assert got == {tuple(k.split("/", 1)): (v, len(v.encode())) for k, v in shown.items()} | {("b", "bad.py"): ("x�", 2)}
    every = tree_source.read_trees(spark, root, ignored="true", levels="0")
    assert {(r.repo_id, r.path) for r in every.select("repo_id", "path").collect()} == {tuple(k.split("/", 1)) for k in made} | {("b", "bad.py")}
    assert {r.content for r in tree_source.read_trees(spark, root, contents="false").collect()} == {None}
    one = tree_source.read_trees(spark, root).filter("repo_id = 'a' and startswith(path, 'src/')")
    assert {r.path for r in one.collect()} == {"src/__init__.py", "src/deep/er/_x.py"}
    with pytest.raises(Exception, match="not a path inside"):
        tree_source.write_trees(spark.createDataFrame([("a", "../out", "x")], "repo_id string, path string, content string"), root)
    assert not os.path.exists(os.path.join(root, "out"))


def test_tree_source_lists_only_what_filters_ask(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    for path in ("a/src/x/f.py", "a/docs/g.md", "b/src/h.py", "c/i.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("1")
    reader = tree_source.TreeReader({"path": str(tmp_path), "levels": "1"})
    left = list(reader.pushFilters([In(("repo_id",), ("a", "c")), StringStartsWith(("path",), "src/"), GreaterThan(("size",), 0)]))
    assert left == [GreaterThan(("size",), 0)]
    parts = reader.partitions()
    assert {(p.repo_id, p.path, p.deep) for p in parts} == {("a", "", False), ("a", "src", True), ("c", "", False)}
    assert [r for p in parts for b in reader.read(p) for r in b.column("path").to_pylist()] == ["src/x/f.py"]
    assert list(reader.pushFilters([EqualTo(("repo_id",), "b")])) == [] and reader.partitions() == []


def _one(spark, text):
    return spark.createDataFrame([("r", "p", text)], "repo_id string, path string, content string")


def test_entropy_and_checks(spark):
    draw = random.Random(4)
    tokens = ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(20)] + ["a" * 40, "ab" * 20]
    bits = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
    frame = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.entropy(F.col("t")).alias("bits"))
    assert all(abs(r.bits - bits(r.t)) < 1e-9 for r in frame.collect())

    def luhn(digits):
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0 and set(digits) != {"0"}

    numbers = ["".join(draw.choices("0123456789", k=draw.randrange(12, 20))) for _ in range(300)] + ["0" * 16, "4111111111111111", "4111 1111 1111 1111"]
    frame = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", secrets.luhn(F.col("t")).alias("ok"))
    assert all(r.ok == luhn(r.t.replace(" ", "")) for r in frame.collect())
    accounts = {"DE89370400440532013000": True, "GB82 WEST 1234 5698 7654 32": True, "GB82WEST12345698765433": False, "FR1420041010050500013M02606": True, "XX": False}
    frame = spark.createDataFrame([(t,) for t in accounts], "t string").select("t", secrets.account_check(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in frame.collect()} == accounts


def test_secret_tokens_have_places(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    text = f"é 4111 1111 1111 1111 and 4111 1111 1111 1112\nk={key}; d41d8cd98f00b204e9800998ecf8427e"
    found = rows(secrets.secret_tokens(_one(spark, text)).select("kind", "position", "token"), "position")
    assert ("card_number", 3, "4111 1111 1111 1111") in found and ("random_hex", text.index("d41d") + 1, "d41d8cd98f00b204e9800998ecf8427e") in found
    assert ("random_text", text.index(key) + 1, key) in found and len(found) == 3
    assert secrets.secret_tokens(_one(spark, None)).collect() == [] and secrets.secret_tokens(_one(spark, "plain words only")).collect() == []


@pytest.mark.parametrize(
    "text,masked",
    [
        ("Authorization: Bearer abcdefghij.KLMNOP_q", "Authorization: [AUTHORIZATION]"),
        ("https://u:s3cretpw@host/x", "[URL_PASSWORD]host/x"),
        ("github_pat_11AAAAAAA0bcdefghijklmnop", "[TOKEN]"),
        ("v1.2.3.4.5 and 10.0.0.1, 10.0.0.2.", "v1.2.3.4.5 and [IPV4], [IPV4]."),
        ('{"password": "hunter22"}', "{[ASSIGNED_SECRET]}"),
        ("password = 'hunter 22'; x", "[ASSIGNED_SECRET]; x"),
        ("API_KEY=abcdef123 next", "[ASSIGNED_SECRET] next"),
        ("https://host/a:b@c", "https://host/a:b@c"),
        ("bearer of news", "bearer of news"),
    ],
)
def test_masking(spark, text, masked):
    assert quality.mask_sensitive(_one(spark, text)).first().content == masked


MANIFESTS = [
    ("a/App.csproj", '<Project><ItemGroup><PackageReference Include="N.Json" Version="13.0.1" /><PackageReference Include="X"><Version>2.0</Version></PackageReference></ItemGroup></Project>', "dotnet", {("N.Json", "13.0.1"), ("X", "2.0")}),
    ("Cargo.toml", "[target.'cfg(unix)'.dependencies]\nlibc = \"0.2\"\n[target.x86.dependencies.tokio]\nversion = \"1\"\n", "rust", {("libc", "0.2"), ("tokio", "1")}),
    ("setup.py", "setup(install_requires=['a>=1', \"b[x]==2\"],\n tests_require=['c'])", "python", {("a", ">=1"), ("b", "==2"), ("c", None)}),
    ("pom.xml", "<project><properties><v.j> 5.1 </v.j></properties><dependency><groupId>g</groupId><artifactId>j</artifactId><version>${v.j}</version></dependency><dependency><groupId>g</groupId><artifactId>k</artifactId><version>${other}</version></dependency></project>", "java", {("g:j", "5.1"), ("g:k", "${other}")}),
]


@pytest.mark.parametrize("path,content,ecosystem,entries", MANIFESTS)
def test_manifests(spark, path, content, ecosystem, entries):
    found = dependencies.dependency_manifest(spark.createDataFrame([("r", path, content)], "repo_id string, path string, content string")).collect()
    assert {(r.package, r.version) for r in found} == entries and {r.ecosystem for r in found} == {ecosystem}


def test_old_lock_file_and_broken_ones(spark):
    files = spark.createDataFrame(
        [("r", "package-lock.json", '{"dependencies": {"a": {"version": "1", "dev": true}}}'), ("r", "x/package-lock.json", "{broken"), ("r", "Pipfile.lock", "[]"), ("r", "composer.lock", None)],
        "repo_id string, path string, content string",
    )
    assert rows(dependencies.locked_dependencies(files).select("path", "package", "version")) == [("package-lock.json", "a", "1")]


def test_recursive_chunks_keep_the_text(spark):
    draw = random.Random(12)
    texts = ["", "short", "a" * 95, "p1 line\n\n" + "word " * 30 + "\n\nend"]
    texts += ["".join(draw.choice(["x", "yy ", "é\n", "zzzz", "\n\n", "w" * 25]) for _ in range(draw.randrange(1, 200))) for _ in range(60)]
    files = spark.createDataFrame([("r", f"p{i}.py", t) for i, t in enumerate(texts)] + [("r", "null", None)], "repo_id string, path string, content string")
    found = {}
    for r in chunks.split_recursive(files, size=20).orderBy("path", "chunk_no").collect():
        assert 0 < len(r.chunk) <= 20 and r.start == 1 + sum(map(len, found.get(r.path, []))) and r.chunk_no == len(found.get(r.path, []))
        found.setdefault(r.path, []).append(r.chunk)
    assert {p: "".join(c) for p, c in found.items()} == {f"p{i}.py": t for i, t in enumerate(texts) if t}
    # A line that fits a chunk is never cut.
    for i, text in enumerate(texts):
        ends = {sum(map(len, found.get(f"p{i}.py", [])[:k])) for k in range(1, len(found.get(f"p{i}.py", [])))}
        at = 0
        for line in text.split("\n"):
            assert len(line) >= 20 or not any(at < e < at + len(line) for e in ends)
            at += len(line) + 1
