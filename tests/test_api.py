from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from repoquarry import Repositories
from repoquarry.operators import skew


def doubled(sample):
    """The sample under two ids, so that answers must keep them apart."""
    return [t.unionByName(t.withColumn("repo_id", F.lit("t"))) for t in sample]


def test_questions_about_many_and_one(spark, sample):
    both = Repositories(*doubled(sample))
    one = both.only("t")
    assert rows(both.profile().select("repo_id", "primary_language", "total_files", "total_commits", "authors_count"), "repo_id") == [
        ("s", "Python", 3, 2, 2), ("t", "Python", 3, 2, 2),
    ]
    info = one.repository_info().first()
    assert (info.last_commit, info.languages, info.authors) == ("c2", {"Python": 5, "Markdown": 3}, ["Ann", "Bob"])
    assert rows(one.recent_commits(1).select("repo_id", "commit_id", "file_count", "total_additions")) == [("t", "c2", 1, 2)]
    assert both.file_history("main.py").count() == 4 and one.file_history().count() == 4
    assert one.frequently_changed_files(2).count() == 1
    assert one.repository_structure().count() == 2
    assert one.top_languages(1).first().language == "Python"
    assert one.search_context().first().context.startswith("Repository: None\nPrimary Language: Python\n\nPrimary Language: Python\nTotal Languages: 2\n")
    assert one.basic_important_files().count() == 3 and one.basic_analysis().first().important_count == 3
    important = one.basic_important_files()
    whole = one.project_analysis(important).first()
    assert whole.important_count == 3 and whole.total_files_analyzed == 3 and whole.confidence_score == 0.6
    assert whole.recommendations[0] == "Start documentation with critical files: main.py"
    assert "📝 Total Commits: 2" in one.repo_cards().first().card
    assert [r.text.split("\n")[1] for r in one.commit_digest().orderBy("rank").collect()] == ["1. c2 by Bob", "2. c1 by Ann"]
    later = one.files.filter("path <> 'main.py'")
    assert rows(one.changed_files(later).select("file_path", "change_type")) == [("main.py", "D")]
    assert one.overview(important).first().analysis_status == "basic"
    assert one.analysis(important).first().insights[0] == "Primary language is Python with 62.5% coverage"


def test_spread_join_equals_plain_join(spark):
    large = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i) for i in range(600)], "k string, v bigint")
    small = spark.createDataFrame([("hot", "x"), ("k0", "y"), ("k0", "z")], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, spread = large.join(small, ["k"], how), skew.spread_join(large, small, ["k"], "v", how, rows_per_place=3)
        assert sorted(map(str, plain.collect())) == sorted(map(str, spread.select(plain.columns).collect()))
