"""One object over the tables of many repositories, for users who think in questions rather than operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed
from repoquarry.operators import answers, chunks, contents, dependencies, history, importance, languages, quality, search, snapshots, tree
from repoquarry.plans import profile, reports


class Repositories:
    """Questions about all repositories in the tables, or about one after `only(repo_id)`.

    `files(repo_id, path, content, size, blob)`, `commits(repo_id, commit_id, author, ts, message[, seq])`,
    `changes(repo_id, commit_id, file_path, change_type, old_path, lines_added, lines_deleted)` and, optionally,
    `repos(repo_id, url, local_path, branch)`. Every answer is a lazy DataFrame with `repo_id` as its first key.
    """

    def __init__(self, files: DataFrame, commits: DataFrame, changes: DataFrame, repos: DataFrame | None = None):
        self.files, self.commits, self.changes, self.repos = files, commits, changes, repos

    def only(self, repo_id: str) -> Repositories:
        """The same questions about one repository; the filter reaches the scans."""
        wanted = F.col("repo_id") == repo_id
        repos = None if self.repos is None else self.repos.filter(wanted)
        return Repositories(self.files.filter(wanted), self.commits.filter(wanted), self.changes.filter(wanted), repos)

    # Repository and history

    def repository_info(self) -> DataFrame:
        return profile.repository_info(self.files, self.commits, self.repos)

    def recent_commits(self, count: int = fixed.RECENT_COMMITS, since: datetime | str | None = None) -> DataFrame:
        """Newest commits with the number of changed files and lines."""
        recent = history.recent_commits(self.commits, count, since)
        return history.commit_rollup(recent, history.changes_of(self.changes, recent))

    def recent_commits_with_files(self, count: int = fixed.RECENT_COMMITS, since: datetime | str | None = None, page_size: int = 1000) -> DataFrame:
        """Newest commits, each with its changes `files_changed` in pages (one row for an ordinary commit) and its totals."""
        commits = self.recent_commits(count, since)
        listed = history.commit_files(history.changes_of(self.changes, commits), page_size)
        return commits.join(listed, ["repo_id", "commit_id"], "left")

    def changed_files(self, later_files: DataFrame) -> DataFrame:
        """Changes leading from the files held here to a later snapshot of them."""
        return snapshots.diff_snapshots(self.files, later_files)

    def file_history(self, file_path: str | None = None, max_commits: int = fixed.HISTORY_COMMITS) -> DataFrame:
        return history.file_history(self.commits, self.changes, file_path, max_commits)

    def file_history_with_files(self, file_path: str, max_commits: int = fixed.HISTORY_COMMITS, page_size: int = 1000) -> DataFrame:
        """The newest commits that touch the file, each with all its changes and totals."""
        commits = self.file_history(file_path, max_commits)
        changes = history.changes_of(self.changes, commits)
        return history.commit_rollup(commits, changes).join(history.commit_files(changes, page_size), ["repo_id", "commit_id"], "left")

    def frequently_changed_files(self, threshold: int = fixed.FREQUENCY_THRESHOLD) -> DataFrame:
        return history.change_frequency(self.commits, self.changes, threshold=threshold)

    def repository_structure(self) -> DataFrame:
        return tree.directory_index(self.files)

    # Languages

    def languages(self) -> DataFrame:
        return languages.languages(self.files)

    def top_languages(self, count: int = 5) -> DataFrame:
        return languages.top_languages(self.languages(), count)

    def language_summary(self) -> DataFrame:
        return reports.language_summary_text(self.profile())

    # Profiles, analyses, overviews

    def profile(self) -> DataFrame:
        return profile.repo_profile(self.files, self.commits, self.repos)

    def search_context(self) -> DataFrame:
        return reports.search_context(self.profile())

    def basic_important_files(self, count: int = fixed.BASIC_FILES) -> DataFrame:
        return importance.classify_basic(self.files, count)

    def basic_analysis(self, count: int = fixed.BASIC_FILES) -> DataFrame:
        return reports.analyze_basic(self.profile(), self.files, count)

    def analysis(self, important: DataFrame) -> DataFrame:
        """Insights, recommendations and confidence for parsed important files."""
        return reports.analysis_result(self.profile(), important)

    def read_important_files(self, important: DataFrame) -> DataFrame:
        return contents.read_contents(important, self.files)

    def overview(self, important: DataFrame) -> DataFrame:
        return reports.analyze_overview(self.profile(), important, self.files)

    def project_analysis(self, important: DataFrame) -> DataFrame:
        return reports.project_analysis(self.profile(), important, self.files)

    def repo_cards(self) -> DataFrame:
        return reports.repo_card(self.profile())

    def commit_digest(self, count: int = fixed.DIGEST_COMMITS) -> DataFrame:
        return reports.commit_digest(self.commits, self.changes, count)

    # Contents as prompts and texts

    def prompt_sections(self, important: DataFrame) -> DataFrame:
        return contents.prompt_sections(self.read_important_files(important))

    def content_summary(self, important: DataFrame) -> DataFrame:
        return reports.content_summary(self.read_important_files(important))

    def directory_text(self, directories: int = 10) -> DataFrame:
        return reports.directory_text(self.files, directories)

    def important_files(self, responses: DataFrame) -> DataFrame:
        """Model answers `(repo_id, response_id, text)` as important files of the tree; invented paths are left out."""
        return importance.existing_only(answers.parse_important_files(responses), self.files)

    # Search and chunks

    def chunks(self, size: int = 2000, overlap: int = 200) -> DataFrame:
        return chunks.chunk_text(self.files, size, overlap)

    def search(self, terms: list[str], count: int = 10) -> DataFrame:
        return search.search_docs(self.files, terms, count)

    # Dependencies

    def dependencies(self) -> DataFrame:
        return dependencies.dependency_manifest(self.files)

    def imports(self) -> DataFrame:
        return dependencies.import_edges(self.files)

    def impact_of(self, changed: DataFrame) -> DataFrame:
        """Files `(repo_id, path)` and everything that imports them, directly or not."""
        return dependencies.impact_from_code(changed, self.files)

    # Quality and trends

    def masked_files(self) -> DataFrame:
        return quality.mask_sensitive(self.files)

    def sensitive_findings(self) -> DataFrame:
        return quality.sensitive_findings(self.files)

    def documentation_coverage(self) -> DataFrame:
        return quality.doc_coverage(self.files)

    def test_share(self) -> DataFrame:
        return quality.test_share(self.files)

    def debt_markers(self) -> DataFrame:
        return quality.debt_markers(self.files)

    def health_trend(self, period: str = "month") -> DataFrame:
        """Changes over time; takes the time of a change from its commit if the changes carry none."""
        changes = self.changes
        if "ts" not in changes.columns:
            changes = changes.join(self.commits.select("repo_id", "commit_id", "ts"), ["repo_id", "commit_id"])
        return quality.health_trend(changes, period)
