"""Fixed values.

Every table in this file is a value the results depend on: change one and the numbers change. They are
plain lists and dicts in their natural order.
"""

from __future__ import annotations


# File extension -> language whose lines it counts for.
LANGUAGE_OF_EXTENSION: dict[str, str] = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".cs": "C#",
    ".php": "PHP",
    ".rb": "Ruby",
    ".go": "Go",
    ".rs": "Rust",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".html": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "Sass",
    ".less": "Less",
    ".vue": "Vue",
    ".jsx": "JSX",
    ".tsx": "TSX",
    ".md": "Markdown",
    ".yml": "YAML",
    ".yaml": "YAML",
    ".json": "JSON",
    ".xml": "XML",
    ".sql": "SQL",
    ".sh": "Shell",
    ".bash": "Bash",
    ".zsh": "Zsh",
    ".dockerfile": "Dockerfile",
    ".r": "R",
    ".m": "MATLAB",
    ".pl": "Perl",
}

# Language -> extensions of the files listed under it (not the inverse of the table above).
EXTENSIONS_OF_LANGUAGE: dict[str, list[str]] = {
    "Python": [".py", ".pyw", ".pyx", ".pyi"],
    "JavaScript": [".js", ".mjs", ".cjs"],
    "TypeScript": [".ts", ".tsx"],
    "Java": [".java"],
    "Go": [".go"],
    "Rust": [".rs"],
    "C": [".c", ".h"],
    "C++": [".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh"],
    "C#": [".cs"],
    "PHP": [".php", ".php3", ".php4", ".php5"],
    "Ruby": [".rb", ".rbw"],
    "Swift": [".swift"],
    "Kotlin": [".kt", ".kts"],
    "Scala": [".scala"],
    "Dart": [".dart"],
    "HTML": [".html", ".htm"],
    "CSS": [".css"],
    "SCSS": [".scss"],
    "Sass": [".sass"],
    "Vue": [".vue"],
    "React": [".jsx", ".tsx"],
    "Shell": [".sh", ".bash", ".zsh", ".fish"],
    "SQL": [".sql"],
    "YAML": [".yml", ".yaml"],
    "JSON": [".json"],
    "XML": [".xml"],
    "Markdown": [".md", ".markdown"],
}

# Path parts that take a file out of every count. Parts starting with a dot are out as well;
# the three starred entries are compared literally.
IGNORED_PARTS: list[str] = [
    ".git", "__pycache__", ".pyc", ".DS_Store",
    "node_modules", ".vscode", ".idea", ".vs",
    "*.log", "*.tmp", "*.cache",
]

# Suffixes whose content is never read.
SKIPPED_SUFFIXES: list[str] = [
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".bin",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".svg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv",
    ".db", ".sqlite", ".sqlite3",
]

# Words that put a file first among the samples of its language.
PRIORITY_WORDS: list[str] = ["main", "app", "index", "server", "run", "config", "settings", "models", "views", "routes", "controllers", "services"]

# Root files a description is taken from, best first.
README_NAMES: list[str] = ["README.md", "README.rst", "README.txt", "README"]

# Entry point names by language; entries with regex signs are regexes.
ENTRY_POINTS: dict[str, list[str]] = {
    "python": ["main.py", "__main__.py", "app.py", "server.py", "run.py", "manage.py", "wsgi.py", "asgi.py", "application.py"],
    "javascript": ["index.js", "main.js", "app.js", "server.js", "start.js", "index.mjs", "app.mjs", "server.mjs"],
    "typescript": ["index.ts", "main.ts", "app.ts", "server.ts", "start.ts", "index.tsx", "app.tsx"],
    "java": ["Main.java", "Application.java", "App.java", "Server.java", r".*Application\.java$", r".*Main\.java$"],
    "go": ["main.go"],
    "rust": ["main.rs", "lib.rs"],
    "c": ["main.c"],
    "cpp": ["main.cpp", "main.cxx"],
    "csharp": ["Program.cs", "Main.cs", "Application.cs"],
    "php": ["index.php", "app.php", "bootstrap.php"],
}

# Configuration file regexes.
CONFIG_PATTERNS: list[str] = [
    r"package\.json$", r"package-lock\.json$", r"yarn\.lock$",
    r"requirements.*\.txt$", "Pipfile$", r"pyproject\.toml$",
    r"pom\.xml$", r"build\.gradle$", r"Cargo\.toml$",
    r"composer\.json$", r"go\.mod$", "Gemfile$",
    r"\.env.*$", r"config\..*$", r"settings\..*$",
    r".*\.config\.(js|ts|json)$", r".*\.conf$", r".*\.ini$",
    r".*\.yaml$", r".*\.yml$", r".*\.toml$",
    "Dockerfile.*$", r"docker-compose.*\.(yml|yaml)$",
    "Makefile$", "makefile$", r"CMakeLists\.txt$",
    r"webpack\.config\..*$", r"vite\.config\..*$",
    r"rollup\.config\..*$", r"babel\.config\..*$",
    r"tsconfig\.json$", r"jsconfig\.json$",
    r"\.github/workflows/.*\.(yml|yaml)$",
    r"\.gitlab-ci\.yml$", r"\.travis\.yml$",
    "Jenkinsfile$", r"azure-pipelines\.yml$",
]

# Test file regexes.
TEST_PATTERNS: list[str] = [
    r"test_.*\.py$", r".*_test\.py$", r"conftest\.py$",
    r".*/tests/.*\.py$", r".*/test/.*\.py$",
    r".*\.test\.(js|ts|jsx|tsx)$", r".*\.spec\.(js|ts|jsx|tsx)$",
    r".*/tests/.*\.(js|ts|jsx|tsx)$", r".*/test/.*\.(js|ts|jsx|tsx)$",
    r".*/__tests__/.*\.(js|ts|jsx|tsx)$",
    r".*Test\.java$", r".*Tests\.java$", r".*IT\.java$",
    r".*/test/.*\.java$", r".*/tests/.*\.java$",
    r".*_test\.go$",
    r".*_test\.rs$", r".*/tests/.*\.rs$",
    r"test_.*\.(c|cpp|cxx)$", r".*_test\.(c|cpp|cxx)$",
    ".*/test.*$", ".*/spec.*$",
]

# Documentation file regexes.
DOC_PATTERNS: list[str] = [
    "README.*$", "CHANGELOG.*$", "HISTORY.*$",
    "LICENSE.*$", "COPYING.*$", "NOTICE.*$",
    "CONTRIBUTING.*$", "CODE_OF_CONDUCT.*$",
    r".*\.md$", r".*\.rst$", r".*\.txt$",
    ".*/docs/.*$", ".*/doc/.*$", ".*/documentation/.*$",
    r".*\.adoc$", r".*\.asciidoc$",
]

# Build script regexes.
BUILD_PATTERNS: list[str] = [
    "Makefile$", "makefile$", "Dockerfile.*$",
    r"build\.sh$", r"build\.bat$", r"install\.sh$",
    r"setup\.py$", r"setup\.cfg$", r"pyproject\.toml$",
    r"build\.gradle$", r"build\.xml$", r"CMakeLists\.txt$",
    r"webpack\..*$", r"gulpfile\..*$", r"gruntfile\..*$",
    r"rollup\..*$", r"vite\..*$",
]

# Asset regexes.
ASSET_PATTERNS: list[str] = [
    r".*\.(png|jpg|jpeg|gif|svg|ico|webp)$",
    r".*\.(css|scss|sass|less|styl)$",
    r".*\.(woff|woff2|ttf|eot)$",
    r".*\.(mp3|mp4|wav|avi|mov)$",
    r".*\.(pdf|doc|docx|xls|xlsx)$",
]

# Utility and helper file regexes.
UTILITY_PATTERNS: list[str] = [
    ".*/utils?/.*$", ".*/util/.*$", ".*/helpers?/.*$",
    ".*/helper/.*$", ".*/common/.*$", ".*/shared/.*$",
    ".*/lib/.*$", ".*/libs/.*$", ".*/library/.*$",
    r".*util.*\..*$", r".*helper.*\..*$", r".*common.*\..*$",
]

# Files (or directories, with a slash at the end) characteristic of a framework.
FRAMEWORK_FILES: dict[str, list[str]] = {
    "django": ["settings.py", "urls.py", "wsgi.py", "asgi.py", "models.py", "views.py", "admin.py", "forms.py"],
    "flask": ["app.py", "run.py", "config.py", "__init__.py"],
    "react": ["App.js", "App.tsx", "index.js", "index.tsx", "App.css", "index.css"],
    "vue": ["App.vue", "main.js", "main.ts", "index.html"],
    "angular": ["app.module.ts", "main.ts", "app.component.ts", "angular.json", "app.component.html"],
    "spring": ["Application.java", "Main.java", "application.properties", "application.yml", "pom.xml"],
    "express": ["app.js", "server.js", "index.js", "routes/", "middleware/", "controllers/"],
}

# The substring rules of the basic classification, first match wins.
# level, content type, reason, substrings of the lower-cased path
BASIC_RULES: list[tuple[str, str, str, list[str]]] = [
    ("CRITICAL", "Application entry point", "Entry point or main application file",
     ["main.", "index.", "app.", "__init__", "setup."]),
    ("HIGH", "Configuration file", "Configuration or dependency file",
     ["config", "settings", ".env", "package.json", "requirements", "pom.xml"]),
    ("HIGH", "Documentation", "Documentation file",
     ["readme", "license", "changelog"]),
    ("MEDIUM", "Test file", "Test file",
     ["test", "spec"]),
]
BASIC_DEFAULT: tuple[str, str, str] = ("MEDIUM", "General file", "Identified through pattern analysis")

# What marks a line of a free-text answer as naming a file, and a word as being one.
ANSWER_LINE_SUFFIXES: list[str] = [".py", ".js", ".ts", ".java", ".go", ".cpp", ".c", ".rb"]
ANSWER_WORD_SUFFIXES: list[str] = [".py", ".js", ".ts", ".java", ".go"]
ANSWER_LEVELS: list[str] = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# Work limits.
AUTHOR_COMMITS = 100
FREQUENCY_COMMITS = 200
FREQUENCY_THRESHOLD = 5
HISTORY_COMMITS = 50
RECENT_COMMITS = 10
DIGEST_COMMITS = 5
MAX_CONTENT_BYTES = 1024 * 1024
MAX_CONTENT_LINES = 2000
MEDIUM_FILES = 5
MEDIUM_CHARACTERS = 2000
BASIC_FILES = 15

# Sentences of the reports.
NO_LANGUAGES = "No programming languages detected."
BASIC_INSIGHTS = (
    "Basic pattern-based analysis completed",
    "For more accurate results, install CrewAI dependencies",
)
BASIC_RECOMMENDATIONS = (
    "Install CrewAI and SerperDev API key for AI-powered analysis",
    "Review pattern-based classifications manually",
    "Focus on CRITICAL and HIGH importance files first",
)
LANGUAGE_RECOMMENDATIONS: list[tuple[list[str], str]] = [
    (["python"], "Focus on documenting main modules, __init__.py files, and configuration files"),
    (["javascript", "typescript"], "Prioritize documenting index.js/ts, package.json, and main component files"),
    (["java"], "Document main classes, interfaces, and configuration files first"),
]
CONFIG_RECOMMENDATION = "Document configuration files to explain project setup and dependencies"
OVERVIEW_NOTES = (
    "",
    "## Notes",
    "This is a basic analysis generated from repository metadata and file structure.",
    "For detailed project analysis including dependencies, frameworks, and architecture,",
    "install CrewAI dependencies and configure API keys for enhanced analysis.",
)
FALLBACK_NOTE = (
    "*Note: This is a basic analysis. For detailed project overview, "
    "ensure CrewAI dependencies are properly installed.*"
)

# Texts of the reports, with the names of the values that go into them.
OVERVIEW_HEAD = """\
# Project Overview (Basic Analysis)

## Repository Information
**URL**: {url}
**Primary Language**: {primary_language}
**Total Files**: {total_files}
**Total Commits**: {total_commits}
**Contributors**: {authors_count}

## Languages Used"""
OVERVIEW_STRUCTURE = """
## Project Structure
### Directory Overview"""
OVERVIEW_CONTENTS = """
## File Analysis Summary
- **Total files analyzed**: {successful_reads}/{content_files}
- **Critical files**: {critical_files}
- **High importance files**: {high_files}
- **Medium importance files**: {medium_files}
- **Total lines analyzed**: {total_lines}

### Successfully Analyzed Files"""
FALLBACK_HEAD = """\
# Project Overview (Basic Analysis)

**Repository**: {url}
**Primary Language**: {primary_language}
**Languages**: {languages}
**Files Analyzed**: {successful_reads}/{content_files}

## File Analysis Summary
- Critical files: {critical_files}
- High importance files: {high_files}
- Medium importance files: {medium_files}

## Readable Files"""
CONTENT_SUMMARY_HEAD = """\
📄 File Content Summary
==================
Total files: {total_files}
Successfully read: {successful_reads}
Failed to read: {failed_reads}
Total lines: {total_lines}
Total size: {total_size} bytes

📊 By Importance Level:
  Critical: {critical_files} files
  High: {high_files} files
  Medium: {medium_files} files

📝 Readable Files:"""
SUMMARY_HEAD = """\
Primary Language: {primary_language}
Total Languages: {language_count}
Total Code Files: {code_files}

Language Breakdown:"""
SUMMARY_LANGUAGE = "- {language}: {share}% ({lines} lines, {files} files)"
SUMMARY_SAMPLES = """
  Sample files: {samples}"""
SEARCH_CONTEXT = """\
Repository: {url}
Primary Language: {primary_language}

{summary}
"""
READABLE_FILE = "  ✅ {path} ({level}, {lines} lines)"
UNREADABLE_FILE = "  ❌ {path} - {error}"
OVERVIEW_LANGUAGE = "- **{language}**: {lines} lines ({share}%)"
OVERVIEW_DIRECTORY = "- **{name}**: {files} files"
OVERVIEW_FILE = "- `{path}` ({level}) - {type}"
FALLBACK_FILE = "- {path} ({level})"
ROOT_TITLE = "Root directory:"
DIRECTORY_TITLE = "{dir}/:"
DIRECTORY_FILE = "  - {name}"
DIRECTORY_MORE = "  ... and {more} more files"
CARD_HEAD = """
============================================================
📊 REPOSITORY ANALYSIS
============================================================
📍 Repository URL: {url}
📁 Local Path: {path}
🌿 Current Branch: {branch}
📝 Total Commits: {commits}
🔄 Last Commit: {last}..."""
CARD_PEOPLE = "👥 Contributors ({count}): {authors}"
CARD_MORE_PEOPLE = "    ... and {more} more"
CARD_LANGUAGES = """
💻 Programming Languages:
{languages}"""
CARD_LANGUAGE = "    ('{language}', {lines})"
DIGEST_HEAD = """
{rank}. {hash} by {author}"""
DIGEST_TIME = "   📅 {time}"
DIGEST_MESSAGE = "   💬 {headline}"
DIGEST_FILE = "   📄 {files} file changed"
DIGEST_FILES = "   📄 {files} files changed"
DIGEST_LINES = "   ➕{added} ➖{deleted} lines"
INSIGHT_LANGUAGE = "Primary language is {language} with {share}% coverage"
INSIGHT_CRITICAL = "Identified {critical} critical files essential for understanding the project"
INSIGHT_HIGH = "Found {high} high-importance files containing key business logic"
INSIGHT_CONFIDENCE = "Average classification confidence: {share}%"
CRITICAL_RECOMMENDATION = "Start documentation with critical files: {paths}"
BASIC_IMPORTANT = "Identified {count} potentially important files"
BASIC_LANGUAGE = "Primary language: {language}"
REPORT_CONFIDENCE = "**Analysis Confidence**: {share}%"
REPORT_LEVEL = "## {level} Files"
REPORT_FILE = "### `{path}`"
REPORT_TYPE = "- **Type**: {type}"
REPORT_FILE_CONFIDENCE = "- **Confidence**: {share}%"
REPORT_REASONS = "- **Reasons**: {reasons}"
