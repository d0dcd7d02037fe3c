"""Path predicates of the scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory sets, extensions, markers and test names of the scans.
SEARCH_EXCLUDED_DIRS = [
    "node_modules", "dist", "build", "out", ".next", "venv", ".venv", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".git", ".hg", ".svn", ".idea", ".vscode",
]
INDEX_EXCLUDED_DIRS = [
    "__pycache__", ".git", ".svn", ".hg", "node_modules", "dist", "build", "out", "target",
    "venv", ".venv", "env", ".env", ".idea", ".vscode",
]
INVENTORY_EXCLUDED_DIRS = [
    "__pycache__", ".git", ".svn", ".hg", "node_modules", "dist", "build", "out", "target",
    "venv", ".venv", "env", ".env", ".idea", ".vscode",
    ".mypy_cache", ".pytest_cache",
]
AUDIT_IGNORED_DIRS = [
    ".git", ".svn", ".hg", ".idea", ".vscode", "node_modules", "venv", ".venv", "env", ".env",
    "dist", "build", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".next", "out", "proc", "run",
    "sys", "target", "tmp", "var/tmp", ".cache", "models", "latest_model", "storage", "logs",
]
TEST_DIRS = [
    "tests", "test", "__tests__", "fixtures", "testdata", "sample_repo", "test_rigs", "rigs", "fixture",
]
INVENTORY_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".java",
    ".go", ".rs", ".sh", ".bash", ".zsh",
]
MARKER_FILES = [
    "setup.py", "pyproject.toml", "requirements.txt", "package.json", "pom.xml", "build.gradle",
    "CMakeLists.txt", "Makefile",
]
GIT_DIR = ".git"
CODE_EXTENSIONS = [".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".hpp", ".sh"]
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp",
    ".cs": "csharp",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
MAX_FILE_BYTES = 10 * 1024 * 1024
MASSIVE_ROOT = r"^(/+|[A-Za-z]:[\\/]*)$"
SCRIPT_PATH = r"[/\\](scripts|bin)[/\\]"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """As ``splitext``: leading dots of a name start no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")


def has_part(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def is_script(path: Column) -> Column:
    """Needs a separator in front, so a relative path starting with scripts/ is none."""
    return F.lower(path).rlike(SCRIPT_PATH)


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return (
        has_part(low, TEST_DIRS)
        | basename(low).rlike(r"^test.*\.py$|_test\.py$")
        | F.contains(low, F.lit("fixture"))
    )


def production_skip_reason(path: Column, self_files: list[str] | None = None) -> Column:
    """Why the audit leaves a file out (the job's own files, tests, ignored paths), else null."""
    own = basename(path).isin(self_files) if self_files else F.lit(False)
    return (
        F.when(own, "self_file")
        .when(is_test_file(path), "test_file")
        .when(has_part(path, AUDIT_IGNORED_DIRS), "ignored_path")
    )


def is_massive_root(root: Column) -> Column:
    """A filesystem root or a bare drive, too broad to scan."""
    return F.regexp_replace(root, r"/\.(?=/|$)", "").rlike(MASSIVE_ROOT)


def scan_skip_reason(
    path: Column,
    length: Column,
    is_symlink: Column,
    extensions: list[str],
    excluded_dirs: list[str],
    max_bytes: int = MAX_FILE_BYTES,
    profile: str = "search",
) -> Column:
    """Why a listed file is not read, as one column.

    Profiles: ``search`` tests the suffix and skips links, ``index`` tests the last
    extension and reads links, ``inventory`` tests every part of the full path.
    """
    low = F.lower(path)
    wanted = [e.lower() if e.startswith(".") or profile == "search" else "." + e.lower() for e in extensions]
    if profile == "search":
        ext_ok = F.lit(False)
        for e in wanted:
            ext_ok = ext_ok | F.endswith(low, F.lit(e))
    else:
        ext_ok = extension(path).isin(wanted)
    within = path if profile == "inventory" else dirname(path)
    reason = F.when(has_part(within, excluded_dirs), "excluded_dir")
    if profile == "search":
        reason = reason.when(is_symlink, "symlink")
    return reason.when(~ext_ok, "extension").when(length > max_bytes, "too_big")
