"""Imports of one file."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: import statements -------------------------------------------------------------
PYTHON_IMPORT = r"(?mdU)^\s*(?:from|import)\s+([\w.]+)"
SCRIPT_IMPORT = r"(?dU)import\s+.*?from\s+['\"]([^'\"]+)['\"]"
SCRIPT_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx")
# -------------------------------------------------------------------------------------------------


def extract_imports(content: Column, ext: Column) -> Column:
    """Distinct import names of a file as a sorted array; empty for other languages and unreadable text."""
    none = F.array().cast("array<string>")
    found = (
        F.when(ext == ".py", F.regexp_extract_all(content, F.lit(PYTHON_IMPORT), F.lit(1)))
        .when(ext.isin(*SCRIPT_EXTENSIONS), F.regexp_extract_all(content, F.lit(SCRIPT_IMPORT), F.lit(1)))
        .otherwise(none)
    )
    return F.sort_array(F.array_distinct(F.coalesce(found, none)))


def dependency_depth(imports: Column) -> Column:
    """Most dots in any import name, 0 without imports."""
    dots = F.transform(imports, lambda x: F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))))
    return F.coalesce(F.array_max(dots), F.lit(0))
