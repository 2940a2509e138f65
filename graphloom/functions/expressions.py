"""Scalar expressions on names, kinds, labels and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of package names that mark a test project.
TEST_MARKERS = (
    "coverlet.collector",
    "microsoft.net.test.sdk",
    "mstest.testframework",
    "mstest.testadapter",
    "nunit",
    "nunit3testadapter",
    "xunit",
    "xunit.runner.visualstudio",
)
ROOT_GROUP = "(solution root)"
NO_FRAMEWORK = "(not specified)"


def is_true(value: Column) -> Column:
    """The text ``true`` in any case; null is false."""
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def project_kind(
    name: Column, sdk: Column, packages: Column, is_test: Column, use_wpf: Column, use_forms: Column, output_type: Column
) -> Column:
    """Test, web, desktop, app or library; the first that fits. All comparisons ignore case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    marked = F.exists(packages, lambda p: reduce(lambda a, b: a | b, [F.lower(p).contains(m) for m in TEST_MARKERS]))
    test = is_true(is_test) | F.coalesce(marked, F.lit(False)) | low.contains(".tests") | low.endswith("tests") | low.endswith("test")
    return (
        F.when(test, "test")
        .when(F.lower(F.coalesce(sdk, F.lit(""))).contains("web"), "web")
        .when(is_true(use_wpf) | is_true(use_forms), "desktop")
        .when(F.lower(F.coalesce(output_type, F.lit(""))).isin("exe", "winexe"), "app")
        .otherwise("library")
    )


def escape_label(text: Column) -> Column:
    """A label that flowchart text may hold."""
    # Fixed values, applied in this order.
    for old, new in (("\\", "/"), ("<", "&lt;"), (">", "&gt;"), ('"', "'"), ("#", "&#35;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def group_or_root(group: Column) -> Column:
    return F.when(F.trim(F.coalesce(group, F.lit(""))) == "", ROOT_GROUP).otherwise(group)


def target_framework(single: Column, several: Column) -> Column:
    """The single value unless null (an empty one counts), else the first non-empty one of a ``;`` list."""
    listed = F.filter(F.transform(F.split(several, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(single, F.get(listed, F.lit(0)), F.lit(NO_FRAMEWORK))


def static_using_namespace(name: Column) -> Column:
    """What stands before the last dot; null if that is nothing."""
    cut = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(cut != "", cut)


def cycle_text(nodes: Column) -> Column:
    """Members and once more the first, joined by arrows."""
    return F.when(F.size(nodes) == 0, "(empty)").otherwise(F.array_join(F.concat(nodes, F.slice(nodes, 1, 1)), " → "))


def cycle_label(scope: Column, length: Column, nodes: Column) -> Column:
    """Sidebar label of a cycle: not closed."""
    counted = F.when(length > 0, length).otherwise(F.size(nodes))
    return F.concat(scope, F.lit(": ("), counted.cast("string"), F.lit(") "), F.array_join(nodes, " → "))


def cycle_message(what: str, name: Column, nodes: Column) -> Column:
    return F.concat(F.lit(f"{what} '"), name, F.lit("' participates in a dependency cycle: "), cycle_text(nodes))


def export_file_name(solution: Column, granularity: str, extension: str) -> Column:
    """A safe file name for an export."""
    base = F.when(F.coalesce(solution, F.lit("")) == "", "dependency-map").otherwise(solution)
    return F.concat(F.regexp_replace(base, r"[^A-Za-z0-9_.-]+", "_"), F.lit(f"-{granularity}.{extension}"))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(leaf(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or nothing."""
    return F.lower(F.regexp_extract(leaf(path), r"(\.[^.]*)$", 1))


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` put on ``base`` unless it is absolute, with ``\\`` as ``/`` and dots resolved."""
    rel = F.replace(relative, F.lit("\\"), F.lit("/"))
    whole = F.when(rel.startswith("/"), rel).otherwise(F.concat_ws("/", base, rel))
    steps = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def path_key(path: Column, path_mode: str = "portable") -> Column:
    return F.lower(path) if path_mode == "windows" else path
