"""File intake: names, departments, versions, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspark.functions import text

#: Document kinds and file types that are taken, and the shape of a file name.
KINDS = {"QT": "Quy trình", "QD": "Quy định", "CS": "Chính sách", "HD": "Hướng dẫn", "BM": "Biểu mẫu", "BC": "Báo cáo", "KH": "Kế hoạch", "TL": "Tài liệu tham khảo"}
EXTENSIONS = ("pdf", "docx", "xlsx", "csv", "txt", "md")
SHAPE = r"^([A-ZĐ][A-ZĐ0-9_]*)-([A-Z]{2,10})-([0-9]{3})_([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)_V([1-9][0-9]*)\.([A-Za-z0-9]+)$"
CODE = r"^[A-Z][A-Z0-9_]{0,49}$"


def parse_name(name: Column, expected: Column) -> Column:
    """A struct of a file name's parts, with `error` null if all is well; the first failing check names it."""
    value = F.trim(F.coalesce(name, F.lit("")))
    groups = [F.regexp_extract(value, SHAPE, i).alias(f"g{i}") for i in range(1, 7)]
    parts = text.let(F.struct(value.alias("value"), *groups), lambda x: F.struct(x.alias("x"), text.department_code(x["g1"]).alias("department"), F.lower(x["g6"]).alias("extension")))
    return text.let(text.let(parts, lambda x: F.struct(x["x"].alias("x"), x["department"].alias("department"), x["extension"].alias("extension"), _error(x, expected).alias("error"))), _listed)


def _error(parts: Column, expected: Column) -> Column:
    """The first thing wrong with a file name; null if there is none."""
    group = lambda i: parts["x"][f"g{i}"]
    value, department, extension = parts["x"]["value"], parts["department"], parts["extension"]
    return (
        F.when((value == "") | F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\")), "INVALID_FILENAME")
        .when(group(1) == "", "INVALID_FILENAME_FORMAT")
        .when(~department.rlike(CODE), "UNKNOWN_DEPARTMENT")
        .when(expected.isNotNull() & (department != expected), "DEPARTMENT_MISMATCH")
        .when(~group(2).isin(*KINDS), "UNSUPPORTED_DOCUMENT_KIND")
        .when(group(3) == "000", "INVALID_SEQUENCE")
        .when(~extension.isin(*EXTENSIONS), "UNSUPPORTED_EXTENSION")
    )


def _listed(parts: Column) -> Column:
    group = lambda i: parts["x"][f"g{i}"]
    department, extension, error = parts["department"], parts["extension"], parts["error"]
    ok = lambda c: F.when(error.isNull(), c)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.struct(
        ok(department).alias("department"),
        ok(group(2)).alias("kind"),
        ok(F.try_element_at(kind, group(2))).alias("kind_name"),
        ok(F.concat_ws("-", department, group(2), group(3))).alias("document_code"),
        ok(group(4)).alias("slug"),
        ok(F.replace(group(4), F.lit("-"), F.lit(" "))).alias("title"),
        ok(group(5).cast("int")).alias("version"),
        ok(extension).alias("extension"),
        error.alias("error"),
    )


def department(folder: Column) -> Column:
    """A struct of a folder name's code and display name; null where no code can be made."""
    value = F.trim(F.coalesce(folder, F.lit("")))
    parts = F.split(value, r"\s*[-–—]\s*", 2)
    code = text.department_code(F.get(parts, F.lit(0)))
    name = text.present(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    return F.when(code.rlike(CODE), F.struct(code.alias("code"), name.alias("name")))


def decide_versions(new: DataFrame, done: DataFrame) -> DataFrame:
    """`new` with a decision or an error for each file, against the completed versions before any import.

    Both: source, document_code, version, slug, checksum. All new files are judged against the same state.
    """
    keys = ["source", "document_code"]
    same = done.groupBy(*keys, "version").agg(F.min("checksum").alias("old_checksum"), F.lit(True).alias("exists"))
    latest = done.groupBy(*keys).agg(F.max("version").alias("latest"), F.max_by("slug", F.struct("version", "slug")).alias("latest_slug"))
    rows = new.join(latest, keys, "left").join(same, [*keys, "version"], "left")
    newest, v = F.col("latest"), F.col("version")
    outcome = (
        F.when(newest.isNull() & (v == 1), "CREATE")
        .when(newest.isNull(), "INITIAL_VERSION_MUST_BE_ONE")
        .when(F.col("exists") & (F.col("old_checksum") == F.col("checksum")), "DUPLICATE")
        .when(F.col("exists"), "VERSION_CONTENT_CONFLICT")
        .when(v < newest, "OLDER_VERSION")
        .when(F.col("slug") != F.col("latest_slug"), "DOCUMENT_NAME_MISMATCH")
        .otherwise("NEW_VERSION")
    )
    return rows.withColumn("outcome", outcome).drop("latest", "latest_slug", "old_checksum", "exists")


def activate(versions: DataFrame) -> DataFrame:
    """`versions` with `active`: the highest completed version of each (source, document_code)."""
    order = Window.partitionBy("source", "document_code").orderBy(F.desc("version"), "file_id")
    return versions.withColumn("active", F.row_number().over(order) == 1)


def destination(status: Column) -> Column:
    """Where a file goes after its run."""
    return F.when(status.isin("completed", "skipped"), "DONE").when(status == "error", "ERROR")
