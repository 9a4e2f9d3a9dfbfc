"""Authored files. A file frame has cell, rel and content (text or bytes)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension and by name, comment leaders, and what
# is never authored surface.
LANGUAGE_BY_EXTENSION = {
    ".py": "Python", ".tf": "HCL", ".hcl": "HCL", ".yaml": "YAML", ".yml": "YAML",
    ".json": "JSON", ".toml": "TOML", ".sh": "Shell", ".sql": "SQL",
    ".md": "Markdown", ".txt": "Text", ".dockerfile": "Dockerfile",
    ".tpl": "Template", ".env": "DotEnv", ".ini": "INI", ".cfg": "INI"}
LANGUAGE_BY_NAME = {"Dockerfile": "Dockerfile", "Makefile": "Makefile"}
COMMENT_LEADER = {
    "Python": "#", "YAML": "#", "TOML": "#", "Shell": "#", "HCL": "#", "Dockerfile": "#",
    "Makefile": "#", "INI": "#", "DotEnv": "#", "SQL": "--", "Template": "#"}
IGNORE_PARTS = ("__pycache__", "node_modules", ".venv", "venv", "env", ".terraform", ".git", ".pulumi",
                ".claude", ".mypy_cache", ".pytest_cache", ".ruff_cache")
IGNORE_SUFFIXES = (
    ".pyc", ".pyo", ".pyd", ".so", ".dylib", ".dll", ".a", ".o", ".class", ".jar", ".zip", ".tar", ".gz",
    ".tgz", ".bz2", ".xz", ".7z", ".rar", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".woff", ".woff2",
    ".log", ".pid", ".bin", ".exe", ".wasm")
IGNORE_NAMES = (".skeleton_manifest",)
SNIFF_BYTES = 8192
#: What tells whether a file has changed since it was measured.
SIGNATURE = ("cell", "rel", "mtime", "size")
RIG_OWNED = (".git", ".gitignore")
CACHE_DIRS = ("__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache")
SUPERVISOR_EVENTS = ("ALERT",)


def _lookup(x: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]


def base_name(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def suffix(rel: Column) -> Column:
    return F.regexp_extract(base_name(rel), r"[^/](\.[^./]+)$", 1)


def language(rel: Column) -> Column:
    """By whole name, else by extension, else the extension itself."""
    ext = suffix(rel)
    return F.coalesce(_lookup(base_name(rel), LANGUAGE_BY_NAME), _lookup(F.lower(ext), LANGUAGE_BY_EXTENSION),
                      F.when(ext != "", ext), F.lit("other"))


def line_count(content: Column) -> Column:
    parts = F.size(F.split(content, "\n"))
    return F.when(content == "", 0).otherwise(parts - F.endswith(content, F.lit("\n")).cast("int")).cast("long")


def source_lines(content: Column, lang: Column) -> Column:
    """Non-blank lines that are not whole-line comments of the language."""
    leader = F.coalesce(_lookup(lang, COMMENT_LEADER), F.lit(""))
    counts = lambda line: (F.ltrim(F.translate(line, "\t\r\f", "   ")) != "") & ~(
        (leader != "") & F.startswith(F.ltrim(F.translate(line, "\t\r\f", "   ")), leader))
    return F.size(F.filter(F.split(content, "\n"), counts)).cast("long")


def is_binary(content: Column) -> Column:
    """Whether the first SNIFF_BYTES hold a zero byte or are no valid UTF-8, as
    when their end splits a character; true for missing content."""
    head = F.substring(content.cast("binary"), 1, SNIFF_BYTES)
    bad = F.contains(head, F.lit(bytearray(b"\x00"))) | ~F.is_valid_utf8(head.cast("string"))
    return F.coalesce(bad, F.lit(True))


def path_counts(rel: Column) -> Column:
    """The part of the test that needs no content."""
    parts = F.split(rel, "/")
    return (~base_name(rel).isin(*IGNORE_NAMES) & ~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in IGNORE_PARTS]))
            & ~F.lower(suffix(rel)).isin(*IGNORE_SUFFIXES))


def countable(files: DataFrame) -> DataFrame:
    """The files that count; the path decides before any content is read."""
    return files.where(path_counts(F.col("rel"))).where(~is_binary(F.col("content")))


def per_file(files: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Language, lines, source lines and whether the file is authored: absent
    from the ``skeleton`` (cell, rel, sha) or different from it."""
    text = F.col("content").cast("string")
    lang = language(F.col("rel"))
    rows = countable(files).select("cell", "rel", lang.alias("language"), line_count(text).alias("lines"),
                                   source_lines(text, lang).alias("sloc"), F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    return _authored(rows, skeleton)


def _authored(rows: DataFrame, skeleton: DataFrame) -> DataFrame:
    seeded = skeleton.select("cell", "rel", F.col("sha").alias("_sha"))
    return (rows.join(seeded, ["cell", "rel"], "left")
            .withColumn("authored", ~F.coalesce(F.col("sha") == F.col("_sha"), F.lit(False))).drop("_sha"))


def measured(files: DataFrame) -> DataFrame:
    """What a cache keeps of each file: its columns but the content, ``skip`` where the
    file does not count, and else what is measured, null where it is skipped."""
    text, lang = F.col("content").cast("string"), language(F.col("rel"))
    skip = ~path_counts(F.col("rel")) | is_binary(F.col("content"))
    rest = [c for c in files.columns if c != "content"]
    unless = lambda c: F.when(~F.col("skip"), c)
    return files.withColumn("skip", skip).select(
        *rest, "skip", unless(lang).alias("language"), unless(line_count(text)).alias("lines"),
        unless(source_lines(text, lang)).alias("sloc"), unless(F.sha2(F.col("content").cast("binary"), 256)).alias("sha"))


def refreshed(now: DataFrame, cached: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache of ``measured`` brought up to date. ``now`` lists the files (SIGNATURE
    and what ``read`` needs), ``read`` adds the content to rows of it. A file with the time and
    size that ``cached`` holds keeps its row and is not read; others are read and
    measured; files that are gone, or that go before they are read, have no row."""
    names = [*SIGNATURE, "skip", "language", "lines", "sloc", "sha"]
    held = cached.select(*SIGNATURE, F.struct(*names[len(SIGNATURE):]).alias("_held"))
    found = now.join(held, list(SIGNATURE), "left")  # both parts start from its shuffles
    kept = found.where("_held IS NOT NULL").select(*SIGNATURE, "_held.*")
    return kept.unionByName(measured(read(found.where("_held IS NULL").drop("_held"))).select(*names))


def with_authored(cached: DataFrame, skeleton: DataFrame) -> DataFrame:
    """``per_file`` out of a cache; the ``skeleton`` may change without the files."""
    rows = cached.where(~F.col("skip")).select("cell", "rel", "language", "lines", "sloc", "sha")
    return _authored(rows, skeleton)


def author_surface(rows: DataFrame) -> DataFrame:
    """Per cell: files, languages, lines and source lines, authored and in
    all. Languages are reduced first, so no list grows with the files."""
    by_language = rows.groupBy("cell", "language").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("authored").alias("a"), F.sum("lines").alias("l"),
        F.sum(F.when(F.col("authored"), F.col("lines"))).alias("al"), F.sum(F.when(F.col("authored"), F.col("sloc"))).alias("asl"))
    mine = F.when(F.col("a") > 0, F.col("language"))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_language.groupBy("cell").agg(
        z("a").alias("files"), names(mine).alias("languages"), F.count(mine).alias("language_count"),
        z("al").alias("lines"), z("asl").alias("sloc"), z("n").alias("total_files"), names("language").alias("total_languages"),
        F.count(F.lit(1)).alias("total_language_count"), z("l").alias("total_lines"))


def fingerprint(files: DataFrame, tree: str = "tree") -> DataFrame:
    """sha256 over the ordered ``sha  path`` text of each tree.

    The rows of a tree are sorted, which spills, and read one after another into a
    running digest, so a tree of any number of files takes the memory of one batch.
    The digest itself is sequential: one tree is one task."""
    kind = files.schema[tree].dataType.simpleString()
    rows = files.select(F.col(tree).alias("tree"), "rel", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))

    def digests(batches):
        now, n, digest, of = None, 0, None, None
        for batch in batches:
            done, of = [], batch.schema.field(0).type
            for name, rel, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n == 0 or name != now:
                    if n:
                        done.append((now, n, digest.hexdigest()))
                    now, n, digest = name, 0, hashlib.sha256()
                n += 1
                digest.update(f"{sha}  {rel}\n".encode())
            yield told(done, of)
        if n:
            yield told([(now, n, digest.hexdigest())], of)

    def told(done, of):
        names, counts, found = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(names, of), pa.array(counts, pa.int64()), pa.array(found, pa.string())], ["tree", "files", "fingerprint"])

    out = rows.repartition("tree").sortWithinPartitions("tree", "rel").mapInArrow(digests, f"tree {kind}, files long, fingerprint string")
    return out.withColumnRenamed("tree", tree)


def tree_diff(skeleton: DataFrame, tree: DataFrame, exact: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """What lies outside the authorable surface: fixed files deleted or
    modified, and files that were never seeded. ``tree`` has cell, rel, sha."""
    rel = F.col("rel")
    may = rel.isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        may = may | F.startswith(rel, F.lit(p))
    parts = F.split(rel, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ignored = (parts[0].isin(*RIG_OWNED) | F.endswith(rel, F.lit(".pyc"))
               | F.arrays_overlap(dirs, F.array(*[F.lit(c) for c in CACHE_DIRS])))
    s = skeleton.select("cell", "rel", F.col("sha").alias("old"), F.lit(True).alias("seeded"))
    t = tree.select("cell", "rel", F.col("sha").alias("new"), F.lit(True).alias("present"))
    j = s.join(t, ["cell", "rel"], "full_outer").where(~may)
    what = (F.when(F.col("seeded") & F.col("present").isNull(), "deleted").when(F.col("seeded") & (F.col("old") != F.col("new")), "modified")
            .when(F.col("seeded").isNull() & ~ignored, "outside surface"))
    return j.select("cell", "rel", what.alias("change")).where("change IS NOT NULL")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of a record whose signature changed, appeared or vanished. Both
    sides have cell, key, sig."""
    j = before.withColumnRenamed("sig", "old").join(after.withColumnRenamed("sig", "new"), ["cell", "key"], "full_outer")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select("cell", "key")


def ledger_moved(old: Column, new: Column) -> Column:
    """A ledger text changed other than by whole supervisor lines at its end."""
    grown = F.coalesce(F.startswith(new, old), F.lit(False))
    added = F.filter(F.split(F.substr(new, F.length(old) + 1), "\n"), lambda l: l != "")
    foreign = F.exists(added, lambda l: ~F.coalesce(F.try_element_at(F.split(l, "\t"), F.lit(2)).isin(*SUPERVISOR_EVENTS), F.lit(False)))
    return ~old.eqNullSafe(new) & (~grown | foreign)
