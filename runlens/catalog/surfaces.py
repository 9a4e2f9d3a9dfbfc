"""Authored files, tree and record diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import FILES
from runlens.operators import surface
from runlens.sources import lines, tables

_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_case = lambda x, t: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"
SURF = FILES + f""",
fx AS (SELECT *, string_split(rel, '/')[-1] AS nm, regexp_extract(string_split(rel, '/')[-1], '[^/](\\.[^./]+)$', 1) AS sx FROM files),
fl AS (SELECT *, coalesce({_case('nm', surface.LANGUAGE_BY_NAME)}, {_case('lower(sx)', surface.LANGUAGE_BY_EXTENSION)}, nullif(sx, ''), 'other') AS language,
    nm NOT IN {_in(surface.IGNORE_NAMES)} AND NOT list_has_any(string_split(rel, '/'), {list(surface.IGNORE_PARTS)})
      AND lower(sx) NOT IN {_in(surface.IGNORE_SUFFIXES)} AS path_ok,
    octet_length(encode(content)) > 8192 AND substr(hex(encode(content)), 16385, 1) IN ('8', '9', 'A', 'B') OR contains(substr(content, 1, 8192), chr(0)) AS bin FROM fx),
fc AS (SELECT *, coalesce({_case('language', surface.COMMENT_LEADER)}, '') AS ld, string_split(content, chr(10)) AS ls FROM fl),
pf0 AS (SELECT cell, doc_id, rel, language, CAST(CASE WHEN content = '' THEN 0 ELSE len(ls) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS lines,
    CAST(len(list_filter(ls, lambda l: trim(translate(l, chr(9) || chr(13) || chr(12), '   ')) <> '' AND NOT (ld <> '' AND starts_with(ltrim(translate(l, chr(9) || chr(13) || chr(12), '   ')), ld)))) AS BIGINT) AS sloc,
    sha256(content) AS sha FROM fc WHERE path_ok AND NOT bin),
skel AS (SELECT cell, rel, CASE WHEN doc_id % 4 = 0 THEN sha256(content) ELSE sha256('seed ' || content) END AS sha FROM files WHERE doc_id % 4 < 2),
pf AS (SELECT pf0.cell, pf0.rel, language, lines, sloc, pf0.sha, NOT coalesce(pf0.sha = skel.sha, false) AS authored FROM pf0 LEFT JOIN skel USING (cell, rel))"""


def skeleton(spark, sf):
    """Every fourth file as seeded, the next one seeded differently."""
    d = F.col("doc_id") % 4
    return tables.files(spark, sf).where(d < 2).select(
        "cell", "rel", F.sha2(F.when(d == 0, F.col("content")).otherwise(F.concat(F.lit("seed "), "content")), 256).alias("sha"))


@query("files_measured", with_ctes(SURF, "SELECT * FROM pf"))
def files_measured(spark, sf):
    return surface.per_file(tables.files(spark, sf), skeleton(spark, sf))


@query("author_surface", with_ctes(SURF, """SELECT cell, count(*) FILTER (authored) AS files,
    coalesce(array_to_string(list_sort(list(DISTINCT language) FILTER (authored)), ','), '') AS languages, count(DISTINCT language) FILTER (authored) AS language_count,
    CAST(coalesce(sum(lines) FILTER (authored), 0) AS BIGINT) AS lines, CAST(coalesce(sum(sloc) FILTER (authored), 0) AS BIGINT) AS sloc,
    count(*) AS total_files, array_to_string(list_sort(list(DISTINCT language)), ',') AS total_languages, count(DISTINCT language) AS total_language_count,
    CAST(sum(lines) AS BIGINT) AS total_lines FROM pf GROUP BY cell"""))
def author_surface(spark, sf):
    return surface.author_surface(surface.per_file(tables.files(spark, sf), skeleton(spark, sf)))


@query("refreshed_surface", with_ctes(SURF, """SELECT f.cell, f.rel, f.doc_id AS mtime, CAST(octet_length(encode(f.content)) AS BIGINT) AS size, pf.rel IS NULL AS skip, pf.language,
    pf.lines + CASE WHEN f.doc_id % 4 <> 0 AND f.doc_id % 6 = 2 THEN 1000 ELSE 0 END AS lines, pf.sloc, pf.sha
    FROM files f LEFT JOIN pf ON f.cell = pf.cell AND f.rel = pf.rel"""))
def refreshed_surface(spark, sf):
    """The cache lacks every fourth file and has older times for another sixth; where
    its times hold its figures are taken as they are, which 1,000 lines more tell."""
    f = tables.files(spark, sf).select("cell", "rel", F.col("doc_id").alias("mtime"), F.octet_length("content").cast("long").alias("size"), "content")
    d = F.col("mtime")
    old = surface.measured(f.where(d % 4 != 0)).withColumn("lines", F.when(d % 6 == 2, F.col("lines") + 1000).otherwise(F.col("lines")))
    old = old.withColumn("mtime", F.when(d % 6 == 1, d - 1).otherwise(d))
    text = f.select("cell", "rel", "content")
    return surface.refreshed(f.drop("content"), old, lambda named: named.join(text, ["cell", "rel"]))


@query("file_kinds", with_ctes(SURF, "SELECT doc_id, language, path_ok, bin AS is_binary, path_ok AND NOT bin AS countable FROM fl"))
def file_kinds(spark, sf):
    f = tables.files(spark, sf)
    ok, binary = surface.path_counts(F.col("rel")), surface.is_binary(F.col("content"))
    return f.select("doc_id", surface.language(F.col("rel")).alias("language"), ok.alias("path_ok"), binary.alias("is_binary"),
                    (ok & ~binary).alias("countable"))


@query("content_hashes", "SELECT page_id, sha256(html) AS sha FROM pages")
def content_hashes(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("tree_fingerprints", with_ctes(FILES, "SELECT cell || '/' || CAST(doc_id // 64 AS VARCHAR) AS tree, count(*) AS files, "
       "sha256(string_agg(sha256(content) || '  ' || rel || chr(10), '' ORDER BY rel)) AS fingerprint FROM files GROUP BY 1"))
def tree_fingerprints(spark, sf):
    f = tables.files(spark, sf)
    return surface.fingerprint(f.withColumn("tree", F.concat("cell", F.lit("/"), F.floor(F.col("doc_id") / 64).cast("string"))))


@query("tree_diffs", with_ctes(SURF, """
tr AS (SELECT cell, rel, sha256(content) AS sha FROM files WHERE doc_id % 6 <> 4),
j AS (SELECT coalesce(s.cell, t.cell) AS cell, coalesce(s.rel, t.rel) AS rel, s.sha AS old, t.sha AS new FROM skel s FULL JOIN tr t ON s.cell = t.cell AND s.rel = t.rel),
k AS (SELECT cell, rel, CASE WHEN old IS NOT NULL AND new IS NULL THEN 'deleted' WHEN old <> new THEN 'modified' WHEN old IS NULL THEN 'outside surface' END AS change
  FROM j WHERE NOT starts_with(rel, 'lib/') AND rel <> 'src/7/f7.py')""", "SELECT * FROM k WHERE change IS NOT NULL"))
def tree_diffs(spark, sf):
    tree = tables.files(spark, sf).where("doc_id % 6 <> 4").select("cell", "rel", F.sha2("content", 256).alias("sha"))
    return surface.tree_diff(skeleton(spark, sf), tree, exact=("src/7/f7.py",), prefixes=("lib/",))


@query("record_changes", """WITH b AS (SELECT source AS cell, CAST(doc_id AS VARCHAR) AS key, n_chars AS sig FROM documents WHERE doc_id % 10 <> 3),
a AS (SELECT source AS cell, CAST(doc_id AS VARCHAR) AS key, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS sig FROM documents WHERE doc_id % 10 <> 4)
SELECT coalesce(b.cell, a.cell) AS cell, coalesce(b.key, a.key) AS key FROM b FULL JOIN a ON a.cell = b.cell AND a.key = b.key WHERE b.sig IS DISTINCT FROM a.sig""")
def record_changes(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    snap = lambda keep, sig: d.where(keep).select(F.col("source").alias("cell"), i.cast("string").alias("key"), sig.alias("sig"))
    return surface.snapshot_diff(snap(i % 10 != 3, F.col("n_chars")), snap(i % 10 != 4, F.col("n_chars") + (i % 7 == 0).cast("int")))


@query("ledger_changes", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE n_chars > 0 END AS moved FROM documents""")
def ledger_changes(spark, sf):
    t, i = F.concat("text", F.lit("\n")), F.col("doc_id") % 5
    new = (F.when(i == 0, t).when(i == 1, F.concat(t, F.lit("now\tALERT\tc\twedged\n"))).when(i == 2, F.concat(t, F.lit("now\tALERT\tc\nnow\tITER\tgreen\n")))
           .when(i == 3, F.concat(t, F.lit("short\n"))).otherwise(F.concat(F.lit("x"), t)))
    return table(spark, sf, "documents").select("doc_id", surface.ledger_moved(t, new).alias("moved"))


@query("manifest_rows", r"""WITH l AS (SELECT doc_id, unnest(string_split(translate(text, ' ', chr(9)), chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, split_part(line, chr(9), 1) AS rel, TRY_CAST(split_part(line, chr(9), 2) AS BIGINT) AS lines, split_part(line, chr(9), 3) AS sha
FROM l WHERE len(string_split(line, chr(9))) = 3""")
def manifest_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.translate("text", " ", "\t").alias("text"))
    return lines.manifest(lines.numbered(d, "text", "doc_id"), "doc_id")
