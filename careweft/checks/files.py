"""File, table and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from careweft.checks.common import Registry, table
from careweft.functions.names import clean_columns
from careweft.functions.text import chunk_text, expand_tabs, text_pieces
from careweft.functions.times import stamp_text
from careweft.session import staging_path
from careweft.sources import listing
from careweft.sources.delimited import marked_files, read_delimited, read_wide_csv
from careweft.sources.links import extract_links
from careweft.sources.tables import create_view, replace_table
from careweft.sources.values import in_population, values_df
from careweft.sources.versions import publish, roll_back

REGISTRY = Registry()

# Fixed values of the file fixture.
EXTENSIONS = [".csv", ".TXT", ".D01", ".T9x", ".7z", ".xlsx", ".r", "._x", None]
SITE = "https://files.example.com/"


def files(spark, sf_dir):
    """FX-FILES: one file per document."""
    extension = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 9 + 1).cast("int")
    )
    hours = F.make_dt_interval(
        F.expr("doc_id div 24").cast("int"), (F.col("doc_id") % 24).cast("int")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), extension).alias("name"),
        extension.alias("extension"),
        F.col("n_chars").alias("size"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("modified"),
        F.concat(F.lit("root/teams/"), F.col("source")).alias("folder"),
    )


FILES_SQL = """
files AS (
  SELECT doc_id, lang, 'doc_' || doc_id || ext AS name, ext AS extension, n_chars AS size,
         TIMESTAMP '2024-01-01' + to_hours(doc_id) AS modified, 'root/teams/' || source AS folder
  FROM (SELECT *, ['.csv', '.TXT', '.D01', '.T9x', '.7z', '.xlsx', '.r', '._x', NULL]
                  [doc_id % 9 + 1] AS ext FROM documents))"""


@REGISTRY.add(
    "staged_file_filter",
    f"""WITH {FILES_SQL} SELECT doc_id, name FROM files
    WHERE name <> 'doc_4.7z' AND name NOT LIKE '%.r' AND name NOT LIKE '%\\_fileheader%' ESCAPE '\\'""",
)
def staged_file_filter(spark, sf_dir):
    return listing.staged_files(files(spark, sf_dir), "doc_4.7z").select("doc_id", "name")


@REGISTRY.add(
    "route_by_filename",
    f"""WITH {FILES_SQL},
    named AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '_pfile_' || name
                             WHEN doc_id % 3 = 1 THEN lang || '_xfile_' || name
                             ELSE 'pl_pfile_' || lang || '_pfile_' || name END AS name FROM files)
    SELECT doc_id, name, 'dim_' || split_part(name, '_pfile_', 1) AS table_name
    FROM named WHERE name LIKE '%\\_pfile\\_%' ESCAPE '\\'""",
)
def route_by_filename(spark, sf_dir):
    mark = (
        F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("_pfile_"), "name"))
        .when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("_xfile_"), "name"))
        .otherwise(F.concat(F.lit("pl_pfile_"), "lang", F.lit("_pfile_"), "name"))
    )
    named = files(spark, sf_dir).select("doc_id", mark.alias("name"))
    return marked_files(named, "_pfile_", "dim_")


def raw_library(spark, sf_dir):
    """A document-library listing: nested attributes, prefixed folders."""
    kind = F.when(F.col("doc_id") % 4 == 0, "Folder").otherwise("File")
    return files(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("Content"),
        F.col("name").alias("Name"),
        F.col("extension").alias("Extension"),
        F.col("modified").alias("Date accessed"),
        F.col("modified").alias("Date modified"),
        F.struct(
            F.col("size").cast("string").alias("Size"),
            F.lit("text").alias("Content Type"),
            kind.alias("Kind"),
        ).alias("Attributes"),
        F.concat(F.lit(SITE), "folder", F.lit("/")).alias("Folder Path"),
    )


def library(spark, sf_dir):
    return listing.tidy_inventory(
        raw_library(spark, sf_dir),
        expand={"Attributes": ["Size", "Content Type", "Kind"]},
        drop=["Date accessed", "Content Type"],
        renames={
            "Content": "content", "Name": "name", "Extension": "extension", "Kind": "kind",
            "Date modified": "modified", "Size": "size", "Folder Path": "folder",
        },
        types={"size": "bigint"},
        strip={"folder": SITE},
        blank_unless={"Content": F.col("Kind") == "Folder"},
    )


@REGISTRY.add(
    "file_inventory",
    f"""WITH {FILES_SQL}
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'c' || doc_id END AS content, name, extension,
           strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified, size,
           CASE WHEN doc_id % 4 = 0 THEN 'Folder' ELSE 'File' END AS kind,
           folder || '/' AS folder
    FROM files""",
)
def file_inventory(spark, sf_dir):
    return library(spark, sf_dir).withColumn("modified", stamp_text("modified"))


def all_files(spark, sf_dir):
    own = files(spark, sf_dir).filter(F.col("lang") == "en").drop("lang")
    shared = files(spark, sf_dir).filter(F.col("lang") == "fr").select("doc_id", "lang")
    shared = library(spark, sf_dir).join(shared.select("doc_id"), "doc_id", "left_semi")
    rest = files(spark, sf_dir).filter(~F.col("lang").isin("en", "fr"))
    rest = rest.select("doc_id", "name", "extension", "size", F.col("modified").alias("created"))
    return listing.combine_inventories([own, shared.drop("content"), rest])


ALL_FILES_SQL = """
all_files AS (
  SELECT doc_id, name, extension, size, CASE WHEN lang IN ('en', 'fr') THEN modified END AS modified,
         CASE WHEN lang NOT IN ('en', 'fr') THEN modified END AS created,
         CASE lang WHEN 'en' THEN folder WHEN 'fr' THEN folder || '/' END AS folder,
         CASE WHEN lang = 'fr' THEN CASE WHEN doc_id % 4 = 0 THEN 'Folder' ELSE 'File' END END
           AS kind
  FROM files WHERE name IS NOT NULL)"""


@REGISTRY.add(
    "files_union",
    f"""WITH {FILES_SQL}, {ALL_FILES_SQL}
    SELECT doc_id, name, extension, size, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified,
           strftime(created, '%Y-%m-%d %H:%M:%S') AS created, folder, kind
    FROM all_files""",
)
def files_union(spark, sf_dir):
    stamps = {c: stamp_text(c) for c in ("modified", "created")}
    return all_files(spark, sf_dir).withColumns(stamps)


@REGISTRY.add(
    "files_by_extension",
    f"""WITH {FILES_SQL}, {ALL_FILES_SQL}
    SELECT 'text' AS file_group, doc_id, name FROM all_files
    WHERE lower(extension) LIKE '.csv%' OR lower(extension) LIKE '.txt%'
    UNION ALL
    SELECT 'excel', doc_id, name FROM all_files WHERE lower(extension) LIKE '.xl%'
    UNION ALL
    SELECT 'zip', doc_id, name FROM all_files
    WHERE lower(extension) LIKE '.zip%' OR lower(extension) LIKE '.7z%'""",
)
def files_by_extension(spark, sf_dir):
    found = all_files(spark, sf_dir)
    parts = []
    for group, wanted in (("text", ["csv", ".Txt"]), ("excel", "xl"),
                          ("zip", listing.FILE_GROUPS["zip"])):
        hits = listing.files_by_extensions(found, wanted, modified=None)
        parts.append(hits.select(F.lit(group).alias("file_group"), "doc_id", "name"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@REGISTRY.add(
    "extension_sort_key",
    f"""WITH {FILES_SQL}
    SELECT DISTINCT extension,
      CASE WHEN extension = '.D01' THEN '2' WHEN extension = '.T9x' THEN '3'
           WHEN extension = '.7z' THEN '4' WHEN extension = '._x' OR extension IS NULL THEN '1'
           ELSE '0' END || lower(extension) AS sort_key
    FROM files""",
)
def extension_sort_key(spark, sf_dir):
    return listing.distinct_extensions(files(spark, sf_dir))


def _write_csv(df, name: str, **options) -> str:
    path = staging_path(df.sparkSession, name)
    writer = df.write.option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).options(**options).csv(path)
    return path


@REGISTRY.add(
    "csv_all_string",
    """SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS part_key, p_name || ', "new"' AS p_name,
              p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part""",
)
def csv_all_string(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("part_key"),
        F.concat("p_name", F.lit(', "new"')).alias("p_name"),
        "p_brand",
        F.col("p_size").cast("string").alias("p_size"),
    )
    return read_wide_csv(spark, _write_csv(part, "part-csv"))


@REGISTRY.add(
    "csv_multi_line",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents",
)
def csv_multi_line(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", "text"
    )
    return read_wide_csv(spark, _write_csv(docs, "documents-csv"), multi_line=True)


@REGISTRY.add(
    "clean_columns",
    """SELECT CAST(p_partkey AS VARCHAR) AS Part_Key, p_name AS Part_Name_full,
              p_brand AS Brand_No, CAST(p_size AS VARCHAR) AS Size_of_part FROM part""",
)
def cleaned_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("Part - Key"),
        F.col("p_name").alias("Part  Name (full)"),
        F.col("p_brand").alias("Brand__No.#"),
        F.col("p_size").cast("string").alias("Size_-_of part?"),
    )
    return clean_columns(read_wide_csv(spark, _write_csv(part, "messy-csv")))


@REGISTRY.add(
    "csv_latin1_noquote",
    f"""WITH {FILES_SQL}
    SELECT '"é' || name AS name, extension, CASE WHEN doc_id % 7 <> 0 THEN size END AS size,
           strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified,
           strftime(modified, '%Y-%m-%d %H:%M:%S') AS created, folder
    FROM files WHERE name IS NOT NULL""",
)
def csv_latin1_noquote(spark, sf_dir):
    prefix = "Microsoft.PowerShell.Core\\FileSystem::"
    raw = files(spark, sf_dir).filter(F.col("name").isNotNull())
    time = stamp_text("modified")
    raw = raw.select(
        F.concat(F.lit('"é'), "name").alias("PSChildName"),
        F.col("extension").alias("Extension"),
        F.when(F.col("doc_id") % 7 == 0, "unknown")
        .otherwise(F.col("size").cast("string"))
        .alias("Length"),
        time.alias("LastWriteTime"),
        time.alias("CreationTime"),
        F.concat(F.lit(prefix), "folder").alias("PSParentPath"),
    )
    # The writer takes no code page 1252; the bytes are the same for this text.
    path = _write_csv(raw, "files-csv", encoding="iso-8859-1", quote="")
    found = read_delimited(
        spark,
        path,
        renames={
            "PSChildName": "name", "Extension": "extension", "Length": "size",
            "LastWriteTime": "modified", "CreationTime": "created", "PSParentPath": "folder",
        },
        types={"size": "bigint", "modified": "timestamp_ntz", "created": "timestamp_ntz"},
    )
    found = listing.tidy_inventory(found, strip={"folder": prefix})
    return found.withColumns({c: stamp_text(c) for c in ("modified", "created")})


@REGISTRY.add(
    "replace_table",
    "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10",
)
def replaced_table(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    name = "careweft_replaced_part"
    replace_table(part.limit(0), name, path=staging_path(spark, name))
    return replace_table(part.filter("p_size > 10"), name, path=staging_path(spark, name))


@REGISTRY.add(
    "replace_without_gap",
    """SELECT 'present' AS version, count(*) AS parts, sum(p_size) AS sizes FROM part WHERE p_size > 10
       UNION ALL
       SELECT 'previous', count(*), sum(p_size) FROM part WHERE p_size <= 10""",
)
def replaced_without_gap(spark, sf_dir):
    """The table after two versions were published, and after going back by one."""
    part, name = table(spark, sf_dir, "part").select("p_partkey", "p_size"), "careweft_published_part"
    root = staging_path(spark, name)

    def summed(rows, label):
        return rows.agg(F.lit(label).alias("version"), F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("sizes"))

    publish(part.filter("p_size <= 10"), name, root)
    present = summed(publish(part.filter("p_size > 10"), name, root), "present")
    return present.unionByName(summed(roll_back(spark, name, root), "previous"))


@REGISTRY.add(
    "commented_view",
    """SELECT o_orderpriority AS priority, count(*) AS orders FROM orders GROUP BY 1""",
)
def commented_view(spark, sf_dir):
    name = "careweft_orders"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    replace_table(orders, name, path=staging_path(spark, name))
    sql = f"SELECT o_orderpriority AS priority, count(*) AS orders FROM {name} GROUP BY 1"
    return create_view(spark, "careweft_view_orders", sql, "# Orders\n- the buyer's priorities")


@REGISTRY.add(
    "values_into_table",
    """SELECT c_custkey, c_name, v.note FROM customer JOIN
       (VALUES (3, 'o''k'), (5, NULL), (8, 'x')) v(k, note) ON c_custkey = v.k""",
)
def values_into_table(spark, sf_dir):
    rows = [(3, "o'k"), (5, None), (None, None), (8, "x"), (3, "o'k")]
    chosen = values_df(spark, rows, "c_custkey bigint, note string", distinct=True)
    name = "careweft_chosen"
    saved = replace_table(chosen, name, path=staging_path(spark, name))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    kept = in_population(customers, saved, ["c_custkey"])
    return kept.join(F.broadcast(saved), "c_custkey").select("c_custkey", "c_name", "note")


@REGISTRY.add(
    "html_anchor_links",
    """WITH found AS (
      SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href
      FROM pages)
    SELECT page_id, href, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link,
           split_part(href, '/', -1) AS file_name
    FROM found""",
)
def html_anchor_links(spark, sf_dir):
    found = extract_links(table(spark, sf_dir, "pages"), match="href")
    return found.select("page_id", "href", "link", "file_name")


@REGISTRY.add(
    "text_chunks",
    """WITH RECURSIVE cut AS (
      SELECT doc_id, 0 AS chunk_no, CAST('' AS VARCHAR) AS chunk, text AS rest FROM documents
      UNION ALL
      SELECT doc_id, chunk_no + 1, left(rest, n), substr(rest, n + 1) FROM (
        SELECT *, CASE WHEN length(rest) <= 4000 THEN length(rest)
                       WHEN strpos(left(rest, 4000), chr(10)) > 0
                       THEN 4001 - strpos(reverse(left(rest, 4000)), chr(10))
                       ELSE 4001 END AS n
        FROM cut WHERE length(rest) > 0))
    SELECT doc_id, chunk_no, chunk FROM cut WHERE chunk_no > 0""",
)
def text_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_text(docs, "text")


@REGISTRY.add(
    "text_chunks_rejoin",
    """SELECT doc_id, md5(text) AS digest, true AS all_short FROM documents WHERE length(text) > 0""",
)
def text_chunks_rejoin(spark, sf_dir):
    pieces = text_pieces("text", 1000)
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return docs.select("doc_id", pieces.alias("pieces")).select(
        "doc_id",
        F.md5(F.array_join("pieces", "")).alias("digest"),
        F.forall("pieces", lambda p: F.length(p) <= 1001).alias("all_short"),
    )


def _tabs_sql(first: str) -> str:
    return f"""WITH t AS (
      SELECT doc_id, regexp_split_to_array(replace(text, ', ', chr(9)), '[\\r\\n]') AS lines
      FROM documents)
    SELECT doc_id, array_to_string(list_transform(lines, lambda line, i:
             CASE WHEN {first} THEN line ELSE
             list_reduce(string_split(line, chr(9)), lambda acc, part:
               acc || repeat(' ', CAST(4 - length(acc) % 4 AS BIGINT)) || part) END), chr(10)) AS text
    FROM t"""


def _tabbed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.replace("text", F.lit(", "), F.lit("\t")).alias("text"))


@REGISTRY.add("expand_tabs", _tabs_sql("false"))
def tabs_expanded(spark, sf_dir):
    return _tabbed(spark, sf_dir).withColumn("text", expand_tabs("text"))


@REGISTRY.add("expand_tabs_after_first_line", _tabs_sql("i = 1"))
def tabs_after_first_line(spark, sf_dir):
    kept = expand_tabs("text", keep_first_line=True)
    return _tabbed(spark, sf_dir).withColumn("text", kept)
