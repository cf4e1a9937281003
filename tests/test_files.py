"""Files on disk: CSV, archives, listings, tables, views."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from careweft.functions.names import clean_columns, clean_name, quote_name
from careweft.sources import codes, delimited, listing
from careweft.sources.archives import entry_lines, read_zip_entries, zip_entries
from careweft.sources.links import extract_links, resolve_link
from careweft.sources.tables import create_view, load_tables, replace_table, table_from_query
from careweft.sources.values import in_population, values_df


def test_clean_name():
    assert clean_name("Provider Business-Mailing  Address (if outside U.S.)") == (
        "Provider_Business_Mailing_Address_if_outside_US"
    )
    assert clean_name("a__b - c#%") == "a_b_c"


def test_clean_columns_collide(spark):
    with pytest.raises(ValueError, match="a_b"):
        clean_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_quote_name():
    assert quote_name("a`b") == "`a``b`" and quote_name("a]b", "tsql") == "[a]]b]"
    assert quote_name('a"b', "duckdb") == '"a""b"'


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('NPI,"Last, Name",Note (1)\n0012,"O""Neil, A","two\nlines"\n7,,\n')
    df = delimited.read_wide_csv(spark, str(path), multi_line=True, clean=True)
    assert df.columns == ["NPI", "Last_Name", "Note_1"]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [
        ("0012", 'O"Neil, A', "two\nlines"), ("7", None, None),
    ]
    assert {t for _, t in df.dtypes} == {"string"}


def test_marked_files(spark, tmp_path):
    for name, rows in {
        "npidata_pfile_1.csv": ["01"], "npidata_pfile_2.csv": ["02", "03"],
        "pl_pfile_1.csv": ["9"], "npidata_other.csv": ["x"],
    }.items():
        (tmp_path / name).write_text("N P I\n" + "\n".join(rows) + "\n")
    frames = delimited.load_marked_files(spark, str(tmp_path), prefix="dim_")
    assert sorted(frames) == ["dim_npidata", "dim_pl"]
    assert sorted(r["N_P_I"] for r in frames["dim_npidata"].collect()) == ["01", "02", "03"]
    saved = load_tables(frames)
    assert saved["dim_pl"].count() == 1


def test_code_page_1252(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes('Näme,Size\n"é€“x,12\nplain,many\n'.encode("cp1252"))
    df = delimited.read_delimited(
        spark, str(path), renames={"Näme": "name", "Size": "size"}, types={"size": "bigint"}
    )
    assert sorted(map(tuple, df.collect())) == [('"é€“x', 12), ("plain", None)]


def archive(entries, spoil=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    data = out.getvalue()
    if spoil:
        at = data.find(spoil)
        data = data[:at] + b"\x00\xff" * (len(spoil) // 2) + data[at + 2 * (len(spoil) // 2):]
    return data


def test_zip_folder(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive({"d/": "", "d/x.csv": "a\r\nb\r\n", "y.r": "z"}))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("skipped")
    entries = read_zip_entries(spark, str(tmp_path))
    got = {(r["file_name"], None if r["content"] is None else bytes(r["content"]))
           for r in entries.collect()}
    assert got == {("d/x.csv", b"a\r\nb\r\n"), ("y.r", b"z"), (None, None)}
    lines = entry_lines(entries.filter("file_name like '%.csv'"))
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == ["a", "b"]


def test_spoiled_entry_has_no_content(spark):
    body = bytes(range(256)) * 8
    data = archive({"good.bin": b"ok", "bad.bin": body})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        start = z.getinfo("bad.bin").header_offset + 30 + len("bad.bin")
    spoiled = data[:start] + b"\xff" * 20 + data[start + 20:]
    df = spark.createDataFrame([(1, bytearray(spoiled)), (2, None)], "id int, z binary")
    got = {r["file_name"]: r["content"] for r in zip_entries(df, "z").collect()}
    assert bytes(got["good.bin"]) == b"ok" and got["bad.bin"] is None and len(got) == 2


def test_listing(spark, tmp_path):
    for name in ("a.csv", "b.r", "x_fileheader.csv", "all.zip"):
        (tmp_path / name).write_text("12345")
    found = listing.list_files(spark, str(tmp_path))
    assert sorted(r["name"] for r in found.collect()) == [
        "a.csv", "all.zip", "b.r", "x_fileheader.csv",
    ]
    assert {r["size"] for r in found.collect()} == {5}
    staged = listing.staged_files(found, "all.zip")
    assert [r["name"] for r in staged.collect()] == ["a.csv"]
    labelled = listing.list_files(spark, str(tmp_path), zone="EST", label_times=True)
    assert all(r["modification_time"].endswith(" EST") for r in labelled.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_extension_order(spark):
    given = [".zip", ".D01", ".T9", ".7z", "._x", ".doc", ".D", ".txt"]
    df = spark.createDataFrame([(e,) for e in [*given, ".zip"]], "extension string")
    got = [r["extension"] for r in listing.distinct_extensions(df).collect()]
    assert got == [".D", ".doc", ".txt", ".zip", "._x", ".D01", ".T9", ".7z"]


def test_files_by_extension_sorted(spark):
    rows = [(".CSV", dt.datetime(2024, 1, 1)), (".csvx", dt.datetime(2024, 1, 3)),
            (".txt", dt.datetime(2024, 1, 2)), (None, dt.datetime(2024, 1, 4))]
    df = spark.createDataFrame(rows, "extension string, modified timestamp_ntz")
    one = listing.files_by_extensions(df, "csv")
    assert [r["extension"] for r in one.collect()] == [".csvx", ".CSV"]
    two = listing.files_by_extensions(df, [".csv", "TXT"])
    assert [r["extension"] for r in two.collect()] == [".csvx", ".txt", ".CSV"]


def test_tables_and_views(spark):
    df = spark.range(3).toDF("n")
    assert replace_table(df, "t_replace").count() == 3
    assert replace_table(df.filter("n > 1"), "t_replace").count() == 1
    assert table_from_query(spark, "t_query", "SELECT n + 1 AS m FROM t_replace").first()["m"] == 3
    view = create_view(spark, "v_replace", "SELECT n FROM t_replace", "it's\na \\ comment")
    assert view.count() == 1
    text = spark.sql("DESCRIBE TABLE EXTENDED v_replace").filter("col_name = 'Comment'").first()
    assert text["data_type"] == "it's\na \\ comment"


def test_values(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (None, None), (2, None)]
    schema = "k int, t string"
    assert values_df(spark, rows, schema).count() == 3
    assert values_df(spark, rows, schema, distinct=True).count() == 2
    assert values_df(spark, rows, schema, True, include_empty_rows=True).count() == 3
    empty = values_df(spark, [], schema, into="t_values")
    assert empty.count() == 0 and empty.columns == ["k", "t"]
    facts = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    for small in (50_000, 0):
        monkeypatch.setattr("careweft.sources.values.SMALL_ROWS", small)
        kept = in_population(facts, values_df(spark, rows, schema), ["k"])
        assert sorted(r["k"] for r in kept.collect()) == [1, 2]


def test_code_tables(spark):
    sizes = {n: codes.provider_code_table(spark, n).count() for n in codes.PROVIDER_CODE_TABLES}
    assert len(sizes) == 13
    assert (sizes["state"], sizes["country"], sizes["name_suffix"]) == (60, 236, 12)
    country = dict(map(tuple, codes.provider_code_table(spark, "country").collect()))
    assert country["ZW"] == "ZIMBABWE" and country["RE"] == "REUNION"
    assert country["ST"] == "SAO TOME AND PRINCIPE" and country["LC"] == "SAINT LUCIA"
    assert country["VA"] == "HOLY SEE (VATICAN CITY STATE)" and "PR" not in country


def test_decode_keeps_unknown(spark, monkeypatch):
    df = spark.createDataFrame([("M",), ("Z",), (None,)], "g string")
    table = codes.provider_code_table(spark, "gender")
    for small in (50_000, 0):
        monkeypatch.setattr(codes, "SMALL_ROWS", small)
        out = codes.decode(df, "g", table, "gender_code", ["gender"])
        assert {(r["g"], r["gender"]) for r in out.collect()} == {
            ("M", "Male"), ("Z", None), (None, None),
        }


@pytest.mark.parametrize(
    "link, absolute",
    [
        ("x.zip", "http://h.org/a/b/x.zip"), ("/x.zip", "http://h.org/x.zip"),
        ("../x.zip?y=1", "http://h.org/a/x.zip?y=1"), ("./x", "http://h.org/a/b/x"),
        ("../../../x", "http://h.org/x"), ("https://o.org/z", "https://o.org/z"),
        ("//o.org/z", "http://o.org/z"), ("?q=2", "http://h.org/a/b/c.html?q=2"),
        ("#end", "http://h.org/a/b/c.html?p=1#end"), ("mailto:a@b", "mailto:a@b"),
        ("..", "http://h.org/a/"), ("x/", "http://h.org/a/b/x/"),
    ],
)
def test_resolve_link(spark, link, absolute):
    page = "http://h.org/a/b/c.html?p=1#top"
    df = spark.createDataFrame([(page, link)], "p string, l string")
    assert df.select(resolve_link("p", "l")).first()[0] == absolute


def test_links_by_id(spark):
    html = (
        '<p><A ID="DATA.ZIP.1" HREF=\'./files/data_1.zip?x=1\'>data</A>'
        '<a href="/other" id="other">o</a><a name="no-link">n</a><abbr id="DATA.ZIP.2">'
    )
    df = spark.createDataFrame([(1, "http://h.org/d/index.html", html)], "k int, url string, html string")
    found = extract_links(df, match="id", pattern=r"DATA\.ZIP\..*").collect()
    assert [(r["link"], r["file_name"]) for r in found] == [
        ("http://h.org/d/files/data_1.zip?x=1", "data_1.zip")
    ]
    assert extract_links(df).count() == 2


def test_inventory(spark):
    df = spark.createDataFrame(
        [("a", ("1", "Folder"), "c1"), ("b", ("x", "File"), "c2"), (None, (None, None), "c3")],
        "name string, attributes struct<size:string,kind:string>, content string",
    )
    tidy = listing.tidy_inventory(
        df,
        expand={"attributes": ["size", "kind"]},
        types={"size": "bigint"},
        blank_unless={"content": F.col("kind") == "Folder"},
    )
    rows = {r["name"]: (r["size"], r["content"]) for r in tidy.collect()}
    assert rows == {"a": (1, "c1"), "b": (None, None), None: (None, None)}
    both = listing.combine_inventories([tidy, tidy.select("name").withColumn("extra", F.lit(1))])
    assert both.count() == 4 and "extra" in both.columns


def test_links_are_read_as_markup(spark):
    page = """<!-- <a href="/no">x</a> --><script>"<a href='/no2'>"</script><a href="my file.zip">1</a>
      <a href="x?a=1&amp;b=2">2</a><a title="see href=bad > x" href='good'>3</a><a disabled href = /bare class=c>4</a>
      <a data-href="/other">5</a><abbr href="/no3">6</abbr><A HREF="it's">7</A>"""
    df = spark.createDataFrame([("http://h.org/a/b", page)], "url string, html string")
    found = [r["href"] for r in extract_links(df).orderBy("anchor_no").collect()]
    assert found == ["my file.zip", "x?a=1&b=2", "good", "/bare", "it's"]
