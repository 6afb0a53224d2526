"""Sources, sinks and streams on small files: odd rows, broken archives, replies, refreshed tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from grantlens.functions.text import first_truthy, invite_text
from grantlens.operators.relational import with_columns
from grantlens.plans import pending, verification
from grantlens.sinks import tables
from grantlens.sources import archives, delimited, filings, organisations
from grantlens.streaming.refresh import refresh


def xml(ein, year="2023", more="", ns=' xmlns="urn:x"'):
    return f"<Return{ns}><Filer><EIN>{ein}</EIN></Filer><TaxYr>{year}</TaxYr>{more}</Return>"


def test_folder_of_filings(spark, tmp_path):
    for i, text in enumerate([xml("000000001"), xml("000000001", more="<FMVAssetsEOYAmt>0</FMVAssetsEOYAmt><TotalAssetsEOYAmt>7</TotalAssetsEOYAmt>"), xml(""), "<broken", xml("000000002", ns=""), xml("000000003", "x")]):
        (tmp_path / f"{i}_public.xml").write_text(text)
    (tmp_path / "note.txt").write_text("no filing")
    got = filings.foundations(filings.read_xml(spark, str(tmp_path))).collect()
    assert sorted((r.ein, r.tax_year, r.assets) for r in got) == [("000000001", 2023, 7), ("000000003", 0, 0)]
    assert filings.backfill(filings.read_xml(spark, str(tmp_path))).count() == 1
    assert sorted((r.ein, r.tax_year, r.invite_only) for r in filings.invite_flags(filings.read_xml(spark, str(tmp_path))).collect()) == [("000000001", 2023, False), ("000000003", 0, False)]


def test_address_of_an_empty_block(spark):
    form = "<ApplicationSubmissionInfoGrp><RecipientUSAddress/><RecipientForeignAddress><CityNm>Rome</CityNm></RecipientForeignAddress></ApplicationSubmissionInfoGrp>"
    row = filings.parse(xml("1", more=form).encode())
    assert row["contact_address"] == "" and row["has_application"] == 1
    assert filings.parse(xml("1", more=form.replace("<RecipientUSAddress/>", "")).encode())["contact_address"] == "Rome"


def test_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(4):
            z.writestr(f"d/{i}_public.xml", xml(f"00000000{i}"))
        z.writestr("x.txt", "y")
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    (tmp_path / "b.zip").write_bytes(b"broken")
    (tmp_path / "c.zip").write_bytes(b"PK" * 5000)
    archives = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    members = filings.list_members(archives)
    assert sorted(r.object_id for r in members.collect()) == list("0123")
    assert filings.shred(filings.read_members(members)).count() == 4
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "object_id string")
    counts = filings.member_counts(filings.wanted_members(members, ids("1", "2", "2", "9"), ids("2"))).first()
    assert (counts.extracted, counts.skipped, counts.bytes) == (1, 1, len(xml("000000001")))
    assert filings.member_counts(filings.wanted_members(members, ids("9"), ids())).first().bytes == 0


def test_large_lists_are_split(spark, tmp_path):
    path, conf = tmp_path / "list.csv", "spark.sql.files.maxPartitionBytes"
    path.write_text("EIN,NAME\n" + "".join(f'{i:09d},"a ""b"" {i}"\n' for i in range(5000)))
    before = spark.conf.get(conf)
    spark.conf.set(conf, "16384")
    try:
        rows = delimited.scan_all(spark, [str(path)], ["EIN", "NAME"], line_feeds=False)
        assert rows.rdd.getNumPartitions() > 4 and delimited.scan(spark, str(path)).rdd.getNumPartitions() == 1
        got = [(r.EIN, r.NAME) for r in rows.orderBy("file_no", "row_no").collect()]
    finally:
        spark.conf.set(conf, before)
    assert got == [(f"{i:09d}", f'a "b" {i}') for i in range(5000)]
    path.write_text('EIN,NAME\n1,"two\nlines"\n')
    assert delimited.scan_all(spark, [str(path)], ["NAME"]).first().NAME == "two\nlines"
    assert delimited.scan_index(spark, {2023: str(path)}, ["NAME", "no"]).first().NAME == "two\nlines"


def test_short_and_quoted_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,"b,c",d\nshort\n\n"x ""y""",, z \n')
    got = {r.line: r.value for r in delimited.scan_place(spark, str(tmp_path / "in.csv"), 2).collect()}
    assert got['a,"b,c",d'] == "d" and got["short"] is None and got['"x ""y""",, z '] == "z"
    shown = tables.with_field(spark.createDataFrame([("a",), ("",)], "line string"), F.lit('say "x", y')).collect()
    assert [r.line for r in shown] == ['a,"say ""x"", y"', ',"say ""x"", y"']


def _zips(folder, packing=zipfile.ZIP_DEFLATED):
    for a in range(2):
        with zipfile.ZipFile(folder / f"{a}.zip", "w", packing) as z:
            for i in range(30):
                z.writestr(f"x/{a}{i:02d}_public.xml", xml(f"{a}{i:02d}") if i % 7 else "<broken")
            z.writestr("readme.txt", "x")
    (folder / "bad.zip").write_text("nothing")
    (folder / "empty.zip").write_text("")


def _read(spark, folder, schema=None, **options):
    archives.register(spark)
    reader = spark.read.format(archives.FORMAT).options(**options)
    return (reader.schema(schema) if schema else reader).load(str(folder))


@pytest.mark.parametrize("split", [700, 1 << 30])
def test_archive_source_reads_each_member_once(spark, tmp_path, split):
    _zips(tmp_path)
    got = _read(spark, tmp_path, splitBytes=split).collect()
    want = {f"{a}{i:02d}": xml(f"{a}{i:02d}") if i % 7 else "<broken" for a in range(2) for i in range(30)}
    assert len(got) == 60 and {r.object_id: r.content.decode() for r in got} == want
    assert all(r.size == len(r.content) and r.archive.endswith(f"/{r.object_id[0]}.zip") and r.member == f"x/{r.object_id}_public.xml" for r in got)


def test_archive_source_bounds_and_columns(spark, tmp_path):
    _zips(tmp_path)
    some = _read(spark, tmp_path, "object_id string, size long", idFrom="025", idBelow="103")
    assert sorted(r.object_id for r in some.collect()) == ["025", "026", "027", "028", "029", "100", "101", "102"] and some.columns == ["object_id", "size"]
    assert _read(spark, tmp_path / "1.zip", "member string").count() == 30
    whole = _read(spark, tmp_path)
    # a filtered query leaves the next one its rows
    assert [whole.filter(c).count() for c in ("object_id = '115'", "true", "object_id < '003' AND size > 0", "true")] == [1, 60, 3, 60]
    with pytest.raises(Exception, match="no such columns"):
        _read(spark, tmp_path, "nothing string").count()


def test_archive_source_damaged_member(spark, tmp_path):
    _zips(tmp_path, zipfile.ZIP_STORED)
    whole = (tmp_path / "1.zip").read_bytes()
    (tmp_path / "1.zip").write_bytes(whole.replace(b"<EIN>105<", b"<EIN>1x5<"))
    got = {r.object_id: r.content for r in _read(spark, tmp_path).collect()}
    assert len(got) == 60 and [i for i, c in got.items() if c is None] == ["105"]


def test_table_function_equals_shred(spark, tmp_path):
    _zips(tmp_path)
    files = _read(spark, tmp_path).unionByName(spark.createDataFrame([(None, None, "999", None, None)], "archive string, member string, object_id string, size long, content binary"))
    got = spark.sql(f"SELECT f.* FROM {{files}} a, LATERAL {archives.FUNCTION}(a.object_id, a.content) f", files=files)
    want = filings.shred(_read(spark, tmp_path).withColumnRenamed("member", "path"))
    assert got.columns == want.columns and got.count() == 50
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_replace_children_keeps_others(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "ein string, tax_year int, v int"
    rows = lambda *x: spark.createDataFrame(x, schema)
    tables.replace_children(rows(("a", 1, 1), ("a", 1, 2), ("b", 1, 3), ("a", 2, 4)), path, ["ein", "tax_year"], "tax_year")
    for _ in range(2):
        tables.replace_children(rows(("a", 1, 9), ("c", 3, 5)), path, ["ein", "tax_year"], "tax_year")
    assert sorted((r.ein, r.tax_year, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1, 9), ("a", 2, 4), ("b", 1, 3), ("c", 3, 5)]


def test_refresh_replaces(spark, tmp_path):
    landing, target = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    for i, assets in enumerate((5, 6)):
        (landing / f"{i}_public.xml").write_text(xml("000000001", more=f"<FMVAssetsEOYAmt>{assets}</FMVAssetsEOYAmt>"))
        refresh(spark, str(landing), target, str(tmp_path / "cp")).awaitTermination()
        assert [(r.ein, r.assets) for r in spark.read.parquet(target).collect()] == [("000000001", assets)]


def test_classifier_replies(spark):
    kb = spark.createDataFrame([(f"n{i}", f"N{i}", 9000 - i, [], "pending") for i in range(5)] + [("r", "R", 9000, ["Arts"], "rule"), ("s", "S", 10, [], "pending")], "name_norm string, display_name string, max_grant long, tags array<string>, source string").coalesce(1)
    none = spark.createDataFrame([], f"display_name string, tags {pending.TAGS}")
    calls = lambda names: '[{"tags": [{"name": "Church", "confidence": 80}, {"name": "Nope", "confidence": 99}]}, {"tags": []}]' if "N0" in names else 1 / 0
    new = pending.classify(pending.to_classify(kb), calls, batch=3)
    # the third name has no entry in the reply, the second batch fails
    assert sorted((r.display_name, [t.name for t in r.tags]) for r in new.collect()) == [("N0", ["Church"]), ("N1", [])]
    same, asked = pending.classify_pending(kb, none)
    assert asked.count() == 0 and sorted(map(repr, same.collect())) == sorted(map(repr, kb.collect()))
    done = {r.name_norm: (r.tags, r.source) for r in pending.apply_cache(kb, new).collect()}
    assert done["n0"] == (["Church"], "llm") and done["n1"] == ([], "llm") and done["n2"] == ([], "pending") and done["r"] == (["Arts"], "rule")


def test_replies_of_organisations(spark):
    replies = [("1", None), ("2", "no json"), ("3", '{"organization": null}'), ("4", '{"organization": {"name": "A"}, "filings_with_data": [{"formtype": 2, "tax_prd": null, "totrevenue": 5}, {"formtype": 0, "tax_prd": 9, "totrevenue": 1}]}'), ("5", '{"organization": {"name": null}}')]
    got = {r.ein: tuple(r)[1:] for r in organisations.summarise(spark.createDataFrame(replies, "ein string, reply string")).collect()}
    assert got["1"] == got["2"] == got["3"] == ("No", "", "", "", "", "", "")
    assert got["4"] == ("Yes", "A", "", "", "", "", "5") and got["5"] == ("Yes", "", "", "", "", "", "")


def test_second_reading_of_phones(spark):
    own = "<BusinessOfficerGrp><PhoneNum> 5 </PhoneNum></BusinessOfficerGrp>"
    theirs = "<PreparerFirmGrp><PhoneNum>9</PhoneNum></PreparerFirmGrp>"
    texts = [xml("000000001", more=theirs + own), xml("000000002", more=theirs), xml("000000003", more=theirs + "<PhoneNum>7</PhoneNum>"), xml("4"), xml("000000005", "x")]
    files = spark.createDataFrame([(f"/{i}.xml", bytearray(t.encode())) for i, t in enumerate(texts)], "path string, content binary")
    assert {r.ein: r.phone for r in verification.second_profile(files).collect()} == {"000000001": "5", "000000002": "", "000000003": "7"}
    assert {r.ein: r.tax_year for r in verification.second_flags(files).collect()} == {"000000001": 2023, "000000002": 2023, "000000003": 2023, "000000005": 0}


def test_small_functions(spark):
    df = spark.createDataFrame([(None, "", "x", None), ("a", "b", "c", True)], "p string, q string, r string, f boolean")
    got = df.select(first_truthy(F.col("p"), F.col("q"), F.col("r")).alias("t"), invite_text(F.col("f")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("x", ""), ("a", "Invite Only")]
    assert with_columns(df, {"p": ("int", 1), "z": ("int", 1)}).dtypes[-1] == ("z", "int")


def test_shredded_columns(spark):
    """Only the columns named are read, and as the whole reading has them; files that don't parse have rows if they are asked for."""
    from grantlens.sources import filings as X
    from grantlens.sources import testbed as T

    files = T.filings_xml(spark, "/root/testdata/sf0.001")
    whole = X.shred(files)
    some = ["object_id", "ein", "year", "activities"]
    assert sorted(X.shred(files, some).collect()) == sorted(whole.select(some).collect())
    given = whole.select("object_id", (F.size("grants") > 0).cast("int").alias("has_grants"))
    assert sorted(X.shred(files, ["object_id", "has_grants"]).collect()) == sorted(given.collect())
    marked = X.shred(files.withColumn("n", F.length("content")), ["object_id", "ein"], ["n"], every=True).collect()
    assert len(marked) == files.count() > whole.count() == sum(r.ein is not None for r in marked) and all(r.n > 0 for r in marked)


def test_profiles_are_read_in_one_pass(spark):
    """verify_profiles makes the filings once: its result reads no line items any more."""
    from grantlens.queries import QUERIES

    plan = QUERIES["verify_profiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_foundations_shuffle_no_grants(spark):
    from grantlens.queries import QUERIES

    plan = QUERIES["xml_foundations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "grants#" not in plan.replace("has_grants#", "")


def test_archives_are_packed_where_filings_are_made(spark):
    """Members are deflated, and no exchange carries documents."""
    import zipfile
    from grantlens.queries import filings as Q

    paths = [r.path.removeprefix("file://") for r in Q._archives(spark, "/root/testdata/sf0.001").collect()]
    members = []
    for p in paths:
        if zipfile.is_zipfile(p):
            members += zipfile.ZipFile(p).infolist()
    assert len({m.filename for m in members if m.filename != "readme.txt"}) == 843 and all(m.compress_type == zipfile.ZIP_DEFLATED for m in members)
    assert sum(not zipfile.is_zipfile(p) for p in paths) == 1
