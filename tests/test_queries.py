"""Every query with SQL equals DuckDB's answer; functions keep their traps."""

import duckdb
import pytest

from grantlens import queries
from grantlens.functions.similarity import ratio_of, token_set_of, token_sort_of
from grantlens.functions.text import normalized
from grantlens.sources.filings import foundations, grants, shred

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.SQL:
        assert df.columns
        return
    rel = db.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert len(rel.columns) == len(df.columns)
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_names(spark):
    pairs = {"The Foundation Inc.": "", "Smith Fam Fdn": "smith family", "Joshua Fund": "joshua", "Cross-Cultural Aid": "crosscultural aid", "Acme DBA Beta": "acme", "Acme dba B fka C": "acme dba b", "Osaka Relief": "os", "Handball Club": "han"}
    df = spark.createDataFrame(list(pairs.items()), "raw string, want string")
    assert all(r.n == r.want for r in df.withColumn("n", normalized(df.raw)).collect())


def test_similarity():
    assert ratio_of("cure", "core") == 75 and ratio_of("", "") == 100 and token_sort_of("a b", "b a") == 100 and token_set_of("cru", "cru south") == 100


def test_filings(spark):
    xml = """<Return xmlns="urn:x"><PaidPreparerInformationGrp><PhoneNum>1</PhoneNum></PaidPreparerInformationGrp><Filer><EIN>012345678</EIN><PhoneNum>5551234567</PhoneNum></Filer><TaxYr>2023</TaxYr><FMVAssetsEOYAmt>1234.9</FMVAssetsEOYAmt>
    <GrantOrContriApprvForFutGrp><RecipientPersonNm>P</RecipientPersonNm><Amt>abc</Amt></GrantOrContriApprvForFutGrp><GrantOrContributionPdDurYrGrp><RecipientBusinessName><BusinessNameLine1Txt>B</BusinessNameLine1Txt></RecipientBusinessName><RecipientForeignAddress/><Amt>7.9</Amt></GrantOrContributionPdDurYrGrp></Return>"""
    files = spark.createDataFrame([("/a/1_public.xml", bytearray(xml.encode())), ("/a/2_public.xml", bytearray(b"<bad")), ("/a/0.xml", bytearray(xml.replace("1234.9", "5").encode())), ("/a/3.xml", bytearray(b"<Return/>"))], "path string, content binary")
    shredded = shred(files)
    (f,) = foundations(shredded).collect()
    assert (f.ein, f.tax_year, f.assets, f.phone, f.revenue, f.has_grants) == ("012345678", 2023, 1234, "(555) 123-4567", None, 1)
    assert [(r.grant_kind, r.grantee_name, r.amount, r.country) for r in grants(shredded).orderBy("id").collect()] == [("paid", "B", 7, "FOREIGN"), ("future", "P", 0, "US")]
