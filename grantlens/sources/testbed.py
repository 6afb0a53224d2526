"""The domain's tables, and filings as XML, made from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import zero_padded

#: Tag rules for the invented part names.
RULES = [(r"\bwidget\b", ["Church"]), (r"\bgear\b", ["Christian Ministry"]), (r"\bplate\b", ["Evangelism", "Church Planting"]), (r"\bbolt\b", ["Food Security"]), (r"\bhot\b", ["Christian School"]), (r"\bred\b", ["International Missions"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, tax_year, id, grantee_name, purpose, amount, s_nationkey, is_foreign: one row for each line item.

    What is wide is joined last, and customers are joined to orders, so that line items move as few bytes as may be.
    """
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("tax_year")).join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.floor("l_extendedprice").alias("amount"))
    given = lines.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    given = given.select("o_custkey", "tax_year", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", "amount", "s_nationkey", (F.col("s_nationkey") != F.col("c_nationkey")).cast("int").alias("is_foreign"))
    named = given.join(t("part").select("p_partkey", F.col("p_name").alias("grantee_name"), F.col("p_type").alias("purpose")), F.col("l_partkey") == F.col("p_partkey"))
    return named.select("o_custkey", "tax_year", "id", "grantee_name", "purpose", "amount", "s_nationkey", "is_foreign")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, state, country of the nations, a fixed table."""
    t = lambda n: table(spark, sf_dir, n)
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("country"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ein, grantee_name, state, country, is_foreign, amount, purpose, tax_year: one row for each line item."""
    given = _lines(spark, sf_dir).join(F.broadcast(_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    return given.select("id", zero_padded(F.col("o_custkey").cast("string")).alias("ein"), "grantee_name", "state", "country", "is_foreign", "amount", "purpose", "tax_year")


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, tax_year, assets, n_orders: one row for each customer and year."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("tax_year")).agg(F.sum(F.floor("o_totalprice")).alias("assets"), F.count("*").alias("n_orders"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ein, tax_year, assets, n_orders: one row for each customer and year."""
    return _yearly(spark, sf_dir).select(zero_padded(F.col("o_custkey").cast("string")).alias("ein"), "tax_year", "assets", "n_orders")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).select("ein", "name", "state", "ntee")


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``universe`` with the customer's key as o_custkey."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(zero_padded(F.col("c_custkey").cast("string")).alias("ein"), F.col("c_name").alias("name"), F.col("n_name").alias("state"), F.col("c_mktsegment").alias("ntee"), F.col("c_custkey").alias("o_custkey"))


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{name}>"))


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise("")


def filings_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: one XML document for each customer and year, with the line items as grants."""
    k = F.col("k")
    paid = lambda g: F.concat(
        F.when(g["id"] % 3 == 0, "<f:GrantOrContriApprvForFutGrp>").otherwise("<f:GrantOrContributionPdDurYrGrp>"),
        F.lit("<f:RecipientBusinessName>"), _element("f:BusinessNameLine1Txt", g["grantee_name"]), F.lit("</f:RecipientBusinessName>"),
        F.when(g["is_foreign"] == 1, F.concat(F.lit("<f:RecipientForeignAddress>"), _element("f:CountryCd", g["country"]), F.lit("</f:RecipientForeignAddress>")))
        .otherwise(F.concat(F.lit("<f:RecipientUSAddress>"), _element("f:StateAbbreviationCd", g["state"]), F.lit("</f:RecipientUSAddress>"))),
        F.when(g["id"] % 4 == 1, F.concat(_element("f:Amt", F.lit("0")), _element("f:Amount", F.concat(g["amount"].cast("string"), F.lit(".75")))))
        .otherwise(_element("f:Amt", F.concat(g["amount"].cast("string"), F.lit(".75")))), _element("f:GrantOrContributionPurposeTxt", g["purpose"]),
        F.when(g["id"] % 3 == 0, "</f:GrantOrContriApprvForFutGrp>").otherwise("</f:GrantOrContributionPdDurYrGrp>"),
    )
    # nations' names are put in after the grants of a filing are together: 25 rows in one map
    names = _places(spark, sf_dir).agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", F.struct("state", "country")))).alias("names"))
    lines = _lines(spark, sf_dir).repartition("o_custkey", "tax_year").groupBy("o_custkey", "tax_year").agg(F.sort_array(F.collect_list(F.struct("id", "grantee_name", "s_nationkey", "is_foreign", "amount", "purpose"))).alias("l"))
    placed = F.transform("l", lambda x: F.struct(x["id"], x["grantee_name"], F.element_at("names", x["s_nationkey"]).alias("place"), x["is_foreign"], x["amount"], x["purpose"]))
    known = F.transform(F.filter(placed, lambda x: x["place"].isNotNull()), lambda x: F.struct(x["id"], x["grantee_name"], x["place"]["state"].alias("state"), x["place"]["country"].alias("country"), x["is_foreign"], x["amount"], x["purpose"]))
    given = lines.crossJoin(F.broadcast(names)).select("o_custkey", "tax_year", known.alias("g"))
    u = _universe(spark, sf_dir).withColumnRenamed("state", "home")
    f = _yearly(spark, sf_dir).join(u, "o_custkey").join(given, ["o_custkey", "tax_year"], "left").withColumn("k", F.col("o_custkey").cast("long"))
    number = F.concat(F.lit("555123"), F.lpad((k % 10000).cast("string"), 4, "0"))
    address = F.concat(_element("f:AddressLine1Txt", F.concat(k.cast("string"), F.lit(" Main St"))), _element("f:CityNm", F.col("ntee")))
    form = F.concat(
        F.lit("<f:ApplicationSubmissionInfoGrp>"), _element("f:RecipientPersonNm", F.concat(F.lit("Person "), k.cast("string"))),
        F.when(k % 4 == 1, F.concat(F.lit("<f:RecipientUSAddress>"), address, _element("f:ZIPCd", F.lit("00501")), F.lit("</f:RecipientUSAddress>")))
        .otherwise(F.concat(F.lit("<f:RecipientForeignAddress>"), address, _element("f:CountryCd", F.lit("CA")), F.lit("</f:RecipientForeignAddress>"))),
        _element("f:RecipientPhoneNum", number), _element("f:RecipientEmailAddressTxt", F.lit("a@example.org")), _element("f:SubmissionDeadlinesTxt", F.lit("NONE")), F.lit("</f:ApplicationSubmissionInfoGrp>"),
    )
    text = F.concat(
        F.lit('<f:Return xmlns:f="urn:filing"><f:PreparerPersonGrp><f:PhoneNum>9999999999</f:PhoneNum></f:PreparerPersonGrp><f:Filer>'), _element("f:EIN", F.col("ein")),
        F.lit("<f:BusinessName>"), _element("f:BusinessNameLine1Txt", F.col("name")), F.lit("</f:BusinessName><f:USAddress>"), _element("f:CityNm", F.col("ntee")), _element("f:StateAbbreviationCd", F.col("home")), F.lit("</f:USAddress>"),
        _if(k % 3 == 0, _element("f:PhoneNum", number)), F.lit("</f:Filer>"), _if(k % 3 == 1, F.concat(F.lit("<f:BusinessOfficerGrp>"), _element("f:PhoneNum", F.lit(" 12 ")), F.lit("</f:BusinessOfficerGrp>"))),
        _element("f:TaxYr", F.col("tax_year")), _element("f:FMVAssetsEOYAmt", F.when(k % 4 == 0, "0").otherwise(F.concat(F.col("assets").cast("string"), F.lit(".9")))), _element("f:TotalAssetsEOYAmt", F.col("assets") + 5),
        _element("f:TotDistriAndExpensesRevAndExpnssAmt", F.col("n_orders") * 10), _element("f:WebsiteAddressTxt", F.when(k % 5 == 0, " n/a ").otherwise(F.concat(F.lit("www."), k.cast("string"), F.lit(".org")))),
        _if(k % 2 == 0, _element("f:TotalRevAndExpnssAmt", F.when(k % 10 == 4, "n/a").otherwise((F.col("assets") * 2).cast("string")))), _if(k % 3 < 2, _element("f:OnlyContriToPreselectedInd", F.when(k % 3 == 0, "x").otherwise("1"))), _if(k % 2 == 1, form),
        _element("f:DescriptionOfActivity", F.concat(F.lit("Supports "), F.col("ntee"))), F.lit("<f:ProgramSrvcAccomplishmentGrp>"), _element("f:DescriptionProgramSrvcAccomTxt", F.lit("Program")), _element("f:ExpenseAmt", F.col("n_orders")),
        F.lit("</f:ProgramSrvcAccomplishmentGrp>"), F.coalesce(F.array_join(F.transform("g", paid), ""), F.lit("")), F.lit("</f:Return>"),
    )
    whole = f.select(_path(), text.cast("binary").alias("content"))
    return whole.unionAll(_odd_xml(spark, sf_dir))


def filing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of ``filings_xml``; no document is made."""
    made = _yearly(spark, sf_dir).join(_universe(spark, sf_dir), "o_custkey").select(_path())
    return made.unionAll(_odd_xml(spark, sf_dir).select("path"))


def _path() -> Column:
    return F.concat(F.lit("/raw/"), "ein", F.lit("_"), F.col("tax_year").cast("string"), F.lit("_public.xml")).alias("path")


def _odd_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no reader gets a filing from: encodings that are unknown or not for bytes, and a byte that is not UTF-8."""
    k = F.col("c_custkey")
    body = F.concat(F.lit('<f:Return xmlns:f="urn:filing"><f:Filer><f:CityNm>x'), F.lit("</f:CityNm></f:Filer></f:Return>")).cast("binary")
    named = lambda name: F.concat(F.lit(f'<?xml version="1.0" encoding="{name}"?>').cast("binary"), body)
    spoilt = F.concat(F.lit('<f:Return xmlns:f="urn:filing"><f:Filer><f:CityNm>').cast("binary"), F.unhex(F.lit("E9")), F.lit("</f:CityNm></f:Filer></f:Return>").cast("binary"))
    content = F.when(k % 10 == 0, named("foo")).when(k % 10 == 5, named("shift_jis")).when(k % 10 == 7, spoilt)
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("/raw/"), (k * 2 + 1).cast("string"), F.lit("_odd_public.xml")).alias("path"), content.alias("content"))
    return rows.filter("content IS NOT NULL")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ein (as it is, not padded), object_id, sub_date, name, row: the filings as an index lists them."""
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").join(names, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_custkey").cast("string").alias("ein"), F.col("o_orderkey").cast("string").alias("object_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sub_date"), F.col("c_name").alias("name"), F.col("o_orderkey").alias("row"))
