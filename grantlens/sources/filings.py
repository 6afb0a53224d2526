"""XML filings: from files or zip archives to one nested row for each filing, then to tables."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Collection, Iterator
from contextlib import nullcontext

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import number_or_null, object_id, phone, website, whole_number, year

SCHEMA = """object_id string, ein string, name string, city string, state string, year string, assets string, total_assets string, distributions string,
site string, phone string, revenue string, invite string, has_application int, contact string, contact_address string, contact_phone string, email string,
application_format string, deadlines string, restrictions string,
grants array<struct<kind:string,name:string,city:string,state:string,country:string,is_foreign:int,amount:string,other_amount:string,purpose:string>>,
activities array<struct<description:string,expenses:string>>"""
#: What ``foundations`` and ``backfill`` need.
FOUNDATION = """object_id ein name city state year assets total_assets distributions site phone revenue invite has_application contact contact_address contact_phone email
application_format deadlines restrictions has_grants""".split()
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.replace("\n", " ").split("grants array")[0].replace(", ", ",").strip(", ").split(",")] + ["grants", "activities"]

# Element names of the filings, in the order in which they are tried.
GRANT_GROUPS = [("paid", "GrantOrContributionPdDurYrGrp"), ("legacy", "GrantOrContriPaidDuringYear"), ("future", "GrantOrContriApprvForFutGrp")]
PREPARERS = {"PreparerPersonGrp", "PreparerFirmGrp", "PaidPreparerInformationGrp"}
ACTIVITY_TEXTS = ["DescriptionOfActivity", "ActivityOrProgramDescription", "Desc"]
PROGRAM_GROUPS = ["ProgramSrvcAccomplishmentGrp", "ProgramServiceAccomplishment"]
APPLICATION = dict(
    contact="RecipientPersonNm", contact_phone="RecipientPhoneNum", email="RecipientEmailAddressTxt", application_format="FormAndInfoAndMaterialsTxt",
    deadlines="SubmissionDeadlinesTxt", restrictions="RestrictionsOnAwardsTxt",
)
ADDRESSES = ["RecipientUSAddress", "RecipientForeignAddress"]
ADDRESS_PARTS = [["AddressLine1Txt"], ["AddressLine2Txt"], ["CityNm"], ["StateAbbreviationCd", "ProvinceOrStateNm"], ["ZIPCd", "ForeignPostalCd"], ["CountryCd"]]
# End of fixed values.


def parse(data: bytes, columns: Collection[str] = _COLUMNS) -> dict | None:
    """None for malformed text, an encoding that is unknown or can't be read, a root without a namespace or a filing without an EIN.

    Only the columns named are read. The tree is walked once; elements are looked up by name.
    """
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, LookupError, ValueError):
        return None
    if not root.tag.startswith("{"):
        return None
    ns = root.tag[: root.tag.index("}") + 1]
    named: dict[str, list[ET.Element]] = {}
    for node in root.iter():
        named.setdefault(node.tag, []).append(node)
    # what is below the root: the root itself is found by ``every`` only
    under = lambda tag: named.get(tag, [])[tag == root.tag :]
    every = lambda name: named.get(ns + name, [])

    def down(node, path: str):
        """The first element at a path of children."""
        first, _, rest = path.partition("/")
        if not rest:
            return node.find(ns + first)
        return next((hit for c in node.findall(ns + first) if (hit := down(c, rest)) is not None), None)

    def find(path: str):
        """The first element at a path that begins anywhere below the root."""
        first, _, rest = path.partition("/")
        nodes = under(ns + first)
        return next((hit for n in nodes if (hit := down(n, rest)) is not None), None) if rest else nodes[0] if nodes else None

    def text(*paths: str) -> str:
        return next((t for p in paths if (h := find(p)) is not None and (t := (h.text or "").strip())), "")

    def within(node, *names: str) -> str:
        """The first text of the first elements of these names anywhere below a node."""
        return next((t for n in names if (h := node.find(f".//{ns}{n}")) is not None and (t := (h.text or "").strip())), "")

    def own_phone() -> str:
        phones = every("PhoneNum")
        theirs = {x for p in PREPARERS for tag in (ns + p, p) for n in named.get(tag, []) for x in n.iter(ns + "PhoneNum")} if phones else ()
        return next(((n.text or "").strip() for n in phones if n not in theirs), "")

    def below(node, *paths: str) -> str:
        """The first text at one of the paths, child by child."""
        hits = (down(node, p) for p in paths) if node is not None else ()
        return next((t for h in hits if h is not None and (t := (h.text or "").strip())), "")

    def address(node) -> str:
        """Of the first block that is there, even if it is empty."""
        blocks = (node.find(ns + a) for a in ADDRESSES) if node is not None else ()
        block = next((b for b in blocks if b is not None), None)
        return ", ".join(t for names in ADDRESS_PARTS if (t := below(block, *names)))

    ein = text("Filer/EIN", "EIN") or next(((n.text or "").strip() for n in under("EIN")[:1]), "")
    if not ein:
        return None

    def grants() -> Iterator[dict]:
        for kind, group in GRANT_GROUPS:
            for g in every(group):
                name = below(g, "RecipientBusinessName/BusinessNameLine1Txt", "RecipientBusinessName/BusinessNameLine1", "RecipientPersonNm")
                if name:
                    abroad = g.find(ns + "RecipientForeignAddress")
                    country = "US" if abroad is None else below(abroad, "CountryCd", "Country") or "FOREIGN"
                    city, state = (below(g, *(f"RecipientUSAddress/{n}" for n in names)) for names in (("CityNm", "City"), ("StateAbbreviationCd", "State")))
                    yield dict(kind=kind, name=name, city=city, state=state, country=country, is_foreign=int(abroad is not None), amount=below(g, "Amt"), other_amount=below(g, "Amount"), purpose=below(g, "GrantOrContributionPurposeTxt", "PurposeOfGrantOrContriTxt"))

    def activities() -> list[dict]:
        out = [dict(description=t, expenses="0") for a in ACTIVITY_TEXTS for n in every(a) if (t := (n.text or "").strip())]
        return out + [dict(description=t, expenses=within(n, "ExpenseAmt")) for a in PROGRAM_GROUPS for n in every(a) if (t := within(n, "DescriptionProgramSrvcAccomTxt", "ActivityOrMissionDesc"))]

    form = find("ApplicationSubmissionInfoGrp")
    read = dict(
        ein=lambda: ein, name=lambda: text("Filer/BusinessName/BusinessNameLine1Txt", "Filer/BusinessName/BusinessNameLine1", "BusinessName/BusinessNameLine1Txt"),
        city=lambda: text("Filer/USAddress/CityNm", "Filer/USAddress/City"), state=lambda: text("Filer/USAddress/StateAbbreviationCd", "Filer/USAddress/State"),
        year=lambda: text("TaxYr", "TaxYear"), assets=lambda: text("FMVAssetsEOYAmt"), total_assets=lambda: text("TotalAssetsEOYAmt"),
        distributions=lambda: text("TotDistriAndExpensesRevAndExpnssAmt"), site=lambda: text("WebsiteAddressTxt"),
        phone=lambda: text("Filer/PhoneNum", "BusinessOfficerGrp/PhoneNum") or own_phone(), revenue=lambda: text("TotalRevAndExpnssAmt"), invite=lambda: text("OnlyContriToPreselectedInd"),
        has_application=lambda: int(form is not None), contact_address=lambda: address(form), grants=lambda: list(grants()), activities=activities,
        has_grants=lambda: int(any(True for _ in grants())),
    )
    return {c: read[c]() if c in read else below(form, APPLICATION[c]) for c in columns if c != "object_id"}


def shred(files: DataFrame, columns: list[str] | None = None, keep: Collection[str] = (), every: bool = False) -> DataFrame:
    """files: path, content and the columns to keep. One row for each filing that parses, with the columns named.

    Columns: those of SCHEMA, which are all read if none are named, and ``has_grants`` (0 or 1). With ``every`` files that don't parse
    have a row too, whose columns but object_id are null.
    """
    wanted = columns or _COLUMNS
    others = [files.schema[c] for c in keep]
    known = StructType.fromDDL(SCHEMA + ", has_grants int")
    out = StructType([known[c] for c in wanted] + others)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places = [], []
            for at, (i, data) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                row = parse(data, wanted) if (data := data.as_py()) is not None else None
                if row or every:
                    rows.append({"object_id": i} | (row or {}))
                    places.append(at)
            arrays = [pa.array([r.get(c) for r in rows], schema.field(c).type) for c in wanted]
            yield pa.RecordBatch.from_arrays(arrays + [b.column(c).take(pa.array(places, pa.int64())).cast(schema.field(c).type) for c in keep], schema=schema)

    return files.select(object_id(F.col("path")).alias("object_id"), "content", *keep).mapInArrow(run, out)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    return shred(spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path))


def _open(path: str) -> zipfile.ZipFile | None:
    """An archive, read from its store in parts; None if it is broken."""
    store, at = fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "file:///", path))
    try:
        return zipfile.ZipFile(store.open_input_file(at))
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for what is too short to hold an archive's end
        return None


def list_members(archives: DataFrame) -> DataFrame:
    """archive, member, object_id, size of the XML members of zip archives (path); a broken archive has none."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                with _open(path) or nullcontext() as z:
                    found = [(path, i.filename, i.file_size) for i in z.infolist() if i.filename.endswith(".xml")] if z else []
                    yield pd.DataFrame(found, columns=["archive", "member", "size"])

    listed = archives.select("path").mapInPandas(run, "archive string, member string, size long")
    return listed.withColumn("object_id", object_id(F.concat(F.lit("/"), "member")))


def wanted_members(members: DataFrame, wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Members whose object_id is wanted; ``skip`` marks those that are there already."""
    mine = members.join(wanted.select("object_id").distinct(), "object_id", "left_semi")
    return mine.join(have.select("object_id", F.lit(True).alias("skip")).distinct(), "object_id", "left").withColumn("skip", F.coalesce("skip", F.lit(False)))


def member_counts(chosen: DataFrame) -> DataFrame:
    """extracted, skipped, bytes of ``wanted_members``."""
    taken = F.sum(F.when(~F.col("skip"), F.col("size")).otherwise(0))
    return chosen.agg(F.count_if(~F.col("skip")).alias("extracted"), F.count_if(F.col("skip")).alias("skipped"), F.coalesce(taken, F.lit(0)).alias("bytes"))


def read_members(members: DataFrame) -> DataFrame:
    """path, content of members (archive, member): each batch opens an archive once."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, group in f.groupby("archive"):
                with _open(path) as z:
                    for name in group["member"]:
                        yield pd.DataFrame({"path": ["/" + name], "content": [z.read(name)]})

    return members.select("archive", "member").mapInPandas(run, "path string, content binary")


def winners(filings: DataFrame) -> DataFrame:
    """One filing for each EIN and year: that of the greatest object id."""
    from ..operators.relational import latest

    return latest(filings.withColumn("tax_year", year(F.col("year"))), ["ein", "tax_year"], "object_id")


def _profile() -> list[Column]:
    """What a filing says about how to apply, and its revenue."""
    return [
        website(F.col("site")).alias("website"), phone(F.col("phone")).alias("phone"), number_or_null(F.col("revenue")).alias("revenue"),
        (F.upper("invite") == "X").cast("int").alias("invite_only"), F.col("has_application").alias("has_application_info"), F.col("contact").alias("contact_person"), "contact_address",
        phone(F.col("contact_phone")).alias("contact_phone"), F.col("email").alias("contact_email"), "application_format", "deadlines", "restrictions",
    ]


def foundations(filings: DataFrame) -> DataFrame:
    """One row for each EIN and year. Assets at market value, unless they are 0 or missing: then the book value.

    filings: has_grants or grants; grants themselves are not shuffled.
    """
    if "has_grants" not in filings.columns:
        filings = filings.withColumn("has_grants", (F.size("grants") > 0).cast("int"))
    filings = filings.drop("grants", "activities")
    market, book = whole_number(F.col("assets")), whole_number(F.col("total_assets"))
    return winners(filings).select(
        "ein", "tax_year", F.col("name").alias("organization_name"), "city", "state", F.lit("US").alias("country"), F.when(market != 0, market).otherwise(book).alias("assets"),
        whole_number(F.col("distributions")).alias("distributions"), "has_grants", *_profile(),
    )


def backfill(filings: DataFrame) -> DataFrame:
    """ein, tax_year and the profile's fields of filings whose year is a number."""
    return winners(filings.filter(F.col("year").rlike(r"^\d+$"))).select("ein", "tax_year", *_profile())


def invite_flags(filings: DataFrame) -> DataFrame:
    """ein, tax_year, invite_only of the latest filing of each EIN; of equal years the greatest object id."""
    from ..operators.relational import latest

    flags = filings.select(F.trim("ein").alias("ein"), year(F.col("year")).alias("tax_year"), (F.upper("invite") == "X").alias("invite_only"), "object_id")
    return latest(flags, ["ein"], "tax_year", "object_id").drop("object_id")


def grants(filings: DataFrame) -> DataFrame:
    """One row for each grant. The amount is the second element's where the first one's is 0 or no number."""
    g = winners(filings).select("ein", "tax_year", F.posexplode("grants").alias("id", "g"))
    first, other = whole_number(F.col("g.amount")), whole_number(F.col("g.other_amount"))
    return g.select("ein", "tax_year", "id", F.col("g.kind").alias("grant_kind"), F.col("g.name").alias("grantee_name"), "g.city", "g.state", "g.country", "g.is_foreign", F.when(first != 0, first).otherwise(other).alias("amount"), "g.purpose")


def activities(filings: DataFrame) -> DataFrame:
    a = winners(filings).select("ein", "tax_year", F.posexplode("activities").alias("id", "a"))
    return a.select("ein", "tax_year", "id", "a.description", whole_number(F.col("a.expenses")).alias("expenses"))
