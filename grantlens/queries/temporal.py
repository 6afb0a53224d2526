"""Windows and state on streams, joins by time, rolled-up grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import latest
from ..operators.temporal import asof_join, interval_join
from ..plans import rollups
from ..sources import testbed as T
from ..streaming import flags, windows
from ..streaming.feed import fed
from .catalog import query
from .core import EIN, GRANTS

#: Errors are known two days after they happen; events land in spans of so many days.
_DAYS = 9
_ARRIVED = f"""e AS (SELECT *, CAST(floor(date_diff('second', date_trunc('day', (SELECT min(ts) FROM events)), ts + CASE WHEN event_type = 'error' THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END) / 86400.0 / {_DAYS}) AS BIGINT) AS batch
    FROM events),
w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e GROUP BY batch),
l AS (SELECT max(ts) AS last FROM events)"""
_MS = "date_trunc('milliseconds', {})"


def arrivals(spark, sf_dir):
    """The events with the number of the batch in which each arrives."""
    e = T.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    first = F.unix_seconds(F.lit(e.agg(F.date_trunc("day", F.min("ts"))).first()[0]).cast("timestamp"))
    known = F.unix_seconds("ts") + F.when(F.col("event_type") == "error", 2 * 86400).otherwise(0)
    return e.withColumn("batch", F.floor((known - first) / 86400 / _DAYS).cast("long"))


_MEASURES = lambda: [F.count("*").alias("n"), F.sum("cents").alias("cents")]
_SUMS = "count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents"


@query(f"""WITH {_ARRIVED}, s AS (SELECT e.*, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM e)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, {_SUMS} FROM s JOIN w USING (batch), l
WHERE (before IS NULL OR window_start + INTERVAL 6 HOUR > {_MS.format('before')} - INTERVAL 1 DAY) AND window_start + INTERVAL 6 HOUR <= {_MS.format('last')} - INTERVAL 1 DAY GROUP BY 1, 2, 3""")
def stream_tumbling(spark, sf_dir):
    """Six-hour windows by type; what comes for a window that the watermark, a day behind, has closed is dropped."""
    return fed(arrivals(spark, sf_dir), "batch", lambda s: windows.tumbling(s, "ts", "6 hours", "1 day", ["event_type"], _MEASURES()), "tumbling")


@query(f"""WITH {_ARRIVED}, s AS (SELECT e.*, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - to_days(CAST(k AS INT)) AS window_start FROM e, range(3) r(k))
SELECT window_start, window_start + INTERVAL 3 DAY AS window_end, {_SUMS} FROM s JOIN w USING (batch), l
WHERE (before IS NULL OR window_start + INTERVAL 3 DAY > {_MS.format('before')} - INTERVAL 1 DAY) AND window_start + INTERVAL 3 DAY <= {_MS.format('last')} - INTERVAL 1 DAY GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Three-day windows that begin each day: a row may be late for some of its windows only."""
    return fed(arrivals(spark, sf_dir), "batch", lambda s: windows.sliding(s, "ts", "3 days", "1 day", "1 day", [], _MEASURES()), "sliding")


@query(f"""WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER u + INTERVAL 5 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 5 HOUR AS window_end, user_id, {_SUMS} FROM g GROUP BY user_id, session
HAVING max(ts) + INTERVAL 5 HOUR <= {_MS.format('(SELECT max(ts) FROM events)')} - INTERVAL 4 DAY""")
def stream_sessions(spark, sf_dir):
    """Sessions of users with gaps of five hours; the delay waits for whatever comes late."""
    return fed(arrivals(spark, sf_dir), "batch", lambda s: windows.sessions(s, "ts", "5 hours", "4 days", ["user_id"], _MEASURES()), "sessions")


@query("""SELECT user_id, CASE WHEN event_type = 'error' THEN 'Invite Only' ELSE 'Not Invite Only' END AS flag
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest_flag(spark, sf_dir):
    """The latest flag of each entity from keyed state, over runs that each go on where the last one ended."""
    e = arrivals(spark, sf_dir)
    flag = F.when(F.col("event_type") == "error", "Invite Only").otherwise("Not Invite Only")
    rows = e.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("number"), flag.alias("flag"), "batch")
    with flags.state_store(spark):
        changes = fed(rows, "batch", lambda s: flags.flag_changes(s, "4 days", 90 * 86400 * 1000), "flags")
    return latest(changes, ["key"], "ts", "number").select(F.col("key").cast("long").alias("user_id"), "flag")


@query(f"""WITH o AS (SELECT {EIN.format('o_custkey', 'o_custkey')} AS ein, o_orderdate AS filed, max(o_orderkey) AS filing FROM orders GROUP BY 1, 2),
p AS (SELECT l_orderkey * 10 + l_linenumber AS id, {EIN.format('o_custkey', 'o_custkey')} AS ein, l_shipdate - INTERVAL 40 DAY AS paid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.id, p.ein, p.paid, o.filed, o.filing FROM p ASOF LEFT JOIN o ON p.ein = o.ein AND p.paid >= o.filed""")
def asof_filing(spark, sf_dir):
    """Each payment with the latest filing of its giver on or before its day; some come before the first filing."""
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", T.zero_padded(F.col("o_custkey").cast("string")).alias("ein"), "o_orderdate")
    lines = T.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("o_orderkey"), (F.col("l_shipdate") - F.expr("INTERVAL 40 DAYS")).alias("paid"))
    paid = lines.join(o.select("o_orderkey", "ein"), "o_orderkey").select("id", "ein", "paid")
    filed = o.groupBy("ein", F.col("o_orderdate").alias("filed")).agg(F.max("o_orderkey").alias("filing"))
    return asof_join(paid, filed, "ein", "paid", "filed")


@query(f"""WITH o AS (SELECT o_orderkey AS filing, {EIN.format('o_custkey', 'o_custkey')} AS ein, o_orderdate AS opened, o_orderdate + to_days(CAST(o_orderkey % 90 AS INT)) AS closed FROM orders),
p AS (SELECT l_orderkey * 10 + l_linenumber AS id, {EIN.format('o_custkey', 'o_custkey')} AS ein, l_shipdate AS paid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.ein, id, paid, filing, opened, closed FROM p JOIN o ON p.ein = o.ein AND paid BETWEEN opened AND closed""")
def payments_in_periods(spark, sf_dir):
    """Payments within the periods, of different length, that their giver's filings are open."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filing"), T.zero_padded(F.col("o_custkey").cast("string")).alias("ein"), F.col("o_orderdate").alias("opened"))
    periods = o.withColumn("closed", F.expr("opened + make_dt_interval(CAST(filing % 90 AS INT))"))
    lines = T.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("filing"), F.col("l_shipdate").alias("paid"))
    paid = lines.join(o.select("filing", "ein"), "filing").select("id", "ein", "paid")
    return interval_join(paid, periods, "ein", "paid", "opened", "closed").select("ein", "id", "paid", "filing", "opened", "closed")


_SIZE = "CASE WHEN amount < 20000 THEN 'small' WHEN amount < 60000 THEN 'middle' ELSE 'large' END"
_SIZED = f"{GRANTS}, z AS (SELECT CASE WHEN id % 9 = 0 THEN NULL ELSE state END AS state, tax_year, {_SIZE} AS size, amount FROM g)"
_TOTALS = "count(*) AS grants, CAST(sum(amount) AS BIGINT) AS amount FROM z"


def _sized(spark, sf_dir):
    g = T.grants(spark, sf_dir)
    return g.select(F.when(F.col("id") % 9 != 0, F.col("state")).alias("state"), "tax_year", rollups.size_class(F.col("amount")).alias("size"), "amount")


@query(f"WITH {_SIZED} SELECT state, tax_year, size, grouping(state, tax_year, size) AS level, {_TOTALS} GROUP BY CUBE (state, tax_year, size)")
def grant_cube(spark, sf_dir):
    """Totals over all subsets of state (some unknown), year and size."""
    return rollups.totals(_sized(spark, sf_dir), ["state", "tax_year", "size"])


@query(f"WITH {_SIZED} SELECT state, tax_year, size, grouping(state, tax_year, size) AS level, {_TOTALS} GROUP BY ROLLUP (state, tax_year, size)")
def grant_rollup(spark, sf_dir):
    return rollups.totals(_sized(spark, sf_dir), ["state", "tax_year", "size"], "rollup")


@query(f"WITH {_SIZED} SELECT state, tax_year, size, grouping(state, tax_year, size) AS level, {_TOTALS} GROUP BY GROUPING SETS ((state), (tax_year, size), ())")
def grant_sets(spark, sf_dir):
    return rollups.chosen_totals(_sized(spark, sf_dir), ["state", "tax_year", "size"], [["state"], ["tax_year", "size"], []])


@query(f"WITH {GRANTS} SELECT tax_year, count(DISTINCT ein) AS givers, true AS count_within, true AS median_within FROM g GROUP BY tax_year")
def sketched_years(spark, sf_dir):
    """Givers and median grants of years from sketches kept by state and year and merged, beside the exact counts: both within their bounds."""
    g = T.grants(spark, sf_dir).select("ein", "state", "tax_year", "amount")
    found = rollups.estimates(rollups.merged(rollups.sketches(g, ["state", "tax_year"], "ein", "amount"), ["tax_year"]), ["tax_year"])
    exact = g.groupBy("tax_year").agg(F.count_distinct("ein").alias("givers"))
    ranks = g.join(found.select("tax_year", "quantile"), "tax_year").groupBy("tax_year").agg(F.avg((F.col("amount") < F.col("quantile")).cast("double")).alias("below"), F.avg((F.col("amount") <= F.col("quantile")).cast("double")).alias("at_most"))
    near = F.abs(F.col("different") - F.col("givers")) <= 4 * 1.04 / 2 ** (rollups.LG_REGISTERS / 2) * F.col("givers") + 1
    within = (F.col("below") <= 0.52) & (F.col("at_most") >= 0.48)
    return exact.join(found, "tax_year").join(ranks, "tax_year").select("tax_year", "givers", near.alias("count_within"), within.alias("median_within"))


_YEARS = f"{GRANTS}, y AS (SELECT ein, tax_year, CAST(sum(amount) AS BIGINT) AS amount FROM g GROUP BY 1, 2)"


@query(f"""WITH {_YEARS} SELECT ein, tax_year, amount, CAST(sum(amount) OVER r AS BIGINT) AS recent, count(*) OVER r AS years_recent, lag(tax_year) OVER m AS last_year, lead(tax_year) OVER m AS next_year, amount - lag(amount) OVER m AS change
FROM y WINDOW m AS (PARTITION BY ein ORDER BY tax_year), r AS (PARTITION BY ein ORDER BY tax_year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def giving_frames(spark, sf_dir):
    return rollups.frames(rollups.by_year(T.grants(spark, sf_dir)))


@query(f"""WITH {_YEARS}, i AS (SELECT *, tax_year - row_number() OVER (PARTITION BY ein ORDER BY tax_year) AS island FROM y),
r AS (SELECT ein, min(tax_year) AS first_year, max(tax_year) AS last_year, count(*) AS years, CAST(sum(amount) AS BIGINT) AS amount FROM i GROUP BY ein, island)
SELECT *, first_year - lag(last_year) OVER (PARTITION BY ein ORDER BY first_year) - 1 AS gap FROM r""")
def giving_runs(spark, sf_dir):
    return rollups.runs(rollups.by_year(T.grants(spark, sf_dir)))
