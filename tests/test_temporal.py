"""Streams with late rows and restarts, joins by time, sketches: against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grantlens.operators.temporal import asof_join, interval_join
from grantlens.plans import rollups
from grantlens.queries import QUERIES, core
from grantlens.streaming import flags, windows
from grantlens.streaming.feed import advance, fed, landed

T0 = datetime(2024, 1, 1)
EVENTS = "id long, ts timestamp, k string, batch long"


def made(rng, n, batches, late):
    """Events of batches of a day each; some hours of a batch are as old as ``late`` hours."""
    return [(i, T0 + timedelta(hours=24 * b - rng.choice([0, 0, 0, rng.randrange(late)]), minutes=rng.randrange(1440)), rng.choice("abc"), b) for i in range(n) if (b := i * batches // n) >= 0]


def marks(rows, delay):
    """The watermark before each batch, and the last one."""
    out, top = {}, None
    for b in sorted({r[3] for r in rows}):
        out[b] = top - delay if top else datetime.min
        top = max([r[1] for r in rows if r[3] == b] + ([top] if top else []))
    return out, top - delay


@pytest.mark.parametrize("kind", ["tumbling", "sliding"])
def test_late_rows_are_dropped_by_rule(spark, kind):
    rng = random.Random(7)
    rows = made(rng, 160, 4, 60)
    delay, size, step = timedelta(hours=6), timedelta(hours=4), timedelta(hours=4 if kind == "tumbling" else 2)
    before, last = marks(rows, delay)
    want, dropped = defaultdict(int), 0
    for _, ts, k, b in rows:
        start = datetime(1970, 1, 1) + (ts - datetime(1970, 1, 1)) // step * step
        while start + size > ts:
            if start + size > before[b]:
                want[start, k] += start + size <= last
            else:
                dropped += 1
            start -= step
    df = spark.createDataFrame(rows, EVENTS)
    n = [F.count("*").alias("n")]
    if kind == "tumbling":
        got = fed(df, "batch", lambda s: windows.tumbling(s, "ts", "4 hours", "6 hours", ["k"], n), "t")
    else:
        got = fed(df, "batch", lambda s: windows.sliding(s, "ts", "4 hours", "2 hours", "6 hours", ["k"], n), "t")
    assert {(r.window_start, r.k): r.n for r in got.collect()} == {w: n for w, n in want.items() if n} and dropped > 5


def test_sessions(spark):
    rng = random.Random(8)
    rows = made(rng, 120, 3, 12)
    gap, delay = timedelta(hours=1), timedelta(hours=20)
    _, last = marks(rows, delay)
    want = []
    for k in "abc":
        times = sorted(r[1] for r in rows if r[2] == k)
        run = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t > run[-1] + gap:
                if run[-1] + gap <= last:
                    want.append((run[0], run[-1] + gap, k, len(run)))
                run = []
            run.append(t)
    got = fed(spark.createDataFrame(rows, EVENTS), "batch", lambda s: windows.sessions(s, "ts", "1 hour", "20 hours", ["k"], [F.count("*").alias("n")]), "s")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def killed_while(marker):
    """A processor that fails in the middle of a batch, as long as a file is there. Made here, so that workers need not import this module."""

    class Killed(flags.LatestFlag):
        def handleInputRows(self, key, rows, timerValues):
            import os

            yield from super().handleInputRows(key, rows, timerValues)
            if key[0] == "k3" and os.path.exists(marker):
                raise RuntimeError("killed")

    return Killed


def test_flags_after_a_restart(spark, tmp_path):
    """A run that dies in the middle of a batch gives out nothing of it; the next goes on, and each change is there once."""
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(6)}", T0 + timedelta(minutes=rng.randrange(5000)), i, rng.choice(["x", "y"])) for i in range(90)]
    schema, folder = "key string, ts timestamp, number long, flag string", str(tmp_path / "in")
    marker = tmp_path / "marker"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    seen, want = {}, []
    spark.createDataFrame([], schema).write.parquet(folder)
    with flags.state_store(spark):
        stream = flags.flag_changes(landed(spark, folder, schema), "10 days", 40 * 86400 * 1000, killed_while(str(marker)))
        for b in range(3):
            batch = rows[b * 30 : b * 30 + 30] + [("k3", T0 + timedelta(days=5 + b), 1000 + b, "x")]
            spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
            for k in {r[0] for r in batch}:
                top = max((r[1], r[2], r[3]) for r in batch if r[0] == k)
                if k not in seen or top > seen[k]:
                    seen[k] = top
                    want.append((k, *top))
            if b == 1:
                marker.touch()
                with pytest.raises(Exception, match="killed"):
                    advance(stream, out, checkpoint)
                marker.unlink()
            advance(stream, out, checkpoint)
    assert sorted(map(tuple, spark.read.schema(schema).parquet(out).collect())) == sorted(want)


def test_idle_state_goes(spark):
    """After the watermark has passed an entity's idle time it starts anew: an older row counts again."""
    rows = [("a", T0 + timedelta(days=9), 1, "x", 0), ("b", T0 + timedelta(days=40), 2, "x", 1), ("a", T0 + timedelta(days=39), 3, "y", 2), ("a", T0 + timedelta(days=38), 4, "z", 3)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, number long, flag string, batch long")
    with flags.state_store(spark):
        got = fed(df, "batch", lambda s: flags.flag_changes(s, "5 days", 10 * 86400 * 1000), "idle")
    assert sorted((r.key, r.flag) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_asof_join(spark):
    rng = random.Random(10)
    left = [(i, rng.choice(["hot", "hot", "a", None]), T0 + timedelta(hours=rng.randrange(300)) if rng.random() < 0.95 else None) for i in range(400)]
    right = sorted({(rng.choice(["hot", "a", "b"]), T0 + timedelta(hours=rng.randrange(300))) for _ in range(60)})
    right = [(k, t, i if i % 5 else None) for i, (k, t) in enumerate(right)]
    l = spark.createDataFrame(left, "id long, k string, t timestamp").repartition(9)  # noqa: E741
    r = spark.createDataFrame(right, "k string, rt timestamp, v long").repartition(7)
    joined = asof_join(l, r, "k", "t", "rt")
    want = []
    for i, k, t in left:
        hits = [(rt, v) for rk, rt, v in right if rk == k and t is not None and rt <= t]
        want.append((i, k, t, *(max(hits, key=lambda h: h[0]) if hits else (None, None))))
    assert sorted(map(repr, map(tuple, joined.collect()))) == sorted(map(repr, want))
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    assert asof_join(l, r.limit(0), "k", "t", "rt").filter("rt IS NOT NULL").count() == 0 and asof_join(l.limit(0), r, "k", "t", "rt").count() == 0


def test_interval_join(spark):
    rng = random.Random(11)
    at = lambda h: T0 + timedelta(hours=h, minutes=rng.choice([0, 30]))
    points = [(i, rng.choice(["hot", "hot", "a", None]), at(rng.randrange(3000)) if rng.random() < 0.95 else None) for i in range(300)]
    spans = [(i, rng.choice(["hot", "a", "b"]), s, s + timedelta(hours=rng.choice([-5, 0, 3, 30, 400, 2900]))) for i in range(80) for s in [at(rng.randrange(3000))]]
    p = spark.createDataFrame(points, "id long, k string, t timestamp")
    s = spark.createDataFrame(spans, "span long, k string, a timestamp, b timestamp")
    got = interval_join(p, s, "k", "t", "a", "b")
    want = sorted((i, n) for i, k, t in points for n, sk, a, b in spans if k == sk and t is not None and a <= t <= b)
    assert sorted((r.id, r.span) for r in got.collect()) == want and len(want) > 500
    assert interval_join(p, s.limit(0), "k", "t", "a", "b").count() == 0


def test_sketches_merge(spark):
    """Sketches of parts, merged, are as near as those made in one pass, and the rows are not needed."""
    g = spark.range(60000).select((F.col("id") % 7).alias("state"), (F.col("id") % 3).alias("tax_year"), (F.xxhash64("id") % 20000).alias("ein"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100000)).alias("amount"))
    kept = rollups.sketches(g, ["state", "tax_year"], "ein", "amount")
    merged = {r.tax_year: r for r in rollups.estimates(rollups.merged(kept, ["tax_year"]), ["tax_year"]).collect()}
    direct = {r.tax_year: r for r in rollups.estimates(rollups.sketches(g, ["tax_year"], "ein", "amount"), ["tax_year"]).collect()}
    exact = {r.tax_year: r.n for r in g.groupBy("tax_year").agg(F.count_distinct("ein").alias("n")).collect()}
    for y, n in exact.items():
        assert abs(merged[y].different - n) < 0.05 * n and abs(direct[y].different - n) < 0.05 * n
        assert 46000 < merged[y].quantile < 54000 and 46000 < direct[y].quantile < 54000


def test_one_reading_of_the_grants(spark):
    for name in ("keyword_points", "focus_points"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") <= 1, name
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in core.all_points(spark, "/root/testdata/sf0.001")]
    assert not any("lineitem.parquet" in p for p in plans)


def test_odd_filings(spark):
    from grantlens.plans.verification import second_profile
    from grantlens.sources.filings import foundations, grants, shred

    body = '<R xmlns="u"><Filer><EIN>00000{}123</EIN></Filer><TaxYr>2020</TaxYr><TotalRevAndExpnssAmt>{}</TotalRevAndExpnssAmt><WebsiteAddressTxt>w{}w</WebsiteAddressTxt>{}</R>'
    group = "<GrantOrContributionPdDurYrGrp><RecipientPersonNm>P</RecipientPersonNm>{}</GrantOrContributionPdDurYrGrp>"
    of = lambda n, revenue="abc", mark="", g="": body.format(n, revenue, mark, g)
    amounts = [("<Amt>0</Amt><Amount>7</Amount>", 7), ("<Amt>-0.5</Amt><Amount>8.9</Amount>", 8), ("<Amt>5</Amt><Amount>7</Amount>", 5), ("<Amt>x</Amt>", 0), ("<Sub><Amt>4</Amt></Sub>", 0)]
    files = [("/1_public.xml", of(1, g="".join(group.format(a) for a, _ in amounts)).encode()), ("/2_public.xml", ('<?xml version="1.0" encoding="foo"?>' + of(2)).encode()), ("/3_public.xml", ('<?xml version="1.0" encoding="shift_jis"?>' + of(3)).encode()),
             ("/4_public.xml", of(4, "12.9", "é").encode("latin-1")), ("/5_public.xml", of(5, "1e3").encode())]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    shredded = shred(df)
    assert {(r.ein, r.revenue) for r in foundations(shredded).collect()} == {("000001123", None), ("000005123", 1000)}
    assert [r.amount for r in grants(shredded).orderBy("id").collect()] == [n for _, n in amounts]
    got = {r.ein: (r.revenue, r.website) for r in second_profile(df).collect()}
    assert got == {"000001123": (None, "ww"), "000002123": (None, "ww"), "000003123": (None, "ww"), "000004123": (12, "ww"), "000005123": (1000, "ww")}
