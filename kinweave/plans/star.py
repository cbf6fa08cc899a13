"""Reference operators applied to the star-schema tables, each with its SQL oracle.

An order stands for a dated family or person (o_orderdate the start), a line for a child or an end event (l_shipdate), a customer
for a person, a nation for a country or surname. QUERIES and ORACLE share their keys; columns have the same names in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import calendar, geo, text
from kinweave.functions.labels import DASH
from kinweave.operators import dates, flow, graph, hist, rank, series
from kinweave.operators.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def order_year() -> F.Column:
    return F.year("o_orderdate")


def first_ship(t: Tables) -> DataFrame:
    """Orders with the day of their first shipment: lines are aggregated before they are joined."""
    ships = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("ship"))
    return t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")).join(ships, "o_orderkey")


FIRST_SHIP = "f AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, ship FROM orders JOIN (SELECT l_orderkey, min(l_shipdate)::DATE AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
YEARS = "(year(greatest(a, b)) - year(least(a, b)) - CASE WHEN month(greatest(a, b)) * 100 + day(greatest(a, b)) < month(least(a, b)) * 100 + day(least(a, b)) THEN 1 ELSE 0 END)"
MONTHS_BETWEEN = "(12 * (year(greatest(a, b)) - year(least(a, b))) + month(greatest(a, b)) - month(least(a, b)) - CASE WHEN day(greatest(a, b)) < day(least(a, b)) THEN 1 ELSE 0 END)"


@query("SELECT ((year(o_orderdate) - 1) // 100 + 1)::BIGINT AS century, count(*) AS n FROM orders GROUP BY 1")
def tally_by_century(t):
    return t.orders.groupBy(long(calendar.century(order_year())).alias("century")).agg(F.count("*").alias("n"))


@query("SELECT (year(o_orderdate) // 10 * 10)::BIGINT AS decade, count(*) AS n FROM orders GROUP BY 1")
def tally_by_decade(t):
    return t.orders.groupBy(long(calendar.decade(order_year())).alias("decade")).agg(F.count("*").alias("n"))


@query("SELECT m.ord, count(o_orderkey) AS n FROM range(1, 13) m(ord) LEFT JOIN orders ON month(o_orderdate) = m.ord GROUP BY 1")
def tally_by_month(t):
    counts = t.orders.groupBy(long(F.month("o_orderdate")).alias("ord")).agg(F.count("*").alias("n"))
    return hist.spine(t.orders, 1, 12).join(counts, "ord", "left").select("ord", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH z AS (SELECT month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)
SELECT CASE WHEN md <= 119 THEN 'Capricornus' WHEN md <= 218 THEN 'Aquarius' WHEN md <= 320 THEN 'Pisces' WHEN md <= 420 THEN 'Aries' WHEN md <= 521 THEN 'Taurus' WHEN md <= 621 THEN 'Gemini'
WHEN md <= 722 THEN 'Cancer' WHEN md <= 822 THEN 'Leo' WHEN md <= 922 THEN 'Virgo' WHEN md <= 1022 THEN 'Libra' WHEN md <= 1122 THEN 'Scorpio' WHEN md <= 1220 THEN 'Sagittarius' ELSE 'Capricornus' END AS sign, count(*) AS n FROM z GROUP BY 1""")
def tally_by_zodiac(t):
    return t.orders.groupBy(calendar.zodiac(F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("sign")).agg(F.count("*").alias("n"))


@query("SELECT year(d)::BIGINT AS year, count(*) AS n, sum(line)::BIGINT AS lines FROM (SELECT l_orderkey, min(l_shipdate) AS d, arg_min(l_linenumber, (l_shipdate, l_linenumber)) AS line FROM lineitem GROUP BY 1) GROUP BY 1")
def event_dates_dedup(t):
    first = dates.earliest_row(t.lineitem, "l_orderkey", F.col("l_shipdate"), "l_shipdate", "l_linenumber")
    return first.groupBy(long(F.year("l_shipdate")).alias("year")).agg(F.count("*").alias("n"), F.sum(long("l_linenumber")).alias("lines"))


@query(f"""SELECT b.ord, CASE WHEN b.ord >= 40 THEN '40+' ELSE b.ord || '{DASH}' || (b.ord + 9) END AS label, count(p_partkey) AS n
FROM range(0, 41, 10) b(ord) LEFT JOIN part ON least(p_size // 10 * 10, 40) = b.ord GROUP BY 1, 2""")
def fixed_hist_overflow(t):
    return hist.fixed_width(t.part, F.col("p_size"), 0, 40, 10)


@query(f"""WITH {FIRST_SHIP}, g AS (SELECT date_diff('day', day, ship) AS d FROM f)
SELECT b.ord, count(*) FILTER (WHERE d > 0) AS left_n, count(*) FILTER (WHERE d < 0) AS right_n FROM range(0, 1801, 300) b(ord) LEFT JOIN g ON least(abs(d) // 300 * 300, 1800) = b.ord GROUP BY 1""")
def two_sided_hist(t):
    return hist.two_sided(first_ship(t), F.datediff("ship", "day"), 300, 1800)


@query(f"""WITH {FIRST_SHIP}, g AS (SELECT {MONTHS_BETWEEN.replace('(a,', '(day,').replace(', b)', ', ship)')} AS m FROM f WHERE ship > day)
SELECT (CASE WHEN m < 6 THEN 0 WHEN m < 12 THEN 1 WHEN m < 24 THEN 2 WHEN m < 36 THEN 3 WHEN m < 48 THEN 4 WHEN m < 60 THEN 5 ELSE 6 END)::BIGINT AS band, count(*) AS n FROM g GROUP BY 1""")
def month_bands(t):
    m = calendar.whole_months(F.col("day"), F.col("ship"))
    band = F.when(m < 6, 0).when(m < 12, 1).when(m < 24, 2).when(m < 36, 3).when(m < 48, 4).when(m < 60, 5).otherwise(6)
    return hist.banded(first_ship(t).where("ship > day"), band)


@query("SELECT (CASE WHEN v <= 10 THEN 1 WHEN v <= 50 THEN 2 WHEN v <= 200 THEN 3 WHEN v <= 500 THEN 4 WHEN v <= 1000 THEN 5 ELSE 6 END)::BIGINT AS band, count(*) AS n FROM (SELECT l_extendedprice / 50 AS v FROM lineitem) GROUP BY 1")
def distance_bands(t):
    return hist.banded(t.lineitem, geo.distance_band(F.col("l_extendedprice") / 50))


@query("SELECT CASE WHEN p_size <= 17 THEN '0–17' WHEN p_size <= 35 THEN '18–35' WHEN p_size <= 65 THEN '36–65' ELSE '65+' END AS band, count(*) AS n FROM part GROUP BY 1")
def life_stage_bands(t):
    size = F.col("p_size")
    return t.part.groupBy(F.when(size <= 17, "0–17").when(size <= 35, "18–35").when(size <= 65, "36–65").otherwise("65+").alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {FIRST_SHIP} SELECT {YEARS.replace('(a,', '(day,').replace(', b)', ', ship)')}::BIGINT AS years, count(*) AS n FROM f GROUP BY 1")
def whole_years_span(t):
    return first_ship(t).groupBy(long(calendar.whole_years(F.col("day"), F.col("ship"))).alias("years")).agg(F.count("*").alias("n"))


@query(f"WITH {FIRST_SHIP} SELECT {MONTHS_BETWEEN.replace('(a,', '(day,').replace(', b)', ', ship)')}::BIGINT AS months, count(*) AS n FROM f GROUP BY 1")
def whole_months_span(t):
    return first_ship(t).groupBy(long(calendar.whole_months(F.col("day"), F.col("ship"))).alias("months")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, min(l_shipdate) FILTER (WHERE l_shipdate > o_orderdate) AS first_after FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def earliest_after(t):
    rows = t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    return rows.groupBy("o_orderkey").agg(F.min(dates.earliest_after(F.col("o_orderdate"), F.col("l_shipdate"))).alias("first_after"))


@query(f"WITH {FIRST_SHIP} SELECT year(day)::BIGINT AS year, (o_custkey % 2)::BIGINT AS side, count(*) AS n, CASE WHEN count(*) >= 120 THEN round(avg(date_diff('day', day, ship)), 1) END AS mean FROM f WHERE ship > day GROUP BY 1, 2")
def mean_by_cohort_floor(t):
    rows = first_ship(t).where("ship > day").groupBy(long(F.year("day")).alias("year"), long(F.col("o_custkey") % 2).alias("side"))
    return rows.agg(F.count("*").alias("n"), F.when(F.count("*") >= 120, F.round(F.avg(F.datediff("ship", "day")), 1)).alias("mean"))


@query(f"""WITH {FIRST_SHIP}, g AS (SELECT year(day)::BIGINT AS year, date_diff('day', day, ship) AS d FROM f WHERE ship > day)
SELECT year, s.days, round(100.0 * count(*) FILTER (WHERE d >= s.days) / count(*), 1) AS share FROM g, range(0, 101, 10) s(days) GROUP BY 1, 2 HAVING count(*) >= 30""")
def survival_by_cohort(t):
    steps = range(0, 101, 10)
    rows = first_ship(t).where("ship > day").groupBy(long(F.year("day")).alias("year"))
    d = F.datediff("ship", "day")
    wide = rows.agg(F.count("*").alias("n"), *(F.sum((d >= s).cast("long")).alias(f"s{s}") for s in steps)).where("n >= 30")
    return wide.select("year", F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("days"), F.round(F.col(f"s{s}") * 100.0 / F.col("n"), 1).alias("share")) for s in steps))).alias("x")).select("year", "x.days", "x.share")


@query(f"WITH {FIRST_SHIP} SELECT year(day)::BIGINT AS year, count(*) AS n, quantile_disc(date_diff('day', day, ship), 0.5)::BIGINT AS median, min(date_diff('day', day, ship))::BIGINT AS low, max(date_diff('day', day, ship))::BIGINT AS high FROM f GROUP BY 1 HAVING count(*) >= 5")
def raw_samples_by_cohort(t):
    d = F.datediff("ship", "day")
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY days)")  # counts of distinct days, not lists of rows
    rows = first_ship(t).select(long(F.year("day")).alias("year"), d.alias("days")).groupBy("year")
    return rows.agg(F.count("*").alias("n"), long(middle).alias("median"), long(F.min("days")).alias("low"), long(F.max("days")).alias("high")).where("n >= 5")


@query(f"""WITH {FIRST_SHIP}, g AS (SELECT year(day)::BIGINT AS year, o_custkey % 2 AS side, least(date_diff('day', day, ship) // 300 * 300, 1800) AS band FROM f WHERE ship >= day)
SELECT y.year, b.ord, count(*) FILTER (WHERE side = 0) AS left_n, count(*) FILTER (WHERE side = 1) AS right_n FROM (SELECT DISTINCT year FROM g) y CROSS JOIN range(0, 1801, 300) b(ord) LEFT JOIN g ON g.year = y.year AND g.band = b.ord GROUP BY 1, 2""")
def pyramid(t):
    band = long(F.least(F.floor(F.datediff("ship", "day") / 300) * 300, F.lit(1800)))
    counts = first_ship(t).where("ship >= day").groupBy(long(F.year("day")).alias("year"), band.alias("ord")).agg(F.sum((F.col("o_custkey") % 2 == 0).cast("long")).alias("left_n"), F.sum((F.col("o_custkey") % 2 == 1).cast("long")).alias("right_n"))
    # One row a cohort and band: the spine is bands x cohorts, both bounded by the calendar.
    spine = counts.select("year").distinct().select("year", F.explode(F.sequence(F.lit(0), F.lit(1800), F.lit(300)).cast("array<bigint>")).alias("ord"))
    return spine.join(counts, ["year", "ord"], "left").fillna(0, ["left_n", "right_n"])


@query("""WITH e AS (SELECT year(o_orderdate) // 25 * 25 AS p, month(o_orderdate) AS m FROM orders), s AS (SELECT unnest(range(min(p), max(p) + 1, 25)) AS p FROM e)
SELECT s.p::BIGINT AS period, c.m AS month, count(e.m) AS n FROM s CROSS JOIN range(1, 13) c(m) LEFT JOIN e ON e.p = s.p AND e.m = c.m GROUP BY 1, 2""")
def heatmap_period_month(t):
    ends = t.orders.agg(F.min(order_year()), F.max(order_year())).first()
    width = calendar.pick_period(*ends) if ends[0] is not None else calendar.PERIODS[0]
    counts = t.orders.groupBy(long(calendar.period_start(order_year(), width)).alias("period"), long(F.month("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))
    periods = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("period"))
    spine = periods.select("period", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<bigint>")).alias("month"))
    return spine.join(counts, ["period", "month"], "left").fillna(0, ["n"])


@query("SELECT CASE WHEN count(*) >= 12 THEN round((count(*) FILTER (WHERE month(o_orderdate) IN (12, 1, 2)) / 3.0) / (count(*) / 12.0), 2) END AS score, count(*) FILTER (WHERE month(o_orderdate) IN (12, 1, 2)) AS season, count(*) AS total FROM orders")
def winter_peak(t):
    winter = F.sum(F.month("o_orderdate").isin(12, 1, 2).cast("long"))
    row = t.orders.agg(winter.alias("season"), F.count("*").alias("total"))
    return row.select(F.when(F.col("total") >= 12, F.round((F.col("season") / 3.0) / (F.col("total") / 12.0), 2)).alias("score"), F.coalesce("season", F.lit(0)).alias("season"), "total")


@query(f"WITH {FIRST_SHIP} SELECT year(day)::BIGINT AS year, count(*) AS total, count(*) FILTER (WHERE date_diff('day', day, ship) < 60) AS hit, round(100.0 * count(*) FILTER (WHERE date_diff('day', day, ship) < 60) / count(*), 1) AS rate FROM f WHERE ship >= day GROUP BY 1 HAVING count(*) >= 5")
def under_threshold_rate(t):
    hit = F.sum((F.datediff("ship", "day") < 60).cast("long"))
    rows = first_ship(t).where("ship >= day").groupBy(long(F.year("day")).alias("year")).agg(F.count("*").alias("total"), hit.alias("hit")).where("total >= 5")
    return rows.withColumn("rate", F.round(F.col("hit") * 100.0 / F.col("total"), 1))


@query("""WITH d AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1),
c AS (SELECT (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::BIGINT AS cohort, count(*) AS total, sum(coalesce(r, 0))::BIGINT AS hit FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY 1),
q AS (SELECT min(cohort) AS a, max(cohort) AS b FROM c WHERE hit >= 1 AND total >= greatest(3, (SELECT sum(total) FROM c) // 100))
SELECT cohort, total, hit, round(hit / total, 4) AS rate FROM c, q WHERE cohort BETWEEN a AND b""")
def cohort_rate_window(t):
    hit = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_returnflag") == "R").cast("long")).alias("r"))
    cohort = long(order_year() * 4 + F.quarter("o_orderdate") - 1)
    c = t.orders.select("o_orderkey", cohort.alias("cohort")).join(hit, "o_orderkey", "left").groupBy("cohort").agg(F.count("*").alias("total"), F.sum(F.coalesce("r", F.lit(0))).alias("hit"))
    floor = c.agg(F.greatest(F.lit(3), F.floor(F.sum("total") / 100)).alias("floor"))
    cut = hist.slice_between(c.crossJoin(F.broadcast(floor)), "cohort", (F.col("hit") >= 1) & (F.col("total") >= F.col("floor")))
    return cut.select("cohort", "total", "hit", F.round(F.col("hit") / F.col("total"), 4).alias("rate"))


MONTHLY = "m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS period, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(range(min(period), max(period) + 1)) AS period FROM m), d AS (SELECT s.period, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (period))"


def monthly(t) -> DataFrame:
    period = long(order_year() * 12 + F.month("o_orderdate") - 1)
    return series.dense(t.orders.groupBy(period.alias("period")).agg(F.count("*").alias("n")), "period", "n")


@query(f"""WITH {MONTHLY}, w AS (SELECT period, n, quantile_disc(n, 0.5) OVER x AS baseline, stddev_pop(n) OVER x AS sd, count(*) OVER x AS k FROM d WINDOW x AS (ORDER BY period ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT period, n, baseline::BIGINT AS baseline, round(n / baseline, 4) AS multiplier, round((n - baseline) / sd, 4) AS z_score FROM w WHERE k = 11 AND baseline >= 2 AND sd > 0 AND (n - baseline) / sd >= 1 ORDER BY (n - baseline) / sd DESC, period LIMIT 10""")
def anomalies_zscore(t):
    return series.anomalies(monthly(t), "period", "n", z=1.0).withColumns({"multiplier": F.round("multiplier", 4), "z_score": F.round("z_score", 4)})


@query(f"WITH {MONTHLY} SELECT period, n, sum(n) OVER (ORDER BY period)::BIGINT AS running FROM d")
def running_total(t):
    return series.running_total(monthly(t), "period", "n")


@query("""WITH g AS (SELECT date_diff('day', lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate::DATE) AS d FROM orders)
SELECT b.ord, CASE WHEN b.ord >= 360 THEN '360+' ELSE b.ord || '–' || (b.ord + 29) END AS label, count(d) AS n FROM range(0, 361, 30) b(ord) LEFT JOIN g ON least(d // 30 * 30, 360) = b.ord GROUP BY 1, 2""")
def lag_gap_hist(t):
    rows = series.gaps(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")
    return hist.fixed_width(rows, F.datediff("o_orderdate", F.col("before.o_orderdate")), 0, 360, 30)


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders), s AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1)
SELECT (date_diff('day', last_ship::DATE, o_orderdate::DATE) // 100)::BIGINT AS band, count(*) AS n FROM o JOIN s ON l_orderkey = prev WHERE last_ship <= o_orderdate GROUP BY 1""")
def lag_prev_attr(t):
    rows = series.gaps(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderdate", F.col("before.o_orderkey").alias("prev")).where("prev is not null")
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("prev")).agg(F.max("l_shipdate").alias("last_ship"))
    return rows.join(last, "prev").where("last_ship <= o_orderdate").groupBy(long(F.floor(F.datediff("o_orderdate", "last_ship") / 100)).alias("band")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts)::BIGINT AS sec FROM events), r AS (SELECT user_id, min(sec) AS anchor FROM e GROUP BY 1
UNION ALL SELECT r.user_id, (SELECT min(sec) FROM e WHERE e.user_id = r.user_id AND sec > r.anchor + 3600) FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = r.user_id AND sec > r.anchor + 3600))
SELECT size, count(*) AS n FROM (SELECT r.user_id, r.anchor, count(*) AS size FROM r JOIN e ON e.user_id = r.user_id AND e.sec BETWEEN r.anchor AND r.anchor + 3600 GROUP BY 1, 2) GROUP BY 1""")
def anchored_clusters(t):
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)  # the nearest, of two the even one, as the cast of the SQL rounds
    sets = series.anchored_clusters(t.events, "user_id", second, 3600)
    return sets.groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, lower(p_type)) AS ord, arg_min(p_type, p_partkey) AS label, count(*) AS n FROM part GROUP BY lower(p_type) ORDER BY n DESC, lower(p_type) LIMIT 20")
def topn_fold(t):
    counts = rank.folded_counts(t.part, F.col("p_type"), F.col("p_partkey"))
    return rank.top(counts, 20, F.col("n").desc(), F.col("key")).select("ord", "label", "n")


TOKENS = "k AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part), kept AS (SELECT * FROM k WHERE length(token) > 3)"


def name_tokens(t) -> DataFrame:
    return t.part.select("p_partkey", F.explode(text.given_tokens(F.col("p_name"))).alias("token")).distinct()


@query(f"WITH {TOKENS} SELECT row_number() OVER (ORDER BY count(*) DESC, token) AS ord, token, count(*) AS n FROM kept GROUP BY token ORDER BY n DESC, token LIMIT 15")
def token_topn(t):
    return rank.top(name_tokens(t).groupBy("token").agg(F.count("*").alias("n")), 15, F.col("n").desc(), F.col("token")).select("ord", "token", "n")


USES = f"{TOKENS}, u AS (SELECT token, year(o_orderdate)::BIGINT AS year FROM kept JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey), best AS (SELECT token FROM u GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 5)"


def token_uses(t) -> DataFrame:
    """Token and order year of every line: the lines meet orders once, and tokens by part."""
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), long(order_year()).alias("year")), "l_orderkey")
    by_part = lines.groupBy("l_partkey", "year").agg(F.count("*").alias("n"))
    return name_tokens(t).join(by_part.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey").groupBy("token", "year").agg(F.sum("n").alias("n"))


@query(f"""WITH {USES}, s AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM u JOIN best USING (token)) SELECT best.token, s.year, count(u.year) AS n FROM best CROSS JOIN s LEFT JOIN u ON u.token = best.token AND u.year = s.year GROUP BY 1, 2""")
def name_trend(t):
    uses = written(token_uses(t), "uses")  # one row a token and year
    best = uses.groupBy("token").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "token").limit(5).select("token")
    kept = uses.join(F.broadcast(best), "token")
    ends = kept.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return best.crossJoin(F.broadcast(ends)).join(kept, ["token", "year"], "left").fillna(0, ["n"]).select("token", "year", "n")


@query(f"WITH {USES} SELECT token, max(year) AS last_year, max(year) >= 2000 AS active FROM u JOIN best USING (token) GROUP BY 1")
def last_year_by_name(t):
    sums = token_uses(t).groupBy("token").agg(F.sum("n").alias("total"), F.max("year").alias("last_year"))
    return sums.orderBy(F.col("total").desc(), "token").limit(5).select("token", "last_year", (F.col("last_year") >= 2000).alias("active"))


TRADES = "p AS (SELECT o_orderkey, cn.n_name AS a, sn.n_name AS b, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey)"


def trades(t) -> DataFrame:
    """o_orderkey, l_linenumber, year, a (customer's nation), b (supplier's). Nations are 25 rows; the rest joins by key."""
    buyers = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("a"))
    sellers = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("b"))
    of_order = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", long(order_year()).alias("year"), "a")
    return t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber").join(of_order, "o_orderkey").join(sellers, "l_suppkey")


@query(f"""WITH {TRADES}, tot AS (SELECT label, count(*) AS n FROM (SELECT a AS label FROM p UNION ALL SELECT b FROM p WHERE a <> b) GROUP BY 1), best AS (SELECT label FROM tot ORDER BY n DESC, label LIMIT 8),
c AS (SELECT a AS r, b AS c FROM p UNION ALL SELECT b, a FROM p WHERE a <> b) SELECT x.label AS row_label, y.label AS col_label, count(c.r) AS n FROM best x CROSS JOIN best y LEFT JOIN c ON c.r = x.label AND c.c = y.label GROUP BY 1, 2""")
def pair_matrix(t):
    return flow.pair_matrix(trades(t), "a", "b", 8)


@query(f"""WITH {TRADES}, f AS (SELECT a, b, count(*) AS weight, min((o_orderkey, l_linenumber)) AS first FROM p WHERE a <> b GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (ORDER BY weight DESC, first, a, b) AS ord FROM f ORDER BY ord LIMIT 15),
s AS (SELECT a, row_number() OVER (ORDER BY min(ord)) - 1 AS source_node FROM top GROUP BY 1), d AS (SELECT b, row_number() OVER (ORDER BY min(ord)) - 1 + (SELECT count(*) FROM s) AS target_node FROM top GROUP BY 1),
k AS (SELECT a, b, o_orderkey, row_number() OVER (PARTITION BY a, b ORDER BY o_orderkey, l_linenumber) AS i FROM p WHERE a <> b AND o_orderkey % 2 = 0)
SELECT top.ord, top.a AS source, top.b AS target, source_node, target_node, weight, coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY i) FROM k WHERE k.a = top.a AND k.b = top.b AND i <= 3), '') AS samples FROM top JOIN s USING (a) JOIN d USING (b)""")
def flow_topk(t):
    rows = trades(t).where("a <> b")
    return flow.flows(rows, "a", "b", F.struct("o_orderkey", "l_linenumber"), F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 2 == 0, 15)


@query(f"WITH {TRADES}, y AS (SELECT year(o_orderdate)::BIGINT AS year, a, b FROM p JOIN orders USING (o_orderkey)) SELECT year, count(*) AS total, count(*) FILTER (WHERE list_has_any(string_split(a, ' '), string_split(b, ' '))) AS hit, round(100.0 * count(*) FILTER (WHERE list_has_any(string_split(a, ' '), string_split(b, ' '))) / count(*), 1) AS rate FROM y GROUP BY 1 HAVING count(*) >= 10")
def overlap_rate(t):
    hit = F.arrays_overlap(F.split("a", " "), F.split("b", " "))
    rows = trades(t).groupBy("year").agg(F.count("*").alias("total"), F.sum(hit.cast("long")).alias("hit")).where("total >= 10")
    return rows.withColumn("rate", F.round(F.col("hit") * 100.0 / F.col("total"), 1))


@query("""WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_partkey % 2 = 0) AS sons, count(*) FILTER (WHERE l_partkey % 2 = 1) AS daughters FROM lineitem GROUP BY 1)
SELECT row_number() OVER (ORDER BY greatest(sons, daughters)::DOUBLE / (sons + daughters) DESC, sons + daughters DESC, l_orderkey) AS ord, l_orderkey, sons, daughters, sons + daughters AS total FROM g WHERE sons + daughters >= 4 AND greatest(sons, daughters) >= 0.8 * (sons + daughters) ORDER BY 1 LIMIT 10""")
def sex_ratio_skew(t):
    even = F.sum((F.col("l_partkey") % 2 == 0).cast("long"))
    rows = t.lineitem.groupBy("l_orderkey").agg(even.alias("sons"), (F.count("*") - even).alias("daughters"))
    kept = rank.skewed(rows, "l_orderkey", "sons", "daughters", 4, 0.8)
    return rank.top(kept, 10, F.col("skew").desc(), F.col("total").desc(), F.col("l_orderkey")).select("ord", "l_orderkey", "sons", "daughters", "total")


@query(f"""WITH {FIRST_SHIP}, g AS (SELECT o_orderkey, date_diff('day', day, ship)::BIGINT AS days FROM f WHERE ship > day), s AS (SELECT *, row_number() OVER (ORDER BY days, o_orderkey) AS ord, 'short' AS side FROM g ORDER BY ord LIMIT 3),
l AS (SELECT *, row_number() OVER (ORDER BY days DESC, o_orderkey DESC) AS ord, 'long' AS side FROM g WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) ORDER BY ord LIMIT 3) SELECT o_orderkey, days, ord, side FROM s UNION ALL SELECT o_orderkey, days, ord, side FROM l""")
def two_ended_topk(t):
    return rank.two_ended(first_ship(t).where("ship > day").select("o_orderkey", long(F.datediff("ship", "day")).alias("days")), "days", "o_orderkey", 3)


@query(f"""WITH {FIRST_SHIP}, g AS (SELECT o_orderkey, date_diff('day', day, ship)::BIGINT AS days FROM f WHERE ship > day) SELECT * FROM (SELECT 'youngest' AS slot, days AS value, o_orderkey AS key FROM g ORDER BY days, o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'oldest', days, o_orderkey FROM g ORDER BY days DESC, o_orderkey LIMIT 1)""")
def record_holder(t):
    rows = first_ship(t).where("ship > day")
    days = long(F.datediff("ship", "day"))
    one = lambda name, largest: rank.record_holder(rows, days, F.col("o_orderkey"), largest).select(F.lit(name).alias("slot"), "value", "key")
    return one("youngest", False).unionByName(one("oldest", True))


@query("""WITH k AS (SELECT l_orderkey, year(l_shipdate)::BIGINT AS year, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT year, sum(n)::BIGINT AS siblings, count(*) AS families FROM k GROUP BY 1 HAVING count(*) >= 2""")
def sibling_clusters(t):
    late = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").where("l_shipdate > o_orderdate")
    k = late.groupBy("l_orderkey", long(F.year("l_shipdate")).alias("year")).agg(F.count("*").alias("n")).where("n >= 2")
    return k.groupBy("year").agg(F.sum("n").alias("siblings"), F.count("*").alias("families")).where("families >= 2")


@query("SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')) AS value, count(*) AS total FROM customer")
def semi_coverage(t):
    urgent = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(urgent, "c_custkey", "left_semi").agg(F.count("*").alias("value")).crossJoin(t.customer.agg(F.count("*").alias("total")))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') GROUP BY 1")
def anti_living(t):
    urgent = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_custkey, max(CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT CASE best WHEN 3 THEN 'Married' WHEN 2 THEN 'Divorced' WHEN 1 THEN 'Widowed' ELSE 'Single' END AS bucket, count(*) AS n FROM s GROUP BY 1""")
def marital_classify(t):
    status = F.col("o_orderstatus")
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(status == "O", 3).when(status == "P", 2).when(status == "F", 1).otherwise(0)).alias("best"))
    bucket = F.when(F.col("best") == 3, "Married").when(F.col("best") == 2, "Divorced").when(F.col("best") == 1, "Widowed").otherwise("Single")
    return t.customer.select("c_custkey").join(best, "c_custkey", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE d.text IS NULL OR trim(d.text) = '') AS no_text, count(*) FILTER (WHERE d.lang IS NULL OR d.lang = '') AS no_lang, count(*) FILTER (WHERE l.doc_id IS NULL) AS no_label, count(*) FILTER (WHERE d.n_chars <> length(d.text)) AS odd_length
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_gaps(t):
    rows = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    n = lambda condition, name: F.sum(F.coalesce(condition, F.lit(False)).cast("long")).alias(name)
    c = F.col
    return rows.agg(F.count("*").alias("total"), n(c("text").isNull() | (F.trim("text") == ""), "no_text"), n(c("lang").isNull() | (c("lang") == ""), "no_lang"), n(c("has").isNull(), "no_label"), n(c("n_chars") != F.length("text"), "odd_length"))


BLOB = "b AS (SELECT c_custkey, '0 @I' || c_custkey || '@ INDI' || chr(10) || '1 BIRT' || chr(10) || '2 DATE 1 JAN ' || (1800 + c_custkey % 200) || chr(10) || '2 PLAC Town' || (c_custkey % 7) || ', ' || c_mktsegment || chr(10) || '1 OCCU ' || c_mktsegment || chr(10) || '1 OCCU Smith' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '1 DEAT Y' ELSE '' END AS g FROM customer)"


def blobs(t) -> DataFrame:
    key, nl = F.col("c_custkey"), F.lit("\n")
    parts = [F.lit("0 @I"), key, F.lit("@ INDI"), nl, F.lit("1 BIRT"), nl, F.lit("2 DATE 1 JAN "), 1800 + key % 200, nl, F.lit("2 PLAC Town"), key % 7, F.lit(", "), F.col("c_mktsegment"), nl, F.lit("1 OCCU "), F.col("c_mktsegment"), nl, F.lit("1 OCCU Smith"), F.when(key % 3 == 0, F.lit("\n1 DEAT Y")).otherwise("")]
    return t.customer.select("c_custkey", F.concat(*(p.cast("string") for p in parts)).alias("g"))


@query(f"WITH {BLOB} SELECT occu, count(*) AS n FROM (SELECT unnest(regexp_extract_all(g, '1 OCCU ([^\\n]*)', 1)) AS occu FROM b) GROUP BY 1")
def text_extract_all(t):
    return blobs(t).select(F.explode(text.tag_values(F.col("g"), "OCCU")).alias("occu")).groupBy("occu").agg(F.count("*").alias("n"))


@query(f"WITH {BLOB} SELECT regexp_extract(g, '2 PLAC ([^\\n]*)', 1) AS place, min(regexp_extract(g, '2 DATE 1 JAN ([0-9]+)', 1)::BIGINT) AS first_year, count(*) FILTER (WHERE g LIKE '%1 DEAT%') AS dead, count(*) AS n FROM b GROUP BY 1")
def text_block_first(t):
    g = F.col("g")
    return blobs(t).groupBy(text.event_place(g, "BIRT").alias("place")).agg(F.min(long(text.event_year_of_text(g, "BIRT"))).alias("first_year"), F.sum(text.has_tag(g, "DEAT").cast("long")).alias("dead"), F.count("*").alias("n"))


@query("SELECT event_type, sum((props ->> '$.k')::BIGINT)::BIGINT AS total, count(props ->> '$.k') AS n FROM events GROUP BY 1")
def json_prop(t):
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.sum(long(k)).alias("total"), F.count(k).alias("n"))


@query("""WITH g AS (SELECT n_nationkey * 7.0 - 60 AS lat, n_nationkey * 13.0 - 150 AS lng FROM nation), q AS (SELECT x.lat AS a, x.lng AS b, y.lat AS c, y.lng AS d FROM g x JOIN g y ON x.lat < y.lat),
h AS (SELECT 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))) AS km FROM q)
SELECT (CASE WHEN km <= 10 THEN 1 WHEN km <= 50 THEN 2 WHEN km <= 200 THEN 3 WHEN km <= 500 THEN 4 WHEN km <= 1000 THEN 5 ELSE 6 END)::BIGINT AS band, count(*) AS n, round(min(km), 3) AS nearest FROM h GROUP BY 1""")
def haversine_bands(t):
    at = t.nation.select((F.col("n_nationkey") * 7.0 - 60).alias("lat"), (F.col("n_nationkey") * 13.0 - 150).alias("lng"))
    pairs = at.join(F.broadcast(at.select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))), F.col("lat") < F.col("lat2"))  # 25 nations
    rows = pairs.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")))
    return rows.groupBy(long(geo.distance_band(F.col("km"))).alias("band")).agg(F.count("*").alias("n"), F.round(F.min("km"), 3).alias("nearest"))


@query("SELECT places, count(*) AS n FROM (SELECT l_orderkey, least(count(DISTINCT year(l_shipdate)), 5) AS places FROM lineitem GROUP BY 1) GROUP BY 1")
def distinct_places(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.least(F.countDistinct(F.year("l_shipdate")), F.lit(5)).alias("places")).groupBy("places").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS record, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def inventory_counts(t):
    one = lambda name: getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("record"), "n")
    return one("customer").unionByName(one("orders")).unionByName(one("part")).unionByName(one("supplier"))


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, event_type) AS ord, event_type, count(*) AS n FROM events GROUP BY event_type")
def type_counts(t):
    return rank.top(t.events.groupBy("event_type").agg(F.count("*").alias("n")), 0, F.col("n").desc(), F.col("event_type")).select("ord", "event_type", "n")


QUANTITY = "q AS (SELECT b.ord, count(l_quantity) AS n FROM range(0, 101, 5) b(ord) LEFT JOIN lineitem ON floor(l_quantity / 5) * 5 = b.ord GROUP BY 1)"


def quantities(t) -> DataFrame:
    return hist.fixed_width(t.lineitem, F.col("l_quantity"), 0, 100, 5).select("ord", "n")


@query(f"WITH {QUANTITY}, e AS (SELECT min(ord) FILTER (WHERE n > 0) AS a, max(ord) FILTER (WHERE n > 0) AS b FROM q) SELECT ord, n FROM q, e WHERE ord BETWEEN a AND b")
def trim_zero_ends(t):
    return hist.drop_zero_ends(quantities(t), "ord", "n")


@query(f"""WITH {FIRST_SHIP}, g AS (SELECT date_diff('day', day, ship) AS d, o_custkey % 2 AS s FROM f), h AS (SELECT b.ord, count(*) FILTER (WHERE s = 0) AS a_n, count(*) FILTER (WHERE s = 1) AS b_n FROM range(0, 9001, 500) b(ord) LEFT JOIN g ON d // 500 * 500 = b.ord AND d >= 0 GROUP BY 1),
e AS (SELECT min(ord) FILTER (WHERE a_n + b_n > 0) AS a, max(ord) FILTER (WHERE a_n + b_n > 0) AS b FROM h) SELECT ord, a_n, b_n FROM h, e WHERE ord BETWEEN a AND b""")
def co_trim(t):
    d = F.datediff("ship", "day")
    side = lambda k, name: hist.fixed_width(first_ship(t).where(F.col("o_custkey") % 2 == k), d, 0, 9000, 500).select("ord", F.col("n").alias(name))
    return hist.drop_zero_ends(side(0, "a_n").join(side(1, "b_n"), "ord"), "ord", "a_n", "b_n")


@query("""WITH h AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS ord, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT r.ratio, min(ord) AS a, max(ord) AS b FROM h, (SELECT unnest([0.01, 0.02, 0.05, 0.10, 0.20]::DOUBLE[]) AS ratio) r WHERE n >= r.ratio * (SELECT max(n) FROM h) GROUP BY 1),
c AS (SELECT k.ratio, a, b, count(*) AS m FROM k JOIN h ON ord BETWEEN a AND b GROUP BY 1, 2, 3), p AS (SELECT coalesce(min(ratio) FILTER (WHERE m <= 80), 0.20) AS ratio FROM c) SELECT ord, n FROM h, c WHERE c.ratio = (SELECT ratio FROM p) AND ord BETWEEN a AND b AND (SELECT count(*) FROM h) > 80 UNION ALL SELECT ord, n FROM h WHERE (SELECT count(*) FROM h) <= 80""")
def outlier_cap(t):
    months = t.lineitem.groupBy(long(F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("ord")).agg(F.count("*").alias("n"))
    return hist.cap_by_trim(months, "ord", "n", 80)


@query(f"WITH {MONTHLY}, k AS (SELECT period, n, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS rows FROM d), z AS (SELECT *, CASE WHEN ceil(rows / 24.0) <= 1 THEN 1 WHEN ceil(rows / 24.0) <= 2 THEN 2 WHEN ceil(rows / 24.0) <= 5 THEN 5 WHEN ceil(rows / 24.0) <= 10 THEN 10 WHEN ceil(rows / 24.0) <= 20 THEN 20 WHEN ceil(rows / 24.0) <= 50 THEN 50 ELSE 100 END AS step FROM k) SELECT (i // step)::BIGINT AS chunk, min(period) AS low, max(period) AS high, sum(n)::BIGINT AS n FROM z GROUP BY 1")
def collapse_bins(t):
    return hist.collapse(monthly(t), "period", "n", 24)


@query("WITH h AS (SELECT l_quantity::BIGINT AS ord, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS rows FROM h), s AS (SELECT *, CASE WHEN ceil(rows / 24.0) <= 1 THEN 1 WHEN ceil(rows / 24.0) <= 5 THEN 5 WHEN ceil(rows / 24.0) <= 10 THEN 10 WHEN ceil(rows / 24.0) <= 25 THEN 25 WHEN ceil(rows / 24.0) <= 50 THEN 50 ELSE 100 END AS step FROM k) SELECT (i // step)::BIGINT AS chunk, min(ord) AS low, max(ord) AS high, sum(n)::BIGINT AS n FROM s GROUP BY 1")
def compress_fives(t):
    counts = t.lineitem.groupBy(long("l_quantity").alias("ord")).agg(F.count("*").alias("n"))
    return hist.collapse(counts, "ord", "n", 24, hist.CHUNK_STEPS)


# Synthetic kinship: the parents of customer c are c // 2 and c // 3, offered by families c and c + 1 (the second knows one less).
CANDIDATES = "cand AS (SELECT c_custkey AS child, c_custkey AS family, nullif(c_custkey // 2, 0) AS father, nullif(c_custkey // 3, 0) AS mother FROM customer UNION ALL SELECT c_custkey, c_custkey + 1, nullif(c_custkey // 2, 0), NULL FROM customer WHERE c_custkey % 5 = 0)"
PARENTS = f"{CANDIDATES}, pm AS (SELECT child, father, CASE WHEN mother = father THEN NULL ELSE mother END AS mother FROM (SELECT child, arg_min(father, rk) AS father, arg_min(mother, rk) AS mother FROM (SELECT *, CASE WHEN father = child THEN 0 ELSE 1 END AS ok, (-((father IS NOT NULL)::INT + (mother IS NOT NULL AND mother IS DISTINCT FROM father)::INT), family) AS rk FROM cand) GROUP BY 1) WHERE father IS NOT NULL OR mother IS NOT NULL), pe AS (SELECT DISTINCT child, parent FROM (SELECT child, father AS parent FROM pm UNION ALL SELECT child, mother FROM pm) WHERE parent IS NOT NULL)"


def parents(t) -> DataFrame:
    c = F.col("c_custkey")
    part = lambda k: F.nullif(F.floor(c / k), F.lit(0))
    one = t.customer.select(c.alias("child"), c.alias("family"), part(2).alias("father"), part(3).alias("mother"))
    two = t.customer.where(c % 5 == 0).select(c.alias("child"), (c + 1).alias("family"), part(2).alias("father"), F.lit(None).cast("long").alias("mother"))
    return graph.parent_map(one.unionByName(two))


@query(f"WITH {PARENTS} SELECT child, father, mother FROM pm")
def parent_map(t):
    return parents(t)


ANCESTORS = f"{PARENTS}, a1 AS (SELECT DISTINCT child AS person, parent AS anc FROM pe), a2 AS (SELECT DISTINCT person, parent AS anc FROM a1 JOIN pe ON child = anc), a3 AS (SELECT DISTINCT person, parent AS anc FROM a2 JOIN pe ON child = anc), a4 AS (SELECT DISTINCT person, parent AS anc FROM a3 JOIN pe ON child = anc), an AS (SELECT person, 1 AS gen, anc FROM a1 UNION ALL SELECT person, 2, anc FROM a2 UNION ALL SELECT person, 3, anc FROM a3 UNION ALL SELECT person, 4, anc FROM a4)"


@query(f"WITH {ANCESTORS}, k AS (SELECT c_custkey, count(anc) AS known FROM customer LEFT JOIN an ON person = c_custkey GROUP BY 1) SELECT known, count(*) AS n FROM k GROUP BY 1")
def ancestor_bands(t):
    persons = t.customer.select(F.col("c_custkey").alias("person"))
    return graph.completeness(parents(t), persons, 4).groupBy("known").agg(F.count("*").alias("n"))


@query(f"WITH {ANCESTORS}, k AS (SELECT person, gen, count(*) AS n FROM an GROUP BY 1, 2) SELECT round((SELECT sum(n / pow(2.0, gen) / 4) FROM k) / count(*), 4) AS value FROM customer")
def completeness(t):
    persons = t.customer.select(F.col("c_custkey").alias("person"))
    return graph.completeness(parents(t), persons, 4).agg(F.round(F.avg("share"), 4).alias("value"))


@query(f"""WITH {ANCESTORS}, c AS (SELECT o_orderkey AS couple, o_custkey AS a, o_custkey + 7 AS b FROM orders), k AS (SELECT * FROM c WHERE a IN (SELECT child FROM pm) AND b IN (SELECT child FROM pm)), h AS (SELECT DISTINCT couple FROM k JOIN an x ON x.person = a JOIN an y ON y.person = b AND y.anc = x.anc)
SELECT count(*) AS total, count(h.couple) AS endogamous, round(100.0 * count(h.couple) / count(*), 1) AS rate FROM k LEFT JOIN h USING (couple)""")
def endogamy(t):
    couples = t.orders.select(F.col("o_orderkey").alias("couple"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + 7).alias("b"))
    rows = graph.shared_ancestry(couples, parents(t), 4).agg(F.count("*").alias("total"), F.sum(F.col("endogamous").cast("long")).alias("endogamous"))
    return rows.withColumn("rate", F.round(F.col("endogamous") * 100.0 / F.col("total"), 1))


def kin_edges(t) -> DataFrame:
    return graph.parent_edges(parents(t)).select("parent", "child")


@query(f"WITH RECURSIVE {PARENTS}, r AS (SELECT parent AS node, 0 AS d FROM pe UNION SELECT child, 0 FROM pe UNION SELECT pe.parent, r.d + 1 FROM r JOIN pe ON pe.child = r.node) SELECT depth, count(*) AS n FROM (SELECT node, max(d)::BIGINT AS depth FROM r GROUP BY 1) GROUP BY 1")
def generation_depth(t):
    return graph.depths(kin_edges(t)).groupBy(long("depth").alias("depth")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {PARENTS}, r AS (SELECT parent AS a, child AS p FROM pe UNION SELECT r.a, pe.child FROM r JOIN pe ON pe.parent = r.p) SELECT row_number() OVER (ORDER BY count(*) DESC, a) AS ord, a AS ancestor, count(*) AS n FROM r WHERE a <> p GROUP BY a ORDER BY n DESC, a LIMIT 10")
def descendants_topk(t):
    return rank.top(graph.top_descendants(kin_edges(t), 10), 10, F.col("n").desc(), F.col("ancestor")).select("ord", "ancestor", "n")


def ties(t) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.where((c % 7 != 0) & (c > 1)).select(c.alias("u"), F.floor(c / 2).alias("v"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS u, c_custkey // 2 AS v FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey > 1), up AS (SELECT c_custkey AS node, c_custkey AS top FROM customer UNION SELECT node, v FROM up JOIN e ON u = top), r AS (SELECT node, min(top) AS root FROM up GROUP BY 1)
SELECT root, count(*) AS size FROM r GROUP BY 1""")
def components(t):
    return graph.components(ties(t), t.customer.select(F.col("c_custkey").alias("node"))).groupBy("root").agg(F.count("*").alias("size"))


# A component of these ties is a tree whose root is its smallest node, so the way between two nodes goes up from both to the last
# node that they share: the walks of the chain are lookups in the table of ancestors.
@query("""WITH RECURSIVE e AS (SELECT c_custkey AS u, c_custkey // 2 AS v FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey > 1),
up AS (SELECT c_custkey AS node, c_custkey AS top, 0 AS d FROM customer UNION ALL SELECT node, v, d + 1 FROM up JOIN e ON u = top),
r AS (SELECT node, min(top) AS root FROM up GROUP BY 1), big AS (SELECT root FROM r GROUP BY 1 ORDER BY count(*) DESC, root LIMIT 1),
far AS (SELECT node AS s FROM up JOIN big ON top = root ORDER BY d DESC, node LIMIT 1),
ups AS (SELECT top, d FROM up JOIN far ON node = s),
dist AS (SELECT up.node, min(up.d + ups.d) AS d FROM up JOIN ups ON up.top = ups.top GROUP BY 1),
ends AS (SELECT node FROM dist WHERE d = (SELECT max(d) FROM dist)),
meet AS (SELECT up.node, arg_min(up.top, up.d) AS top, min(up.d) AS d, arg_min(ups.d, up.d) AS sd FROM up JOIN ends ON up.node = ends.node JOIN ups ON up.top = ups.top GROUP BY 1),
p AS (SELECT list_concat((SELECT list(x.top ORDER BY x.d) FROM up x WHERE x.node = meet.node AND x.d <= meet.d), (SELECT list(y.top ORDER BY y.d DESC) FROM up y, far WHERE y.node = far.s AND y.d < meet.sd)) AS a FROM meet),
q AS (SELECT least(a, list_reverse(a)) AS a FROM p)
SELECT len(min(a))::BIGINT AS length, array_to_string(min(a), ',') AS path FROM q""")
def partner_chain(t):
    """The longest partnership chain of the largest component (of equals, the one with the smallest root)."""
    edges = ties(t)
    roots = written(graph.components(edges, t.customer.select(F.col("c_custkey").alias("node"))), "roots", merge=True)
    largest = roots.groupBy("root").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "root").limit(1).select("root")
    inside = edges.join(roots.withColumnRenamed("node", "u"), "u").join(F.broadcast(largest), "root")
    both = inside.select("root", "u", "v").unionByName(inside.select("root", F.col("v").alias("u"), F.col("u").alias("v")))
    return graph.longest_chain(both, cap=None).select("length", "path")
