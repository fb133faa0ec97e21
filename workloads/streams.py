"""Windows, reports, relation-to-stream operators and continuous queries, replayed over the events table.

Time is whole minutes.  The SQL side enumerates windows and picks the reported one by search, so it does not
share the arithmetic of the Spark side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.builder import TripleQuery
from trivane.functions.expressions import compare
from trivane.operators.sequence import numbered
from trivane.plans.rules import Rule
from trivane.query import Aggregate, Select, maximum
from trivane.store import TripleStore
from trivane.streaming.engine import StreamQueryBuilder, retrieve, windows_joined
from trivane.streaming.r2s import relation_to_stream
from trivane.streaming.windows import (
    NonEmptyContent,
    OnContentChange,
    OnWindowClose,
    Periodic,
    WindowSpec,
    evaluations,
    last_width,
    left_since,
    on_time,
    since,
    time_range,
    window_contents,
    window_sets,
)
from workloads.registry import query
from workloads.tables import EVENTS_SQL, MINUTE, events, table

# First minute of the recorded month.
START = 28401120
SPO = ["s", "p", "o"]


def _windows_sql(width: int, slide: int, closed: str = "both") -> str:
    first = f"cast(ceil(ts / {slide}.0) AS bigint) * {slide}" if closed == "both" else f"(ts // {slide} + 1) * {slide}"
    return f"""placed AS (SELECT e.*, c AS w_close, greatest(c - {width}, 0) AS w_open FROM events_t e,
        unnest(generate_series({first}, ts + {width}, {slide})) g(c)),
        opened AS (SELECT DISTINCT ts, w_close, w_open FROM placed),
        points AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM events_t))"""


def _fired_sql(condition: str) -> str:
    """Of the windows fed by the event before, the latest one that meets the condition."""
    return f"""fired AS (SELECT p.ts AS fire_ts, p.prev, max(o.w_close) AS w_close, max(o.w_open) AS w_open
        FROM points p JOIN opened o ON o.ts = p.prev WHERE {condition} GROUP BY 1, 2)"""


CONTENT = """content AS (SELECT DISTINCT fire_ts, f.w_open, f.w_close, s, p, o, o_num FROM fired f JOIN placed e
    ON e.w_close = f.w_close AND e.ts <= f.prev)"""
SIZES = "SELECT fire_ts, w_open, w_close, count(*) AS n FROM content GROUP BY ALL"


def stream_sql(select: str, width: int, slide: int, condition: str = "o.w_close < p.ts", *more: str) -> str:
    ctes = [EVENTS_SQL, _windows_sql(width, slide), _fired_sql(condition), CONTENT, *more]
    return "WITH " + ", ".join(ctes) + " " + select


def _sizes(content):
    return content.groupBy("fire_ts", "w_open", "w_close").agg(F.count("*").alias("n"))


def _set_sizes(spark, sf, spec):
    return window_sets(events(spark, sf), spec).groupBy("w_open", "w_close").agg(F.count("*").alias("n"))


def _sets_sql(width, slide, closed="both"):
    return f"""WITH {EVENTS_SQL}, {_windows_sql(width, slide, closed)}
        SELECT w_open, w_close, count(DISTINCT (s, p, o)) AS n FROM placed GROUP BY ALL"""


@query("rsp_sliding", _sets_sql(60, 15))
def rsp_sliding(spark, sf):
    return _set_sizes(spark, sf, WindowSpec.sliding("60", "15"))


@query("rsp_tumbling", _sets_sql(60, 60))
def rsp_tumbling(spark, sf):
    return _set_sizes(spark, sf, WindowSpec.tumbling(60))


@query("rsp_tumbling_half_open", _sets_sql(60, 60, "left"))
def rsp_tumbling_half_open(spark, sf):
    return _set_sizes(spark, sf, WindowSpec.tumbling(60, closed="left"))


@query("rsp_range_step", _sets_sql(30, 10))
def rsp_range_step(spark, sf):
    return _set_sizes(spark, sf, WindowSpec.range(30, 10))


SECONDS = """events_t AS (SELECT concat('user/', user_id) AS s, event_type AS p, cast(event_id AS varchar) AS o, value AS o_num,
    cast(floor(epoch_us(ts) / 1000000) AS bigint) AS ts FROM events)"""


@query(
    "rsp_duration",
    f"""WITH {SECONDS}, {_windows_sql(7200, 1800)} SELECT w_open, w_close, count(DISTINCT (s, p, o)) AS n FROM placed GROUP BY ALL""",
)
def rsp_duration(spark, sf):
    """Windows of two hours every half hour, given as durations over seconds."""
    seconds = table(spark, sf, "events").selectExpr(
        "concat('user/', user_id) AS s", "event_type AS p", "cast(event_id AS string) AS o", "value AS o_num",
        "cast(floor(unix_micros(cast(ts AS timestamp)) / 1000000) AS bigint) AS ts",
    )
    return window_sets(seconds, WindowSpec.sliding("PT2H", "PT30M")).groupBy("w_open", "w_close").agg(F.count("*").alias("n"))


@query("rsp_on_close", stream_sql(SIZES, 60, 15))
def rsp_on_close(spark, sf):
    return _sizes(window_contents(events(spark, sf), WindowSpec(60, 15), [OnWindowClose()]))


@query("rsp_non_empty", stream_sql(SIZES, 20, 10, "true"))
def rsp_non_empty(spark, sf):
    return _sizes(window_contents(events(spark, sf), WindowSpec(20, 10), [NonEmptyContent()]))


@query(
    "rsp_periodic",
    f"""WITH {EVENTS_SQL}, {_windows_sql(30, 10)},
        fired AS (SELECT p.ts AS fire_ts, p.prev, max(o.w_close) AS w_close, max(o.w_open) AS w_open FROM points p
          JOIN opened o ON o.ts = p.ts WHERE p.ts % 5 = 0 GROUP BY 1, 2), {CONTENT} {SIZES}""",
)
def rsp_periodic(spark, sf):
    return _sizes(window_contents(events(spark, sf), WindowSpec(30, 10), [Periodic(5)]))


@query("rsp_report_all", stream_sql(SIZES, 60, 15, "o.w_close < p.ts AND p.ts % 5 = 0"))
def rsp_report_all(spark, sf):
    reports = [OnWindowClose(), NonEmptyContent(), Periodic(5)]
    return _sizes(window_contents(events(spark, sf), WindowSpec(60, 15), reports))


COARSE = """coarse AS (SELECT 'site' AS s, 'saw' AS p, event_type AS o, cast(NULL AS double) AS o_num,
    cast(floor(epoch_us(ts) / 1000000 / 60) AS bigint) AS ts FROM events)"""


def coarse_events(spark, sf):
    """Events reduced to their type, so that triples repeat and a window's content can stay the same."""
    return events(spark, sf).select(
        F.lit("site").alias("s"), F.lit("saw").alias("p"), F.col("p").alias("o"), F.lit(None).cast("double").alias("o_num"), "ts"
    )


@query(
    "rsp_on_change",
    f"""WITH {COARSE}, events_t AS (SELECT * FROM coarse), {_windows_sql(60, 15)},
        changed AS (SELECT DISTINCT b.ts, b.w_close FROM placed b WHERE NOT EXISTS (SELECT 1 FROM placed a
          WHERE a.w_close = b.w_close AND a.s = b.s AND a.p = b.p AND a.o = b.o AND a.ts < b.ts)),
        fired AS (SELECT p.ts AS fire_ts, p.prev, max(o.w_close) AS w_close, max(o.w_open) AS w_open FROM points p
          JOIN opened o ON o.ts = p.prev JOIN changed h ON h.ts = o.ts AND h.w_close = o.w_close GROUP BY 1, 2),
        {CONTENT} {SIZES}""",
)
def rsp_on_change(spark, sf):
    return _sizes(window_contents(coarse_events(spark, sf), WindowSpec(60, 15), [OnContentChange()]))


@query(
    "rsp_tick_time",
    f"""WITH {EVENTS_SQL}, {_windows_sql(60, 15)}, {_fired_sql("o.w_close < p.ts")}
        SELECT fire_ts, prev AS previous, w_open, w_close FROM fired""",
)
def rsp_tick_time(spark, sf):
    """At most one evaluation per distinct event time."""
    return evaluations(events(spark, sf), WindowSpec(60, 15))


# Arrivals in the order of evaluation, each with the time of the one before it.
ARRIVALS = """arr AS (SELECT *, row_number() OVER (ORDER BY ts, s, p, o) - 1 AS no, lag(ts) OVER (ORDER BY ts, s, p, o) AS prev
    FROM events_t)"""


@query(
    "rsp_tick_tuple",
    f"""WITH {EVENTS_SQL}, {ARRIVALS},
        opened AS (SELECT no, prev, ts, c AS w_close, greatest(c - 30, 0) AS w_open FROM arr,
          unnest(generate_series(cast(ceil(prev / 10.0) AS bigint) * 10, prev + 30, 10)) g(c) WHERE c < ts),
        fired AS (SELECT no AS fire_no, any_value(ts) AS fire_ts, max(w_close) AS w_close, max(w_open) AS w_open FROM opened GROUP BY 1)
        SELECT fire_ts, fire_no, w_open, w_close, count(DISTINCT (s, p, o)) AS n FROM fired f JOIN arr a
          ON a.no < f.fire_no AND a.ts BETWEEN w_open AND w_close GROUP BY ALL""",
)
def rsp_tick_tuple(spark, sf):
    """Every arrival is an instant: several at one time report the same closed window, each for itself."""
    content = window_contents(events(spark, sf), WindowSpec(30, 10), [OnWindowClose()], "tuple")
    return content.groupBy("fire_ts", "fire_no", "w_open", "w_close").agg(F.count("*").alias("n"))


@query(
    "rsp_tick_tuple_change",
    f"""WITH {COARSE}, events_t AS (SELECT * FROM coarse), {ARRIVALS},
        opened AS (SELECT no, ts, c AS w_close, greatest(c - 20, 0) AS w_open FROM arr,
          unnest(generate_series(cast(ceil(prev / 10.0) AS bigint) * 10, prev + 20, 10)) g(c)),
        changed AS (SELECT o.* FROM opened o JOIN arr a ON a.no = o.no - 1 WHERE NOT EXISTS (SELECT 1 FROM arr b
          WHERE b.no < a.no AND b.s = a.s AND b.p = a.p AND b.o = a.o AND b.ts BETWEEN o.w_open AND o.w_close))
        SELECT no AS fire_no, any_value(ts) AS fire_ts, max(w_close) AS w_close, max(w_open) AS w_open FROM changed GROUP BY 1""",
)
def rsp_tick_tuple_change(spark, sf):
    """Arrivals after which a window holds something it did not hold, per arrival."""
    fired = evaluations(coarse_events(spark, sf), WindowSpec(20, 10), [OnContentChange()], "tuple")
    return fired.select("fire_no", "fire_ts", "w_open", "w_close")


@query(
    "rsp_tick_batch",
    f"""WITH {EVENTS_SQL}, {_windows_sql(60, 15)},
        ends AS (SELECT DISTINCT max(ts) AS ts FROM (SELECT *, cast(o AS bigint) // 50 AS b FROM events_t) GROUP BY b),
        fired AS (SELECT p.ts AS fire_ts, p.prev, max(o.w_close) AS w_close, max(o.w_open) AS w_open
          FROM points p JOIN ends USING (ts) JOIN opened o ON o.ts = p.prev WHERE o.w_close < p.ts GROUP BY 1, 2),
        {CONTENT} {SIZES}""",
)
def rsp_tick_batch(spark, sf):
    """Fifty messages are a batch, and its last event time is its instant."""
    batched = events(spark, sf).withColumn("batch", F.floor(F.col("o").cast("bigint") / 50))
    return _sizes(window_contents(batched, WindowSpec(60, 15), [OnWindowClose()], "batch"))


# -- relation to stream --------------------------------------------------------------------------------

ERRORS = "res AS (SELECT DISTINCT fire_ts, s FROM content WHERE p = 'error')"
EVALS = "ev AS (SELECT fire_ts, lag(fire_ts) OVER (ORDER BY fire_ts) AS before FROM fired)"


def _error_users(spark, sf, operator):
    stream, spec = events(spark, sf), WindowSpec(120, 30)
    content = window_contents(stream, spec)
    rows = Select("?s").where(("?s", "error", "?e")).run(TripleStore(content), carry=["fire_ts"]).distinct()
    return relation_to_stream(rows, evaluations(stream, spec).select("fire_ts"), operator, ["s"])


@query("rsp_rstream", stream_sql("SELECT fire_ts, s FROM res", 120, 30, "o.w_close < p.ts", ERRORS))
def rsp_rstream(spark, sf):
    return _error_users(spark, sf, "rstream")


@query(
    "rsp_istream",
    stream_sql(
        "SELECT fire_ts, s FROM res JOIN ev USING (fire_ts) WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.fire_ts = before AND r.s = res.s)",
        120, 30, "o.w_close < p.ts", ERRORS, EVALS,
    ),
)
def rsp_istream(spark, sf):
    return _error_users(spark, sf, "istream")


@query(
    "rsp_dstream",
    stream_sql(
        """SELECT ev.fire_ts, res.s FROM ev JOIN res ON res.fire_ts = ev.before
           WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.fire_ts = ev.fire_ts AND r.s = res.s)""",
        120, 30, "o.w_close < p.ts", ERRORS, EVALS,
    ),
)
def rsp_dstream(spark, sf):
    return _error_users(spark, sf, "dstream")


# -- continuous queries --------------------------------------------------------------------------------


@query(
    "rsp_window_bgp",
    stream_sql(
        """SELECT DISTINCT a.fire_ts, a.s AS u FROM content a JOIN content b ON a.fire_ts = b.fire_ts AND a.s = b.s
           WHERE a.p = 'click' AND b.p = 'purchase'""",
        60, 60,
    ),
)
def rsp_window_bgp(spark, sf):
    """Users who clicked and bought within the same window."""
    both = Select("?u").where(("?u", "click", "?a"), ("?u", "purchase", "?b"))
    return StreamQueryBuilder(60, 60).add_query(both).build().evaluate(events(spark, sf))


def profiles(spark, sf):
    return TripleStore(
        table(spark, sf, "customer").selectExpr("concat('user/', c_custkey) AS s", "'segment' AS p", "c_mktsegment AS o")
    )


@query(
    "rsp_window_static",
    stream_sql(
        """SELECT DISTINCT fire_ts, s AS u, c_mktsegment AS g FROM content JOIN customer ON s = concat('user/', c_custkey)
           WHERE p = 'error'""",
        60, 60,
    ),
)
def rsp_window_static(spark, sf):
    """Window content next to static background triples."""
    background = profiles(spark, sf)
    asked = Select("?u", "?g").where(("?u", "error", "?e")).where_in(background, ("?u", "segment", "?g"))
    return StreamQueryBuilder(60, 60).add_query(asked).add_triples(background).build().evaluate(events(spark, sf))


@query(
    "rsp_window_background",
    stream_sql(
        """SELECT fire_ts, s AS u, customer.c_mktsegment AS g FROM (SELECT DISTINCT fire_ts, s FROM content WHERE p = 'error') c
           JOIN customer ON s = concat('user/', c_custkey)
           JOIN customer boss ON boss.c_custkey = 1 AND boss.c_mktsegment = customer.c_mktsegment""",
        60, 60,
    ),
)
def rsp_window_background(spark, sf):
    """One pattern set over window content and static triples, some of it met by static triples alone."""
    asked = Select("?u", "?g").where(("?u", "error", "?e"), ("?u", "segment", "?g"), ("user/1", "segment", "?g"))
    return StreamQueryBuilder(60, 60).add_query(asked).add_triples(profiles(spark, sf)).build().evaluate(events(spark, sf))


@query(
    "rsp_window_background_total",
    stream_sql(
        """SELECT fire_ts, g, count(*) AS n FROM (SELECT DISTINCT fire_ts, s, c_mktsegment AS g, o_num, o FROM content JOIN customer
           ON s = concat('user/', c_custkey) WHERE p = 'purchase') GROUP BY fire_ts, g""",
        60, 60,
    ),
)
def rsp_window_background_total(spark, sf):
    """Aggregates per window over solutions of both kinds."""
    asked = Select("?g", "?n").where(("?u", "purchase", "?e"), ("?u", "segment", "?g"))
    asked = asked.group_by("?g").agg(Aggregate(F.count, "?e", "n"))
    return StreamQueryBuilder(60, 60).add_query(asked).add_triples(profiles(spark, sf)).build().evaluate(events(spark, sf))


@query(
    "rsp_window_rule",
    stream_sql(
        """SELECT DISTINCT a.fire_ts, a.s AS u, c_mktsegment AS g FROM content a JOIN content b ON a.fire_ts = b.fire_ts
           AND a.s = b.s JOIN customer ON a.s = concat('user/', c_custkey) WHERE a.p = 'signup' AND b.p = 'purchase'""",
        120, 60,
    ),
)
def rsp_window_rule(spark, sf):
    """A rule per window whose premises mix window content and background."""
    rule = Rule([("?u", "signup", "?a"), ("?u", "purchase", "?b"), ("?u", "segment", "?g")], [("?u", "converted", "?g")])
    asked = Select("?u", "?g").where(("?u", "converted", "?g"))
    engine = StreamQueryBuilder(120, 60).add_rules(rule).add_triples(profiles(spark, sf)).add_query(asked)
    return engine.build().evaluate(events(spark, sf))


@query(
    "rsp_multi_window",
    f"""WITH {EVENTS_SQL},
        a AS (SELECT DISTINCT s, c AS w_close FROM events_t, unnest(generate_series(cast(ceil(ts / 30.0) AS bigint) * 30, ts + 120, 30)) g(c) WHERE p = 'error'),
        b AS (SELECT DISTINCT s, c AS w_close FROM events_t, unnest(generate_series(cast(ceil(ts / 30.0) AS bigint) * 30, ts + 30, 30)) g(c) WHERE p = 'purchase')
        SELECT w_close, s AS u FROM a JOIN b USING (w_close, s)""",
)
def rsp_multi_window(spark, sf):
    """Errors of the last two hours next to purchases of the last half hour, for the same user."""
    stream = events(spark, sf)
    wide = TripleStore(window_sets(stream.filter("p = 'error'"), WindowSpec(120, 30)))
    narrow = TripleStore(window_sets(stream.filter("p = 'purchase'"), WindowSpec(30, 30)))
    errors = Select("?u").where(("?u", "error", "?e")).run(wide, carry=["w_close"]).distinct()
    bought = Select("?u").where(("?u", "purchase", "?e")).run(narrow, carry=["w_close"]).distinct()
    return windows_joined(errors, bought, ["u"])


CATALOGUE = f"""cat AS (SELECT s, max(ts) AS last FROM events_t GROUP BY s),
    act AS (SELECT s FROM cat WHERE last >= (SELECT max(ts) FROM events_t) - 1440),
    hit AS (SELECT s FROM act WHERE EXISTS (SELECT 1 FROM events_t e WHERE e.s = act.s AND p = 'error')
      AND EXISTS (SELECT 1 FROM events_t e WHERE e.s = act.s AND p = 'purchase'))"""


def catalogue(spark, sf):
    """One stream per user: what it observes, and whether it was heard of on the last day."""
    heard = events(spark, sf).groupBy("s", "p").agg(F.max("ts").alias("last"))
    newest = heard.agg(F.max("last")).scalar()
    observes = heard.select("s", F.lit("observes").alias("p"), F.col("p").alias("o"))
    last = heard.groupBy("s").agg(F.max("last").alias("last"))
    state = last.select("s", F.lit("state").alias("p"), F.when(F.col("last") >= newest - 1440, "active").otherwise("latent").alias("o"))
    return TripleStore(observes.union(state))


WATCHED = [("?s", "observes", "error"), ("?s", "observes", "purchase")]


@query("rsp_retrieve", f"WITH {EVENTS_SQL}, {CATALOGUE} SELECT s FROM hit")
def rsp_retrieve(spark, sf):
    return retrieve(catalogue(spark, sf), WATCHED, every=True, active=True)


@query("rsp_retrieve_some", f"WITH {EVENTS_SQL}, {CATALOGUE} SELECT min(s) AS s FROM hit")
def rsp_retrieve_some(spark, sf):
    return retrieve(catalogue(spark, sf), WATCHED, every=False, active=True)


@query("qb_stream_filter", stream_sql("SELECT fire_ts, s, p, o FROM content WHERE p = 'error' AND s LIKE '%1%'", 100, 10))
def qb_stream_filter(spark, sf):
    asked = TripleQuery(TripleStore(events(spark, sf))).with_predicate("error").with_subject_like("1")
    return asked.stream_results(events(spark, sf))


@query(
    "qb_stream_topk",
    stream_sql(
        """SELECT fire_ts, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY fire_ts ORDER BY o_num DESC, s, p, o) AS r
           FROM content WHERE p = 'purchase') WHERE r BETWEEN 2 AND 4""",
        60, 30,
    ),
)
def qb_stream_topk(spark, sf):
    asked = TripleQuery(TripleStore(events(spark, sf))).with_predicate("purchase").window(60, 30)
    return asked.order_by("o_num").desc().offset(1).limit(3).stream_results(events(spark, sf))


@query(
    "qb_stream_istream",
    stream_sql(
        """SELECT fire_ts, s, p, o FROM res JOIN ev USING (fire_ts) WHERE NOT EXISTS (SELECT 1 FROM res r
           WHERE r.fire_ts = before AND r.s = res.s AND r.o = res.o)""",
        60, 30, "o.w_close < p.ts", "res AS (SELECT fire_ts, s, p, o FROM content WHERE p = 'signup')", EVALS,
    ),
)
def qb_stream_istream(spark, sf):
    asked = TripleQuery(TripleStore(events(spark, sf))).with_predicate("signup").window(60, 30)
    return asked.with_stream_operator("istream").stream_results(events(spark, sf))


@query(
    "qb_stream_tuple",
    f"""WITH {EVENTS_SQL}, {ARRIVALS},
        opened AS (SELECT no, ts, c AS w_close, greatest(c - 20, 0) AS w_open FROM arr,
          unnest(generate_series(cast(ceil(prev / 20.0) AS bigint) * 20, prev + 20, 20)) g(c) WHERE c < ts),
        fired AS (SELECT no AS fire_no, any_value(ts) AS fire_ts, max(w_close) AS w_close, max(w_open) AS w_open FROM opened GROUP BY 1)
        SELECT DISTINCT fire_ts, fire_no, s, p, o FROM fired f JOIN arr a ON a.no < f.fire_no AND a.ts BETWEEN w_open AND w_close
          WHERE p = 'error'""",
)
def qb_stream_tuple(spark, sf):
    asked = TripleQuery(TripleStore(events(spark, sf))).with_predicate("error").window(20, 20).with_tick_strategy("tuple")
    return asked.stream_results(events(spark, sf))


@query(
    "rsp_window_aggregate",
    stream_sql("SELECT fire_ts, p, max(o_num) AS peak FROM content GROUP BY fire_ts, p", 60, 60),
)
def rsp_window_aggregate(spark, sf):
    """Highest value per event type and window."""
    # The object is the event id and its number the event's value.
    peaks = Select("?p", "?peak").where(("?u", "?p", "?e")).group_by("?p").agg(maximum("?e", "peak"))
    return StreamQueryBuilder(60, 60).add_query(peaks).build().evaluate(events(spark, sf))


@query(
    "rsp_window_filter",
    stream_sql("SELECT DISTINCT fire_ts, s AS u FROM content WHERE p = 'purchase' AND o_num > 90", 60, 30),
)
def rsp_window_filter(spark, sf):
    asked = Select("?u").where(("?u", "purchase", "?e")).filter(compare("?e", ">", 90))
    return StreamQueryBuilder(60, 30).add_query(asked).build().evaluate(events(spark, sf))


# -- time ranges over the log --------------------------------------------------------------------------


@query("stream_range", f"WITH {EVENTS_SQL} SELECT DISTINCT s, p, o FROM events_t WHERE ts BETWEEN {START + 5000} AND {START + 25000}")
def stream_range(spark, sf):
    return time_range(events(spark, sf), START + 5000, START + 25000)


@query("stream_istream", f"WITH {EVENTS_SQL} SELECT s, p, o, ts FROM events_t WHERE ts > {START + 20000}")
def stream_istream(spark, sf):
    return since(events(spark, sf), START + 20000)


@query(
    "stream_dstream",
    f"""WITH {EVENTS_SQL} SELECT s, p, o FROM events_t WHERE ts BETWEEN {START + 10000} AND {START + 20000}
        EXCEPT SELECT s, p, o FROM events_t WHERE ts BETWEEN {START + 15000} AND {START + 25000}""",
)
def stream_dstream(spark, sf):
    return left_since(events(spark, sf), START + 20000, START + 25000, 10000)


@query("stream_last_width", f"WITH {EVENTS_SQL} SELECT DISTINCT s, p, o FROM events_t WHERE ts BETWEEN {START + 30000} AND {START + 40000}")
def stream_last_width(spark, sf):
    return last_width(events(spark, sf), START + 40000, 10000)


@query(
    "rsp_late_batch",
    f"""WITH e AS (SELECT event_id, cast(floor(epoch_us(ts) / 1000000 / 60) AS bigint) AS ts,
          cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events),
        a AS (SELECT *, row_number() OVER (ORDER BY ts + k, event_id) - 1 AS n FROM e),
        b AS (SELECT n // 100 AS b, max(ts) AS top FROM a GROUP BY 1),
        m AS (SELECT b, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b)
        SELECT event_id, ts FROM a JOIN m ON a.n // 100 = m.b WHERE seen IS NULL OR ts >= seen - 30""",
)
def rsp_late_batch(spark, sf):
    """Events delivered k minutes after they happened; those more than half an hour behind are dropped."""
    delayed = table(spark, sf, "events").select(
        "event_id",
        F.expr(MINUTE).alias("ts"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )
    arrived = numbered(delayed, [F.col("ts") + F.col("k"), F.col("event_id")], "arrival", "arrivals")
    return on_time(arrived, "arrival", 100, 30).select("event_id", "ts")
