"""Entity-day views over the test tables, as SQL for Spark and for DuckDB from one definition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import materialise

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def day(self, x: str) -> str:
        return f"datediff({x}, date'1970-01-01')" if self.spark else f"date_diff('day', date '1970-01-01', {x})"

    def days(self, a: str, b: str) -> str:
        return f"explode(sequence({a}, {b}))" if self.spark else f"unnest(range({a}, {b} + 1))"

    def date(self, day: str) -> str:
        return f"date_add(date'1970-01-01', cast({day} as int))" if self.spark else f"(date '1970-01-01' + cast({day} as integer))"

    def hhmm(self, minutes: str) -> str:
        m = f"cast({minutes} as bigint)"
        hour, minute = f"cast({m} // 60 as varchar)" if not self.spark else f"cast({m} div 60 as string)", f"cast({m} % 60 as {'string' if self.spark else 'varchar'})"
        return f"concat(lpad({hour}, 2, '0'), ':', lpad({minute}, 2, '0'))"


SPARK, DUCK = Dialect(True), Dialect(False)


def _ranked(e: Dialect, volumes: str) -> str:
    return f"""
        select entity_id, date, {e.day('date')} as day, volume,
          cast(greatest(1.0, floor(100.0 * (rk + (ties - 1) / 2.0) / n + 0.5)) as double) as label
        from (select *, rank() over (partition by entity_id order by volume) as rk, count(*) over (partition by entity_id, volume) as ties,
                count(*) over (partition by entity_id) as n
              from ({volumes}) a) b"""


def _activity(name: str, key: str, join: str):
    def sql(e: Dialect) -> str:
        return _ranked(e, f"""select {key} as entity_id, cast(l_shipdate as date) as date, cast(sum(l_quantity) as double) as volume
                    from lineitem join supplier on l_suppkey = s_suppkey {join} group by 1, 2""")

    return sql


def _day_facts(e: Dialect) -> str:
    """What the calendar takes from an entity's lines of a day.

    On Spark event names are keys before they are compared: an aggregate that keeps a string sorts all lines, where one of
    numbers hashes them.
    """
    facts = "max(l_tax) as tax, max(l_discount) as disc, min(l_linenumber) as line0,\n        max(l_linenumber) as line1"
    name, lines = "case when p_type = 'PROMO' then p_name end", "from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey"
    day = "s_nationkey as entity_id, cast(l_shipdate as date) as date"
    if not e.spark:
        return f"""
      select {day}, {facts}, max({name}) as events
      {lines} group by 1, 2"""
    return f"""
      select entity_id, date, max(tax) as tax, max(disc) as disc, min(line0) as line0, max(line1) as line1, max(event) as events
      from (select {day}, {name} as event, {facts} {lines} group by 1, 2, 3) n group by 1, 2"""


def _calendar(e: Dialect, facts: str | None = None) -> str:
    return f"""
    select a.entity_id, a.date, a.day, cast(a.label as double) as label, case when t.tax = 0 then 'unknown' else 'open' end as status,
      t.disc = 0 as predicted,
      case when a.volume < 5 then null else {e.hhmm("480 + 60 * floor((t.line0 - 1) / 2) + case when t.line0 % 2 = 0 then 30 else 0 end")} end as opens,
      case when a.volume < 5 then null else {e.hhmm("((19 + t.line1) % 24) * 60")} end as closes, t.events
    from activity a join ({facts or _day_facts(e)}) t
      on a.entity_id = t.entity_id and a.date = t.date
    union all
    select s.entity_id, {e.date('s.day')} as date, s.day, cast(null as double), 'closed', false, null, null, null
    from (select entity_id, {e.days('lo', 'hi')} as day from (select entity_id, min(day) as lo, max(day) as hi from activity group by entity_id) r) s
    left join activity a on a.entity_id = s.entity_id and a.day = s.day where a.day is null"""


VIEWS = {
    "activity": _activity("activity", "s_nationkey", ""),
    "region_activity": _activity("region_activity", "n_regionkey", "join nation on s_nationkey = n_nationkey"),
    "calendar": _calendar,
    "entities": lambda e: """
    select n_nationkey as entity_id, n_name as name, r_name as company, cast(-60.0 + 5 * n_nationkey as double) as latitude, cast(-170.0 + 14 * n_nationkey as double) as longitude,
      1990 + n_nationkey % 5 as first_year, 1 + n_nationkey % 12 as first_month,
      case n_nationkey % 4 when 0 then 'local' when 1 then 'regional' when 2 then 'continental' else 'intercontinental' end as tier,
      concat('R', r_regionkey) as country, cast(case when n_nationkey % 6 = 0 then 900 end as double) as reach_km
    from nation join region on n_regionkey = r_regionkey""",
    "station": lambda e: f"""
    select entity_id, date, {e.day('date')} as day, temp_max, temp_min, precip, sunshine from (
      select n_regionkey as entity_id, cast(o_orderdate as date) as date, floor(max(o_totalprice) / 1000 + 0.5) / 10 as temp_max,
        floor(min(o_totalprice) / 1000 + 0.5) / 10 - 10 as temp_min, cast(case when count(*) > 3 then null else min(o_orderkey) % 13 end as double) as precip,
        cast(3600.0 * count(*) as double) as sunshine
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2) s""",
    "hourly": lambda e: """
    select event_type as station, date_trunc('hour', ts) as hour, avg(value) / 5 as temp, case when count(*) = 1 then null else min(value) / 20 end as precip,
      1 + 6 * (min(user_id) % 2) as lead
    from events group by 1, 2""",
    "source_rows": lambda e: f"""
    select case when o_orderstatus = 'P' then concat('R', n_regionkey) else concat('R', n_regionkey, '-', n_nationkey) end as code,
      cast(o_orderdate as date) as date, {e.day('cast(o_orderdate as date)')} as day,
      case when o_orderpriority like '1%' or o_orderpriority like '2%' then 'national' else 'school' end as type,
      cast((o_orderkey % 10) / 10.0 as double) as share, o_orderpriority as name, o_orderkey as row_id
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "regions": lambda e: "select concat('R', n_regionkey, '-', n_nationkey) as code, concat('R', n_regionkey) as country, n_nationkey as region_id from nation",
    "markets": lambda e: """
    select entity_id, code, country, region_id, q / sum(q) over (partition by entity_id) as prior from (
      select s_nationkey as entity_id, concat('R', n_regionkey, '-', n_nationkey) as code, concat('R', n_regionkey) as country, n_nationkey as region_id, cast(sum(l_quantity) as double) as q
      from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join nation on c_nationkey = n_nationkey group by 1, 2, 3, 4) m""",
    "lagged": lambda e: "select a.entity_id, a.date, a.day, a.label, p.label as last_year from activity a left join activity p on a.entity_id = p.entity_id and p.day = a.day - 364",
    "log": lambda e: f"""
    select {e.date('l.day - k.lead')} as made_on, l.entity_id, l.date, l.day, k.lead as lead_days,
      cast(case when k.extra = 1 then 55.0 else coalesce(l.last_year, 50.0) end as double) as prediction,
      case when ((l.entity_id + k.lead) % 2 = 0) = (k.extra = 0) then 'live' else 'backtest' end as source
    from lagged l cross join (select lead, extra from (values (1), (7), (14), (30)) v(lead) cross join (values (0), (1)) w(extra)) k
    where k.extra = 0 or l.last_year is null""",
    "intervals": lambda e: f"""
    select c_nationkey as state, o_totalprice as weight, {e.day('cast(o_orderdate as date)')} as start_day,
      {e.day('cast(o_orderdate as date)')} + o_orderkey % 10 as end_day, o_orderkey as row_id
    from orders join customer on o_custkey = c_custkey""",
    "areas": lambda e: """
    select n_nationkey as region_id, concat('R', n_regionkey) as country, cast(1000 + 500 * n_nationkey as double) as population, cast(-40 + 20 * floor(n_nationkey / 5) as double) as lat,
      cast(-80 + 40 * (n_nationkey % 5) as double) as lon, cast(0.5 + n_regionkey / 4.0 as double) as affluence from nation""",
    "points": lambda e: "select c_custkey as point_id, cast((c_custkey * 37 % 3600) / 10.0 - 180 as double) as lon, cast((c_custkey * 53 % 1800) / 10.0 - 90 as double) as lat, cast(c_acctbal as double) as pop, c_nationkey as home from customer",
    "rectangles": lambda e: "select n_nationkey as rect_id, cast(-100 + 40 * (n_nationkey % 5) as double) as lon0, cast(-60 + 40 * (n_nationkey % 5) as double) as lon1, cast(-50 + 20 * floor(n_nationkey / 5) as double) as lat0, cast(-30 + 20 * floor(n_nationkey / 5) as double) as lat1 from nation",
}
NEEDS = {"calendar": ["activity"], "lagged": ["activity"], "log": ["lagged"]}

#: How a sharing query makes these views instead, on Spark: from two tables of days, each one pass over the large ones.
#: line_days: lines by entity, day and event; volume counts every line, the facts those whose part is known (parts of one key
#: are one part to it). order_days: orders by nation, day and what source_rows makes of them. markets meet orders by hash, as
#: their keys occur once, and are summed by numbers: no line is sorted, and no code made for each line.
SHARED_VIEWS = {
    "line_days": """
    select s_nationkey as entity_id, cast(l_shipdate as date) as date, event, sum(l_quantity) as volume, count(known) as n_known, max(case when known then l_tax end) as tax,
      max(case when known then l_discount end) as disc, min(case when known then l_linenumber end) as line0, max(case when known then l_linenumber end) as line1
    from lineitem join supplier on l_suppkey = s_suppkey
    left join (select p_partkey, true as known, max(case when p_type = 'PROMO' then p_name end) as event from part where p_partkey is not null group by 1) p on l_partkey = p_partkey group by 1, 2, 3""",
    "activity": _ranked(SPARK, "select entity_id, date, cast(sum(volume) as double) as volume from line_days group by 1, 2"),
    "calendar": _calendar(SPARK, """select entity_id, date, max(tax) as tax, max(disc) as disc, min(line0) as line0, max(line1) as line1, max(event) as events
      from line_days where n_known > 0 group by 1, 2"""),
    "order_days": """
    select n_regionkey, n_nationkey, cast(o_orderdate as date) as date, coalesce(o_orderstatus = 'P', false) as wide, o_orderpriority = '1-URGENT' as urgent,
      coalesce(o_orderpriority like '1%' or o_orderpriority like '2%', false) as national, count(*) as n, max(o_totalprice) as most, min(o_totalprice) as least,
      min(o_orderkey) as first, sum(log1p(-least(greatest(cast((o_orderkey % 10) / 10.0 as double), 0.0D), 1 - 1e-9D))) as spared
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3, 4, 5, 6""",
    "station": f"""
    select entity_id, date, {SPARK.day('date')} as day, temp_max, temp_min, precip, sunshine from (
      select n_regionkey as entity_id, date, floor(max(most) / 1000 + 0.5) / 10 as temp_max, floor(min(least) / 1000 + 0.5) / 10 - 10 as temp_min,
        cast(case when sum(n) > 3 then null else min(first) % 13 end as double) as precip, cast(3600.0 * sum(n) as double) as sunshine
      from order_days group by 1, 2) s""",
    "source_days": f"""
    select code, date, {SPARK.day('date')} as day, type, urgent, 1 - exp(sum(spared)) as share
    from (select case when wide then concat('R', n_regionkey) else concat('R', n_regionkey, '-', n_nationkey) end as code, date,
            case when national then 'national' else 'school' end as type, urgent, spared from order_days) o group by code, date, type, urgent""",
    "markets": """
    select entity_id, concat('R', n_regionkey, '-', n_nationkey) as code, concat('R', n_regionkey) as country, n_nationkey as region_id, q / sum(q) over (partition by entity_id) as prior from (
      select /*+ shuffle_hash(o) */ s_nationkey as entity_id, n_regionkey, n_nationkey, cast(sum(l_quantity) as double) as q from lineitem join supplier on l_suppkey = s_suppkey
      join (select o_orderkey, n_regionkey, n_nationkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) o on l_orderkey = o_orderkey group by 1, 2, 3) m""",
}
SHARED_NEEDS = {"activity": ["line_days"], "calendar": ["activity", "line_days"], "station": ["order_days"], "source_days": ["order_days"]}


def _with(names: tuple[str, ...], e: Dialect) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n](e)})" for n in order)


#: Tables that the parts of a running query share, by folder and name; None outside sharing().
_shared: dict[tuple[str, str], DataFrame] | None = None


@contextmanager
def sharing(on: bool) -> Iterator[None]:
    """A query's run; with `on`, its shared() tables are made once, however many of its plans and fits read them."""
    global _shared
    before, _shared = _shared, {} if on else None
    try:
        yield
    finally:
        _shared = before


def shared(sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name, written once within sharing(), else a plan for each call."""
    if _shared is None:
        return make()
    if (sf_dir, name) not in _shared:
        _shared[sf_dir, name] = materialise(make())
    return _shared[sf_dir, name]


#: Views that aggregate the large tables: entities by days or by regions, whatever the rows they come from.
AGGREGATES = tuple(SHARED_VIEWS)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; the base tables are read where the view's plan uses them."""
    if _shared is not None:
        # Views that it needs stand for themselves, so that a shared one isn't computed within this one.
        return shared(sf_dir, name, lambda: _view(spark, sf_dir, name, True)) if name in AGGREGATES else _view(spark, sf_dir, name, True)
    return _view(spark, sf_dir, name, False)


def is_sharing() -> bool:
    return _shared is not None


def _view(spark: SparkSession, sf_dir: str, name: str, apart: bool) -> DataFrame:
    if apart:
        for needed in (SHARED_NEEDS if name in SHARED_VIEWS else NEEDS).get(name, []):
            view(spark, sf_dir, needed).createOrReplaceTempView(needed)
        text = SHARED_VIEWS[name] if name in SHARED_VIEWS else VIEWS[name](SPARK)
    else:
        text = f"{_with((name,), SPARK)} SELECT * FROM {name}"
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the views, then more common table expressions or the final select."""
    body = body.strip()
    return _with(names, DUCK) + (", " + body[4:].lstrip() if body[:4].upper() == "WITH" else " " + body)
