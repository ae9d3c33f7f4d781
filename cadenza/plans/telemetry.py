"""Telemetry: threshold rules over batches, and the same over a stream."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query


@query("""with w as (select date_trunc('hour', ts) as start, max(value) as top, count(*) as n, cast(sum(case when event_type='error' then 1 else 0 end) as bigint) as errors from events group by 1)
select start, round(top, 2) as top, n, errors, case when top > 480 then 'high' when errors > 3 then 'errors' else 'ok' end as state from w""")
def telemetry_alerts(spark, sf_dir):
    return alerts(table(spark, sf_dir, "events"), "1 hour")


def alerts(events, width: str):
    """State of each window of time. On a stream, set a watermark before."""
    w = events.groupBy(F.window("ts", width).alias("w")).agg(
        F.max("value").alias("top"), F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors")
    )
    state = F.when(F.col("top") > 480, "high").when(F.col("errors") > 3, "errors").otherwise("ok")
    return w.select(F.col("w.start").alias("start"), F.round("top", 2).alias("top"), "n", "errors", state.alias("state"))


@query("select event_id, round(value, 2) as value, cast(json_extract_string(props,'$.k') as integer) as k from events order by ts desc, event_id desc limit 15")
def telemetry_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(15)
    return e.select("event_id", F.round("value", 2).alias("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""with e as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as back from events)
select event_type, count(*) as n, round(max(value), 2) as most, round(max(case when back <= 30 then value end), 2) as most_of_tail, round(max(case when back = 1 then value end), 2) as last_ from e group by 1""")
def telemetry_extremes(spark, sf_dir, tail: int = 30):
    """The greatest reading, the greatest of the last ones, and the last one, of each kind."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    # The tail is found without ordering all readings: a group limit keeps the first rows of each task alone.
    last = e.withColumn("back", F.row_number().over(w)).where(F.col("back") <= tail).groupBy("event_type").agg(F.round(F.max("value"), 2).alias("most_of_tail"))
    every = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("most"), F.round(F.max_by("value", F.struct("ts", "event_id")), 2).alias("last_"))
    return every.join(last, "event_type")


#: Rules of a reading: name and condition. The processor's heat counts only where the graphics card's does not.
RULES = {
    "power": "power >= 0.95 * power_limit or total_power >= 500", "gpu_hot": "gpu_temp >= 85", "cpu_hot": "coalesce(gpu_temp, 0) < 85 and cpu_temp >= 90",
    "memory": "ram_used >= 95 or swap_used >= 4000", "power_cap": "contains(throttle, 'SW_POWER_CAP')", "slowdown": "contains(throttle, 'HW_SLOWDOWN') or contains(throttle, 'HW_THERMAL')",
}


def broken_rules(readings, rules=RULES):
    """readings with broken, the names of the rules that a reading breaks, in the order of the rules; a rule about a value
    that is missing is not broken."""
    names = [F.when(F.coalesce(F.expr(condition), F.lit(False)), name) for name, condition in rules.items()]
    return readings.withColumn("broken", F.filter(F.array(*names), lambda x: x.isNotNull()))


@query("""with r as (select event_id, value as power, 400e0 as power_limit, value + 40 as total_power, case when event_id % 11 <> 0 then 40 + cast(json_extract_string(props,'$.k') as integer) / 2 end as gpu_temp, 45 + cast(json_extract_string(props,'$.k') as integer) / 2 as cpu_temp, value / 5 as ram_used, event_id % 4100 as swap_used,
 case event_type when 'error' then '0x8 HW_SLOWDOWN' when 'signup' then '0x4 SW_POWER_CAP' when 'view' then 'HW_THERMAL' else 'none' end as throttle from events),
b as (select event_id, concat_ws(',', case when power >= 0.95e0 * power_limit or total_power >= 500 then 'power' end, case when gpu_temp >= 85 then 'gpu_hot' end, case when coalesce(gpu_temp, 0) < 85 and cpu_temp >= 90 then 'cpu_hot' end, case when ram_used >= 95 or swap_used >= 4000 then 'memory' end,
 case when contains(throttle, 'SW_POWER_CAP') then 'power_cap' end, case when contains(throttle, 'HW_SLOWDOWN') or contains(throttle, 'HW_THERMAL') then 'slowdown' end) as broken from r)
select broken, count(*) as n from b group by 1""")
def telemetry_rules(spark, sf_dir):
    """Readings by the rules that they break: near the limit of power, hot, out of memory, slowed down."""
    k = F.get_json_object("props", "$.k").cast("int")
    throttle = F.when(F.col("event_type") == "error", "0x8 HW_SLOWDOWN").when(F.col("event_type") == "signup", "0x4 SW_POWER_CAP").when(F.col("event_type") == "view", "HW_THERMAL").otherwise("none")
    r = table(spark, sf_dir, "events").select(
        F.col("value").alias("power"), F.lit(400.0).alias("power_limit"), (F.col("value") + 40).alias("total_power"), F.when(F.col("event_id") % 11 != 0, 40 + k / 2).alias("gpu_temp"),
        (45 + k / 2).alias("cpu_temp"), (F.col("value") / 5).alias("ram_used"), (F.col("event_id") % 4100).alias("swap_used"), throttle.alias("throttle"),
    )
    return broken_rules(r).groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))
