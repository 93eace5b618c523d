"""Queries of the sources, sinks and streaming jobs.

Files are staged by Spark from the given tables into the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import timeutil
from tidegrid.operators.densify import keep_one
from tidegrid.plans import derive, target, topics as tp
from tidegrid.plans.derive import HS, IV, PN, PR, with_cte
from tidegrid.plans.q_eval import KEYS, SERIES, _r
from tidegrid.plans.q_intervals import _METHOD, _SPLIT_SQL, _src
from tidegrid.plans.registry import query
from tidegrid.session import cut_lineage, staging_path
from tidegrid.sources import files, market_xml as mx, predictions as pred
from tidegrid.streaming import jobs

# a wall clock around both clock changes: events spread over the days around them
_WALL_DAY = "CASE WHEN event_id % 2 = 0 THEN '25.10.2020' ELSE '28.03.2021' END"


@query(
    "prj2_prj3_wall_time",
    """WITH w AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2020-10-25' ELSE TIMESTAMP '2021-03-28' END + to_minutes(CAST(event_id % 1440 AS INT)) AS wall,
 event_id % 2 = 0 AND (event_id % 1440) // 60 = 2 AND event_id % 4 = 0 AS b FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN b THEN wall - INTERVAL 1 HOUR WHEN hour(wall) < 3 THEN wall - INTERVAL 2 HOUR ELSE wall - INTERVAL 1 HOUR END
 ELSE CASE WHEN hour(wall) < 3 THEN wall - INTERVAL 1 HOUR ELSE wall - INTERVAL 2 HOUR END END AS utc FROM w""",
)
def prj2(spark, d):
    e = derive.table(spark, d, "events").selectExpr(
        "event_id",
        f"{_WALL_DAY} AS date",
        "concat((event_id % 1440) div 60, CASE WHEN event_id % 2 = 0 AND (event_id % 1440) div 60 = 2 THEN "
        "CASE WHEN event_id % 4 = 0 THEN 'B' ELSE 'A' END ELSE '' END, ':', lpad(event_id % 60, 2, '0')) AS time",
    )
    return e.select("event_id", timeutil.parse_wall_time(F.col("date"), F.col("time")).alias("utc"))


@query(
    "prj4_localize_hourly",
    """WITH w AS (SELECT event_id, ts - INTERVAL 1 HOUR AS utc FROM events) SELECT event_id, utc FROM w""",
)
def prj4(spark, d):
    # all events are in January: Berlin is one hour ahead
    return derive.table(spark, d, "events").select("event_id", timeutil.wall_to_utc(F.col("ts")).alias("utc"))


@query(
    "src1_prj1_prj5_intervention_csv",
    """SELECT event_id, ts_ AS begin_date, ts_ + to_minutes(CAST(15 + event_id % 600 AS INT)) AS end_date, value AS total_load, round(value / 3, 3) AS mean_load,
 CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, CASE WHEN event_id % 3 = 0 THEN 'Voltage-related redispatch' ELSE 'Electricty-related redispatch' END AS measurement_reason, 2 AS n_requesters
FROM (SELECT *, date_trunc('minute', ts) AS ts_ FROM events)""",
)
def src1(spark, d):
    e = derive.table(spark, d, "events").withColumn("b", F.expr("from_utc_timestamp(date_trunc('minute', ts), 'Europe/Berlin')"))
    e = e.withColumn("e", F.expr("timestampadd(MINUTE, CAST(15 + event_id % 600 AS INT), b)"))
    comma = lambda c: F.regexp_replace(c.cast("string"), "\\.", ",")
    raw = e.select(
        F.date_format("b", "dd.MM.yyyy").alias("BEGINN_DATUM"), F.date_format("b", "HH:mm").alias("BEGINN_UHRZEIT"),
        F.date_format("e", "dd.MM.yyyy").alias("ENDE_DATUM"), F.date_format("e", "HH:mm").alias("ENDE_UHRZEIT"),
        F.lit("DE").alias("NETZREGION"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'Spannungsbedingter Redispatch' ELSE 'Strombedingter Redispatch' END").alias("GRUND_DER_MASSNAHME"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'Wirkleistungseinspeisung erhöhen' ELSE 'Wirkleistungseinspeisung reduzieren' END").alias("RICHTUNG"),
        comma(F.round(F.col("value") / 3, 3).cast("decimal(20,3)")).alias("MITTLERE_LEISTUNG_MW"),
        comma(F.col("value").cast("decimal(20,2)")).alias("MAXIMALE_LEISTUNG_MW"),
        comma(F.col("value").cast("decimal(20,2)")).alias("GESAMTE_ARBEIT_MWH"),
        F.lit("50Hertz").alias("ANWEISENDER_UENB"), F.lit("50Hertz & TenneT DE").alias("ANFORDERNDER_UENB"),
        F.concat(F.lit("U"), F.col("event_id")).alias("BETROFFENE_ANLAGE"), F.lit("Erneuerbar").alias("PRIMAERENERGIEART"),
    )
    path = staging_path(spark, "interventions")
    raw.write.option("header", True).option("sep", ";").csv(path)
    out = target.split_requesters(files.read_interventions(spark, path))
    return out.select(
        F.expr("CAST(substring(affected_unit, 2) AS BIGINT)").alias("event_id"), "begin_date", "end_date", "total_load",
        "mean_load", "direction", "measurement_reason", F.size("requesting_operator").alias("n_requesters"),
    )


@query(
    "src2_snk2_hourly_csv",
    with_cte(HS) + "SELECT series, ts AS begin_date, 'load' AS metric, value FROM hs",
)
def src2(spark, d):
    h = derive.hourly(spark, d).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("begin_date"), F.lit("x").alias("end_date"),
        F.col("value").alias("load"), F.col("series").cast("double").alias("series"),
    )
    path = staging_path(spark, "hourly")
    files.write_csv(h, path)
    wide = files.read_hourly_csv(spark, path, ["load", "series"], long=False)
    return wide.unpivot(["series", "begin_date"], ["load"], "metric", "value").withColumn("series", F.col("series").cast("long"))


# documents: one per user and day with one series and one period of hourly points
def _market_docs(spark, d):
    e = derive.table(spark, d, "events")
    pts = e.groupBy("user_id", F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("position")).agg(
        F.round(F.sum("value"), 2).alias("q")
    )
    one = F.concat(
        F.lit("<Point><position>"), F.col("position"), F.lit("</position><quantity>"),
        F.col("q").cast("decimal(20,2)"), F.lit("</quantity></Point>"),
    )
    # at most 24 points per document
    doc = pts.groupBy("user_id", "day").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", one.alias("x")))), lambda s: s["x"]), "").alias("points")
    )
    head = (
        "concat('<Doc xmlns=\"urn:x:gl\"><mRID>D', user_id, '-', day, '</mRID><revisionNumber>2</revisionNumber>"
        "<sender_MarketParticipant.mRID codingScheme=\"A01\">10YDE-VE-------2</sender_MarketParticipant.mRID>"
        "<sender_MarketParticipant.marketRole.type>A46</sender_MarketParticipant.marketRole.type><TimeSeries><mRID>1</mRID><businessType>A04</businessType>"
        "<in_Domain.mRID codingScheme=\"A01\">', CASE user_id % 2 WHEN 0 THEN '10YDE-VE-------2' ELSE '10YDE-ENBW-----N' END, '</in_Domain.mRID>"
        "<out_Domain.mRID codingScheme=\"A01\">X', user_id, '</out_Domain.mRID>"
        "<mktPSRType.psrType>', CASE user_id % 2 WHEN 0 THEN 'A04' ELSE 'A05' END, '</mktPSRType.psrType><MktPSRType><psrType>', CASE user_id % 3 WHEN 0 THEN 'B16' ELSE 'B04' END, '</psrType></MktPSRType>"
        "<flowDirection.direction>A0', user_id % 2 + 1, '</flowDirection.direction><quantity_Measure_Unit.name>MWH</quantity_Measure_Unit.name>"
        "<curveType>', CASE user_id % 2 WHEN 0 THEN 'A03' ELSE 'A01' END, '</curveType>"
        "<Period><timeInterval><start>', day, 'T00:00Z</start><end>', date_add(day, 1), 'T00:00Z</end></timeInterval><resolution>PT60M</resolution>',"
        " points, '</Period><Reason><code>B24</code></Reason><Reason><code>Z99</code></Reason></TimeSeries></Doc>') AS xml"
    )
    return doc.selectExpr("user_id", head)


_DOC = """
pt AS (SELECT user_id, date_trunc('day', ts) AS day, CAST(hour(ts) + 1 AS INT) AS position, round(sum(value), 2) AS q FROM events GROUP BY ALL),
dy AS (SELECT DISTINCT user_id, day FROM pt),
st AS (SELECT user_id, day, unnest(range(1, 25)) AS position FROM dy),
hold AS (SELECT st.user_id, st.day, st.position, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY st.user_id, st.day ORDER BY st.position), 0) AS q
 FROM st LEFT JOIN pt USING (user_id, day, position))
"""


@query(
    "src3_market_xml",
    with_cte(_DOC)
    + """, r AS (SELECT * FROM hold WHERE user_id % 2 = 0 UNION ALL SELECT user_id, day, position, q FROM pt WHERE user_id % 2 = 1)
SELECT day + to_hours(CAST(position - 1 AS INT)) AS begin_date, day + to_hours(CAST(position AS INT)) AS end_date, q AS value, 'PT60M' AS resolution,
 CASE user_id % 3 WHEN 0 THEN 'Solar' ELSE 'Fossil Gas' END AS psr_type_name, user_id FROM r""",
)
def src3(spark, d):
    docs = _market_docs(spark, d).withColumn("xml", F.regexp_replace("xml", "<in_Domain.mRID[^/]*/in_Domain.mRID>", ""))
    out = mx.market_intervals(mx.document_series(docs))
    return out.select(
        "begin_date", "end_date", "value", "resolution", "psr_type_name",
        F.expr("CAST(substring(domain, 2) AS BIGINT)").alias("user_id"),
    )


@query(
    "src4_src5_redispatch_xml",
    with_cte(_DOC)
    + """SELECT 'D' || user_id || '-' || strftime(day, '%Y-%m-%d') || '_1' AS ts_mrid, 2 AS doc_revision_number, day + to_hours(CAST(position - 1 AS INT)) AS begin_timestamp_utc,
 q AS quantity_mwh, CASE user_id % 2 WHEN 0 THEN 'DE_50HzT' ELSE 'DE_TransnetBW' END AS tso, CASE user_id % 2 WHEN 0 THEN 'generation' ELSE 'load' END AS psr_type_name,
 CASE user_id % 2 WHEN 0 THEN 'up' ELSE 'down' END AS flow_direction_name, 'Load flow overflow,Z99' AS reason_labels, 'X' || user_id AS out_domain_name, 'System Operator' AS sender_role_name, '10YDE-VE-------2' AS sender_mrid FROM hold""",
)
def src4(spark, d):
    out = mx.redispatch_intervals(mx.document_series(_market_docs(spark, d)))
    return out.select(
        "ts_mrid", "doc_revision_number", "begin_timestamp_utc", "quantity_mwh", "tso", "psr_type_name",
        "flow_direction_name", "reason_labels", "out_domain_name", "sender_role_name", "sender_mrid",
    )


PARTIES = {"10YDE-VE-------2": "Party A", "10YDE-ENBW-----N": "Party B"}


@query(
    "src5_cross_border_parties",
    with_cte(_DOC)
    + """SELECT 'D' || user_id || '-' || strftime(day, '%Y-%m-%d') || '_1' AS ts_mrid, day + to_hours(CAST(position - 1 AS INT)) AS begin_timestamp_utc, q AS quantity_mwh,
 CASE user_id % 3 WHEN 0 THEN 'S' || user_id ELSE '10YDE-VE-------2' END AS sender_mrid, CASE user_id % 3 WHEN 0 THEN 'S' || user_id ELSE 'Party A' END AS sender_mrid_name,
 CASE user_id % 5 WHEN 0 THEN NULL ELSE '10YDE-ENBW-----N' END AS receiver_mrid, CASE user_id % 5 WHEN 0 THEN NULL ELSE 'Party B' END AS receiver_mrid_name,
 CASE user_id % 2 WHEN 0 THEN 'Area North' ELSE '10YDE-ENBW-----N' END AS in_domain_name, 'X' || user_id AS out_domain_name FROM hold""",
)
def src5(spark, d):
    """Senders of every third user are unknown codes, receivers of every fifth are absent; so is one of two domains from the names."""
    receiver = "<receiver_MarketParticipant.mRID codingScheme=\"A01\">10YDE-ENBW-----N</receiver_MarketParticipant.mRID><TimeSeries>"
    sender = F.concat(F.lit("codingScheme=\"A01\">S"), F.col("user_id"), F.lit("</sender_MarketParticipant.mRID>"))
    xml = F.when(F.col("user_id") % 5 != 0, F.replace("xml", F.lit("<TimeSeries>"), F.lit(receiver))).otherwise(F.col("xml"))
    docs = _market_docs(spark, d).withColumn("xml", xml)
    unknown = F.replace("xml", F.lit("codingScheme=\"A01\">10YDE-VE-------2</sender_MarketParticipant.mRID>"), sender)
    docs = docs.withColumn("xml", F.when(F.col("user_id") % 3 == 0, unknown).otherwise(F.col("xml")))
    out = mx.redispatch_intervals(mx.document_series(docs), {"10YDE-VE-------2": "Area North"}, PARTIES)
    return out.select(
        "ts_mrid", "begin_timestamp_utc", "quantity_mwh", "sender_mrid", "sender_mrid_name", "receiver_mrid", "receiver_mrid_name",
        "in_domain_name", "out_domain_name",
    )


def _outage_docs(spark, d):
    li = derive.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    one = F.concat(
        F.lit("<Point><position>"), F.col("l_linenumber"), F.lit("</position><quantity>"), F.col("q").cast("int"),
        F.lit("</quantity></Point>"),
    )
    # a handful of lines per order
    pts = li.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", one.alias("x")))), lambda s: s["x"]), "").alias("points")
    )
    o = derive.table(spark, d, "orders").join(pts, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.selectExpr(
        "concat('<U><mRID>O', o_orderkey, '</mRID><revisionNumber>', o_custkey % 3 + 1, '</revisionNumber><createdDateTime>', date_format(o_orderdate, 'yyyy-MM-dd'), 'T06:00:00Z</createdDateTime>"
        "<unavailability_Time_Period.timeInterval><start>', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00Z</start><end>', date_format(date_add(o_orderdate, 2), 'yyyy-MM-dd'), 'T00:00Z</end></unavailability_Time_Period.timeInterval>"
        "<Reason><code>B', 18 + o_custkey % 2, '</code></Reason><TimeSeries><mRID>1</mRID><businessType>A5', 3 + o_custkey % 2, '</businessType><docStatus><value>A05</value></docStatus>"
        "<biddingZone_Domain.mRID codingScheme=\"A01\">10YDE-RWENET---I</biddingZone_Domain.mRID><production_RegisteredResource.name>R', o_custkey, '</production_RegisteredResource.name>"
        "<production_RegisteredResource.pSRType.psrType>B14</production_RegisteredResource.pSRType.psrType><production_RegisteredResource.pSRType.powerSystemResources.nominalP unit=\"MAW\">500</production_RegisteredResource.pSRType.powerSystemResources.nominalP>"
        "<Available_Period><timeInterval><start>', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00Z</start><end>', date_format(date_add(o_orderdate, 1), 'yyyy-MM-dd'), 'T00:00Z</end></timeInterval><resolution>PT60M</resolution>', points, '</Available_Period></TimeSeries></U>') AS xml"
    )


@query(
    "src6_prj10_outage_xml",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS INT) AS q FROM lineitem GROUP BY ALL),
n AS (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nx FROM p)
SELECT 'O' || o_orderkey || '_1' AS TimeSeriesInstanceCode, CAST(o_custkey % 3 + 1 AS INT) AS VersionNumber, o_orderdate + INTERVAL 6 HOUR AS VersionPublicationTimestampUTC,
 CASE o_custkey % 2 WHEN 0 THEN 'Planned' ELSE 'Forced' END AS Type, 'DE_Amprion' AS TSO, 'Nuclear' AS ProductionTypeName, 500.0::DOUBLE AS NominalCapacityMW,
 CASE o_custkey % 2 WHEN 0 THEN 'Failure' ELSE 'Maintenance' END AS ReasonGroup, o_orderdate + INTERVAL 2 DAY AS EndOutageUTC,
 o_orderdate + to_hours(CAST(l_linenumber - 1 AS INT)) AS StartTimeSeriesUTC, CASE WHEN nx IS NULL THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + to_hours(CAST(nx - 1 AS INT)) END AS EndTimeSeriesUTC, q::DOUBLE AS AvailableCapacityMW
FROM n JOIN orders ON o_orderkey = l_orderkey""",
)
def src6(spark, d):
    return mx.outage_intervals(_outage_docs(spark, d)).select(
        "TimeSeriesInstanceCode", "VersionNumber", "VersionPublicationTimestampUTC", "Type", "TSO", "ProductionTypeName",
        "NominalCapacityMW", "ReasonGroup", "EndOutageUTC", "StartTimeSeriesUTC", "EndTimeSeriesUTC", "AvailableCapacityMW",
    )


@query(
    "src19_outage_table",
    "SELECT 'north' AS area, CAST(o_custkey % 3 + 1 AS INT) AS version, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL UNION ALL SELECT 'south', CAST(o_custkey % 3 + 1 AS INT), count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL",
)
def src19(spark, d):
    # three parts read these rows; the documents are parsed once
    one = cut_lineage(mx.outage_intervals(_outage_docs(spark, d)).select("InstanceCode", "VersionNumber"))
    out = mx.outage_table({"north": one, "south": one.unionByName(one)})
    return out.groupBy(F.col("Area").alias("area"), F.col("VersionNumber").alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cmp4_hourly_topic_table",
    with_cte(_DOC)
    + """, r AS (SELECT user_id % 2 AS side, day + to_hours(CAST(position - 1 AS INT)) AS ts, q FROM hold WHERE user_id % 2 = 0
 UNION ALL SELECT user_id % 2, day + to_hours(CAST(position - 1 AS INT)), q FROM pt WHERE user_id % 2 = 1)
SELECT 'load_' || user_id AS metric, ts AS begin_date, q AS value FROM (SELECT 'X' || u AS user_id, ts, q FROM (SELECT user_id AS u, day + to_hours(CAST(position - 1 AS INT)) AS ts, q FROM hold WHERE user_id % 2 = 0
 UNION ALL SELECT user_id, day + to_hours(CAST(position - 1 AS INT)), q FROM pt WHERE user_id % 2 = 1))""",
)
def cmp4(spark, d):
    docs = _market_docs(spark, d).withColumn("xml", F.regexp_replace("xml", "<in_Domain.mRID[^/]*/in_Domain.mRID>", ""))
    rows = mx.market_intervals(mx.document_series(docs))
    return mx.hourly_topic(rows, F.concat(F.lit("load_"), F.col("domain"))).select("metric", "begin_date", "value")


_TOPIC_SQL = """
it AS (SELECT event_type AS kind, user_id % 3 AS area, value, event_id % 10 < 2 AS whole,
 CASE WHEN event_id % 10 < 2 THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END AS b, CASE event_id % 10 WHEN 0 THEN 3 ELSE 1 END AS n FROM events),
hx AS (SELECT kind, area, value, whole, date_trunc('hour', b) + to_hours(CAST(k AS INT)) AS h FROM it, LATERAL (SELECT unnest(range(n)) AS k)),
mx_ AS (SELECT h, """


def _topic_mean(name: str, cond: str) -> str:
    return f"coalesce(avg(value) FILTER (whole AND {cond}), avg(value) FILTER (NOT whole AND {cond})) AS {name}"


_TOPIC_CONDITIONS = {
    "load_forecast": "kind = 'view'", "load_actual": "kind = 'click'", "wind_forecast": "kind = 'signup' AND area = 0", "wind_actual": "kind = 'signup' AND area <> 0",
    "north_export": "kind = 'purchase' AND area = 0", "north_import": "kind = 'error' AND area = 0",
    "south_export": "kind = 'purchase' AND area > 0", "south_import": "kind = 'error' AND area > 0",
}


def _topics():
    on = {c: F.expr(cond) for c, cond in _TOPIC_CONDITIONS.items()}
    flows = tp.net_flows("flows", {c: (on[f"{c}_export"], on[f"{c}_import"]) for c in ("north", "south")})
    return [tp.forecast_errors("errors", {c: (on[f"{c}_forecast"], on[f"{c}_actual"]) for c in ("load", "wind")}), flows]


def _published(spark, d):
    """Events as published values of three resolutions: three hours, an hour, a quarter."""
    return derive.table(spark, d, "events").selectExpr(
        "event_type AS kind", "user_id % 3 AS area", "value",
        "CASE WHEN event_id % 10 < 2 THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END AS begin_date",
        "CASE WHEN event_id % 10 = 0 THEN date_trunc('hour', ts) + INTERVAL 3 HOURS WHEN event_id % 10 = 1 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR "
        "ELSE date_trunc('minute', ts) + INTERVAL 15 MINUTES END AS end_date",
    )


@query(
    "cmp4_wide_topics",
    "WITH "
    + _TOPIC_SQL
    + ", ".join(_topic_mean(c, cond) for c, cond in _TOPIC_CONDITIONS.items())
    + """ FROM hx GROUP BY h)
SELECT h AS begin_date, h + INTERVAL 1 HOUR AS end_date, round(load_forecast, 6) AS load_forecast, round(load_actual, 6) AS load_actual, round(load_forecast - load_actual, 6) AS load_error,
 round(wind_forecast, 6) AS wind_forecast, round(wind_actual, 6) AS wind_actual, round(wind_forecast - wind_actual, 6) AS wind_error,
 CASE WHEN coalesce(north_export, north_import) IS NOT NULL THEN round(coalesce(north_export, 0) - coalesce(north_import, 0), 6) END AS north,
 CASE WHEN coalesce(south_export, south_import) IS NOT NULL THEN round(coalesce(south_export, 0) - coalesce(south_import, 0), 6) END AS south FROM mx_""",
)
def cmp4_topics(spark, d):
    topics = _topics()
    return _r(tp.wide_topics(_published(spark, d), topics), *[c for t in topics for c in t.shown], n=6)


@query(
    "cmp4_net_flow_topic",
    "WITH "
    + _TOPIC_SQL
    + ", ".join(_topic_mean(c, cond) for c, cond in _TOPIC_CONDITIONS.items())
    + """ FROM hx GROUP BY h),
nt AS (SELECT h, CASE WHEN coalesce(north_export, north_import) IS NOT NULL THEN round(coalesce(north_export, 0) - coalesce(north_import, 0), 6) END AS north,
 CASE WHEN coalesce(south_export, south_import) IS NOT NULL THEN round(coalesce(south_export, 0) - coalesce(south_import, 0), 6) END AS south FROM mx_)
SELECT h AS begin_date, h + INTERVAL 1 HOUR AS end_date, north, south FROM nt WHERE coalesce(north, south) IS NOT NULL""",
)
def cmp4_flows(spark, d):
    topics = _topics()
    return _r(tp.topic_table(tp.wide_topics(_published(spark, d), topics), topics[1]), "north", "south", n=6)


@query(
    "src7_src20_snk1_dataset",
    with_cte(PN)
    + """SELECT 'data' AS part, tso AS operator, count(*) AS rows, round(sum(y), 4) AS total FROM pn WHERE unique_id = 'up' GROUP BY ALL
UNION ALL SELECT 'metadata', tso, count(*), 3 FROM pn GROUP BY tso""",
)
def src7(spark, d):
    p = derive.panel(spark, d).select(F.col("tso").alias("operator"), F.col("unique_id").alias("direction"), F.col("ds").alias("ts"), "y")
    root = staging_path(spark, "dataset")
    data = files.write_dataset(p, root, "basic", ["basic"])
    up = files.read_dataset(spark, data, "up").groupBy("operator").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("y"), 4).alias("total")
    ).select(F.lit("data").alias("part"), "operator", "rows", "total")
    meta = files.read_metadata(spark, f"{root}/basic_metadata").select(
        F.lit("metadata").alias("part"), "operator", "rows", F.size("columns").cast("double").alias("total")
    )
    return up.unionByName(meta)


def _stage_predictions(spark, d, attribution=False):
    """Prediction folders: the window layout for all, a last-checkpoint copy that must not be read."""
    p = derive.predictions(spark, d).withColumn("model", F.concat("model", F.lit("_seed7")))
    kind = "ig_preds_best_checkpoint" if attribution else "predictions_best_checkpoint"
    laid = p.select(
        "unique_id", "ds", "horizon", "y", F.col("y_pred").alias("forecast"),
        F.col("tso").alias("k1"), F.lit("ds1").alias("k2"), F.concat(F.lit("window_"), F.col("window_index")).alias("k3"),
        F.lit("evaluation").alias("k4"), F.lit(kind).alias("k5"),
        F.concat(F.lit(f"{kind}_"), F.col("model"), F.lit("_window"), F.col("window_index"), F.lit(".parquet")).alias("k6"),
    )
    root = staging_path(spark, "predictions")
    keys = ["k1", "k2", "k3", "k4", "k5", "k6"]
    last = laid.withColumns(
        {"k5": F.lit("predictions"), "forecast": F.col("forecast") + 1000,
         "k6": F.regexp_replace("k6", "^.*_checkpoint_", "predictions_")}
    )
    files.write_folders(laid.unionByName(last), root, keys)
    return root


_PSQL = with_cte(PN, PR) + "SELECT tso, unique_id, ds, horizon, y, window_index, model || '_seed7' AS model, y_pred FROM pr"


@query("src8_src9_window_predictions", _PSQL)
def src8(spark, d):
    out = pred.read_predictions(spark, _stage_predictions(spark, d), "ds1", True, "seed")
    return out.where("model <> ''")


@query(
    "src10_attribution_predictions",
    with_cte(PN, PR)
    + """SELECT tso, unique_id, ds, horizon, y, max(y_pred) FILTER (WHERE model = 'blend') AS blend_seed7, max(y_pred) FILTER (WHERE model = 'naive') AS naive_seed7,
 max(y_pred) FILTER (WHERE model = 'seasonal') AS seasonal_seed7, max(y_pred) FILTER (WHERE model = 'damped') AS damped_seed7 FROM pr GROUP BY ALL""",
)
def src10(spark, d):
    long = pred.read_predictions(spark, _stage_predictions(spark, d, True), "ds1", True, "seed", only=["attribution"])
    return pred.averaged(long, ["blend_seed7", "naive_seed7", "seasonal_seed7", "damped_seed7"])


@query(
    "src11_src12_src21_benchmark_csv",
    with_cte(PN, PR)
    + """SELECT tso, unique_id, ds, CAST(row_number() OVER (PARTITION BY tso, unique_id, model, date_trunc('day', ds) ORDER BY ds) AS INT) AS horizon, y,
 CASE model WHEN 'blend' THEN 'ridge_regression' ELSE model END AS model, y_pred FROM pr""",
)
def src11(spark, d):
    p = derive.predictions(spark, d).groupBy(*SERIES, "ds").agg(
        F.max("y").alias("y"),
        F.max(F.when(F.col("model") == "blend", F.col("y_pred"))).alias("linear_regression"),
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in ("naive", "seasonal", "damped")],
    )
    root = staging_path(spark, "benchmarks")
    p.select(
        "unique_id", F.date_format("ds", "yyyy-MM-dd HH:mm:ss").alias("ds"), "y", "linear_regression", "naive", "seasonal", "damped",
        F.col("tso").alias("k1"), F.lit("ds1").alias("k2"), F.lit("evaluation").alias("k3"), F.lit("benchmarks_a.csv").alias("k4"),
    ).repartition("k1").write.partitionBy("k1", "k2", "k3", "k4").option("header", True).csv(root)
    name = pred.resolve_dataset(pred.list_files(spark, root, "*.csv"), "other")
    return pred.read_benchmarks(spark, root, name, ["seasonal", "linear_regression", "damped", "naive"], strict=True)


@query(
    "src13_futures_csv",
    """WITH p AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY 1)
SELECT CAST(day AS TIMESTAMP) AS day, CASE WHEN isodow(day) = 3 THEN NULL ELSE price END AS gas FROM p""",
)
def src13(spark, d):
    p = derive.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 6).alias("p"))
    path = staging_path(spark, "futures")
    p.select(
        F.col("day").cast("string").alias("day"),
        F.when(F.weekday("day") == 2, "#N/A N/A").otherwise(F.col("p").cast("decimal(20,6)").cast("string")).alias("price"),
    ).write.option("header", True).csv(path)
    return files.read_futures(spark, path, "gas").withColumn("day", F.col("day").cast("timestamp"))


@query(
    "src14_holiday_csv",
    """WITH y AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT CAST(day AS TIMESTAMP) AS day, unnest(['50Hertz', 'TenneT DE']) AS operator, CAST(unnest([CAST(day(day) = 1 AS INT), CAST(day(day) <= 2 AS INT)]) AS INT) AS is_holiday FROM y""",
)
def src14(spark, d):
    days = derive.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    path = staging_path(spark, "holidays")
    days.select(
        "day", F.lit("some").alias("states"), (F.dayofmonth("day") == 1).cast("int").alias("50Hertz"),
        (F.dayofmonth("day") <= 2).cast("int").alias("TenneT DE"),
    ).write.option("header", True).csv(path)
    out = files.read_holidays(spark, path, ["50Hertz", "TenneT DE"])
    return out.withColumn("day", F.col("day").cast("timestamp"))


@query(
    "src16_datasets_by_name",
    with_cte(PN) + "SELECT tso AS operator, unique_id, count(*) AS n, round(sum(y), 4) AS total FROM pn GROUP BY ALL",
)
def src16(spark, d):
    root = staging_path(spark, "named")
    derive.panel(spark, d).withColumn("k", F.concat(F.lit("basic_"), F.col("tso"), F.lit(".parquet"))).drop("tso").repartition(
        "k"
    ).write.partitionBy("k").parquet(root)
    out = files.read_matching(spark, root, "basic")
    return out.groupBy("operator", "unique_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query(
    "src17_sweep_csv",
    with_cte(PN, PR)
    + "SELECT tso, unique_id, model AS model_name, window_index, round(avg(abs(y - y_pred)), 8) AS mae FROM pr GROUP BY ALL",
)
def src17(spark, d):
    root = staging_path(spark, "sweep")
    derive.predictions(spark, d).select(
        F.date_format("ds", "yyyy-MM-dd HH:mm:ss").alias("ds"), "unique_id", "y", "horizon", F.col("y_pred").alias("y_hat"),
        F.col("model").alias("model_name"), F.concat("model", F.lit("_i24")).alias("model_alias"), F.lit(24).alias("input_size"),
        "window_index", F.lit("validation").alias("eval_split"), "tso",
    ).write.option("header", True).csv(root)
    out = pred.read_sweep(spark, root)
    return _r(out.groupBy("tso", "unique_id", "model_name", "window_index").agg(F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("mae")), "mae")


@query(
    "src18_attribution_files",
    """WITH a AS (SELECT CAST(year(l_shipdate) - 1995 AS INT) AS "window", CAST(month(l_shipdate) AS INT) AS stride, l_returnflag AS feature, round(sum(l_tax), 4) AS value FROM lineitem GROUP BY ALL)
SELECT * FROM a""",
)
def src18(spark, d):
    root = staging_path(spark, "attribution")
    a = derive.table(spark, d, "lineitem").groupBy(
        F.concat(F.lit("window_"), F.year("l_shipdate") - 1995).alias("a"), F.concat(F.lit("stride_"), F.month("l_shipdate")).alias("b"),
        F.col("l_returnflag").alias("feature"),
    ).agg(F.round(F.sum("l_tax"), 4).alias("value"))
    a.repartition("a").write.partitionBy("a", "b").parquet(root)
    return pred.read_attributions(spark, root)


@query(
    "snk3_upsert_and_densify",
    """WITH o AS (SELECT user_id // 10 AS series, date_trunc('hour', ts) AS begin_date, round(sum(value), 2) AS value FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
n AS (SELECT user_id // 10 AS series, date_trunc('hour', ts) AS begin_date, round(sum(value) + 1, 2) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL),
m AS (SELECT series, begin_date, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (series, begin_date)),
g AS (SELECT series, unnest(generate_series(min(begin_date), max(begin_date), INTERVAL 1 HOUR)) AS begin_date FROM m GROUP BY 1)
SELECT series, begin_date, value FROM g LEFT JOIN m USING (series, begin_date)""",
)
def snk3(spark, d):
    e = derive.table(spark, d, "events")
    hourly = lambda rows, add: rows.groupBy(
        F.expr("user_id div 10").alias("series"), F.date_trunc("hour", "ts").alias("begin_date")
    ).agg(F.round(F.sum("value") + add, 2).alias("value"))
    old = hourly(e.where("ts < '2024-01-20'"), 0)
    new = hourly(e.where("ts >= '2024-01-15'"), 1)
    return files.merge_with_existing(old, new, ["series"])


@query(
    "snk4_cached_table",
    with_cte(PN, PR) + "SELECT tso, unique_id, model, round(sum(y_pred), 4) AS total FROM pr GROUP BY ALL",
)
def snk4(spark, d):
    path = staging_path(spark, "cache")
    make = lambda: derive.predictions(spark, d).groupBy(*KEYS).agg(F.round(F.sum("y_pred"), 4).alias("total"))
    files.cached_table(spark, path, make)
    return files.cached_table(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("not cached")))


@query(
    "set4_keep_first",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)
def set4_first(spark, d):
    e = derive.table(spark, d, "events").drop("props")
    return keep_one(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def _stream(spark, d):
    batch = spark.read.parquet(f"{d}/events.parquet")
    # the table's own path, one file or a folder of part files; as a pattern, since a stream's plain path must be a folder
    return spark.readStream.schema(batch.schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "str1_hourly_stream",
    """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY ALL)
SELECT h.* FROM h WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
)
def str1(spark, d):
    path = staging_path(spark, "stream")
    out = jobs.run_once(jobs.hourly_stream(_stream(spark, d), ["event_type"]), f"{path}/out", f"{path}/checkpoint")
    return _r(out, "value", n=4)


@query(
    "str2_upsert_stream",
    "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL",
)
def str2(spark, d):
    path = staging_path(spark, "upsert")
    stream = _stream(spark, d).select("user_id", "event_type", "value", "event_id", F.col("event_id").alias("batch_order"))
    return jobs.upsert_stream(spark, stream, f"{path}/table", f"{path}/checkpoint", ["user_id", "event_type"])


def _event_stream(spark, d):
    return _stream(spark, d).selectExpr(
        "event_id", "date_trunc('minute', ts) AS begin_date",
        "timestampadd(MINUTE, CAST(15 + event_id % 600 AS INT), date_trunc('minute', ts)) AS end_date",
        f"CAST({derive.MEAN_LOAD} AS DOUBLE) AS mean_load", "value AS total_load",
        "CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction", f"{derive.OPERATOR} AS operator",
    )


@query(
    "str3_interval_energy_stream",
    with_cte(IV, _src("'equal'"), _SPLIT_SQL)
    + """, a AS (SELECT operator, direction, ts, round(sum(hour_load), 6) AS total_load, count(*) AS n FROM hr GROUP BY ALL)
SELECT a.* FROM a WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 23 HOUR FROM hr)""",
)
def str3(spark, d):
    path = staging_path(spark, "energy")
    out = jobs.run_once(jobs.interval_energy_stream(_event_stream(spark, d), longest_hours=11), f"{path}/out", f"{path}/checkpoint")
    return _r(out, "total_load", n=6)


@query(
    "str3_dead_letters",
    with_cte(IV)
    + """SELECT event_id, begin_date, end_date, round(mean_load, 6) AS mean_load, round(total_load, 6) AS total_load, direction, operator, 'longer than 8 hours' AS reason
FROM iv WHERE epoch(end_date) - epoch(begin_date) > 8 * 3600""",
)
def str3_dead(spark, d):
    path = staging_path(spark, "energy")
    _, aside = jobs.run_energy(_event_stream(spark, d), f"{path}/out", f"{path}/checkpoint", longest_hours=8)
    return _r(aside, "mean_load", "total_load", n=6)

