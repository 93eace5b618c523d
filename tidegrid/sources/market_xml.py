"""Market publication documents: XML text in, interval rows out.

Documents are rows, so thousands of files parse in parallel; the schema is
explicit because inference would turn codes into numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.lookups import lookup
from tidegrid.operators.intervals import expand_curve
from tidegrid.sources import codes

_INTERVAL = "timeInterval STRUCT<start: STRING, end: STRING>"
_POINT = "Point ARRAY<STRUCT<position: STRING, quantity: STRING, `price.amount`: STRING>>"
_PERIOD = f"Period ARRAY<STRUCT<{_INTERVAL.replace(' ', ': ', 1)}, resolution: STRING, {_POINT.replace(' ', ': ', 1)}>>"

SERIES_SCHEMA = f"""
mRID STRING, businessType STRING, curveType STRING,
`inBiddingZone_Domain.mRID` STRING, `in_Domain.mRID` STRING,
`outBiddingZone_Domain.mRID` STRING, `out_Domain.mRID` STRING,
MktPSRType STRUCT<psrType: STRING>, `mktPSRType.psrType` STRING,
`flowDirection.direction` STRING, `quantity_Measure_Unit.name` STRING,
Reason ARRAY<STRUCT<code: STRING>>, {_PERIOD}
"""


def _as_struct(ddl: str) -> str:
    """Top-level DDL columns to struct fields."""
    out, depth, item = [], 0, ""
    for ch in ddl.replace("\n", " "):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(item.strip())
            item = ""
        else:
            item += ch
    out.append(item.strip())
    return ", ".join(x.replace(" ", ": ", 1) for x in out)


DOCUMENT_SCHEMA = f"""
mRID STRING, revisionNumber STRING, createdDateTime STRING,
`sender_MarketParticipant.mRID` STRING, `sender_MarketParticipant.marketRole.type` STRING,
`receiver_MarketParticipant.mRID` STRING, `receiver_MarketParticipant.marketRole.type` STRING,
TimeSeries ARRAY<STRUCT<{_as_struct(SERIES_SCHEMA)}>>
"""

OUTAGE_SCHEMA = f"""
mRID STRING, revisionNumber STRING, createdDateTime STRING,
`unavailability_Time_Period.timeInterval` STRUCT<start: STRING, end: STRING>,
Reason ARRAY<STRUCT<code: STRING>>,
TimeSeries ARRAY<STRUCT<
mRID: STRING, businessType: STRING, revisionNumber: STRING, createdDateTime: STRING, docStatus: STRUCT<value: STRING>,
`biddingZone_Domain.mRID`: STRING, `start_DateAndOrTime.date`: STRING, `start_DateAndOrTime.time`: STRING,
`end_DateAndOrTime.date`: STRING, `end_DateAndOrTime.time`: STRING,
Unavailability_Time_Period: STRUCT<timeInterval: STRUCT<start: STRING, end: STRING>>,
`production_RegisteredResource.mRID`: STRING, `production_RegisteredResource.name`: STRING,
`production_RegisteredResource.location.name`: STRING, psrType: STRING,
`production_RegisteredResource.pSRType.psrType`: STRING,
`production_RegisteredResource.pSRType.powerSystemResources.nominalP`: STRING,
Available_Period: ARRAY<STRUCT<timeInterval: STRUCT<start: STRING, end: STRING>, resolution: STRING, quantity: STRING,
Point: ARRAY<STRUCT<position: STRING, quantity: STRING>>>>>>
"""

_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "value"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``xml`` and ``file``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("xml"), F.col("_metadata.file_path").alias("file")
    )


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """TimeSeries elements straight from files, for documents larger than a row should be."""
    return (
        spark.read.format("xml").option("rowTag", "TimeSeries").options(**_OPTIONS).schema(SERIES_SCHEMA).load(path)
        .select(F.struct("*").alias("s"))
    )


def document_series(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Parse documents and give one row per TimeSeries: document fields and ``s``."""
    parsed = docs.withColumn("_d", F.from_xml(F.col(xml), DOCUMENT_SCHEMA, _OPTIONS))
    d = "_d.`{}`"
    return parsed.select(
        *[c for c in docs.columns if c != xml],
        F.col("_d.mRID").alias("doc_mrid"),
        F.coalesce(F.col("_d.revisionNumber").cast("int"), F.lit(1)).alias("doc_revision_number"),
        *[
            F.col(d.format(f"{side}_MarketParticipant.{tag}")).alias(f"{side}_{name}")
            for side in ("sender", "receiver")
            for tag, name in (("mRID", "mrid"), ("marketRole.type", "role"))
        ],
        F.explode("_d.TimeSeries").alias("s"),
    )


def utc(text: Column) -> Column:
    """ISO time with or without seconds, in UTC."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
        F.try_to_timestamp(text),
    )


def _minutes(resolution: Column, day: int, default: int) -> Column:
    table = {"PT1M": 1, "PT15M": 15, "PT30M": 30, "PT60M": 60, "PT1H": 60, "P1D": day}
    out = F.lit(default)
    for code, m in table.items():
        out = F.when(resolution == code, m).otherwise(out)
    return out


def _periods(series: DataFrame, value: str) -> DataFrame:
    points = F.transform(
        F.filter("p.Point", lambda x: x["position"].isNotNull()),
        lambda x: F.struct(
            x["position"].cast("int").alias("position"),
            F.coalesce(x[value].try_cast("double"), F.lit(0.0)).alias("quantity"),
        ),
    )
    return series.withColumn("p", F.explode("s.Period")).withColumns(
        {
            "resolution": F.coalesce(F.col("p.resolution"), F.lit("PT60M")),
            "period_start": utc(F.col("p.timeInterval.start")),
            "period_end": utc(F.col("p.timeInterval.end")),
            "points": points,
        }
    ).where("period_start IS NOT NULL AND period_end IS NOT NULL AND size(points) > 0")


def _steps(minutes: str) -> Column:
    return F.expr(f"CAST(floor(timestampdiff(SECOND, period_start, period_end) / ({minutes} * 60)) AS INT)")


def market_intervals(series: DataFrame, value: str = "quantity", business_type: str | None = None) -> DataFrame:
    """Interval rows of load, generation, price and exchange documents, one per period and step."""
    if business_type is not None:
        series = series.where(F.col("s.businessType") == business_type)
    rows = _periods(series, value)
    psr = F.coalesce(F.col("s.MktPSRType.psrType"), F.col("s.`mktPSRType.psrType`"))
    monthly = F.expr("resolution = 'P1M' AND curve_type = 'A03'")
    rows = rows.withColumns(
        {
            "psr_type": psr,
            "psr_type_name": lookup(psr, codes.PRODUCTION_TYPES, psr),
            "domain": F.coalesce(
                *[
                    F.col(f"s.`{t}`")
                    for t in ("inBiddingZone_Domain.mRID", "in_Domain.mRID", "outBiddingZone_Domain.mRID", "out_Domain.mRID")
                ]
            ),
            "curve_type": F.coalesce(F.col("s.curveType"), F.lit("A01")),
        }
    )
    rows = rows.withColumn("step_minutes", _minutes(F.col("resolution"), 60, 60)).withColumn(
        "step_months", F.when(monthly, F.lit(1))
    )
    months = F.expr("(year(period_end) - year(period_start)) * 12 + month(period_end) - month(period_start)")
    rows = rows.withColumn("n_steps", F.when(monthly, months).otherwise(_steps("step_minutes"))).where("n_steps > 0")
    keys = ["resolution", "psr_type", "psr_type_name", "domain"]
    return expand_curve(rows, keys).drop("position").dropDuplicates(
        ["begin_date", "end_date", "psr_type", "domain"]
    )


def redispatch_intervals(series: DataFrame, names: dict[str, str] | None = None, parties: dict[str, str] | None = None) -> DataFrame:
    """Interval rows of internal and cross-border redispatch documents.

    ``names`` maps domain codes to names, ``parties`` those of senders and receivers (by default the same); an unknown code is its own
    name. Values hold until the next point whatever the curve type.
    """
    names = names or codes.CONTROL_AREAS
    parties = names if parties is None else parties
    rows = _periods(series, "quantity")
    minutes = _minutes(F.col("p.resolution"), 1440, 15)
    s = lambda t: F.col(f"s.`{t}`")
    reasons = F.transform(
        F.filter("s.Reason", lambda r: r["code"].isNotNull()),
        lambda r: lookup(r["code"], codes.REDISPATCH_REASONS, r["code"]),
    )
    rows = rows.withColumns(
        {
            "ts_mrid": F.coalesce(F.concat_ws("_", "doc_mrid", F.col("s.mRID")), F.col("s.mRID")),
            "in_domain": s("in_Domain.mRID"),
            "out_domain": s("out_Domain.mRID"),
            "in_domain_name": lookup(s("in_Domain.mRID"), names, s("in_Domain.mRID")),
            "out_domain_name": lookup(s("out_Domain.mRID"), names, s("out_Domain.mRID")),
            "tso": lookup(s("in_Domain.mRID"), codes.CONTROL_AREAS),
            "psr_type": s("mktPSRType.psrType"),
            "psr_type_name": lookup(s("mktPSRType.psrType"), codes.RESOURCE_TYPES, s("mktPSRType.psrType")),
            "flow_direction": s("flowDirection.direction"),
            "flow_direction_name": lookup(s("flowDirection.direction"), codes.FLOW_DIRECTIONS, s("flowDirection.direction")),
            "quantity_unit": s("quantity_Measure_Unit.name"),
            "published_curve": F.col("s.curveType"),
            "reason_labels": F.when(F.size(reasons) > 0, F.array_join(reasons, ",")),
            "business_type": F.col("s.businessType"),
            "sender_mrid_name": lookup(F.col("sender_mrid"), parties, F.col("sender_mrid")),
            "receiver_mrid_name": lookup(F.col("receiver_mrid"), parties, F.col("receiver_mrid")),
            "sender_role_name": lookup(F.col("sender_role"), codes.PARTY_ROLES, F.col("sender_role")),
            "receiver_role_name": lookup(F.col("receiver_role"), codes.PARTY_ROLES, F.col("receiver_role")),
            "step_minutes": minutes,
            "step_months": F.lit(None).cast("int"),
            "curve_type": F.lit("A03"),
        }
    )
    rows = rows.withColumn("n_steps", _steps("step_minutes")).where("n_steps > 0")
    keys = [
        "doc_mrid", "doc_revision_number", "ts_mrid", "sender_mrid", "sender_mrid_name", "sender_role", "sender_role_name",
        "receiver_mrid", "receiver_mrid_name", "receiver_role", "receiver_role_name", "tso", "in_domain", "in_domain_name",
        "out_domain", "out_domain_name", "psr_type", "psr_type_name", "flow_direction", "flow_direction_name",
        "quantity_unit", "resolution", "published_curve", "reason_labels", "business_type",
    ]
    return (
        expand_curve(rows, keys).drop("position")
        .withColumnsRenamed(
            {
                "begin_date": "begin_timestamp_utc", "end_date": "end_timestamp_utc",
                "value": "quantity_mwh", "published_curve": "curve_type",
            }
        )
    )


def reason_group(text: Column) -> Column:
    out = F.lit("Other")
    for group, pattern in reversed(codes.REASON_GROUPS):
        out = F.when(F.lower(text).rlike(pattern), group).otherwise(out)
    return out


def outage_intervals(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Versioned unavailability rows: each point lasts to the next, the last one to the period end."""
    # from an array of one, as filters on a plain column would parse every document again for each of them
    parsed = docs.withColumn("_d", F.explode(F.array(F.from_xml(F.col(xml), OUTAGE_SCHEMA, _OPTIONS))))
    parsed = parsed.where(
        F.assert_true(F.col("_d.mRID").isNotNull(), F.lit("outage document without mRID")).isNull()
    ).withColumn("s", F.explode("_d.TimeSeries"))
    res = "s.`production_RegisteredResource.{}`"
    doc_period = F.col("_d.`unavailability_Time_Period.timeInterval`")

    def bound(side: str) -> Column:
        date, clock = F.col(f"s.`{side}_DateAndOrTime.date`"), F.col(f"s.`{side}_DateAndOrTime.time`")
        return utc(
            F.coalesce(
                F.col(f"s.Unavailability_Time_Period.timeInterval.{side}"),
                F.concat(date, F.lit("T"), clock),
                doc_period[side],
            )
        )

    reason = F.get(F.col("_d.Reason.code"), F.lit(0))
    psr = F.coalesce(F.col(res.format("pSRType.psrType")), F.col("s.psrType"))
    base = parsed.select(
        F.col("_d.mRID").alias("InstanceCode"),
        F.concat(F.col("_d.mRID"), F.lit("_"), F.col("s.mRID")).alias("TimeSeriesInstanceCode"),
        F.coalesce(F.col("s.revisionNumber"), F.col("_d.revisionNumber"), F.lit("1")).cast("int").alias("VersionNumber"),
        utc(F.coalesce(F.col("s.createdDateTime"), F.col("_d.createdDateTime"))).alias("VersionPublicationTimestampUTC"),
        F.col("s.docStatus.value").alias("Status"),
        F.col("s.businessType").alias("BusinessType"),
        lookup(F.col("s.businessType"), codes.OUTAGE_TYPES).alias("Type"),
        lookup(F.col("s.`biddingZone_Domain.mRID`"), codes.CONTROL_AREAS).alias("TSO"),
        F.col("s.`biddingZone_Domain.mRID`").alias("ControlArea"),
        psr.alias("ProductionType"),
        lookup(psr, codes.PRODUCTION_TYPES, psr).alias("ProductionTypeName"),
        F.col(res.format("name")).alias("ResourceName"),
        F.col(res.format("location.name")).alias("ResourceLocation"),
        F.col(res.format("mRID")).alias("ResourceCode"),
        F.col(res.format("pSRType.powerSystemResources.nominalP")).try_cast("double").alias("NominalCapacityMW"),
        reason.alias("ReasonCode"),
        lookup(reason, codes.OUTAGE_REASONS, reason).alias("ReasonText"),
        bound("start").alias("StartOutageUTC"),
        bound("end").alias("EndOutageUTC"),
        F.explode_outer("s.Available_Period").alias("p"),
    ).withColumn("ReasonGroup", F.coalesce(reason_group(F.col("ReasonText")), F.lit("Other")))
    minutes = _minutes(F.col("p.resolution"), 1440, 60)
    pts = F.transform(
        F.filter("p.Point", lambda x: x["position"].isNotNull()),
        lambda x: F.struct(x["position"].cast("int").alias("pos"), x["quantity"].try_cast("double").alias("q")),
    )
    rows = base.withColumn("_m", minutes).withColumn("_pts", pts).withColumn("_n", F.coalesce(F.size("_pts"), F.lit(0)))
    start, end = utc(F.col("p.timeInterval.start")), utc(F.col("p.timeInterval.end"))
    rows = rows.withColumn("_s", start).withColumn("_e", end)
    whole = F.array(
        F.struct(
            F.coalesce(F.col("_s"), F.col("StartOutageUTC")).alias("a"),
            F.coalesce(F.col("_e"), F.col("EndOutageUTC")).alias("b"),
            F.col("p.quantity").try_cast("double").alias("q"),
        )
    )
    at = "timestampadd(MINUTE, CAST(_m * ({} - 1) AS INT), _s)"
    parts = F.expr(
        "transform(_pts, (x, i) -> named_struct('a', " + at.format("x.pos") + ", 'b', CASE WHEN i + 1 < _n THEN "
        + at.format("_pts[i + 1].pos") + " ELSE _e END, 'q', x.q))"
    )
    return rows.withColumn("_i", F.explode(F.when(F.col("_n") > 0, parts).otherwise(whole))).select(
        *[c for c in base.columns if c != "p"],
        F.col("_i.a").alias("StartTimeSeriesUTC"),
        F.col("_i.b").alias("EndTimeSeriesUTC"),
        F.col("_i.q").alias("AvailableCapacityMW"),
        F.col("p.resolution").alias("Resolution"),
    )


def outage_table(parts: dict[str, DataFrame]) -> DataFrame:
    """Outages of several areas under one roof, exact duplicates removed."""
    out = None
    for area, df in parts.items():
        tagged = df.withColumn("Area", F.lit(area))
        out = tagged if out is None else out.unionByName(tagged)
    return out.dropDuplicates()


def hourly_topic(intervals: DataFrame, metric: Column, how: str = "mean") -> DataFrame:
    """Published intervals of one topic to one hourly row per metric."""
    from tidegrid.operators.densify import resample_hourly

    named = intervals.withColumn("metric", metric).dropDuplicates(["begin_date", "end_date", "metric"])
    return resample_hourly(named.select("metric", "begin_date", "end_date", "value"), ["metric"], how)
