"""Dashboard figures of every company in one pass per source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlode import rules
from leadlode.functions.common import let
from leadlode.operators.crm import label_picked


def dashboard_kpis(clients: DataFrame, history: DataFrame) -> DataFrame:
    """One row of key figures per company that has clients or e-mails."""
    status, score = F.col("status"), F.col("trust_score")
    c = clients.groupBy("company_id").agg(
        F.count("*").alias("total_companies_found"),
        F.count_if(
            F.coalesce(status.isin(list(rules.QUALIFIED_STATUSES)), F.lit(False))
            | F.coalesce(score >= 80, F.lit(False))
        ).alias("qualified_status"),
        F.count_if(status.isin(list(rules.ACTIVE_STATUSES))).alias("active_status"),
        F.avg("trust_score").alias("avg_score"),
    )
    # Two steps, so that a company with most of the log is counted per client first.
    h = (
        history.groupBy("company_id", "client_id")
        .agg(F.count("*").alias("n"))
        .groupBy("company_id")
        .agg(F.count("client_id").alias("mailed"), F.sum("n").alias("emails"))
    )

    def n(col):
        return F.coalesce(F.col(col), F.lit(0)).cast("bigint")

    return c.join(h, "company_id", "full_outer").select(
        "company_id",
        n("total_companies_found").alias("total_companies_found"),
        F.greatest(n("mailed"), n("qualified_status")).alias("qualified_leads"),
        F.greatest(n("emails"), n("active_status")).alias("active_outreach"),
        F.when(F.col("avg_score") > 0, F.round("avg_score", 1)).otherwise(0.0).alias("avg_trust_score"),
        n("emails").alias("total_emails_generated"),
    )


def log_time(value: Column, as_of: Column) -> Column:
    """Time of a log text in either written form; its UTC offset is dropped.

    Text that cannot be read counts as ``as_of``; NULL and '' stay NULL.  The cast
    to a zone-less timestamp keeps the wall-clock reading of an offset.
    """
    plain = F.substring_index(value, ".", 1)
    parsed = F.when(value.contains("T"), value.try_cast("timestamp_ntz")).when(
        plain.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), plain.try_cast("timestamp_ntz")
    )
    return F.when(value != "", F.coalesce(parsed, as_of))


def _as_time(df: DataFrame, column: str, as_of: Column) -> Column:
    if df.schema[column].dataType.typeName() == "string":
        return log_time(F.col(column), as_of)
    return F.col(column).cast("timestamp_ntz")


def week_of(at: Column, as_of: Column) -> Column:
    """1..4 for the four 7-day spans that end at ``as_of`` (later times are week 4)."""

    def pick(t):
        week = F.lit(None).cast("int")
        for number, days in ((1, 28), (2, 21), (3, 14), (4, 7)):
            week = F.when(t >= as_of - F.expr(f"interval {days} days"), number).otherwise(week)
        return week

    return let(at, pick)


WEEKS = (1, 2, 3, 4)


def weekly_chart(clients: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """E-mails, calls and meetings per company and week; empty weeks show 0.

    Each table is read once and becomes one wide row per company; the weeks turn
    into rows only after the join.
    """
    now = F.lit(as_of).cast("timestamp_ntz")

    def wide(df, **measures):
        dated = df.withColumn("week", week_of(_as_time(df, "created_at", now), now))
        return dated.groupBy("company_id").agg(
            *[
                F.count_if((F.col("week") == w) & condition).alias(f"{name}{w}")
                for name, condition in measures.items()
                for w in WEEKS
            ]
        )

    status = F.col("status")
    mails = wide(history, emails=F.lit(True))
    moves = wide(
        clients,
        calls=status == "Contacted",
        meetings=status.isin(list(rules.MEETING_STATUSES)),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(w).alias("week"),
                *[
                    F.coalesce(F.col(f"{name}{w}"), F.lit(0).cast("bigint")).alias(name)
                    for name in ("emails", "calls", "meetings")
                ],
            )
            for w in WEEKS
        ]
    )
    return mails.join(moves, "company_id", "full_outer").select("company_id", F.inline(rows))


def _last(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.col("id").desc())
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def activity_feed(
    clients: DataFrame, history: DataFrame, as_of: str, k: int = 6, recent: int = 5
) -> DataFrame:
    """The ``k`` latest events per company out of e-mails and client saves.

    The latest e-mails are picked before client names are looked up, so the join
    sees a handful of rows per company; so it is with their sequence labels, which
    are made here for a log that has none.
    """
    latest = _last(history, recent)
    if "label" not in history.columns:
        latest = label_picked(history, latest.withColumnRenamed("nth", "_nth")).withColumnRenamed("_nth", "nth")
    kind = F.col("email_type")
    word = F.when(kind == "outreach", "Cold Outreach").when(kind == "followup", "Follow-up").otherwise(
        "Negotiation Reply"
    )
    icon = F.when(kind == "outreach", "auto_awesome").when(kind == "followup", "sync").otherwise("handshake")
    who = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    mails = (
        latest.join(who, "client_id", "left")
        .select(
            "company_id",
            F.concat(F.col("label"), F.lit(" Generated")).alias("title"),
            F.concat(
                word, F.lit(" for "),
                F.coalesce(F.when(F.col("client_name") != "", F.col("client_name")), F.lit("Prospect")),
            ).alias("subtitle"),
            F.col("created_at").cast("string").alias("ts"),
            icon.alias("icon"),
            kind.alias("type"),
            F.lit(0).alias("src"),
            "nth",
        )
    )
    saves = _last(clients, recent).select(
        "company_id",
        F.concat(F.lit("Prospect Saved: "), F.col("name")).alias("title"),
        F.concat(
            F.lit("Fit Score: "), F.col("trust_score").cast("string"),
            F.lit("% · Status: "), F.col("status"),
        ).alias("subtitle"),
        F.coalesce(F.col("created_at").cast("string"), F.lit(as_of)).alias("ts"),
        F.lit("corporate_fare").alias("icon"),
        F.lit("saved").alias("type"),
        F.lit(1).alias("src"),
        "nth",
    )
    w = Window.partitionBy("company_id").orderBy(F.col("ts").desc(), "src", "nth")
    return (
        mails.unionByName(saves)
        .withColumn("rnk", F.row_number().over(w))
        .where(F.col("rnk") <= k)
        .select("company_id", "rnk", "title", "subtitle", "ts", "icon", "type")
    )
