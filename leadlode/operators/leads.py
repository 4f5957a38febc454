"""Lead scores folded from e-mail events, and the leads table.

A score starts at the lead's current value (20 for a new one), rises with opens
and clicks, falls to 0 on a bounce and is held in 0..100 at every step.  Because
nothing but a bounce lowers it, the fold has a closed form: the sum since the last
bounce, capped at 100.  That form combines from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlode import rules, schemas
from leadlode.functions.common import or_none

TOP = 100


def parse_webhooks(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Webhook JSON -> ``recipient, type`` and a ``status`` of ok / skipped / bad_json."""
    p = F.from_json(
        F.col(payload),
        schemas.WEBHOOK_PAYLOAD + ", _bad string",
        {"columnNameOfCorruptRecord": "_bad"},
    )
    recipient = F.get(F.col("_p.data.to"), 0)
    return (
        raw.withColumn("_p", p)
        .withColumn("recipient", or_none(recipient))
        .withColumn("type", F.col("_p.type"))
        .withColumn(
            "status",
            F.when(F.col("_p._bad").isNotNull() | F.col("_p").isNull(), "bad_json")
            .when(F.col("recipient").isNull(), "skipped")
            .otherwise("ok"),
        )
        .drop("_p")
    )


def delta_of(event_type: Column) -> Column:
    d = F.lit(0)
    for name, points in rules.EVENT_DELTA.items():
        d = F.when(event_type == name, points).otherwise(d)
    return d.cast("bigint")


def with_effects(events: DataFrame, type_col: str = "type") -> DataFrame:
    t = F.col(type_col)
    return events.select(
        "*",
        delta_of(t).alias("delta"),
        F.coalesce(t == rules.BOUNCE_EVENT, F.lit(False)).alias("is_bounce"),
        F.coalesce(t == "email.opened", F.lit(False)).alias("is_open"),
        F.coalesce(t == "email.clicked", F.lit(False)).alias("is_click"),
    )


def in_chunks(
    events: DataFrame, lead: str = "lead", ts: str = "ts", tie: str = "event_id", unit: str = "hour"
) -> DataFrame:
    """Events hashed on lead and time chunk, so that a busy lead is spread by time."""
    return (
        events.select(lead, ts, tie, "type")
        .withColumn("chunk", F.date_trunc(unit, F.col(ts)))
        .repartition(lead, "chunk")
    )


def chunk_summaries(
    events: DataFrame, lead: str = "lead", ts: str = "ts", tie: str = "event_id", unit: str = "hour"
) -> DataFrame:
    """Per lead and time chunk: what the chunk does to a score that enters it."""
    return summarize(in_chunks(events, lead, ts, tie, unit), lead, ts, tie)


def summarize(chunked: DataFrame, lead: str, ts: str, tie: str) -> DataFrame:
    at = F.struct(ts, tie)
    whole = Window.partitionBy(lead, "chunk")
    e = with_effects(chunked)
    e = e.withColumn("last_bounce", F.max(F.when(F.col("is_bounce"), at)).over(whole))
    after = F.col("last_bounce").isNull() | (at > F.col("last_bounce"))
    return e.groupBy(lead, "chunk").agg(
        F.max("is_bounce").alias("bounced"),
        F.sum(F.when(after, F.col("delta")).otherwise(0)).alias("gain"),
        F.max("is_open").alias("opened"),
        F.max("is_click").alias("clicked"),
        F.count("*").alias("n_events"),
    )


def combine_summaries(summaries: DataFrame, lead: str = "lead", order: str = "chunk") -> DataFrame:
    """Fold a lead's chunk summaries, in ``order``, into one summary per lead."""
    last = F.max(F.when(F.col("bounced"), F.col(order))).over(Window.partitionBy(lead))
    counted = F.col("_last").isNull() | (F.col(order) >= F.col("_last"))
    return (
        summaries.withColumn("_last", last)
        .groupBy(lead)
        .agg(
            F.max("bounced").alias("bounced"),
            F.sum(F.when(counted, F.col("gain")).otherwise(0)).alias("gain"),
            F.max("opened").alias("opened"),
            F.max("clicked").alias("clicked"),
            F.sum("n_events").alias("n_events"),
        )
    )


def in_range(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(TOP), score))


def final_score(start: Column, bounced: Column, gain: Column) -> Column:
    entered = F.when(bounced, 0).otherwise(in_range(start))
    return F.least(F.lit(TOP), entered + gain).cast("int")


def score_leads(events: DataFrame, leads: DataFrame, lead: str = "lead", **options) -> DataFrame:
    """New score and flags of every lead that had events.

    Events are reduced to one row per lead before they meet the leads table.
    Flags stay set once set.
    """
    folded = combine_summaries(chunk_summaries(events, lead, **options), lead)
    old = leads.select(
        lead,
        F.col("probability_score").alias("start"),
        *[F.col(c).alias(f"was_{c}") for c in ("opened", "clicked", "bounced")],
    )
    return folded.join(old, lead).select(
        lead,
        final_score(F.col("start"), F.col("bounced"), F.col("gain")).alias("score"),
        *[(F.col(c) | F.coalesce(F.col(f"was_{c}"), F.lit(False))).alias(c) for c in ("opened", "clicked", "bounced")],
        "n_events",
    )


def unknown_recipients(events: DataFrame, leads: DataFrame, lead: str = "lead") -> DataFrame:
    """Events whose recipient is no lead, counted per recipient."""
    return events.groupBy(lead).agg(F.count("*").alias("n_events")).join(leads.select(lead), lead, "left_anti")


def score_history(
    events: DataFrame,
    leads: DataFrame,
    lead: str = "lead",
    ts: str = "ts",
    tie: str = "event_id",
    unit: str = "hour",
) -> DataFrame:
    """The score of a lead after each of its events."""
    chunked = in_chunks(events, lead, ts, tie, unit)
    s = summarize(chunked, lead, ts, tie)
    by_chunk = Window.partitionBy(lead).orderBy("chunk")
    up_to = by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("run", F.sum(F.col("bounced").cast("int")).over(up_to))
    in_run = (
        Window.partitionBy(lead, "run").orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    s = s.withColumn("gained", F.sum("gain").over(in_run))
    s = s.select(
        lead,
        "chunk",
        F.coalesce(F.lag("gained").over(by_chunk), F.lit(0)).alias("entering"),
        (F.col("run") - F.col("bounced").cast("int") > 0).alias("after_bounce"),
    )
    old = leads.select(lead, F.col("probability_score").alias("start"))
    s = s.join(old, lead).select(
        lead,
        "chunk",
        (F.when(F.col("after_bounce"), 0).otherwise(in_range(F.col("start"))) + F.col("entering")).alias("entering"),
    )
    e = with_effects(chunked)
    rows = Window.unboundedPreceding, Window.currentRow
    e = e.withColumn(
        "g",
        F.sum(F.col("is_bounce").cast("int")).over(
            Window.partitionBy(lead, "chunk").orderBy(ts, tie).rowsBetween(*rows)
        ),
    )
    e = e.withColumn(
        "local",
        F.sum("delta").over(Window.partitionBy(lead, "chunk", "g").orderBy(ts, tie).rowsBetween(*rows)),
    )
    return e.join(s, [lead, "chunk"]).select(
        lead,
        ts,
        tie,
        "type",
        F.least(
            F.lit(TOP), F.col("local") + F.when(F.col("g") == 0, F.col("entering")).otherwise(0)
        ).cast("int").alias("score"),
    )


def upsert_leads(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert-or-replace keyed on the id and, independently, on the e-mail.

    A row stays when no later row has its id and no later row has its e-mail.
    ``new`` comes with a load order ``seq`` >= 1; old rows rank before all of it
    and hold both keys only once.
    """
    fresh = new.select(
        *[F.col(c) for c in old.columns if c in new.columns],
        *[F.lit(False).alias(c) for c in ("opened", "clicked", "replied", "bounced") if c not in new.columns],
        *([F.lit(rules.START_SCORE).alias("probability_score")] if "probability_score" not in new.columns else []),
        F.col(seq).alias("_seq"),
    )
    rows = old.withColumn("_seq", F.lit(0).cast("bigint")).unionByName(fresh, allowMissingColumns=True)

    def latest(key):
        w = Window.partitionBy(key).orderBy(F.col("_seq").desc())
        return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")

    return (
        latest("contact_email")
        .join(latest("id").select("id", "_seq"), ["id", "_seq"], "left_semi")
        .drop("_seq")
        .select(*old.columns)
    )


def leads_from_companies(cards: DataFrame, company_id: int = 1) -> DataFrame:
    """Accepted company cards as new lead rows; the address is a guess and says so."""
    domain = F.coalesce(or_none(F.col("domain")), F.lit("company.com"))
    card = F.to_json(F.struct(*[F.col(c) for c in cards.columns]))
    return cards.select(
        F.concat(F.lit("co-"), F.col("domain")).alias("id"),
        F.coalesce(or_none(F.col("name")), F.lit("Unknown Company")).alias("company_name"),
        F.col("snippet").alias("company_description"),
        F.concat(F.lit("contact@"), domain).alias("contact_email"),
        F.lit(True).alias("is_guessed"),
        F.concat(F.lit("Outreach opportunity for "), F.col("name")).alias("subject"),
        F.coalesce(or_none(F.col("matchReason")), F.lit("AI Qualified Prospect")).alias("suggested_action"),
        card.alias("email_source_context"),
        F.lit(company_id).alias("company_id"),
    )
