"""Lead-score queries, in batch and over a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadlode.operators import candidates as CA
from leadlode.operators import leads as LE
from leadlode.plans import views as V
from leadlode.session import checkpoint_dir, shared_files
from leadlode.sources.readers import table
from leadlode.streaming import candidates as SC
from leadlode.streaming import scores as SS
from leadlode.functions import text as TX


def lead_scores(spark, folder):
    return LE.score_leads(V.events(spark, folder), V.leads(spark, folder))


def lead_score_history(spark, folder):
    return LE.score_history(V.events(spark, folder), V.leads(spark, folder)).select("lead", "event_id", "score")


def unknown_recipients(spark, folder):
    return LE.unknown_recipients(V.events(spark, folder), V.leads(spark, folder))


def _payload(events):
    body = F.to_json(
        F.struct("type", F.struct(F.array(F.col("lead").cast("string")).alias("to")).alias("data"))
    )
    # Some messages arrive cut off, some without a recipient.
    return (
        F.when(F.col("event_id") % 50 == 0, F.substring(body, 1, 12))
        .when(F.col("event_id") % 50 == 1, '{"type": "email.opened", "data": {"to": []}}')
        .otherwise(body)
    )


def webhook_status(spark, folder):
    e = V.events(spark, folder)
    raw = e.select("ts", "event_id", _payload(e).alias("payload"))
    return LE.parse_webhooks(raw).groupBy("status", "type").agg(F.count("*").alias("n"))


def _fresh_root(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, folder, name):
    """A table as a stream: the files of its folder, or the one file it is."""
    path = f"{folder}/{name}.parquet"
    source = spark.readStream.schema(table(spark, folder, name).schema)
    files, where = shared_files(spark, path)
    if files.getFileStatus(where).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_scores(spark, folder):
    """Webhook messages read as a stream; scores after the stream has drained."""
    kind = F.lit("email.delivered")
    for source, event in V.EVENT_OF.items():
        kind = F.when(F.col("event_type") == source, event).otherwise(kind)
    body = F.to_json(
        F.struct(
            kind.alias("type"),
            F.struct(F.array(F.col("user_id").cast("string")).alias("to")).alias("data"),
        )
    )
    raw = _stream(spark, folder, "events").select("ts", "event_id", body.alias("payload"))
    parsed = LE.parse_webhooks(raw).withColumn("lead", F.col("recipient").try_cast("bigint"))
    root = _fresh_root(spark, "scores")
    SS.start_scores(parsed, root).awaitTermination()
    return SS.current_scores(SS.read_summaries(spark, root), V.leads(spark, folder)).select(
        "lead", "score", "opened", "clicked", "bounced", "n_events"
    )


def stream_candidates(spark, folder):
    """Domains that pass the rules, each once, out of a stream of pages."""
    hits = _stream(spark, folder, "pages").select(
        "page_id", "url", TX.html_title(F.col("html")).alias("title")
    )
    root = _fresh_root(spark, "candidates")
    (
        SC.first_domains(SC.clean_stream(hits, excluded=V.EXCLUDED))
        .writeStream.format("parquet")
        .option("path", f"{root}/domains")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("domain string").parquet(f"{root}/domains")


def stream_page_counters(spark, folder):
    """Hits per ten pages, counted over a stream; each batch writes the pages it changed."""
    hits = _stream(spark, folder, "pages").select(
        "page_id", (F.col("page_id") % 10).alias("page"), "url", TX.html_title(F.col("html")).alias("title")
    )
    root = _fresh_root(spark, "counters")

    def step(changed, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/counts/batch={batch}")

    (
        SC.page_counters(CA.filter_candidates(hits, excluded=V.EXCLUDED))
        .writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    counts = SS.read_batches(spark, f"{root}/counts", "page bigint, processed bigint, qualified bigint")
    return counts.groupBy("page").agg(F.max("processed").alias("processed"), F.max("qualified").alias("qualified"))


QUERIES = {
    f.__name__: f
    for f in (
        lead_scores, lead_score_history, unknown_recipients, webhook_status, stream_scores, stream_candidates,
        stream_page_counters,
    )
}

_RUNS = f"""
  e AS (SELECT *, sum(CASE WHEN type = 'email.bounced' THEN 1 ELSE 0 END)
               OVER (PARTITION BY lead ORDER BY ts, event_id) AS g FROM ({V.EVENTS})),
  h AS (SELECT e.*, l.was_bounced, least(100, CASE WHEN g = 0 THEN l.start ELSE 0 END +
               sum(delta) OVER (PARTITION BY lead, g ORDER BY ts, event_id)) AS score
        FROM e JOIN ({V.LEADS}) l USING (lead)),
  f AS (SELECT lead, CAST(arg_max(score, (ts, event_id)) AS INTEGER) AS score, bool_or(type = 'email.opened') AS opened,
               bool_or(type = 'email.clicked') AS clicked, bool_or(type = 'email.bounced') OR bool_or(was_bounced) AS bounced,
               count(*) AS n_events FROM h GROUP BY lead)"""

SQL = {
    "lead_scores": f"WITH {_RUNS} SELECT lead, score, opened, clicked, bounced, n_events FROM f",
    "lead_score_history": f"WITH {_RUNS} SELECT lead, event_id, CAST(score AS INTEGER) AS score FROM h",
    "unknown_recipients": "SELECT user_id AS lead, count(*) AS n_events FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
    "webhook_status": f"""
        SELECT CASE event_id % 50 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status,
               CASE event_id % 50 WHEN 0 THEN NULL WHEN 1 THEN 'email.opened' ELSE type END AS type, count(*) AS n
        FROM ({V.EVENTS}) GROUP BY ALL""",
    "stream_scores": f"WITH {_RUNS} SELECT lead, score, opened, clicked, bounced, n_events FROM f",
    "stream_page_counters": f"""
        SELECT page_id % 10 AS page, count(*) AS processed, count(*) FILTER (reject_reason IS NULL) AS qualified
        FROM ({V.CANDIDATES}) GROUP BY 1""",
    "stream_candidates": f"SELECT DISTINCT domain FROM ({V.CANDIDATES}) WHERE reject_reason IS NULL",
}
