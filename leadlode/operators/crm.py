"""Client table and e-mail log: upsert, overlay, labels, status moves, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode import rules, schemas
from leadlode.functions.common import or_none, text_or_empty
from leadlode.operators.components import connected_components
from leadlode.operators.ordered import numbered_rows, numbers_of
from leadlode.session import cut_lineage, drop_shared, write_shared
from leadlode.sources.versions import VersionedTable


def label_of(email_type: Column, nth: Column) -> Column:
    word = F.lit("Email")
    for kind, label in rules.LABEL_OF_TYPE.items():
        word = F.when(email_type == kind, label).otherwise(word)
    return F.concat_ws(" ", word, nth.cast("string"))


LABEL_KEYS = ["client_id", "company_id", "email_type"]


def label_picked(history: DataFrame, picked: DataFrame) -> DataFrame:
    """Sequence labels of some e-mails of a log; the others are only counted."""
    numbered = numbers_of(history, picked, LABEL_KEYS, "id")
    return numbered.withColumn("label", label_of(F.col("email_type"), F.col("nth"))).drop("nth")


def label_emails(history: DataFrame, already: DataFrame | None = None, **options) -> DataFrame:
    """Sequence label of every e-mail: ``Follow-up 3`` is the third of its type.

    ``already`` holds counts (``n``) per client, company and type of an older log
    that this one continues.
    """
    keys = LABEL_KEYS
    numbered = numbered_rows(history, keys, "id", **options)
    nth = F.col("nth")
    if already is not None:
        counts = already.select(F.struct(*keys).alias("_key"), F.col("n").alias("_n"))
        numbered = numbered.withColumn("_key", F.struct(*keys)).join(counts, "_key", "left")
        nth = nth + F.coalesce(F.col("_n"), F.lit(0))
    return numbered.withColumn("label", label_of(F.col("email_type"), nth)).drop("nth", "_n", "_key")


def log_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("client_id", "company_id", "email_type").agg(F.count("*").alias("n"))


def append_history(existing: DataFrame, new: DataFrame, as_of: Column, **options) -> DataFrame:
    """New log rows, labelled after the existing ones and stamped."""
    return (
        label_emails(new, log_counts(existing), **options)
        .withColumn("status", F.coalesce("status", F.lit("Draft")) if "status" in new.columns else F.lit("Draft"))
        .withColumn("created_at", as_of)
    )


def _latest(col: str, seq: Column) -> Column:
    """Newest non-NULL value with its load order; NULL when there is none."""
    return F.max(F.when(F.col(col).isNotNull(), F.struct(seq.alias("seq"), F.col(col).alias("value"))))


def upsert_clients(
    old: DataFrame, new: DataFrame, as_of: Column, fields=None, seq: str = "seq"
) -> DataFrame:
    """Save a batch of clients, matched by name or website inside a company.

    Rows of the batch that share a name or a website, directly or through others,
    are one client.  Its newest non-NULL values overlay the oldest matching row,
    or make a new one whose id follows the load order.  ``new`` has
    ``company_id, name, seq`` and any of the client fields.

    Starts Spark jobs at once, since the linking runs to a fixpoint.  Rows are
    reduced per name and website before they are linked, so a hot name never meets
    a join row by row.
    """
    changed, inserted, fields = _saves(old, new, as_of, fields, seq)
    updated = old.join(changed, "id", "left").select(*_overlay(old, fields))
    return updated.unionByName(inserted)


def client_changes(old: DataFrame, new: DataFrame, as_of: Column, fields=None, seq: str = "seq") -> DataFrame:
    """The rows that ``upsert_clients`` would change or add, whole; for tables that are saved by bucket."""
    changed, inserted, fields = _saves(old, new, as_of, fields, seq)
    return old.join(changed, "id").select(*_overlay(old, fields)).unionByName(inserted)


def save_clients(stored: VersionedTable, new: DataFrame, as_of: Column, **options) -> int:
    """Save a batch to a stored client table, rewriting only the buckets its clients are in; the new version."""
    rows, path = write_shared(client_changes(stored.read(), new, as_of, **options))
    version = stored.upsert(rows)
    drop_shared(new.sparkSession, path)
    return version


def _overlay(old: DataFrame, fields) -> list[Column]:
    return [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns]


def _saves(old: DataFrame, new: DataFrame, as_of: Column, fields, seq: str):
    """Changed fields (``id`` and ``_field``), new rows, and the fields that are saved."""
    fields = [f for f in (fields or schemas.CLIENT_FIELDS) if f in old.columns and f in new.columns]

    def key_of(prefix, col):
        return F.when(
            text_or_empty(F.col(col)) != "",
            F.concat_ws("|", F.lit(prefix), F.col("company_id").cast("string"), F.lower(F.col(col))),
        )

    def keyed(df):
        site = key_of("w", "website") if "website" in df.columns else F.lit(None).cast("string")
        return df.withColumn("_name", key_of("n", "name")).withColumn("_site", site)

    # One pass over the batch; all that follows works on this reduced table.
    folded = cut_lineage(
        keyed(new)
        .groupBy("company_id", "_name", "_site")
        .agg(*[_latest(f, F.col(seq)).alias(f) for f in fields], F.min(seq).alias("_first"))
    )
    pairs = folded.select("_name", "_site")
    wanted = pairs.select(F.col("_name").alias("_key")).union(pairs.select("_site")).where(
        F.col("_key").isNotNull()
    ).distinct()
    stored_keys = (
        keyed(old)
        .select("id", F.explode(F.array_compact(F.array("_name", "_site"))).alias("_key"))
        .join(wanted, "_key", "left_semi")
    )
    # A stored row links two incoming keys when it carries both.
    both = stored_keys.groupBy("id").agg(F.min("_key").alias("src"), F.max("_key").alias("dst"))
    edges = (
        pairs.where(F.col("_site").isNotNull())
        .select(F.col("_name").alias("src"), F.col("_site").alias("dst"))
        .union(both.select("src", "dst"))
    )
    labels = connected_components(edges)

    per_client = (
        folded.join(labels.withColumnRenamed("node", "_name"), "_name", "left")
        .withColumn("_label", F.coalesce("label", "_name"))
        .groupBy("company_id", "_label")
        .agg(*[F.max(f).alias(f) for f in fields], F.min("_first").alias("_first"))
    )
    oldest = (
        stored_keys.join(labels.withColumnRenamed("node", "_key"), "_key", "left")
        .groupBy(F.coalesce("label", "_key").alias("_label"))
        .agg(F.min("id").alias("_id"))
    )
    saved = per_client.join(oldest, "_label", "left").select(
        "_id", "_first", "company_id", *[F.col(f)["value"].alias(f) for f in fields]
    )

    changes = saved.where(F.col("_id").isNotNull()).select(
        F.col("_id").alias("id"), *[F.col(f).alias(f"_{f}") for f in fields]
    )
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    inserted = saved.where(F.col("_id").isNull()).select(
        (top + F.col("_first")).alias("id"),
        *[_insert_value(c, fields, as_of, old) for c in old.columns if c != "id"],
    )
    return changes, inserted, fields


def _insert_value(column: str, fields, as_of: Column, old: DataFrame) -> Column:
    kind = old.schema[column].dataType
    default = {"status": F.lit("Pending"), "trust_score": F.lit(0), "created_at": as_of}.get(column)
    if column == "company_id":
        return F.col(column).cast(kind).alias(column)
    value = F.col(column) if column in fields else F.lit(None)
    return (value if default is None else F.coalesce(value, default)).cast(kind).alias(column)


def update_clients(clients: DataFrame, changes: DataFrame, fields=None, seq: str = "seq") -> DataFrame:
    """Overlay the non-NULL fields of ``changes``.

    A client with several changes gets the newest non-NULL value of each field by ``seq``; without
    that column ``changes`` must hold one row per id and company.
    """
    fields = [f for f in (fields or schemas.CLIENT_FIELDS) if f in changes.columns and f in clients.columns]
    if seq in changes.columns:
        newest = changes.groupBy("id", "company_id").agg(*[_latest(f, F.col(seq)).alias(f) for f in fields])
        changes = newest.select("id", "company_id", *[F.col(f)["value"].alias(f) for f in fields])
    keyed = changes.select("id", "company_id", *[F.col(f).alias(f"_{f}") for f in fields])
    return clients.join(keyed, ["id", "company_id"], "left").select(
        *[
            F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in clients.columns
        ]
    )


def mark_contacted(clients: DataFrame, sent: DataFrame) -> DataFrame:
    """Pending clients that were mailed become Contacted."""
    mailed = sent.select("id", "company_id").distinct().withColumn("_sent", F.lit(True))
    moved = F.col("_sent") & (F.col("status") == "Pending")
    return (
        clients.join(mailed, ["id", "company_id"], "left")
        .withColumn("status", F.when(moved, "Contacted").otherwise(F.col("status")))
        .select(*clients.columns)
    )


def stage_of(status: Column) -> Column:
    """Board column of a status, ignoring case; NULL for a status of no stage."""
    s = F.lower(F.coalesce(or_none(status), F.lit("Pending")))
    stage = F.lit(None).cast("string")
    for name, statuses in rules.STAGE_OF_STATUS.items():
        stage = F.when(s.isin(list(statuses)), name).otherwise(stage)
    return stage


def pipeline_stages(clients: DataFrame) -> DataFrame:
    return clients.groupBy("company_id", stage_of(F.col("status")).alias("stage")).agg(
        F.count("*").alias("n")
    )
