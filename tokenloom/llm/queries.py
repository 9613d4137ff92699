"""The queries of the problems on text and training data, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import conversations, history, languages, mapping, packing, personal, tokens
from tokenloom.llm.sql import SQL
from tokenloom.operators.graph import checkpointed
from tokenloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.found(table(spark, folder, "replay_event"))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The timeline rows with typed placeholders."""
    return personal.redacted(table(spark, folder, "replay_event"))


def p1_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Of the redacted rows: how many there are, how many still hold a mention, and how many of those
    with a mention are as before. The last two are 0."""
    rows = table(spark, folder, "replay_event")
    out = checkpointed(personal.redacted(rows).select("event_id", "title", "detail"))
    mentioned = personal.found(rows).select("event_id").distinct()
    same = rows.join(mentioned, "event_id", "left_semi").join(out, "event_id").where(rows.title.eqNullSafe(out.title) & rows.detail.eqNullSafe(out.detail)).agg(F.count("*").alias("as_before"))
    left = personal.found(out).select("event_id").distinct().agg(F.count("*").alias("left_over"))
    return out.agg(F.count("*").alias("n")).crossJoin(left).crossJoin(same)  # one row each


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    names = mapping.reference_names(table(spark, folder, "model_reference"))
    return mapping.mapped(mapping.free_values(table(spark, folder, "usage_event"), table(spark, folder, "summary_report")), names)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.defects(table(spark, folder, "replay_event"), table(spark, folder, "replay_request"))


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations that are whole, turn by turn."""
    return conversations.conversations(table(spark, folder, "replay_event"), table(spark, folder, "replay_request"))


def p3_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations without their parts, which depend on the calibrated gap."""
    return p3_conversations(spark, folder).select("source", "session", "turn_no", "role", "ts_ms", "event_id")


def p7_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    """What `p7_found` gives, from one grouping of all events, without a history."""
    return history.repeats(history.prepared(*(table(spark, folder, t) for t in ("bundle_event", "usage_bundle", "device_record"))))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.batched(history.prepared(*(table(spark, folder, t) for t in ("bundle_event", "usage_bundle", "device_record"))))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return packing.containers(tokens.sizes(documents), rows=documents.count())


def p9_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Of the containers: how many texts there are; how many containers hold too much, texts aren't there
    token by token once, and texts are split although they fit; and whether more than a hundredth is unused
    beyond one container. All but the first are 0."""
    documents = table(spark, folder, "documents")
    sized = checkpointed(tokens.sizes(documents))
    parts = checkpointed(packing.containers(sized, rows=documents.count()))
    fill = parts.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    over = fill.agg(F.count_if(F.col("used") > packing.CAPACITY).alias("too_full"), (F.count("*") * packing.CAPACITY > F.sum("used") * 1.01 + packing.CAPACITY).cast("long").alias("wasteful"))
    placed = parts.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("parts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("reach"))
    both = sized.join(placed, "doc_id", "full")
    whole = F.coalesce((F.col("placed") == F.col("n_tokens")) & (F.col("reach") == F.col("n_tokens")), F.lit(False))
    texts = both.agg(F.count("*").alias("texts"), F.count_if(~whole).alias("not_whole"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= packing.CAPACITY)).alias("split"))
    return texts.crossJoin(over)  # one row each


def p10_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Of the labels: how many documents there are; and how many confidences are out of bounds, documents with a
    language lack segments or the reverse, and languages aren't among the segments. All but the first are 0."""
    rows = p10_labels(spark, folder)
    sure = lambda c: (c > 0) & (c <= 1)
    bad = F.col("lang").isNotNull() & ~(F.coalesce(sure(F.col("confidence")), F.lit(False)) & F.forall("segments", lambda s: sure(s["confidence"])))
    return rows.agg(
        F.count("*").alias("documents"), F.count_if(bad).alias("out_of_bounds"), F.count_if(F.col("lang").isNull() != (F.size("segments") == 0)).alias("without"),
        F.count_if(F.col("lang").isNotNull() & ~F.exists("segments", lambda s: s["lang"] == F.col("lang"))).alias("elsewhere"))


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every document and of its segments."""
    documents = table(spark, folder, "documents")
    return languages.labelled(documents, languages.fitted_model(documents))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = languages.doubtful(p10_labels(spark, folder)).selectExpr("doc_id", "posexplode(segments) as (at, segment)")
    return rows.selectExpr("doc_id", "at + 1 as segment_no", "segment.lang as lang")


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p1_properties": p1_properties,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p3_turns": p3_turns,
    "p7_found": p7_found,
    "p7_one_pass": p7_one_pass,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_properties": p9_properties,
    "p10_found": p10_found,
    "p10_labels": p10_labels,
    "p10_properties": p10_properties,
}
