"""Questions over processed documents: context lines, chat history, answers and their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.functions.text import strip


# The wording of contexts is our own: only a model reads them.


def field_line(name: Column, value: Column, masked: Column, bucket: Column, score: Column, corrected: Column) -> Column:
    """name = value [bucket 0.85, checked by hand]"""
    shown = F.when(F.coalesce(masked, F.lit(False)), K.MASKED).otherwise(F.coalesce(value, F.lit("(none)")))
    points = F.when(score.isNotNull(), F.format_string(" %.2f", score)).otherwise("")
    return F.concat(name, F.lit(" = "), shown, F.lit(" ["), F.coalesce(bucket, F.lit("unrated")), points, F.when(F.coalesce(corrected, F.lit(False)), ", checked by hand").otherwise(""), F.lit("]"))


def _stacked(lines: DataFrame, *order: str) -> DataFrame:
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"])
    return lines.groupBy("document_id").agg(F.array_join(sorted_lines, "\n").alias("lines"))


def field_lines(fields: DataFrame) -> DataFrame:
    """fields: document_id, pos, name, value, is_masked, bucket, combined_score, manually_corrected."""
    line = field_line(*[F.col(c) for c in ("name", "value", "is_masked", "bucket", "combined_score", "manually_corrected")])
    return _stacked(fields.select("document_id", "pos", line.alias("line")), "pos")


def table_lines(cells: DataFrame, masked_columns: tuple[str, ...] = ()) -> DataFrame:
    """Tables with their first rows; cells of masked_columns are not shown."""
    value = F.when(F.col("col_name").isin(*masked_columns), K.MASKED).otherwise(F.col("value")) if masked_columns else F.col("value")
    described = F.transform(F.array_sort(F.collect_list(F.struct("col_pos", F.concat("col_name", F.lit(" = "), value).alias("t")))), lambda s: s["t"])
    rows = cells.groupBy("document_id", "table_idx", "table_name", "row_index").agg(F.array_join(described, "; ").alias("t"))
    heads = rows.groupBy("document_id", "table_idx", "table_name").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.select("document_id", "table_idx", F.lit(0).alias("row_index"), F.concat(F.lit("table "), "table_name", F.lit(", rows: "), F.col("n").cast("string")).alias("line"))
    shown = rows.filter(F.col("row_index") <= K.CONTEXT_ROWS).select("document_id", "table_idx", "row_index", F.concat(F.lit("  "), F.col("row_index").cast("string"), F.lit(") "), "t").alias("line"))
    return _stacked(heads.unionByName(shown), "table_idx", "row_index")


def context(documents: DataFrame, fields: DataFrame, cells: DataFrame, checks: DataFrame, flags: DataFrame) -> DataFrame:
    """(document_id, context) of documents (document_id, doc_type, filename, upload_timestamp, is_confidential,
    sensitivity_level, reason, overall_status, n_corrections): a text that a model can read, without masked values."""
    failed = checks.filter("not passed").groupBy("document_id").agg(F.array_sort(F.collect_list("check_name")).alias("failed"))
    alerts = flags.groupBy("document_id").agg(F.count(F.lit(1)).alias("alerts"))
    out = documents.join(field_lines(fields).withColumnRenamed("lines", "field_lines"), "document_id", "left").join(table_lines(cells).withColumnRenamed("lines", "table_lines"), "document_id", "left")
    out = out.join(failed, "document_id", "left").join(alerts, "document_id", "left")
    name = F.coalesce(F.nullif("filename", F.lit("")), F.concat("doc_type", F.lit("_"), F.substring("document_id", 1, 8)))
    head = F.concat(F.lit("== "), name, F.lit(" ("), "doc_type", F.lit("), of "), F.substring("upload_timestamp", 1, 10), F.lit(", id "), "document_id")
    checked = F.concat(F.lit("checks: "), F.when(F.col("failed").isNull(), F.lit("all hold")).otherwise(F.concat(F.lit("these fail: "), F.array_join("failed", ", "))))
    warned = F.concat(F.lit("signs of tampering: "), F.coalesce("alerts", F.lit(0)).cast("string"))
    secret = F.when(F.col("is_confidential"), F.concat(F.lit("secrecy: "), F.lower("sensitivity_level"), F.lit(", because "), "reason")).otherwise("secrecy: none")
    status = F.concat(F.lit("review: "), "overall_status", F.lit(", corrections: "), F.col("n_corrections").cast("string"))
    return out.select("document_id", F.concat_ws("\n", head, "field_lines", "table_lines", checked, warned, secret, status).alias("context"))


def relevant(contexts: DataFrame, query: str, k: int) -> DataFrame:
    """The k contexts (…, seq) that share most words with the question, of equal ones the newest: for prompts with a limit."""
    words = [w for w in {x.lower() for x in query.split()} if len(w) > 2]
    hits = sum((F.contains(F.lower("context"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return contexts.withColumn("hits", hits).orderBy(F.desc("hits"), F.desc("seq"), "document_id").limit(k)


def recent_turns(conversations: DataFrame, k: int = K.HISTORY_TURNS) -> DataFrame:
    """(conv_id, history): the last k turns, oldest first, as 'Role: text' lines."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = conversations.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    line = F.concat(F.initcap(F.coalesce("role", F.lit("user"))), F.lit(": "), strip(F.coalesce("text", F.lit(""))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"])
    return last.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("history"))


TAG = r"(?i)REFERENCED_DOCS:\s*(\[[^\]]*\])"


def parse_answer(raw: Column) -> Column:
    """STRUCT of the answer without its tag, and the ids that the tag lists."""
    text = strip(raw)
    tagged = text.rlike(TAG)
    answer = F.when(tagged, strip(F.regexp_extract(text, r"(?is)^(.*?)REFERENCED_DOCS:\s*\[[^\]]*\]", 1))).otherwise(text)
    ids = F.coalesce(F.from_json(F.regexp_extract(text, TAG, 1), "array<string>"), F.array().cast("array<string>"))
    return F.struct(answer.alias("answer"), ids.alias("listed"))


def references(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, answer, referenced_documents): ids that the tag lists, then those of documents (document_id, seq)
    whose id or its first 8 characters stand anywhere in the answer, newest first; within an id that stands there as a whole no other
    id begins. Pieces of the answer of 8 characters are
    joined with the starts of ids, and shorter pieces with ids that are shorter, so that no answer is compared with every
    document."""
    parsed = answers.select("answer_id", parse_answer(F.col("raw")).alias("p")).select("answer_id", "p.*")
    ids = documents.filter("document_id != ''").select("document_id", "seq", F.substring("document_id", 1, 8).alias("piece"))
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.length("answer"), F.lit(1))))
    at = parsed.select("answer_id", "answer", start.alias("at"))
    pieces = at.select("answer_id", F.expr("substring(answer, at, 8)").alias("piece")).distinct()
    # Pieces of fewer characters are made only if there is an id of so few: one row says so.
    any_short = documents.agg(F.coalesce(F.bool_or((F.length("document_id") < 8) & (F.col("document_id") != "")), F.lit(False)).alias("any_short"))
    shorter = at.crossJoin(F.broadcast(any_short)).filter("any_short").select("answer_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.col("answer").substr(F.col("at"), n))).alias("piece")).distinct()
    short = F.length("document_id") < 8
    hit = pieces.join(ids.filter(~short), "piece").unionByName(shorter.join(ids.filter(short), "piece"))
    hit = hit.groupBy("answer_id", "document_id").agg(F.max("seq").alias("seq"))
    found = hit.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("o"), "document_id"))), lambda s: s["document_id"]).alias("found"))
    # Ids of random digits begin alike, or within each other: what is left beside whole ids decides for those that are not whole.
    longest = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    whole = F.array_sort(F.filter("found", lambda i: F.contains("answer", i)), longest)
    rest = F.aggregate(whole, F.col("answer"), lambda left, i: F.replace(left, i, F.lit("\n")))
    meant = F.filter("found", lambda i: F.contains("answer", i) | F.contains("rest", F.substring(i, 1, 8)))
    out = parsed.join(found, "answer_id", "left").withColumn("rest", rest).withColumn("found", meant)
    return out.select("answer_id", "answer", F.array_union("listed", F.coalesce("found", F.array().cast("array<string>"))).alias("referenced_documents"))
