"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, mask, replies, sqlfuncs, text
from ..functions.opaque import mask_variant as mask_unknown
from ..functions.rules import CORE, GENERIC_MASK, VARIANT
from ..operators import aggregate, align, nested, ordered, rows, runs, windows
from ..session import dealt, scratch_dir, spread, table, tune
from ..sources import generate, json_ranges, readers, writers
from ..streaming import streams
from . import inputs, verify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _texts(spark, sf, name, key):
    return spread(table(spark, sf, name), key)


# ------------------------------------------------------------------ detection


@query
def pii_count_by_type(spark, sf):
    t = F.col("text")
    return _texts(spark, sf, "documents", "doc_id").select("doc_id", *detect.count_by_type(t), detect.count_pii(t).alias("n_pii"))


@query
def pii_rows(spark, sf):
    return rows.filter_pii_rows(_texts(spark, sf, "documents", "doc_id"), "text").select("doc_id", "source")


@query
def clean_rows(spark, sf):
    return rows.filter_clean(_texts(spark, sf, "pages", "page_id"), "html").select("page_id", "url")


@query
def pii_spans(spark, sf):
    return rows.pii_spans(_texts(spark, sf, "documents", "doc_id"), "doc_id", "text")


@query
def span_counts(spark, sf):
    return aggregate.span_counts(_texts(spark, sf, "pages", "page_id"), "page_id", "html")


@query
def cc_double_count(spark, sf):
    return _texts(spark, sf, "documents", "doc_id").select("doc_id", detect.count_cc(F.col("text")).alias("n_cc"))


@query
def total_matches_by_lang(spark, sf):
    return aggregate.total_matches(_texts(spark, sf, "documents", "doc_id"), ["text", "source"], CORE, ["lang"])


@query
def pii_summary_by_source(spark, sf):
    return aggregate.pii_summary(_texts(spark, sf, "documents", "doc_id"), "text", ["source", "lang"])


@query
def dataset_summary(spark, sf):
    return aggregate.dataset_summary(_texts(spark, sf, "documents", "doc_id"), "doc_id", "text")


@query
def variant_count_by_type(spark, sf):
    return _texts(spark, sf, "pages", "page_id").select("page_id", *detect.count_by_type(F.col("html"), VARIANT))


# -------------------------------------------------------------------- masking


@query
def mask_documents_typed(spark, sf):
    return _texts(spark, sf, "documents", "doc_id").select("doc_id", mask.mask_all(F.col("text")).alias("masked"))


@query
def mask_pages_generic(spark, sf):
    masked = mask.mask_generic(F.col("html"), VARIANT.masked_as(GENERIC_MASK))
    return _texts(spark, sf, "pages", "page_id").select("page_id", masked.alias("masked"))


@query
def mask_customers(spark, sf):
    masked = mask.mask_columns(inputs.customers(spark, sf).drop("c_custkey", "c_nationkey"), mask.CARD_ONLY)
    return masked.select(*inputs.CUSTOMER_COLUMNS)


@query
def mask_residue(spark, sf):
    once, twice = mask.mask(F.col("text")), mask.mask(F.col("text"), passes=2)
    masked = _texts(spark, sf, "documents", "doc_id").select("doc_id", once.alias("once"), twice.alias("twice"))
    return masked.select(
        "doc_id",
        detect.count_pii(F.col("once")).alias("n_after_one"),
        detect.count_pii(F.col("twice")).alias("n_after_two"),
        mask.residual_digit_run(F.col("once")).alias("residual_digit_run"),
    )


@query
def removal_by_source(spark, sf):
    docs = _texts(spark, sf, "documents", "doc_id")
    masked = docs.select("source", "text", mask.mask_all(F.col("text")).alias("masked"))
    return aggregate.removal_summary(masked, "text", "masked", ["source"])


@query
def sql_mask_all(spark, sf):
    sqlfuncs.register(spark)
    _texts(spark, sf, "documents", "doc_id").createOrReplaceTempView("veilwork_documents")
    return spark.sql(
        "select doc_id, mask_all(text) as masked, count_all(text) as n_pii, contains_all(text) as has_pii,"
        " count_cards(text) as n_cc from veilwork_documents"
    )


@query
def mask_struct(spark, sf):
    masked = mask.mask_struct(inputs.records(spark, sf), "doc", CORE, only="customers")
    return nested.json_leaves(masked, "id", "doc").select("id", "path", "value")


@query
def mask_json_text(spark, sf):
    docs = inputs.records(spark, sf)
    masked = docs.select("id", mask.mask_json_text(writers.json_text(docs, "doc")).alias("doc"))
    typed = masked.select("id", F.from_json("doc", docs.schema["doc"].dataType).alias("doc"))
    return nested.json_leaves(typed, "id", "doc").select("id", "path", "value")


@query
def mask_variant(spark, sf):
    docs = inputs.records(spark, sf)
    masked = mask_unknown(docs.select("id", writers.json_text(docs, "doc").alias("doc")), "doc")
    typed = masked.select("id", F.from_json("doc", docs.schema["doc"].dataType).alias("doc"))
    return nested.json_leaves(typed, "id", "doc").select("id", "path", "value")


# ----------------------------------------------------------- lines and tokens


@query
def doc_lines(spark, sf):
    return rows.text_lines(_texts(spark, sf, "documents", "doc_id"), "doc_id", "text")


@query
def doc_line_counts(spark, sf):
    n = text.count_lines(F.col("text"))
    return _texts(spark, sf, "documents", "doc_id").select("doc_id", n.alias("n_lines"))


def _chat(spark, sf):
    return inputs.chat(spread(table(spark, sf, "events"), "event_id"))


@query
def chat_parse(spark, sf):
    parsed = text.parse_chat_line(F.col("line"))
    lines = inputs.masked_chat(_chat(spark, sf)).select("event_id", parsed.alias("p"))
    return lines.select("event_id", F.col("p.ts").alias("clock"), "p.user", "p.message")


@query
def chat_format_ratio(spark, sf):
    ok = detect.line_format_ok(F.col("line"))
    counted = inputs.masked_chat(_chat(spark, sf)).groupBy("user_id").agg(
        F.count("*").alias("n_lines"), F.count_if(ok).alias("n_formatted")
    )
    ratio = text.safe_ratio(F.col("n_formatted"), F.col("n_lines"))
    return counted.withColumn("format_ratio", text.round4(ratio))


@query
def chat_ssn_find(spark, sf):
    found = F.array_join(detect.find_ssns(F.col("line")), ",")
    return _chat(spark, sf).select("event_id", found.alias("ssns"))


@query
def mask_chat_ssn(spark, sf):
    return _chat(spark, sf).select("event_id", mask.mask_ssn(F.col("line")).alias("line"))


@query
def chat_tokens(spark, sf):
    return rows.distinct_tokens(_chat(spark, sf), ["user_id"], "line")


@query
def token_survival(spark, sf):
    base = _chat(spark, sf)
    survived = align.token_survival(base, inputs.masked_chat(base), "user_id", "line")
    return survived.filter("n_tokens > 0")


@query
def document_tokens(spark, sf):
    return rows.distinct_tokens(_texts(spark, sf, "documents", "doc_id"), ["source"], "text")


# ------------------------------------------------------------ scalar functions


@query
def card_format(spark, sf):
    k = F.col("c_custkey")
    digits = F.concat(F.lit("4"), F.lpad(k.cast("string"), 15, "0"))
    style = F.element_at(F.array(F.lit("raw"), F.lit("dashed"), F.lit("spaced")), (k % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.format_card(digits, style).alias("card"),
        text.format_card(F.left(digits, F.lit(15)), style).alias("short_card"),
        text.format_ssn(100 + k % 800, k % 90, k % 9000).alias("ssn"),
        text.format_phone(200 + k % 700, k % 900, k % 9000).alias("phone"),
        text.format_email(F.col("c_mktsegment"), k.cast("string"), F.lit("example.org")).alias("email"),
        text.format_clock(k * 37).alias("clock"),
    )


@query
def truncate_preview(spark, sf):
    t = F.col("text")
    return _texts(spark, sf, "documents", "doc_id").select(
        "doc_id", text.truncate_marked(t, 2000).alias("shown"), text.one_line_preview(t).alias("preview")
    )


@query
def strip_values(spark, sf):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))
    stripped = table(spark, sf, "conversations").select("conv_id", "turn", text.strip(padded).alias("stripped"))
    return stripped.withColumn("n_chars", F.length("stripped").cast("long"))


@query
def path_parts(spark, sf):
    paths = nested.json_key_paths(inputs.records(spark, sf), "id", "doc")
    return paths.select("id", "path", F.array_join(text.path_parts(F.col("path")), "|").alias("parts"))


@query
def template_notes(spark, sf):
    k = F.col("c_custkey")
    card = F.concat(F.lit("4"), F.lpad(k.cast("string"), 15, "0"))
    note = text.template_fill(generate.CARD_NOTES, k % len(generate.CARD_NOTES), {"cc": card})
    return table(spark, sf, "customer").select("c_custkey", note.alias("note"))


@query
def parse_action(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    call = F.format_string('{"action_type": "%s", "command": "ls -%d"}', F.when(c % 2 == 0, "python").otherwise("bash"), c)
    reply = (
        F.when(t % 5 == 0, call)
        .when(t % 5 == 1, F.concat(F.lit("```json\n"), call, F.lit("\n```")))
        .when(t % 5 == 2, F.format_string('{"action_type": "perl", "command": "x%d"}', c))
        .when(t % 5 == 3, F.lit("  "))
        .otherwise(F.col("text"))
    )
    parsed = table(spark, sf, "conversations").select("conv_id", "turn", replies.parse_action(reply).alias("a"))
    return parsed.select("conv_id", "turn", "a.action_type", "a.command")


@query
def flatten_observation(spark, sf):
    e = F.col("event_id")
    outer = (
        F.when(e % 4 == 0, F.format_string(', "reward": 0.%d, "done": true', e % 9))
        .when(e % 4 == 1, F.lit(', "reward": null'))
        .otherwise("")
    )
    envelope = F.concat(
        F.lit('{"type": "observation", "data": {"observation": {"stdout": "'),
        F.col("event_type"),
        F.format_string('", "stderr": "", "exit_code": %d, "file_tree": ["a.csv", "b/%d.txt"], "done": false, "reward": 0.5, "error": null}', e % 3, e),
        outer,
        F.lit("}}"),
    )
    flat = table(spark, sf, "events").select("event_id", *replies.flatten_observation(envelope))
    return flat.withColumn("file_tree", F.array_join("file_tree", "|"))


# ----------------------------------------------------------------- alignment


def _customer_pair(spark, sf):
    base = inputs.customers(spark, sf)
    return base, inputs.masked_customers(base)


@query
def table_align_key(spark, sf):
    base, cand = _customer_pair(spark, sf)
    return align.align_by_key(base, cand, "id").select("id", "n_baseline", "n_candidate", "n_equal")


@query
def table_align_position(spark, sf):
    base, cand = (align.with_rank(df, "c_custkey") for df in _customer_pair(spark, sf))
    return align.align_by_position(base, cand, "row_index").select(
        "row_index", F.col("b.id").alias("baseline_id"), F.col("c.id").alias("candidate_id"), "n_equal"
    )


@query
def json_leaves(spark, sf):
    return nested.json_leaves(inputs.records(spark, sf), "id", "doc").select("id", "path", "value")


@query
def json_key_paths(spark, sf):
    return nested.json_key_paths(inputs.records(spark, sf), "id", "doc")


@query
def json_nodes_untyped(spark, sf):
    docs = inputs.records(spark, sf)
    return nested.json_nodes(docs.select("id", writers.json_text(docs, "doc").alias("doc")), "id", "doc").select(
        "id", "path", "value", "is_key"
    )


@query
def props_key_paths(spark, sf):
    return nested.json_key_paths(table(spark, sf, "events").select("event_id", "props"), "event_id", "props")


@query
def get_by_path(spark, sf):
    docs = inputs.records(spark, sf)
    doc = F.try_parse_json(writers.json_text(docs, "doc"))
    at = lambda p: nested.get_by_path(F.col("v"), F.lit(p))
    return docs.select("id", doc.alias("v")).select(
        "id",
        at("customers[0].profile.ssn").alias("ssn"),
        at("customers[0].orders[1].payment.card_number").alias("second_card"),
        at("customers[0].loyalty_points").alias("not_text"),
    )


@query
def explode_records(spark, sf):
    customer = nested.explode_records(inputs.records(spark, sf), "doc.customers", "customer", "id")
    order = nested.explode_records(customer, "customer.orders", "ord", "id")
    item = nested.explode_records(order, "ord.items", "item", "id", "ord")
    return item.select(
        "id",
        F.col("ord.order_id").alias("order_id"),
        F.col("item_no").cast("long").alias("item_no"),
        F.col("item.sku").alias("sku"),
        F.col("item.qty").alias("qty"),
        F.col("item.price").alias("price"),
    )


def _record_pair(spark, sf):
    base = inputs.records(spark, sf, dealt)
    return base, inputs.masked_records(base)


@query
def key_path_overlap(spark, sf):
    return align.key_path_overlap(*_record_pair(spark, sf), "id", "doc").filter("n_paths > 0")


@query
def path_lookup(spark, sf):
    return align.path_lookup(*_record_pair(spark, sf), "id", "doc").select("id", "path", "value", "found")


# -------------------------------------------------------------- verification


@query
def score_table(spark, sf):
    return verify.validate_table(*_customer_pair(spark, sf), match="id", key="c_nationkey")


@query
def score_table_position(spark, sf):
    base, cand = (align.with_rank(df, "c_custkey") for df in _customer_pair(spark, sf))
    return verify.validate_table(base, cand, match="row_index", by="position")


@query
def score_text(spark, sf):
    base = _chat(spark, sf)
    return verify.validate_text(base, inputs.masked_chat(base), "user_id", "line")


@query
def score_text_whole(spark, sf):
    base = _chat(spark, sf)
    return verify.validate_text(base, inputs.masked_chat(base), None, "line")


@query
def score_json(spark, sf):
    return verify.validate_json(*_record_pair(spark, sf), "id")


@query
def score_json_leaves(spark, sf):
    return verify.validate_json(*_record_pair(spark, sf), "id", strategy="leaves")


@query
def score_documents(spark, sf):
    docs = _texts(spark, sf, "documents", "doc_id")
    masked = docs.withColumn("text", mask.mask_all(F.col("text")))
    return verify.validate_text(docs, masked, "source", "text", rules=CORE)


def _all_scores(spark, sf, isolate=True):
    chat = _chat(spark, sf)
    return verify.validate_many(
        spark,
        {
            "customers": ("easy", _customer_pair(spark, sf), {"key": "c_nationkey"}),
            "chat": ("medium", (chat, inputs.masked_chat(chat)), {"key": "user_id", "column": "line"}),
            "records": ("hard", _record_pair(spark, sf), {"key": "id"}),
            "broken": ("no_such_validator", (chat, chat), {}),
        },
        isolate,
    )


@query
def validate_many(spark, sf):
    return _all_scores(spark, sf)


@query
def score_violations(spark, sf):
    """A dataset that fails has no scores to count, so the failure is raised."""
    return verify.score_violations(_all_scores(spark, sf, isolate=False)).agg(F.count("*").alias("n_violations"))


@query
def source_status(spark, sf):
    docs = inputs.records(spark, sf)
    k = F.col("id")
    raw = writers.json_text(docs, "doc")
    content = (
        F.when(k % 7 == 0, F.expr("substr({0}, 1, 40)".format("raw")).cast("binary"))
        .when(k % 11 == 0, F.concat(F.unhex(F.lit("FF")), F.col("raw").cast("binary")))
        .otherwise(F.col("raw").cast("binary"))
    )
    found = docs.select("id", raw.alias("raw")).filter(k % inputs.LOST != 0).select("id", content.alias("content"))
    return readers.source_status(docs, found, "id", "content")


# ------------------------------------------------------------------- run logs


def _steps(spark, sf):
    return inputs.steps(table(spark, sf, "events"))


def _accepted(spark, sf):
    known = _steps(spark, sf).filter("error is null")
    return windows.until_done(known, "episode_id", ["ts", "event_id"])


@query
def task_lookup(spark, sf):
    return _steps(spark, sf).select("event_id", "task_id", "task_name", "max_steps", "error")


@query
def until_done(spark, sf):
    return _accepted(spark, sf).select("episode_id", "event_id", "step", "done")


@query
def last_reward(spark, sf):
    return windows.last_reward(_accepted(spark, sf), "episode_id").select("episode_id", "step", "last_reward")


def _episodes(spark, sf):
    return runs.episode_summary(_accepted(spark, sf))


@query
def episode_summary(spark, sf):
    shown = F.array_join(F.transform("rewards", lambda r: text.fixed(r, 4)), ",")
    return _episodes(spark, sf).withColumn("rewards", shown)


@query
def success_rate(spark, sf):
    rate = runs.success_rate(_episodes(spark, sf))
    return rate.withColumn("success_rate", text.round4(F.col("success_rate")))


def _trials(spark, sf):
    e = F.col("event_id")
    return _steps(spark, sf).select(
        "task_id",
        (e % 50 + 1).cast("double").alias("reset_ms"),
        (e % 400 + 20).cast("double").alias("step_ms"),
        "reward",
        "error",
    )


@query
def run_metrics(spark, sf):
    per_task = runs.avg_by_task(_trials(spark, sf))
    return per_task.select("task_id", *(text.round4(F.col(n)).alias(n) for n in ("reset_avg", "step_avg", "accuracy")))


@query
def run_metrics_overall(spark, sf):
    overall = runs.avg_of_avgs(runs.avg_by_task(_trials(spark, sf)))
    return overall.select(*(text.round4(F.col(n)).alias(n) for n in overall.columns))


@query
def last_and_first_n(spark, sf):
    last = windows.last_value(table(spark, sf, "events"), "user_id", "event_type", "event_id", "last_type")
    return last.withColumn("preview", text.first_n(F.col("last_type"), 3))


# ---------------------------------------------------------------- generators


def _customer_keys(spark, sf):
    return spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query
def gen_customers(spark, sf):
    return generate.gen_customers(_customer_keys(spark, sf), "c_custkey", SEED)


@query
def gen_chat(spark, sf):
    ids = table(spark, sf, "events").select("event_id", "user_id")
    return generate.gen_chat(ids, "event_id", "user_id", SEED).select("channel", "id", "line")


@query
def gen_records(spark, sf):
    made = generate.gen_records(_customer_keys(spark, sf), "c_custkey", SEED)
    r = lambda f: F.col(f"record.{f}")
    return made.select(
        "id",
        r("id").alias("record_id"),
        r("profile.first_name").alias("first_name"),
        r("profile.contact.email").alias("email"),
        r("profile.contact.phone").alias("phone"),
        r("profile.contact.address.street").alias("street"),
        r("profile.ssn").alias("ssn"),
        F.size(r("orders")).cast("long").alias("n_orders"),
        F.size(r("support_tickets")).cast("long").alias("n_tickets"),
        F.col("record.orders")[0]["payment"]["card_number"].alias("first_card"),
        F.size(F.col("record.orders")[0]["items"]).cast("long").alias("n_items"),
        F.array_join(F.col("record.support_tickets")["transcript"], "|").alias("transcripts"),
        r("loyalty_points").alias("loyalty_points"),
    )


@query
def gen_records_check(spark, sf):
    keys = dealt(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    made = generate.gen_records(keys, "c_custkey", SEED)
    masked = mask.mask_struct(made, "record")
    return verify.validate_json(made, masked, "id", "record")


# ------------------------------------------------------------ sources and sinks


def _listing(spark, sf):
    root = scratch_dir(spark, "manifest")
    # A source may hold a large share of the texts, so each is spread over all tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf, "documents").select("source", "text", F.pmod("doc_id", F.lit(tasks)).alias("part"))
    docs.repartition("source", "part").drop("part").write.partitionBy("source").text(root)
    files = readers.dataset_manifest(spark, root)
    return files.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "path", "length")


@query
def manifest(spark, sf):
    return _listing(spark, sf)


@query
def manifest_sizes(spark, sf):
    return _listing(spark, sf).groupBy("source").agg(F.sum("length").alias("n_bytes"))


@query
def csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "csv")
    base = mask.mask_columns(inputs.customers(spark, sf).select(*inputs.CUSTOMER_COLUMNS), mask.CARD_ONLY)
    noted = base.withColumn("notes", F.concat("notes", F.lit(' "x", y\nz')))
    writers.write_csv(noted, path)
    return readers.read_table_csv(spark, path, list(inputs.CUSTOMER_COLUMNS)).drop(readers.CORRUPT)


@query
def lines_roundtrip(spark, sf):
    path = scratch_dir(spark, "lines")
    writers.write_lines(inputs.masked_chat(_chat(spark, sf)), "line", path)
    return readers.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query
def lines_numbered(spark, sf):
    path = scratch_dir(spark, "numbered")
    # Written in order, so that the place in file order is the rank by event_id.
    ordered = _chat(spark, sf).select("event_id", "line").orderBy("event_id")
    writers.write_lines(ordered, "line", path)
    return readers.read_lines(spark, path, numbered=True).select("row_index", "line")


@query
def json_roundtrip(spark, sf):
    path = scratch_dir(spark, "json")
    docs = inputs.records(spark, sf)
    masked = mask.mask_struct(docs, "doc", only="customers")
    writers.write_json_docs(masked, "doc", path)
    back = readers.read_json_lines(spark, path, docs.schema["doc"].dataType)
    keyed = back.select(F.col("doc.customers")[0]["id"].alias("customer"), "doc")
    return nested.json_leaves(keyed, "customer", "doc").select("customer", "path", "value")


def _as_lists(batches):
    """Documents of a partition as the lines of one JSON list; a null ends it, whatever stands before."""
    yield pd.DataFrame({"value": ["["]})
    for rows in batches:
        yield rows.assign(value=rows["value"] + ",")
    yield pd.DataFrame({"value": ["null]"]})


@query
def json_file_leaves(spark, sf):
    """The strings of documents that are elements of whole JSON files, which are read in byte ranges."""
    path = scratch_dir(spark, "json-files")
    docs = inputs.records(spark, sf)
    docs.select(writers.json_text(docs, "doc").alias("value")).mapInPandas(_as_lists, "value string").write.text(path)
    members, files = json_ranges.json_members(spark, path, 1)
    good = members.join(files.filter("not malformed"), "path").filter(F.trim("value") != "null")
    keyed = good.select(F.get_json_object("value", "$.customers[0].id").alias("customer"), "value")
    return nested.json_leaves(keyed, "customer", "value").select("customer", "path", "value")


@query
def score_files(spark, sf):
    """Folders of files against their baseline: a table and a text with line ends in cells, and one that is not there."""
    base, work = scratch_dir(spark, "baseline"), scratch_dir(spark, "workspace")
    columns = list(inputs.CUSTOMER_COLUMNS)
    chat = _chat(spark, sf)
    pairs = ((base, inputs.customers(spark, sf), chat), (work, inputs.masked_customers(inputs.customers(spark, sf)), inputs.masked_chat(chat)))
    for folder, rows, lines in pairs:
        placed = rows.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
        writers.write_csv(placed.withColumn("notes", F.concat("notes", F.lit('\n"seen", once'))).select(columns), f"{folder}/customers.csv")
        writers.write_lines(lines, "line", f"{folder}/chat_logs.txt")
    found = [verify.validate_files(spark, task, work, base) for task in ("easy", "medium", "hard")]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query
def sparse_positions(spark, sf):
    """Place and running sum by hashed ids, over all rows and within a group."""
    events = table(spark, sf, "events").select("event_id", "event_type", F.md5(F.col("event_id").cast("string")).alias("hashed"), (F.col("event_id") % 100).alias("points"))
    placed = ordered.numbered(events, ["hashed"], name="place")
    summed = ordered.running_sum(placed, ["hashed"], "points", name="total")
    return ordered.running_sum(summed, ["hashed"], "points", ["event_type"], "type_total").drop("hashed", "points")


@query
def runlog_roundtrip(spark, sf):
    path = scratch_dir(spark, "runlog")
    accepted = _accepted(spark, sf)
    lines = writers.run_log_lines(accepted, runs.episode_summary(accepted), "episode_id", "spark", "regex")
    writers.write_run_log(lines, "episode_id", path)
    raw = spark.read.text(path).select(
        F.substring_index("value", "\t", 1).cast("long").alias("episode_id"),
        F.regexp_replace("value", r"^\d+\t", "").alias("value"),
    )
    parsed = readers.parse_run_log(raw)
    return parsed.select(
        "episode_id", "kind", "task", "step", "action", "reward", "done", "success", "score",
        F.array_join(F.transform("rewards", lambda r: text.fixed(r, 2)), ",").alias("rewards"),
    )


# ------------------------------------------------------------------ streaming


@query
def mask_stream(spark, sf):
    docs = streams.stream_table(spark, sf, "documents.parquet").select("doc_id", "text")
    masked = streams.mask_stream(docs, "text").withColumnRenamed("text", "masked")
    return streams.drain(masked, "mask-stream")


@query
def leak_counts_stream(spark, sf):
    events = streams.stream_table(spark, sf, "events.parquet")
    feed = inputs.masked_chat(inputs.chat(events))
    counts = streams.leak_counts_stream(feed, "line", "ts", by=("event_type",))
    shown = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return streams.drain_complete(counts, "leaks").withColumn("window_start", shown)


@query
def leak_counts_closed(spark, sf):
    """The same in append mode, over rows that arrive out of order: each window once, when it is closed."""
    feed = streams.arrivals(inputs.masked_chat(inputs.chat(table(spark, sf, "events"))), "ts", "leak-arrivals")
    counts = streams.leak_counts_stream(feed, "line", "ts", watermark="17 days", by=("event_type",))
    shown = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return streams.drain(counts, "leaks-closed").withColumn("window_start", shown)


@query
def episode_stream(spark, sf):
    """Steps that arrive out of order over several micro-batches."""
    log = inputs.steps(table(spark, sf, "events")).filter("error is null")
    feed = streams.arrivals(log.select("episode_id", "event_id", "ts", "max_steps", "reward"), "ts", "step-arrivals")
    accepted = streams.episode_stream(feed.withColumn("at", F.col("ts").cast("timestamp")), "17 days", timedelta(days=366))
    return streams.drain(accepted, "episodes").select("episode_id", "event_id", "step", "done", "last_reward")
