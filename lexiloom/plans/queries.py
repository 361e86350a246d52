"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.chunks import register_chunks
from lexiloom.functions.inference import constant_factory, grade_batch
from lexiloom.functions.text import iso_text
from lexiloom.operators import bounded_cache as cache_of_size
from lexiloom.operators import accounts, jobs, ledger, memory, ocr, open_json, retrieval, segments, textwork
from lexiloom.operators.cache import ttl_cache_replay
from lexiloom.operators.credits import replay_credits
from lexiloom.plans import files
from lexiloom.plans.image_job import corrected_lines
from lexiloom.plans.ledger_report import revenue_report, transactions_report
from lexiloom.plans.streams import StreamTables, run_past_the_end, run_status_to_end, run_to_end, run_updates_to_end
from lexiloom.plans.tables import Tables
from lexiloom.plans.translation import translate_batch
from lexiloom.sources.corpus import read_text_corpus
from lexiloom.sources.manifests import is_reject, is_row, judge_manifest, parse_manifest, pick_rows
from lexiloom.sources.media import media_verdict
from lexiloom.sources.shared import new_folder
from lexiloom.sources.sinks import ocr_documents, read_chunk_store, write_chunk_store
from lexiloom.sources.status import read_job_status
from lexiloom.sources.word_format import register_word_runs
from lexiloom.streaming import state
from lexiloom.streaming.inbox import follow_texts, translate_once
from lexiloom.streaming.jobs import stream_job_status, stream_throughput

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bound(fn) for name, fn in QUERIES.items()}


# --- ledger --------------------------------------------------------------------
@query
def ledger_page(t: Tables) -> DataFrame:
    return transactions_report(t.transactions(), t.users(), skip=20, limit=100, start=START, end=END, transaction_type="usage")


@query
def ledger_page_ascending(t: Tables) -> DataFrame:
    return transactions_report(
        t.transactions(), t.users(), limit=50, direction="asc", username="customer#00000000_", totals_scope="filtered"
    )


@query
def revenue_page(t: Tables) -> DataFrame:
    return revenue_report(t.transactions(), t.users(), skip=10, limit=200)


@query
def ledger_totals(t: Tables) -> DataFrame:
    return ledger.ledger_totals(t.transactions(), ledger.transaction_condition(None, START, END, "purchase"))


@query
def ledger_totals_filtered(t: Tables) -> DataFrame:
    return ledger.ledger_totals(t.transactions(), ledger.transaction_condition(None, START, END, "all"), "filtered")


@query
def ledger_by_username(t: Tables) -> DataFrame:
    return ledger.ledger_output(ledger.transactions_of_username(t.transactions(), t.users(), "CUSTOMER#%1_"))


@query
def ledger_enriched(t: Tables) -> DataFrame:
    named = ledger.enrich_username(t.transactions(), t.users())
    shown = ledger.name_or_id(named.withColumn("known_name", F.col("username")))
    return ledger.ledger_output(shown)


@query
def user_pages(t: Tables) -> DataFrame:
    return ledger.ledger_output(ledger.page_per_user(t.transactions(), skip=5, limit=10))


@query
def transactions_filtered(t: Tables) -> DataFrame:
    return ledger.ledger_output(ledger.filter_transactions(t.transactions(), None, START, END, "PURCHASE"))


@query
def transaction_types(t: Tables) -> DataFrame:
    kind = ledger.normalize_transaction_type(F.upper("event_type"))
    return t.given("events").groupBy("event_type", kind.alias("transaction_type")).agg(F.count(F.lit(1)).alias("rows"))


@query
def history_filtered(t: Tables) -> DataFrame:
    rows = ledger.filter_history(t.history(), None, "2024-01-01 01:00:00", None, "fr", "vi")
    return ledger.ledger_output(rows, ()).select("id", "user_id", "source_language", "target_language", "created_at", "output_text")


@query
def history_page(t: Tables) -> DataFrame:
    rows = ledger.bill_usage(ledger.filter_history(t.history(), source="en"))
    shown = ledger.ledger_output(ledger.page(rows, 3, 40, "asc"), ("credits_used",))
    return shown.select("id", "user_id", "target_language", "created_at", "character_count", "credits_used")


@query
def history_billed(t: Tables) -> DataFrame:
    billed = ledger.bill_usage(t.history())
    return billed.select(
        "id", "character_count", F.col("credits_used").cast("double").alias("credits_used"), iso_text(F.col("local_time")).alias("local_time")
    )


@query
def users_public(t: Tables) -> DataFrame:
    return ledger.ledger_output(ledger.public_users(t.users()))


@query
def payment_outcomes(t: Tables) -> DataFrame:
    judged = ledger.payment_outcome(t.payments())
    return judged.groupBy("outcome", "success").agg(F.count(F.lit(1)).alias("payments"))


@query
def orphans(t: Tables) -> DataFrame:
    return ledger.ledger_output(accounts.orphans(t.transactions(), t.users()))


@query
def delete_effects(t: Tables) -> DataFrame:
    return accounts.delete_effects(t.users(), t.transactions(), t.history())


@query
def changes_applied(t: Tables) -> DataFrame:
    return accounts.apply_history_deletes(t.history(), t.history_changes()).select("id", "user_id", "source_language")


@query
def change_outcomes(t: Tables) -> DataFrame:
    judged = accounts.history_delete_verdicts(t.history_changes(), t.history())
    return accounts.change_outcomes(judged.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"])


@query
def history_cleared(t: Tables) -> DataFrame:
    indebted = t.given("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return accounts.clear_history(t.history(), indebted).select("id", "user_id")


@query
def profiles_updated(t: Tables) -> DataFrame:
    changed = accounts.apply_changes(t.users(), t.profile_changes(), "user_id", "seq", ["username", "email"])
    return changed.select("user_id", "username", "email")


@query
def user_change_verdicts(t: Tables) -> DataFrame:
    return accounts.validate_user_changes(t.user_changes(), t.users())


@query
def user_change_outcomes(t: Tables) -> DataFrame:
    return accounts.change_outcomes(accounts.validate_user_changes(t.user_changes(), t.users()), ["action"])


@query
def config_patched(t: Tables) -> DataFrame:
    return accounts.patch_config(t.config(), t.config_patch()).withColumn("price", F.col("price").cast("double"))


@query
def signup_duplicates(t: Tables) -> DataFrame:
    return accounts.register_defaults(t.signups(), t.users())


@query
def signups_in_turn(t: Tables) -> DataFrame:
    """The serial rule: refused sign-ups take neither name nor e-mail."""
    return accounts.register_in_turn(t.signups(), t.users())


# --- OCR -----------------------------------------------------------------------
@query
def boxes_merged(t: Tables) -> DataFrame:
    return ocr.merge_nearby_boxes(t.boxes())


@query
def boxes_merged_twice(t: Tables) -> DataFrame:
    return ocr.merge_nearby_boxes(t.boxes(), horizontal=60, vertical=6, passes=2)


@query
def regions_numbered(t: Tables) -> DataFrame:
    return ocr.number_regions(t.boxes(), t.images())


@query
def detections_unified(t: Tables) -> DataFrame:
    return ocr.union_detections(t.boxes().filter("x_max % 2 = 0"), t.free_boxes(), t.images())


@query
def grid_cells(t: Tables) -> DataFrame:
    return ocr.fallback_grid(t.images())


def _placement(t: Tables) -> DataFrame:
    regions = ocr.region_numbers(t.boxes()).select("image_id", "region", *ocr.region_rect())
    first = regions.select("image_id", "region", F.col("region").alias("pos"), "x", "y", "w", "h")
    again = first.filter("region % 4 = 0").withColumn("pos", F.col("pos") + 1000).withColumn("x", F.col("x") + 3)
    translated = regions.select(
        "image_id", "region", (F.col("region") % 5 != 0).alias("has_text"),
        (F.col("w") + F.col("region") % 2).alias("out_w"), F.col("h").alias("out_h"),
    )
    return ocr.placement_plan(translated, first.unionByName(again), t.images())


@query
def placement(t: Tables) -> DataFrame:
    return ocr.inside_and_rejected(_placement(t))[0]


@query
def placement_rejected(t: Tables) -> DataFrame:
    return ocr.inside_and_rejected(_placement(t))[1]


@query
def placement_grid(t: Tables) -> DataFrame:
    named = t.boxes().select(
        "image_id",
        "idx",
        F.concat(F.lit("out/crop_"), ((F.col("x_max") + F.col("y_max") + 100) % 11).cast("string"), F.lit(".jpg")).alias("crop_path"),
        (F.col("x_max") % 5 != 0).alias("has_text"),
    )
    return ocr.placement_plan_grid(named, t.images())


def _lines(t: Tables) -> DataFrame:
    numbered = ocr.region_numbers(t.boxes())
    return numbered.select("image_id", (F.col("region") - 1).alias("pos"), "text", "confidence", *ocr.region_rect())


def _corrected(t: Tables) -> DataFrame:
    """Upper-case lines; every sixth image lost its first line."""
    lost = (F.col("image_id") % 6 == 0) & (F.col("pos") == 0)
    return _lines(t).filter(~lost).select("image_id", "pos", F.upper("text").alias("text"))


@query
def corrections_aligned(t: Tables) -> DataFrame:
    return ocr.align_corrections(_lines(t).select("image_id", "pos", "text"), _corrected(t))


def _hasty(prompt: str) -> str:
    """A corrector that loses the last of an even number of lines when it also gets the full text, and of 4, 8, ... lines anyhow."""
    numbered, _, full = prompt.partition("\n\n")
    lines = numbered.upper().split("\n")
    return "\n".join(lines[:-1] if len(lines) % (2 if full else 4) == 0 else lines)


@query
def corrections_retried(t: Tables) -> DataFrame:
    lines = _lines(t)
    full = t.boxes().groupBy("image_id").agg(F.max("text").alias("full_text"))
    return corrected_lines(lines, full, constant_factory(_hasty)).select("image_id", "pos", "text", "text_corrected")


@query
def correction_requests(t: Tables) -> DataFrame:
    full = t.boxes().groupBy("image_id").agg(F.max("text").alias("full_text"))
    return ocr.correction_requests(_lines(t), full)


@query
def numbered_lines(t: Tables) -> DataFrame:
    number, text = (F.col("doc_id") % 13).cast("string"), F.col("text")
    replies = t.given("documents").select("doc_id", F.concat(number, F.lit(". "), F.replace(text, F.lit("\n"), F.lit("\n 2.  "))).alias("reply"))
    return ocr.explode_numbered_lines(replies)


@query
def language_mapped(t: Tables) -> DataFrame:
    asked = (
        t.given("documents").select("lang")
        .unionByName(t.given("nation").select(F.col("n_name").alias("lang")))
        .unionByName(t.given("documents").select(F.when(F.col("lang") == "fr", "French").when(F.col("lang") == "de", "zh").otherwise("rs_cyrillic").alias("lang")))
    )
    mapped = ocr.map_language(asked)
    keys = ["lang", "ocr_code", "name_ocr_code", "display_name", "target_name"]
    return mapped.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


@query
def manifest_rows(t: Tables) -> DataFrame:
    rows, _ = parse_manifest(t.manifest_lines(), "text_areas")
    point = lambda i, c: F.get("box", F.lit(i))[c]
    return rows.select(
        "image_id", "index", point(0, "x").alias("x1"), point(0, "y").alias("y1"),
        point(1, "x").alias("x2"), point(1, "y").alias("y2"), "text", "confidence",
    )


@query
def manifest_rejects(t: Tables) -> DataFrame:
    return parse_manifest(t.manifest_lines(), "text_areas")[1]


def _layout_lines(t: Tables, fields: str, header: str) -> DataFrame:
    """A manifest's lines: quantity 1 has a bad index, 2 lacks its last field, 3 is a header line, 4 has a field more."""
    key, quantity = F.col("l_partkey").cast("string"), F.col("l_quantity")
    made = {
        "index": F.when(quantity == 1, "n/a").otherwise(F.col("l_linenumber").cast("string")),
        "path": F.concat(F.lit("p/"), key, F.lit(".jpg")),
        "other": F.concat(F.lit("o/"), key, F.lit(".png")),
        "box": F.concat_ws(", ", key, F.lit("2"), F.lit("30"), F.lit("40")),
        "rect": F.concat_ws(",", key, F.lit("2"), F.lit("3"), F.lit("4")),
        "text": F.concat(F.lit(" w"), key),
        "said": F.concat(F.lit("s"), key),
        "sure": (100 - F.col("l_linenumber")).cast("string"),
    }
    columns = [made[f] for f in fields.split()]
    line = (
        F.when(quantity == 2, F.concat_ws("|", *columns[:-1]))
        .when(quantity == 3, header)
        .when(quantity == 4, F.concat_ws("|", *columns, F.lit(" False ")))
        .otherwise(F.concat_ws("|", *columns))
    )
    return t.texts("lineitem").select(F.col("l_orderkey").alias("image_id"), line.alias("value"))


#: Layout: what its fields are made of, a header line, whether the header is followed, columns that are shown.
MANIFESTS = {
    "cropped": ("index path box rect text sure", "x", False, "path text"),
    "processed": ("index path other box rect text sure", "x", False, "crop_path processed_path text"),
    "extracted": ("index path text said", "INDEX|PATH|ORIGINAL_TEXT|EXTRACTED_TEXT", False, "path original_text extracted_text"),
    "translated_texts": ("index other path said text", "index|processed_path|path|translated_text|extracted_text", True, "path extracted_text translated_text"),
    "translated": ("index path other text said", "INDEX|CROP_PATH|OUTPUT_PATH|EXTRACTED_TEXT|TRANSLATED_TEXT", False, "crop_path output_path extracted_text translated_text has_text"),
}


@query
def manifest_layouts(t: Tables) -> DataFrame:
    """The other five layouts, one of them read by its header: rows and rejects as one table."""
    shown = []
    for layout, (fields, header, by_header, columns) in MANIFESTS.items():
        judged = judge_manifest(_layout_lines(t, fields, header), layout, header if by_header else None)
        boxes = [F.get("box", F.lit(0))["x"].cast("int"), F.col("rect")["w"], F.col("confidence").cast("int")] if "rect" in judged.columns else []
        row = F.concat_ws("~", *(F.col(c).cast("string") for c in columns.split()), *(b.cast("string") for b in boxes))
        table = lambda index, row, layout=layout: [F.lit(layout).alias("layout"), "image_id", index.alias("index"), row.alias("row")]
        good = table(F.col("index").cast("string"), row)
        shown.append(pick_rows(judged, (is_row(), good), (is_reject(), table(F.col("reason"), F.col("line")))))
    return reduce(DataFrame.union, shown)


@query
def ocr_results(t: Tables) -> DataFrame:
    """The nested documents with their list of lines as JSON text."""
    aligned = ocr.align_corrections(_lines(t), _corrected(t))
    shaped = aligned.select(
        "image_id", "pos", F.col("x").alias("x_min"), F.col("y").alias("y_min"), (F.col("x") + F.col("w")).alias("x_max"),
        (F.col("y") + F.col("h")).alias("y_max"), "text", "text_corrected", "confidence",
    )
    info = t.boxes().groupBy("image_id").agg(F.max("text").alias("full_text")).withColumn("language", F.lit("en"))
    return ocr_documents(shaped, info).withColumn("results", F.to_json("results"))


@query
def media_in_order(t: Tables) -> DataFrame:
    """The natural order, as each file's place in it among the files of its number."""
    by_number = Window.partitionBy("number").orderBy("path")
    return ocr.natural_order(t.media()).select("path", "number", F.row_number().over(by_number).alias("place"))


@query
def media_listed(t: Tables) -> DataFrame:
    files = t.media()
    images = media_verdict(files, "image").select("path", "number", F.col("verdict").alias("image_verdict"))
    return images.join(media_verdict(files, "audio").select("path", F.col("verdict").alias("audio_verdict")), "path")


# --- documents -----------------------------------------------------------------
@query
def segments_classified(t: Tables) -> DataFrame:
    return segments.classify_segments(t.segments())


@query
def words_classified(t: Tables) -> DataFrame:
    return segments.class_summary(segments.classify_segments(t.runs()))


@query
def segments_assembled(t: Tables) -> DataFrame:
    return segments.assemble_segments(t.runs(dealt=True), keep_runs=False)


@query
def segments_redistributed(t: Tables) -> DataFrame:
    return segments.redistribute_segments(t.with_targets(segments.assemble_segments(t.runs(dealt=True))))


def _judged(t: Tables) -> DataFrame:
    return t.with_targets(segments.assemble_segments(t.runs(dealt=True), keep_runs=False)).withColumn("ok", F.col("target").isNotNull())


@query
def segments_fallback(t: Tables) -> DataFrame:
    return segments.fallback_text_elements(t.runs(), _judged(t)).select("doc", "part", "para_idx", "run_idx", "text")


@query
def translated_rollup(t: Tables) -> DataFrame:
    return segments.translated_counts(_judged(t))


@query
def doc_structure(t: Tables) -> DataFrame:
    return segments.document_structure(t.runs())


@query
def paragraph_preview(t: Tables) -> DataFrame:
    return segments.paragraph_preview(segments.paragraph_texts(t.runs(dealt=True)), 10, 2)


# --- text ----------------------------------------------------------------------
@query
def links_masked(t: Tables) -> DataFrame:
    masked = textwork.mask_links(t.page_texts())
    return masked.select("page_id", "masked", F.size("spans").alias("spans"))


@query
def link_spans(t: Tables) -> DataFrame:
    return textwork.span_table(textwork.mask_links(t.page_texts()), ["page_id"])


@query
def links_restored(t: Tables) -> DataFrame:
    return textwork.unmask(textwork.mask_links(t.page_texts())).select("page_id", "restored")


@query
def formats_masked(t: Tables) -> DataFrame:
    masked = textwork.mask_formats(t.page_texts())
    return masked.select("page_id", "masked", F.size("spans").alias("spans"))


@query
def spacing_repaired(t: Tables) -> DataFrame:
    both = textwork.repair_spacing(t.segments(), "text", "repaired")
    return textwork.repair_spacing(both, "text", "repaired_prefixes", prefixes=True).select(
        "doc_id", "para_idx", "repaired", "repaired_prefixes"
    )


@query
def responses_guarded(t: Tables) -> DataFrame:
    result = t.model_outputs()
    for kind in ("document", "api", "cleanup", "ocr"):
        result = textwork.guard_responses(result, kind).withColumnsRenamed(
            {"guarded": f"{kind}_text", "guard_outcome": f"{kind}_outcome"}
        )
    return result.drop("source", "output")


@query
def guard_counts(t: Tables) -> DataFrame:
    return textwork.guard_summary(textwork.guard_responses(t.model_outputs(), "document"))


@query
def requests_parsed(t: Tables) -> DataFrame:
    return textwork.parse_requests(t.requests()).drop("question").withColumn("workers", F.col("workers").cast("double"))


@query
def fragments(t: Tables) -> DataFrame:
    return textwork.language_fragments(t.replies())


@query
def fragment_shares(t: Tables) -> DataFrame:
    return textwork.language_shares(textwork.language_fragments(t.replies()))


# --- memory and inference --------------------------------------------------------
def _keyed(t: Tables) -> DataFrame:
    return memory.with_key(t.segments(), "vi", "General")


@query
def tm_hits(t: Tables) -> DataFrame:
    return memory.tm_lookup(_keyed(t), t.memory()).select("doc_id", "para_idx", "key", "target", "hit")


@query
def tm_misses(t: Tables) -> DataFrame:
    return memory.tm_misses(_keyed(t), t.memory()).select("key", "source")


@query
def tm_stats(t: Tables) -> DataFrame:
    return memory.tm_stats(_keyed(t).withColumn("job", F.col("lang")), memory=t.memory())


@query
def bounded_cache(t: Tables) -> DataFrame:
    """Each language is a job of its own, with a cache of 500 texts."""
    replayed = cache_of_size.bounded_cache_replay(_keyed(t).withColumn("job", F.col("lang")), max_size=500)
    return cache_of_size.bounded_cache_stats(replayed)


@query
def tm_retained(t: Tables) -> DataFrame:
    kept = memory.tm_retain(t.memory(), 2000)
    return kept.select("key", "source", iso_text(F.col("last_used")).alias("last_used"))


@query
def tm_merged(t: Tables) -> DataFrame:
    """The memory's next version after the German lines and newer French ones came in."""
    later = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    fresh = (
        memory.with_key(t.segments().filter("lang IN ('de', 'fr') AND text LIKE '%a%'"), "vi", "General")
        .filter(F.col("key").isNotNull())
        .select(*memory.IDENTITY, F.col("text").alias("source"), F.concat(F.lit("v2:"), "text").alias("target"), later.alias("last_used"))
    )
    merged = memory.tm_merge(t.memory(), fresh)
    return merged.select("key", "source", "target", iso_text(F.col("last_used")).alias("last_used"))


@query
def translated_default_fn(t: Tables) -> DataFrame:
    """Every line through the hook with a pure function, known lines from the memory."""
    mark = constant_factory(lambda text: "vi:" + text)
    done = translate_batch(t.segments(), mark, "vi", memory=t.memory(), protect=None)
    return done.select("doc_id", "para_idx", "target", "outcome")


@query
def translated_protected(t: Tables) -> DataFrame:
    """The same with protected formats and repaired spacing."""
    mark = constant_factory(lambda text: "vi:" + text)
    done = translate_batch(t.segments(), mark, "vi", memory=t.memory())
    return done.select("doc_id", "para_idx", "target", "outcome")


# --- ordered state -----------------------------------------------------------------
@query
def ttl_replay(t: Tables) -> DataFrame:
    replayed = ttl_cache_replay(t.cache_requests(), storable="storable")
    return replayed.select("id", F.col("key").cast("string").alias("key"), "storable", "hit")


@query
def credit_replay(t: Tables) -> DataFrame:
    return _amounts(replay_credits(t.credit_events(), t.users()))


def _amounts(replayed: DataFrame) -> DataFrame:
    return replayed.drop("ts").withColumns({c: F.col(c).cast("double") for c in ("amount", "balance")})


@query
def status_folded(t: Tables) -> DataFrame:
    folded = jobs.fold_job_status(t.status_events())
    return folded.withColumn("updated_at", iso_text(F.col("updated_at")))


@query
def job_progress(t: Tables) -> DataFrame:
    shown = jobs.job_progress(t.status_events())
    return shown.select(
        "job_id", "seq", "percent", F.round("elapsed", 3).alias("elapsed"), F.round("eta", 3).alias("eta"),
        F.round("speed", 6).alias("speed"), "elapsed_text", "eta_text",
    )


@query
def job_throughput(t: Tables) -> DataFrame:
    per_minute = jobs.throughput(t.status_events())
    return per_minute.withColumn("window_start", iso_text(F.col("window_start")))


# --- retrieval -----------------------------------------------------------------------
@query
def chunk_windows(t: Tables) -> DataFrame:
    return retrieval.chunk_windows(t.texts("documents"), "doc_id")


@query
def chunk_corpus(t: Tables) -> DataFrame:
    return retrieval.chunk_corpus(t.texts("documents"), "doc_id")


@query
def chunks_in_sql(t: Tables) -> DataFrame:
    register_chunks(t.spark)
    t.texts("documents").createOrReplaceTempView("lexiloom_documents")
    return t.spark.sql(
        "SELECT d.doc_id, c.chunk_idx, c.chunk_size, c.chunk AS text "
        "FROM lexiloom_documents d, LATERAL chunks(d.text, 2000, 400) c"
    )


def _found(t: Tables) -> DataFrame:
    return retrieval.retrieve_topk(t.corpus(), t.label_queries(), 20)


@query
def retrieve_topk(t: Tables) -> DataFrame:
    return _found(t).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query
def neighbours_of_all(t: Tables) -> DataFrame:
    """Every vector asks for its nearest ones: more queries than a task holds lists for."""
    asking = t.corpus().select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.retrieve_topk(t.corpus(), asking, 4, block=100, held_queries=200)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query
def chunks_united(t: Tables) -> DataFrame:
    """Windows of documents and of page texts as one table."""
    pages = t.page_texts().withColumn("doc_id", -1 - F.col("page_id"))
    return retrieval.union_chunks([retrieval.chunk_windows(x, "doc_id") for x in (t.texts("documents"), pages)])


def _graded(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A neighbour is relevant when it has the query's label."""
    labelled = t.corpus().select("vec_id", F.col("label").cast("string").alias("document"))
    pairs = _found(t).join(labelled, "vec_id").withColumn("question", F.col("query_id").cast("string"))
    grader = constant_factory(lambda question, document: "yes" if question == document else "no")
    return retrieval.split_by_grade(grade_batch(pairs, grader), t.label_queries().select("query_id"))


@query
def graded_split(t: Tables) -> DataFrame:
    return _graded(t)[0].select("query_id", "vec_id", "rank", "grade")


@query
def unanswered(t: Tables) -> DataFrame:
    return _graded(t)[1]


# --- streams: the given tables followed as files ---------------------------------------
def _streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


@query
def stream_ttl_replay(t: Tables) -> DataFrame:
    replayed = run_past_the_end(_streams(t).cache_requests(), lambda rows: state.stream_cache_replay(rows, storable="storable"))
    return replayed.select("id", F.col("key").cast("string").alias("key"), "storable", "hit")


@query
def stream_credit_replay(t: Tables) -> DataFrame:
    return _amounts(run_past_the_end(_streams(t).credit_events(), lambda rows: state.stream_credit_replay(rows, t.users())))


@query
def stream_job_progress(t: Tables) -> DataFrame:
    shown = run_past_the_end(_streams(t).status_events(), state.stream_job_progress)
    return shown.select(
        "job_id", "seq", "percent", F.round("elapsed", 3).alias("elapsed"), F.round("eta", 3).alias("eta"),
        F.round("speed", 6).alias("speed"), "elapsed_text", "eta_text",
    )


@query
def stream_status_folded(t: Tables) -> DataFrame:
    current = run_status_to_end(stream_job_status(_streams(t).status_events()))
    return current.withColumn("updated_at", iso_text(F.col("updated_at")))


@query
def stream_throughput_rows(t: Tables) -> DataFrame:
    """Windows that are still open at the end come out in update mode; the newest row of each counts."""
    events = _streams(t).status_events().withColumn("ts", F.col("ts").cast("timestamp"))
    windows = run_updates_to_end(stream_throughput(events), ["job_id", "window_start"])
    return windows.withColumn("window_start", iso_text(F.col("window_start").cast("timestamp_ntz")))


@query
def stream_translate_once(t: Tables) -> DataFrame:
    return run_to_end(translate_once(_streams(t).segments(), "vi")).select("key", "text")


# --- files: written from the given tables, then read ------------------------------------
def _word_rows(runs: DataFrame) -> DataFrame:
    doc = F.regexp_extract(F.substring_index("doc", "/", -1), r"doc-(-?\d+)\.docx$", 1).alias("doc")
    return runs.select(doc, "part", "part_kind", "para_idx", "run_idx", "text_idx", "text", "error")


@query
def word_runs_read(t: Tables) -> DataFrame:
    register_word_runs(t.spark)
    return _word_rows(t.spark.read.format("word_runs").option("partitionBytes", 1 << 20).load(files.word_files(t.runs(dealt=True, whole=True))))


@query
def word_runs_followed(t: Tables) -> DataFrame:
    """The same files as a stream."""
    register_word_runs(t.spark)
    stream = t.spark.readStream.format("word_runs").option("settleSeconds", 0).load(files.word_files(t.runs(dealt=True, whole=True)))
    return _word_rows(run_to_end(stream))


def _doc_of_path():
    return F.regexp_extract("path", r"doc_id=(-?\d+)\.txt$", 1).cast("long").alias("doc_id")


@query
def texts_read(t: Tables) -> DataFrame:
    return read_text_corpus(t.spark, files.text_files_of(t.texts("documents"))).select(_doc_of_path(), "text")


@query
def texts_followed(t: Tables) -> DataFrame:
    """New text files as a stream of lines."""
    lines = follow_texts(t.spark, files.text_files_of(t.texts("documents")), files_per_trigger=1_000_000)
    return run_to_end(lines).select(_doc_of_path(), "para_idx", "text")


@query
def status_files_read(t: Tables) -> DataFrame:
    folder = files.status_files(jobs.fold_job_status(t.status_events()))
    return read_job_status(t.spark, folder).select("id", "status", "progress", "started_at", "message", "error", "_bad")


@query
def chunk_store_read(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "chunks")
    write_chunk_store(retrieval.chunk_windows(t.texts("documents"), "doc_id"), folder, key="doc_id")
    return read_chunk_store(t.spark, folder).select("doc_id", "chunk_idx", "start", "text")


@query
def open_fields_folded(t: Tables) -> DataFrame:
    """The newest value of every field that a conversation's messages ever had."""
    return open_json.fold_open_fields(t.open_messages(), "body")


@query
def open_fields_profiled(t: Tables) -> DataFrame:
    return open_json.profile_open_fields(t.open_messages(), "body").drop("schema")


@query
def open_messages_rejected(t: Tables) -> DataFrame:
    return open_json.open_rejects(t.open_messages(), "body")
