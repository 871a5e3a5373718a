"""Import jobs on raw submissions, and jobs on texts and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import binding, binding_raw, config, schemas
from listwright.functions import text as t
from listwright.functions import urls
from listwright.operators import dedupe, maintain, resolve, standardize, validate
from listwright.operators.skew import ranked
from listwright.plans import imports, rescore
from listwright.session import scratch_path, stage
from listwright.sources import export, landing, tables

def _now():
    return F.to_timestamp(F.lit(binding_raw.NOW))


def _raw(spark, sf, cells):
    return binding_raw.raw(spark, sf, cells)


def _listings(spark, sf):
    """Standardized listings, written: a filter on what was read would be pushed to the raw cells and read them again."""
    return stage(standardize.listings(_raw(spark, sf, binding_raw.LISTING), _now()), "standardized")


def _research(spark, sf):
    return stage(standardize.research(_raw(spark, sf, binding_raw.RESEARCH)), "standardized")


def _listing_out(df: DataFrame) -> DataFrame:
    pains = F.transform("pain_points", lambda p: F.concat_ws(":", p["type"], p["theme"], p["mention_count"].cast("string")))
    return df.select(
        "record_no", "name", "normalized_name", "url", "marketplace", "external_id", "brand", "category", F.array_join("features", "|").alias("features"),
        "weight_kg", F.col("dimensions.length_cm").alias("length_cm"), F.col("dimensions.height_cm").alias("height_cm"), "selling_price", "mrp",
        "discount_percentage", "currency", "review_count", "average_rating", "competitor_count", F.col("costs.product_cost").alias("product_cost"),
        F.col("costs.cost_source_name").alias("cost_source_name"), "fragile", "return_risk", F.array_join(pains, "|").alias("pain_points"),
        "source_name", "source_url", t.iso(F.col("collected_at")).alias("collected_at"), "confidence_score", "dataset_status",
    )


def standardize_listings(spark: SparkSession, sf: str) -> DataFrame:
    return _listing_out(standardize.usable_rows(_listings(spark, sf)))


def standardize_research(spark: SparkSession, sf: str) -> DataFrame:
    return _listing_out(standardize.usable_rows(_research(spark, sf)))


def malformed_rows(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_listings(spark, sf), _research(spark, sf)]
    both = standardize.malformed_rows(parts[0], "listing").unionByName(standardize.malformed_rows(parts[1], "research"))
    return both.withColumn("errors", F.array_join("errors", "; "))


def pain_point_shred(spark: SparkSession, sf: str) -> DataFrame:
    df = standardize.usable_rows(_listings(spark, sf))
    return df.select("record_no", F.posexplode("pain_points").alias("position", "p")).select(
        "record_no", F.col("position").cast("long"), "p.type", "p.theme", "p.mention_count"
    )


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The raw listings written as CSV files, landed again and standardized."""
    path = scratch_path(spark, "submission")
    cells = _raw(spark, sf, binding_raw.LISTING).withColumn("best_seller_rank", F.col("record_no")).withColumnRenamed("name", " Name ").drop("record_no")
    # several files in the order of their names: the record number is the position in the whole submission
    cells.repartitionByRange(8, "best_seller_rank").sortWithinPartitions("best_seller_rank").write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    landed = landing.read_csv(spark, path, line_breaks=False)
    out = standardize.listings(landed, _now()).where("malformed IS NULL")
    return out.select(F.col("best_seller_rank").alias("part"), F.col("record_no").cast("long").alias("record_no"), "name", "url", "selling_price")


def research_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The raw research records written as CSV files whose cells hold line breaks, landed again and standardized."""
    path = scratch_path(spark, "submission")
    cells = _raw(spark, sf, binding_raw.RESEARCH)
    cells = cells.withColumns({"search_term": F.col("record_no").cast("string"), "description": F.lit('two\nlines, "quoted"')}).withColumnRenamed("product_name", " Product_Name ")
    cells.repartitionByRange(8, "record_no").sortWithinPartitions("record_no").drop("record_no").write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    out = standardize.research(landing.read_csv(spark, path)).where("malformed IS NULL")
    return out.select(
        F.col("search_term").cast("long").alias("part"), F.col("record_no").cast("long").alias("record_no"), "name", "url", "marketplace", "selling_price", "competitor_count", "description"
    )


def json_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The raw research records written as JSON envelopes in camel case, landed again and standardized."""
    path = scratch_path(spark, "submission")
    cells = _raw(spark, sf, binding_raw.RESEARCH)
    camel = F.struct(*[F.col(c).alias(landing._camel(c)) for c in cells.columns if c != "record_no"], F.col("record_no").cast("string").alias("searchTerm"))
    # one envelope, and one file, per thousand records
    envelopes = cells.groupBy(F.floor(F.col("record_no") / 1000).alias("g")).agg(F.array_sort(F.collect_list(F.struct("record_no", camel.alias("r")))).alias("rows"))
    envelopes.select("g", F.transform("rows", lambda x: x["r"]).alias("records")).write.partitionBy("g").json(path)
    landed = landing.read_research_json(spark, path)
    out = standardize.research(landed).where("malformed IS NULL")
    return out.select(
        F.col("search_term").cast("long").alias("part"), F.col("record_no").cast("long").alias("position"), "name", "url", "marketplace", "selling_price", "competitor_count", "verification_requested"
    )


def validate_listings(spark: SparkSession, sf: str) -> DataFrame:
    df = standardize.usable_rows(_listings(spark, sf))
    checked = validate.check_listings(df, config.category_slugs(), _now())
    return checked.select("record_no", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def validate_research(spark: SparkSession, sf: str) -> DataFrame:
    df = standardize.usable_rows(_research(spark, sf))
    checked = validate.check_research(df, config.category_slugs(), _now())
    return checked.select(
        "record_no", "code", F.array_join("errors", "; ").alias("errors"), F.when(F.col("code").isNull(), F.array_join("warnings", "; ")).alias("warnings")
    )


def unknown_marketplaces(spark: SparkSession, sf: str) -> DataFrame:
    df = standardize.usable_rows(_listings(spark, sf))
    bad = validate.unknown_marketplace(df, config.marketplaces(spark)).where(~F.col("known_marketplace"))
    return bad.select("record_no", validate.unknown_marketplace_error().alias("error"))


def verification_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = standardize.usable_rows(_listings(spark, sf))
    return validate.gate(df).select("record_no", "dataset_status", "downgraded", F.array_join("verification_notes", " # ").alias("notes"))


def _all_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs as they are, with a neutral host name, and under a loopback or reserved host."""
    u = F.col("url")
    variants = F.array(
        F.struct(F.lit("as is").alias("variant"), u.alias("url")),
        F.struct(F.lit("shop").alias("variant"), F.replace(u, F.lit("example"), F.lit("shop")).alias("url")),
        F.struct(F.lit("port").alias("variant"), F.regexp_replace(u, r"^(https?)://([^/?#]+)", "$1://me:pw@WWW.$2:8080").alias("url")),
        F.struct(F.lit("loopback").alias("variant"), F.regexp_replace(u, r"://[^/?#]+", "://127.0.0.1/Demo").alias("url")),
        F.struct(F.lit("tld").alias("variant"), F.regexp_replace(u, r"example\.\w+", "foo-store.test").alias("url")),
        F.struct(F.lit("ftp").alias("variant"), F.regexp_replace(u, r"^https?", "ftp").alias("url")),
        F.struct(F.lit("broken").alias("variant"), F.regexp_replace(u, r"^https?://", "").alias("url")),
    )
    pages = binding.table(spark, sf, "pages").select("page_id", F.explode(variants).alias("v"))
    return pages.select("page_id", "v.variant", "v.url")


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _all_urls(spark, sf).select("page_id", "variant", urls.canonical_url(F.col("url")).alias("canonical"))


def placeholder_urls(spark: SparkSession, sf: str) -> DataFrame:
    reasons = urls.placeholder_reasons(F.col("url"))
    return _all_urls(spark, sf).select("page_id", "variant", (F.size(reasons) > 0).alias("is_placeholder"), F.array_join(reasons, "; ").alias("reasons"))


def source_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every document source and conversation role, wrapped in several ways, judged as a source name."""
    docs = binding.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(
        F.col("source"), F.concat(F.col("source"), F.lit("_test2")), F.concat(F.lit("demo"), F.col("source")), F.concat(F.lit("tbd 9"), F.col("lang")),
        F.concat(F.lit("contest "), F.col("lang")), F.lit(" Manual  Entry "), F.lit("N/A"), F.concat(F.lit("  "), F.col("lang"), F.lit("-Sample")),
    )).alias("source_name"))
    return docs.select("id", "source_name", urls.is_non_attributable(F.col("source_name")).alias("non_attributable"))


def match_names(spark: SparkSession, sf: str) -> DataFrame:
    return binding.table(spark, sf, "documents").select("doc_id", t.match_name(F.col("text")).alias("match_name"))


def display_names(spark: SparkSession, sf: str) -> DataFrame:
    return binding.table(spark, sf, "documents").select("doc_id", t.display_name(F.col("text")).alias("display_name"))


def theme_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents read as pipe lists of themes (line breaks turned into pipes), one row per theme."""
    cell = F.regexp_replace("text", r"[\n.]+", "|")
    return binding.table(spark, sf, "documents").select("doc_id", F.posexplode(t.pipe_list(cell)).alias("position", "theme")).withColumn("position", F.col("position").cast("long"))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    df = standardize.usable_rows(_listings(spark, sf))
    return dedupe.with_keys(df.select("record_no", "marketplace", "external_id", "url", "normalized_name"))


def dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf).select("record_no", "identity_key", "name_key")


def batch_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.split_duplicates(_keyed(spark, sf)).select("record_no", "is_duplicate")


def dedupe_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a row that shares one key with the part before it and one with the part behind it: one chain through all rows."""
    key = F.col("p_partkey")
    rows = binding.table(spark, sf, "part").select(
        key.alias("record_no"), F.concat(F.lit("i"), F.floor(key / 2)).alias("identity_key"), F.concat(F.lit("n"), F.floor((key + 1) / 2)).alias("name_key")
    )
    return dedupe.split_duplicates(rows).select("record_no", "is_duplicate")


def _base_store(spark: SparkSession, sf: str) -> tables.Store:
    """A store that holds the products on file and their index, in buckets fit for a small table."""
    store = tables.Store(spark, scratch_path(spark, "store"), buckets=16)
    with store.begin("base") as run:
        imports.load_products(run, _stored_wide(spark, sf))
    return store


def _match(spark: SparkSession, sf: str, real: bool) -> DataFrame:
    """Matched through the stored index of the products on file."""
    return imports.by_index(_base_store(spark, sf))(_keyed(spark, sf), real).select("record_no", "existing_id")


def entity_match(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, False)


def entity_match_real(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf, True)


def _stored_wide(spark: SparkSession, sf: str) -> DataFrame:
    stored = binding_raw.stored(spark, sf)
    types = dict(standardize.listings(_raw(spark, sf, binding_raw.LISTING), _now()).dtypes)
    types["verification_notes"] = "array<string>"
    absent = [c for c in resolve.PRODUCT_COLUMNS if c not in stored.columns]
    return stored.withColumns({c: F.lit(None).cast(types[c]) for c in absent})


def _matcher(spark: SparkSession, sf: str):
    stored = binding_raw.stored(spark, sf)
    return lambda rows, exclude_sample: resolve.match(rows, stored, exclude_sample)


def _listing_batch(spark: SparkSession, sf: str) -> imports.Batch:
    checked = imports.check_listings(_raw(spark, sf, binding_raw.LISTING), _now())
    return imports.run_batch(checked, _matcher(spark, sf), config.marketplaces(spark), research=False)


def _research_batch(spark: SparkSession, sf: str) -> imports.Batch:
    checked = imports.check_research(_raw(spark, sf, binding_raw.RESEARCH), _now())
    return imports.run_batch(checked, _matcher(spark, sf), config.marketplaces(spark), research=True)


def import_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return _research_batch(spark, sf).resolved.select("record_no", "product_id", "is_new", "dataset_status", "downgraded")


def snapshot_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Products on file as a base of which one in three is out of date, a layer that mends those, and the batch as a second layer."""
    store, stored = tables.Store(spark, scratch_path(spark, "store")), _stored_wide(spark, sf)
    stale = F.pmod(F.xxhash64("product_id"), F.lit(3)) == 0
    with store.begin("base") as run:
        run.write_snapshot("products", stored.withColumns({"name": F.when(stale, "out of date").otherwise(F.col("name")), "brand": F.when(~stale, F.col("brand"))}))
    with store.begin("mend") as run:
        run.upsert("products", stored)
    with store.begin("batch") as run:
        run.upsert("products", resolve.snapshot(None, _listing_batch(spark, sf).resolved))
    return store.read_snapshot("products", schemas.PRODUCTS).select("product_id", "name", "url", "marketplace", "external_id", "normalized_name", "brand", "dataset_status", "source_name")


def pain_point_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Two themes of each product on file, replaced by one in a layer, and those of the batch in a second one."""
    store = tables.Store(spark, scratch_path(spark, "store"))
    theme = lambda *texts: binding_raw.stored(spark, sf).select(
        "product_id", F.lit("complaint").alias("type"), F.explode(F.array(*[F.lit(t) for t in texts])).alias("theme"), F.lit(1).cast("long").alias("mention_count"))
    with store.begin("base") as run:
        run.write_snapshot("pain_points", theme("first", "second"))
    with store.begin("replaced") as run:
        run.upsert("pain_points", theme("old theme"))
    with store.begin("batch") as run:
        run.upsert("pain_points", resolve.pain_point_rows(_listing_batch(spark, sf).resolved).select("product_id", "type", "theme", "mention_count"))
    return store.read_snapshot("pain_points", schemas.PAIN_POINTS).select("product_id", "type", "theme", "mention_count")


#: Every raw listing lands in one of three submissions.
THIRDS = 3


def third(rows: DataFrame, k: int) -> DataFrame:
    return rows.where(F.col("record_no") % THIRDS == k)


def store_state(store: tables.Store) -> DataFrame:
    """What the store holds of each product: its record, its number of price rows, and its newest price with the record that brought it."""
    prices = store.read_history("prices", schemas.PRICES).groupBy("product_id").agg(F.count(F.lit(1)).alias("price_rows"))
    newest = store.read_snapshot("newest_prices", schemas.NEWEST_PRICES).select("product_id", "selling_price", F.col("record_no").alias("price_record"))
    products = store.read_snapshot("products", schemas.PRODUCTS).join(prices, "product_id", "left").join(newest, "product_id", "left")
    return products.select("product_id", "name", "url", "marketplace", "external_id", "brand", "dataset_status", "source_name", "price_rows", "selling_price", "price_record")


def _three_imports(spark: SparkSession, sf: str) -> tables.Store:
    store, rows = _base_store(spark, sf), _raw(spark, sf, binding_raw.LISTING)
    for k in range(THIRDS):
        imports.write_import(store, third(rows, k), f"run-{k}", _now(), config.marketplaces(spark), research=False)
    return store


def store_after_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Three submissions imported one after the other into a store with products; buckets of many layers are compacted in between."""
    store = _three_imports(spark, sf)
    store.compact(layers=2)
    return store_state(store)


def stored_run_log(spark: SparkSession, sf: str) -> DataFrame:
    """The run log that three imports wrote, oldest run first."""
    runs = _three_imports(spark, sf).read_history("runs", schemas.RUNS)
    return runs.select("run_id", "status", "received", "created", "updated", "rejected", "duplicates")


def newest_price_table(spark: SparkSession, sf: str) -> DataFrame:
    """Newest prices as three commits leave them: every observation belongs to one of the runs, and each folds its own rows into the table."""
    store = tables.Store(spark, scratch_path(spark, "store"))
    rows = ranked(binding.prices(spark, sf).select("product_id", "collected_at", "row_id", "selling_price", "mrp"), [F.col("row_id"), F.col("product_id")], "record_no")
    for k in range(THIRDS):
        own = rows.where(F.dayofyear("collected_at") % THIRDS == k).withColumn("run_id", F.lit(f"run-{k}"))
        fields = tables.empty(spark, schemas.PRICES).schema.fields
        added = own.select(*[F.col(f.name).cast(f.dataType) if f.name in own.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        with store.begin(f"run-{k}") as run:
            imports.append_history(run, "prices", added, imports.newest_on_file(store, "prices", own.select("product_id").distinct()))
    newest = store.read_snapshot("newest_prices", schemas.NEWEST_PRICES)
    return newest.select("product_id", "selling_price", "mrp")


def store_index_after_imports(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index after three imports: entries of products as they are now, withdrawn ones left out."""
    entries = _three_imports(spark, sf).read_snapshot("product_keys", schemas.PRODUCT_KEYS)
    return entries.where("live").select("marketplace", "kind", "key", "product_id", "sample")


def import_price_rows(spark: SparkSession, sf: str) -> DataFrame:
    batch = _listing_batch(spark, sf)
    on_file = binding_raw.stored(spark, sf).select(
        "product_id", F.to_timestamp(F.lit("2026-09-01 00:00:00")).alias("collected_at"),
        F.lit(301.0).alias("selling_price"), F.lit(None).cast("double").alias("mrp"),
    )
    return imports.price_rows(batch.resolved, on_file).select("product_id", "record_no", "selling_price", "mrp")


def field_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = standardize.usable_rows(_research(spark, sf)).withColumn("product_id", F.concat(F.lit("P"), F.col("record_no")))
    return resolve.ledger_rows(rows, F.lit("run-1")).select("product_id", "field_name", "raw_value", "numeric_value", "source_name", "run_id")


def import_report(spark: SparkSession, sf: str) -> DataFrame:
    return imports.report(_research_batch(spark, sf), research=True)


def listing_ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return imports.report(_listing_batch(spark, sf), research=False)


def import_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return imports.rejection_counts(_research_batch(spark, sf).rejections)


def missing_critical_report(spark: SparkSession, sf: str) -> DataFrame:
    return _research_batch(spark, sf).missing_critical.withColumn("missing", F.array_join("missing", "; "))


def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    research = imports.dry_run(imports.check_research(_raw(spark, sf, binding_raw.RESEARCH), _now())).withColumn("kind", F.lit("research"))
    listing = imports.dry_run(imports.check_listings(_raw(spark, sf, binding_raw.LISTING), _now())).withColumn("kind", F.lit("listing"))
    return research.unionByName(listing)


def batch_source_names(spark: SparkSession, sf: str) -> DataFrame:
    return imports.source_names(standardize.usable_rows(_research(spark, sf)))


def export_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The export file written and read back as lines."""
    from listwright.queries.scoring import export_rows

    path = scratch_path(spark, "export")
    export.write_csv(export_rows(spark, sf), path)
    rows = spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").option("nullValue", "\u0000").csv(path)
    return rows.select(*[F.col(f"`{c}`").alias(c.lower().replace(" ", "_").replace("%", "pct").replace("(", "").replace(")", "")) for c in rows.columns])


def export_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    from listwright.queries.scoring import export_rows

    path = scratch_path(spark, "export")
    export.write_json(export_rows(spark, sf), path)
    line = F.col("value")
    return spark.read.text(path).select(
        F.get_json_object(line, "$.rank").cast("long").alias("rank"), F.get_json_object(line, "$.product").alias("product"),
        line.contains('"classification":null').alias("class_is_null"), F.size(F.json_object_keys(line)).cast("long").alias("fields"),
    )


def regate_stored(spark: SparkSession, sf: str) -> DataFrame:
    df = maintain.regate(binding.products(spark, sf))
    return df.select("product_id", "dataset_status", F.array_join("verification_notes", "; ").alias("notes"))


def status_backfill(spark: SparkSession, sf: str) -> DataFrame:
    old = binding.products(spark, sf).withColumns({
        "normalized_name": F.expr("CASE WHEN data_source_id = 2 THEN 'kept' END"), "is_sample_data": F.expr("dataset_status = 'SAMPLE'"),
        "source_name": F.expr("CASE WHEN data_source_id = 0 THEN source_name END"),
        "dataset_status": F.expr("CASE WHEN fragile THEN 'PROVISIONAL' WHEN data_source_id = 1 THEN dataset_status END"),
    })
    return maintain.backfill(old, binding.sources(spark)).select("product_id", "normalized_name", "source_name", "dataset_status")


def ungated_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = rescore.stored_scores(binding.catalog(spark, sf), binding.AS_OF)
    return maintain.withhold_ungated(scores).select("product_id", "risk_score", "score_status", "final_score", "classification")


def source_freshness(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.to_timestamp(F.lit("2024-02-01 12:00:00"))
    df = tables.source_freshness(binding.products(spark, sf), as_of)
    return df.withColumn("newest", t.iso(F.col("newest")))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return binding.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") * 1_000_000).alias("finished_at"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END").alias("status"),
        (F.col("o_custkey") % 4).alias("data_source_id"),
    )


def run_list(spark: SparkSession, sf: str) -> DataFrame:
    return tables.newest_runs(_runs(spark, sf)).select("run_id", "status", t.iso(F.col("created_at")).alias("created_at"))


def last_completed_run(spark: SparkSession, sf: str) -> DataFrame:
    return tables.last_completed_run(_runs(spark, sf), binding.sources(spark)).withColumn("finished_at", t.iso(F.col("finished_at")))


def seed_fees_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Fee rows proposed per part against the configured fee table."""
    incoming = binding.table(spark, sf, "part").select(
        F.expr("CASE WHEN p_partkey % 9 = 0 THEN 'ebay' ELSE " + binding.MARKETPLACE + " END").alias("marketplace"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN 'default' ELSE " + binding.CATEGORY + " END").alias("category"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'referral_percentage' WHEN 1 THEN 'commission_percentage' ELSE 'closing_fee_fixed_inr' END").alias("fee_type"),
        F.expr("CAST('2026-01-01' AS DATE)").alias("effective_date"), F.col("p_size").cast("double").alias("fee_value"), F.lit("rate card").alias("source"),
    )
    added, skipped = tables.seed_fees(config.fees(spark), incoming, config.marketplaces(spark))
    warned = skipped.groupBy("marketplace").agg(F.count(F.lit(1)).cast("double").alias("fee_value")).select(
        "marketplace", F.lit("skipped").alias("category"), F.lit("").alias("fee_type"), "fee_value", F.lit("").alias("source")
    )
    return added.select("marketplace", "category", "fee_type", "fee_value", "source").unionByName(warned)


QUERIES = {
    f.__name__: f
    for f in [
        standardize_listings, standardize_research, malformed_rows, pain_point_shred, csv_scan, research_csv_scan, json_scan, validate_listings, validate_research,
        unknown_marketplaces, verification_gate, canonical_urls, placeholder_urls, source_names, match_names, display_names, theme_lists,
        dedupe_keys, batch_dedupe, dedupe_chain, store_after_imports, store_index_after_imports, stored_run_log, newest_price_table, entity_match, entity_match_real, import_resolved, snapshot_merge, pain_point_replace, import_price_rows,
        field_ledger, import_report, listing_ingest_summary, import_rejections, missing_critical_report, dry_run, batch_source_names,
        export_csv_lines, export_json_lines, regate_stored, status_backfill, ungated_scores, source_freshness, run_list, last_completed_run,
        seed_fees_if_absent,
    ]
}
