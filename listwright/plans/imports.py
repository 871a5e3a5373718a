"""A submission from raw rows to the rows it adds to every table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listwright import config, schemas
from listwright.operators import dedupe, history, resolve, standardize, validate
from listwright.session import cleared, stage
from listwright.sources.tables import Conflict, Run, Store, dimension

DUPLICATE = "another record in this submission already describes this product"
CONFLICT = "the listing URL already belongs to another product"


@dataclass
class Checked:
    """Outcome of standardizing and validating; nothing is matched or written yet."""

    standardized: DataFrame
    accepted: DataFrame
    rejections: DataFrame
    warnings: DataFrame


@dataclass
class Batch:
    """Rows a submission adds or replaces, and its report parts."""

    checked: Checked
    resolved: DataFrame
    rejections: DataFrame
    duplicates: DataFrame
    downgrades: DataFrame
    missing_critical: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _reject(rows: DataFrame, code: str, errors: Column) -> DataFrame:
    return rows.select("record_no", F.col("name").alias("identifier"), F.lit(code).alias("code"), errors.alias("errors"))


def check_listings(raw: DataFrame, now: Column) -> Checked:
    """Demo/manual rows: every validation error is listed, code INVALID_RECORD."""
    rows = stage(standardize.listings(raw, now), "standardized")
    checked = stage(validate.check_listings(standardize.usable_rows(rows), config.category_slugs(), now), "checked")
    bad = checked.where(F.size("errors") > 0)
    rejections = _union([standardize.malformed_rows(rows), _reject(bad, "INVALID_RECORD", F.col("errors"))])
    return Checked(rows, checked.where(F.size("errors") == 0), rejections, _warned(checked.where(F.size("errors") == 0)))


def check_research(raw: DataFrame, now: Column) -> Checked:
    """Research records: the first failing rule group gives the code."""
    rows = stage(standardize.research(raw), "standardized")
    checked = stage(validate.check_research(standardize.usable_rows(rows), config.category_slugs(), now), "checked")
    bad = checked.where(F.col("code").isNotNull())
    identifier = F.when(F.col("name") != "", F.col("name")).when(F.col("url") != "", F.col("url"))
    refused = bad.select("record_no", identifier.alias("identifier"), "code", "errors")
    rejections = _union([standardize.malformed_rows(rows), refused])
    accepted = checked.where(F.col("code").isNull())
    return Checked(rows, accepted, rejections, _warned(accepted))


def _warned(accepted: DataFrame) -> DataFrame:
    return accepted.where(F.size("warnings") > 0).select("record_no", F.col("name").alias("identifier"), "warnings")


def run_batch(checked: Checked, match: Callable[[DataFrame, bool], DataFrame], marketplaces: DataFrame, research: bool) -> Batch:
    """Marketplace check, in-file dedupe, verification gate and match with the stored products.

    ``match`` gets the rows and whether SAMPLE products are left out, and adds what ``resolve.match_by`` adds. Research imports never
    match SAMPLE products, and claim VERIFIED only on request.
    """
    placed = validate.unknown_marketplace(checked.accepted, marketplaces)
    keyed = stage(dedupe.with_keys(placed.where("known_marketplace")), "keyed")
    marked = stage(dedupe.split_duplicates(keyed), "deduplicated")
    claim = F.when(F.col("verification_requested"), "VERIFIED").otherwise("UNVERIFIED") if research else None
    gated = validate.gate(marked.where(~F.col("is_duplicate")), claim)
    linked = stage(resolve.resolve(match(gated, research)), "resolved")
    resolved = linked.where(~F.col("conflict"))
    duplicates = marked.where("is_duplicate").select("record_no", F.col("name").alias("identifier"))
    rejections = [
        checked.rejections,
        _reject(placed.where(~F.col("known_marketplace")), "UNKNOWN_MARKETPLACE", F.array(validate.unknown_marketplace_error())),
        _reject(linked.where("conflict"), "CONFLICTING_URL", F.array(F.lit(CONFLICT))),
    ]
    if research:
        rejections.append(duplicates.select("record_no", "identifier", F.lit("DUPLICATE_IN_FILE").alias("code"), F.array(F.lit(DUPLICATE)).alias("errors")))
    missing = resolved.withColumn("missing", validate.missing_for_score()).where(F.size("missing") > 0)
    return Batch(
        checked, resolved, _union(rejections), duplicates,
        resolved.where("downgraded").select("record_no", F.col("name").alias("identifier"), F.col("verification_notes").alias("reasons")),
        missing.select("record_no", F.col("name").alias("identifier"), "missing"),
    )


def _counts(df: DataFrame, **measures: Column | None) -> DataFrame:
    """One aggregate over ``df``, given as (measure, n) rows; None counts all rows."""
    row = df.agg(*[(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(name) for name, c in measures.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).alias("n")) for name in measures])
    return row.select(F.explode(entries).alias("r")).select("r.*")


def report(batch: Batch, research: bool) -> DataFrame:
    """Counts of an import, one (measure, n) row each.

    A research import counts duplicates among the rejected records, a listing import beside them.
    """
    new = F.col("is_new")
    outcome = {"created": new, "updated": ~new, "verification_downgrades": F.col("downgraded")}
    if research:
        outcome |= {"imported": None, "merged_into_existing": ~new, "missing_critical_fields": F.size(validate.missing_for_score()) > 0}
    parts = [
        _counts(batch.checked.standardized, **{"submitted" if research else "received": None}),
        _counts(batch.resolved, **outcome),
        _counts(batch.rejections, rejected=None),
        _counts(batch.duplicates, **{"duplicates_in_file" if research else "skipped_duplicate": None}),
    ]
    if research:
        parts.append(_counts(batch.checked.warnings, records_with_warnings=None))
    return _union(parts)


def dry_run(checked: Checked) -> DataFrame:
    """What an import would do, without matching or writing."""
    return _union([
        _counts(checked.standardized, submitted=None), _counts(checked.accepted, would_import=None),
        _counts(checked.rejections, would_reject=None), _counts(checked.warnings, warnings=None),
    ])


def rejection_counts(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("code").agg(F.count(F.lit(1)).alias("records"))


PROVENANCE = ["source_name", "source_url", "collected_at", "confidence_score"]


def price_rows(resolved: DataFrame, on_file: DataFrame) -> DataFrame:
    """Price rows to append; compared with the newest stored row (``on_file``, one per product) after rounding to two decimals."""
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("double") / 100
    rows = resolved.select(
        "product_id", "record_no", cents("selling_price").alias("selling_price"), cents("mrp").alias("mrp"), "discount_percentage", "currency", *PROVENANCE
    )
    return history.changed_on_arrival(rows, "product_id", "record_no", "collected_at", history.PRICE_FIELDS, on_file)


def metrics_rows(resolved: DataFrame, on_file: DataFrame) -> DataFrame:
    rows = history.with_any_metric(resolved.select("product_id", "record_no", *history.METRIC_FIELDS, "search_term", *PROVENANCE))
    return history.changed_on_arrival(rows, "product_id", "record_no", "collected_at", history.METRIC_TRIGGERS, on_file)


def findings(batch: Batch) -> DataFrame:
    """What an import noticed besides the rejections: kind, record, details."""
    none = F.array().cast("array<string>")
    kinds = {
        "duplicate": (batch.duplicates, none), "warning": (batch.checked.warnings, F.col("warnings")),
        "downgrade": (batch.downgrades, F.col("reasons")), "missing_critical": (batch.missing_critical, F.col("missing")),
    }
    return _union([df.select(F.lit(kind).alias("kind"), "record_no", "identifier", F.coalesce(details, none).alias("details")) for kind, (df, details) in kinds.items()])


def source_names(standardized: DataFrame) -> DataFrame:
    """The distinct source names of a submission, one row each."""
    return standardized.where("source_name <> ''").select("source_name").distinct()


def _run_row(spark, run_id: str, data_source_id: int | None, status: str, now: Column, counts: dict[str, int], error: str | None) -> DataFrame:
    given = {"run_id": run_id, "data_source_id": data_source_id, "status": status, "error": error, **{c: counts.get(c) for c in ("received", "created", "updated", "rejected", "duplicates")}}
    times = {"created_at": now, "finished_at": F.current_timestamp()}
    fields = StructType.fromDDL(schemas.RUNS).fields
    return spark.range(0, 1, 1, 1).select(*[(times[f.name] if f.name in times else F.lit(given[f.name])).cast(f.dataType).alias(f.name) for f in fields])


#: Times an import begins again because another run was committed meanwhile.
ATTEMPTS = 5


def write_import(
    store: Store, raw: DataFrame, run_id: str, now: Column, marketplaces: DataFrame | None, research: bool, data_source_id: int | None = None,
) -> None:
    """Runs a submission and commits all its tables together; a run that is committed already changes nothing.

    ``marketplaces`` are the stored ones where none are given. A run that meets another one's commit is repeated on the newer tables. A
    run that fails leaves the tables as they were and a row with its error in the run log; staged copies go either way.
    """
    places = dimension(store, "marketplaces") if marketplaces is None else marketplaces
    for attempt in range(ATTEMPTS):
        if store.is_committed(run_id):
            return
        try:
            with cleared(store.spark), store.begin(run_id) as run:
                _write(run, store, raw, run_id, now, places, research, data_source_id)
            return
        except Conflict:
            if attempt + 1 == ATTEMPTS:
                raise
        except Exception as error:
            _log_failure(store, _run_row(store.spark, run_id, data_source_id, "failed", now, {}, str(error)[:2000]))
            raise


def _log_failure(store: Store, row: DataFrame) -> None:
    """Best effort: what goes wrong here must not hide the first error."""
    try:
        store.append("runs", row, f"failed-{uuid.uuid4().hex}")
    except Exception as second:
        print(f"the failed run could not be logged: {second}")


#: Keys of a batch that are looked up in the files' statistics and Bloom filters; larger batches join the opened buckets only.
PUSHED = 500


def by_index(store: Store) -> Callable[[DataFrame, bool], DataFrame]:
    """Matches rows through the stored index: only the buckets of their keys are opened, and of a small batch only the files that may hold one."""

    def match(rows: DataFrame, exclude_sample: bool) -> DataFrame:
        asked = stage(resolve.key_entries(rows, "record_no").select("slot").distinct(), "slots")
        entries = store.read_snapshot("product_keys", schemas.PRODUCT_KEYS, store.touched("product_keys", asked))
        slots = [r["slot"] for r in asked.limit(PUSHED + 1).collect()]
        if len(slots) <= PUSHED:
            entries = entries.where(F.col("slot").isin(slots))
        return resolve.match_by(rows, entries, exclude_sample)

    return match


def load_products(run: Run, products: DataFrame) -> None:
    """Products given as a whole, with their index."""
    run.write_snapshot("products", products)
    run.write_snapshot("product_keys", resolve.product_entries(products))


def newest_on_file(store: Store, name: str, ids: DataFrame) -> DataFrame:
    """The newest stored row of each of some products (``ids``: product_id), from the buckets that hold them."""
    table = f"newest_{name}"
    return store.read_snapshot(table, schemas.TABLES[table], store.touched(table, ids)).join(ids, "product_id", "left_semi")


def append_history(run: Run, name: str, added: DataFrame, newest: DataFrame) -> None:
    """A run's history rows, and the newest rows that follow: both are as large as the run, whatever the history holds."""
    run.append(name, added.select(*StructType.fromDDL(schemas.TABLES[name]).names))
    run.upsert(f"newest_{name}", history.folded(newest, added, run.number))


def _write(run: Run, store: Store, raw: DataFrame, run_id: str, now: Column, marketplaces: DataFrame, research: bool, data_source_id: int | None) -> None:
    checked = check_research(raw, now) if research else check_listings(raw, now)
    batch = run_batch(checked, by_index(store), marketplaces, research)
    tagged = lambda df: df.withColumn("run_id", F.lit(run_id))
    ids = stage(batch.resolved.select("product_id").distinct(), "touched")
    known = lambda name: stage(newest_on_file(store, name, ids), f"newest-{name}")
    for name, rows, fields in [("prices", price_rows, history.PRICE_FIELDS), ("metrics", metrics_rows, history.METRIC_TRIGGERS)]:
        newest = known(name)
        append_history(run, name, stage(tagged(rows(batch.resolved, newest.select("product_id", "collected_at", *fields))), name), newest)
    append_history(run, "costs", stage(tagged(history.cost_rows(batch.resolved, carried=("record_no",))), "costs"), known("costs"))
    if research:
        run.append("ledger", resolve.ledger_rows(batch.resolved, F.lit(run_id)))
    run.append("rejections", batch.rejections)
    run.append("findings", tagged(findings(batch)).select("run_id", "kind", "record_no", "identifier", "details"))
    measures = stage(report(batch, research), "report")
    run.append("reports", tagged(measures).select("run_id", "measure", "n"))
    run.upsert("pain_points", resolve.pain_point_rows(batch.resolved))
    records = stage(resolve.snapshot(None, batch.resolved), "records")
    before = store.read_snapshot("products", schemas.PRODUCTS, store.touched("products", ids)).join(ids, "product_id", "left_semi")
    run.upsert("product_keys", resolve.changed_entries(before, records))
    run.upsert("products", records)
    counts = {r["measure"]: r["n"] for r in measures.collect()}
    named = {"received": ("submitted", "received"), "duplicates": ("duplicates_in_file", "skipped_duplicate")}
    counts |= {name: next((counts[m] for m in found if m in counts), None) for name, found in named.items()}
    run.append("runs", _run_row(store.spark, run_id, data_source_id, "completed", now, counts, None))
