"""Oracle SQL for the scoring and serving queries."""

from __future__ import annotations

from listwright.fixed import CRITICAL_FIELDS, DISCLAIMERS, NEXT_STEPS, NO_RISKS
from listwright.oracle.base import _COMPONENTS, inr, iso, num, quote, r2, with_ctes

_ORDER = "collected_at, l_orderkey, l_linenumber, l_suppkey, l_extendedprice"
_NEWEST = ", ".join(f"{c} DESC" for c in _ORDER.split(", "))
_KEYS = {
    "demand": "demand", "profitability": "profitability", "competition_opportunity": "competitionOpportunity", "differentiation": "differentiation",
    "shipping_simplicity": "shippingSimplicity", "customer_pain_opportunity": "customerPainOpportunity", "bundle_expansion": "bundleExpansion",
}

_DISCLAIMER = (
    f"CASE WHEN dataset_status='SAMPLE' THEN {quote(DISCLAIMERS['SAMPLE'])} WHEN score_status='INCOMPLETE' THEN {quote(DISCLAIMERS['INCOMPLETE'])} "
    f"WHEN dataset_status='UNVERIFIED' THEN {quote(DISCLAIMERS['UNVERIFIED'])} ELSE {quote(DISCLAIMERS['VERIFIED'])} END"
)
_MISSING_COSTS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{n}' END" for c, n in [
        ("product_cost", "productCost"), ("shipping_cost", "shippingCost"), ("packaging_cost", "packagingCost"), ("marketplace_fee", "marketplaceFee"),
        ("payment_fee", "paymentFee"), ("advertising_cost", "advertisingCost"), ("return_allowance", "returnAllowance"), ("other_costs", "otherCosts"),
    ]) + "], lambda x: x IS NOT NULL), '{sep}')"
_NOTES = (
    "array_to_string(list_filter([CASE WHEN product_cost IS NULL THEN 'No supplier/product cost on record — profit is not meaningful until one is supplied.' END,"
    " CASE WHEN " + _MISSING_COSTS.replace("{sep}", ", ") + " <> '' THEN 'Treated as zero because no value was collected: ' || " + _MISSING_COSTS.replace("{sep}", ", ") + " || '.' END,"
    " CASE WHEN n_fees IS NULL AND marketplace_fee IS NULL THEN 'No marketplace fee schedule matched this marketplace/category.' END], lambda x: x IS NOT NULL), '{sep}')"
)

_FLAT = """rank, product_id, name, coalesce(marketplace_name, slug) AS marketplace, category, brand, stored_price AS selling_price, stored_landed AS estimated_landed_cost,
  stored_profit AS profit_per_unit, stored_margin AS profit_margin_percentage, demand AS demand_score, risk_score, array_to_string(reasons, '; ') AS risk_reasons,
  final_score, classification, data_completeness, dataset_status, score_status, array_to_string(missing, '; ') AS missing_critical_fields,
  shown_source AS source_name, source_url"""

_FILTER = """category IN ('car-accessories','home-organization','storage-products','kitchen-organization') AND slug IN ('amazon_in','flipkart','meesho')
  AND stored_price BETWEEN 1000 AND 90000 AND stored_margin >= 5 AND demand >= 10 AND competition_opportunity >= 5 AND differentiation >= 20 AND risk_score <= 80
  AND final_score >= 20 AND (name ILIKE '%re%' OR brand ILIKE '%re%') AND dataset_status <> 'SAMPLE' AND score_status='COMPLETE'"""

_LABELS = "CASE x " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in CRITICAL_FIELDS.items()) + " END"


def _page(where: str, order: str, limit: int, offset: int = 0) -> str:
    return with_ctes(f"""SELECT {_FLAT} FROM (SELECT *, row_number() OVER (ORDER BY {order}, name, product_id) AS rank FROM ranked WHERE {where})
      WHERE rank > {offset} AND rank <= {offset + limit}""")


_FINAL_ORDER = "final_score DESC NULLS LAST"

_PAINS = {
    "pain_lists": """SELECT product_id, count(*) AS n_pains, coalesce(list(theme ORDER BY theme) FILTER (type='complaint'), []) AS complaints,
      coalesce(list(theme ORDER BY theme) FILTER (type='opportunity'), []) AS opportunities,
      arg_min(theme, (-mention_count, theme)) FILTER (type='complaint') AS top_complaint,
      list(DISTINCT source_name ORDER BY source_name) AS pain_sources FROM pains GROUP BY product_id""",
}


def _explain(where: str, limit: int) -> str:
    na = "'Data unavailable'"
    discount = "CASE WHEN mrp > 0 AND selling_price <= mrp THEN floor((mrp-selling_price)/mrp*10000.0+0.5)/100.0 END"
    return with_ctes(f"""SELECT rank, product_id, name AS product_name, category, marketplace_name AS marketplace, stored_price AS current_price,
      product_cost AS estimated_supplier_cost, stored_landed AS estimated_landed_cost, stored_profit AS profit_per_unit, stored_margin AS profit_margin_percentage,
      demand AS demand_score, competition_opportunity AS competition_opportunity_score, differentiation AS differentiation_score, risk_score, final_score, classification,
      top_complaint AS main_customer_pain_point, opportunities[1] AS differentiation_opportunity,
      CASE WHEN review_count IS NOT NULL AND average_rating IS NOT NULL THEN {inr('review_count')} || ' reviews at ' || {num('average_rating')} || '/5 on ' || marketplace_name
        || ' (review count is an indirect popularity signal, not a sales figure).' ELSE {na} END AS demand_evidence,
      'Listed at ₹' || {inr('selling_price')} || coalesce(' against an MRP of ₹' || {inr('mrp')}, '')
        || CASE WHEN {discount} <> 0 THEN ' (' || {num(discount, 2)} || '% off)' ELSE '' END || '.' AS pricing_evidence,
      CASE WHEN competitor_count IS NOT NULL THEN competitor_count || ' comparable listings counted; competition opportunity scores ' || {num('competition_opportunity', 2)}
        || '/100 (100 = least contested).' ELSE {na} END AS competition_evidence,
      CASE WHEN is_reliable THEN '₹' || {inr('stored_price')} || ' selling price less ₹' || {inr('total_cost')} || ' total cost leaves ₹' || {inr('stored_profit')}
        || ' per unit (' || {num('stored_margin', 2)} || '% margin). ' || {_NOTES.replace('{sep}', ' ')}
        ELSE 'Data unavailable — no supplier cost on record, so no profit figure is claimed.' END AS economics_evidence,
      CASE WHEN len(complaints) > 0 THEN len(complaints) || ' recurring complaint theme(s) recorded from listing reviews: ' || array_to_string(complaints, ', ') || '.'
        WHEN n_pains > 0 THEN 'Reviews were read and no recurring complaint theme was recorded.' ELSE {na} END AS customer_pain_evidence,
      CASE WHEN len(opportunities) > 0 THEN 'Recorded opportunities: ' || array_to_string(opportunities, ', ') || '.' ELSE {na} END AS differentiation_evidence,
      CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') ELSE {quote(NO_RISKS)} END AS risks,
      CASE WHEN dataset_status='SAMPLE' THEN {quote(NEXT_STEPS['SAMPLE'])} ELSE {quote(NEXT_STEPS['OTHER'])} END AS suggested_validation_step,
      array_to_string(list_concat([shown_source], list_filter(coalesce(pain_sources, []), lambda x: x <> shown_source)), '; ') AS data_sources,
      data_completeness, dataset_status, score_status,
      array_to_string(list_transform(missing, lambda x: {_LABELS}), '; ') AS missing_critical_fields, {_DISCLAIMER} AS disclaimer
      FROM (SELECT *, row_number() OVER (ORDER BY {_FINAL_ORDER}, name, product_id) AS rank FROM ranked WHERE {where})
      LEFT JOIN pain_lists USING (product_id) WHERE rank <= {limit}""", _PAINS)


_IDS = "(VALUES (1,'P7'),(2,'P3'),(3,'P63'),(4,'P100'),(5,'P12')) AS ids(position, product_id)"


def _position(table: str, kind: str, value: str) -> str:
    return f"""SELECT product_id, '{kind}' AS kind, row_number() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) AS position, CAST({value} AS DOUBLE) AS value, source_name
      FROM {table} WHERE product_id IN (SELECT product_id FROM {_IDS})"""


_PROVENANCE = " UNION ALL ".join(
    f"""SELECT product_id, {i} AS position, '{label}' AS field, source_name, source_url, collected_at, confidence_score FROM (
      SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) AS rn FROM {t}) WHERE rn = 1"""
    for i, label, t in [(2, "Selling price / MRP", "prices"), (3, "Demand & competition signals", "metrics"), (4, "Cost inputs", "costs")]
)

SQL = {
    "latest_price": with_ctes(f"SELECT product_id, selling_price, mrp, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) AS rn FROM prices) WHERE rn=1"),
    "latest_metrics": with_ctes("SELECT * FROM latest_metrics"),
    "latest_cost": with_ctes("SELECT * FROM latest_cost"),
    "price_change_history": with_ctes(f"""SELECT product_id, step AS selling_price, l_orderkey, l_linenumber, l_suppkey FROM (
      SELECT *, row_number() OVER w AS rn, lag(step) OVER w AS prev FROM (SELECT *, floor(selling_price/500)*500.0 AS step FROM obs)
      WINDOW w AS (PARTITION BY product_id ORDER BY {_ORDER})) WHERE rn=1 OR step <> prev"""),
    "metrics_change_history": with_ctes(f"""SELECT product_id, rc AS review_count, ar AS average_rating, cc AS competitor_count, l_orderkey, l_linenumber, l_suppkey FROM (
      SELECT *, row_number() OVER w AS rn, lag(rc) OVER w AS prc, lag(ar) OVER w AS par, lag(cc) OVER w AS pcc FROM (
        SELECT *, review_count // 1000 AS rc, floor(average_rating) AS ar, CASE WHEN competitor_count IS NOT NULL THEN CAST(1 AS BIGINT) END AS cc FROM metrics)
      WINDOW w AS (PARTITION BY product_id ORDER BY {_ORDER}))
      WHERE rn=1 OR rc IS DISTINCT FROM prc OR ar IS DISTINCT FROM par OR cc IS DISTINCT FROM pcc"""),
    "price_change_on_arrival": """WITH RECURSIVE seq AS (
        SELECT user_id AS product_id, event_id AS arrival, ts - to_days(CAST(event_id % 7 AS INTEGER)) AS seen, floor(value/100) AS price,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      walk AS (
        SELECT product_id, arrival, n, seen AS state_at, price AS state_price, price, true AS stored FROM seq WHERE n = 1
        UNION ALL
        SELECT s.product_id, s.arrival, s.n,
          CASE WHEN s.price <> w.state_price AND s.seen >= w.state_at THEN s.seen ELSE w.state_at END,
          CASE WHEN s.price <> w.state_price AND s.seen >= w.state_at THEN s.price ELSE w.state_price END,
          s.price, s.price <> w.state_price
        FROM walk w JOIN seq s ON s.product_id = w.product_id AND s.n = w.n + 1)
      SELECT product_id, arrival, price AS selling_price FROM walk WHERE stored""",
    "price_history_newest_first": with_ctes(f"SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) AS position, selling_price, l_orderkey, l_linenumber FROM prices"),
    "cost_append": with_ctes("""SELECT product_id || '/' || l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS product_id, product_cost, shipping_cost, packaging_cost,
      marketplace_fee_override, payment_fee, advertising_cost, return_allowance, other_costs, CAST(CAST(collected_at AS DATE) AS VARCHAR) AS effective_date, confidence_score
      FROM costs WHERE l_orderkey % 4 <> 0"""),
    "fee_asof": with_ctes("""SELECT product_id, fee_type, fee_category, CASE WHEN fee_type LIKE '%percentage' THEN fee_value END AS percentage, amount, fee_source,
      CAST(effective_date AS VARCHAR) AS effective_date FROM applied_fees"""),
    "unit_economics": with_ctes(f"""SELECT product_id, selling_price, marketplace_fee, payment_fee, total_cost, landed_cost, profit, margin_pct, roi_pct, is_reliable,
      {_MISSING_COSTS.replace('{sep}', '; ')} AS missing_costs, {_NOTES.replace('{sep}', '; ')} AS economics_notes FROM econ"""),
    "cohort_stats": with_ctes(f"SELECT category, cohort_size, {r2('lr_min')} AS log_reviews_min, {r2('lr_max')} AS log_reviews_max, c_min AS competitors_min, c_max AS competitors_max, cohort_label FROM cohorts"),
    "sub_scores": with_ctes("SELECT product_id, " + ", ".join(c for c, _ in _COMPONENTS) + " FROM subs"),
    "score_evidence": with_ctes(f"""SELECT product_id, CASE WHEN average_rating IS NOT NULL THEN {r2('least(100.0, greatest(0.0, average_rating/5.0*100.0))')} END AS rating_component,
      cohort_label AS cohort, cohort_size, CASE WHEN established_brand_dominance THEN 20.0 ELSE 0.0 END AS brand_penalty,
      CASE WHEN weight_kg IS NULL THEN NULL WHEN weight_kg <= 0.5 THEN 0.0 WHEN weight_kg <= 1 THEN 10.0 WHEN weight_kg <= 2 THEN 25.0 WHEN weight_kg <= 5 THEN 45.0 ELSE 70.0 END AS weight_penalty,
      CASE WHEN length_cm IS NULL OR length_cm*width_cm*height_cm <= 3000 THEN 0.0 WHEN length_cm*width_cm*height_cm <= 15000 THEN 10.0
           WHEN length_cm*width_cm*height_cm <= 50000 THEN 25.0 ELSE 45.0 END AS volume_penalty, length_cm IS NOT NULL AS dimensions_available,
      CASE WHEN bundle_potential_score IS NOT NULL THEN 'manual_override' WHEN baseline IS NOT NULL THEN 'category_baseline' END AS bundle_source,
      CASE WHEN bundle_expansion IS NULL THEN 'No manual value and no category baseline configured for ''' || category || '''.' END AS bundle_unavailable,
      coalesce(opportunity_count, 0) AS opportunity_count,
      CASE regulatory_complexity WHEN 'low' THEN 5.0 WHEN 'medium' THEN 15.0 WHEN 'high' THEN 30.0 END AS regulatory_points,
      array_to_string(list_transform(missing, lambda x: {_LABELS}), '; ') AS missing_labels FROM scored LEFT JOIN baselines USING (category)""").replace("baseline IS NOT NULL", "baselines.baseline IS NOT NULL"),
    "score_contributions": with_ctes(" UNION ALL ".join(
        f"""SELECT product_id, '{_KEYS[c]}' AS component, {r2(f'{c} * (CAST({w} AS DOUBLE)/available)')} AS contribution,
        floor(CAST({w} AS DOUBLE)/available*10000.0+0.5)/10000.0 AS effective_weight FROM finals WHERE final_score IS NOT NULL AND {c} IS NOT NULL"""
        for c, w in _COMPONENTS)),
    "product_scores": with_ctes("SELECT product_id, stored_price AS selling_price, stored_landed AS estimated_landed_cost, stored_profit AS profit_per_unit, stored_margin AS profit_margin_percentage, stored_roi AS roi_percentage, "
        + ", ".join(f"{c} AS {c}_score" for c, _ in _COMPONENTS)
        + ", final_score, score_status, array_to_string(missing, '; ') AS missing_critical_fields, risk_score, array_to_string(reasons, '; ') AS risk_reasons, classification, data_completeness FROM ranked"),
    "classification_counts": with_ctes("SELECT classification, score_status, count(*) AS products FROM scored GROUP BY ALL"),
    "ranked_products": _page("true", _FINAL_ORDER, 50),
    "ranked_filtered": _page(_FILTER, "risk_score ASC NULLS LAST", 40, 3),
    "ranked_deep": with_ctes(f"""SELECT {_FLAT} FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC NULLS LAST, name, product_id) AS rank FROM ranked)
      WHERE rank > (SELECT count(*) // 2 FROM part) AND rank <= (SELECT count(*) // 2 + 300 FROM part)"""),
    "ranked_total": with_ctes(f"SELECT count(*) AS total FROM ranked WHERE {_FILTER}"),
    "ranked_by_class": _page("classification = 'B' AND dataset_status <> 'SAMPLE' AND score_status='COMPLETE' AND final_score IS NOT NULL", _FINAL_ORDER, 500),
    "export_rows": with_ctes(f"""SELECT row_number() OVER (ORDER BY {_FINAL_ORDER}, name, product_id) AS rank, name AS product, url, marketplace_name AS marketplace, category,
      stored_price AS price, stored_landed AS estimated_cost, stored_profit AS estimated_profit, stored_margin AS margin, demand AS demand_score,
      competition_opportunity AS competition_opportunity_score, differentiation AS differentiation_score, risk_score, final_score, classification, data_completeness,
      dataset_status, score_status, CASE WHEN len(missing) > 0 THEN array_to_string(missing, '; ') ELSE 'None' END AS missing_critical_fields, {_DISCLAIMER} AS disclaimer,
      shown_source AS source_name, source_url, {iso('collected_at')} AS collected_at, CAST(NULL AS VARCHAR) AS score_computed_at FROM ranked"""),
    "dashboard_summary": with_ctes(f"""SELECT count(*) AS total_products, count(final_score) AS products_scored, count(*) - count(final_score) AS products_unscored,
      count(*) FILTER (final_score > 70) AS products_above_70, {r2('CAST(sum(CAST(stored_margin AS DECIMAL(18,2))) AS DOUBLE)/count(stored_margin)')} AS average_margin,
      {r2('CAST(count(stored_margin) AS DOUBLE)/count(*)')} AS margin_coverage, count(*) FILTER (risk_score >= 60) AS high_risk_products,
      count(*) FILTER (classification='A') AS class_a, count(*) FILTER (classification='B') AS class_b, count(*) FILTER (classification='C') AS class_c,
      count(*) FILTER (classification IS NULL) AS class_none, {r2('CAST(sum(CAST(data_completeness AS DECIMAL(18,2))) AS DOUBLE)/count(*)')} AS average_completeness,
      count(*) FILTER (dataset_status='SAMPLE') AS status_sample, count(*) FILTER (dataset_status='UNVERIFIED') AS status_unverified,
      count(*) FILTER (dataset_status='VERIFIED') AS status_verified, count(*) FILTER (dataset_status='VERIFIED') AS real_verified_products,
      count(*) FILTER (has_notes) AS downgraded_claims, count(*) FILTER (score_status='COMPLETE') AS score_complete, count(*) FILTER (score_status='INCOMPLETE') AS score_incomplete,
      count(*) FILTER (dataset_status<>'SAMPLE' AND score_status='COMPLETE' AND final_score IS NOT NULL) AS verified_opportunities FROM ranked"""),
    "category_rollup": with_ctes(f"SELECT category, count(*) AS product_count, {r2('CAST(sum(CAST(final_score AS DECIMAL(18,2))) AS DOUBLE)/nullif(count(final_score),0)')} AS average_score FROM ranked GROUP BY category"),
    "opportunity_explanations": _explain("true", 20),
    "verified_opportunities": _explain("dataset_status <> 'SAMPLE' AND score_status='COMPLETE' AND final_score IS NOT NULL", 20),
    "opportunities_all_incomplete": _explain("score_status='INCOMPLETE'", 500),
    "compare_products": with_ctes(f"""SELECT ids.position, product_id, name, category, marketplace, selling_price, mrp, review_count, total_cost, profit, margin_pct, roi_pct,
      complaint_count, opportunity_count, final_score, classification, score_status, risk_score FROM {_IDS} JOIN ranked USING (product_id)"""),
    "product_detail": with_ctes(f"""SELECT product_id, name, brand, profit, final_score, data_completeness, (SELECT count(*) FROM applied_fees f WHERE f.product_id = ranked.product_id) AS fee_rows,
      1 + (SELECT count(DISTINCT 1) FROM prices t WHERE t.product_id = ranked.product_id) + (SELECT count(DISTINCT 1) FROM metrics t WHERE t.product_id = ranked.product_id)
        + (SELECT count(DISTINCT 1) FROM costs t WHERE t.product_id = ranked.product_id) + (SELECT count(DISTINCT 1) FROM pains t WHERE t.product_id = ranked.product_id) AS provenance_rows,
      nullif((SELECT count(DISTINCT s) FROM (SELECT source_name AS s FROM products p WHERE p.product_id = ranked.product_id UNION SELECT source_name FROM pains t WHERE t.product_id = ranked.product_id) WHERE s IS NOT NULL), 0) AS sources_rows,
      nullif((SELECT count(*) FROM prices t WHERE t.product_id = ranked.product_id), 0) AS prices_rows, nullif((SELECT count(*) FROM metrics t WHERE t.product_id = ranked.product_id), 0) AS metrics_rows,
      nullif((SELECT count(*) FROM costs t WHERE t.product_id = ranked.product_id), 0) AS costs_rows, nullif((SELECT count(*) FROM pains t WHERE t.product_id = ranked.product_id), 0) AS pain_points_rows
      FROM {_IDS} JOIN ranked USING (product_id)"""),
    "product_detail_histories": with_ctes(" UNION ALL ".join([
        _position("prices", "price", "selling_price"), _position("metrics", "metrics", "review_count"), _position("costs", "cost", "product_cost"),
        f"SELECT product_id, 'pain:' || theme, 0, CAST(mention_count AS DOUBLE), source_name FROM pains WHERE product_id IN (SELECT product_id FROM {_IDS})"])),
    "provenance_list": with_ctes(f"""SELECT u.product_id, u.position, u.field, u.source_name, u.source_url, {iso('u.collected_at')} AS collected_at, u.confidence_score, p.dataset_status FROM (
      SELECT product_id, 1 AS position, 'Product record' AS field, source_name, source_url, collected_at, confidence_score FROM products UNION ALL {_PROVENANCE}
      UNION ALL SELECT product_id, 5, 'Review observations', source_name, source_url, collected_at, NULL FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY type, theme) AS rn FROM pains) WHERE rn=1
      ) u JOIN products p USING (product_id)"""),
    "product_sources": with_ctes("SELECT DISTINCT product_id, source_name FROM (SELECT product_id, source_name FROM products UNION ALL SELECT product_id, source_name FROM pains) WHERE source_name IS NOT NULL"),
    "pain_point_counts": with_ctes("SELECT * FROM pain_counts"),
    "main_pain_points": with_ctes("""SELECT product_id, arg_min(theme, (-mention_count, theme)) FILTER (type='complaint') AS top_complaint,
      min(theme) FILTER (type='opportunity') AS first_opportunity FROM pains GROUP BY product_id"""),
}
