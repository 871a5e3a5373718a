"""Common table expressions shared by the oracle queries."""

from __future__ import annotations

import re

from listwright import binding, config


def r2(x: str) -> str:
    return f"(floor(({x})*100.0+0.5)/100.0)"


def clamp(x: str) -> str:
    return f"least(100.0, greatest(0.0, {x}))"


def num(x: str, digits: int = 10) -> str:
    return rf"regexp_replace(CAST(CAST({x} AS DECIMAL(30,{digits})) AS VARCHAR), '\.?0+$', '')"


def inr(x: str) -> str:
    whole = f"split_part({num(x, 3)}, '.', 1)"
    frac = f"CASE WHEN contains({num(x, 3)}, '.') THEN '.' || split_part({num(x, 3)}, '.', 2) ELSE '' END"
    digits = f"ltrim({whole}, '-')"
    sign = f"CASE WHEN starts_with({whole}, '-') THEN '-' ELSE '' END"
    grouped = (
        f"CASE WHEN length({digits}) <= 3 THEN {digits} "
        f"WHEN length({digits}) <= 5 THEN {digits}[:-4] || ',' || {digits}[-3:] "
        f"WHEN length({digits}) <= 7 THEN {digits}[:-6] || ',' || {digits}[-5:-4] || ',' || {digits}[-3:] "
        f"ELSE {digits}[:-8] || ',' || {digits}[-7:-6] || ',' || {digits}[-5:-4] || ',' || {digits}[-3:] END"
    )
    return f"({sign} || {grouped} || {frac})"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


CFG = config.scoring()
_W = CFG["finalScoreWeights"]

_fee_rows = [
    (f["marketplace"], f["category"], f["feeType"], float(f["value"]), f["source"], f["effectiveDate"])
    for f in config.dimensions()["fees"]
] + binding.EXTRA_FEES
FEES = ", ".join(
    f"({i}, {quote(m)}, {quote(c)}, {quote(t)}, CAST({v} AS DOUBLE), {quote(s)}, DATE {quote(d)})"
    for i, (m, c, t, v, s, d) in enumerate(_fee_rows, 1)
)
MARKETPLACES = ", ".join(f"({quote(m['slug'])}, {quote(m['name'])})" for m in config.dimensions()["marketplaces"])
BASELINES = ", ".join(f"({quote(c)}, CAST({v} AS DOUBLE))" for c, v in CFG["bundleExpansionScore"]["categoryBaselines"].items())
CATEGORIES = ", ".join(quote(c) for c in config.category_slugs())

_COMPONENTS = [
    ("demand", _W["demand"]), ("profitability", _W["profitability"]), ("competition_opportunity", _W["competitionOpportunity"]),
    ("differentiation", _W["differentiation"]), ("shipping_simplicity", _W["shippingSimplicity"]),
    ("customer_pain_opportunity", _W["customerPainOpportunity"]), ("bundle_expansion", _W["bundleExpansion"]),
]
_AVAILABLE = " + ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE CAST({w} AS DOUBLE) END" for c, w in _COMPONENTS)
_TOTAL = " + ".join(f"coalesce({c} * (CAST({w} AS DOUBLE) / available), 0.0)" for c, w in _COMPONENTS)

_SHIP = """CASE WHEN weight_kg IS NULL THEN NULL ELSE 100.0
    - CASE WHEN weight_kg <= 0.5 THEN 0 WHEN weight_kg <= 1 THEN 10 WHEN weight_kg <= 2 THEN 25 WHEN weight_kg <= 5 THEN 45 ELSE 70 END
    - CASE WHEN length_cm IS NULL THEN 0 WHEN length_cm*width_cm*height_cm <= 3000 THEN 0 WHEN length_cm*width_cm*height_cm <= 15000 THEN 10
           WHEN length_cm*width_cm*height_cm <= 50000 THEN 25 ELSE 45 END
    - CASE WHEN fragile THEN 25 ELSE 0 END END"""


def _norm(x: str, low: str, high: str) -> str:
    return f"CASE WHEN {low} IS NULL OR {high} IS NULL OR {low} = {high} THEN 50.0 ELSE {clamp(f'({x} - {low}) / ({high} - {low}) * 100.0')} END"


def _latest(name: str, source: str, columns: str) -> str:
    return f"""SELECT product_id, {columns} FROM (
      SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY collected_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
      FROM {source}) WHERE rn = 1"""


CTES: dict[str, str] = {
    "products": f"""SELECT 'P' || p_partkey AS product_id, p_partkey AS pk, p_name || ' ' || p_partkey AS name, p_brand AS brand,
      'https://shop' || (p_partkey % 7) || '.in/dp/' || p_partkey AS url,
      {binding.MARKETPLACE} AS marketplace,
      CASE WHEN p_partkey % 5 <> 0 THEN 'X' || p_partkey END AS external_id,
      {binding.CATEGORY} AS category,
      CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS DOUBLE) / 10.0 END AS weight_kg,
      CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS length_cm,
      CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 40 + 1 AS DOUBLE) END AS width_cm,
      CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 25 + 1 AS DOUBLE) END AS height_cm,
      CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 8 = 1 END AS fragile,
      CASE p_partkey % 5 WHEN 1 THEN 'none' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' END AS return_risk,
      CASE p_partkey % 6 WHEN 1 THEN 'none' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' END AS regulatory_complexity,
      CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 10 = 3 END AS brand_ip_risk,
      CASE WHEN p_partkey % 12 <> 0 THEN p_partkey % 12 = 5 END AS seasonal_demand,
      CASE WHEN p_partkey % 14 <> 0 THEN p_partkey % 7 = 2 END AS established_brand_dominance,
      CASE WHEN p_partkey % 15 = 0 THEN CAST(p_partkey % 120 AS DOUBLE) END AS bundle_potential_score,
      p_partkey % 4 AS data_source_id,
      {binding.SOURCE} AS source_name,
      CASE WHEN p_partkey % 19 <> 0 THEN 'https://' || CASE WHEN p_partkey % 6 = 1 THEN 'example.com' ELSE 'supplier.in' END || '/q/' || p_partkey END AS source_url,
      CASE WHEN p_partkey % 23 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(p_partkey) END AS collected_at,
      (p_partkey % 11) / 10.0 AS confidence_score,
      CASE p_partkey % 3 WHEN 0 THEN 'SAMPLE' WHEN 1 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS dataset_status,
      p_partkey % 21 = 1 AS has_notes
      FROM part""",
    "obs": f"""SELECT 'P' || l_partkey AS product_id, l_shipdate AS collected_at, {r2('l_extendedprice/l_quantity')} AS selling_price,
      l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_partkey, l_quantity, l_discount,
      CASE l_linenumber % 3 WHEN 0 THEN 'field notes' WHEN 1 THEN 'price desk' ELSE 'supplier visit' END AS source_name,
      'https://supplier.in/o/' || l_orderkey AS source_url, (l_orderkey % 11) / 10.0 AS confidence_score
      FROM lineitem""",
    "prices": f"SELECT *, CASE WHEN l_orderkey % 10 <> 0 THEN {r2('selling_price*(1+l_discount)')} END AS mrp FROM obs",
    "metrics": f"""SELECT *, CASE WHEN l_orderkey % 11 <> 0 THEN CAST(l_quantity AS BIGINT)*37 + l_orderkey % 1000 END AS review_count,
      CASE WHEN l_orderkey % 29 <> 0 THEN {r2('5.0 - 10.0*l_discount')} END AS average_rating,
      CASE WHEN l_orderkey % 13 <> 0 THEN l_suppkey END AS competitor_count,
      CAST(l_linenumber AS BIGINT) AS seller_count, l_orderkey AS best_seller_rank FROM obs""",
    "costs": f"""SELECT *, CASE WHEN l_partkey % 7 <> 0 THEN {r2('selling_price*0.4')} END AS product_cost,
      CASE WHEN l_partkey % 9 <> 4 THEN CAST(30 + l_partkey % 50 AS DOUBLE) END AS shipping_cost,
      CAST(l_partkey % 20 AS DOUBLE) AS packaging_cost,
      CASE WHEN l_partkey % 21 = 0 THEN CAST(55.5 AS DOUBLE) END AS marketplace_fee_override,
      CASE WHEN l_partkey % 22 = 0 THEN CAST(12 AS DOUBLE) END AS payment_fee,
      CAST((l_partkey % 13) * 2.25 AS DOUBLE) AS advertising_cost,
      CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey % 30 AS DOUBLE) END AS return_allowance,
      CASE WHEN l_partkey % 4 <> 0 THEN CAST((l_partkey % 6) * 1.125 AS DOUBLE) END AS other_costs
      FROM obs""",
    "pains": """SELECT 'P' || l_partkey AS product_id, CASE l_returnflag WHEN 'R' THEN 'complaint' WHEN 'A' THEN 'positive' ELSE 'opportunity' END AS type,
      l_returnflag || l_linestatus || l_linenumber AS theme, count(*) AS mention_count,
      any_value(CASE WHEN l_linestatus = 'O' THEN 'field notes' ELSE 'review desk' END) AS source_name,
      'https://reviews.in/' || l_partkey AS source_url, TIMESTAMP '2024-01-01' + to_seconds(l_partkey) AS collected_at
      FROM lineitem GROUP BY l_partkey, l_returnflag, l_linestatus, l_linenumber""",
    "fees": f"SELECT * FROM (VALUES {FEES}) AS t(fee_id, marketplace, category, fee_type, fee_value, source, effective_date)",
    "marketplaces": f"SELECT * FROM (VALUES {MARKETPLACES}) AS t(slug, marketplace_name)",
    "sources": "SELECT * FROM (VALUES (0, 'manual_csv'), (1, 'real_data_import'), (2, 'tracker')) AS t(data_source_id, source)",
    "baselines": f"SELECT * FROM (VALUES {BASELINES}) AS t(category, baseline)",
    "latest_price": _latest("latest_price", "prices", "selling_price, mrp, collected_at AS price_at"),
    "latest_metrics": _latest("latest_metrics", "metrics", "review_count, average_rating, competitor_count, seller_count, best_seller_rank"),
    "latest_cost": _latest("latest_cost", "costs", "product_cost, shipping_cost, packaging_cost, marketplace_fee_override, payment_fee, advertising_cost, return_allowance, other_costs"),
    "pain_counts": """SELECT product_id, count(*) AS pain_rows, count(*) FILTER (type='complaint') AS complaint_count,
      count(*) FILTER (type='opportunity') AS opportunity_count FROM pains GROUP BY product_id""",
    "signals": """SELECT * FROM products LEFT JOIN latest_price USING (product_id) LEFT JOIN latest_metrics USING (product_id)
      LEFT JOIN latest_cost USING (product_id) LEFT JOIN pain_counts USING (product_id)""",
    "applied_fees": f"""SELECT product_id, fee_type, fee_category, fee_value, fee_source, effective_date,
      {r2("CASE WHEN fee_type LIKE '%percentage' THEN selling_price*fee_value/100.0 ELSE fee_value END")} AS amount FROM (
      SELECT s.product_id, s.selling_price, f.fee_type, f.category AS fee_category, f.fee_value, f.source AS fee_source, f.effective_date,
        row_number() OVER (PARTITION BY s.product_id, f.fee_type ORDER BY f.category = 'default', f.effective_date DESC, f.fee_id) AS rn
      FROM signals s JOIN fees f ON f.marketplace = s.marketplace AND f.category IN (s.category, 'default') AND f.effective_date <= DATE '{binding.AS_OF}'
      WHERE s.selling_price IS NOT NULL) WHERE rn = 1""",
    "fee_sums": f"""SELECT product_id, count(*) AS n_fees,
      {r2("sum(amount) FILTER (fee_type <> 'payment_gateway_percentage')")} AS selling_fees,
      {r2("sum(amount) FILTER (fee_type = 'payment_gateway_percentage')")} AS gateway_fees FROM applied_fees GROUP BY product_id""",
    "costed": """SELECT * EXCLUDE (payment_fee), coalesce(marketplace_fee_override, selling_fees) AS marketplace_fee, coalesce(payment_fee, gateway_fees) AS payment_fee
      FROM signals LEFT JOIN fee_sums USING (product_id)""",
    "econ0": f"""SELECT *, selling_price > 0 AS sold,
      {r2('+'.join(r2(f'coalesce({c}, 0.0)') for c in ['product_cost', 'shipping_cost', 'packaging_cost', 'marketplace_fee', 'payment_fee', 'advertising_cost', 'return_allowance', 'other_costs']))} AS total_cost,
      {r2('+'.join(r2(f'coalesce({c}, 0.0)') for c in ['product_cost', 'shipping_cost', 'packaging_cost']))} AS landed_cost FROM costed""",
    "econ": f"""SELECT * EXCLUDE (margin0), margin0 AS margin_pct, CASE WHEN landed_cost > 0 THEN {r2('profit/landed_cost*100.0')} END AS roi_pct,
      sold AND product_cost IS NOT NULL AS is_reliable FROM (
      SELECT *, {r2('profit/selling_price*100.0')} AS margin0 FROM (SELECT *, {r2('selling_price - total_cost')} AS profit FROM econ0))""",
    "cohort_own": """SELECT category, count(*) AS n, ln(min(review_count)+1) AS lr_min, ln(max(review_count)+1) AS lr_max,
      min(competitor_count) AS c_min, max(competitor_count) AS c_max FROM signals GROUP BY category""",
    "cohorts": """SELECT o.category, CASE WHEN o.n>=3 THEN o.n ELSE a.n END AS cohort_size,
      CASE WHEN o.n>=3 THEN o.lr_min ELSE a.lr_min END AS lr_min, CASE WHEN o.n>=3 THEN o.lr_max ELSE a.lr_max END AS lr_max,
      CASE WHEN o.n>=3 THEN o.c_min ELSE a.c_min END AS c_min, CASE WHEN o.n>=3 THEN o.c_max ELSE a.c_max END AS c_max,
      CASE WHEN o.n>=3 THEN 'category:' || o.category ELSE 'all products (category cohort too small)' END AS cohort_label
      FROM cohort_own o, (SELECT count(*) AS n, ln(min(review_count)+1) AS lr_min, ln(max(review_count)+1) AS lr_max,
        min(competitor_count) AS c_min, max(competitor_count) AS c_max FROM signals) a""",
    "subs": f"""SELECT e.*, cohort_size, cohort_label,
      CASE WHEN review_count IS NOT NULL AND average_rating IS NOT NULL THEN {r2(f"({_norm('ln(review_count+1)', 'lr_min', 'lr_max')})*0.7 + {clamp('average_rating/5.0*100.0')}*0.3")} END AS demand,
      CASE WHEN is_reliable THEN {r2(clamp('margin_pct/50.0*100.0'))} END AS profitability,
      CASE WHEN competitor_count IS NOT NULL THEN {r2(clamp(f"100.0 - ({_norm('CAST(competitor_count AS DOUBLE)', 'c_min', 'c_max')}) - CASE WHEN established_brand_dominance THEN 20.0 ELSE 0.0 END"))} END AS competition_opportunity,
      CASE WHEN pain_rows > 0 THEN {r2(clamp('opportunity_count*20.0'))} END AS differentiation,
      CASE WHEN weight_kg IS NOT NULL THEN {r2(clamp(_SHIP))} END AS shipping_simplicity,
      CASE WHEN pain_rows > 0 THEN {r2(clamp('complaint_count*15.0'))} END AS customer_pain_opportunity,
      CASE WHEN coalesce(bundle_potential_score, baseline) IS NOT NULL THEN {r2(clamp('coalesce(bundle_potential_score, baseline)'))} END AS bundle_expansion
      FROM econ e JOIN cohorts c USING (category) LEFT JOIN baselines b USING (category)""",
    "gated": f"""SELECT *, {_AVAILABLE} AS available, list_filter([CASE WHEN selling_price IS NULL THEN 'selling_price' END, CASE WHEN product_cost IS NULL THEN 'product_cost' END,
      CASE WHEN review_count IS NULL OR average_rating IS NULL THEN 'demand_signal' END, CASE WHEN competitor_count IS NULL THEN 'competition_signal' END,
      CASE WHEN source_name IS NULL OR source_url IS NULL THEN 'source' END, CASE WHEN collected_at IS NULL THEN 'collected_at' END], lambda x: x IS NOT NULL) AS missing
      FROM subs""",
    "finals": f"""SELECT *, CASE WHEN len(missing)=0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS score_status,
      CASE WHEN len(missing)=0 AND available>0 THEN {r2(clamp(_TOTAL))} END AS final_score, {r2('available')} AS data_completeness FROM gated""",
    "risks": f"""SELECT *, least(100.0, CASE WHEN fragile THEN 20.0 ELSE 0.0 END + CASE WHEN shipping_simplicity < 50 THEN 15.0 ELSE 0.0 END
      + CASE WHEN is_reliable AND margin_pct < 10 THEN 20.0 ELSE 0.0 END + CASE WHEN competition_opportunity < 40 THEN 20.0 ELSE 0.0 END
      + CASE WHEN established_brand_dominance THEN 15.0 ELSE 0.0 END
      + CASE return_risk WHEN 'medium' THEN 10.0 WHEN 'high' THEN 25.0 ELSE 0.0 END
      + CASE regulatory_complexity WHEN 'low' THEN 5.0 WHEN 'medium' THEN 15.0 WHEN 'high' THEN 30.0 ELSE 0.0 END
      + CASE WHEN brand_ip_risk THEN 25.0 ELSE 0.0 END + CASE WHEN seasonal_demand THEN 10.0 ELSE 0.0 END) AS risk_score,
      list_filter([CASE WHEN fragile THEN 'Fragile product' END, CASE WHEN shipping_simplicity < 50 THEN 'Heavy or bulky to ship' END,
        CASE WHEN is_reliable AND margin_pct < 10 THEN 'Low margin (' || {num('margin_pct', 2)} || '% < 10%)' END,
        CASE WHEN competition_opportunity < 40 THEN 'High competition' END, CASE WHEN established_brand_dominance THEN 'Strong established brands' END,
        CASE WHEN return_risk IN ('medium','high') THEN return_risk || ' return risk' END,
        CASE WHEN regulatory_complexity IN ('low','medium','high') THEN regulatory_complexity || ' regulatory complexity' END,
        CASE WHEN brand_ip_risk THEN 'Brand/IP risk' END, CASE WHEN seasonal_demand THEN 'Seasonal demand' END,
        CASE WHEN NOT coalesce(is_reliable, false) THEN 'Quality uncertainty: no verified cost data' END], lambda x: x IS NOT NULL) AS reasons FROM finals""",
    "scored": """SELECT *, CASE WHEN final_score IS NULL THEN NULL WHEN risk_score>=70 THEN 'C' WHEN final_score>=70 AND risk_score<=40 THEN 'A'
      WHEN final_score>=50 THEN 'B' ELSE 'C' END AS classification FROM risks""",
    "ranked": f"""SELECT s.*, marketplace AS slug, marketplace_name, CASE WHEN sold THEN {r2('selling_price')} END AS stored_price,
      CASE WHEN sold THEN landed_cost END AS stored_landed, CASE WHEN is_reliable THEN profit END AS stored_profit,
      CASE WHEN is_reliable THEN margin_pct END AS stored_margin, CASE WHEN is_reliable THEN roi_pct END AS stored_roi,
      coalesce(source_name, source, 'unknown') AS shown_source
      FROM scored s LEFT JOIN marketplaces m ON m.slug = s.marketplace LEFT JOIN sources d USING (data_source_id)""",
}


def with_ctes(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` preceded by the expressions it needs, in order."""
    pool = {**CTES, **(extra or {})}
    needed: set[str] = set()
    queue = [body]
    while queue:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", queue.pop()))
        for name in words & pool.keys() - needed:
            needed.add(name)
            queue.append(pool[name])
    used = [f"{name} AS ({pool[name]})" for name in pool if name in needed]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(used) + "\n" if used else "") + body
