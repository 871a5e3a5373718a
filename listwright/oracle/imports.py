"""Oracle SQL for the import queries."""

from __future__ import annotations

from listwright import binding, binding_raw, config
from listwright.fixed import AUTOMATED_SOURCE_NAMES, NON_ATTRIBUTABLE_NAMES, OPTIONAL_FIELDS, REQUIRED_FIELDS, NUMERIC_FIELDS
from listwright.fixed import LOOPBACK_HOSTS, PLACEHOLDER_HOST_TOKENS, PLACEHOLDER_PATH_SEGMENTS, PLACEHOLDER_TLDS
from listwright.oracle.scoring import _DISCLAIMER
from listwright.oracle.base import CATEGORIES, iso, num, quote, with_ctes

_NULLS = "('', '-', 'n/a', 'na', 'null', 'none', 'unknown')"
_NOW = f"TIMESTAMP '{binding_raw.NOW}'"
_LIST = lambda words: "[" + ", ".join(quote(w) for w in words) + "]"


def cell(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN {_NULLS} THEN NULL ELSE trim({c}) END"


def number(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(({cell(c)}), '[₹,\s]', '', 'g'), '(?i)^Rs\.?', '')"
    return rf"TRY_CAST(nullif(regexp_extract({bare}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?', 0), '') AS DOUBLE)"


def integer(c: str) -> str:
    return f"CAST(floor(({number(c)}) + 0.5) AS BIGINT)"


def flag(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('true','yes','y','1') THEN true WHEN lower(trim({c})) IN ('false','no','n','0') THEN false END"


def risk(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('low','medium','high') THEN lower(trim({c})) END"


def plist(c: str) -> str:
    return f"list_filter(list_transform(string_split(({cell(c)}), '|'), lambda x: trim(x)), lambda x: x <> '')"


def display(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def match_name(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def canonical(u: str) -> str:
    web = r"'^(?i)(https?|ftp)://([^/?#@]*@)?([^\s/?#:@]+)(:\d+)?(/[^?#]*)?([?#].*)?$'"
    part = lambda i: f"regexp_extract({u}, {web}, {i})"
    return rf"CASE WHEN regexp_matches({u}, {web}) THEN lower({part(1)}) || '://' || regexp_replace(lower({part(3)}), '^www\.', '') || rtrim({part(5)}, '/') ELSE {u} END"


def reasons(u: str) -> str:
    """Reasons for a canonical or raw URL; the inputs here hold no user info with '@' in the path."""
    web = r"'^(?i)(https?|ftp)://([^/?#@]*@)?([^\s/?#:@]+)(:\d+)?(/[^?#]*)?([?#].*)?$'"
    host = f"lower(regexp_extract({u}, {web}, 3))"
    scheme = f"lower(regexp_extract({u}, {web}, 1))"
    path = f"regexp_extract({u}, {web}, 5)"
    tld = f"regexp_extract({host}, '[^.]*$')"
    return f"""CASE WHEN {u} IS NULL OR trim({u}) = '' THEN ['no URL supplied']
      WHEN NOT regexp_matches({u}, {web}) THEN ['''' || {u} || ''' is not a parseable URL']
      ELSE list_concat(
        CASE WHEN {scheme} NOT IN ('http','https') THEN ['protocol ''' || {scheme} || ':'' is not http(s)'] ELSE [] END,
        CASE WHEN list_contains({_LIST(LOOPBACK_HOSTS)}, {host}) THEN ['''' || {host} || ''' is a loopback address, not a public listing'] ELSE [] END,
        CASE WHEN list_contains({_LIST(PLACEHOLDER_TLDS)}, {tld}) THEN ['''.' || {tld} || ''' is a reserved/non-public TLD'] ELSE [] END,
        list_transform(list_filter(string_split_regex({host}, '[.-]'), lambda t: list_contains({_LIST(PLACEHOLDER_HOST_TOKENS)}, t)),
          lambda t: 'hostname ''' || {host} || ''' contains placeholder token ''' || t || ''''),
        list_transform(list_filter(string_split({path}, '/'), lambda s: list_contains({_LIST(PLACEHOLDER_PATH_SEGMENTS)}, lower(s))),
          lambda s: 'URL path contains placeholder segment ''/' || s || '/''')) END"""


def unattributed(n: str) -> str:
    import re

    tokens = "|".join(re.sub("[^a-z0-9]", "[^a-z0-9]", w) for w in NON_ATTRIBUTABLE_NAMES)
    return f"coalesce(trim({n}) = '' OR regexp_matches(lower(trim({n})), '(^|[^a-z])({tokens})([^a-z]|$)'), true)"


def errors(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in pairs) + "], lambda x: x IS NOT NULL)"


def text(ts: str) -> str:
    return f"array_to_string({ts}, '; ')"


def pains(c: str, kind: str) -> str:
    count = integer("string_split(x, ':')[2]")
    return f"list_transform({plist(c)}, lambda x: {{'type': '{kind}', 'theme': trim(string_split(x, ':')[1]), 'n': {count}}})"


_ALL_PAINS = lambda: f"list_concat(coalesce({pains('complaints', 'complaint')}, []), coalesce({pains('positives', 'positive')}, []), coalesce({pains('opportunities', 'opportunity')}, []))"
_TS = lambda c: f"CASE WHEN trim({c}) LIKE '%+05:30' THEN TRY_CAST(replace(trim({c}), '+05:30', '') AS TIMESTAMP) - INTERVAL 330 MINUTES ELSE TRY_CAST(({cell(c)}) AS TIMESTAMP) END"
_DISCOUNT = "CASE WHEN mrp > 0 AND selling_price <= mrp THEN floor((mrp-selling_price)/mrp*10000.0+0.5)/100.0 END"
_COSTS = ("product_cost", "shipping_cost")
_RESEARCH_MISSING = {f: "CAST(NULL AS VARCHAR)" for f in REQUIRED_FIELDS + OPTIONAL_FIELDS if f not in binding_raw.RESEARCH}

EXTRA = {
    "raw_l": binding_raw.sql(binding_raw.LISTING),
    "raw_r": binding_raw.sql({**binding_raw.RESEARCH, **_RESEARCH_MISSING}),
    "l0": f"""SELECT record_no, {cell('name')} AS raw_name, {cell('url')} AS raw_url, {number('selling_price')} AS selling_price, selling_price AS raw_price,
      lower(coalesce({cell('marketplace')}, '')) AS marketplace, {cell('external_id')} AS external_id, {cell('brand')} AS brand, lower(coalesce({cell('category')}, '')) AS category,
      {plist('features')} AS features, {number('weight_kg')} AS weight_kg, {number('length_cm')} AS l_cm, {number('width_cm')} AS w_cm, {number('height_cm')} AS h_cm,
      {number('mrp')} AS mrp, upper(coalesce({cell('currency')}, 'INR')) AS currency, {integer('review_count')} AS review_count, {number('average_rating')} AS average_rating,
      {integer('competitor_count')} AS competitor_count, {number('product_cost')} AS product_cost, {number('shipping_cost')} AS shipping_cost,
      coalesce({cell('cost_source')}, 'manual entry') AS cost_source, {cell('cost_source_url')} AS cost_source_url, {flag('fragile')} AS fragile,
      CASE WHEN lower(trim(return_risk)) IN ('low','medium','high') THEN lower(trim(return_risk)) END AS return_risk, {_ALL_PAINS()} AS pain_list,
      coalesce({cell('source_name')}, 'manual_csv') AS source_name, {cell('source_url')} AS own_source_url, {_TS('collected_at')} AS seen, {number('confidence_score')} AS confidence_score,
      CASE WHEN upper(trim(dataset_status)) IN ('SAMPLE','UNVERIFIED','VERIFIED') THEN upper(trim(dataset_status)) WHEN lower(trim(is_sample_data)) = 'true' THEN 'SAMPLE' ELSE 'UNVERIFIED' END AS dataset_status
      FROM raw_l""",
    "l_all": f"""SELECT *, {display('raw_name')} AS name, {match_name('raw_name')} AS normalized_name, {canonical('raw_url')} AS url, coalesce(own_source_url, raw_url) AS source_url,
      coalesce(seen, {_NOW}) AS collected_at, {_DISCOUNT} AS discount, product_cost IS NOT NULL OR shipping_cost IS NOT NULL AS has_costs, l_cm IS NOT NULL AND w_cm IS NOT NULL AND h_cm IS NOT NULL AS has_dims,
      CASE WHEN raw_name IS NULL THEN 'name is empty' WHEN raw_url IS NULL THEN 'url is empty' WHEN selling_price IS NULL THEN 'selling_price ''' || raw_price || ''' is not a number' END AS malformed FROM l0""",
    "l": "SELECT * FROM l_all WHERE malformed IS NULL",
    "r0": f"""SELECT record_no, {cell('product_name')} AS raw_name, {cell('product_url')} AS raw_url, {number('observed_price')} AS selling_price, {cell('observed_price')} AS raw_price,
      lower(coalesce({cell('marketplace')}, {cell('source')}, '')) AS marketplace, {cell('product_id')} AS external_id, {cell('brand')} AS brand, lower(coalesce({cell('category')}, '')) AS category,
      {number('product_weight')} AS weight_kg, product_dimensions, {number('mrp')} AS mrp, upper(coalesce({cell('currency')}, 'INR')) AS currency,
      CASE WHEN ({cell('review_count')}) IS NOT NULL THEN {integer('review_count')} ELSE {integer('demand_signal')} END AS review_count, {number('rating')} AS average_rating,
      {integer('competition_signal')} AS competitor_count, {number('supplier_cost')} AS product_cost, {number('shipping_cost')} AS shipping_cost,
      {cell('cost_source_name')} AS cost_source0, {cell('cost_source_url')} AS cost_source_url, {flag('fragile')} AS fragile, CAST(NULL AS VARCHAR) AS return_risk, {_ALL_PAINS()} AS pain_list,
      coalesce({cell('source_name')}, '') AS source_name, coalesce({cell('source_url')}, '') AS source_url, {_TS('observed_at')} AS collected_at, {cell('observed_at')} AS raw_at,
      {number('confidence_score')} AS confidence_score, 'UNVERIFIED' AS dataset_status, upper(coalesce({cell('dataset_status')}, '')) AS declared, {flag('verification_requested')} AS asked
      FROM raw_r""",
    "r_all": rf"""SELECT *, coalesce({display('raw_name')}, '') AS name, coalesce({match_name('raw_name')}, '') AS normalized_name, coalesce({canonical('raw_url')}, '') AS url, {_DISCOUNT} AS discount,
      coalesce(cost_source0, source_name) AS cost_source, product_cost IS NOT NULL OR shipping_cost IS NOT NULL AS has_costs, CAST(NULL AS VARCHAR[]) AS features,
      list_filter(list_transform(string_split_regex(regexp_replace(lower(product_dimensions), 'cm|mm|in|inches', '', 'g'), '[x×*]'),
        lambda p: TRY_CAST(nullif(regexp_extract(trim(p), '^\d+\.?\d*', 0), '') AS DOUBLE)), lambda v: v > 0) AS sides,
      coalesce(asked, false) OR declared = 'VERIFIED' AS verification_requested,
      CASE WHEN raw_price IS NOT NULL AND selling_price IS NULL THEN 'observed_price ''' || raw_price || ''' is not a number'
        WHEN raw_at IS NOT NULL AND collected_at IS NULL THEN 'observed_at ''' || raw_at || ''' is not a parseable timestamp' END AS malformed FROM r0""",
    "r": "SELECT *, CASE WHEN len(sides) = 3 THEN sides[1] END AS l_cm, CASE WHEN len(sides) = 3 THEN sides[3] END AS h_cm, len(sides) = 3 AS has_dims FROM r_all WHERE malformed IS NULL",
}
EXTRA["l_checked"] = f"""SELECT *, {errors(
    ("length(name) < 3", "'name is required (min 3 characters)'"),
    (r"NOT regexp_matches(url, '(?i)^https?://[^\s/$.?#].[^\s]*$')", "'url is not a valid http(s) URL: ''' || url || ''''"),
    ("marketplace = ''", "'marketplace is required'"), ("category = ''", "'category is required'"),
    (f"category <> '' AND category NOT IN ({CATEGORIES})", "'category ''' || category || ''' is not in config/categories.json — add it there first'"),
    ("selling_price <= 0", "'selling_price must be greater than zero'"), ("currency <> 'INR'", "'currency must be INR for this system, got ''' || currency || ''''"),
    (r"NOT regexp_matches(source_url, '(?i)^https?://[^\s/$.?#].[^\s]*$')", "'source_url is required and must be a valid http(s) URL'"),
    (f"collected_at > {_NOW} + INTERVAL 24 HOURS", "'collected_at is in the future'"),
    ("average_rating < 0 OR average_rating > 5", f"'average_rating must be between 0 and 5, got ' || {num('average_rating')}"),
    ("review_count < 0", "'review_count cannot be negative'"), ("weight_kg <= 0", "'weight_kg must be greater than zero when supplied'"),
    ("confidence_score < 0 OR confidence_score > 1", "'confidence_score must be between 0 and 1'"),
    (r"len(pain_list) > 0 AND NOT regexp_matches(source_url, '(?i)^https?://[^\s/$.?#].[^\s]*$')", "'pain point ''' || pain_list[1].theme || ''' has no valid source URL — review observations must be traceable'"),
)} AS errors, {errors(
    ("selling_price > mrp", f"'selling_price (' || {num('selling_price')} || ') exceeds MRP (' || {num('mrp')} || ') — verify the listing'"),
    ("product_cost IS NULL", "'No supplier/product cost supplied — profitability will be reported as unavailable'"),
    ("review_count IS NULL OR average_rating IS NULL", "'Missing review count or rating — demand score will be reported as unavailable'"),
    ("competitor_count IS NULL", "'No competing-listing count — competition score and Final Score will be withheld'"),
    ("dataset_status = 'VERIFIED' AND confidence_score < 0.8", f"'Marked VERIFIED but confidence is only ' || {num('confidence_score')} || ' — confirm this is intentional'"),
)} AS warnings FROM l"""
_MISSING = errors(*[(c, f"'{f} is required for a real record'") for f, c in [
    ("product_name", "name = ''"), ("marketplace", "marketplace = ''"), ("product_url", "url = ''"), ("observed_price", "selling_price IS NULL"),
    ("observed_at", "collected_at IS NULL"), ("source_url", "source_url = ''"), ("source_name", "source_name = ''")]])
_INVALID = errors(
    ("selling_price <= 0", f"'observed_price must be greater than zero, got ' || {num('selling_price')}"),
    ("currency <> 'INR'", "'currency must be INR for this system, got ''' || currency || ''''"), (f"collected_at > {_NOW} + INTERVAL 24 HOURS", "'observed_at is in the future'"),
    ("average_rating < 0 OR average_rating > 5", f"'rating must be between 0 and 5, got ' || {num('average_rating')}"), ("review_count < 0", "'review_count cannot be negative'"),
    ("weight_kg <= 0", "'product_weight must be greater than zero when supplied'"), ("confidence_score < 0 OR confidence_score > 1", "'confidence_score must be between 0 and 1'"))
EXTRA["r_judged"] = f"""SELECT *, {reasons('url')} AS u_reasons, {reasons('source_url')} AS s_reasons, {_MISSING} AS e_missing, {_INVALID} AS e_invalid FROM r"""
EXTRA["r_checked"] = f"""SELECT *, CASE WHEN source_name = 'demo_data' THEN 'SEED_DATA_SOURCE' WHEN declared = 'SAMPLE' THEN 'SAMPLE_STATUS_NOT_ALLOWED' WHEN len(e_missing) > 0 THEN 'MISSING_REQUIRED_FIELD'
    WHEN len(u_reasons) + len(s_reasons) > 0 THEN 'PLACEHOLDER_URL' WHEN {unattributed('source_name')} THEN 'SEED_DATA_SOURCE' WHEN len(e_invalid) > 0 THEN 'INVALID_VALUE'
    WHEN category NOT IN ({CATEGORIES}) THEN 'UNKNOWN_CATEGORY' END AS code,
  CASE WHEN source_name = 'demo_data' THEN 'source_name ''demo_data'' identifies seed/demo data, which cannot be imported as real data'
    WHEN declared = 'SAMPLE' THEN 'dataset_status SAMPLE is reserved for seed data and cannot be submitted through the real-data pipeline' WHEN len(e_missing) > 0 THEN {text('e_missing')}
    WHEN len(u_reasons) + len(s_reasons) > 0 THEN concat_ws('; ', CASE WHEN len(u_reasons) > 0 THEN 'product_url is a placeholder/example URL: ' || {text('u_reasons')} END,
      CASE WHEN len(s_reasons) > 0 THEN 'source_url is a placeholder/example URL: ' || {text('s_reasons')} END)
    WHEN {unattributed('source_name')} THEN 'source_name ''' || source_name || ''' does not attribute the record to a real, traceable origin' WHEN len(e_invalid) > 0 THEN {text('e_invalid')}
    WHEN category = '' THEN 'category is required so the product can be scored against a peer cohort'
    WHEN category NOT IN ({CATEGORIES}) THEN 'category ''' || category || ''' is not in config/categories.json — add it there first' END AS errors,
  {errors(
    ("product_cost IS NULL", "'No supplier_cost supplied — profitability and the Final Score will be withheld'"),
    ("review_count IS NULL OR average_rating IS NULL", "'Missing rating or review_count — demand signal incomplete, Final Score will be withheld'"),
    ("competitor_count IS NULL", "'No competition_signal supplied — Final Score will be withheld'"),
    ("selling_price > mrp", f"'observed_price (' || {num('selling_price')} || ') exceeds MRP (' || {num('mrp')} || ') — verify the listing'"),
    ("verification_requested", "'VERIFIED was requested; it is granted only if the record passes the verification gate'"),
    ("contains(product_dimensions, 'mm')", "'product_dimensions names a unit other than cm; the numbers are taken as centimetres'"),
  )} AS warnings FROM r_judged"""


def gate(source: str, claim: str) -> str:
    why = errors(
        (f"list_contains({_LIST(AUTOMATED_SOURCE_NAMES)}, lower(trim(source_name)))",
         "'source ''' || source_name || ''' is an automated collector — data arriving from it is not human-verified. VERIFIED requires a person to confirm the listing and a supplier quote.'"),
        ("len(s_reasons) > 0", f"'source_url is not a real traceable URL: ' || {text('s_reasons')}"),
        ("len(u_reasons) > 0", f"'product url is not a real traceable URL: ' || {text('u_reasons')}"),
        (unattributed("source_name"), "'source_name ''' || source_name || ''' does not attribute the record to a real, traceable origin (an adapter name or a demo/sample placeholder is not an attribution)'"),
        ("brand IS NULL AND weight_kg IS NULL AND NOT has_dims AND features IS NULL", "'no actual product information on record (needs at least one of: brand, description, weight, dimensions, features)'"),
        ("selling_price <= 0", "'no actual observed selling price'"),
        (f"product_cost IS NOT NULL AND {unattributed('cost_source')}", "'a product cost is claimed but its cost_source ''' || cost_source || ''' is not a real attributable supplier/quote'"),
        ("product_cost IS NOT NULL AND contains(cost_source_url, 'demo-store')", "'cost_source_url is a placeholder URL'"),
        ("review_count IS NULL OR average_rating IS NULL", "'demand metrics (review count and average rating) are not both present'"),
        ("competitor_count IS NULL", "'competition metric (count of comparable listings) is missing'"),
    )
    return f"""SELECT * EXCLUDE (dataset_status, why), claim = 'VERIFIED' AND len(why) > 0 AS downgraded, CASE WHEN claim = 'VERIFIED' AND len(why) > 0 THEN array_to_string(why, ' # ') END AS notes,
      CASE WHEN claim = 'SAMPLE' THEN 'SAMPLE' WHEN claim = 'VERIFIED' AND len(why) = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS dataset_status
      FROM (SELECT *, {claim} AS claim, {why} AS why FROM (SELECT *, {reasons('url')} AS u_reasons, {reasons('source_url')} AS s_reasons FROM {source}))"""


_KEYS = """CASE WHEN external_id IS NOT NULL THEN marketplace || '::id::' || external_id ELSE marketplace || '::url::' || url END AS identity_key,
  marketplace || '::name::' || normalized_name AS name_key"""
_SLUGS = "SELECT slug FROM marketplaces"


def walk(source: str) -> str:
    """Sequential dedupe of ``source`` (record_no, identity_key, name_key) as a recursion over the kept keys."""
    return f"""SELECT * FROM (
      WITH RECURSIVE seq AS MATERIALIZED (SELECT record_no, hash(identity_key) AS identity_key, hash(name_key) AS name_key, row_number() OVER (ORDER BY record_no) AS n FROM {source}),
      go AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS UBIGINT[]) AS keys, CAST(NULL AS BIGINT) AS record_no, false AS kept
        UNION ALL
        SELECT s.n, CASE WHEN list_contains(g.keys, s.identity_key) OR list_contains(g.keys, s.name_key) THEN g.keys ELSE list_concat(g.keys, [s.identity_key, s.name_key]) END,
          s.record_no, NOT (list_contains(g.keys, s.identity_key) OR list_contains(g.keys, s.name_key))
        FROM go g JOIN seq s ON s.n = g.n + 1)
      SELECT record_no, kept FROM go WHERE n > 0)"""


def matched(source: str, stored: str) -> str:
    best = lambda key: f"(SELECT marketplace, {key}, min(product_id) AS id FROM {stored} WHERE {key} <> '' GROUP BY ALL)"
    return f"""SELECT b.*, coalesce(e.id, u.id, n.id) AS existing_id, u.id AS url_id FROM {source} b
      LEFT JOIN {best('external_id')} e ON e.marketplace = b.marketplace AND e.external_id = b.external_id
      LEFT JOIN {best('url')} u ON u.marketplace = b.marketplace AND u.url = b.url
      LEFT JOIN {best('normalized_name')} n ON n.marketplace = b.marketplace AND n.normalized_name = b.normalized_name"""


def resolved(source: str) -> str:
    return f"""SELECT * EXCLUDE (head_id, head_no, head_existing), coalesce(existing_id, head_id) AS product_id,
      existing_id IS NULL AND head_existing IS NULL AND head_no = record_no AS is_new,
      coalesce(url_id <> coalesce(existing_id, head_id), false) OR head_id <> coalesce(existing_id, head_id) AS conflict FROM (
      SELECT *, first_value(coalesce(existing_id, sha256(identity_key))) OVER w AS head_id, first_value(record_no) OVER w AS head_no, first_value(existing_id) OVER w AS head_existing
      FROM {source} WINDOW w AS (PARTITION BY marketplace, url ORDER BY record_no))"""


EXTRA.update({
    "stored_products": binding_raw.stored_sql(),
    "stored_real": "SELECT * FROM stored_products WHERE dataset_status <> 'SAMPLE'",
    "l_keyed": f"SELECT *, {_KEYS} FROM l",
    "l_ok": f"SELECT *, {_KEYS} FROM l_checked WHERE len(errors) = 0",
    "l_placed": f"SELECT * FROM l_ok WHERE marketplace IN ({_SLUGS})",
    "l_walk": walk("l_placed"),
    "l_kept": "SELECT l_placed.* FROM l_placed JOIN l_walk USING (record_no) WHERE kept",
    "l_gated": gate("l_kept", "dataset_status"),
    "l_matched": matched("l_gated", "stored_products"),
    "l_linked": resolved("l_matched"),
    "l_resolved": "SELECT * FROM l_linked WHERE NOT conflict",
    "r_ok": f"SELECT * EXCLUDE (u_reasons, s_reasons), {_KEYS} FROM r_checked WHERE code IS NULL",
    "r_placed": f"SELECT * FROM r_ok WHERE marketplace IN ({_SLUGS})",
    "r_walk": walk("r_placed"),
    "r_kept": "SELECT r_placed.* FROM r_placed JOIN r_walk USING (record_no) WHERE kept",
    "r_gated": gate("r_kept", "CASE WHEN verification_requested THEN 'VERIFIED' ELSE 'UNVERIFIED' END"),
    "r_matched": matched("r_gated", "stored_real"),
    "r_linked": resolved("r_matched"),
    "r_resolved": "SELECT * FROM r_linked WHERE NOT conflict",
    "l_last": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY record_no DESC) AS rn FROM l_resolved) WHERE rn = 1",
    "l_pain_last": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY record_no DESC) AS rn FROM l_resolved WHERE len(pain_list) > 0) WHERE rn = 1",
})


def q(body: str) -> str:
    return with_ctes(body, EXTRA, recursive=False)


def _standardized(t: str) -> str:
    return q(f"""SELECT record_no, name, normalized_name, url, marketplace, external_id, brand, category, array_to_string(features, '|') AS features, weight_kg,
      CASE WHEN has_dims THEN l_cm END AS length_cm, CASE WHEN has_dims THEN h_cm END AS height_cm, selling_price, mrp, discount AS discount_percentage, currency, review_count, average_rating,
      competitor_count, product_cost, CASE WHEN has_costs THEN cost_source END AS cost_source_name, fragile, return_risk,
      array_to_string(list_transform(pain_list, lambda p: concat_ws(':', p.type, p.theme, CAST(p.n AS VARCHAR))), '|') AS pain_points, source_name, source_url,
      {iso('collected_at')} AS collected_at, confidence_score, dataset_status FROM {t}""")


_VARIANTS = r"""SELECT page_id, v.variant AS variant, v.url AS url FROM (SELECT page_id, unnest([
  {'variant': 'as is', 'url': url}, {'variant': 'shop', 'url': replace(url, 'example', 'shop')},
  {'variant': 'port', 'url': regexp_replace(url, '^(https?)://([^/?#]+)', '\1://me:pw@WWW.\2:8080')},
  {'variant': 'loopback', 'url': regexp_replace(url, '://[^/?#]+', '://127.0.0.1/Demo')},
  {'variant': 'tld', 'url': regexp_replace(url, 'example\.\w+', 'foo-store.test')},
  {'variant': 'ftp', 'url': regexp_replace(url, '^https?', 'ftp')}, {'variant': 'broken', 'url': regexp_replace(url, '^https?://', '')}]) AS v FROM pages)"""
EXTRA["urls"] = _VARIANTS
_LEDGER = " UNION ALL ".join(
    f"SELECT 'P' || record_no AS product_id, '{f}' AS field_name, {cell(f)} AS raw_value, {number(f) if f in NUMERIC_FIELDS else 'CAST(NULL AS DOUBLE)'} AS numeric_value, record_no FROM raw_r"
    for f in REQUIRED_FIELDS + OPTIONAL_FIELDS if f in binding_raw.RESEARCH
)
_ROWS = lambda *pairs: " UNION ALL ".join(f"SELECT '{n}' AS measure, (SELECT count(*) FROM {f}) AS n" for n, f in pairs)
_R_REJECTED = "(SELECT record_no FROM r_all WHERE malformed IS NOT NULL UNION ALL SELECT record_no FROM r_checked WHERE code IS NOT NULL UNION ALL SELECT record_no FROM r_ok WHERE marketplace NOT IN (SELECT slug FROM marketplaces) UNION ALL SELECT record_no FROM r_walk WHERE NOT kept UNION ALL SELECT record_no FROM r_linked WHERE conflict)"
_L_REJECTED = "(SELECT record_no FROM l_all WHERE malformed IS NOT NULL UNION ALL SELECT record_no FROM l_checked WHERE len(errors) > 0 UNION ALL SELECT record_no FROM l_ok WHERE marketplace NOT IN (SELECT slug FROM marketplaces) UNION ALL SELECT record_no FROM l_linked WHERE conflict)"
_CRITICAL = errors(("product_cost IS NULL", "'supplier_cost'"), ("review_count IS NULL OR average_rating IS NULL", "'demand_signal (rating + review_count)'"), ("competitor_count IS NULL", "'competition_signal'"))
_SEED_KEY = f"CASE WHEN p_partkey % 9 = 0 THEN 'ebay' ELSE {binding.MARKETPLACE} END"

SQL = {
    "standardize_listings": _standardized("l"),
    "standardize_research": _standardized("r"),
    "malformed_rows": q("""SELECT record_no, coalesce(raw_name, raw_url) AS identifier, 'listing' AS code, malformed AS errors FROM l_all WHERE malformed IS NOT NULL
      UNION ALL SELECT record_no, coalesce(raw_name, raw_url), 'research', malformed FROM r_all WHERE malformed IS NOT NULL"""),
    "pain_point_shred": q("SELECT record_no, i - 1 AS position, pain_list[i].type AS type, pain_list[i].theme AS theme, pain_list[i].n AS mention_count FROM (SELECT record_no, pain_list, unnest(range(1, len(pain_list) + 1)) AS i FROM l)"),
    "csv_scan": q("SELECT record_no AS part, record_no + 2 AS record_no, name, url, selling_price FROM l"),
    "json_scan": q("""SELECT record_no AS part, n.position, name, url, marketplace, selling_price, competitor_count, verification_requested FROM r
      JOIN (SELECT p_partkey, row_number() OVER (ORDER BY (p_partkey // 1000) || '/', p_partkey) AS position FROM part) n ON n.p_partkey = r.record_no"""),
    "validate_listings": q(f"SELECT record_no, {text('errors')} AS errors, {text('warnings')} AS warnings FROM l_checked"),
    "validate_research": q(f"SELECT record_no, code, errors, CASE WHEN code IS NULL THEN {text('warnings')} END AS warnings FROM r_checked"),
    "unknown_marketplaces": q("SELECT record_no, 'unknown marketplace ''' || marketplace || ''' — add it to the marketplaces table first' AS error FROM l WHERE marketplace NOT IN (SELECT slug FROM marketplaces)"),
    "verification_gate": with_ctes("SELECT record_no, dataset_status, downgraded, notes FROM gated_all", {**EXTRA, "gated_all": gate("l", "dataset_status")}),
    "canonical_urls": q(f"SELECT page_id, variant, {canonical('url')} AS canonical FROM urls"),
    "placeholder_urls": q(f"SELECT page_id, variant, len(why) > 0 AS is_placeholder, {text('why')} AS reasons FROM (SELECT *, {reasons('url')} AS why FROM urls)"),
    "source_names": f"""SELECT id, source_name, {unattributed('source_name')} AS non_attributable FROM (SELECT doc_id AS id, unnest([source, source || '_test2', 'demo' || source, 'tbd 9' || lang,
      'contest ' || lang, ' Manual  Entry ', 'N/A', '  ' || lang || '-Sample']) AS source_name FROM documents)""",
    "match_names": f"SELECT doc_id, {match_name('text')} AS match_name FROM documents",
    "display_names": f"SELECT doc_id, {display('text')} AS display_name FROM documents",
    "theme_lists": r"""SELECT doc_id, i - 1 AS position, items[i] AS theme FROM (SELECT doc_id, items, unnest(range(1, len(items) + 1)) AS i FROM (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[\n.]+', '|', 'g'), '|'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> '') AS items FROM documents))""",
    "dedupe_keys": q("SELECT record_no, identity_key, name_key FROM l_keyed"),
    "batch_dedupe": with_ctes("SELECT record_no, NOT kept AS is_duplicate FROM all_walk", {**EXTRA, "all_walk": walk("l_keyed")}),
    "entity_match": with_ctes("SELECT record_no, existing_id FROM m", {**EXTRA, "m": matched("l_keyed", "stored_products")}),
    "entity_match_real": with_ctes("SELECT record_no, existing_id FROM m", {**EXTRA, "m": matched("l_keyed", "stored_real")}),
    "import_resolved": q("SELECT record_no, product_id, is_new, dataset_status, downgraded FROM r_resolved"),
    "snapshot_merge": q("""SELECT product_id, name, url, marketplace, external_id, normalized_name, brand, dataset_status, source_name FROM l_last
      UNION ALL SELECT product_id, name, url, marketplace, external_id, normalized_name, brand, dataset_status, source_name FROM stored_products WHERE product_id NOT IN (SELECT product_id FROM l_last)"""),
    "pain_point_replace": q("""SELECT product_id, p.type AS type, p.theme AS theme, p.n AS mention_count FROM (SELECT product_id, unnest(pain_list) AS p FROM l_pain_last)
      UNION ALL SELECT product_id, 'complaint', 'old theme', 1 FROM stored_products WHERE product_id NOT IN (SELECT product_id FROM l_pain_last)"""),
    "field_ledger": q(f"SELECT x.product_id, x.field_name, x.raw_value, x.numeric_value, r.source_name, 'run-1' AS run_id FROM ({_LEDGER}) x JOIN r USING (record_no) WHERE x.raw_value IS NOT NULL"),
    "import_report": q(_ROWS(
        ("submitted", "raw_r"), ("created", "(SELECT * FROM r_resolved WHERE is_new)"), ("updated", "(SELECT * FROM r_resolved WHERE NOT is_new)"), ("rejected", _R_REJECTED),
        ("duplicates_in_file", "(SELECT * FROM r_walk WHERE NOT kept)"), ("verification_downgrades", "(SELECT * FROM r_resolved WHERE downgraded)"), ("imported", "r_resolved"),
        ("merged_into_existing", "(SELECT * FROM r_resolved WHERE NOT is_new)"), ("missing_critical_fields", f"(SELECT {_CRITICAL} AS m FROM r_resolved) WHERE len(m) > 0"),
        ("records_with_warnings", "(SELECT * FROM r_checked WHERE code IS NULL AND len(warnings) > 0)"))),
    "listing_ingest_summary": q(_ROWS(
        ("received", "raw_l"), ("created", "(SELECT * FROM l_resolved WHERE is_new)"), ("updated", "(SELECT * FROM l_resolved WHERE NOT is_new)"), ("rejected", _L_REJECTED),
        ("skipped_duplicate", "(SELECT * FROM l_walk WHERE NOT kept)"), ("verification_downgrades", "(SELECT * FROM l_resolved WHERE downgraded)"))),
    "import_rejections": q("""SELECT code, count(*) AS records FROM (SELECT 'MALFORMED_RECORD' AS code FROM r_all WHERE malformed IS NOT NULL UNION ALL SELECT code FROM r_checked WHERE code IS NOT NULL
      UNION ALL SELECT 'UNKNOWN_MARKETPLACE' FROM r_ok WHERE marketplace NOT IN (SELECT slug FROM marketplaces) UNION ALL SELECT 'DUPLICATE_IN_FILE' FROM r_walk WHERE NOT kept
      UNION ALL SELECT 'CONFLICTING_URL' FROM r_linked WHERE conflict) GROUP BY code"""),
    "missing_critical_report": q(f"SELECT record_no, identifier, {text('m')} AS missing FROM (SELECT record_no, name AS identifier, {_CRITICAL} AS m FROM r_resolved) WHERE len(m) > 0"),
    "dry_run": q("SELECT 'research' AS kind, * FROM (" + _ROWS(("submitted", "raw_r"), ("would_import", "(SELECT * FROM r_checked WHERE code IS NULL)"),
        ("would_reject", "(SELECT record_no FROM r_all WHERE malformed IS NOT NULL UNION ALL SELECT record_no FROM r_checked WHERE code IS NOT NULL)"), ("warnings", "(SELECT * FROM r_checked WHERE code IS NULL AND len(warnings) > 0)"))
        + ") UNION ALL SELECT 'listing', * FROM (" + _ROWS(("submitted", "raw_l"), ("would_import", "l_ok"),
        ("would_reject", "(SELECT record_no FROM l_all WHERE malformed IS NOT NULL UNION ALL SELECT record_no FROM l_checked WHERE len(errors) > 0)"), ("warnings", "(SELECT * FROM l_ok WHERE len(warnings) > 0)")) + ")"),
    "batch_source_names": q("SELECT DISTINCT source_name FROM r WHERE source_name <> ''"),
    "regate_stored": with_ctes(f"""SELECT product_id, CASE WHEN dataset_status = 'VERIFIED' AND source_name = 'seed_demo_data' THEN 'SAMPLE' WHEN doubtful THEN 'UNVERIFIED' ELSE dataset_status END AS dataset_status,
      CASE WHEN dataset_status = 'VERIFIED' AND source_name = 'seed_demo_data' THEN 'Rows of the seed source are samples and cannot be VERIFIED.'
        WHEN doubtful THEN 'The stored VERIFIED claim was withdrawn: its source or its address cannot be traced.'
        WHEN has_notes THEN 'claim refused' END AS notes
      FROM (SELECT *, dataset_status = 'VERIFIED' AND (len({reasons('url')}) > 0 OR len({reasons('source_url')}) > 0 OR {unattributed('source_name')}) AS doubtful FROM products)"""),
    "status_backfill": with_ctes(f"""SELECT product_id, CASE WHEN data_source_id = 2 THEN 'kept' ELSE {match_name('name')} END AS normalized_name,
      coalesce(CASE WHEN data_source_id = 0 THEN source_name END, source, 'unknown') AS source_name,
      CASE WHEN fragile THEN 'UNVERIFIED' WHEN data_source_id = 1 THEN dataset_status WHEN dataset_status = 'SAMPLE' THEN 'SAMPLE' ELSE 'UNVERIFIED' END AS dataset_status
      FROM products LEFT JOIN sources USING (data_source_id)"""),
    "ungated_scores": with_ctes("SELECT product_id, risk_score, 'INCOMPLETE' AS score_status, CAST(NULL AS DOUBLE) AS final_score, CAST(NULL AS VARCHAR) AS classification FROM scored"),
    "source_freshness": with_ctes(f"""SELECT source_name, count(*) AS products, {iso('max(collected_at)')} AS newest,
      floor(date_diff('microsecond', max(collected_at), TIMESTAMP '2024-02-01 12:00:00') / 3600000000.0 * 10 + 0.5) / 10 AS age_hours FROM products GROUP BY source_name"""),
    "run_list": f"SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, {iso('o_orderdate')} AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25",
    "last_completed_run": with_ctes(f"""SELECT run_id, {iso('finished')} AS finished_at, coalesce(source, 'unknown') AS source FROM (
      SELECT o_orderkey AS run_id, o_orderdate + to_seconds(o_custkey) AS finished, o_custkey % 4 AS data_source_id FROM orders WHERE o_orderstatus = 'F' ORDER BY finished DESC, run_id DESC LIMIT 1)
      LEFT JOIN sources USING (data_source_id)"""),
    "seed_fees_if_absent": with_ctes(f"""SELECT marketplace, category, fee_type, min(fee_value) AS fee_value, 'rate card' AS source FROM incoming
        WHERE marketplace IN (SELECT slug FROM marketplaces) AND NOT EXISTS (SELECT 1 FROM fees f WHERE f.fee_id <= {len(config.dimensions()['fees'])} AND f.marketplace = incoming.marketplace AND f.category = incoming.category
          AND f.fee_type = incoming.fee_type AND f.effective_date = DATE '2026-01-01') GROUP BY ALL
      UNION ALL SELECT marketplace, 'skipped', '', CAST(count(*) AS DOUBLE), '' FROM incoming WHERE marketplace NOT IN (SELECT slug FROM marketplaces) GROUP BY marketplace""",
      {"incoming": f"""SELECT {_SEED_KEY} AS marketplace, CASE WHEN p_size % 2 = 0 THEN 'default' ELSE {binding.CATEGORY} END AS category,
        CASE p_partkey % 3 WHEN 0 THEN 'referral_percentage' WHEN 1 THEN 'commission_percentage' ELSE 'closing_fee_fixed_inr' END AS fee_type, CAST(p_size AS DOUBLE) AS fee_value FROM part"""}),
}
_CHANGED = "s.price IS DISTINCT FROM w.state_price OR s.mrp IS DISTINCT FROM w.state_mrp"


def price_seq(source: str, order: str, on_file: str = "false") -> str:
    return f"""SELECT product_id, record_no, floor(selling_price * 100 + 0.5) / 100 AS price, floor(mrp * 100 + 0.5) / 100 AS mrp, collected_at AS seen,
      {on_file} AS on_file, row_number() OVER (PARTITION BY product_id ORDER BY {order}) AS n FROM {source}"""


def price_walk(seq: str) -> str:
    """Rows of ``seq`` that the change gate keeps, product by product in the order of ``n``."""
    return f"""SELECT * FROM (WITH RECURSIVE price_seq AS MATERIALIZED (SELECT * FROM {seq}), walk AS (
    SELECT product_id, CAST(NULL AS BIGINT) AS record_no, CAST(0 AS BIGINT) AS n, CASE WHEN on_file THEN TIMESTAMP '2026-09-01' END AS state_at,
      CASE WHEN on_file THEN CAST(301.0 AS DOUBLE) END AS state_price, CAST(NULL AS DOUBLE) AS state_mrp, on_file AS known, false AS kept, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS mrp,
      CAST(NULL AS TIMESTAMP) AS seen
    FROM price_seq WHERE n = 1
    UNION ALL
    SELECT s.product_id, s.record_no, s.n, CASE WHEN (NOT w.known OR {_CHANGED}) AND (w.state_at IS NULL OR s.seen >= w.state_at) THEN s.seen ELSE w.state_at END,
      CASE WHEN (NOT w.known OR {_CHANGED}) AND (w.state_at IS NULL OR s.seen >= w.state_at) THEN s.price ELSE w.state_price END,
      CASE WHEN (NOT w.known OR {_CHANGED}) AND (w.state_at IS NULL OR s.seen >= w.state_at) THEN s.mrp ELSE w.state_mrp END,
      true, NOT w.known OR {_CHANGED}, s.price, s.mrp, s.seen FROM walk w JOIN price_seq s ON s.product_id = w.product_id AND s.n = w.n + 1)
  SELECT * FROM walk WHERE kept)"""


EXTRA["price_seq0"] = price_seq("l_resolved", "record_no", "product_id IN (SELECT product_id FROM stored_products)")
EXTRA["price_walk"] = price_walk("price_seq0")
# Three submissions one after the other, each matched with the products as the one before left them.
_STORED = "product_id, marketplace, external_id, url, normalized_name, dataset_status, name, brand, source_name"
EXTRA["b0_store"] = f"SELECT {_STORED} FROM stored_products"
for _k in range(1, 4):
    EXTRA |= {
        f"b{_k}_placed": f"SELECT * FROM l_placed WHERE record_no % 3 = {_k - 1}",
        f"b{_k}_walk": walk(f"b{_k}_placed"),
        f"b{_k}_kept": f"SELECT p.* FROM b{_k}_placed p JOIN b{_k}_walk USING (record_no) WHERE kept",
        f"b{_k}_gated": gate(f"b{_k}_kept", "dataset_status"),
        f"b{_k}_matched": matched(f"b{_k}_gated", f"b{_k - 1}_store"),
        f"b{_k}_linked": resolved(f"b{_k}_matched"),
        f"b{_k}_resolved": f"SELECT *, {_k} AS batch FROM b{_k}_linked WHERE NOT conflict",
        f"b{_k}_last": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY record_no DESC) AS rn FROM b{_k}_resolved) WHERE rn = 1",
        f"b{_k}_store": f"SELECT {_STORED} FROM b{_k}_last UNION ALL SELECT {_STORED} FROM b{_k - 1}_store WHERE product_id NOT IN (SELECT product_id FROM b{_k}_last)",
    }
_SEQ = "product_id, record_no, selling_price, mrp, collected_at, batch"
EXTRA["b_all"] = " UNION ALL ".join(f"SELECT {_SEQ} FROM b{k}_resolved" for k in range(1, 4))
EXTRA["b_seq0"] = price_seq("b_all", "batch, record_no").replace("AS n FROM", "AS n, batch FROM")
EXTRA["b_walk"] = price_walk("b_seq0")
EXTRA["b_newest"] = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS price_rows, row_number() OVER (PARTITION BY product_id ORDER BY seen DESC, n DESC) AS rn FROM b_walk) WHERE rn = 1"
SQL["store_after_imports"] = q("""SELECT s.product_id, name, url, marketplace, external_id, brand, dataset_status, source_name, price_rows, w.price AS selling_price, w.record_no AS price_record
  FROM b3_store s LEFT JOIN b_newest w USING (product_id)""")
SQL["store_index_after_imports"] = q("""SELECT marketplace, k.kind AS kind, k.key AS key, product_id, sample FROM (
  SELECT marketplace, product_id, dataset_status = 'SAMPLE' AS sample,
    unnest([{'kind': 'external_id', 'key': external_id}, {'kind': 'url', 'key': url}, {'kind': 'normalized_name', 'key': normalized_name}]) AS k FROM b3_store) WHERE k.key <> ''""")
SQL["dedupe_chain"] = f"""WITH part_chain AS (SELECT p_partkey AS record_no, 'i' || (p_partkey // 2) AS identity_key, 'n' || ((p_partkey + 1) // 2) AS name_key FROM part),
  chain_walk AS ({walk("part_chain")}) SELECT record_no, NOT kept AS is_duplicate FROM chain_walk"""
SQL["import_price_rows"] = q("SELECT product_id, record_no, price AS selling_price, mrp FROM price_walk")


def _shown(c: str, numeric: bool = False) -> str:
    return f"coalesce({num(c) if numeric else c}, 'Data unavailable')"


_NUMBERS = {
    "price_inr": "stored_price", "estimated_cost_inr": "stored_landed", "estimated_profit_inr": "stored_profit", "margin_pct": "stored_margin", "demand_score": "demand",
    "competition_opportunity_score": "competition_opportunity", "differentiation_score": "differentiation", "risk_score": "risk_score", "final_score": "final_score",
    "data_completeness": "data_completeness",
}
_TEXTS = {
    "product": "name", "url": "url", "marketplace": "marketplace_name", "category": "category", "classification": "classification", "dataset_status": "dataset_status",
    "score_status": "score_status", "source": "shown_source", "source_url": "source_url",
}
_RANK = "row_number() OVER (ORDER BY final_score DESC NULLS LAST, name, product_id)"
SQL["export_csv_lines"] = with_ctes(
    f"SELECT CAST({_RANK} AS VARCHAR) AS rank, " + ", ".join(f"{_shown(e, True)} AS {c}" for c, e in _NUMBERS.items()) + ", "
    + ", ".join(f"{_shown(e)} AS {c}" for c, e in _TEXTS.items())
    + f", CASE WHEN len(missing) > 0 THEN array_to_string(missing, '; ') ELSE 'None' END AS missing_critical_fields, {_DISCLAIMER} AS disclaimer, "
    + f"coalesce({iso('collected_at')}, 'Data unavailable') AS collected_at, 'Data unavailable' AS score_computed_at FROM ranked"
)
SQL["export_json_lines"] = with_ctes(f"SELECT {_RANK} AS rank, name AS product, classification IS NULL AS class_is_null, 24 AS fields FROM ranked")
SQL["research_csv_scan"] = q("SELECT record_no AS part, record_no + 2 AS record_no, name, url, marketplace, selling_price, competitor_count, 'two' || chr(10) || 'lines, \"quoted\"' AS description FROM r")
_OF = "record_no % 3 = {k} - 1"
SQL["stored_run_log"] = q(" UNION ALL ".join(f"""SELECT 'run-{k - 1}' AS run_id, 'completed' AS status, (SELECT count(*) FROM raw_l WHERE {_OF.format(k=k)}) AS received,
  (SELECT count(*) FROM b{k}_resolved WHERE is_new) AS created, (SELECT count(*) FROM b{k}_resolved WHERE NOT is_new) AS updated,
  (SELECT count(*) FROM {_L_REJECTED.replace('l_linked', f'b{k}_linked')} WHERE {_OF.format(k=k)}) AS rejected, (SELECT count(*) FROM b{k}_walk WHERE NOT kept) AS duplicates""" for k in range(1, 4)))
