"""Word lists, field lists, codes and texts that results must reproduce exactly."""

# --- cleaning ---------------------------------------------------------------------------------
NULL_TOKENS = ["", "-", "n/a", "na", "null", "none", "unknown"]
TRUE_TOKENS = ["true", "yes", "y", "1"]
FALSE_TOKENS = ["false", "no", "n", "0"]
RISK_LEVELS = ["none", "low", "medium", "high"]
DATASET_STATUSES = ["SAMPLE", "UNVERIFIED", "VERIFIED"]
PAIN_TYPES = ["complaint", "positive", "opportunity"]

# --- URL and source judgments -----------------------------------------------------------------
PLACEHOLDER_HOST_TOKENS = [
    "example", "test", "invalid", "localhost", "demo", "sample", "placeholder", "dummy", "fake",
    "mock", "sandbox", "staging", "lorem", "ipsum", "foo", "bar", "baz", "acme", "yourdomain",
    "mydomain", "domain",
]
PLACEHOLDER_TLDS = ["test", "invalid", "localhost", "example", "local", "internal"]
PLACEHOLDER_PATH_SEGMENTS = ["demo", "sample", "placeholder", "dummy", "fake", "mock", "example"]
LOOPBACK_HOSTS = ["127.0.0.1", "0.0.0.0", "::1", "[::1]"]
NON_ATTRIBUTABLE_NAMES = [
    "seed_demo_data", "manual_csv", "manual entry", "demo assumption", "unknown", "n/a", "na",
    "none", "test", "demo", "sample", "placeholder", "example", "tbd",
]
SEED_SOURCE_NAMES = ["seed_demo_data", "sample_data", "demo_data"]
AUTOMATED_SOURCE_NAMES = [
    "keepa", "amazon_sp_api", "amazon_creators_api", "flipkart_affiliate", "ondc", "rainforest",
    "oxylabs", "serpapi",
]

# --- submitted fields -------------------------------------------------------------------------
LISTING_FIELDS = [
    "name", "url", "marketplace", "external_id", "brand", "category", "subcategory", "description",
    "features", "variants", "sizes", "colors", "image_urls", "weight_kg", "length_cm", "width_cm",
    "height_cm", "selling_price", "mrp", "currency", "review_count", "average_rating",
    "competitor_count", "seller_count", "best_seller_rank", "search_term", "product_cost",
    "shipping_cost", "packaging_cost", "marketplace_fee_override", "payment_fee",
    "advertising_cost", "return_allowance", "other_costs", "cost_source", "cost_source_url",
    "fragile", "return_risk", "regulatory_complexity", "brand_ip_risk", "seasonal_demand",
    "established_brand_dominance", "bundle_potential_score", "complaints", "positives",
    "opportunities", "source_url", "collected_at", "confidence_score", "source_name",
    "dataset_status", "is_sample_data",
]
REQUIRED_FIELDS = [
    "product_name", "marketplace", "product_url", "observed_price", "observed_at", "source_url",
    "source_name",
]
OPTIONAL_FIELDS = [
    "product_id", "category", "brand", "description", "rating", "review_count", "supplier_cost",
    "shipping_cost", "packaging_cost", "marketplace_fee", "payment_fee", "advertising_cost",
    "return_allowance", "other_costs", "cost_source_name", "cost_source_url", "product_weight",
    "product_dimensions", "demand_signal", "competition_signal", "seller_count",
    "best_seller_rank", "search_term", "mrp", "currency", "confidence_score", "fragile",
    "return_risk", "regulatory_complexity", "brand_ip_risk", "seasonal_demand",
    "established_brand_dominance", "complaints", "positives", "opportunities",
    "verification_requested",
]
NUMERIC_FIELDS = [
    "observed_price", "rating", "review_count", "supplier_cost", "shipping_cost",
    "packaging_cost", "marketplace_fee", "payment_fee", "advertising_cost", "return_allowance",
    "other_costs", "product_weight", "demand_signal", "competition_signal", "seller_count",
    "best_seller_rank", "mrp", "confidence_score",
]
#: Read from a submission but not written to the ledger.
UNLISTED_FIELDS = [
    "source", "dataset_status", "subcategory", "features", "variants", "sizes", "colors",
    "image_urls", "bundle_potential_score",
]

# --- costs and fees ---------------------------------------------------------------------------
#: (stored column, name used in notes and reports), in the order costs are added up.
COST_FIELDS = [
    ("product_cost", "productCost"),
    ("shipping_cost", "shippingCost"),
    ("packaging_cost", "packagingCost"),
    ("marketplace_fee", "marketplaceFee"),
    ("payment_fee", "paymentFee"),
    ("advertising_cost", "advertisingCost"),
    ("return_allowance", "returnAllowance"),
    ("other_costs", "otherCosts"),
]
PERCENTAGE_FEE_TYPES = [
    "referral_percentage", "commission_percentage", "collection_fee_percentage",
    "payment_gateway_percentage", "other_percentage",
]
GATEWAY_FEE_TYPE = "payment_gateway_percentage"

# --- scoring ----------------------------------------------------------------------------------
#: (column, configuration key), in the order the final score is added up.
COMPONENTS = [
    ("demand", "demand"),
    ("profitability", "profitability"),
    ("competition_opportunity", "competitionOpportunity"),
    ("differentiation", "differentiation"),
    ("shipping_simplicity", "shippingSimplicity"),
    ("customer_pain_opportunity", "customerPainOpportunity"),
    ("bundle_expansion", "bundleExpansion"),
]
CRITICAL_FIELDS = {
    "selling_price": "Current selling price (INR)",
    "product_cost": "Supplier/product cost per unit (INR)",
    "marketplace": "Marketplace the listing belongs to",
    "demand_signal": "Demand signal (review count and average rating)",
    "competition_signal": "Competition signal (count of comparable listings)",
    "source": "Named source and source URL for the record",
    "collected_at": "Timestamp the data was collected",
}

# --- serving texts ----------------------------------------------------------------------------
UNAVAILABLE = "Data unavailable"
DISCLAIMERS = {
    "SAMPLE": "DEMO DATA — this row describes no real listing. It exists to exercise the pipeline and is not a validated, profitable or recommended product. Not market evidence.",
    "INCOMPLETE": "INCOMPLETE — critical inputs are missing, so no Final Score has been issued. Ranking below is by sub-scores only and must not be read as a recommendation.",
    "UNVERIFIED": "UNVERIFIED — researched but not independently re-checked. Confirm the listing and supplier quote before acting.",
    "VERIFIED": "VERIFIED — inputs confirmed against the listing and a supplier quote. Still a ranking of opportunity, not a prediction of profit.",
}
NEXT_STEPS = {
    "SAMPLE": "No action: this is demo data. Import real researched data before drawing any conclusion.",
    "OTHER": "Validate before scaling: confirm the supplier quote and sample quality, then run a small first order (20-30 units) and measure real sell-through, return rate and ad cost against these estimates. These scores rank opportunity from collected signals — they are not a prediction of profit.",
}
NO_RISKS = "No risk penalties triggered by the data on file."
#: (column, header) of the export, in order.
EXPORT_COLUMNS = [
    ("rank", "Rank"), ("product", "Product"), ("url", "URL"), ("marketplace", "Marketplace"),
    ("category", "Category"), ("price", "Price (INR)"), ("estimated_cost", "Estimated Cost (INR)"),
    ("estimated_profit", "Estimated Profit (INR)"), ("margin", "Margin %"),
    ("demand_score", "Demand Score"),
    ("competition_opportunity_score", "Competition Opportunity Score"),
    ("differentiation_score", "Differentiation Score"), ("risk_score", "Risk Score"),
    ("final_score", "Final Score"), ("classification", "Classification"),
    ("data_completeness", "Data Completeness"), ("dataset_status", "Dataset Status"),
    ("score_status", "Score Status"), ("missing_critical_fields", "Missing Critical Fields"),
    ("disclaimer", "Disclaimer"), ("source_name", "Source"), ("source_url", "Source URL"),
    ("collected_at", "Collected At"), ("score_computed_at", "Score Computed At"),
]

# --- price-tracker dumps ----------------------------------------------------------------------
TRACKER_SOURCE = "keepa"
TRACKER_EPOCH_MINUTES = 21_564_000
TRACKER_SERIES = {
    "AMAZON": 0, "NEW": 1, "USED": 2, "SALES_RANK": 3, "LIST_PRICE": 4, "COLLECTIBLE": 5,
    "REFURBISHED": 6, "NEW_FBM_SHIPPING": 7, "LIGHTNING_DEAL": 8, "WAREHOUSE": 9, "NEW_FBA": 10,
    "COUNT_NEW": 11, "COUNT_USED": 12, "COUNT_REFURBISHED": 13, "COUNT_COLLECTIBLE": 14,
    "EXTRA_INFO_UPDATES": 15, "RATING": 16, "COUNT_REVIEWS": 17, "BUY_BOX_SHIPPING": 18,
}
TRACKER_AVAILABILITY = {
    -1: "no Amazon offer", 0: "in stock", 1: "pre-order", 2: "unknown", 3: "back-order",
    4: "delayed shipping",
}
TRACKER_IMAGE_PREFIX = "https://m.media-amazon.com/images/I/"
TRACKER_PAGE_PREFIX = "https://www.amazon.in/dp/"
