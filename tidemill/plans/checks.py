"""The catalogue of checks over the advertising tables, and the relations that they scan."""

from __future__ import annotations

from tidemill.operators.quality import WARNING, Check, Parent, Relation

ADVERTISER = Parent("advertisers", "advertiser_id", "advertiser_id", {"a_id": "advertiser_id", "a_created_at": "created_at"})

#: Tables with what their rows point to.
RELATIONS = {
    "b_advertisers": Relation("advertisers"),
    "b_campaigns": Relation("campaigns", (ADVERTISER,)),
    "b_line_items": Relation("line_items", (
        Parent("campaigns", "campaign_id", "campaign_id", {"c_id": "campaign_id", "c_created_at": "created_at", "c_start": "start_date", "c_end": "end_date"}),
    )),
    "b_creatives": Relation("creatives", (ADVERTISER,)),
    "b_publishers": Relation("publishers"),
    "b_placements": Relation("placements", (Parent("publishers", "publisher_id", "publisher_id", {"b_id": "publisher_id", "b_created_at": "created_at"}),)),
    "b_audiences": Relation("audiences"),
    "b_impressions": Relation("impressions", (
        Parent("campaigns", "campaign_id", "campaign_id", {"c_id": "campaign_id", "c_adv": "advertiser_id", "c_start": "start_date", "c_end": "end_date", "c_created_at": "created_at", "c_status": "campaign_status"}),
        Parent("line_items", "line_item_id", "line_item_id", {"l_id": "line_item_id", "l_camp": "campaign_id", "l_start": "start_date", "l_end": "end_date"}),
        Parent("advertisers", "advertiser_id", "advertiser_id", {"a_id": "advertiser_id"}),
        Parent("creatives", "creative_id", "creative_id", {"r_id": "creative_id", "r_adv": "advertiser_id"}),
        Parent("publishers", "publisher_id", "publisher_id", {"b_id": "publisher_id"}),
        Parent("placements", "placement_id", "placement_id", {"p_id": "placement_id", "p_pub": "publisher_id", "p_floor": "floor_price"}),
        Parent("audiences", "audience_id", "audience_id", {"u_id": "audience_id", "u_country": "country"}),
    )),
    "b_clicks": Relation("clicks", (
        Parent("impressions", "impression_id", "impression_id", {"i_id": "impression_id", "i_camp": "campaign_id", "i_line": "line_item_id", "i_adv": "advertiser_id", "i_cre": "creative_id", "i_ts": "impression_timestamp", "i_device": "device_type", "i_country": "country"}),
    )),
    "b_conversions": Relation("conversions", (
        Parent("clicks", "click_id", "click_id", {"k_id": "click_id", "k_imp": "impression_id", "k_camp": "campaign_id", "k_adv": "advertiser_id", "k_ts": "click_timestamp"}),
        Parent("impressions", "impression_id", "impression_id", {"i_id": "impression_id"}),
    )),
    "b_spend": Relation("spend_transactions", (
        Parent("campaigns", "campaign_id", "campaign_id", {"c_id": "campaign_id"}),
        Parent("line_items", "line_item_id", "line_item_id", {"l_id": "line_item_id", "l_camp": "campaign_id"}),
        Parent("publishers", "publisher_id", "publisher_id", {"b_id": "publisher_id"}),
        Parent("impressions", "impression_id", "impression_id", {"i_id": "impression_id"}),
    )),
}

#: All relations as SQL.
BASES = {name: relation.sql() for name, relation in RELATIONS.items()} | {
    "b_raw_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "b_impression_ids": "SELECT impression_id, count(*) AS n FROM {impressions} GROUP BY impression_id",
    "b_click_ids": "SELECT click_id, count(*) AS n FROM {clicks} GROUP BY click_id",
    "b_click_impressions": "SELECT impression_id, count(*) AS n FROM {clicks} GROUP BY impression_id",
    "b_conversion_ids": "SELECT conversion_id, count(*) AS n FROM {conversions} GROUP BY conversion_id",
    "b_conversion_clicks": "SELECT click_id, count(*) AS n FROM {conversions} GROUP BY click_id",
    "b_domains": "SELECT domain, count(*) AS n FROM {publishers} GROUP BY domain",
}


def _many(kind: str, rows: list[tuple], **more) -> list[Check]:
    return [Check(name, kind, base, predicate, **more) for name, base, predicate in rows]


NO_FLIGHT = "CAST(impression_timestamp AS DATE) < {0} OR CAST(impression_timestamp AS DATE) > {1}"

REFERENTIAL = _many("referential", [
    ("orphan_campaigns", "b_campaigns", "a_id IS NULL"),
    ("orphan_line_items", "b_line_items", "c_id IS NULL"),
    ("orphan_creatives", "b_creatives", "a_id IS NULL"),
    ("orphan_placements", "b_placements", "b_id IS NULL"),
    ("orphan_impression_foreign_keys", "b_impressions", "c_id IS NULL OR l_id IS NULL OR a_id IS NULL OR r_id IS NULL OR b_id IS NULL OR p_id IS NULL OR u_id IS NULL"),
    ("impression_line_item_belongs_to_campaign", "b_impressions", "l_camp <> campaign_id"),
    ("impression_advertiser_matches_campaign", "b_impressions", "c_adv <> advertiser_id"),
    ("impression_creative_belongs_to_advertiser", "b_impressions", "r_adv <> advertiser_id"),
    ("impression_placement_belongs_to_publisher", "b_impressions", "p_pub <> publisher_id"),
    ("orphan_clicks", "b_clicks", "i_id IS NULL"),
    ("click_attributes_match_impression", "b_clicks", "i_camp <> campaign_id OR i_line <> line_item_id OR i_adv <> advertiser_id OR i_cre <> creative_id"),
    ("orphan_conversions", "b_conversions", "k_id IS NULL OR i_id IS NULL"),
    ("conversion_attributes_match_click", "b_conversions", "k_imp <> impression_id OR k_camp <> campaign_id OR k_adv <> advertiser_id"),
    ("orphan_spend_transactions", "b_spend", "c_id IS NULL OR l_id IS NULL OR b_id IS NULL"),
    ("spend_line_item_belongs_to_campaign", "b_spend", "l_camp <> campaign_id"),
    ("spend_impression_reference_valid", "b_spend", "impression_id IS NOT NULL AND i_id IS NULL"),
])

TEMPORAL = _many("temporal", [
    ("campaign_created_before_advertiser", "b_campaigns", "created_at < a_created_at"),
    ("campaign_created_after_flight_start", "b_campaigns", "CAST(created_at AS DATE) > start_date"),
    ("campaign_start_after_end", "b_campaigns", "start_date > end_date"),
    ("line_item_created_before_campaign", "b_line_items", "created_at < c_created_at"),
    ("line_item_flight_outside_campaign", "b_line_items", "start_date < c_start OR end_date > c_end"),
    ("impression_outside_campaign_flight", "b_impressions", NO_FLIGHT.format("c_start", "c_end")),
    ("impression_outside_line_item_flight", "b_impressions", NO_FLIGHT.format("l_start", "l_end")),
    ("impression_before_parent_creation", "m_parents", "impression_timestamp < l_created_at OR impression_timestamp < r_created_at OR impression_timestamp < p_created_at"),
    ("click_before_impression", "b_clicks", "click_timestamp < i_ts"),
    ("conversion_before_click", "b_conversions", "conversion_timestamp < k_ts"),
    ("conversion_outside_attribution_window", "b_conversions", "conversion_timestamp > k_ts + attribution_window_hours * INTERVAL '1' HOUR"),
    ("event_created_before_it_happened", "m_event_times", "bad = 1"),
    ("updated_before_created", "m_updates", "bad = 1"),
])

#: What currency columns must look like; the same in both SQL dialects but for the function's name.
CODE = "'^[A-Z][A-Z][A-Z]$'"


def business(as_of: str = "1998-01-01") -> list[Check]:
    """The business rules; ``as_of`` is the day on which campaigns' states are judged."""
    day = f"DATE '{as_of}'"
    contradicts = (
        f"(campaign_status = 'ACTIVE' AND NOT (start_date <= {day} AND {day} <= end_date)) "
        f"OR (campaign_status IN ('COMPLETED', 'CANCELLED') AND end_date >= {day}) OR (campaign_status = 'DRAFT' AND start_date <= {day})"
    )
    return _many("business", [
        ("invalid_enum_values", "m_enums", "bad = 1"),
        ("unexpected_nulls", "m_nulls", "bad = 1"),
        ("negative_money", "m_money", "bad = 1"),
        ("viewability_out_of_range", "b_impressions", "viewability_score NOT BETWEEN 0 AND 1"),
        ("clearing_price_above_bid", "b_impressions", "clearing_price > bid_price"),
        ("clearing_price_below_floor", "b_impressions", "clearing_price < p_floor"),
        ("audience_age_range_invalid", "b_audiences", "min_age >= max_age"),
        ("daily_budget_above_total", "b_campaigns", "daily_budget > campaign_budget"),
        ("campaign_status_contradicts_dates", "b_campaigns", contradicts),
        ("currency_not_iso_format", "m_currencies", "bad = 1"),
        ("spend_impression_reference_inconsistent_with_billing_type", "b_spend", "(billing_type = 'CPM') <> (impression_id IS NULL)"),
        ("draft_campaign_delivered_impressions", "b_impressions", "c_status = 'DRAFT'"),
        ("impression_country_unknown", "b_impressions", "u_country IS NULL OR u_country <> country"),
    ])


BUSINESS = business()

UNIQUENESS = _many("uniqueness", [
    ("duplicate_primary_keys", "m_keys", "n > 1"),
    ("duplicate_impression_ids", "b_impression_ids", "n > 1"),
    ("duplicate_click_ids", "b_click_ids", "n > 1"),
    ("duplicate_conversion_ids", "b_conversion_ids", "n > 1"),
    ("duplicate_publisher_domains", "b_domains", "n > 1"),
]) + _many("uniqueness", [
    ("multiple_clicks_per_impression", "b_click_impressions", "n > 1"),
    ("multiple_conversions_per_click", "b_conversion_clicks", "n > 1"),
], severity=WARNING)

JOINS = _many("join", [
    ("join_campaigns_to_advertisers", "b_campaigns", "a_id IS NOT NULL"),
    ("join_line_items_to_campaigns", "b_line_items", "c_id IS NOT NULL"),
    ("join_creatives_to_advertisers", "b_creatives", "a_id IS NOT NULL"),
    ("join_placements_to_publishers", "b_placements", "b_id IS NOT NULL"),
    ("join_impressions_to_campaigns", "b_impressions", "c_id IS NOT NULL"),
    ("join_impressions_to_clicks", "b_clicks", "i_id IS NOT NULL"),
    ("join_clicks_to_conversions", "b_conversions", "k_id IS NOT NULL"),
    ("join_impressions_to_supply", "b_impressions", "b_id IS NOT NULL AND p_id IS NOT NULL"),
    ("join_impressions_to_audiences", "b_impressions", "u_id IS NOT NULL"),
    ("join_spend_to_impressions", "b_spend", "i_id IS NOT NULL"),
    ("join_full_funnel", "b_conversions", "k_id IS NOT NULL AND i_id IS NOT NULL"),
    ("campaigns_with_delivery", "b_impressions", "c_id IS NOT NULL AND c_status <> 'DRAFT'"),
    ("publishers_with_delivery", "b_impressions", "b_id IS NOT NULL"),
], expect="nonzero")

ROW_RULES = _many("row", [
    ("blank_advertiser_name", "b_advertisers", "advertiser_name IS NULL OR trim(advertiser_name) = ''"),
    ("publisher_status_unknown", "b_publishers", "publisher_status NOT IN ('ACTIVE', 'INACTIVE')"),
    ("placement_device_unknown", "b_placements", "device_type NOT IN ('MOBILE', 'DESKTOP', 'TABLET')"),
    ("line_item_status_unknown", "b_line_items", "line_item_status NOT IN ('DRAFT', 'ACTIVE', 'PAUSED')"),
    ("bid_not_positive", "b_line_items", "bid_amount <= 0 OR target_cpm <= 0 OR frequency_cap <= 0"),
    ("audience_gender_unknown", "b_audiences", "gender NOT IN ('ALL', 'MALE', 'FEMALE')"),
    ("line_item_start_after_end", "b_line_items", "start_date > end_date"),
    ("landing_page_not_https", "b_creatives", "landing_page_url NOT LIKE 'https://%'"),
    ("audience_age_out_of_bounds", "b_audiences", "min_age < 13 OR max_age > 99"),
    ("publisher_created_after_placement", "b_placements", "created_at < b_created_at"),
    ("advertiser_created_after_creative", "b_creatives", "created_at < a_created_at"),
    ("line_item_created_after_its_flight", "b_line_items", "CAST(created_at AS DATE) > start_date"),
    ("click_place_differs_from_impression", "b_clicks", "device_type <> i_device OR country <> i_country"),
    ("paused_campaign_not_started", "b_campaigns", "campaign_status = 'PAUSED' AND start_date > DATE '2001-01-01'"),
]) + _many("uniqueness", [("duplicate_source_line_numbers", "b_raw_keys", "n > 1")])



def _each(*rows: tuple[str, str]) -> str:
    """One row per row of every table, with whether it violates the table's own condition."""
    return " UNION ALL ".join(f"SELECT CASE WHEN {bad} THEN 1 ELSE 0 END AS bad FROM {{{table}}}" for table, bad in rows)


def _no_code(column: str) -> str:
    return f"NOT rlike({column}, {CODE})"


MASTERS = {
    "advertisers": "advertiser_id", "campaigns": "campaign_id", "line_items": "line_item_id", "creatives": "creative_id",
    "publishers": "publisher_id", "placements": "placement_id", "audiences": "audience_id",
}

#: Conditions over several tables, each counted on its own table.
EACH = {
    "m_enums": (
        ("advertisers", "account_status NOT IN ('ACTIVE', 'SUSPENDED', 'CLOSED')"),
        ("campaigns", "campaign_status NOT IN ('DRAFT', 'ACTIVE', 'PAUSED', 'COMPLETED', 'CANCELLED')"),
        ("campaigns", "campaign_objective NOT IN ('AWARENESS', 'TRAFFIC', 'ENGAGEMENT', 'CONVERSIONS', 'APP_INSTALLS')"),
        ("campaigns", "bid_strategy NOT IN ('CPC', 'CPM', 'CPA', 'TARGET_ROAS', 'MAX_CONVERSIONS')"),
        ("line_items", "optimization_goal NOT IN ('CLICKS', 'CONVERSIONS', 'REVENUE', 'REACH', 'IMPRESSIONS')"),
        ("creatives", "creative_type NOT IN ('BANNER', 'VIDEO', 'NATIVE', 'AUDIO')"),
        ("creatives", "creative_status NOT IN ('ACTIVE', 'PAUSED', 'REJECTED', 'EXPIRED')"),
        ("publishers", "publisher_type NOT IN ('WEBSITE', 'MOBILE_APP', 'CTV', 'AUDIO')"),
        ("placements", "placement_type NOT IN ('HEADER', 'SIDEBAR', 'IN_FEED', 'VIDEO_PRE_ROLL', 'VIDEO_MID_ROLL', 'APP_BANNER', 'APP_INTERSTITIAL')"),
        ("audiences", "audience_type NOT IN ('DEMOGRAPHIC', 'INTEREST', 'BEHAVIORAL', 'LOOKALIKE', 'RETARGETING')"),
        ("impressions", "device_type NOT IN ('DESKTOP', 'MOBILE', 'TABLET', 'CTV', 'SMART_SPEAKER')"),
        ("conversions", "conversion_type NOT IN ('PURCHASE', 'SIGNUP', 'LEAD', 'APP_INSTALL', 'SUBSCRIPTION')"),
        ("spend_transactions", "billing_type NOT IN ('CPM', 'CPC', 'CPA')"),
    ),
    "m_nulls": (
        ("advertisers", "advertiser_name IS NULL OR billing_currency IS NULL"),
        ("campaigns", "campaign_name IS NULL OR start_date IS NULL OR end_date IS NULL"),
        ("impressions", "country IS NULL OR city IS NULL OR currency IS NULL"),
        ("clicks", "country IS NULL OR device_type IS NULL"),
        ("conversions", "conversion_value IS NULL OR currency IS NULL"),
    ),
    "m_money": (
        ("spend_transactions", "spend_amount < 0"),
        ("impressions", "bid_price < 0 OR clearing_price < 0"),
        ("placements", "floor_price < 0"),
        ("line_items", "bid_amount <= 0 OR target_cpm <= 0"),
        ("campaigns", "campaign_budget <= 0 OR daily_budget <= 0"),
        ("conversions", "conversion_value < 0"),
    ),
    "m_currencies": (
        ("advertisers", _no_code("billing_currency")),
        ("line_items", _no_code("bid_currency")),
        *((t, _no_code("currency")) for t in ("placements", "impressions", "conversions", "spend_transactions")),
    ),
    "m_event_times": (
        ("impressions", "created_at < impression_timestamp"),
        ("clicks", "created_at < click_timestamp"),
        ("conversions", "created_at < conversion_timestamp"),
        ("spend_transactions", "created_at < spend_timestamp"),
    ),
    "m_updates": tuple((t, "updated_at < created_at") for t in MASTERS),
}

BASES |= {name: _each(*rows) for name, rows in EACH.items()} | {
    "m_parents": """SELECT i.impression_timestamp, l.created_at AS l_created_at, r.created_at AS r_created_at, p.created_at AS p_created_at
        FROM {impressions} i JOIN {line_items} l ON i.line_item_id = l.line_item_id
        JOIN {creatives} r ON i.creative_id = r.creative_id JOIN {placements} p ON i.placement_id = p.placement_id""",
    "m_keys": " UNION ALL ".join(f"SELECT count(*) AS n FROM {{{t}}} GROUP BY {key}" for t, key in MASTERS.items()),
}

#: Bases as Spark scans them: rows that a check can count by the bounds of what they are compared with, so that the others
#: are not moved to every parent. No row is before one parent's creation that is not before the latest of them.
NARROWED = {
    "m_parents": """SELECT impression_timestamp, l_created_at, r.created_at AS r_created_at, p.created_at AS p_created_at
        FROM (SELECT i.creative_id, i.placement_id, i.impression_timestamp, l.created_at AS l_created_at
          FROM {impressions} i JOIN {line_items} l ON i.line_item_id = l.line_item_id
          WHERE i.impression_timestamp < l.created_at OR i.impression_timestamp < (SELECT max(created_at) FROM {creatives})
            OR i.impression_timestamp < (SELECT max(created_at) FROM {placements})) x
        JOIN {creatives} r ON x.creative_id = r.creative_id JOIN {placements} p ON x.placement_id = p.placement_id""",
}

#: The checks over several tables.
ALL_TABLES = [c for c in BUSINESS + TEMPORAL + UNIQUENESS if c.base.startswith("m_")]


def _pair(table: str, where: str) -> str:
    """Silver and source rows of a table side by side; the source differs in planted places."""
    key = MASTERS[table]
    return f"FROM {_silver(table)} s JOIN {_source(table)} p ON s.{key} = p.{key} WHERE {where}"


def _silver(table: str) -> str:
    """The newest captures as a current-state table, some rows of which never arrived."""
    return f"(SELECT * FROM {{{table}_log}} WHERE capture = 4 AND CAST({MASTERS[table]} AS BIGINT) % 13 <> 0)"


def _source(table: str) -> str:
    """What the source holds: live rows, less some that are gone unnoticed, and some deleted ones that are back."""
    number = f"CAST({MASTERS[table]} AS BIGINT)"
    return f"(SELECT * FROM {{{table}_log}} WHERE capture = 4 AND (NOT is_deleted OR {number} % 14 = 0) AND {number} % 11 <> 0)"


def _missing(one, other) -> str:
    """Keys of every member table on one side and not on the other."""
    return " UNION ALL ".join(
        f"SELECT a.{key} AS id FROM {one(t)} a LEFT JOIN {other(t)} b ON a.{key} = b.{key} WHERE b.{key} IS NULL" for t, key in MASTERS.items()
    )


def _live(table: str) -> str:
    return f"(SELECT * FROM {_silver(table)} x WHERE NOT is_deleted)"


def _differs(column: str, key: str, other: str) -> str:
    return f"s.{column} AS s_{column}, CASE WHEN CAST(p.{key} AS BIGINT) % 17 = 0 THEN {other} ELSE p.{column} END AS p_{column}"


#: The tables whose deletions the source is asked about.
DELETABLE = ("campaigns", "creatives", "line_items", "publishers", "audiences")

BASES |= {
    "r_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {_source(t)} p) AS source_rows, (SELECT count(*) FROM {_live(t)} s) AS live_rows" for t in MASTERS
    ),
    "r_not_in_silver": _missing(_source, _live),
    "r_not_in_source": _missing(_live, _source),
    "r_campaigns": f"SELECT {_differs('campaign_status', 'campaign_id', chr(39) + 'DRAFT' + chr(39))}, s.daily_budget AS s_daily_budget, p.daily_budget AS p_daily_budget "
    + _pair("campaigns", "NOT s.is_deleted"),
    "r_line_items": f"SELECT {_differs('bid_amount', 'line_item_id', 'p.bid_amount + 1')} " + _pair("line_items", "NOT s.is_deleted"),
    "r_creatives": f"SELECT {_differs('creative_status', 'creative_id', 'NULL')} " + _pair("creatives", "NOT s.is_deleted"),
    "r_publishers": f"SELECT {_differs('publisher_status', 'publisher_id', 'NULL')} " + _pair("publishers", "NOT s.is_deleted"),
    "r_deleted": " UNION ALL ".join(f"SELECT s.{MASTERS[t]} AS id {_pair(t, 's.is_deleted')}" for t in DELETABLE),
}

RECONCILIATION = _many("reconciliation", [
    ("reconciliation_live_row_counts_match", "r_counts", "source_rows <> live_rows"),
    ("reconciliation_rows_missing_from_silver", "r_not_in_silver", "true"),
    ("reconciliation_rows_missing_from_source", "r_not_in_source", "true"),
    ("reconciliation_campaign_values_match", "r_campaigns", "s_campaign_status IS DISTINCT FROM p_campaign_status OR s_daily_budget IS DISTINCT FROM p_daily_budget"),
    ("reconciliation_line_item_bids_match", "r_line_items", "s_bid_amount IS DISTINCT FROM p_bid_amount"),
    ("reconciliation_creative_status_matches", "r_creatives", "s_creative_status IS DISTINCT FROM p_creative_status"),
    ("reconciliation_publisher_status_matches", "r_publishers", "s_publisher_status IS DISTINCT FROM p_publisher_status"),
    ("reconciliation_soft_deletes_are_gone_from_the_source", "r_deleted", "true"),
])

#: Over a current-state table ``c_state`` and what it came from.
INTEGRITY = _many("integrity", [
    ("silver_duplicate_primary_keys", "s_keys", "n > 1"),
    ("silver_null_primary_keys", "s_state", "user_id IS NULL"),
    ("silver_deleted_rows_have_a_deletion_time", "s_state", "is_deleted AND deleted_at IS NULL"),
    ("silver_live_rows_have_no_deletion_time", "s_state", "NOT is_deleted AND deleted_at IS NOT NULL"),
    ("silver_duplicate_impression_ids", "b_impression_ids", "n > 1"),
    ("silver_event_tables_have_no_deletions", "s_events", "is_deleted"),
])
LINEAGE = _many("lineage", [
    ("lineage_snapshot_rows_carry_no_change_metadata", "s_state", "_lsn IS NULL AND (_op IS NOT NULL OR _event_ts IS NOT NULL)"),
    ("lineage_changed_rows_carry_a_known_operation", "s_state", "_lsn IS NOT NULL AND (_op IS NULL OR _op NOT IN ('c', 'u', 'd', 'r'))"),
    ("lineage_delete_flag_agrees_with_the_operation", "s_state", "_op IS NOT NULL AND (_op = 'd') <> is_deleted"),
    ("lineage_soft_deletes_came_from_a_change_event", "s_state", "is_deleted AND _lsn IS NULL"),
    ("lineage_applied_changes_postdate_the_snapshot_export", "s_state", "_lsn <= boundary"),
    ("lineage_event_tables_were_never_merged", "s_events", "_lsn IS NOT NULL"),
])

ADVERTISING = REFERENTIAL + TEMPORAL + BUSINESS + UNIQUENESS + JOINS + ROW_RULES


def as_sql(checks: list[Check], bases: dict[str, str]) -> str:
    """The same observations, one statement per check."""
    parts = []
    plain = lambda text: text.replace("rlike(", "regexp_matches(")
    for c in checks:
        good = "observed = 0" if c.expect == "zero" else "observed > 0"
        bad = "FAIL" if c.severity == "ERROR" else "WARN"
        parts.append(
            f"SELECT '{c.name}' AS name, '{c.type}' AS type, '{c.severity}' AS severity, '{c.expect}' AS expect, observed, "
            f"CASE WHEN {good} THEN 'PASS' ELSE '{bad}' END AS status "
            f"FROM (SELECT count(*) AS observed FROM ({plain(bases[c.base])}) b WHERE {plain(c.predicate)}) o"
        )
    return " UNION ALL ".join(parts)
