"""Schemas of the lead tables. The canonical column order is a contract with the files' consumers."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_A = T.ArrayType(T.StringType())
RAW_EXTRACTED = T.StructType([T.StructField("title", _S), T.StructField("meta_description", _B), T.StructField("has_reviews", _B)])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LEAD = _struct(
    id=_S, search_keyword=_S, search_location=_S, order_ids=_A, query_type=_S, name=_S, url=_S, website=_S, rating=_D, reviews=_I,
    category=_S, phone=_S, phone_type=_S, scraped_date=_TS, emails=_S, alternative_phones=_S, linkedin=_S, facebook=_S, twitter=_S,
    instagram=_S, data_status=_S, found_web_mobile=_S, is_valid=_B, lead_status=_S, first_seen_date=_TS, last_updated_date=_TS,
    dead_email=_B, enriched_at=_TS, enrichment_version=_I, http_status=_I, domain_state=_S, ssl_status=_S, mobile_friendly=_B,
    has_contact_info=_B, quality_score=_I, tags=_A, last_checked_at=_TS, raw_extracted=RAW_EXTRACTED,
)
LEAD_COLUMNS = LEAD.fieldNames()
#: What a parsed page gives; the first 14 columns of LEAD.
RAW_LEAD_COLUMNS = LEAD_COLUMNS[:14]
TEXT_COLUMNS = [f.name for f in LEAD if isinstance(f.dataType, T.StringType)]
TASK = _struct(
    task_id=_S, task_key=_S, target_url=_S, task_type=_S, search_keyword=_S, search_location=_S, order_ids=_A, query_type=_S,
    minimum_reviews=_I, priority=_I, status=_S, worker_id=_S, attempt_count=_I, max_attempts=_I, lease_until=_TS, started_at=_TS,
    completed_at=_TS, last_error=_S, created_at=_TS, updated_at=_TS, parse_status=_S, parse_attempts=_I, parse_lease_until=_TS,
)
PAGE_HEADER = _struct(hash_id=_S, order_ids=_A, query_type=_S, scraped_date=_S, Search_Keyword=_S, Search_Location=_S, minimum_reviews=_I)
ORDER = _struct(
    order_id=_S, client_name=_S, keywords=_A, locations=_A, direct_queries=_A, bounding_box=_S, minimum_reviews=_I,
    max_leads_required=_I, step_size=_D, zoom=_I,
)
