"""Declared schemas. Nothing in this package infers one from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _D, _L, _I, _B, _TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(),
    T.TimestampNTZType(),
)

# Clean outages; sources cast their strings to these types.
OUTAGES = _struct(
    incident_reference_number=_S, incident_date_time=_TS, restoration_date_time=_TS,
    incident_duration=_L, customer_affected=_L, total_customer_minutes_lost=_L,
    direct_cause_category=_S, direct_cause=_S, network_type=_S, voltage=_S, district_code=_I,
    district_name=_S, primary_substation=_S, main_equipment_involved_1=_S,
    main_equipment_involved_2=_S, main_equipment_involved_3=_S, main_equipment_involved_4=_S,
    main_equipment_involved_5=_S, main_equipment_involved_6=_S, exceptional_event_id=_S,
    local_authority=_S, latitude=_D, longitude=_D,
)

SITES = _struct(charge_point_location=_S, site_category=_S, latitude=_D, longitude=_D)

PREDICTIONS = _struct(
    lat=_D, lon=_D, risk_level=_S, confidence=_D, prob_low=_D, prob_medium=_D, prob_high=_D,
)

INCIDENTS = _struct(
    incident_num=_S, incident_type=_S, outage_time=_TS, customers_affected=_I,
    customers_off_supply=_I, incident_status=_S, estimated_restoration_time=_TS, latitude=_D,
    longitude=_D,
)

# Tender properties in a GeoJSON feature (fixed field names of the feed).
TENDER_FIELDS = (
    "substation_name", "post_codes", "voltage_of_connection_kv", "maximum_requirement_mva",
    "need_type", "delivery_start_date", "months_required", "times_required", "days_required",
    "maximum_utilisation_price_mw", "estimated_availability_hours",
    "estimated_utilisation_hours", "easting", "northing", "lat", "long", "period",
    "geo_point_2d", "site_number", "ceiling_price_period",
)

LONG_LIST_COLUMNS = {
    "Town/ Village": "town",
    "Potential Sites": "potential_sites",
    "Brief Description": "brief_description",
    "Local Authority Area": "local_authority",
}

POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(_D)))
MULTIPOLYGON = T.ArrayType(POLYGONS)
