"""URL query parameters, read the way a browser reads them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Parameter names of the application link.
ATTRIBUTION_PARAMS = [
    "app", "utm_id", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "utm_source_platform",
]
PREFILL_PARAMS = [
    "first_name", "last_name", "full_name", "email", "phone", "business_legal_name", "ein",
    "amount_requested", "start_date", "dob", "business_street", "business_city",
    "business_state", "business_zip", "owner_street", "owner_city", "owner_state", "owner_zip",
    "prefill", "contact_id", "recipient_id", "message_id", "application_id", "entry_id",
]
# Name to longest kept length.
UNDERWRITING_PARAMS = {
    "avg_monthly_deposits": 100,
    "total_mca_debits": 100,
    "avg_balance": 100,
    "avg_negative_balance_days": 100,
    "open_mca": 600,
}
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "ID", "IL", "IN",
    "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH",
    "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT",
    "VT", "VA", "WA", "WV", "WI", "WY",
]


def query_text(url: Column) -> Column:
    """What stands between the first question mark and the fragment; a question mark in the fragment opens no query."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def decode(value: Column) -> Column:
    """Percent-decoded text; a percent sign that starts no code stands for itself."""
    sound = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(sound), value)


def pairs(url: Column) -> Column:
    """Query parameters in order as (name, value, raw); each is decoded once."""
    given = F.filter(F.split(query_text(url), "&"), lambda p: p != "")
    return F.transform(
        given,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("name"),
            decode(F.regexp_replace(p, r"^[^=]*=?", "")).alias("value"),
            p.alias("raw"),
        ),
    )


def param(url_pairs: Column, name: str) -> Column:
    """First value of a parameter; NULL when absent."""
    return F.get(F.filter(url_pairs, lambda p: p["name"] == name), F.lit(0))["value"]


def without_params(url: Column, names: list[str]) -> Column:
    """The URL without the named parameters; order and repeats of others stay."""
    kept = F.filter(pairs(url), lambda p: ~p["name"].isin(names))
    query = F.array_join(F.transform(kept, lambda p: p["raw"]), "&")
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)^[^#]*(#.*)\z", 1)
    return F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), fragment)


def bucket_and_object(uri: Column) -> tuple[Column, Column]:
    """Bucket and object of a storage URI; NULL when it is not one."""
    pattern = r"^gs://([^/]+)/(.+)$"
    return tuple(F.when(uri.rlike(pattern), F.regexp_extract(uri, pattern, i)) for i in (1, 2))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """Folder part of an object name; NULL when it has none."""
    return F.when(path.rlike(r"^.+/[^/]+$"), F.regexp_extract(path, r"^(.+)/[^/]+$", 1))
