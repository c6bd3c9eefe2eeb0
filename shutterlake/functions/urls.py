"""Object keys and image URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.text import given

RAW_BUCKET = "iot-raw"
ANNOTATED_BUCKET = "iot-annotated"
# Hosts that are only reachable inside the deployment.
INTERNAL_HOSTS = ["minio:9000", "localhost:9000", "127.0.0.1:9000"]


def path_of(url: Column) -> Column:
    """Path of an absolute URL without query, leading slash dropped; null otherwise."""
    return given(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^?#]*)", 1))


def object_key(url: Column, bucket: str = RAW_BUCKET) -> Column:
    """Object key behind a console link, a direct URL or a bare path."""
    path = path_of(url)
    prefix = given(F.regexp_extract(url, r"[?&]prefix=([^&#]*)", 1))
    decoded = F.try_to_binary(F.replace(prefix, F.lit("%3D"), F.lit("=")), F.lit("base64")).cast("string")
    without_bucket = F.when(path.contains("/"), F.regexp_replace(path, r"^[^/]*/+", "")).otherwise(path)
    return (
        F.when(path.isNull(), F.regexp_replace(url, rf"^/?{bucket}/", ""))
        .when(prefix.isNotNull() & path.contains("api/v1/buckets/"), decoded)
        .otherwise(without_bucket)
    )


def key_after_bucket(url: Column, bucket: str = RAW_BUCKET) -> Column:
    """Key after the named bucket segment, query dropped; a bare path is a key;
    an absolute URL without the bucket gives null."""
    clean = F.regexp_replace(url, r"[?#].*$", "")
    found = given(F.regexp_extract(clean, rf"/{bucket}/+(.*)$", 1))
    return F.coalesce(found, F.when(~url.startswith("http"), url))


def public_url(key: Column, domain: str, bucket: str = RAW_BUCKET, https: bool = False) -> Column:
    """Console download link carrying the key as base64."""
    scheme = "https" if https or domain.startswith("https://") else "http"
    host = domain.removeprefix("https://").removeprefix("http://")
    return F.concat(
        F.lit(f"{scheme}://{host}/api/v1/buckets/{bucket}/objects/download?preview=true&prefix="),
        F.base64(F.encode(key, "UTF-8")),
        F.lit("&version_id=null"),
    )


def to_public(
    url: Column, domain: str | None = None, bucket: str = RAW_BUCKET,
    fallback_host: str = "localhost:1442", https: bool = False,
) -> Column:
    """Internal URL → public one; other URLs unchanged.

    With a public domain and a key in the bucket the console link is built;
    otherwise the host is replaced and the query dropped.
    """
    internal = F.lit(False)
    for host in INTERNAL_HOSTS:
        internal = internal | url.contains(host)
    clean = F.regexp_replace(url, r"\?.*$", "")
    hosts = "|".join(host.replace(".", r"\.") for host in INTERNAL_HOSTS)
    scheme = "https" if https else "http"
    replaced = F.regexp_replace(clean, rf"https?://({hosts})", f"{scheme}://{fallback_host}")
    if domain:
        key = given(F.regexp_extract(clean, rf"^[^:]+://[^/]+/(?:[^/]+/)*?{bucket}/+(.+)$", 1))
        replaced = F.when(key.isNotNull(), public_url(key, domain, bucket, https)).otherwise(replaced)
    return F.when(internal, replaced).otherwise(url)


def capture_key(device_id: Column, taken_at: Column, stored_at: Column, shot_id: Column) -> Column:
    """`raw/yyyy/MM/dd/device/millis_shot.jpg`, shot cut to its last six characters."""
    shot = F.coalesce(F.right(given(shot_id), F.lit(6)), F.lit("na"))
    return F.concat(
        F.lit("raw/"), F.date_format(taken_at, "yyyy/MM/dd"), F.lit("/"), device_id, F.lit("/"),
        F.unix_millis(stored_at).cast("string"), F.lit("_"), shot, F.lit(".jpg"),
    )


def annotated_key(device_id: Column, timestamp_text: Column, shot_id: Column) -> Column:
    """`device/yyyy-MM-dd_HH-mm-ssZ_shot_annotated.jpg` from the ISO event time."""
    stamp = F.replace(F.replace(timestamp_text, F.lit(":"), F.lit("-")), F.lit("T"), F.lit("_"))
    return F.concat(device_id, F.lit("/"), stamp, F.lit("_"), shot_id, F.lit("_annotated.jpg"))


def move_host(url: Column, old: str = "localhost:9000", new: str = "localhost:9002") -> Column:
    return F.replace(url, F.lit(old), F.lit(new))


def is_signed(url: Column) -> Column:
    return url.contains("?X-Amz-") | url.contains("%3FX-Amz-")


def signable_key(url: Column, bucket: str = RAW_BUCKET) -> Column:
    """Key to sign for a local direct URL; null when signed already or of another form."""
    path = given(F.regexp_extract(url, r"localhost:900[02]/([^?]*)", 1))
    return F.when(~is_signed(url), F.regexp_replace(path, rf"^{bucket}/", ""))
