"""Row ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t


def contact_id(source_url: Column, full_name: Column, found: Column, generated: Column) -> Column:
    """SHA-256 over the four identifying columns, NULL as the empty string."""
    parts = [F.coalesce(c, F.lit("")) for c in (source_url, full_name, found, generated)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def url_uuid5(key: Column) -> Column:
    """UUID version 5 in the URL namespace."""
    name_space = F.unhex(F.lit(uuid.NAMESPACE_URL.hex))
    digest = F.sha1(F.concat(name_space, F.encode(key, "UTF-8")))
    nibble = F.substr(
        F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1)
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(nibble, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def crm_id(email: Column, full_name: Column, source_url: Column) -> Column:
    """from the address, else from name and page, so reruns give the same id."""
    key = F.lower(t.strip(F.coalesce(email, F.lit(""))))
    fallback = F.concat(t.strip(F.coalesce(full_name, F.lit(""))), F.lit("|"), F.coalesce(source_url, F.lit("")))
    return url_uuid5(F.when(key != "", key).otherwise(fallback))
