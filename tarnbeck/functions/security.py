"""Keyed hashes, signed tokens and field encryption."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_hex(secret: str) -> Callable[[Column], Column]:
    """HMAC-SHA256 of a binary column in hex (null for null)."""

    @F.pandas_udf("string")
    def run(body: pd.Series) -> pd.Series:
        return body.map(lambda b: None if b is None else hmac.new(secret.encode(), b, hashlib.sha256).hexdigest())

    return run


def sign_token(expires: Column, path: Column, secret: str) -> Column:
    """``<expiry>.<signature>`` over the path and the expiry."""
    e = expires.cast("string")
    return F.concat(e, F.lit("."), hmac_hex(secret)(F.encode(F.concat(path, F.lit(":"), e), "utf-8")))


def token_valid(token: Column, path: Column, now: Column, secret: str) -> Column:
    """Whether a token's signature is right and its expiry is not past."""
    e = F.regexp_extract(token, r"^(.*)\.[^.]*$", 1)
    return (token == sign_token(e, path, secret)) & F.coalesce(e.try_cast("double") >= now, F.lit(False))


def encrypt(value: Column, key: str, version: str) -> Column:
    """``<key version>:<AES-GCM, base64>``; the key has 16, 24 or 32 characters."""
    return F.concat(F.lit(f"{version}:"), F.base64(F.aes_encrypt(value, F.lit(key), F.lit("GCM"))))


def decrypt(value: Column, keys: dict[str, str]) -> Column:
    """The plain text under any of the keys by version; null where the version is unknown."""
    version, body = F.substring_index(value, ":", 1), F.unbase64(F.regexp_replace(value, "^[^:]*:", ""))
    out: Column = F.lit(None).cast("string")
    for name, key in keys.items():
        out = F.when(version == name, F.aes_decrypt(body, F.lit(key), F.lit("GCM")).cast("string")).otherwise(out)
    return out
