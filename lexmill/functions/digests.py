"""Digests as columns; HMAC, which has no built-in, in Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def base64url(c: Column) -> Column:
    """base64 with the URL alphabet, without padding."""
    return F.rtrim(F.translate(F.base64(c), "+/", "-_"), F.lit("="))


def hmac_sha256(secret: str):
    """Column function: base64url of the HMAC-SHA256 of a text under a secret."""

    @F.pandas_udf(StringType())
    def sign(s: pd.Series) -> pd.Series:
        one = lambda x: base64.urlsafe_b64encode(hmac.new(secret.encode(), x.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
        return s.map(lambda x: None if x is None else one(x))

    return sign


def token_valid(issued: Column, at: Column, hours: int = 12) -> Column:
    """Whether a session issued at a time is still good."""
    return (at >= issued) & (at < issued + F.make_dt_interval(hours=F.lit(hours)))
