"""Passwords, tokens and access: hashing and signing from the standard library."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COST, BLOCK, LANES = 1 << 14, 8, 1  # of scrypt
PUBLIC_METHODS = ("Login", "Register", "Health")  # need no token


def hash_password(password: str, salt: bytes | None = None) -> str:
    """``$scrypt$n,r,p$salt$hash``."""
    salt = salt or os.urandom(16)
    key = hashlib.scrypt(password.encode(), salt=salt, n=COST, r=BLOCK, p=LANES, dklen=32)
    return "$".join(["", "scrypt", f"{COST},{BLOCK},{LANES}", *(base64.b64encode(x).decode() for x in (salt, key))])


def verify_password(password: str, held: str) -> bool:
    try:
        _, kind, cost, salt, key = held.split("$")
        n, r, p = map(int, cost.split(","))
        own = hashlib.scrypt(password.encode(), salt=base64.b64decode(salt), n=n, r=r, p=p, dklen=32)
        return kind == "scrypt" and hmac.compare_digest(own, base64.b64decode(key))
    except ValueError:
        return False


def with_hash(users: DataFrame, password: str = "password") -> DataFrame:
    """``users`` with ``password_hash`` in place of the password; NULL stays NULL."""

    @F.pandas_udf("string")
    def hashed(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else hash_password(w))

    return users.withColumn("password_hash", hashed(F.col(password))).drop(password)


def _part(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def issue_token(user_id: str, roles: list[str], key: bytes, seconds: float) -> str:
    """A signed token (HS256) of a user, good for so many seconds."""
    head, body = (_part(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, {"user_id": user_id, "roles": roles, "exp": int(time.time() + seconds)}))
    return f"{head}.{body}.{_part(hmac.digest(key, f'{head}.{body}'.encode(), 'sha256'))}"


def read_token(token: str, key: bytes) -> dict | None:
    """What a token says; None if it is forged, malformed or out of date."""
    try:
        head, body, sign = token.split(".")
        wanted = _part(hmac.digest(key, f"{head}.{body}".encode(), "sha256"))
        pad = lambda s: base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))
        if not hmac.compare_digest(sign, wanted) or json.loads(pad(head)).get("alg") != "HS256":
            return None
        said = json.loads(pad(body))
        return said if said["exp"] > time.time() else None
    except (ValueError, KeyError):
        return None


def allowed(method: Column, authorization: Column, public: tuple[str, ...] = PUBLIC_METHODS) -> Column:
    """Whether a call may go ahead: a public method, or one with a bearer token (which ``read_token`` checks)."""
    return F.coalesce(method.isin(*public), F.lit(False)) | F.coalesce(authorization.rlike(r"^Bearer \S+$"), F.lit(False))
