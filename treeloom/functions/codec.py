"""Encodings, digests and keyed digests as column expressions; Arrow UDFs only where Spark has no function."""

from __future__ import annotations

import base64 as b64
import hashlib
import hmac as hm

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def base64(data: Column, wrap: int = 0) -> Column:
    """Base64 text; with wrap > 0, a line break after every `wrap` characters."""
    text = F.regexp_replace(F.base64(data), r"[\r\n]", "")
    return text if not wrap else F.rtrim(F.regexp_replace(text, f"(.{{{wrap}}})", "$1\n"), F.lit("\n")) if wrap else text


def unbase64(text: Column) -> Column:
    """Bytes of base64 text; white space in it is passed over. Null where it is none."""
    return F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64"))


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(base64(data), "+/", "-_"), F.lit("="))


def unbase64url(text: Column) -> Column:
    """Bytes of base64 text in letters for URLs, without padding; null where it is none."""
    plain = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def unhex(text: Column) -> Column:
    return F.unhex(text)


def md5(data: Column) -> Column:
    return F.md5(data)


def sha1(data: Column) -> Column:
    return F.sha1(data)


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def random_token() -> Column:
    """16 random bytes in hex; a new value for each row and run."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


@pandas_udf(T.StringType())
def base32(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else b64.b32encode(x if isinstance(x, bytes) else x.encode()).decode())


@pandas_udf(T.BinaryType())
def unbase32(text: pd.Series) -> pd.Series:
    """Bytes of base32 text; white space in it is passed over. Null where it is none."""

    def one(x):
        x = "".join(x.split()).upper()
        try:
            return b64.b32decode(x + "=" * (-len(x) % 8))
        except ValueError:
            return None

    return text.map(lambda x: None if x is None else one(x))


def hmac(data: Column, key: Column | bytes, digest: str = "sha256") -> Column:
    """Keyed digest of data (string or binary) as binary; digest: md5, sha1 or sha256. A key that is given as bytes takes two built-in digests only."""
    if digest not in ("md5", "sha1", "sha256"):
        raise ValueError(f"unknown digest {digest}")
    if isinstance(key, bytes):
        block = (hashlib.new(digest, key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        inner, outer = (F.lit(bytearray(x ^ y for x in block)) for y in (0x36, 0x5C))
        hashed = lambda x: F.unhex({"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[digest](x))
        return hashed(F.concat(outer, hashed(F.concat(inner, data.cast("binary")))))

    @pandas_udf(T.BinaryType())
    def run(d: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hm.new(b, a, digest).digest() for a, b in zip(d, k, strict=True)])

    return run(data.cast("binary"), key.cast("binary"))


def pbkdf2(password: Column, salt: Column, iterations: int = 30000, length: int = 32, digest: str = "sha256") -> Column:
    @pandas_udf(T.BinaryType())
    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hashlib.pbkdf2_hmac(digest, a, b, iterations, length) for a, b in zip(p, s, strict=True)])

    return run(password.cast("binary"), salt.cast("binary"))


def encode_password(password: Column, salt: Column, iterations: int = 30000) -> Column:
    """'!pbkdf2_sha256$iterations$salt$key', key in base64."""
    return F.concat(F.lit(f"!pbkdf2_sha256${iterations}$"), salt, F.lit("$"), base64(pbkdf2(password, salt, iterations)))


@pandas_udf(T.BooleanType())
def password_matches(stored: pd.Series, password: pd.Series) -> pd.Series:
    def one(s, p):
        if s is None or p is None:
            return None
        part = s.split("$")
        if len(part) != 4 or part[0] != "!pbkdf2_sha256" or not part[1].isdigit():
            return False
        try:
            want = b64.b64decode(part[3], validate=True)
        except ValueError:
            return False
        if not want:
            return False
        return hm.compare_digest(want, hashlib.pbkdf2_hmac("sha256", p.encode(), part[2].encode(), int(part[1]), len(want)))

    return pd.Series([one(s, p) for s, p in zip(stored, password, strict=True)])
