"""Identity and hashing as Column expressions (no Python in the row path)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"
# fixed values: name-based identifier spaces of claims and certificates
CLAIM_SPACE = "56ce789b-bcdf-5b26-a3fa-af0a5ab6fe92"
CERTIFICATE_SPACE = "43a4658d-4204-5bdd-8b30-3eb25313a4ad"


def _bytes(c: Column) -> Column:
    return F.encode(c, "utf-8")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest from two nested ``sha2`` calls; ``message`` is binary, the result is lower hex."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), digest), 256)


def subject_token(raw: Column, pepper: bytes) -> Column:
    """``sub_`` + 32 hex of the keyed digest of the trimmed, lower-cased identifier; blank gives NULL.

    ``lower`` is Spark's case mapping: it differs from full case folding for a few letters (sharp s).
    """
    if len(pepper) < 16:
        raise ValueError("the pepper needs at least 16 bytes")
    norm = F.lower(F.trim(raw))
    return F.when(norm != "", F.concat(F.lit("sub_"), F.substring(hmac_sha256(pepper, _bytes(norm)), 1, 32)))


def uuid5(space: str, text: Column) -> Column:
    """Name-based identifier, version 5: SHA-1 of the space bytes and the text, with the fixed bits."""
    h = F.sha1(F.concat(F.lit(bytearray(bytes.fromhex(space.replace("-", "")))), _bytes(text)))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)))
                            .bitwiseOR(F.lit(0x80)).cast("long")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
                    F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def claim_id(source: Column, event_id: Column) -> Column:
    return uuid5(CLAIM_SPACE, F.concat_ws(SEP, source, event_id))


def mandate_ref(raw: Column) -> Column:
    return F.when(F.length(raw) > 0, F.concat(F.lit("mnd_"), F.substring(F.sha2(_bytes(raw), 256), 1, 32)))


def unit_draw(text: Column) -> Column:
    """Uniform draw in [0,1): the first eight digest bytes over 2^64.  Reproducible, unlike ``rand``."""
    head = F.conv(F.substring(F.sha2(_bytes(text), 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2 ** 64))


def arm_draw(experiment: str, stratum: Column, token: Column) -> Column:
    return unit_draw(F.concat_ws(SEP, F.lit(experiment), stratum, token))


def pick_by_share(draw: Column, names: list[str]) -> Column:
    """First name whose running share exceeds the draw (shares added in float, as a running sum)."""
    share, running, out = 1.0 / len(names), 0.0, None
    for n in names:
        running += share
        out = F.when(draw < running, n) if out is None else out.when(draw < running, n)
    return out.otherwise(names[-1])


def signature_ok(raw: Column, signature: Column, source: Column, secrets: dict[str, bytes]) -> Column:
    """Does ``t=<sec>,v1=<hex>`` sign the raw bytes with the secret of this source?"""
    t = F.regexp_extract(signature, r"^t=(\d+),v1=([0-9a-f]{64})$", 1)
    v1 = F.regexp_extract(signature, r"^t=(\d+),v1=([0-9a-f]{64})$", 2)
    message = F.concat(_bytes(F.concat(t, F.lit("."))), raw)
    out = F.lit(False)
    for name, secret in secrets.items():
        out = F.when(source == name, hmac_sha256(secret, message) == v1).otherwise(out)
    return F.coalesce((v1 != "") & out, F.lit(False))


def signed_at(signature: Column) -> Column:
    t = F.regexp_extract(signature, r"^t=(\d+),v1=([0-9a-f]{64})$", 1)
    return F.timestamp_seconds(F.when(t != "", t).try_cast("long"))


def category_bucket(value: Column, buckets: int = 64) -> Column:
    """Sum of byte · (31^i mod 1000003), modulo 64; NULL for an empty value.

    The power is carried along the bytes, so a value may have any length.
    """
    hexed = F.hex(_bytes(value))
    positions = F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("p"))
    total = F.aggregate(
        positions, start,
        lambda acc, i: F.struct((acc["s"] + F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long") * acc["p"]).alias("s"),
                                (acc["p"] * 31 % 1000003).alias("p")),
        lambda acc: acc["s"])
    return F.when(F.length(value) > 0, (total % buckets).cast("double"))


def fingerprint(value: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(_bytes(value), 256), 1, digits)


def chain_step(prev_hex: Column, body: Column) -> Column:
    """Entry hash of a ledger row: SHA-256 of the previous hash bytes followed by the body bytes."""
    return F.sha2(F.concat(F.unhex(prev_hex), _bytes(body)), 256)


GENESIS = "0" * 64
