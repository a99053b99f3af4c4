"""Hashes, checksums and span bytes as expressions."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the compatible hash: multiplier, rotation of numbers and of bytes.
MULTIPLIER, ROTATE_LONG, ROTATE_BYTES = 40343, 43, 6
#: Fixed values of a span's 4-byte header: unserialized and metadata bits, largest length.
UNSERIALIZED, METADATA, LENGTH_MASK = 1 << 31, 1 << 30, (1 << 30) - 1
WORD = 1 << 64


def _decimal(x: Column | int) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast("decimal(38,0)")


def _signed(x: Column) -> Column:
    """The 64 bits of a decimal as a long."""
    return F.when(x >= _decimal(WORD // 2), x - _decimal(WORD)).otherwise(x).cast("long")


def _rotated(x: Column, n: int) -> Column:
    low = x % _decimal(1 << n)
    return ((x - low) / _decimal(1 << n)).cast("decimal(38,0)") + low * _decimal(1 << (64 - n))


def _mixed(state: Column, add: Column | int) -> Column:
    # Products reach 2**80: decimals hold them, where longs would overflow.
    return ((state * _decimal(MULTIPLIER) + _decimal(add)) % _decimal(WORD)).cast("decimal(38,0)")


def compat_hash_long(key: Column) -> Column:
    """The compatible 64-bit hash of a long (its bits as unsigned), as a long."""
    key, state = key.cast("long"), _decimal(8)
    for shift in (0, 16, 32, 48):
        state = _mixed(state, F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(0xFFFF)))
    return _signed(_rotated(_mixed(state, 0), ROTATE_LONG))


def compat_hash_bytes(data: Column) -> Column:
    """The compatible 64-bit hash of a binary or string, as a long."""
    digits = F.hex(data.cast("binary"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("decimal(38,0)"))
    octets = F.when(F.octet_length(data) > 0, octets).otherwise(F.array().cast("array<decimal(38,0)>"))
    state = F.aggregate(octets, F.octet_length(data).cast("decimal(38,0)"), lambda a, b: _mixed(a, b))
    return _signed(_rotated(_mixed(state, 0), ROTATE_BYTES))


def hash_name(name: str) -> str:
    """The algorithm that ``name`` means, in any case: xxh3, xxh64 or compatible."""
    for known, names in (("xxh3", ("xxh3", "xxhash3")), ("xxh64", ("xxh64", "xxhash64")), ("compatible", ("compatible", "compat"))):
        if name.lower() in names:
            return known
    raise ValueError(f"unknown hash {name}")


def hash64(data: Column, algorithm: str = "xxh3") -> Column:
    """The 64-bit hash of a binary or string, as a long; null of null.

    Spark's own ``xxhash64`` has seed 42 over typed values, so XXH3 and XXH64 of
    seed 0 go through Arrow batches; the compatible hash is an expression.
    """
    known = hash_name(algorithm)
    if known == "compatible":
        return compat_hash_bytes(data)
    return _xxh(known)(data.cast("binary"))


def _xxh(known: str):
    @F.pandas_udf("long")
    def hashed(data: pd.Series) -> pd.Series:
        digest = xxhash.xxh3_64_intdigest if known == "xxh3" else xxhash.xxh64_intdigest
        return pd.Series([None if x is None else (digest(bytes(x)) ^ 1 << 63) - (1 << 63) for x in data], dtype="Int64")

    return hashed


def key_bucket(hashed: Column, table_size: int) -> Column:
    """Bucket of a 64-bit hash."""
    return hashed.bitwiseAND(F.lit(table_size - 1))


def key_tag(hashed: Column) -> Column:
    """14-bit tag of a 64-bit hash, bits 48 to 61."""
    return F.shiftrightunsigned(hashed, 48).bitwiseAND(F.lit(0x3FFF))


def xor_checksum(data: Column) -> Column:
    """XOR of the little-endian 8-byte words of a binary, the last filled with zeros, as a long."""
    digits = F.rpad(F.hex(data.cast("binary")), F.ceil(F.octet_length(data) / 8).cast("int") * 16, F.lit("0"))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(data) / 8).cast("int") - 1, F.lit(0))), lambda i: F.substring(digits, i * 16 + 1, F.lit(16)))
    turned = F.transform(words, lambda w: F.concat(*[F.substring(w, F.lit(15 - 2 * j), F.lit(2)) for j in range(8)]))
    value = F.aggregate(turned, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(_signed(F.conv(w, 16, 10).cast("decimal(38,0)"))))
    return F.when(F.octet_length(data) > 0, value).otherwise(F.lit(0).cast("long"))


def span(payload: Column, metadata: Column | None = None) -> Column:
    """struct(metadata, payload) of a blob."""
    return F.struct((F.lit(None).cast("long") if metadata is None else metadata.cast("long")).alias("metadata"), payload.cast("binary").alias("payload"))


def span_length(value: Column) -> Column:
    """Bytes of a span, its metadata counted."""
    return F.octet_length(value["payload"]) + F.when(value["metadata"].isNotNull(), 8).otherwise(0)


def span_header(value: Column) -> Column:
    """The header: length, with the metadata bit."""
    return span_length(value).cast("long").bitwiseAND(F.lit(LENGTH_MASK)).bitwiseOR(F.when(value["metadata"].isNotNull(), F.lit(METADATA)).otherwise(0).cast("long"))


def span_text(value: Column) -> Column:
    """The payload as text."""
    return F.decode(value["payload"], "UTF-8")


def span_equals(a: Column, b: Column) -> Column:
    """Whether payloads and metadata are equal; null equals null."""
    return a["payload"].eqNullSafe(b["payload"]) & a["metadata"].eqNullSafe(b["metadata"])


def span_hash(value: Column, algorithm: str = "compatible") -> Column:
    """The hash of the payload; metadata takes no part."""
    return hash64(value["payload"], algorithm)


def span_with_metadata(value: Column, metadata: Column | None) -> Column:
    """The span with other metadata, or with none."""
    return span(value["payload"], metadata)


def span_with_length(value: Column, length: Column | int) -> Column:
    """The span with its payload cut, or filled with zero bytes, to ``length`` bytes."""
    length = F.lit(length) if isinstance(length, int) else length
    digits = F.rpad(F.hex(value["payload"]), (length * 2).cast("int"), F.lit("0"))
    return span(F.unhex(digits), value["metadata"])


def _little(digits: Column, octets: int) -> Column:
    return F.concat(*[F.substring(digits, 2 * (octets - i) - 1, 2) for i in range(octets)])


def span_bytes(value: Column) -> Column:
    """The serialized span: the header as 4 little-endian bytes, 8 of metadata if there is any, the payload."""
    header = _little(F.lpad(F.hex(span_header(value)), 8, "0"), 4)
    metadata = F.when(value["metadata"].isNotNull(), _little(F.lpad(F.hex(value["metadata"]), 16, "0"), 8)).otherwise("")
    return F.unhex(F.concat(header, metadata, F.hex(value["payload"])))


def span_of_bytes(data: Column) -> Column:
    """The span that :func:`span_bytes` wrote; null where the bytes are shorter than their header says, or lack one."""
    digits = F.hex(data)
    header = F.conv(_little(F.substring(digits, 1, 8), 4), 16, 10).cast("long")
    length, marked = header.bitwiseAND(F.lit(LENGTH_MASK)), header.bitwiseAND(F.lit(METADATA)) != 0
    start = F.when(marked, 8).otherwise(0)
    metadata = F.when(marked, _signed(F.conv(_little(F.substring(digits, 9, 16), 8), 16, 10).cast("decimal(38,0)")))
    payload = F.unhex(F.substring(digits, 9 + 2 * start, (2 * (length - start)).cast("int")))
    whole = (F.octet_length(data) >= 4) & (length >= start) & (F.octet_length(data) >= 4 + length)
    return F.when(whole, span(payload, metadata))
