"""Hash and identity functions of the dialect as Spark SQL; digests are bytes."""

from __future__ import annotations

from tessera.functions.expr import template

template("MD5", "unhex(md5({0}))", "BYTES")
template("SHA1", "unhex(sha1({0}))", "BYTES")
template("SHA256", "unhex(sha2({0}, 256))", "BYTES")
template("SHA512", "unhex(sha2({0}, 512))", "BYTES")
template("FARM_FINGERPRINT", "ts_farm_fingerprint(cast({0} AS binary))", "INT64")
template("GENERATE_UUID", "uuid()", "STRING")
template("BIT_COUNT", "cast(bit_count({0}) AS bigint)", "INT64")
template("ERROR", "raise_error({0})")
