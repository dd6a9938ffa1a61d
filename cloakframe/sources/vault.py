"""Encrypted export and import of the vault table.

One key per export is derived on the driver from a password. It reaches the tasks as the one row of a
broadcast table, so it shows neither in plans nor in the UI and no row passes through Python;
encryption itself is Spark's AES-GCM with a random IV per row.
"""

from __future__ import annotations

import base64
import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Container format.
FORMAT, VERSION = "cloakframe-vault", 1
AAD = "cloakframe-vault-v1"
ITERATIONS = 310_000
MIN_PASSWORD = 10
_ENTRY = "struct<token:string,value:string,type:string,label:string>"


class VaultError(ValueError):
    pass


def derive_key(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def _keyed(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows`` with the key as ``_key``, from a table of one row that is broadcast: as data it shows in no plan, as a literal it would."""
    one = rows.sparkSession.createDataFrame([(0, bytearray(key))], "_one int, _key binary")
    return rows.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")


def encrypt_vault(vault: DataFrame, password: str, *, aad: str = AAD) -> DataFrame:
    """One container row per document: (doc_id, format, version, kdf, cipher, data)."""
    if len(password) < MIN_PASSWORD:
        raise VaultError(f"the password needs at least {MIN_PASSWORD} characters")
    salt = os.urandom(16)
    key = derive_key(password, salt)
    packed = vault.groupBy("doc_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("token", "value", "type", "label")))).alias("_plain")
    )
    kdf = F.struct(
        F.lit("PBKDF2").alias("name"), F.lit("SHA-256").alias("hash"), F.lit(ITERATIONS).alias("iterations"),
        F.lit(base64.b64encode(salt).decode()).alias("salt"),
    )
    sealed = F.aes_encrypt("_plain", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.lit(aad))
    return _keyed(packed, key).select(
        "doc_id", F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), kdf.alias("kdf"),
        F.lit("AES-256-GCM").alias("cipher"), sealed.alias("data"),
    )


def decrypt_vault(
    container: DataFrame, password: str, *, aad: str = AAD, fmt: str = FORMAT, version: int = VERSION
) -> DataFrame:
    """Vault rows of a container. A wrong password, tampering or a foreign format is refused.

    Containers of one export share a salt, so one key serves all rows; the distinct KDF
    headers are read first and must be one.
    """
    heads = container.select("format", "version", "kdf").distinct().limit(2).collect()
    if len(heads) != 1 or heads[0]["format"] != fmt or heads[0]["version"] != version:
        raise VaultError("not one supported vault container")
    kdf = heads[0]["kdf"]
    key = derive_key(password, base64.b64decode(kdf["salt"]), kdf["iterations"])
    opened = F.try_aes_decrypt("data", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string")
    entries = _keyed(container, key).select(
        "doc_id", F.from_json(opened, f"array<{_ENTRY}>").alias("e")
    )
    checked = F.when(F.col("e").isNull(), F.raise_error(F.lit("vault cannot be opened"))).otherwise(F.col("e"))
    return entries.select("doc_id", F.explode_outer(checked).alias("v")).filter("v IS NOT NULL").select("doc_id", "v.*")
