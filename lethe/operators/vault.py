"""The key vault: mappings under AES-256-GCM, and key files.

A key file is a marker, then either the key and the ciphertext, or salt, nonce, the length of the wrapped key
(4 bytes, big end first), the wrapped key and the ciphertext. Nothing in it tells whether a passphrase was used.
The marker is this engine's own; files of other writers are read by naming theirs.

Two older layouts are read, not written: their keys and mappings are Fernet tokens (a version byte, eight bytes of time,
the IV, AES-128-CBC, an HMAC over all before it, as URL-safe base 64). With a passphrase: marker, salt, length, the
wrapped key, the mapping; without: the key, marker, the mapping.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lethe.functions.catalog import KEY_BYTES, NONCE_BYTES, PBKDF2_ROUNDS, SALT_BYTES

MARKER = b"::LETHE-3::"
OLD_LOCKED, OLD_PLAIN = b"::LETHE-2::", b"::LETHE-1::"


def new_key() -> bytes:
    return os.urandom(KEY_BYTES)


def derived_key(passphrase: str, salt: bytes, rounds: int = PBKDF2_ROUNDS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, dklen=KEY_BYTES)


@F.udf(BinaryType(), useArrow=True)
def derive(passphrase, salt, rounds):
    """Once for each document with a passphrase: no JVM function derives keys, so rows go to Python in Arrow batches."""
    return None if passphrase is None or salt is None else derived_key(passphrase, bytes(salt), rounds)


def hmac_sha256(key: Column, message: Column) -> Column:
    """Hex HMAC of a BINARY message under a BINARY key of up to 64 bytes, from two hashes of padded keys."""
    padded = F.rpad(F.hex(key), 128, "0")

    inner = F.unhex(F.sha2(F.concat(_xor(padded, 0x36), message), 256))
    return F.sha2(F.concat(_xor(padded, 0x5C), inner), 256)


def _xor(hex_text: Column, byte: int) -> Column:
    """Each byte of a 64-byte hex text, xor a byte: high and low digits have their own tables."""
    digits = "0123456789ABCDEF"
    high = "".join(f"{i ^ (byte >> 4):X}" for i in range(16))
    low = "".join(f"{i ^ (byte & 15):X}" for i in range(16))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.concat(F.translate(F.substring(hex_text, i, F.lit(1)), digits, high), F.translate(F.substring(hex_text, i + 1, F.lit(1)), digits, low)))
    return F.unhex(F.array_join(pairs, ""))


def _gcm(body: Column, key: Column) -> Column:
    """nonce, ciphertext, tag. The nonce is a hash of key and body: a retried task writes the same bytes, and one
    nonce never serves two bodies."""
    nonce = F.substring(F.unhex(F.sha2(F.concat(F.lit(bytearray(b"nonce")), key, body), 256)), 1, NONCE_BYTES)
    return F.aes_encrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), nonce)


def sealed(mapping: Column, key: Column) -> Column:
    """The mapping's JSON under AES-256-GCM."""
    return _gcm(F.encode(F.to_json(mapping), "UTF-8"), key)


def _url_base64(text: Column) -> Column:
    """Bytes of URL-safe base 64, null where it is none."""
    return F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))


def fernet_opened(token: Column, key: Column) -> Column:
    """What a Fernet token (BINARY text) holds under 32 bytes (half sign, half encrypt); null where either is wrong."""
    raw = _url_base64(F.decode(token, "UTF-8"))
    body, tag = F.substring(raw, F.lit(1), F.length(raw) - 32), F.substring(raw, F.length(raw) - 31, F.lit(32))
    signed = F.unhex(hmac_sha256(F.substring(key, 1, 16), body)) == tag
    plain = F.try_aes_decrypt(F.substring(body, F.lit(10), F.length(body) - 9), F.substring(key, 17, 16), F.lit("CBC"), F.lit("PKCS"))
    return F.when((F.length(raw) >= 73) & (F.substring(raw, 1, 1) == F.lit(bytearray(b"\x80"))) & (F.length(key) == KEY_BYTES) & signed, plain)


def opened(ciphertext: Column, key: Column) -> Column:
    """The mapping, or null where the key is wrong or the bytes are damaged or too short. A key of other than 32 bytes
    is that of an older file: base 64 text of one."""
    enough = F.length(ciphertext) >= NONCE_BYTES + 16
    text = F.decode(F.try_aes_decrypt(ciphertext, F.when(F.length(key) == KEY_BYTES, key), F.lit("GCM")), "UTF-8")
    old = F.decode(fernet_opened(ciphertext, _url_base64(F.decode(key, "UTF-8"))), "UTF-8")
    return F.from_json(F.when(F.length(key) != KEY_BYTES, old).when(enough, text), "map<string,string>")


def key_file(key: Column, ciphertext: Column, passphrase_key: Column | None = None, salt: Column | None = None, marker: bytes = MARKER) -> Column:
    head = F.lit(bytearray(marker))
    plain = F.concat(head, key, ciphertext)
    if passphrase_key is None or salt is None:
        return plain
    wrapped = _gcm(key, passphrase_key)
    nonce, body = F.substring(wrapped, 1, NONCE_BYTES), F.substring(wrapped, NONCE_BYTES + 1, 1 << 20)
    size = F.unhex(F.lpad(F.hex(F.length(body)), 8, "0"))
    return F.when(passphrase_key.isNull(), plain).otherwise(F.concat(head, salt, nonce, size, body, ciphertext))


def read_key_files(files: DataFrame, marker: bytes = MARKER, rounds: int = PBKDF2_ROUNDS, old_locked: bytes = OLD_LOCKED, old_plain: bytes = OLD_PLAIN) -> DataFrame:
    """Adds key, ciphertext and error to rows with blob BINARY and passphrase STRING (null or empty: none)."""
    blob, whole = F.col("blob"), F.lit(1 << 30)
    begins = lambda m: F.substring(blob, 1, len(m)) == F.lit(bytearray(m))
    after = lambda m: F.substring(blob, F.lit(len(m) + 1), whole)
    at = F.instr(F.decode(blob, "ISO-8859-1"), old_plain.decode())
    x = files.withColumn("_locked", F.coalesce(F.length("passphrase") > 0, F.lit(False)))
    x = x.withColumn("_kind", F.when(begins(marker), 3).when(begins(old_locked), 2).when(at > 0, 1)).withColumn("_at", at)
    x = x.withColumn("_rest", F.when(F.col("_kind") == 3, after(marker)).when(F.col("_kind") == 2, after(old_locked)))
    # what a wrapped key stands behind: salt and nonce, or the salt alone
    head = F.when((F.col("_kind") == 3) & F.col("_locked"), SALT_BYTES + NONCE_BYTES).when(F.col("_kind") == 2, SALT_BYTES)
    x = x.withColumn("_head", head)
    size = F.conv(F.hex(F.substring(F.col("_rest"), F.col("_head") + 1, F.lit(4))), 16, 10).cast("long")
    x = x.withColumn("_size", F.when(F.length("_rest") >= F.col("_head") + 4, size))
    full = F.when(F.col("_kind") == 1, True).when(F.col("_head").isNull(), F.length("_rest") >= KEY_BYTES).otherwise(F.length("_rest") >= F.col("_head") + 4 + F.col("_size"))
    x = x.withColumn("_full", F.coalesce(full, F.lit(False)))
    ready = F.col("_locked") & F.col("_full") & F.col("_head").isNotNull()
    x = x.withColumn("_pk", F.when(ready, derive(F.when(ready, F.col("passphrase")), F.substring("_rest", 1, SALT_BYTES), F.lit(rounds))))
    wrapped = F.substring(F.col("_rest"), F.col("_head") + 5, F.col("_size").cast("int"))
    unlocked = F.when(F.col("_kind") == 3, F.try_aes_decrypt(F.concat(F.substring("_rest", SALT_BYTES + 1, NONCE_BYTES), wrapped), F.col("_pk"), F.lit("GCM"))).otherwise(fernet_opened(wrapped, F.col("_pk")))
    key = F.when(F.col("_kind") == 1, F.substring(blob, F.lit(1), F.col("_at") - 1)).when(F.col("_head").isNull(), F.substring("_rest", 1, KEY_BYTES)).otherwise(unlocked)
    x = x.withColumn("key", F.when(F.col("_full"), key))
    behind = F.substring(F.col("_rest"), F.col("_head") + 5 + F.col("_size").cast("int"), whole)
    text = F.when(F.col("_kind") == 1, F.substring(blob, F.col("_at") + len(old_plain), whole)).when(F.col("_head").isNull(), F.substring(F.col("_rest"), F.lit(KEY_BYTES + 1), whole)).otherwise(behind)
    error = (
        F.when(F.col("_kind").isNull(), "unrecognised format").when(~F.col("_full"), "truncated or corrupt")
        .when((F.col("_kind") == 2) & ~F.col("_locked"), "needs its passphrase").when(F.col("key").isNull(), "wrong passphrase or corrupted file")
    )
    return x.withColumn("ciphertext", F.when(F.col("key").isNotNull(), text)).withColumn("error", error).select(*files.columns, "key", "ciphertext", "error")
