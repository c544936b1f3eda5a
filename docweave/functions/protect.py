"""Encrypted columns, a key from a password, and the session that opens them.

Columns are encrypted by Spark's AES in GCM mode, rows one by one; filters run over the decrypted columns, in the same plan.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.filters import compile_filter


def derive_key(password: str, salt: bytes, length: int = 32) -> bytes:
    """A key by scrypt (a memory-hard function of Python's library)."""
    if not password:
        raise ValueError("a password is needed")
    return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1, dklen=length)


def encrypted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """df with columns as AES-GCM binaries; nulls stay null. The key is part of the plan: keep plans out of logs."""
    return df.withColumns({c: F.aes_encrypt(F.col(c).cast("string"), F.lit(key)) for c in columns})


def decrypted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """The inverse of encrypted(); an error at run time for a wrong key."""
    return df.withColumns({c: F.aes_decrypt(F.col(c), F.lit(key)).cast("string") for c in columns})


def filter_encrypted(df: DataFrame, columns: list[str], key: bytes, where: dict) -> DataFrame:
    """The rows that a JSON filter keeps, over encrypted columns; they come out decrypted."""
    return decrypted(df, columns, key).where(compile_filter(where, tuple(df.columns)))


def encrypt_table(source: DataFrame, path: str, columns: list[str], key: bytes) -> int:
    """Writes an encrypted copy of a table; its number of rows, read back with the key."""
    encrypted(source, columns, key).write.mode("overwrite").parquet(path)
    back = decrypted(source.sparkSession.read.parquet(path), columns, key)
    return back.where(" OR ".join(f"{c} IS NOT NULL OR {c} IS NULL" for c in columns)).count()


def deletion_rows(documents: DataFrame, level: str, at: Column) -> DataFrame:
    """Audit rows (target_hash, level, at) of documents deleted at a level (standard, secure, cryptographic): ids only as SHA-256."""
    if level not in ("standard", "secure", "cryptographic"):
        raise ValueError(f"unknown level {level}")
    return documents.where("document_id IS NOT NULL").select(F.sha2(F.col("document_id"), 256).alias("target_hash"), F.lit(level).alias("level"), at.alias("at")).distinct()


@dataclass
class Session:
    """Open after the right password for so many seconds; locked for a while after too many wrong ones."""

    check: bytes
    salt: bytes
    timeout: float = 300.0
    attempts: int = 3
    lockout: float = 60.0
    clock: object = time.monotonic
    _wrong: int = field(default=0, init=False)
    _until: float = field(default=0.0, init=False)
    _open: float = field(default=float("-inf"), init=False)

    @classmethod
    def for_password(cls, password: str, salt: bytes, **options: object) -> Session:
        return cls(hashlib.sha256(derive_key(password, salt)).digest(), salt, **options)

    def unlock(self, password: str) -> bool:
        """Whether the session is open now; PermissionError while it is locked."""
        now = self.clock()
        if now < self._until:
            raise PermissionError("locked after wrong passwords")
        if hashlib.sha256(derive_key(password, self.salt)).digest() == self.check:
            self._wrong, self._open = 0, now
            return True
        self._wrong += 1
        if self._wrong >= self.attempts:
            self._wrong, self._until = 0, now + self.lockout
        return False

    def lock(self) -> None:
        self._open = float("-inf")

    @property
    def active(self) -> bool:
        return self.clock() - self._open < self.timeout
