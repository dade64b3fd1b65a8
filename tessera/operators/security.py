"""Roles, users and column encryption."""

from __future__ import annotations

import hashlib
import hmac
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, DuplicateKeyError, NotFoundError, PermissionDenied
from ..sources import scratch

ACTIONS = ("read", "write", "delete", "createCollection", "dropCollection", "createIndex", "dropIndex", "createUser", "dropUser", "grantRole", "admin")
ROLES = {
    "read": ACTIONS[:1],
    "readWrite": ACTIONS[:3],
    "dbAdmin": ACTIONS[:7],
    "userAdmin": ACTIONS[7:10],
    "root": ACTIONS,
}


def allowed(roles: list[str], action: str) -> bool:
    return any(action in ROLES.get(r, ()) for r in roles)


def check(roles: list[str], action: str) -> None:
    if not allowed(roles, action):
        raise PermissionDenied(f"{action} needs another role than {', '.join(roles) or 'none'}")


def grants(spark: SparkSession) -> DataFrame:
    """(role, action) rows."""
    return spark.createDataFrame([(r, a) for r, acts in ROLES.items() for a in acts], "role string, action string")


class Users:
    """Users with salted scrypt hashes, in memory or in a folder.

    In a folder every change is a file of the next number, made by a rename that never overwrites;
    of two drivers that change users at once, one is told so.
    """

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self.path, self._number = spark, path, 0
        self._users: dict[str, dict] = {}
        if path is not None:
            self._load()

    def _load(self) -> None:
        numbers = [int(n[:-5]) for n in scratch.files(self.spark, self.path) if n.endswith(".json")]
        if numbers and max(numbers) > self._number:
            self._number = max(numbers)
            held = scratch.load(self.spark, f"{self.path}/{self._number:012d}.json")
            self._users = {n: {"salt": bytes.fromhex(u["salt"]), "hash": bytes.fromhex(u["hash"]), "roles": u["roles"]} for n, u in held.items()}

    def _save(self) -> None:
        if self.path is None:
            return
        held = {n: {"salt": u["salt"].hex(), "hash": u["hash"].hex(), "roles": u["roles"]} for n, u in self._users.items()}
        if not scratch.save(self.spark, f"{self.path}/{self._number + 1:012d}.json", held):
            self._load()
            raise ConflictError("users were changed by another driver")
        self._number += 1

    def create(self, name: str, password: str, roles: list[str]) -> None:
        if name in self._users:
            raise DuplicateKeyError(f"user {name} is there already")
        if unknown := set(roles) - set(ROLES):
            raise NotFoundError(f"no role {', '.join(sorted(unknown))}")
        salt = os.urandom(16)
        self._users[name] = {"salt": salt, "hash": self._hash(password, salt), "roles": list(roles)}
        self._save()

    @staticmethod
    def _hash(password: str, salt: bytes) -> bytes:
        return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1)

    def authenticate(self, name: str, password: str) -> bool:
        u = self._users.get(name)
        return u is not None and hmac.compare_digest(u["hash"], self._hash(password, u["salt"]))

    def roles(self, name: str) -> list[str]:
        if name not in self._users:
            raise NotFoundError(f"no user {name}")
        return self._users[name]["roles"]

    def grant(self, name: str, role: str) -> None:
        if role not in ROLES:
            raise NotFoundError(f"no role {role}")
        if role not in self.roles(name):
            self.roles(name).append(role)
            self._save()

    def revoke(self, name: str, role: str) -> None:
        if role in self.roles(name):
            self.roles(name).remove(role)
            self._save()

    def drop(self, name: str) -> None:
        if self._users.pop(name, None) is not None:
            self._save()


def encrypt(c: Column, key: bytes) -> Column:
    """AES-GCM: 12-byte nonce, cipher text, 16-byte tag."""
    return F.aes_encrypt(c.cast("binary"), F.lit(key), F.lit("GCM"))


def decrypt(c: Column, key: bytes) -> Column:
    return F.aes_decrypt(c, F.lit(key), F.lit("GCM"))
