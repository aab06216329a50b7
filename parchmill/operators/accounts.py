"""Writes of the control plane: users, sessions, keys, configuration, activity, as commits to a snapshot store.

Each write reads the newest version, checks its rule and commits once, so a rule and its write agree (one writer at a
time). Tables are the caller's control tables, small next to documents; a commit writes only the rows that change.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.operators.control import KEY_TOUCH, SESSION_TOUCH, should_touch, sparse_update
from parchmill.sources.snapshots import SnapshotStore

KEYS = {"users": "id", "sessions": "token_hash", "api_keys": "id", "recent_searches": "id", "config": "key", "reconcile_activity": "id", "daemon_status": "name"}
SCHEMAS = {
    "users": "id long, username string, password_hash string, display_name string, email string, role string, status string, created_at string, updated_at string, last_login_at string, password_changed_at string",
    "sessions": "token_hash string, user_id long, created_at string, expires_at string, last_seen_at string, user_agent string, ip string",
    "api_keys": "id long, key_hash string, key_prefix string, name string, owner_user_id long, scopes string, created_at string, expires_at string, last_used_at string, revoked_at string, request_count long",
    "recent_searches": "id long, user_id long, query string, created_at string",
    "config": "key string, value string, updated_at string",
    "reconcile_activity": "id long, kind string, started_at string, finished_at string, ok boolean, summary string, detail string",
    "daemon_status": "name string, detail string, processed_count long, last_heartbeat string, updated_at string",
}
VERSION = "config_version"


class Refused(ValueError):
    """A write that a rule forbids; nothing was written."""


class Control:
    """The control tables of one store."""

    def __init__(self, store: SnapshotStore):
        self.store, self.spark = store, store.spark
        if "users" not in store.head()[1]:
            store.commit(replace={t: self.spark.createDataFrame([], s) for t, s in SCHEMAS.items()})

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def rows(self, name: str, rows: list[dict]) -> DataFrame:
        names = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[name])

    def _next(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def _insert(self, name: str, values: dict, unique: str) -> int:
        if self.table(name).filter(F.col(unique) == values[unique]).limit(1).count():
            raise Refused(f"{name}: {unique} is taken")
        row = {"id": self._next(name), **values}
        self.store.commit(upsert={name: self.rows(name, [row])})
        return row["id"]

    # users

    def add_user(self, **values) -> int:
        """The new id; a username that is taken is refused."""
        return self._insert("users", {"role": "member", "status": "active", **values}, "username")

    def add_first_admin(self, **values) -> bool:
        """An admin, only while there are no users."""
        if self.table("users").limit(1).count():
            return False
        self.store.commit(upsert={"users": self.rows("users", [{"id": 1, "status": "active", **values, "role": "admin"}])})
        return True

    def user(self, user_id: int | None = None, username: str | None = None) -> dict | None:
        where = F.col("id") == user_id if username is None else F.col("username") == username
        row = self.table("users").filter(where).first()
        return row and row.asDict()

    def users(self) -> DataFrame:
        return self.table("users").orderBy("id")

    def setup_needed(self) -> bool:
        return not self.table("users").limit(1).count()

    def _last_admin(self, user_id: int) -> bool:
        admins = self.table("users").filter("role = 'admin' and status = 'active'").select("id").limit(2).collect()
        return [r.id for r in admins] == [user_id]

    def delete_user(self, user_id: int, actor: int) -> None:
        """The user with sessions, keys and searches, in one commit; not oneself, not the last active admin."""
        if user_id == actor:
            raise Refused("nobody deletes their own account")
        if self._last_admin(user_id):
            raise Refused("an active admin has to be left")
        self.store.commit(delete={
            "users": self.rows("users", [{"id": user_id}]).select("id"),
            "sessions": self.table("sessions").filter(F.col("user_id") == user_id).select("token_hash"),
            "api_keys": self.table("api_keys").filter(F.col("owner_user_id") == user_id).select("id"),
            "recent_searches": self.table("recent_searches").filter(F.col("user_id") == user_id).select("id"),
        })

    def update_user(self, user_id: int, actor: int, now: str, **fields) -> None:
        """Named fields; a suspension ends the user's sessions. Not one's own suspension or demotion, nor that of the last active admin."""
        old = self.user(user_id)
        if old is None:
            raise Refused("no such user")
        suspends, demotes = fields.get("status") == "suspended", old["role"] == "admin" and fields.get("role", "admin") not in ("admin", None)
        if suspends or demotes:
            if user_id == actor:
                raise Refused("nobody suspends their own account" if suspends else "nobody gives up their own admin role")
            if self._last_admin(user_id):
                raise Refused("an active admin has to be left")
        if "password_hash" in fields:
            fields["password_changed_at"] = now
        ends = {"sessions": self.table("sessions").filter(F.col("user_id") == user_id).select("token_hash")} if suspends else {}
        self.store.commit(upsert={"users": self._patched("users", user_id, {**fields, "updated_at": now})}, delete=ends)

    def _patched(self, name: str, row_id: int, fields: dict) -> DataFrame:
        one = self.table(name).filter(F.col("id") == row_id)
        patch = self.spark.createDataFrame([(row_id, {k: None if v is None else str(v) for k, v in fields.items()})], "id long, fields map<string,string>")
        return sparse_update(one, patch, "id")

    def record_login(self, user_id: int, now: str) -> None:
        self.store.commit(upsert={"users": self._patched("users", user_id, {"last_login_at": now})})

    # sessions

    def add_session(self, **values) -> None:
        self.store.commit(upsert={"sessions": self.rows("sessions", [values])})

    def touch_sessions(self, seen: DataFrame, now: str) -> None:
        """``last_seen_at`` of the sessions used (token_hash), at most once in ``SESSION_TOUCH`` seconds."""
        due = self.table("sessions").join(seen.select("token_hash").distinct(), "token_hash", "left_semi").filter(should_touch(F.col("last_seen_at"), F.lit(now).cast("timestamp"), SESSION_TOUCH))
        self.store.commit(upsert={"sessions": due.withColumn("last_seen_at", F.lit(now))})

    def end_sessions(self, token_hash: str | None = None, user_id: int | None = None) -> None:
        where = F.col("token_hash") == token_hash if user_id is None else F.col("user_id") == user_id
        self.store.commit(delete={"sessions": self.table("sessions").filter(where).select("token_hash")})

    def prune_sessions(self, now: str) -> int:
        """Sessions that ended by now (compared as texts) go; how many."""
        gone = self.table("sessions").filter(F.col("expires_at") <= now).select("token_hash")
        n = gone.count()
        if n:
            self.store.commit(delete={"sessions": gone})
        return n

    # keys

    def add_key(self, **values) -> int:
        """The new id; only the hash of a key is stored, and one hash once."""
        return self._insert("api_keys", {"request_count": 0, **values}, "key_hash")

    def keys(self, user_id: int, role: str) -> DataFrame:
        """All keys for an admin, else one's own, by id, with the owner's username."""
        own = self.table("api_keys") if role == "admin" else self.table("api_keys").filter(F.col("owner_user_id") == user_id)
        names = self.table("users").select(F.col("id").alias("owner_user_id"), F.col("username").alias("owner"))
        return own.join(names, "owner_user_id", "left").select(*own.columns, "owner").orderBy("id")

    def update_key(self, key_id: int, **fields) -> None:
        self.store.commit(upsert={"api_keys": self._patched("api_keys", key_id, fields)})

    def revoke_key(self, key_id: int, now: str) -> None:
        """A key that was revoked keeps its first time."""
        one = self.table("api_keys").filter(F.col("id") == key_id)
        self.store.commit(upsert={"api_keys": one.withColumn("revoked_at", F.coalesce("revoked_at", F.lit(now)))})

    def delete_key(self, key_id: int) -> None:
        self.store.commit(delete={"api_keys": self.rows("api_keys", [{"id": key_id}]).select("id")})

    def touch_keys(self, used: DataFrame) -> None:
        """Requests (id, at) counted onto their keys, with the time of the last one, at most once in ``KEY_TOUCH`` seconds."""
        more = used.groupBy("id").agg(F.count("*").alias("__n"), F.max("at").alias("__at"))
        hit = self.table("api_keys").join(more, "id")
        last = F.when(should_touch(F.col("last_used_at"), F.col("__at").cast("timestamp"), KEY_TOUCH), F.col("__at")).otherwise(F.col("last_used_at"))
        self.store.commit(upsert={"api_keys": hit.withColumns({"request_count": F.col("request_count") + F.col("__n"), "last_used_at": last}).drop("__n", "__at")})

    # configuration

    def config(self) -> tuple[int, dict[str, str]]:
        """(version, values) of one snapshot."""
        held = {r.key: r.value for r in self.table("config").collect()}  # settings, a bounded list
        return int(held.pop(VERSION, "0")), held

    def set_config(self, values: dict[str, str], now: str) -> int:
        """The values and the next version, in one commit."""
        version = self.config()[0] + 1
        self.store.commit(upsert={"config": self.rows("config", [{"key": k, "value": v, "updated_at": now} for k, v in {**values, VERSION: str(version)}.items()])})
        return version

    def seed_config(self, values: dict[str, str], now: str) -> bool:
        """The values, only while nothing is configured."""
        if self.config()[1]:
            return False
        self.set_config(values, now)
        return True

    # records

    def record_search(self, user_id: int, query: str, now: str, keep: int = 20) -> None:
        """The newest of equal queries stays, and of each user's the newest ``keep``."""
        own = self.table("recent_searches").filter(F.col("user_id") == user_id)
        same = own.filter(F.col("query") == query).select("id")
        rest = own.filter(F.col("query") != query).orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, keep - 1)).select("id")
        self.store.commit(upsert={"recent_searches": self.rows("recent_searches", [{"id": self._next("recent_searches"), "user_id": user_id, "query": query, "created_at": now}])}, delete={"recent_searches": same.unionByName(rest)})

    def record_activity(self, kind: str, started_at: str, finished_at: str, ok: bool, summary: dict[str, int], detail: str) -> None:
        row = {"id": self._next("reconcile_activity"), "kind": kind, "started_at": started_at, "finished_at": finished_at, "ok": ok, "summary": json.dumps(summary), "detail": detail}
        self.store.commit(upsert={"reconcile_activity": self.rows("reconcile_activity", [row])})

    def recent_activity(self, limit: int = 50) -> DataFrame:
        return self.table("reconcile_activity").orderBy(F.desc("id")).limit(limit)

    def beat(self, beats: DataFrame, now: str) -> None:
        """The newest heartbeat (name, detail, processed_count, last_heartbeat) of each daemon in place of the one before."""
        last = beats.groupBy("name").agg(F.max_by(F.struct("detail", "processed_count", "last_heartbeat"), "last_heartbeat").alias("b")).select("name", "b.*")
        self.store.commit(upsert={"daemon_status": last.withColumn("updated_at", F.lit(now))})
