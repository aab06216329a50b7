"""Analytical reads of the control plane: heartbeats, activity, recent searches, keys, sessions, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchmill.functions.text import _c, parse_timestamp, strip

#: Roles by rank, scopes in their order.
ROLES = {"readonly": 0, "member": 1, "admin": 2}
SCOPES = ["read", "search", "write", "admin"]


def recent_searches(rows: DataFrame, per_user: int = 20) -> DataFrame:
    """Newest distinct queries of each user: (user_id, query, created_at, id, n)."""
    last = rows.groupBy("user_id", "query").agg(F.max(F.struct("created_at", "id")).alias("m")).select("user_id", "query", "m.created_at", "m.id")
    order = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return last.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_user)


def daemon_state(heartbeat: Column, detail: Column, now: Column, stale: int = 90) -> Column:
    """Fixed names: stopped if the heartbeat is stale or unreadable, idle if the detail says so, else running."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(heartbeat))
    return F.when(age.isNull() | (age > stale), "stopped").when(strip(detail) == "idle", "idle").otherwise("running")


def latest_heartbeats(beats: DataFrame, names: list[str], now: Column, stale: int = 90) -> DataFrame:
    """One row for each known daemon; those without a heartbeat are stopped."""
    last = beats.groupBy("name").agg(F.max(F.struct("last_heartbeat", "detail", "processed_count")).alias("b"))
    known = beats.sparkSession.createDataFrame([(n,) for n in names], "name string")
    got = known.join(last, "name", "left")
    # the detail of a daemon that never reported is a fixed text
    return got.select("name", daemon_state(F.col("b.last_heartbeat"), F.col("b.detail"), now, stale).alias("state"), F.coalesce("b.detail", F.lit("no heartbeat recorded")).alias("detail"), F.coalesce("b.processed_count", F.lit(0)).cast("bigint").alias("processed_count"))


def overall_health(states: DataFrame) -> DataFrame:
    stopped, every = F.count_if(F.col("state") == "stopped"), F.count("*")
    return states.agg(F.when(stopped == 0, "ok").when(stopped == every, "down").otherwise("degraded").alias("health"))


def summary_numbers(x: Column | str) -> Column:
    """Whole numbers of a JSON object: numbers cut at the point, true and false as 1 and 0, texts of digits; others are left out."""
    values = F.from_json(_c(x), "map<string,variant>")

    def whole(v: Column) -> Column:
        kind, said = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        digits = F.regexp_replace(strip(said), r"(?<=\d)_(?=\d)", "")
        by_text = F.when(digits.rlike(r"^[+-]?\d+$"), F.regexp_replace(digits, r"^\+", "").try_cast("bigint"))
        return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).when(kind == "STRING", by_text).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").try_cast("bigint"))

    return F.map_filter(F.transform_values(values, lambda _, v: F.when(v.isNotNull(), whole(v))), lambda _, v: v.isNotNull())


def role_allows(role: Column | str, needed: str) -> Column:
    """Unknown roles allow nothing."""
    rank = F.lit(-1)
    for r, n in ROLES.items():
        rank = F.when(_c(role) == r, n).otherwise(rank)
    return rank >= ROLES[needed]


def scopes(text: Column | str) -> Column:
    """Valid scopes of a comma list, in canonical order."""
    return F.array_intersect(F.array(*map(F.lit, SCOPES)), F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda s: F.trim(s)))


def valid_keys(keys: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Keys that are not revoked, not expired (unreadable counts as expired) and whose owner is active."""
    t = F.try_to_timestamp("expires_at")
    live = keys.filter(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (t.isNotNull() & (t > now))))
    return live.join(users.filter("status = 'active'").select(F.col("id").alias("owner_user_id"), "role"), "owner_user_id")


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not expired (unreadable counts as expired) and whose user is active, with username and role."""
    live = sessions.filter(F.coalesce(parse_timestamp("expires_at") > now, F.lit(False)))
    return live.join(users.filter("status = 'active'").select(F.col("id").alias("user_id"), "username", "role"), "user_id")


def user_counts(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if((F.col("role") == "admin") & (F.col("status") == "active")).alias("admins"), F.count_if(F.col("status") == "suspended").alias("suspended"))


#: Limits of account fields and touches.
USERNAME, EMAIL = r"^[A-Za-z0-9._-]{3,64}$", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PASSWORD_LEAST, DISPLAY_MOST, KEY_TOUCH, SESSION_TOUCH = 8, 120, 60, 300


def account_errors(username: Column, password: Column, display: Column, email: Column, role: Column) -> Column:
    """Names of the fields that are not valid; an absent display name or e-mail is."""
    bad = [
        F.when(~F.coalesce(username.rlike(USERNAME), F.lit(False)), "username"),
        F.when(F.coalesce(F.length(password), F.lit(0)) < PASSWORD_LEAST, "password"),
        F.when(F.length(strip(display)) > DISPLAY_MOST, "display_name"),
        F.when((F.length(email) > 0) & ~email.rlike(EMAIL), "email"),
        F.when(~F.coalesce(role.isin(list(ROLES)), F.lit(False)), "role"),
    ]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def key_digest(raw: Column | str) -> Column:
    """SHA-256 of a key; only this is stored."""
    return F.sha2(_c(raw), 256)


def should_touch(last: Column, now: Column, every: int = KEY_TOUCH) -> Column:
    """Never touched, unreadable, or at least ``every`` seconds ago."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(last))
    return F.coalesce(age >= every, F.lit(True))


def insert_if_empty(table: DataFrame, new: DataFrame) -> DataFrame:
    """table, and the new rows only if it has none."""
    first = table.limit(1).select(F.lit(1).alias("__one"))
    return table.unionByName(new.withColumn("__one", F.lit(1)).join(first, "__one", "left_anti").drop("__one"))


def sparse_update(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the columns that the patch names in ``fields`` (map of column to text) set; an absent name leaves, null clears."""
    p = patch.select(key, F.col("fields").alias("__f"))
    given = lambda c: F.coalesce(F.array_contains(F.map_keys("__f"), c), F.lit(False))
    new = [F.when(given(c), F.try_element_at("__f", F.lit(c)).cast(t)).otherwise(F.col(c)).alias(c) if c != key else F.col(c) for c, t in table.dtypes]
    return table.join(p, key, "left").select(*new)


def keep_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """(id, cycle, failures): failures in a row up to each cycle, of (id, cycle, failed)."""
    past = W.partitionBy("id").orderBy("cycle")
    island = runs.withColumn("g", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(past))
    count = F.sum(F.col("failed").cast("int")).over(W.partitionBy("id", "g").orderBy("cycle"))
    return island.select("id", "cycle", F.coalesce(count, F.lit(0)).cast("int").alias("failures"))


def user_search(users: DataFrame, term: str) -> DataFrame:
    return users.filter(F.lower(F.concat_ws(" ", "display_name", "username", "email")).contains(term.strip().lower()))
