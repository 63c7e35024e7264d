"""The usage log: validation, throttling and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values. Bounds of the log's fields.
TEXT, TYPE, TITLE, BODY, EMAIL, AGENT = 100, 50, 200, 2000, 200, 500
ISSUE_GRACE_S = 120
SPECIES_A_WRITE = 500
GAP_S = 60
LAST = 500


def valid_visit(now: F.Column) -> F.Column:
    short = lambda c: F.col(c).isNotNull() & (F.length(c) <= TEXT)
    ok = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & short("country") & short("city") & (F.col("ts") <= now)
    return F.coalesce(ok, F.lit(False))


def valid_issue(now: F.Column) -> F.Column:
    short = lambda c, n: F.col(c).isNotNull() & (F.length(c) <= n)
    maybe = lambda c, n: F.col(c).isNull() | (F.length(c) <= n)
    ok = short("type", TYPE) & short("title", TITLE) & short("body", BODY) & maybe("email", EMAIL) & maybe("ua", AGENT) & (F.col("ts") <= now + F.expr(f"INTERVAL {ISSUE_GRACE_S} SECONDS"))
    return F.coalesce(ok, F.lit(False))


VISIT = ("event_id", "user_id", "ts", "lat", "lng", "country", "city", "session")
ISSUE = ("type", "title", "body", "email", "ua", "ts")


def no_others(columns: list[str], known: tuple[str, ...]) -> F.Column:
    """Whether a row's other columns are all empty: a record may have known fields alone."""
    other = [F.col(c).isNull() for c in columns if c not in known]
    out = F.lit(True)
    for o in other:
        out &= o
    return out


def consented(visits: DataFrame, consent: str = "consent") -> DataFrame:
    """Visits of users who agreed; no answer is none."""
    return visits.where(F.coalesce(F.col(consent), F.lit(False)))


def once_a_session(visits: DataFrame) -> DataFrame:
    """The first visit of each (user_id, session)."""
    rest = [c for c in visits.columns if c not in ("user_id", "session")]
    first = visits.groupBy("user_id", "session").agg(F.min(F.struct("ts", "event_id", *(c for c in rest if c not in ("ts", "event_id")))).alias("m"))
    return first.select("user_id", "session", *(f"m.{c}" for c in rest))


def location(city: str = "city", country: str = "country") -> F.Column:
    return F.concat_ws(", ", F.nullif(F.col(city), F.lit("")), F.nullif(F.col(country), F.lit("")))


def counters(events: DataFrame, n: F.Column) -> DataFrame:
    """Sessions, and species found, where one write may add 500 at most."""
    return events.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(F.when(n <= SPECIES_A_WRITE, n)), F.lit(0)).cast("long").alias("species_total"))


def last_visits(visits: DataFrame, n: int = LAST) -> DataFrame:
    return visits.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def dashboard(visits: DataFrame, species: F.Column) -> DataFrame:
    recent = last_visits(visits).agg(F.countDistinct(location()).alias("locations"), F.count_if((F.col("lat") != 0) & (F.col("lng") != 0)).alias("markers"))
    return counters(visits, species).crossJoin(recent)  # one row each
