"""Sanitising, validation, rate limits and access rules."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Tables

#: Signs of unsafe queries.
UNSAFE = [r"(?i)\b(drop|delete|truncate|alter)\s+(table|from|database)\b", r"(?i)<script\b", r"(?i)javascript:", r"\.\./", r"(?i)\bunion\s+select\b", r"[;|`]\s*(rm|cat|curl|wget)\b"]
BLOCKED = "[BLOCKED]"
MANY_POLICIES = 10_000


def html_escaped(c: Column) -> Column:
    for sign, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(ref))
    return c


def csv_escaped(c: Column) -> Column:
    """Quoted where it must be; what a spreadsheet would run is led by an apostrophe."""
    c = F.when(c.rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def safe_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.\.+[/\\]?", ""), r'[<>:"|?*\x00-\x1f]', "_")


def sql_escaped(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{7f}-\x{9f}]"
#: Declarations that bring in what lies outside a document.
XML_OUTSIDE = r"(?i)<!(?:entity|doctype)[^>\[]*[>\[]?|(?:system|public)\s+(?:\"[^\"]*\"|'[^']*')"
#: Commands that must not follow another.
HARMFUL_COMMANDS = ("rm", "del", "format", "shutdown", "reboot")
COMMAND_CHAINS = rf"(?i)(?:[|;]|&&)\s*(?:{'|'.join(HARMFUL_COMMANDS)})(?:\s|$)|`[^`]*`|\$\([^)]*\)"
#: Signs of expressions that can take very long: groups that look around, doubled quantifiers, a repeated group that repeats within.
SLOW_REGEX = r"\(\?[=!<]|[+*][+*]|\([^()]*[+*}][^()]*\)[+*{]"
REGEX_LENGTH = 1000


def xml_sanitised(c: Column) -> Column:
    """Without control characters but tabs and line ends, and with declarations of outside entities blocked."""
    return F.regexp_replace(F.regexp_replace(c, CONTROLS, ""), XML_OUTSIDE, BLOCKED)


def command_sanitised(c: Column) -> Column:
    """Without control characters; chained harmful commands and substitutions are blocked."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x{7f}-\x{9f}]", ""), COMMAND_CHAINS, BLOCKED)


def regex_sanitised(c: Column) -> Column:
    """Blocked as a whole if it can take very long, else without control characters and at most REGEX_LENGTH long."""
    c = F.regexp_replace(c, r"[\x00-\x1f\x{7f}-\x{9f}]", "")
    return F.when(c.rlike(SLOW_REGEX), BLOCKED).otherwise(F.left(c, F.lit(REGEX_LENGTH)))


def unsafe(c: Column) -> Column:
    hit = F.lit(False)
    for p in UNSAFE:
        hit = hit | c.rlike(p)
    return hit


def blocked(c: Column) -> Column:
    for p in UNSAFE:
        c = F.regexp_replace(c, p, BLOCKED)
    return c


def safety(original: Column, clean: Column) -> Column:
    """100 less what blocked parts, lost length, control signs and null bytes cost."""
    lost = F.when(F.octet_length(clean) < F.octet_length(original), (1 - F.octet_length(clean) / F.octet_length(original)) * 20).otherwise(0.0)
    s = 100.0 - F.regexp_count(clean, F.lit(r"\[BLOCKED")) * 10.0 - lost - F.regexp_count(original, F.lit(r"[\x00-\x1f\x7f-\x9f]")) * 5.0
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s))


def password_score(c: Column) -> Column:
    kinds = sum((c.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    return F.least(F.length(c) * 4, F.lit(40)) + kinds * 15


def rate_limited(requests: DataFrame, limit: int = 100, window_s: int = 60, burst: int = 20, burst_s: int = 10, block_s: int = 300) -> DataFrame:
    """(client, ts, seq, allowed): a refusal blocks the client for a time, so its requests are walked in order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ts", "seq"], ignore_index=True)
        t = (f["ts"] - pd.Timestamp("1970-01-01")).dt.total_seconds().to_numpy()
        kept: list[float] = []
        until, out, lo = -1.0, [], 0
        for x in t:
            ok = x >= until
            if ok:
                while lo < len(kept) and kept[lo] <= x - window_s:
                    lo += 1
                near = sum(1 for y in reversed(kept) if y > x - burst_s) if kept and kept[-1] > x - burst_s else 0
                ok = len(kept) - lo < limit and near < burst
                if not ok:
                    until = x + block_s
            if ok:
                kept.append(x)
            out.append(ok)
        f["allowed"] = out
        return f[["client", "seq", "allowed"]]

    return requests.groupBy("client").applyInPandas(run, "client long, seq long, allowed boolean")


def severity(violations: Column) -> Column:
    return F.when(violations <= 2, "low").when(violations <= 5, "medium").when(violations <= 10, "high").otherwise("critical")


def decisions(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests(request_id, role, resource, action) under policies(priority, effect, role, glob, actions).

    The most urgent rule that applies decides (a deny beats an allow of equal urgency); none: not_applicable.
    Policies are few, but a caller's: without a look at their size they are broadcast up to MANY_POLICIES only."""
    glob = F.concat(F.lit("^"), F.replace(F.replace(F.col("glob"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    p = policies.withColumn("pattern", glob).withColumnRenamed("role", "policy_role")
    fits = (F.col("policy_role").isin("*") | (F.col("policy_role") == F.col("role"))) & F.expr("resource RLIKE pattern") & F.array_contains("actions", F.col("action"))
    hit = requests.join(F.broadcast(p) if p.limit(MANY_POLICIES + 1).count() <= MANY_POLICIES else p, fits, "left")
    best = hit.groupBy("request_id").agg(F.min_by("effect", F.struct("priority", F.when(F.col("effect") == "deny", 0).otherwise(1))).alias("effect"))
    return best.select("request_id", F.coalesce("effect", F.lit("not_applicable")).alias("decision"))


def role_closure(spark, parents: DataFrame) -> DataFrame:
    """(role, inherits): all roles reachable; ends at cycles. Reach doubles each round; a round joins what the last one has found, and is written."""
    with Tables(spark, "roles") as tables:
        reach = tables.write(parents.select("role", F.col("parent").alias("inherits")).distinct())
        while True:
            step = reach.join(reach.select(F.col("role").alias("inherits"), F.col("inherits").alias("next")), "inherits").select("role", F.col("next").alias("inherits"))
            new = tables.write(step.distinct().join(reach, ["role", "inherits"], "left_anti"))
            if new.isEmpty():
                return tables.release(reach)
            reach = tables.write(reach.unionByName(new))
            tables.forget(reach)


@dataclass(frozen=True)
class Rule:
    """effect for resources like glob, an action (or '*') and conditions (field, operator, value) that must all hold."""

    name: str
    effect: str
    glob: str
    action: str = "*"
    conditions: tuple[tuple[str, str, str], ...] = ()


def condition(field: Column, op: str, value: str) -> Column:
    """One of ten comparisons of a request's field (null: empty) with a text; what isn't a number compares as 0."""
    c = F.coalesce(field.cast("string"), F.lit(""))
    number = F.coalesce(c.try_cast("double"), F.lit(0.0))
    match op:
        case "equals":
            return c == value
        case "not_equals":
            return c != value
        case "contains":
            return F.contains(c, F.lit(value))
        case "starts_with":
            return F.startswith(c, F.lit(value))
        case "ends_with":
            return F.endswith(c, F.lit(value))
        case "greater" | "less":
            try:
                bound = float(value)
            except ValueError:
                bound = 0.0
            return number > bound if op == "greater" else number < bound
        case "matches":
            return c.rlike(value)
        case "in":
            return c.isin(value.split(","))
        case "not_in":
            return ~c.isin(value.split(","))
    raise ValueError(f"no such operator: {op}")


def first_rule(rules: list[Rule], resource: Column, action: Column, fields: dict[str, Column]) -> Column:
    """struct(rule, effect) of the first rule that matches, or (null, not_applicable). One expression, no join."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit("not_applicable").alias("effect"))
    for r in reversed(rules):
        parts = ("".join({"*": ".*", "?": "."}.get(x, x if x.isalnum() or x in "_/-" else "\\" + x) for x in r.glob),)
        ok = F.coalesce(resource, F.lit("")).rlike(f"^{parts[0]}$")
        if r.action != "*":
            ok = ok & action.eqNullSafe(F.lit(r.action))
        for field, op, value in r.conditions:
            ok = ok & condition(fields.get(field, F.lit("")), op, value)
        out = F.when(ok, F.struct(F.lit(r.name).alias("rule"), F.lit(r.effect).alias("effect"))).otherwise(out)
    return out


def session_validity(accesses: DataFrame, timeout_s: int) -> DataFrame:
    """accesses(session, ts, seq) + valid: a session lives while no two accesses are further apart than its timeout; once expired it stays so."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(w)
    worst = F.max("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return accesses.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("valid", worst <= timeout_s * 1_000_000).drop("_gap")


def security_report(events: DataFrame, last: int = 1000) -> DataFrame:
    """One row over the last events(ts, seq, session, severity, kind): counts, threat level and advice."""
    sev = F.col("severity")
    a = events.orderBy(F.desc("ts"), F.desc("seq")).limit(last).agg(
        F.count("*").alias("total_events"), F.countDistinct("session").alias("active_sessions"), F.count_if(sev == "critical").alias("critical_events"), F.count_if(sev == "high").alias("high_events"),
        F.count_if(F.col("kind") == "failed_login").alias("_logins"), F.count_if(F.col("kind") == "injection").alias("_injections"), F.count_if(F.col("kind") == "traversal").alias("_paths"),
    )
    threat = F.when(F.col("critical_events") > 0, "critical").when(F.col("high_events") > 5, "high").when(F.col("high_events") > 0, "medium").otherwise("low")
    advice = F.array_compact(F.array(F.when(F.col("_logins") > 10, "lock accounts after failed logins"), F.when(F.col("_injections") > 0, "validate input against injection"), F.when(F.col("_paths") > 0, "check paths")))
    return a.select("total_events", "active_sessions", "critical_events", "high_events", threat.alias("threat_level"), F.array_join(advice, "; ").alias("advice"))
