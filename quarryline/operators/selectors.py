"""Selectors: which part of a source is meant, as column predicates.

A selector is a struct (kind, source, root, cwd, fromDate, toDate); kind is all,
date_range, cwd or cwd_date_range.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SELECTOR = "struct<kind:string,source:string,root:string,cwd:string,fromDate:string,toDate:string>"
KINDS = ("all", "date_range", "cwd", "cwd_date_range")


def selector(kind: str, root: str, source: str = "codex", cwd: str | None = None, from_date: str | None = None, to_date: str | None = None) -> dict:
    """A checked selector; raises ValueError with the field that is wrong."""
    if kind not in KINDS:
        raise ValueError("kind")
    values = {"root": root, **({"cwd": cwd} if "cwd" in kind else {}), **({"fromDate": from_date, "toDate": to_date} if "date" in kind else {})}
    values = {k: (v or "").strip() for k, v in values.items()}
    for k, v in values.items():
        if not v:
            raise ValueError(k)
        if k.endswith("Date") and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
            raise ValueError(k)
    if "date" in kind and values["fromDate"] > values["toDate"]:
        raise ValueError("fromDate")
    return {"kind": kind, "source": source, **values}


def as_column(s: dict) -> Column:
    return F.struct(*(F.lit(s.get(f)).cast("string").alias(f) for f in ("kind", "source", "root", "cwd", "fromDate", "toDate")))


def canonical(text: Column, default_source: str = "codex", default_root: str | None = None) -> Column:
    """Struct (selector, error) of selector JSON: defaults filled in, fields trimmed and checked."""
    s = F.from_json(text, SELECTOR)
    t = lambda f: F.trim(s[f])
    dated, placed = s["kind"].isin("date_range", "cwd_date_range"), s["kind"].isin("cwd", "cwd_date_range")
    root = F.coalesce(F.when(t("root") != "", t("root")), F.lit(default_root))
    bad_date = lambda f: dated & (t(f).isNull() | ~t(f).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    error = (
        F.when(s.isNull() | s["kind"].isNull() | ~s["kind"].isin(*KINDS), "kind").when(root.isNull(), "root").when(placed & (F.coalesce(t("cwd"), F.lit("")) == ""), "cwd")
        .when(bad_date("fromDate"), "fromDate").when(bad_date("toDate"), "toDate").when(dated & (t("fromDate") > t("toDate")), "reversed")
    )
    clean = F.struct(
        s["kind"].alias("kind"), F.coalesce(s["source"], F.lit(default_source)).alias("source"), root.alias("root"), F.when(placed, t("cwd")).alias("cwd"),
        F.when(dated, t("fromDate")).alias("fromDate"), F.when(dated, t("toDate")).alias("toDate"),
    )
    return F.struct(F.when(error.isNull(), clean).alias("selector"), error.alias("error"))


def storage_key(s: Column) -> Column:
    """Canonical JSON: fixed order, absent fields left out; null for no selector."""
    return F.when(s.isNotNull(), F.to_json(F.struct(*(s[f].alias(f) for f in ("kind", "source", "root", "cwd", "fromDate", "toDate")))))


def under(path: Column, root: Column) -> Column:
    """The path is the root or lies below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def contains(s: Column, cwd: Column, date: Column) -> Column:
    """A file or session of the selector's source and root belongs to it; without a date it is in no range."""
    in_range = date.isNotNull() & (date >= s["fromDate"]) & (date <= s["toDate"])
    kind = s["kind"]
    yes = F.when(kind == "all", True).when(kind == "cwd", cwd == s["cwd"]).when(kind == "date_range", in_range).when(kind == "cwd_date_range", (cwd == s["cwd"]) & in_range)
    return F.coalesce(yes, F.lit(False))


def matches(s: Column, source: Column, path: Column, cwd: Column, date: Column) -> Column:
    """The whole predicate on session or inventory rows."""
    return (source == s["source"]) & under(path, s["root"]) & contains(s, cwd, date)


def implies(a: Column, b: Column) -> Column:
    """Everything that b selects, a selects (same source and root)."""
    same = (a["source"] == b["source"]) & (a["root"] == b["root"])
    dates = (a["fromDate"] <= b["fromDate"]) & (a["toDate"] >= b["toDate"])
    cwds = a["cwd"] == b["cwd"]
    dated, placed = b["kind"].isin("date_range", "cwd_date_range"), b["kind"].isin("cwd", "cwd_date_range")
    by_kind = F.when(a["kind"] == "all", True).when(a["kind"] == "date_range", dated & dates).when(a["kind"] == "cwd", placed & cwds).when(a["kind"] == "cwd_date_range", (b["kind"] == "cwd_date_range") & cwds & dates)
    return same & F.coalesce(by_kind, F.lit(False))
