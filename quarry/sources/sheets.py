"""Spreadsheets: delimited text without declared types."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_url(url: str) -> str:
    """Address of the CSV export of a shared spreadsheet's tab; others unchanged."""
    parts = urlsplit(url)
    found = re.match(r"/spreadsheets/d/([\w-]+)", parts.path)
    if parts.hostname != "docs.google.com" or not found:
        return url
    gid = (parse_qs(parts.fragment).get("gid") or parse_qs(parts.query).get("gid") or ["0"])[0]
    return f"https://docs.google.com/spreadsheets/d/{found[1]}/export?format=csv&gid={gid}"


def slugs(headers: list[str]) -> list[str]:
    """Identifiers of headers: words in lower case joined by _, numbered if repeated;
    a blank header is its place."""
    out: list[str] = []
    for k, h in enumerate(headers, 1):
        plain = "".join(c for c in unicodedata.normalize("NFKD", h or "") if not unicodedata.combining(c)).lower().replace("&", " and ")
        base = "_".join(re.findall("[a-z0-9]+", plain)) or f"column_{k}"
        name, n = base, 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """row_index and one text column per header. Quoted line breaks and doubled
    quotes are read, a byte order mark and all-blank rows are dropped, short rows
    end in blanks. row_index orders rows as the file does; it has gaps."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False).options(**options).csv(path)
    named = raw.toDF(*slugs([re.sub("^﻿", "", c) if not re.fullmatch(r"_c\d+", c) else "" for c in raw.columns]))
    text = named.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in named.columns))
    some = F.concat_ws("", *(F.trim(F.col(c)) for c in text.columns)) != ""
    return text.select(F.monotonically_increasing_id().alias("row_index"), "*").filter(some)
