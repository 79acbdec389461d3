"""The normalisers as SQL functions, for users who write SQL: ``register(spark)``, then ``SELECT fs_amount(amount)`` and the like.

Bodies are SQL expressions made from the same fixed values as the column forms; Catalyst inlines them, so nothing leaves
generated code.  ``fs_filing`` is a table function for LATERAL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from filingscope.functions import normalise as N
from filingscope.operators.flags import LAG_LIMIT

SIZE = "STRUCT<size_min: BIGINT, size_max: BIGINT, size_midpoint: BIGINT>"


def _raw(pattern: str) -> str:
    return 'r"' + pattern + '"'


def _size(low: str, high: str) -> str:
    return f"named_struct('size_min', {low}, 'size_max', {high}, 'size_midpoint', CAST(floor(({low} + {high}) / 2) AS BIGINT))"


def _whole(text: str) -> str:
    return f"try_cast(nullif({text}, '') AS BIGINT)"


def _date(text: str) -> str:
    tries = ", ".join(f"CASE WHEN {text} RLIKE {_raw(N._shape(f))} THEN try_to_date({text}, '{f}') END" for f in N.API_DATE_FORMATS)
    return f"coalesce({tries})"


def _label_size(pick: int) -> str:
    text = f"regexp_replace(regexp_replace(lower(x), '[–—]', '-'), {_raw('[$,' + chr(92) + 's]')}, '')"
    return "CAST(CASE " + " ".join(f"WHEN contains({text}, '{label}') THEN {ends[pick]}" for label, ends in N.SIZE_LABELS.items()) + " END AS BIGINT)"


def definitions() -> list[str]:
    """The statements, each function after those that it calls."""
    kinds = " ".join(f"WHEN trim(lower(x)) RLIKE '{'|'.join(words)}' THEN '{kind}'" for words, kind in N.TYPE_KEYWORDS)
    text, house = "trim(lower(x))", "coalesce(contains(lower(chamber), 'house'), false)"
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        f"{make} fs_party(x STRING) RETURNS STRING RETURN CASE WHEN {text} = '' THEN NULL WHEN startswith({text}, 'r') OR {text} = 'gop' THEN 'Republican'"
        f" WHEN startswith({text}, 'd') THEN 'Democrat' WHEN startswith({text}, 'i') THEN 'Independent' ELSE initcap({text}) END",
        f"{make} fs_tx_type(x STRING) RETURNS STRING RETURN CASE {kinds} ELSE {text} END",
        f"{make} fs_date(x STRING) RETURNS DATE RETURN {_date('trim(x)')}",
        f"{make} fs_size(x STRING) RETURNS {SIZE} RETURN {_size(_label_size(0), _label_size(1))}",
        f"{make} fs_amount_text(x STRING) RETURNS STRING RETURN trim(lower(regexp_replace(x, '[$,]', '')))",
        f"{make} fs_amount_over(x STRING) RETURNS BIGINT RETURN {_whole('regexp_extract(x, ' + _raw('([0-9]+)') + ', 1)')}",
        f"{make} fs_amount_run(x STRING, pattern STRING) RETURNS BIGINT RETURN {_whole('regexp_extract(regexp_replace(x, ' + _raw('[^0-9to–-]') + ', ' + chr(39) * 2 + '), pattern, 1)')}",
        f"{make} fs_amount_low(x STRING) RETURNS BIGINT RETURN CASE WHEN startswith(x, 'over') THEN fs_amount_over(x) ELSE fs_amount_run(x, {_raw('^[to–-]*([0-9]+)')}) END",
        f"{make} fs_amount_high(x STRING) RETURNS BIGINT RETURN CASE WHEN startswith(x, 'over') THEN fs_amount_over(x)"
        f" ELSE coalesce(fs_amount_run(x, {_raw('^[to–-]*[0-9]+[to–-]+([0-9]+)')}), fs_amount_run(x, {_raw('^[to–-]*([0-9]+)')})) END",
        f"{make} fs_amount(x STRING) RETURNS {SIZE} RETURN {_size('fs_amount_low(fs_amount_text(x))', 'fs_amount_high(fs_amount_text(x))')}",
        f"{make} fs_slug(x STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(trim(lower(x)), '[^a-z0-9]+', '-'), '^-+|-+$', '')",
        f"{make} fs_filer_id(name STRING, chamber STRING) RETURNS STRING RETURN concat(CASE WHEN {house} THEN 'FH_' ELSE 'FS_' END, fs_slug(name))",
        f"{make} fs_trade_id(filer STRING, ticker STRING, day DATE, kind STRING, chamber STRING) RETURNS STRING RETURN concat_ws('_',"
        f" CASE WHEN {house} THEN 'fmph' ELSE 'fmps' END, filer, coalesce(ticker, 'NOTICKER'), date_format(day, 'yyyyMMdd'), substring(kind, 1, 1))",
        f"{make} fs_filing(amount STRING, kind STRING, traded STRING, disclosed STRING) RETURNS TABLE(size_min BIGINT, size_max BIGINT, size_midpoint BIGINT,"
        " transaction_type STRING, trade_date DATE, disclosure_date DATE, filing_lag_days INT, filing_violation STRING) RETURN"
        " SELECT fs_amount(amount).size_min, fs_amount(amount).size_max, fs_amount(amount).size_midpoint, fs_tx_type(kind), fs_date(traded), fs_date(disclosed),"
        f" datediff(fs_date(disclosed), fs_date(traded)), CASE WHEN datediff(fs_date(disclosed), fs_date(traded)) > {LAG_LIMIT} THEN 'violation' ELSE 'compliant' END",
    ]


def register(spark: SparkSession) -> None:
    """Define all functions in the session."""
    for statement in definitions():
        spark.sql(statement)
