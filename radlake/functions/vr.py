"""Checks of values by DICOM value representation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes and operators (fixed values).
NUMERIC = ["FL", "FD", "SL", "SS", "UL", "US", "IS", "DS"]
STRING = ["AE", "CS", "LO", "LT", "PN", "SH", "ST", "UT", "UI"]
DATETIME = ["DA", "DT", "TM"]
NUMERIC_OPERATORS = ["EQUALS", "NOT_EQUALS", "GREATER_THAN", "LESS_THAN", "GREATER_THAN_OR_EQUAL_TO", "LESS_THAN_OR_EQUAL_TO"]
STRING_OPERATORS = [
    "CASE_SENSITIVE_STRING_CONTAINS", "CASE_INSENSITIVE_STRING_CONTAINS", "CASE_SENSITIVE_STRING_DOES_NOT_CONTAIN", "CASE_INSENSITIVE_STRING_DOES_NOT_CONTAIN",
    "CASE_SENSITIVE_STRING_EXACT_MATCH", "CASE_INSENSITIVE_STRING_EXACT_MATCH", "EQUALS", "NOT_EQUALS",
]
_FLOAT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+|inf|infinity|nan)([eE][+-]?\d+)?\s*$"
_RANGES = {"SL": (-(2**31), 2**31 - 1), "SS": (-(2**15), 2**15 - 1), "UL": (0, 2**32 - 1), "US": (0, 2**16 - 1)}


def _number(value: Column) -> Column:
    return F.when(value.rlike("(?i)" + _FLOAT), value.try_cast("double"))


def valid_for(value: Column, vr: str) -> Column:
    """Whether a non-empty value obeys one representation."""
    size = F.char_length(value)
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    whole = F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("decimal(38,0)"))
    real_date = F.try_to_timestamp(value, F.lit("yyyyMMdd")).isNotNull()
    checks = {
        "AE": (size <= 16) & ~value.rlike(r"[\\\x00-\x1f]"),
        "AS": value.rlike(r"^\d{3}[DWMY]$") & (size == 4),
        "AT": value.rlike(r"^\([0-9A-Fa-f]{4},[0-9A-Fa-f]{4}\)$"),
        "CS": (size <= 16) & value.rlike(r"^[A-Za-z0-9 _]*$"),
        "DA": F.when(value.rlike(r"^\d{8}$"), real_date).otherwise(False),
        "DS": (size <= 16) & bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"),
        "DT": (size <= 26) & bare.rlike(r"^\d{4}(\d{2}(\d{2}(\d{2}(\d{2}(\d{2}(\.\d{1,6})?)?)?)?)?)?([+-]\d{4})?$"),
        "FL": F.coalesce(F.abs(_number(value)) <= 3.4e38, F.lit(False)),
        "FD": _number(value).isNotNull(),
        "IS": (size <= 12) & F.coalesce(whole.between(-(2**31), 2**31 - 1), F.lit(False)),
        "LO": (size <= 64) & ~value.contains("\\"),
        "SH": (size <= 16) & ~value.contains("\\"),
        "LT": size <= 10240,
        "ST": size <= 1024,
        "UT": size <= 2**32 - 2,
        "PN": F.forall(F.split(value, "="), lambda g: (F.char_length(g) <= 64) & ~g.contains("\\")),
        "TM": (size <= 16) & bare.rlike(r"^\d{2}(\d{2}(\d{2}(\.\d{1,6})?)?)?$"),
        "UI": (size <= 64) & bare.rlike(r"^\d+(\.\d+)*$"),
    }
    if vr in _RANGES:
        return F.coalesce(whole.between(*_RANGES[vr]), F.lit(False))
    return checks.get(vr, size <= 1024)


def valid(value: Column, vr: Column) -> Column:
    """Whether a value obeys the representation in another column; empty or null is valid."""
    out = F.lit(None).cast("boolean")
    for code in [*NUMERIC, *STRING, *DATETIME, "AS", "AT"]:
        out = F.when(vr == code, valid_for(value, code)).otherwise(out)
    known = vr.isin(*NUMERIC, *STRING, *DATETIME, "AS", "AT")
    empty = F.coalesce(value, F.lit("")).eqNullSafe("") | F.coalesce(vr, F.lit("")).eqNullSafe("")
    return F.when(empty, True).when(known, out).otherwise(F.char_length(value) <= 1024)


def operators(vr: Column) -> Column:
    """The rule operators that fit a representation."""
    both = NUMERIC_OPERATORS + [o for o in STRING_OPERATORS if o not in NUMERIC_OPERATORS]
    lists = [(NUMERIC, NUMERIC_OPERATORS), (STRING, STRING_OPERATORS), (DATETIME, both)]
    out = F.array(F.lit("EQUALS"), F.lit("NOT_EQUALS"))
    for codes, names in lists:
        out = F.when(vr.isin(codes), F.array(*map(F.lit, names))).otherwise(out)
    return out


#: What a form says about each representation: code, description, format, example (fixed values).
GUIDANCE = [
    ("AE", "Enter text string (letters, numbers, spaces) up to 16 characters", "String up to 16 characters, no backslash or control chars", "WORKSTATION1"),
    ("AS", "Enter age in format: number + D/W/M/Y (days/weeks/months/years)", "nnnD, nnnW, nnnM, or nnnY (days/weeks/months/years)", "018M (18 months), 065Y (65 years)"),
    ("AT", "Enter DICOM tag in format (GGGG,EEEE) using hexadecimal numbers", "Hexadecimal tag in format (GGGG,EEEE)", "(0018,00FF)"),
    ("CS", "Enter text string with uppercase letters, numbers, spaces, underscores only", "Uppercase letters, digits, space, underscore. Max 16 chars", "ORIGINAL, DERIVED"),
    ("DA", "Enter date in format YYYYMMDD (year, month, day as 8 digits)", "YYYYMMDD format", "19930822 (August 22, 1993)"),
    ("DS", "Enter decimal number (can include decimal point and scientific notation)", "Fixed or floating point number. Max 16 chars", "123.456, -0.5, 1.23E-4"),
    ("DT", "Enter date and time in format YYYYMMDDHHMMSS", "YYYYMMDDHHMMSS.FFFFFF&ZZXX", "20230822143000.123456 (Aug 22, 2023 2:30 PM)"),
    ("FL", "Enter decimal number (floating point)", "IEEE 754 single precision floating point", "123.456"),
    ("FD", "Enter decimal number (high precision floating point)", "IEEE 754 double precision floating point", "123.456789012345"),
    ("IS", "Enter whole number (positive or negative integer)", "Integer in base-10, optional +/- sign. Max 12 chars", "123, -456, +789"),
    ("LO", "Enter text string (letters, numbers, symbols) up to 64 characters", "Character string up to 64 characters", "Patient description or study notes"),
    ("LT", "Enter long text (can include multiple lines) up to 10,240 characters", "Text up to 10240 characters, may contain paragraphs", "Detailed clinical notes with multiple paragraphs"),
    ("PN", "Enter person name using ^ to separate: Family^Given^Middle^Prefix^Suffix", "Family^Given^Middle^Prefix^Suffix (up to 64 chars per group)", "Doe^John^Michael^Dr^Jr"),
    ("SH", "Enter short text string up to 16 characters", "Character string up to 16 characters", "Short description"),
    ("SL", "Enter whole number (32-bit signed integer)", "32-bit signed integer (-2³¹ to 2³¹-1)", "-2147483648 to 2147483647"),
    ("SS", "Enter whole number (16-bit signed integer)", "16-bit signed integer (-32768 to 32767)", "-32768 to 32767"),
    ("ST", "Enter text (can include multiple lines) up to 1,024 characters", "Text up to 1024 characters, may contain paragraphs", "Clinical findings or procedure notes"),
    ("TM", "Enter time in format HHMMSS (24-hour format)", "HHMMSS.FFFFFF (24-hour format)", "143000.123456 (2:30 PM)"),
    ("UI", "Enter unique identifier with numbers separated by dots", "Numeric components separated by dots. Max 64 chars", "1.2.840.10008.1.2.1"),
    ("UL", "Enter positive whole number (32-bit unsigned integer)", "32-bit unsigned integer (0 to 2³²-1)", "0 to 4294967295"),
    ("US", "Enter positive whole number (16-bit unsigned integer)", "16-bit unsigned integer (0 to 65535)", "0 to 65535"),
    ("UT", "Enter very long text (can include multiple paragraphs)", "Text up to 2³²-2 characters, may contain paragraphs", "Very long clinical reports or documentation"),
]


def guidance(rows: DataFrame, vr: str) -> DataFrame:
    """Adds description, format and example of each row's representation; those of text for an unknown one."""
    table = rows.sparkSession.createDataFrame(GUIDANCE, "_vr string, description string, format string, example string")
    shown = rows.join(F.broadcast(table), F.col(vr) == F.col("_vr"), "left").drop("_vr")  # one row per code
    unknown = [F.concat(F.lit("Enter value according to DICOM standard for "), F.coalesce(vr, F.lit(""))), F.lit("See DICOM standard for format requirements"), F.lit("Refer to DICOM documentation")]
    return shown.withColumns({name: F.coalesce(name, text) for name, text in zip(("description", "format", "example"), unknown)})
