"""String functions as column-level operators.

Each ``fn(df, column, ..., output=None)`` writes ``output`` or replaces
``column`` in place, unless a default output name is part of the contract.
All are JVM built-ins inside whole-stage codegen; only the two edit
distances Spark lacks (Jaro-Winkler, Damerau) use an Arrow pandas UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from lakeloom.core import with_result
from lakeloom.functions import batch_similarity


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def _java_replacement(rep: str) -> str:
    # Back-references \1 → $1; a literal $ must be escaped for Java.
    rep = rep.replace("$", r"\$")
    return re.sub(r"\\(\d)", r"$\1", rep)


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str = "", output: str | None = None) -> DataFrame:
    return with_result(df, column, F.regexp_replace(_s(column), F.lit(pattern), F.lit(_java_replacement(replacement))), output)


def regex_extract(df: DataFrame, column: str, pattern: str, group_index: int = 0, group_names=None,
                  output: str | None = None) -> DataFrame:
    """Group text ('' when no match); ``group_names`` → a struct whose Nth
    field is the Nth capture group."""
    if group_names:
        names = [n.strip() for n in (group_names.split(",") if isinstance(group_names, str) else group_names) if n.strip()]
        e = F.struct(*[F.regexp_extract(_s(column), pattern, i + 1).alias(n) for i, n in enumerate(names)])
    else:
        e = F.regexp_extract(_s(column), pattern, max(int(group_index), 0))
    return with_result(df, column, e, output)


def regex_match(df: DataFrame, column: str, pattern: str, output: str | None = None) -> DataFrame:
    """Partial-match boolean."""
    return with_result(df, column, _s(column).rlike(pattern), output)


def trim(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.trim(_s(column)), output)


def case_change(df: DataFrame, column: str, pattern: str = "upper", output: str | None = None) -> DataFrame:
    p = pattern.lower()
    e = F.lower(_s(column)) if p == "lower" else F.initcap(_s(column)) if p in ("title", "initcap", "proper") else F.upper(_s(column))
    return with_result(df, column, e, output)


def length(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.length(_s(column)).cast("bigint"), output)


def substring(df: DataFrame, column: str, start: int = 1, length: int | None = None, output: str | None = None) -> DataFrame:
    s = max(int(start), 1)
    e = F.substring(_s(column), s, int(length)) if length is not None else F.expr(f"substring(CAST(`{column}` AS STRING), {s})")
    return with_result(df, column, e, output)


def concat_suffix(df: DataFrame, column: str, suffix: str, output: str | None = None) -> DataFrame:
    """Append a literal; a NULL value yields just the literal."""
    return with_result(df, column, F.concat_ws("", _s(column), F.lit(suffix)), output)


def split(df: DataFrame, column: str, separator: str, output: str | None = None) -> DataFrame:
    """Literal separator → array."""
    return with_result(df, column, F.split(_s(column), re.escape(separator), -1), output)


def _escape_stray_percents(pattern: str) -> str:
    # no space flag: "50% off" is text; Java knows %d only for %i and %u
    spec = re.compile(r"%(?:%|[-+#0]*\d*(?:\.\d+)?[sdiufeEgGxXocb])")
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "%":
            m = spec.match(pattern, i)
            if m:
                out.append(re.sub("[iu]$", "d", m.group(0)))
                i = m.end()
                continue
            out.append("%%")
        else:
            out.append(pattern[i])
        i += 1
    return "".join(out)


def format_string(df: DataFrame, column: str, pattern: str, output: str | None = None) -> DataFrame:
    """printf-style formatting of one column; stray ``%`` is kept literally."""
    return with_result(df, column, F.format_string(_escape_stray_percents(pattern), F.col(column)), output)


def text_replace(df: DataFrame, column: str, search: str, replacement: str = "", output: str | None = None) -> DataFrame:
    return with_result(df, column, F.replace(_s(column), F.lit(search), F.lit(replacement)), output)


def slug(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    e = F.regexp_replace(F.lower(_s(column)), "[^a-z0-9]+", "-")
    e = F.regexp_replace(e, "^-+|-+$", "")
    return df.withColumn(output or f"{column}_slug", e)


def strip_html(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return with_result(df, column, F.regexp_replace(_s(column), "<[^>]+>", ""), output)


def text_reverse(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_reversed", F.reverse(_s(column)))


def text_repeat(df: DataFrame, column: str, count: int = 2, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{column}_repeated", F.repeat(_s(column), int(count)))


def text_match(df: DataFrame, column: str, needle: str, mode: str = "contains", output: str | None = None) -> DataFrame:
    s = _s(column)
    e = {"contains": F.contains(s, F.lit(needle)), "starts_with": F.startswith(s, F.lit(needle)),
         "ends_with": F.endswith(s, F.lit(needle))}[mode]
    return df.withColumn(output or f"{column}_{mode}", e)


def pad(df: DataFrame, column: str, length: int, fill: str = " ", side: str = "left", output: str | None = None) -> DataFrame:
    """Pad to ``length``; longer strings are cut."""
    f = F.lpad if side == "left" else F.rpad
    return with_result(df, column, f(_s(column), int(length), fill or " "), output)


def base64_codec(df: DataFrame, column: str, mode: str = "encode", output: str | None = None) -> DataFrame:
    """UTF-8 safe base64; Spark's line wrapping (CRLF every 76 chars) is removed."""
    if mode == "encode":
        e = F.regexp_replace(F.base64(F.encode(_s(column), "UTF-8")), "[\\r\\n]", "")
    else:
        e = F.decode(F.unbase64(_s(column)), "UTF-8")
    return df.withColumn(output or f"{column}_{mode}", e)


def hash_column(df: DataFrame, column: str, algorithm: str = "md5", output: str | None = None) -> DataFrame:
    """Digest of the text form; ``hash`` is xxhash64 (engine-specific value)."""
    s = _s(column)
    a = algorithm.lower()
    e = {"md5": lambda: F.md5(s), "sha1": lambda: F.sha1(s), "sha256": lambda: F.sha2(s, 256),
         "hash": lambda: F.xxhash64(s)}[a]()
    return df.withColumn(output or f"{column}_hash", e)


# ---------------------------------------------------------------------------
# Similarity scores
# ---------------------------------------------------------------------------

@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity (prefix scale 0.1 over up to 4 letters, above 0.7 only)."""
    values, null = batch_similarity.jaro_winkler(a.tolist(), b.tolist())
    return pd.Series(values).mask(null)


@F.pandas_udf(LongType())
def damerau_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unrestricted Damerau-Levenshtein distance (adjacent transpositions may be edited
    again), as the SQL engine computes it."""
    values, null = batch_similarity.damerau(a.tolist(), b.tolist())
    return pd.Series(values).astype("Int64").mask(null)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard over the character SETS of two strings; NULL if both empty."""
    sa, sb = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    sa = F.filter(sa, lambda x: x != "")
    sb = F.filter(sb, lambda x: x != "")
    u = F.size(F.array_union(sa, sb))
    return F.when(u > 0, F.size(F.array_intersect(sa, sb)) / u)


def similarity_expr(a: Column, b: Column, algorithm: str) -> Column:
    alg = algorithm.lower().replace("-", "_")
    if alg == "levenshtein":
        return F.levenshtein(a, b).cast("bigint")
    if alg == "jaccard":
        return char_jaccard(a, b)
    if alg == "jaro_winkler":
        return jaro_winkler_udf(a, b)
    if alg == "damerau_levenshtein":
        return damerau_udf(a, b)
    raise ValueError(f"unknown similarity algorithm {algorithm!r}")


def text_similarity(df: DataFrame, left_column: str, right_column: str, algorithm: str = "levenshtein",
                    output: str | None = None) -> DataFrame:
    e = similarity_expr(_s(left_column), _s(right_column), algorithm)
    return df.withColumn(output or f"{algorithm}_score", e)


# ---------------------------------------------------------------------------
# URL / IP
# ---------------------------------------------------------------------------

# Fixed value: one URL regex, scheme optional; groups scheme, host, port,
# path, query, fragment.
URL_RE = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*)://)?([^:/?#]*)(?::([0-9]+))?(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$"
URL_GROUPS = {"scheme": 1, "host": 2, "port": 3, "path": 4, "query": 5, "fragment": 6}


def url_parse(df: DataFrame, column: str, kind: str = "host", output: str | None = None) -> DataFrame:
    idx = URL_GROUPS.get(kind, 2)
    return df.withColumn(output or f"{column}_{kind}", F.regexp_extract(_s(column), URL_RE, idx))


def _ipv4_int(addr: Column) -> Column:
    parts = F.split(addr, "\\.")
    return sum(parts.getItem(i).cast("bigint") * (256 ** (3 - i)) for i in range(4))


def _int_ipv4(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(n, 8 * (3 - i)).bitwiseAND(255).cast("string") for i in range(4)])


def ip_parse(df: DataFrame, column: str, kind: str = "host", output: str | None = None) -> DataFrame:
    """INET parts with integer bit maths for IPv4; IPv6 supports host,
    family and masklen."""
    s = F.trim(_s(column))
    addr = F.split(s, "/").getItem(0)
    is_v6 = F.contains(addr, F.lit(":"))
    has_len = F.contains(s, F.lit("/"))
    masklen = F.when(has_len, F.split(s, "/").getItem(1).cast("int")).otherwise(F.when(is_v6, 128).otherwise(32))
    ip = _ipv4_int(addr)
    mask = (F.lit(1 << 32) - F.pow(F.lit(2), 32 - masklen).cast("bigint")).cast("bigint")
    hostmask = F.lit(0xFFFFFFFF).cast("bigint") - mask
    v4 = {
        "host": addr,
        "family": F.lit(4),
        "masklen": masklen,
        "netmask": _int_ipv4(mask),
        "hostmask": _int_ipv4(hostmask),
        "network": F.concat(_int_ipv4(ip.bitwiseAND(mask)), F.lit("/"), masklen.cast("string")),
        "broadcast": F.concat(_int_ipv4(ip.bitwiseOR(hostmask)), F.lit("/"), masklen.cast("string")),
    }
    v6 = {"host": addr, "family": F.lit(6), "masklen": masklen}
    if kind not in v4:
        kind = "host"
    e = F.when(is_v6, v6.get(kind, F.lit(None))).otherwise(v4[kind])
    if kind in ("family", "masklen"):
        e = e.cast("int")
    return df.withColumn(output or f"{column}_{kind}", e)


# ---------------------------------------------------------------------------
# PII redaction and prompt templates
# ---------------------------------------------------------------------------

# PII patterns, applied in this order (card before phone).
PII_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED-EMAIL]"),
    ("credit_card", r"\b(?:\d[ -]*?){13,19}\b", "[REDACTED-CREDIT-CARD]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED-SSN]"),
    ("phone", r"(?:\+?\d{1,3}[ -])?(?:\(\d{3}\)[ -]?|\d{3}[ -])\d{3}[ -]\d{4}\b", "[REDACTED-PHONE]"),
]


def pii_redact_expr(c: Column, types=None) -> Column:
    want = set(types.split(",") if isinstance(types, str) else types or [])
    want = {w.strip() for w in want if w.strip()}
    e = F.coalesce(c.cast("string"), F.lit(""))
    for name, pattern, label in PII_PATTERNS:
        if not want or name in want:
            # A cheap exact pre-check skips texts where the pattern cannot
            # match (no '@' for an email, no digit for the numeric ones).
            guard = F.contains(e, F.lit("@")) if name == "email" else e.rlike(r"\d")
            e = F.when(guard, F.regexp_replace(e, pattern, label)).otherwise(e)
    return e


def pii_redact(df: DataFrame, input_column: str = "text", output: str | None = None, types=None) -> DataFrame:
    """Ordered regex redaction; NULL input becomes ''."""
    return df.withColumn(output or input_column, pii_redact_expr(F.col(input_column), types))


def prompt_render_expr(template: str, columns: list[str]) -> Column:
    """Compile ``{col}`` placeholders to a concat; missing or NULL → '',
    an unclosed ``{`` is kept literally."""
    parts: list[Column] = []
    i = 0
    while i < len(template):
        j = template.find("{", i)
        if j < 0:
            parts.append(F.lit(template[i:]))
            break
        k = template.find("}", j + 1)
        if k < 0:
            parts.append(F.lit(template[i:]))
            break
        if j > i:
            parts.append(F.lit(template[i:j]))
        name = template[j + 1:k].strip()
        parts.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in columns else F.lit(""))
        i = k + 1
    return F.concat(*parts) if parts else F.lit("")


def prompt_render(df: DataFrame, template: str, output: str = "prompt") -> DataFrame:
    return df.withColumn(output, prompt_render_expr(template, df.columns))


def label_normalize(df: DataFrame, column: str, categories, output: str | None = None,
                    unknown: str = "UNKNOWN") -> DataFrame:
    """Case-insensitive match of a free-text label to a listed category,
    else ``UNKNOWN``."""
    cats = [c.strip() for c in (categories.split(",") if isinstance(categories, str) else categories) if c.strip()]
    m = F.create_map(*[x for c in cats for x in (F.lit(c.lower()), F.lit(c))])
    e = F.coalesce(F.try_element_at(m, F.lower(F.trim(_s(column)))), F.lit(unknown))
    return with_result(df, column, e, output)
