"""String Column functions (all JVM-side expressions, no Python UDFs).

Lengths and limits follow JavaScript string semantics: they count UTF-16
code units, while Spark's ``length`` counts code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
TRUNCATION_SUFFIX = " (truncated...)"
MAX_TEXT_NODE_LENGTH = 120
MAX_ATTR_LENGTH = 100
MAX_MODEL_HTML_CHARS = 200_000
CHARS_PER_TOKEN = 4
SLUG_MAX = 120
SAFE_NAME_MAX = 200


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def utf16_len(col) -> Column:
    """JavaScript ``s.length``: number of UTF-16 code units."""
    c = _c(col)
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_left(col, n: int) -> Column:
    """JavaScript ``s.slice(0, n)``.

    Code points equal code units when the string has no supplementary
    characters, which is the common case and stays a plain ``substring``.
    Otherwise cut the UTF-16 bytes and step back one unit rather than split a
    surrogate pair (Spark cannot hold a lone surrogate).
    """
    c = _c(col)
    raw = F.encode(c, "UTF-16BE")
    cut = F.substring(raw, 1, 2 * n)
    last_hi = F.hex(F.substring(raw, 2 * n - 1, 1))
    safe = F.when(last_hi.between("D8", "DB"), F.substring(raw, 1, 2 * n - 2)).otherwise(cut)
    return F.when(F.length(c) == utf16_len(c), F.substring(c, 1, n)).otherwise(F.decode(safe, "UTF-16BE"))


def truncate_text(col, limit: int = MAX_TEXT_NODE_LENGTH, keep: int | None = None) -> Column:
    """``s.length > limit ? s.slice(0, keep) + suffix : s`` (keep defaults to limit)."""
    c = _c(col)
    keep = limit if keep is None else keep
    return F.when(utf16_len(c) > limit, F.concat(utf16_left(c, keep), F.lit(TRUNCATION_SUFFIX))).otherwise(c)


def truncate_attr(col) -> Column:
    """Attribute values: over 100 units -> first 85 + suffix (exactly 100)."""
    return truncate_text(col, MAX_ATTR_LENGTH, max(0, MAX_ATTR_LENGTH - len(TRUNCATION_SUFFIX)))


def char_count(col) -> Column:
    """Stats ``chars``; null for null or empty text (no stats are computed then)."""
    c = _c(col)
    return F.when(c.isNull() | (F.length(c) == 0), F.lit(None).cast("long")).otherwise(utf16_len(c).cast("long"))


def token_count(col) -> Column:
    """Stats ``tokens``: the documented fallback ``ceil(chars / 4)``."""
    return F.ceil(char_count(col) / F.lit(CHARS_PER_TOKEN)).cast("long")


def text_stats(col) -> Column:
    return F.when(char_count(col).isNull(), F.lit(None)).otherwise(
        F.struct(char_count(col).alias("chars"), token_count(col).alias("tokens"))
    )


def slugify(col) -> Column:
    """Strip scheme, runs of non-alphanumerics to '-', trim '-', first 120."""
    c = _c(col)
    s = F.regexp_replace(c, r"^(?i)[a-z]+://", "")
    s = F.regexp_replace(s, r"(?i)[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.substring(s, 1, SLUG_MAX)


def safe_name(col) -> Column:
    """Each non-alphanumeric to '.', lower case, first 200."""
    c = _c(col)
    return F.substring(F.lower(F.regexp_replace(c, r"(?i)[^a-z0-9]", ".")), 1, SAFE_NAME_MAX)


def escape_text(col) -> Column:
    """Escape ``& < >`` (ampersand first)."""
    c = _c(col)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def collapse_ws(col) -> Column:
    return F.regexp_replace(_c(col), r"[ \t\n\r\f]+", " ")


def is_blank(col) -> Column:
    c = _c(col)
    return c.isNull() | (F.length(F.trim(c)) == 0)


def join_nonempty(sep: str, *cols) -> Column:
    """``[a, b].filter(Boolean).join(sep)``."""
    return F.concat_ws(sep, *[F.nullif(_c(x), F.lit("")) for x in cols])


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), 0)


# ---- URLs ---------------------------------------------------------------

def _adapt(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a code point (bias adaptation of RFC 3492)."""
    d = F.floor(delta / F.when(first, F.lit(700)).otherwise(F.lit(2)))
    d = d + F.floor(d / points)
    start = F.struct(d.alias("d"), F.lit(0).cast("long").alias("k"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda s, _: F.when(s["d"] > 455, F.struct(F.floor(s["d"] / 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s))
    return let(end, lambda e: e["k"] + F.floor(36 * e["d"] / (e["d"] + 38)))


def _digits(delta: Column, bias: Column) -> Column:
    """A number as digits of variable length (RFC 3492)."""
    digit = lambda x: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (x + 1).cast("int"), F.lit(1))

    def step(s, i):
        t = F.least(F.greatest(36 * i - bias, F.lit(1)), F.lit(26))
        more = F.struct(F.floor((s["q"] - t) / (36 - t)).alias("q"), F.lit(False).alias("done"), F.concat(s["out"], digit(t + (s["q"] - t) % (36 - t))).alias("out"))
        last = F.struct(s["q"].alias("q"), F.lit(True).alias("done"), F.concat(s["out"], digit(s["q"])).alias("out"))
        return F.when(s["done"], s).when(s["q"] < t, last).otherwise(more)

    start = F.struct(delta.alias("q"), F.lit(False).alias("done"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(14).cast("long")), start, step)["out"]


def punycode(label: Column) -> Column:
    """RFC 3492, as folds over a label's code points: those beyond ASCII in their
    order, and for each the label's."""
    points = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long"))

    def encode(cps):
        basic = F.array_join(F.transform(F.filter(cps, lambda c: c < 128), lambda c: F.char(c)), "")
        b = F.length(basic).cast("long")
        zero = F.lit(0).cast("long")
        start = F.struct(F.lit(128).cast("long").alias("n"), zero.alias("delta"), F.lit(72).cast("long").alias("bias"), b.alias("h"), F.when(b > 0, F.concat(basic, F.lit("-"))).otherwise(F.lit("")).alias("out"))

        def point(s, c):
            below = F.struct(s["n"].alias("n"), (s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))
            here = F.struct(s["n"].alias("n"), zero.alias("delta"), _adapt(s["delta"], s["h"] + 1, s["h"] == b).alias("bias"), (s["h"] + 1).alias("h"),
                            F.concat(s["out"], _digits(s["delta"], s["bias"])).alias("out"))
            return F.when(c < s["n"], below).when(c == s["n"], here).otherwise(s)

        def least(s, m):
            at = F.struct(m.alias("n"), (s["delta"] + (m - s["n"]) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))
            return let(F.aggregate(cps, at, point), lambda e: F.struct((e["n"] + 1).alias("n"), (e["delta"] + 1).alias("delta"), e["bias"].alias("bias"), e["h"].alias("h"), e["out"].alias("out")))

        return F.aggregate(F.array_sort(F.array_distinct(F.filter(cps, lambda c: c >= 128))), start, least)["out"]

    return let(points, encode)


def canonical_host(host: Column) -> Column:
    """A host as URLs hold it: percent-decoded, lower-cased, labels beyond ASCII in
    punycode, the ideographic full stops as dots. Not done: mapping by the
    Unicode tables beyond lower case, and numbers as IPv4 addresses."""
    plain = F.when(host.contains("%"), F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)).otherwise(host)
    ascii_ = lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
    spelled = lambda h: F.when(h.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(h, "[.\u3002\uff0e\uff61]"), ascii_), ".")).otherwise(h)
    return let(F.lower(plain), spelled)


def url_host(col) -> Column:
    return F.lower(F.try_parse_url(_c(col), F.lit("HOST")))


def is_valid_url(col) -> Column:
    """A URL parses when it has a scheme (``mailto:x`` is a URL too)."""
    c = _c(col)
    return F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull() & c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def host_bucket(col, buckets: int = 64) -> Column:
    """Stable hash bucket of the host, for partitioned sinks (not raw host)."""
    return F.pmod(F.xxhash64(url_host(col)), F.lit(buckets)).cast("int")
