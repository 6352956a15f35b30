"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Every step is a built-in expression over one row: no shuffle, no Python. The
cost is linear in the text: quantifiers are possessive, and a pattern that
begins with a run may start only at the run's first character or where the
previous match ended, so no start inside a failed run is tried again.

Defined results: a null or empty text has no spans; repeated rows each get a
row; an empty table gives an empty table; other columns are not touched, and
the operator's own columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import exclusive_prefix_sums, let, table


@dataclass(frozen=True)
class Kind:
    """pattern: for java.util.regex; needs: a text without a match of this has no span; base/near: score, and what context adds."""

    name: str
    pattern: str
    needs: str
    base: float
    context: str
    near: float = 0.2
    valid: str = field(default="any")


# How many characters an IBAN has, by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
#: Whole by its country's length, so that no word that follows is taken for a part of it; single spaces may stand anywhere.
IBAN = "(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"
#: Kinds in the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"e-?mail|mail|contact|correo|courriel|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|host|server|login|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, r"card|visa|master|credit|payment|karte|carte|tarjeta", valid="luhn"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|tel|call|mobile|fax|telefon|tél", valid="phone"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}}){IBAN}(?![A-Za-z0-9])", "", 0.6, r"iban|account|bank|konto|compte|cuenta", valid="mod97"),
)
#: Code points before and after a span in which context words count. A score tells how sure a span is; validators alone decide which there are.
CONTEXT = 48
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a compact IBAN leaves 1 modulo 97 (first four characters moved to the end, A=10 .. Z=35)."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: Kind, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind.name == "ip":
        return m.rlike(rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z")
    if kind.valid == "luhn":
        return F.length(m).between(16, 37) & F.length(digits).between(16, 19) & luhn(digits)
    if kind.valid == "phone":
        return F.length(digits).between(8, 15)
    if kind.valid == "mod97":
        compact = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & mod97(compact)
    return F.lit(True)


def _spans(kind: Kind, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind, by start. Offsets are code points, the end is exclusive."""
    span = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

    def located(m: Column) -> Column:
        gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g).cast("bigint"))
        return let(
            gaps,
            lambda g: let(
                exclusive_prefix_sums(F.transform(m, lambda x, i: F.get(g, i) + F.length(x))),
                lambda before: F.transform(
                    m, lambda x, i: F.struct(x.alias("m"), (F.get(before, i) + F.get(g, i)).alias("start"))
                ),
            ),
        )

    def scored(x: Column) -> Column:
        ahead = F.least(x["start"], F.lit(CONTEXT))
        words = f"(?i)(?:{kind.context})"
        before = F.substr(text, (x["start"] - ahead + 1).cast("int"), ahead.cast("int"))
        near = before.rlike(words) | F.substr(text, (x["start"] + F.length(x["m"]) + 1).cast("int"), F.lit(CONTEXT)).rlike(words)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            x["start"].alias("start"),
            (x["start"] + F.length(x["m"])).alias("end"),
            F.when(near, kind.base + kind.near).otherwise(kind.base).alias("score"),
        )

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # Offsets cost a second pass, so only texts with a confirmed match pay for it.
    found = let(
        matches,
        lambda m: F.when(
            F.exists(m, lambda x: _valid(kind, x)),
            F.transform(F.filter(located(m), lambda x: _valid(kind, x["m"])), scored),
        ).otherwise(F.array().cast(span)),
    )
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast(span)) if kind.needs else found


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: array<struct<kind, start, end, score>>, by kind as listed in KINDS, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = {f"__{k.name}": _spans(k, t) for k in KINDS}
    return df.withColumns(parts).withColumn(out, F.concat(*parts)).drop(*parts)


def redact(df: DataFrame, text: str = "text", spans: str = "pii", out: str = "redacted") -> DataFrame:
    """Adds ``out``: the text with each span replaced by ``<KIND>``; a span inside or across an earlier one is left to it."""
    by_start = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    t = F.coalesce(F.col(text), F.lit(""))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        took = F.struct(s["end"].alias("at"), F.concat(acc["done"], between, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("done"))
        return F.when(s["start"] >= acc["at"], took).otherwise(acc)

    end = lambda acc: F.concat(acc["done"], F.substr(t, (acc["at"] + 1).cast("int"), F.length(t)))
    return df.withColumn(out, F.aggregate(by_start, zero, step, end))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("pii")
    count = lambda k: F.size(F.filter(pii, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter(pii, lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    return docs.select("doc_id", "pii").select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"), count("iban"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(pii).alias("spans"),
        F.array_join(F.transform(pii, lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


_KIND_SQL = """
SELECT r, {n} AS k, '{name}' AS kind, m, g, i FROM (
  SELECT r, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(list_transform(string_split_regex(t, '{p}'), lambda x: length(x))[:-2]) AS g,
         generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i
  FROM d WHERE len(regexp_extract_all(t, '{p}')) > 0)"""

_RE2 = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b{IBAN}\b",
}

OP1_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ("""
    + "\nUNION ALL".join(_KIND_SQL.format(n=i, name=k.name, p=_RE2[k.name]) for i, k in enumerate(KINDS))
    + r"""),
located AS (SELECT r, k, kind, m, sum(g + length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m) AS s, regexp_replace(m, '[^0-9]', '', 'g') AS dg, replace(m, ' ', '') AS c FROM raw),
ok AS (
  SELECT r, k, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM located WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INT), 0) > 255)) = 0
    WHEN 'phone' THEN length(dg) BETWEEN 8 AND 15
    WHEN 'card' THEN length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(dg), ''), lambda x, j: CASE WHEN j % 2 = 1 THEN x::INT WHEN x::INT < 5 THEN x::INT * 2 ELSE x::INT * 2 - 9 END)) % 10 = 0
    ELSE length(c) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(c[5:] || c[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x::INT ELSE 100 + ascii(x) - 55 END)), lambda a, x: CASE WHEN x < 100 THEN (a * 10 + x) % 97 ELSE (a * 100 + x - 100) % 97 END) = 1 END),
words AS (SELECT ok.*, t, '(?i)(?:' || CASE kind """
    + " ".join(f"WHEN '{k.name}' THEN '{k.context}'" for k in KINDS)
    + r""" END || ')' AS w FROM ok JOIN d USING (r)),
ctx AS (SELECT * EXCLUDE (t, w), CASE WHEN regexp_matches(substr(t, (greatest(s - 48, 0) + 1)::INT, least(s, 48)::INT), w) OR regexp_matches(substr(t, (e + 1)::INT, 48), w) THEN 0.2 ELSE 0 END + CASE kind """
    + " ".join(f"WHEN '{k.name}' THEN {k.base}" for k in KINDS)
    + r""" END AS score FROM words),
per AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone, count(*) FILTER (WHERE k = 4) AS n_iban,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k < 4), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
    string_agg(printf('%.1f', score::DOUBLE), ',' ORDER BY k, s) AS scores
  FROM ctx GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN per USING (r)"""
)
