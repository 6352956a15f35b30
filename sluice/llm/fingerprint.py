"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Sections are what blank lines (``\\n\\n``) part, paragraphs are lines, and leaves
are sentences, or runs of 200 code points where a sentence is longer. The pieces
cover the text without loss and each node hashes its children, so equal roots
mean equal texts, and differing branches lead to what was edited.

Printed form: ``root|section|section..``, a section being
``hash:paragraph,paragraph..`` and a paragraph ``hash=leaf.leaf..``; inner hashes
are cut for print only, parents are built from whole ones.

Everything is one expression a row. For the next document, rows are dealt to
stretches of the order (id descending, then MD5 of the text), which are bounded
by keys: every ``step``-th key of the table, found from ids and digests alone. A
row's stretch is a binary search in those bounds, so any 64-bit ids, sparse or
repeated, make stretches of like size. Each stretch's first row is copied to the
stretch before it; whole texts are shuffled once. Which branches an edit changed
is found by descent from the roots of both trees.

Defined results: a null or empty text is one section with one empty paragraph;
rows with one id follow each other by the MD5 of their text; null ids come last;
of a single row the next document is itself; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import count_partitions, let, table, written

LEAF = r"[^.!?]{1,200}[.!?]*|[.!?]+"
#: Rows of a stretch of the order; more, if there would be more than MAX_BOUNDS stretches.
STRETCH_ROWS = 2048
MAX_BOUNDS = 65_536
_PRINT = {"section": 12, "paragraph": 8, "leaf": 8}


def merkle_tree(text: Column) -> Column:
    """array<struct<hash, paragraphs array<struct<hash, leaves array<string>>>>>, whole MD5s."""

    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), F.md5)
        return let(leaves, lambda x: F.struct(F.md5(F.array_join(x, "")).alias("hash"), x.alias("leaves")))

    def section(block: Column) -> Column:
        return let(
            F.transform(F.split(block, "\n", -1), paragraph),
            lambda p: F.struct(F.md5(F.array_join(F.transform(p, lambda x: x["hash"]), "")).alias("hash"), p.alias("paragraphs")),
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)


def root_of(tree: Column) -> Column:
    return F.sha2(F.array_join(F.transform(tree, lambda s: s["hash"]), ""), 256)


def _printed(tree: Column) -> Column:
    cut = lambda c, kind: F.substring(c, 1, _PRINT[kind])
    leaves = lambda p: F.array_join(F.transform(p["leaves"], lambda x: cut(x, "leaf")), ".")
    paragraphs = lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.concat(cut(p["hash"], "paragraph"), F.lit("="), leaves(p))), ",")
    return F.concat(root_of(tree), F.lit("|"), F.array_join(F.transform(tree, lambda s: F.concat(cut(s["hash"], "section"), F.lit(":"), paragraphs(s))), "|"))


def fingerprint(text: Column) -> Column:
    return let(merkle_tree(text), _printed)


def fingerprint_leaves(printed: Column) -> Column:
    """The distinct leaves of a printed fingerprint."""
    return F.array_distinct(F.regexp_extract_all(printed, F.lit("[=.]([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared leaves over the leaves of both; 1 for equal roots, 0 if there is nothing to share."""
    dice = let(
        F.struct(fingerprint_leaves(a).alias("a"), fingerprint_leaves(b).alias("b")),
        lambda s: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, 0.0).otherwise(
            2.0 * F.size(F.array_intersect(s["a"], s["b"])) / (F.size(s["a"]) + F.size(s["b"]))
        ),
    )
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(dice)


def differing_branches(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph, leaf>> of positions (from 0) in ``a`` whose leaf differs from ``b``'s at that place.

    Both are trees of merkle_tree(). Branches with equal hashes are not descended.
    """

    def leaves(p: Column, q: Column, i: Column, j: Column) -> Column:
        place = F.transform(p["leaves"], lambda x, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf"), x.alias("x")))
        return F.filter(place, lambda x: ~x["x"].eqNullSafe(F.get(q["leaves"], x["leaf"])))

    def paragraphs(s: Column, t: Column, i: Column) -> Column:
        nothing = F.filter(F.array(F.struct(i.alias("section"), i.alias("paragraph"), i.alias("leaf"), F.lit("").alias("x"))), lambda _: F.lit(False))
        per = F.transform(
            s["paragraphs"],
            lambda p, j: let(F.get(t["paragraphs"], j), lambda q: F.when(p["hash"].eqNullSafe(q["hash"]), nothing).otherwise(leaves(p, q, i, j))),
        )
        return F.when(s["hash"].eqNullSafe(t["hash"]), nothing).otherwise(F.flatten(per))

    found = F.flatten(F.transform(a, lambda s, i: let(F.get(b, i), lambda t: paragraphs(s, t, i))))
    return F.transform(found, lambda x: F.struct(x["section"], x["paragraph"], x["leaf"]))


_KEY = "struct<none:int,down:bigint,tie:string>"


def _bounds(keys: DataFrame) -> list[tuple[int, int, str]]:
    """keys: ``k``, a struct of _KEY a row. Every step-th key in order, from the first on: at most MAX_BOUNDS and one a task."""
    parts = count_partitions(keys.sparkSession)
    keys = written(keys.distinct(), "keys")
    ordered = written(keys.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()), "order")
    step = max(STRETCH_ROWS, -(-ordered.count() // MAX_BOUNDS))
    nth = F.row_number().over(W.partitionBy("part").orderBy("k"))
    found = ordered.withColumn("nth", nth).where(F.pmod(F.col("nth") - 1, F.lit(step)) == 0).select("k.none", "k.down", "k.tie").collect()
    return sorted(tuple(r) for r in found)


def with_next(docs: DataFrame, id_col: str, carried: list[str], prefix: str = "next_") -> DataFrame:
    """Adds ``prefix + c`` for each carried column of the next row in descending id order; after the last comes the first."""
    # ~id ascends as the id descends, for every 64-bit id.
    tie = F.md5(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in carried)))
    none = F.col(id_col).isNull()
    key = F.struct(none.cast("int").alias("none"), F.bitwise_not(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))).alias("down"), tie.alias("tie"))
    bounds = _bounds(docs.select(key.alias("k")))
    as_json = json.dumps([dict(zip(("none", "down", "tie"), b, strict=True)) for b in bounds])
    every = F.from_json(F.lit(as_json), f"array<{_KEY}>")
    # How many bounds stand at or below a key, by halving.
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))))
    upto = F.aggregate(halves, F.lit(0), lambda n, h: F.when((n + h <= len(bounds)) & (F.get(every, n + h - 1) <= F.col("__k")), n + h).otherwise(n))
    rows = docs.withColumn("__k", key).withColumn("__g", upto)
    is_head = F.get(every, F.col("__g") - 1) == F.col("__k")
    before = F.when(F.col("__g") > 1, F.col("__g") - 1).otherwise(len(bounds))
    own = F.struct(F.col("__g").alias("g"), F.lit(False).alias("copy"))
    dealt = rows.withColumn("__at", F.explode(F.when(is_head, F.array(own, F.struct(before.alias("g"), F.lit(True).alias("copy")))).otherwise(F.array(own))))
    order = W.partitionBy("__at.g").orderBy("__at.copy", "__k")
    # Plain columns: of a struct of them, the shuffle would carry a second copy.
    led = dealt.withColumns({prefix + c: F.lead(c).over(order) for c in carried}).where(~F.col("__at.copy"))
    return led.drop("__k", "__g", "__at")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", ["text"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))

    def compared(own: Column, new: Column) -> Column:
        edits = differing_branches(own, new)
        place = lambda e: F.concat_ws(".", e["section"], e["paragraph"], e["leaf"])
        return F.struct(
            _printed(own).alias("fp"), _printed(new).alias("efp"),
            let(edits, lambda e: F.struct(F.size(e).cast("bigint").alias("n"), place(F.get(e, F.lit(0))).alias("first"))).alias("edits"),
        )

    trees = let(merkle_tree(F.col("text")), lambda a: let(merkle_tree(F.col("edited")), lambda b: compared(a, b)))
    docs = docs.withColumn("edited", edited).select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("sha"), trees.alias("t"), fingerprint(F.col("next_text")).alias("nfp"))
    return docs.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("t.fp").alias("fingerprint"), F.col("t.efp").alias("edited_fingerprint"),
        likeness(F.col("t.fp"), F.col("t.efp")).alias("near_edited"), likeness(F.col("t.fp"), F.col("nfp")).alias("near_next"),
        F.col("t.edits.n").alias("n_edits"), F.when(F.col("t.edits.n") > 0, F.col("t.edits.first")).alias("first_edit"),
    )


def _sql_fingerprint(t: str) -> str:
    leaves = f"list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: md5(x))"
    tree = f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {leaves}))"
    hashed = f"list_transform({tree}, lambda s: list_transform(s, lambda l: struct_pack(h := md5(array_to_string(l, '')), l := array_to_string(list_transform(l, lambda x: x[:8]), '.'))))"
    sections = f"list_transform({hashed}, lambda s: struct_pack(h := md5(array_to_string(list_transform(s, lambda p: p.h), '')), p := array_to_string(list_transform(s, lambda p: p.h[:8] || '=' || p.l), ',')))"
    return f"list_transform([{sections}], lambda z: sha256(array_to_string(list_transform(z, lambda s: s.h), '')) || '|' || array_to_string(list_transform(z, lambda s: s.h[:12] || ':' || s.p), '|'))[1]"


def _sql_edits(a: str, b: str) -> str:
    """Places (section.paragraph.leaf) of a's leaves that b has not there."""
    tree = lambda t: f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: regexp_extract_all(p, '{LEAF}')))"
    leaf = "lambda x, k: struct_pack(at := (i - 1) || '.' || (j - 1) || '.' || (k - 1), same := x IS NOT DISTINCT FROM z.b[i][j][k])"
    every = f"flatten(list_transform(z.a, lambda s, i: flatten(list_transform(s, lambda p, j: list_transform(p, {leaf})))))"
    trees = f"struct_pack(a := {tree(a)}, b := {tree(b)})"
    return f"list_transform([{trees}], lambda z: list_transform(list_filter({every}, lambda x: NOT x.same), lambda x: x.at))[1]"


def _sql_near(a: str, b: str) -> str:
    la, lb = (f"list_distinct(regexp_extract_all({x}, '[=.]([0-9a-f]{{8}})', 1))" for x in (a, b))
    return f"CASE WHEN {a}[:64] = {b}[:64] THEN 1.0::DOUBLE WHEN len({la}) + len({lb}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect({la}, {lb})) / (len({la}) + len({lb})) END"


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, t, {_sql_fingerprint('t')} AS fp FROM d),
w AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt, coalesce(lead(fp) OVER (ORDER BY doc_id DESC), first_value(fp) OVER (ORDER BY doc_id DESC)) AS nfp FROM f),
e AS (SELECT doc_id, t, length(t) AS n, fp, nfp, substr(t, 1, length(t) - length(t) // 3) || substr(nt, 1, length(t) // 3) AS et FROM w),
g AS (SELECT *, {_sql_fingerprint('et')} AS efp, {_sql_edits('t', 'et')} AS edits FROM e)
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint, {_sql_near('fp', 'efp')} AS near_edited, {_sql_near('fp', 'nfp')} AS near_next,
  len(edits)::BIGINT AS n_edits, edits[1] AS first_edit FROM g"""
