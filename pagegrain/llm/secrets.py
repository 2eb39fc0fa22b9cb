"""Secret scans by linking the parts of a credential.

Base kinds are reported wherever they stand. Weak candidates (names of accounts, secret-like
tokens, endpoints) are reported only where the parts that complete them stand within
``SCOPE`` characters of the same document: an identifier needs a secret, a secret an
identifier, an endpoint both. Parts meet in an interval join on (document, bucket of
``SCOPE`` characters). DataFrame functions only; positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import load, packed, unpacked

SCOPE = 200
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]{16,})"
HEX = r"()([0-9a-f]{24,})"
IDENTIFIER = r"""((?i:user(?:name|_id)?|login|account|client_id|access_key(?:_id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])()([A-Za-z0-9+/_=-]{16,})"
ENDPOINT = r"(https?://)([A-Za-z0-9._~:/?#@!$&()*+,;=%-]+)"
#: name, pattern, least length of group 2, role, weak; the order is that of equal starts
KINDS = (
    ("assign", ASSIGN, 6, "secret", False),
    ("access", ACCESS, 16, "id", False),
    ("hex", HEX, 24, "secret", False),
    ("identifier", IDENTIFIER, 3, "id", True),
    ("weak_secret", WEAK, 16, "secret", True),
    ("endpoint", ENDPOINT, 3, "end", True),
)
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, rank: int) -> Column:
    """Spans of a kind: leftmost, not overlapping, those with a short group 2 dropped."""
    _, pattern, least, *_ = KINDS[rank]
    plain = F.translate(text, "\x01\x02", "��")  # the marks below; same length
    parts = F.split(F.regexp_replace(plain, pattern, "\x01$0\x02$2\x01"), "\x01", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, part: Column) -> Column:
        full, value = F.substring_index(part, "\x02", 1), F.substring_index(part, "\x02", -1)
        end = a["at"] + F.when(a["hit"], F.length(full)).otherwise(F.length(part))
        span = F.struct(a["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        out = F.when(a["hit"] & (F.length(value) >= least), F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), out.alias("out"))

    found = F.aggregate(parts, start, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def _role(rank: Column, value: int) -> Column:
    return F.get(F.array(*(F.lit(k[value]) for k in KINDS)), rank)


def parts(docs: DataFrame) -> DataFrame:
    """``base`` and ``weak`` spans of rows with doc_id and text, and a key for each text with weak ones.

    A weak span that overlaps a base span is the same find and left out; so is a weak
    secret inside an endpoint or identifier.
    """
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("*", *(_spans(F.col("text"), k).alias(f"s{k}") for k in range(len(KINDS))))
    over = lambda s, others: F.exists(others, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    d = d.withColumn("base", F.concat("s0", "s1", "s2"))
    named = F.concat("s3", "s5")
    weak = F.concat(named, F.filter("s4", lambda s: ~over(s, named)))
    d = d.withColumn("weak", F.filter(weak, lambda s: ~over(s, F.col("base"))))
    key = F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x02")), "text").cast("binary"))
    # rows without a weak span need no partner; keys of their own keep them apart in the join
    return d.withColumn("key", F.when(F.size("weak") > 0, key).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``key`` and ``linked``: the weak spans whose complement stands within ``scope``.

    Equal rows share a key and are linked once. A bucket holds at most ``scope`` characters
    of one document, which bounds the pairs.
    """
    rows = found.where(F.size("weak") > 0).select("key", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    rows = rows.select("key", "s.*", _role(F.col("s.rank"), 3).alias("role"), _role(F.col("s.rank"), 4).alias("weak"))
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    # a candidate asks the buckets around both its ends; a part answers in those of its ends
    asks = F.array_distinct(F.flatten(F.array(F.sequence(first - 1, first + 1), F.sequence(last - 1, last + 1))))
    left = rows.where("weak").select("key", "start", "end", "rank", "role", F.explode(asks).alias("b"))
    right = rows.select("key", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("role").alias("role2"), F.explode(F.array_distinct(F.array(first, last))).alias("b"))
    near = (F.col("start2") - F.col("end") <= scope) & (F.col("start") - F.col("end2") <= scope) & (F.col("role") != F.col("role2"))
    pairs = left.join(right, ["key", "b"]).where(near & (F.col("role2") != "end"))
    seen = pairs.groupBy("key", "start", "rank", "end", "role").agg(*(F.max((F.col("role2") == r)).alias(r) for r in ("id", "secret")))
    ok = F.when(F.col("role") == "end", F.col("id") & F.col("secret")).otherwise(F.when(F.col("role") == "id", F.col("secret")).otherwise(F.col("id")))
    return seen.where(ok).groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (with doc_id and text; null text is empty) plus ``base`` and ``all`` spans."""
    d = parts(docs)
    d = d.join(link(d), "key", "left")
    return d.withColumn("all", F.concat("base", F.coalesce("linked", F.array().cast(SPAN))))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and written spans per row; see the module."""
    d = parts(docs).select("doc_id", "key", "base", "weak")
    d = d.join(link(d), "key", "left").withColumn("all", F.concat("base", F.coalesce("linked", F.array().cast(SPAN))))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return d.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; rows without one stay as they are.

    Overlapping spans are cut out once.
    """
    cut = lambda t, a, b: F.substring(t, a + 1, b - a)
    d = scan(packed(docs))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        out = F.when(new, F.concat(a["out"], cut(text, a["at"], s["start"]), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(F.array_sort("all"), start, step, lambda a: F.concat(a["out"], cut(text, a["at"], F.length(text))))
    return unpacked(d.withColumn("text", F.when(F.size("all") > 0, clean).otherwise(text)), docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    return digest(load(spark.read.parquet(f"{sf_dir}/documents.parquet")))
