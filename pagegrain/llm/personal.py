"""Personal data: candidates of wide generators, judged by boosted trees with calibrated cuts.

Base finds (valid e-mail and IP addresses, card and phone numbers) always count. Generators
propose wider spans of the same four kinds, which may overlap: addresses with written-out
signs or without a last part, dotted numbers, long digit groups with any sign between. What
passes the kind's own check (octets, Luhn sum, length) is a weak positive label, what fails
it a negative one. The trees see form and context but not the check, so they say how much a
candidate looks like valid ones; a candidate that fails the check and yet looks like them (a
card number with a wrong digit, ``name [at] host [dot] org``) is added if its score reaches
the kind's cut. The cut is the least score whose share of valid candidates, made monotone,
is ``PRECISION`` or more in the held-out documents.

Rows are scanned, scored and answered in place by DataFrame functions: no shuffle but for
the counts of feature vectors. The trees learn from all of them: up to ``PATTERNS`` vectors are
grown in the driver; where there are more, Spark sums the gradients by node, feature
and value, and the driver sees these sums and pools of scores only. Patterns take no step back over what they have read,
so that long runs of one character class cost linear time. Positions are code points.
"""

from __future__ import annotations

from functools import partial
from itertools import groupby
from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.fold import fold
from pagegrain.llm.common import held_out, load
from pagegrain.sources.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
EMAIL = LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SIGN = r"\x20?+[\[(]\x20?+(?:%s)\x20?+[\])]\x20?+"
WIDE = (
    LOCAL + rf"(?:@|{_SIGN % 'at|@'})[A-Za-z0-9-]++(?:(?:\.|{_SIGN % 'dot|[.]'})[A-Za-z0-9-]++)*+",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}+",
    r"[0-9](?:[\x20./-]?+[0-9]){11,}+",
    r"[+(]?+[0-9][\x20().0-9/-]{5,}[0-9]",
)
PRECISION, PATTERNS, AROUND, LEAST_HELD, CHUNK = 0.95, 4096, 24, 20, 512
TREES, DEPTH, RATE = 24, 3, 0.3
#: words shortly before a candidate, by what they announce
CUES = (
    r"(?i)mail|contact|kontakt|correo|courriel",
    r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|anruf",
    r"(?i)card|visa|karte|carte|tarjeta|credit",
    r"(?i)\bip\b|host|server|address|client",
    r"(?i)version|token|order|item|isbn|number|\bid\b|\bno\.",
)
FEATURES = ("kind", "digits", "letters", "size", "groups", "longest", "signs", "before", "after", "cue")
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """Leftmost matches that do not overlap, with their surroundings; only where ``may`` holds.

    Every second part of the split text is a match. Offsets are summed for chunks of
    ``CHUNK`` parts first, so that a text with very many matches costs no square of them.
    """
    plain = F.translate(text, "\x01", "�")  # the mark below; same length
    pieces = F.split(F.regexp_replace(plain, pattern, "\x01$0\x01"), "\x01", -1)
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  the value is worked out once
    part = lambda p, c: F.slice(p, c * CHUNK + 1, F.lit(CHUNK))

    def placed(p: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.call_function("div", F.size(p) - 1, F.lit(CHUNK)).cast("int"))
        size = F.transform(chunks, lambda c: F.aggregate(part(p, c), F.lit(0), lambda a, x: a + F.length(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offset = F.aggregate(size, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return bound(offset, lambda o: F.flatten(F.transform(chunks, lambda c: found(p, c, F.get(o, c)))))

    def found(p: Column, c: Column, offset: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            end = a["at"] + F.length(x)
            left, right = F.get(p, a["i"] - 1), F.get(p, a["i"] + 1)
            one = F.struct(a["at"].alias("start"), end.alias("end"), x.alias("value"), F.substring(left, -AROUND, AROUND).alias("before"), F.substring(right, 1, 1).alias("after"))
            out = F.when(a["i"] % 2 == 1, F.concat(a["out"], F.array(one))).otherwise(a["out"])
            return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), out.alias("out"))

        start = F.struct(offset.alias("at"), (c * CHUNK).alias("i"), F.array().cast(_FOUND).alias("out"))
        return F.aggregate(part(p, c), start, step, lambda a: a["out"])

    return F.when(may, bound(pieces, placed)).otherwise(F.array().cast(_FOUND))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _valid(kind: int, x: Column) -> Column:
    """Whether a match of the kind is one of the base finds."""
    n = F.length(_digits(x))
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    return n.between(13, 19) & F.call_function("luhn_check", _digits(x)) if kind == 2 else n.between(9, 15)


def _shape(x: Column) -> Column:
    """Class of the character next to a candidate: none, space, letter, digit, a sign of assignment, another."""
    c = F.coalesce(x, F.lit(""))
    rules = ((c == "", 0), (c.rlike(r"[\x20\x09-\x0D]"), 1), (c.rlike("[0-9]"), 3), (c.rlike("[:=\"']"), 4), (c.rlike(r"[!-/;-@\[-`{-~]"), 5))
    out = F.lit(2)
    for test, code in rules:
        out = F.when(test, code).otherwise(out)
    return out


def _features(kind: int, s: Column) -> Column:
    """A candidate of a generator with its features (small integers) and ``y``, whether its kind's check passes."""
    x = F.regexp_replace(F.regexp_replace(s["value"], _SIGN % "at|@", "@"), _SIGN % r"dot|\.", ".") if kind == 0 else s["value"]
    digits = F.length(_digits(x))
    groups = F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda g: g != "")
    signs = sum(F.when(F.contains(x, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(" .-(/"))
    cue = F.lit(0)
    for k, pattern in enumerate(CUES, 1):
        cue = F.when(s["before"].rlike(pattern), k).otherwise(cue)
    base = (EMAIL.replace(r"\G|", ""), IP, CARD, PHONE)[kind]
    y = s["value"].rlike(f"^(?:{base})$") & _valid(kind, s["value"])
    values = (
        F.lit(kind), F.least(digits, F.lit(24)), F.least(F.length(F.regexp_replace(x, "[^A-Za-z]+", "")), F.lit(40)), F.least(F.length(x), F.lit(60)),
        F.least(F.size(groups), F.lit(12)), F.least(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(24)), signs,
        _shape(F.substring(s["before"], -1, 1)), _shape(s["after"]), cue,
    )
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), *(F.coalesce(v, F.lit(0)).cast("int").alias(n) for n, v in zip(FEATURES, values)), F.coalesce(y, F.lit(False)).alias("y"))


def _may(text: Column) -> tuple[Column, ...]:
    digit = text.rlike("[0-9]")
    return text.rlike("@|[at.@][\\x20]?[\\])]"), digit & F.contains(text, F.lit(".")), digit, digit


def _passes(kind: int, s: Column) -> Column:
    return _valid(kind, s["value"])


def _span(kind: int, s: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """Base finds of all kinds, kind by kind and by start."""
    every = []
    for k, (pattern, may) in enumerate(zip((EMAIL, IP, CARD, PHONE), _may(text))):
        may = F.contains(text, F.lit("+")) & may if k == 3 else may
        every.append(F.transform(F.filter(_matches(text, pattern, may), partial(_passes, k)), partial(_span, k)))
    return F.concat(*every)


def candidates(text: Column) -> Column:
    """What the generators propose, with features."""
    each = zip(WIDE, _may(text))
    return F.concat(*(F.transform(_matches(text, p, may), partial(_features, k)) for k, (p, may) in enumerate(each)))


class Model(NamedTuple):
    """Trees as nested (feature, cut, low, high) with numbers as leaves, and the least score of each kind that is added."""

    prior: float
    trees: list
    cuts: dict[int, float]


def _leaf_of(tree, x) -> float:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


def score(model: Model, x) -> float:
    return model.prior + sum(_leaf_of(t, x) for t in model.trees)


def _split(sums: dict[int, dict[int, tuple[float, float]]], g: float, h: float) -> tuple[int, int] | None:
    """Feature and cut of the greatest gain, from (gradient, weight) by feature and value; ties: the first feature, then the lowest cut."""
    best = (1e-6, None)
    for f in sorted(sums):
        gl = hl = 0.0
        for v in sorted(sums[f])[:-1]:
            gl, hl = gl + sums[f][v][0], hl + sums[f][v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, (f, v))
    return best[1]


def _grow(rows: list, depth: int):
    """A tree over (features, gradient, weight) rows."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    every: dict[int, dict[int, list[float]]] = {}
    for f in range(len(FEATURES)) if depth else ():
        sums = every.setdefault(f, {})
        for x, a, b in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
    found = _split(every, g, h)
    if found is None:
        return -RATE * g / (h + 1)
    f, cut = found
    return f, cut, _grow([r for r in rows if r[0][f] <= cut], depth - 1), _grow([r for r in rows if r[0][f] > cut], depth - 1)


#: gradients are summed as whole parts of this, so that sums do not depend on their order
PART = 1 << 20


def _grow_far(rows: DataFrame, depth: int):
    """``_grow`` over a DataFrame of the features, g and h: a pass for each level, of which the driver sees sums by node, feature and value."""
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(n).alias("v")) for f, n in enumerate(FEATURES)))).alias("x")
    whole = lambda c: F.round(F.col(c) * PART).cast("bigint").alias(c)
    done: dict[str, object] = {}  # nodes by their path: a split or a leaf
    open_ = {"": "true"}
    for left in range(depth, -1, -1):
        if not open_:
            break
        node = F.expr("case " + " ".join(f"when {test} then '{path}'" for path, test in open_.items()) + " end").alias("node")
        seen = rows.alias("s").select(node, whole("g"), whole("h"), one).where("node is not null").groupBy("node", "x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        below = {}
        for path, test in open_.items():
            sums: dict[int, dict[int, tuple[float, float]]] = {}
            for r in seen:
                if r.node == path:
                    sums.setdefault(r.f, {})[r.v] = (r.g / PART, r.h / PART)
            g, h = (sum(v[k] for v in sums[0].values()) for k in (0, 1))
            found = _split(sums, g, h) if left else None
            done[path] = -RATE * g / (h + 1) if found is None else found
            if found:
                below |= {path + k: f"{test} and s.{FEATURES[found[0]]} {sign} {found[1]}" for k, sign in (("0", "<="), ("1", ">"))}
        open_ = below

    def tree(path: str):
        at = done[path]
        return (*at, tree(path + "0"), tree(path + "1")) if isinstance(at, tuple) else at

    return tree("")


def _margin(prior: float, trees: list) -> str:
    return " + ".join([f"{prior!r}D", *(_sql(t) for t in trees)])


def boost_far(rows: DataFrame, trees: int = TREES) -> tuple[float, list]:
    """``boost`` over a DataFrame of the features, pos and neg."""
    n = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pos", "neg"))).collect()[0]
    prior, out = log((n.pos + 1) / (n.neg + 1)), []
    if not n.pos or not n.neg:
        return prior, []
    for _ in range(trees):
        d = rows.alias("s").select(*FEATURES, "pos", (F.col("pos") + F.col("neg")).alias("n"), F.expr(f"1 / (1 + exp(-({_margin(prior, out)})))").alias("p"))
        out.append(_grow_far(d.select(*FEATURES, (F.col("n") * F.col("p") - F.col("pos")).alias("g"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h")), DEPTH))
    return prior, out


def boost(rows: list, trees: int = TREES) -> tuple[float, list]:
    """Logistic loss over (features, positives, negatives)."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    prior = log((pos + 1) / (neg + 1))
    if not pos or not neg:
        return prior, []
    margin, out = [prior] * len(rows), []
    for _ in range(trees):
        p = [1 / (1 + exp(-m)) for m in margin]
        out.append(_grow([(x, (a + b) * q - a, (a + b) * q * (1 - q)) for (x, a, b), q in zip(rows, p)], DEPTH))
        margin = [m + _leaf_of(out[-1], x) for m, (x, _, _) in zip(margin, rows)]
    return prior, out


def _pools(scored) -> list[list[float]]:
    """(least score, positives, all) of (score, positives, negatives) in order, pooled until the share rises with the score."""
    pools: list[list[float]] = []
    for s, same in groupby(scored, key=lambda r: r[0]):  # equal scores are one
        a, n = map(sum, zip(*((r[1], r[1] + r[2]) for r in same)))
        pools.append([s, a, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a2, n2 = pools.pop()
            pools[-1][1], pools[-1][2] = pools[-1][1] + a2, pools[-1][2] + n2
    return pools


def calibrate(scored: list[tuple[float, int, int]], precision: float = PRECISION, least: int = LEAST_HELD) -> float | None:
    """The least score from which the share of positives, pooled until it rises with the score, is ``precision`` or more.

    None where fewer than ``least`` candidates reach it.
    """
    ok = [p for p in _pools(sorted(scored)) if p[1] >= precision * p[2]]
    return ok[0][0] if sum(p[2] for p in ok) >= least else None


def _scored_far(rows: DataFrame, model: Model) -> list[tuple[int, float, int, int]]:
    """Pools of each kind as (kind, least score, positives, negatives), pooled by stretches of scores; pooled again they are those of all rows."""
    d = rows.alias("s").select("kind", F.expr(_margin(model.prior, model.trees)).alias("score"), "pos", "neg").groupBy("kind", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    d = d.withColumn("stretch", F.floor(F.col("score") * 16))

    def step(key, found):
        for s, a, n in _pools(found):
            yield key[0], s, a, n - a

    pools = fold(d, ["kind", "stretch"], ["score"], step, "kind int, score double, pos bigint, neg bigint")
    return [tuple(r) for r in pools.collect()]


def train(docs: DataFrame, patterns: int = PATTERNS) -> Model:
    """Learn from the candidates of rows with doc_id and text; without any, nothing is added to the base.

    All feature vectors count; over ``patterns`` of them trees are grown on Spark.
    """
    seen = docs.select(held_out("doc_id", 4).alias("held"), F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c"))
    seen = seen.groupBy("held", *(F.col(f"c.{n}").alias(n) for n in FEATURES)).agg(F.count_if("c.y").alias("pos"), F.count_if(~F.col("c.y")).alias("neg"))
    seen = materialize(seen, "patterns")
    if seen.count() > patterns:
        model = Model(*boost_far(seen.where("not held")), {})
        scored = _scored_far(seen.where("held"), model)
    else:
        rows: dict[bool, list] = {False: [], True: []}
        for r in seen.orderBy(F.desc(F.col("pos") + F.col("neg")), *FEATURES).collect():
            rows[r.held].append((tuple(r[n] for n in FEATURES), r.pos, r.neg))
        model = Model(*boost(rows[False]), {})
        scored = [(x[0], score(model, x), a, b) for x, a, b in rows[True]]
    for k in range(len(KINDS)):
        cut = calibrate([r[1:] for r in scored if r[0] == k])
        if cut is not None:
            model.cuts[k] = cut
    return model


def _sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, cut, low, high = tree
    return f"if(s.{FEATURES[f]} <= {cut}, {_sql(low)}, {_sql(high)})"


def chosen(model: Model, cands: str) -> Column:
    """Of a column of candidates those that reach their kind's cut and fail its check, with their score."""
    if not model.cuts:
        return F.filter(cands, lambda s: F.lit(False))
    cut = "case s.kind " + " ".join(f"when {k} then {c!r}D" for k, c in model.cuts.items()) + " end"
    total = _margin(model.prior, model.trees)
    return F.expr(f"filter({cands}, s -> not s.y and coalesce({total} >= {cut} - 1e-9D, false))")


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, ``base`` and ``added`` spans (kind, start, end) of rows with doc_id and text.

    Added spans overlap no base span; of two added ones that overlap, the first to begin
    stays, the longer one if both begin together. Null text is empty; equal rows are
    judged alike.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("cands"))
    d = d.withColumn("more", chosen(model, "cands"))
    free = lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    span = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"), s["end"].alias("end"))
    ordered = F.array_sort(F.transform(F.filter("more", free), span))
    start = F.struct(F.lit(0).alias("to"), F.array().cast(_SPANS).alias("out"))

    def step(a: Column, s: Column) -> Column:
        ok = s["start"] >= a["to"]
        one = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        return F.struct(F.when(ok, s["end"]).otherwise(a["to"]).alias("to"), F.when(ok, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    added = F.aggregate(ordered, start, step, lambda a: a["out"])
    return d.select("doc_id", "text", "base", F.when(F.size("more") > 0, added).otherwise(F.array().cast(_SPANS)).alias("added"))


def written(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed and start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and text, every found span replaced by its kind in brackets; spans that overlap are cut out once, by the first's kind."""
    text, names = F.col("text"), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    d = find(docs, model).withColumn("every", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        two = F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, F.concat(a["out"], two)).otherwise(a["out"]).alias("out"))

    clean = F.aggregate("every", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return d.select("doc_id", F.when(F.size("every") > 0, clean).otherwise(text).alias("text"))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = load(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digest(find(docs, train(docs)))
