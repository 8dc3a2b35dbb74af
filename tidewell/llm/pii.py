"""Personal data: base patterns, high-recall candidates, boosted trees that pick among them.

Everything on the rows is a DataFrame expression.  Positions come from the
lengths of what lies between matches: splitting a text at a pattern and
extracting all its matches give the same borders, counted in code points.

Base spans (validated e-mail addresses, IP addresses, card and phone numbers)
always stay.  Generators propose further, overlapping candidates; features of
their format and context go through gradient boosted trees written out as
CASE expressions.  The trees are fitted on the driver over counts of feature
patterns from a bounded sample of documents.  A candidate counts as positive
there when it overlaps a validated base span or is a key in a known form.
Scores are calibrated on the other half of the sample by isotonic regression,
and candidates whose calibrated probability reaches the threshold are added
where no base span lies.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that the trees are fitted on (expected number; drawn by a hash of the id).
FIT_DOCUMENTS = 20_000
#: Code points of a run in which a text is looked into.
CHUNK = 1024
ROUNDS, SHRINK, LEAST_WEIGHT, THRESHOLD = 24, 0.4, 5.0, 0.5

# Possessive quantifiers and look-behinds keep the matches of the plain patterns but no
# search starts inside a run that was tried from its start.  \G lets an address begin
# right where the one before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}+[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+])\+?\(?[0-9]{2,4}\)?(?:[ .-]\(?[0-9]{2,5}\)?){1,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,63}+[0-9])[A-Za-z0-9_-]{16,64}(?![A-Za-z0-9_-])",
}
KINDS = [*BASE, "secret"]
_ASSIGNED = r"(?i)(?:password|passwd|pwd|token|secret|key)[ ]?[=:][ ]?[\"']?$"
_CONTACT = r"(?i)(?:phone|tel|fax|call|mail|contact|card|address|host|server)[a-z]{0,4}[ :.]{0,3}$"


def _fold(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """struct<at int, out array<kind>>: ``step(acc, item)`` over the items from (0, []).

    A step appends to ``out``, which copies it; so items are taken in blocks of
    the square root of their number, each with an ``out`` of its own.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step)

    def walk(whole: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(whole))).cast("int"), F.lit(1))
        last = F.floor((F.greatest(F.size(whole), F.lit(1)) - 1) / width).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * width + 1, width))
        outs = F.array().cast(f"array<array<{kind}>>")
        joined = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), outs.alias("outs")), lambda acc, block: _let(one(block, acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs"))))
        return _let(joined, lambda r: F.struct(r["at"].alias("at"), F.flatten(r["outs"]).alias("out")))

    return _let(items, walk)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _chunks(text: Column) -> Column:
    """The text in runs of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in chunks, without a walk from its beginning."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start % CHUNK + 1, end - start)


def _matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<m, s, e>>: matches of the pattern with their code point spans."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>"))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    step = _fold(
        F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m"))),
        "struct<m:string,s:int,e:int>",
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), (acc["at"] + x["b"]).alias("s"), (acc["at"] + x["b"] + F.length(x["m"])).alias("e")))).alias("out"),
        ),
    )["out"]
    return F.when(F.size(found) > 0, step).otherwise(F.array().cast("array<struct<m:string,s:int,e:int>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True when the digit string passes the Luhn check."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")  # noqa: E731  leading zeros don't count
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> of all base spans by start, then kind."""

    def of(kind: str) -> Column:
        ok = F.filter(_matches(text, BASE[kind], NEEDS.get(kind)), lambda x: _valid(kind, x["m"]))
        return F.transform(ok, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*map(of, BASE)))


def _features(before: Column, x: Column, kind: int) -> dict[str, Column]:
    m = x["m"]
    digits, last = F.length(_digits(m)), F.right(before, F.lit(1))
    lower, upper = m.rlike("[a-z]"), m.rlike("[A-Z]")
    return {
        "kind": F.lit(kind),
        "digits": F.least(F.floor(digits / 3), F.lit(7)).cast("int"),
        "length": F.least(F.floor(F.length(m) / 6), F.lit(7)).cast("int"),
        "letters": F.when(lower & upper, 3).when(upper, 2).when(lower, 1).otherwise(0),
        "mark": F.when(m.contains("@"), 5).when(m.contains("("), 4).when(m.contains("."), 3).when(m.contains("-"), 2).when(m.contains(" "), 1).otherwise(0),
        "plus": m.startswith("+").cast("int"),
        "check": F.when((digits >= 12) & (digits <= 19), _luhn(_digits(m)).cast("int")).otherwise(0),
        "context": F.when(before.rlike(_ASSIGNED), 1).when(before.rlike(_CONTACT), 2).otherwise(0),
        "left": F.when((F.length(last) == 0) | last.rlike(r"\s"), 0).when(last.rlike("[0-9A-Za-z]"), 2).otherwise(1),
    }


FEATURES = ["kind", "digits", "length", "letters", "mark", "plus", "check", "context", "left"]


def candidates(text: Column, base: Column) -> Column:
    """array<struct<s, k, e, label, features...>> of everything that the generators propose."""
    # base spans come by start; beside each, the largest end up to it
    reach = _fold(base, "struct<s:int,e:int>", lambda acc, x: F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), F.greatest(acc["at"], x["e"]).alias("e")))).alias("out")))["out"]
    return _let(F.struct(reach.alias("reach"), _chunks(text).alias("chunks")), lambda v: _candidates(text, v["reach"], v["chunks"]))


def _overlaps(reach: Column, s: Column, e: Column) -> Column:
    """True when a span of ``reach`` (by start, with the largest end so far) meets [s, e): the last that starts before e ends after s."""
    steps = F.ceil(F.log2(F.size(reach) + 1)).cast("int")

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")  # 1-based; lo spans start before e
        before = F.get(reach, mid - 1)["s"] < e
        return F.struct(F.when((acc["lo"] < acc["hi"]) & before, mid).otherwise(acc["lo"]).alias("lo"), F.when((acc["lo"] < acc["hi"]) & ~before, mid - 1).otherwise(acc["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(0).alias("lo"), F.size(reach).alias("hi")), halve)["lo"]
    return F.when(F.size(reach) == 0, False).otherwise(F.coalesce(F.get(reach, found - 1)["e"] > s, F.lit(False)))


def _candidates(text: Column, reach: Column, chunks: Column) -> Column:
    def of(kind: str) -> Column:
        k = KINDS.index(kind)

        def one(x: Column) -> Column:
            return _let(_cut(chunks, F.greatest(x["s"] - 24, F.lit(0)), x["s"]), lambda before: told(x, before))

        def told(x: Column, before: Column) -> Column:
            over = _overlaps(reach, x["s"], x["e"])
            f = _features(before, x, k)
            known = (f["context"] == 1) & (f["digits"] > 0) | x["m"].rlike("^AKIA[0-9A-Z]{16}$") if kind == "secret" else F.lit(False)
            return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), over.alias("over"), (over | known).alias("label"), *(c.alias(n) for n, c in f.items()))

        return F.transform(_matches(text, GENERATORS[kind]), one)

    return F.concat(*map(of, GENERATORS))


@dataclass
class Trees:
    """Boosted trees of depth two over feature = value tests, with a cut on the raw score."""

    bias: float
    trees: list[tuple]
    cut: float

    def raw(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for test, yes, no in self.trees:
            total = total + self._node(c, (test, yes, no))
        return total

    def _node(self, c: Column, node: tuple | float) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        (name, value), yes, no = node
        return F.when(c[name] == value, self._node(c, yes)).otherwise(self._node(c, no))

    def raw_of(self, row: dict[str, int]) -> float:
        total = self.bias
        for tree in self.trees:
            node: tuple | float = tree
            while not isinstance(node, float):
                node = node[1] if row[node[0][0]] == node[0][1] else node[2]
            total += node
        return total


def fit(patterns: list[tuple[dict[str, int], float, float]]) -> list[tuple] | None:
    """Trees by Newton boosting over (features, positives, negatives); None without both labels."""
    total = [sum(p for _, p, _ in patterns), sum(n for _, _, n in patterns)]
    if min(total) <= 0:
        return None
    bias = math.log(total[0] / total[1])
    raw = [bias] * len(patterns)
    tests = sorted({(name, row[name]) for row, _, _ in patterns for name in FEATURES})
    trees: list[tuple] = [("bias", bias)]

    def best(rows: list[int], g: list[float], h: list[float], depth: int) -> tuple | float:
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        top, split = 1e-6, None
        if depth:
            for test in tests:
                yes = [i for i in rows if patterns[i][0][test[0]] == test[1]]
                yg, yh = sum(g[i] for i in yes), sum(h[i] for i in yes)
                if yh < LEAST_WEIGHT * 0.01 or sh - yh < LEAST_WEIGHT * 0.01:
                    continue
                gain = yg * yg / (yh + 1) + (sg - yg) ** 2 / (sh - yh + 1) - sg * sg / (sh + 1)
                if gain > top:
                    top, split = gain, (test, set(yes))
        if split is None:
            return SHRINK * sg / (sh + 1)
        test, yes = split
        return (test, best([i for i in rows if i in yes], g, h, depth - 1), best([i for i in rows if i not in yes], g, h, depth - 1))

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g = [pos - (pos + neg) * q for (_, pos, neg), q in zip(patterns, p, strict=True)]
        h = [(pos + neg) * q * (1 - q) for (_, pos, neg), q in zip(patterns, p, strict=True)]
        tree = best(list(range(len(patterns))), g, h, 2)
        if isinstance(tree, float):
            break
        trees.append(tree)
        one = Trees(0.0, [tree], 0.0)
        raw = [r + one.raw_of(row) for r, (row, _, _) in zip(raw, patterns, strict=True)]
    return trees


def calibrated_cut(scored: list[tuple[float, float, float]], threshold: float) -> float:
    """The least raw score whose isotonic probability, over (score, positives, negatives), reaches the threshold."""
    blocks: list[list[float]] = []
    for score, pos, neg in sorted(scored):
        blocks.append([score, pos, pos + neg])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, p, n = blocks.pop()
            blocks[-1][1] += p
            blocks[-1][2] += n
    return next((s for s, p, n in blocks if n and p / n >= threshold), math.inf)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_DOCUMENTS) -> Trees:
    """Fits and calibrates on about ``limit`` documents, drawn by a hash of their ids."""
    n = docs.count()
    share = min(1.0, limit / n) if n else 1.0
    drawn = _picked(docs, id_col, text_col).where(F.pmod(F.xxhash64(F.lit("pii"), F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = drawn.withColumn("base", base_spans(F.col("_text"))).select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)).alias("half"), F.explode(candidates(F.col("_text"), F.col("base"))).alias("c"))
    # one row per feature pattern, of which there are a bounded number
    counts = rows.groupBy("half", *(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(F.sum(F.col("c.label").cast("long")).alias("pos"), F.count("*").alias("n")).collect()
    pattern = lambda r: ({f: r[f] for f in FEATURES}, float(r["pos"]), float(r["n"] - r["pos"]))
    order = lambda rs: sorted((pattern(r) for r in rs), key=lambda p: sorted(p[0].items()))
    trees = fit(order(r for r in counts if r["half"] == 0))
    if trees is None:
        return Trees(0.0, [], math.inf)
    model = Trees(trees[0][1], trees[1:], math.inf)
    model.cut = calibrated_cut([(model.raw_of(row), pos, neg) for row, pos, neg in order(r for r in counts if r["half"] == 1)], THRESHOLD)
    return model


def find_spans(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``base`` and ``spans``, arrays of (s, k, e) in code points; k indexes KINDS.

    ``spans`` holds the base spans and the added ones, by start and kind.
    Added spans overlap neither base spans nor each other: of those that
    overlap, the one that starts first stays, then the longest.  Without a
    model, one is trained on ``docs``.  A null text counts as empty; each row,
    repeated or not, is judged alone; other columns don't matter.
    """
    model = model or train(docs, id_col, text_col)
    keep = [F.col(f"`{c}`").alias(f"_carry_{i}") for i, c in enumerate(carry or [])]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *keep).withColumn("base", base_spans(F.col("_text")))
    if model.trees and model.cut < math.inf:
        good = F.filter(candidates(F.col("_text"), F.col("base")), lambda c: ~c["over"] & (model.raw(c) >= model.cut))
        ordered = F.array_sort(F.transform(good, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("o"), c["k"].alias("k"))))
        chosen = _fold(
            ordered,
            "struct<s:int,k:int,e:int>",
            lambda acc, c: F.struct(
                F.when(c["s"] >= acc["at"], -c["o"]).otherwise(acc["at"]).alias("at"),
                F.when(c["s"] >= acc["at"], F.concat(acc["out"], F.array(F.struct(c["s"].alias("s"), c["k"].alias("k"), (-c["o"]).alias("e"))))).otherwise(acc["out"]).alias("out"),
            ),
        )["out"]
        rows = rows.withColumn("added", chosen)
    else:
        rows = rows.withColumn("added", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    return rows.withColumn("spans", F.array_sort(F.concat("base", "added")))


def joined(spans: Column | str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; all columns stay, a null text stays null."""
    columns = docs.columns
    found = find_spans(docs, model, id_col, text_col, carry=columns)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    walked = lambda chunks: _fold(
        F.col("spans"),
        "string",
        lambda acc, x: F.when(x["e"] <= acc["at"], acc).otherwise(
            F.struct(
                x["e"].alias("at"),
                F.concat(acc["out"], F.array(_cut(chunks, acc["at"], F.greatest(x["s"], acc["at"])), F.when(x["s"] >= acc["at"], F.element_at(names, x["k"] + 1)).otherwise(""))).alias("out"),
            )
        ),
    )
    walk = _let(_let(_chunks(F.col("_text")), walked), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(F.col("_text"), r["at"] + 1, F.length("_text"))))
    fresh = F.when(F.size("spans") > 0, walk).otherwise(F.col("_text"))
    return found.select(*(F.when(F.col(f"_carry_{i}").isNotNull(), fresh).alias(c) if c == text_col else F.col(f"_carry_{i}").alias(c) for i, c in enumerate(columns)))
