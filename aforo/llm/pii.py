r"""Personal data by candidate generation, gradient-boosted trees and calibrated thresholds.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. Beside them
high-recall generators propose looser spans of the same kinds (obfuscated addresses, phone numbers
without a country code, dotted numbers, long digit chains), which may overlap. Boosted trees, trained
with MLlib on a small labelled table, score each by its format and context; a span is added
if its score reaches the threshold calibrated for its kind and it overlaps no base span and no added
span of a higher score (ties: the first).

All of it is SQL on the row: positions come from the pieces between matches, the trees are CASE
expressions. No row moves, there is no Python. Patterns are written so that they need linear time
(possessive, without groups that recurse), however long a text is; a cheap necessary test stands before each.

The labelled table is made of format rules filled with seeded random digits and names. Its candidates are parted by
their text: half train the trees, a quarter calibrates the thresholds, a quarter is left for measuring.

Nulls: a null text is empty and has no spans. Repeated rows are treated alike, an empty table gives an
empty result, other columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import cache

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Trees, their depth, the precision that thresholds are calibrated for.
TREES, DEPTH, PRECISION = 12, 3, 0.95
#: Characters of context that features look at on either side.
CONTEXT = 24

#: Equivalent to the greedy base patterns, in possessive form. \G: where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][ -]?){12}[0-9])[0-9](?:(?![ -](?![0-9]))[0-9 -])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser ones. A lookbehind starts each at the beginning of its run.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,4}+\.[0-9]{1,4}+\.[0-9]{1,4}+\.[0-9]{1,4}+|[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){4,7})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?=(?:[0-9][ .-]?){11}[0-9])[0-9](?:(?![ .-](?![0-9]))[0-9 .-])*+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|(?:[ .-][0-9]{2,4}){3,5})(?![0-9])",
}
#: Necessary for a match, and quickly tested.
GATES = {
    "base": {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{11}", "phone": r"\+[0-9]"},
    "loose": {"email": r"@|[(\[{](?:at)[)\]}]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:", "card": r"[0-9][0-9 .-]{11}", "phone": r"[0-9][ .)-][0-9]|\)[0-9]|\) [0-9]"},
}


def matches(text: Column, pattern: str, gate: str) -> Column:
    """Array of (start, end, text, left, right) of a pattern's matches; positions in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def spans(m: Column, p: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string,left:string,right:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(p[i])
            e = s + F.length(m[i])
            one = F.struct(s.alias("start"), e.alias("end"), m[i].alias("text"), F.right(p[i], F.lit(CONTEXT)).alias("left"), F.left(p[i + 1], F.lit(CONTEXT)).alias("right"))
            return F.struct(e.alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step, lambda acc: acc["out"])

    # the text is split once, and only where something matched
    found = F.when(text.rlike(gate), found).otherwise(F.array().cast("array<string>"))
    some = F.filter(F.array(found), lambda m: F.size(m) > 0)
    split = F.transform(some, lambda m: F.struct(m.alias("m"), pieces.alias("p")))
    return F.flatten(F.transform(split, lambda x: spans(x["m"], x["p"])))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits in the text have a Luhn checksum of 0."""
    reversed_ = F.reverse(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)))

    def worth(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(reversed_, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The check that a base match of this kind must pass."""
    n = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|(?<=0))(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(text)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


_TOLD = r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|mail|e-mail|write to|reach|card|visa|account|iban|pay|ip|host|server|login|address)[a-z]*[ :.#]*$"
_OTHER = r"(?i)(?:order|invoice|ref|isbn|issn|version|build|page|total|ticket|part|item|serial|section|chapter|pi|sum|date|score|token|key|hash|figure)[a-z]*[ :.#]*$"


def features(kind: Column, c: Column) -> list[Column]:
    """Numbers that describe a candidate's format and context."""
    text, left, right = c["text"], c["left"], c["right"]
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    digits = _digits(text)
    return [
        kind.cast("double"),
        F.length(text).cast("double"),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(text, "[^A-Za-z]", "")).cast("double"),
        F.length(F.regexp_replace(text, "[^ ().-]", "")).cast("double"),
        flag(text.contains("@")),
        flag(text.rlike(r"^\(|\+")),
        flag(left.rlike(r"[A-Za-z0-9_]$")),
        flag(right.rlike(r"^[A-Za-z0-9_]")),
        flag(left.rlike(_TOLD)),
        flag(left.rlike(_OTHER)),
        flag(left.rlike("[\"'=#$€£:/]\\s*$")),
        flag(text.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")),
        F.size(F.array_distinct(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)))).cast("double"),
        flag(luhn(digits)),
        flag(text.rlike(r"(?i)at[)\]}]")),
        flag(text.rlike(r"\.(?:com|net|org|edu|gov|io|info|de|fr|es|uk)$")),
        flag(text.rlike(":")),
        flag(text.rlike(r"^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$")),
        flag(text.rlike(r"(?:^|\.)(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[0-9]{4})")),
    ]


#: What fills the formats below: d a digit, 1 a digit from 1, h a hexadecimal digit, n and w a name and a word, o a number up to 255, x one over.
_NAMES = "ana lopez john doe mary smith peter li chen maria garcia paul martin eva novak omar khan info sales office support team".split()
_WORDS = "example mail shop north river studio museum school cloud data city garden union planet market".split()
_FORMATS = {
    (0, 1): "{n}.{n} (at) {w} (dot) com|{n}dd [at] {w}.org|{n} {at} {w}.{w}.net|{n} @ {w}.com|{n}_{n} [at] {w} [dot] {w} [dot] de|{n}.{n}@{w} .com|{n}(at){w}.es|{n}{n}@{w} (dot) fr|{n}-{n} [at] {w}.co [dot] uk",
    (0, 0): "{w} (at) {w}.then|{w} @ d.dd|run @ d.d|{w} [at] {w}.and|x @ y.z|{w} @ dd.d|page @ {w}.The|{w} (at) the.end|{w} @ ddd.dd",
    (1, 1): "10.0.0.o|fe80:0:0:1:h:h:h:h|2001:db8:0:1::h:h|192.168.1.o|172.16.o.1|hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh|o.o.o.o|2a02:hhhh::hhhh:hhhh:hhh:h",
    (1, 0): "x.x.x.x|19dd.1d.1d.xdd|3.14.15.xd|1d:2d:3d:1d:1d:05|1.2.3.1ddd|x.0.0.1|20dd.0d.1d.dddd|0d:1d:2d:3d:4d:5d:0d",
    (2, 1): "C.4.4.4|C-4-4-4|C 4 4 4|C446|C.6.5",
    (2, 0): "1dddddddddddddd1|dddddddddddd|978030640ddd1|20240131ddddddd|98079157dddd1dd1|0000 1111 2222 3333|20dd.1d.1d.1dddd.ddd|ddd ddd ddd ddd ddd",
    (3, 1): "(01d) 555-dddd|1dd-555-01dd|212.555.01dd|020 79dd 0dddd|(030) 901-dddd|650 555 01dd|01 dd dd dd dd|06.dd.dd.dd.dd|91 1dd dd dd|0049 30 90d ddd|030 1ddd dddd|(089) dddd dddd",
    (3, 0): "19dd-19dd-20dd|20dd-01dd-1d|12-3dddd-dddd|100.200 300|24 1000-2000|19dd 19dd-19dd|1d 2d 3d 4d 5d|20dd-1d-1d 1d|1.000.000 000|1d 0d 20dd 1d 3d",
}
_LEFTS = {
    (0, 1): "Mail me: |write to |Contact |reach us at |and the ||e-mail ",
    (0, 0): "we |see |cost |a total of |then |and the |",
    (1, 1): "host |server |from the |login from |IP: |address |and the |",
    (1, 0): "version |section |build |the |score |time |and the |",
    (2, 1): "card |visa |pay with |account |card number: |and the |",
    (2, 0): "order |isbn |serial |the |token = \"|invoice #|ref |and the |",
    (3, 1): "call |Tel. |phone: |mobile |fax |contact |and the |",
    (3, 0): "order |page |part |the |invoice #|date |score |and the |",
}
_RIGHTS = (" ", ". The rest", ", or", "\n", "")


def luhn_valid(digits: str) -> str:
    """The digits with their last one changed so that the checksum is 0."""
    total = sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(digits[:-1] + "0"))))
    return digits[:-1] + str(-total % 10)


def labelled_candidates(spark: SparkSession, each: int = 12, seed: int = 0) -> DataFrame:
    """(kind, text, left, right, label): the training table, some thousand rows; ``each`` texts of each format, each in all its contexts."""
    rnd, rows = random.Random(seed), []
    fill = {"d": lambda: rnd.choice("0123456789"), "1": lambda: rnd.choice("123456789"), "h": lambda: rnd.choice("0123456789abcdef"), "o": lambda: str(rnd.randrange(1, 256)), "x": lambda: str(rnd.randrange(256, 1000))}

    def made(kind: int, form: str) -> str:
        if form[0] == "C":  # a card of 15 or 16 digits in groups
            sizes = [4, *map(int, re.findall("[0-9]", form))]
            digits = luhn_valid(rnd.choice("3456") + "".join(fill["d"]() for _ in range(sum(sizes) - 1)))
            marks, at, out = re.findall("[^C0-9]", form), 0, []
            for size in sizes:
                out.append(digits[at : at + size])
                at += size
            return (marks[0] if marks else "").join(out)
        if kind == 0:
            form = re.sub(r"\{([nw])\}", lambda m: rnd.choice(_NAMES if m[1] == "n" else _WORDS), form)
            return re.sub(r"(?<![a-z])d+(?:\.d+)?(?![a-z])|(?<=[a-z])dd(?= )", lambda m: m[0].replace("d", str(rnd.randrange(1, 10))), form)
        free = "dhox" if kind == 1 else "d"
        return "".join(fill[c]() if c in free or c == "1" and kind > 1 and rnd.random() < 0.5 else c for c in form)

    for (kind, label), forms in _FORMATS.items():
        for form in forms.split("|"):
            for text in dict.fromkeys(made(kind, form) for _ in range(each)):
                for j, left in enumerate(_LEFTS[kind, label].split("|")):
                    rows.append((kind, text, left, _RIGHTS[(len(rows) + j) % len(_RIGHTS)], float(label)))
    return spark.createDataFrame(rows, "kind int, text string, left string, right string, label double")


def _tree_sql(debug: str) -> str:
    """A CASE expression over f0, f1, ... from the printed form of a regression tree."""
    lines = [x.strip() for x in debug.splitlines()[1:] if x.strip()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return f"({float(line.split(':')[1])}D)"
        number, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # the line that begins with Else
        return f"IF(f[{number}] <= {float(bound)}D, {low}, {node()})"

    return node()


def parts(labelled: DataFrame) -> DataFrame:
    """With features f and x, and the part a candidate's text falls into: 0 calibrates, 1 is left for measuring, others train."""
    rows = labelled.withColumn("f", F.array(*features(F.col("kind"), F.struct("text", "left", "right")))).withColumn("x", array_to_vector("f"))
    return rows.withColumn("part", F.pmod(F.xxhash64("kind", "text"), F.lit(4)))


def fit(rows: DataFrame) -> GBTClassificationModel:
    return GBTClassifier(featuresCol="x", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(rows.filter("part > 1"))


def score_sql(model: GBTClassificationModel) -> str:
    """The model's probability of features ``f`` as SQL."""
    margin = " + ".join(f"{float(w)}D * {_tree_sql(t.toDebugString)}" for t, w in zip(model.trees, model.treeWeights))
    return f"1D / (1D + exp(-2D * ({margin})))"


def train(labelled: DataFrame) -> tuple[str, list[float]]:
    """SQL of the score of features ``f`` (0 to 1), and a threshold for each kind.

    Thresholds are the least that keep the wanted precision on the calibrating part, and 1.1 (nothing is added) where
    none does.
    """
    rows = parts(labelled).coalesce(1).persist()
    sql = score_sql(fit(rows))
    held = rows.filter("part = 0").select("kind", "label", F.expr(sql).alias("score")).collect()  # of the small labelled table
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted(((r.score, r.label) for r in held if r.kind == kind), reverse=True)
        best, hits = 1.1, 0
        for i, (s, y) in enumerate(own, 1):
            hits += y
            if hits >= PRECISION * i and (i == len(own) or own[i][0] < s):
                best = s
        thresholds.append(max(best, 0.5))
    rows.unpersist()
    return sql, thresholds


@cache
def _default_model(application: str) -> tuple[str, list[float]]:
    return train(labelled_candidates(SparkSession.getActiveSession()))


_SPAN = "struct<k:int,start:int,end:int,score:double>"
#: Of spans that overlap in a chain those to add: by falling score each that overlaps none taken before.
_PICK = f"""
IF(size($) < 2, $, aggregate(array_sort($, (x, y) -> CASE WHEN x.score > y.score THEN -1 WHEN x.score < y.score THEN 1 ELSE x.start - y.start END),
  cast(array() as array<{_SPAN}>), (p, y) -> IF(exists(p, z -> z.start < y.end AND y.start < z.end), p, array_append(p, y))))
"""
#: One sweep over base spans and candidates in order of their starts. ``cur`` are candidates that overlap in a chain
#: up to ``end`` and no base span so far; base spans cover the text up to ``until``.
_SWEEP = f"""
aggregate(
  array_sort(concat(transform(base, b -> named_struct('start', b.start, 'cand', false, 'end', b.end, 'k', b.k, 'score', 0D)),
                    transform(good, c -> named_struct('start', c.start, 'cand', true, 'end', c.end, 'k', c.k, 'score', c.score)))),
  named_struct('until', 0, 'end', 0, 'cur', cast(array() as array<{_SPAN}>), 'out', cast(array() as array<{_SPAN}>)),
  (a, x) -> CASE
    WHEN x.cand AND x.start < a.until THEN a
    WHEN x.cand AND x.start < a.end THEN named_struct('until', a.until, 'end', greatest(a.end, x.end), 'cur', array_append(a.cur, named_struct('k', x.k, 'start', x.start, 'end', x.end, 'score', x.score)), 'out', a.out)
    WHEN x.cand THEN named_struct('until', a.until, 'end', x.end, 'cur', array(named_struct('k', x.k, 'start', x.start, 'end', x.end, 'score', x.score)), 'out', concat(a.out, {_PICK.replace("$", "a.cur")}))
    ELSE named_struct('until', greatest(a.until, x.end), 'end', a.end, 'cur', filter(a.cur, c -> c.end <= x.start), 'out', a.out)
  END,
  a -> concat(a.out, {_PICK.replace("$", "a.cur")}))
"""


def find_pii(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added spans as arrays of (k, start, end[, score])."""
    sql, thresholds = _default_model(docs.sparkSession.sparkContext.applicationId) if labelled is None else train(labelled)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = {f"{x}_{k}": matches(F.col("text"), patterns[k], GATES[gates][k]) for x, gates, patterns in (("b", "base", BASE), ("l", "loose", LOOSE)) for k in KINDS}
    rows = rows.select("doc_id", *(c.alias(name) for name, c in found.items()))

    def checked(k: str, i: int) -> Column:
        return F.transform(F.filter(f"b_{k}", lambda c: valid(k, c["text"])), lambda c: F.struct(F.lit(i).alias("k"), c["start"].alias("start"), c["end"].alias("end")))

    rows = rows.withColumn("base", F.concat(*(checked(k, i) for i, k in enumerate(KINDS))))

    def described(k: str, i: int) -> Column:
        return F.transform(f"l_{k}", lambda c: F.struct(F.lit(i).alias("k"), c["start"].alias("start"), c["end"].alias("end"), F.array(*features(F.lit(i), c)).alias("f")))

    rows = rows.select("doc_id", "base", F.concat(*(described(k, i) for i, k in enumerate(KINDS))).alias("candidates"))
    scored = F.expr("transform(candidates, c -> named_struct('k', c.k, 'start', c.start, 'end', c.end, 'score', " + sql.replace("f[", "c.f[") + "))")
    bounds = F.array(*(F.lit(float(t)) for t in thresholds))
    rows = rows.select("doc_id", "base", F.filter(scored, lambda c: c["score"] >= bounds[c["k"]]).alias("good"))
    return rows.select("doc_id", "base", F.expr(_SWEEP).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans by kind and start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    bare = F.array_sort(F.transform(spans, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(bare, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bare = F.transform("added", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", bare)).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
