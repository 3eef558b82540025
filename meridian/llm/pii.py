r"""Personal data by candidate spans and gradient boosting, in DataFrame and SQL functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks. Generators with high recall
propose more spans, which may overlap: ``contact`` (anything around an @), ``number`` (digits with
separators) and ``secret`` (long runs that mix letters and digits). Each candidate has features of
its format (digits, length, share of letters, hex, separators, dots, plus) and of the text before it
(assignment, quote, a word for personal data).

Boosted trees select among the candidates. They are trained at each run on silver labels that no
feature repeats: a contact or number is positive if it covers a span that passes its kind's check (a
checksum, ranges of parts, numbers of digits), which the features of its format don't show; a secret
is positive if the text before it assigns it to a token, key or password, while its features are those
of its own characters. Secrets without an assignment count as negatives there, so the probability of
being assigned is divided by its mean over known positives (Elkan and Noto's correction): what looks
like assigned strings is a secret, however many of them stand alone. Features are small integers, so the training set is a table of counts by feature
vector, made by one aggregation over all documents and bounded by the product of the features' ranges;
the trees are grown on that table and become one SQL expression. The margin is calibrated (Platt) for
each kind, on the half of the documents that the trees haven't seen. A candidate is a span if its
calibrated probability reaches its kind's threshold, no base span lies within it or holds it, and no
likelier candidate overlaps it. A kind without labels of both sorts adds nothing.

Patterns are written so that Java's matcher needs neither recursion nor quadratic time: runs are
possessive, and a run that can't match is tried at its first character only.

Defined results: null text counts as empty and has no spans; rows with a null id are processed like
any other; repeated rows get equal results; an empty table gives an empty result; columns other than
id and text aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: kinds in the order of the output, their patterns and checks
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CANDIDATES = {
    "contact": r"(?<![^\s@\"'<>])[^\s@\"'<>]++@[^\s@\"'<>]++",
    "number": r"[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9])++",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
}
KINDS = [*BASE, *CANDIDATES]
NEEDS = {"email": "@", "contact": "@", "phone": "+"}
ASSIGNED = r"(?i)(token|secret|key|password|passwd|pwd|auth)[\"']?\s*[=:]\s*[\"']?$"
NAMED = r"(?i)(mail|phone|tel|call|card|iban|ssn|ip)\W*$"
THRESHOLDS = {"contact": 0.8, "number": 0.8, "secret": 0.8}


def _quoted(pattern: str) -> str:
    """A pattern within an SQL literal."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: Features as SQL over a candidate ``c`` (kind_no, s, before), with their numbers of values.
FEATURES = {
    "kind": ("c.kind_no - 4", 3),
    "digits": ("least(7, int(length(regexp_replace(c.s, '[^0-9]', '')) / 3))", 8),
    "length": ("least(7, int(length(c.s) / 6))", 8),
    "letters": ("int(3.999 * length(regexp_replace(c.s, '[^A-Za-z]', '')) / greatest(1, length(c.s)))", 4),
    "hex": ("int(c.s rlike '^[0-9a-fA-F]+$')", 2),
    "separators": ("least(3, length(regexp_replace(c.s, '[^ ()/-]', '')))", 4),
    "dots": ("least(3, length(regexp_replace(c.s, '[^.]', '')))", 4),
    "plus": ("int(startswith(c.s, '+'))", 2),
    "quoted": ("int(c.kind_no < 6 and c.before rlike '[\"\\']$')", 2),
    "named": (f"int(c.before rlike '{_quoted(NAMED)}')", 2),
}
LEAST_KNOWN = 0.25  # assigned secrets that look like much else don't make all of that secrets
BLOCK = 256  # matches that are added up at a time
SPAN = "array<struct<start:int,end:int,kind_no:int,s:string,before:string>>"


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern, from left to right, with offsets in code points and up to 24 characters before each."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        p, f = x["p"], x["f"]
        begin = a["at"] + F.length(p)
        one = F.struct(begin.alias("start"), (begin + F.length(f)).alias("end"), F.lit(KINDS.index(kind)).alias("kind_no"), f.alias("s"), F.right(p, F.lit(24)).alias("before"))
        return F.when(f.isNull(), a).otherwise(F.struct((begin + F.length(f)).alias("at"), F.concat(a["out"], F.array(one)).alias("out")))

    def block(a: Column, rows: Column) -> Column:
        part = F.aggregate(rows, F.struct(a["at"].alias("at"), F.array().cast(SPAN).alias("out")), add)
        return F.struct(part["at"].alias("at"), F.concat(a["out"], part["out"]).alias("out"))

    # in blocks, as adding one by one to a long array would copy it each time; array(...) names what is found once
    blocks = lambda all: F.transform(F.sequence(F.lit(0), F.floor(F.size(all) / BLOCK).cast("int")), lambda b: F.slice(all, b * BLOCK + 1, BLOCK))
    summed = F.transform(F.array(found), lambda all: F.aggregate(blocks(all), start, block, lambda a: a["out"]))
    has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(has, summed[0]).otherwise(F.array().cast(SPAN))


def _digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def _luhn(s: Column) -> Column:
    digits = F.filter(F.split(F.reverse(s), ""), lambda c: c.between("0", "9"))
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda s: _digits(s).between(12, 19) & _luhn(s),
    "phone": lambda s: _digits(s).between(9, 15),
}


def overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def nested(x: Column, y: Column) -> Column:
    return ((x["start"] <= y["start"]) & (y["end"] <= x["end"])) | ((y["start"] <= x["start"]) & (x["end"] <= y["end"]))


def _proposed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("row"))
    valid = lambda kind: lambda x: CHECKS[kind](x["s"])
    base = [F.filter(matches(F.col("text"), k, p), valid(k)) for k, p in BASE.items()]
    more = [matches(F.col("text"), k, p) for k, p in CANDIDATES.items()]
    return rows.withColumn("base", F.array_sort(F.concat(*base), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["kind_no"] - y["kind_no"]))).withColumn("candidates", F.concat(*more))


def grow(cells: list[tuple], trees: int, rate: float) -> list:
    """Boosted trees of two levels on (features, negatives, positives) counts; a tree: (f, cut, ((f, cut, low, high), (...)))."""
    margin = [0.0] * len(cells)
    model = []

    def best(rows: list[int], g: list[float], h: list[float]):
        total = (sum(g[i] for i in rows), sum(h[i] for i in rows))
        top = (0.0, 0, -1)
        for f, (_, size) in enumerate(FEATURES.values()):
            by = {}
            for i in rows:
                a = by.setdefault(cells[i][0][f], [0.0, 0.0])
                a[0] += g[i]
                a[1] += h[i]
            low = [0.0, 0.0]
            for cut in range(size - 1):
                low = [low[0] + by.get(cut, (0, 0))[0], low[1] + by.get(cut, (0, 0))[1]]
                high = (total[0] - low[0], total[1] - low[1])
                gain = low[0] ** 2 / (low[1] + 1) + high[0] ** 2 / (high[1] + 1) - total[0] ** 2 / (total[1] + 1)
                if gain > top[0] + 1e-9:
                    top = (gain, f, cut)
        return top[1], top[2]

    for _ in range(trees):
        p = [probability(m) for m in margin]
        g = [c[2] * (1 - q) - c[1] * q for c, q in zip(cells, p, strict=True)]
        h = [(c[1] + c[2]) * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        f, cut = best(range(len(cells)), g, h)
        sides = []
        for rows in ([i for i in range(len(cells)) if cells[i][0][f] <= cut], [i for i in range(len(cells)) if cells[i][0][f] > cut]):
            f2, cut2 = best(rows, g, h)
            leaves = []
            for part in ([i for i in rows if cells[i][0][f2] <= cut2], [i for i in rows if cells[i][0][f2] > cut2]):
                value = rate * sum(g[i] for i in part) / (sum(h[i] for i in part) + 1)
                leaves.append(value)
                for i in part:
                    margin[i] += value
            sides.append((f2, cut2, *leaves))
        model.append((f, cut, sides))
    return model


def margin_of(model: list, x: tuple) -> float:
    total = 0.0
    for f, cut, sides in model:
        f2, cut2, low, high = sides[x[f] > cut]
        total += high if x[f2] > cut2 else low
    return total


def margin_sql(model: list) -> str:
    """The same as an SQL expression over the array ``x`` of features."""
    leaf = lambda s: f"if(x[{s[0]}] > {s[1]}, {s[3]!r}d, {s[2]!r}d)"
    return " + ".join(f"if(x[{f}] > {cut}, {leaf(sides[1])}, {leaf(sides[0])})" for f, cut, sides in model)


def probability(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def platt(points: list[tuple[float, float, float]], rounds: int = 200) -> tuple[float, float]:
    """a, b of P(positive) = 1 / (1 + exp(-(a * margin + b))) on (margin, negatives, positives), by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        ga = gb = 0.0
        haa = hbb = hab = 1e-3
        for m, neg, pos in points:
            p = probability(a * m + b)
            g, h = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + g * m, gb + g, haa + h * m * m, hab + h * m, hbb + h
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        scale = min(1.0, 2 / max(abs(da), abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
    return a, b


def _vector(c: str = "c") -> str:
    return "array(" + ", ".join(f"int({sql})" for sql, _ in FEATURES.values()) + ")"


#: The label of a candidate ``c``: by checks of what it covers or, for secrets, by what stands before it.
SILVER = f"if(c.kind_no = {KINDS.index('secret')}, c.before rlike '{_quoted(ASSIGNED)}', exists(r.base, b -> b.start >= c.start and b.end <= c.end))"


def learn(proposed: DataFrame, trees: int, rate: float) -> tuple[list, dict[str, tuple[float, float, float]]]:
    """Trees, and of each kind that has labels of both sorts in either half: its calibration, and the share of positives that the labels know."""
    # label and features before the explosion, so that its rows carry neither texts nor spans; ``r`` names base
    # and candidates once, as the optimiser would put the whole search for base spans in the place of each use
    each = f"struct({SILVER} AS y, {_vector()} AS x)"
    labelled = F.expr(f"transform(array(struct(base, candidates)), r -> transform(r.candidates, c -> {each}))[0]")
    cells = proposed.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).alias("half"), F.explode(labelled).alias("c")).select("half", "c.y", "c.x")
    # at most 2 halves x the product of the features' ranges, however many documents there are
    rows = cells.groupBy("half", "x").agg(F.count_if(~F.col("y")).alias("neg"), F.count_if("y").alias("pos")).collect()
    halves = [sorted((tuple(r.x), r.neg, r.pos) for r in rows if r.half == h) for h in (0, 1)]
    both = lambda part: all(sum(c[i] for c in part) for i in (1, 2))
    model = grow(halves[0], trees, rate) if both(halves[0]) else []
    found = {}
    for n, kind in enumerate(CANDIDATES):
        seen, held = ([c for c in half if c[0][0] == n] for half in halves)
        if both(seen) and both(held):
            a, b = platt([(margin_of(model, x), neg, pos) for x, neg, pos in held])
            known = sum(pos * probability(a * margin_of(model, x) + b) for x, _, pos in held) / sum(c[2] for c in held)
            found[kind] = a, b, max(known, LEAST_KNOWN) if kind == "secret" else 1.0
    return model, found


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: dict[str, float] = THRESHOLDS, trees: int = 24, rate: float = 0.4) -> DataFrame:
    """doc_id, text, base and spans: arrays of (start, end, kind), by start, then kind; ``spans`` has the base spans and those the trees select.

    ``row`` holds all columns of the input row.
    """
    proposed = _proposed(docs, id_col, text_col)
    model, calibrated = learn(proposed, trees, rate)
    kinds = F.array(*(F.lit(k) for k in KINDS))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kinds[s["kind_no"]].alias("kind")))
    if not calibrated:
        return proposed.select("doc_id", "text", "row", plain(F.col("base")).alias("base"), plain(F.col("base")).alias("spans"))
    # z: by how much the log-odds exceed the kind's threshold
    margin = f"({margin_sql(model).replace('x[', 'c.x[')})"
    logit = lambda p: math.log(p / (1 - p))
    excess = " ".join(f"WHEN {KINDS.index(k)} THEN {a!r}d * {margin} + {b - logit(thresholds[k] * known)!r}d" for k, (a, b, known) in calibrated.items())
    rows = proposed.withColumn("scored", F.expr(f"transform(candidates, c -> struct(c.start, c.end, c.kind_no, {_vector()} AS x))"))
    rows = rows.withColumn("scored", F.expr(f"transform(scored, c -> struct(c.start, c.end, c.kind_no, CASE c.kind_no {excess} ELSE -1d END AS z))"))
    rows = rows.withColumn("likely", F.filter("scored", lambda c: (c["z"] >= 0) & ~F.exists("base", lambda s: nested(s, c))))
    rank = lambda c: F.struct(-c["z"], c["start"], c["kind_no"])
    rows = rows.withColumn("more", F.filter("likely", lambda c: ~F.exists("likely", lambda d: overlaps(c, d) & (rank(d) < rank(c)))))
    short = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))
    every = F.array_sort(F.concat(short(F.col("base")), short(F.col("more"))))
    return rows.select("doc_id", "text", "row", plain(F.col("base")).alias("base"), plain(every).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or chain of overlapping spans, replaced by [KIND] of its first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        piece = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece, mark)).alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    whole = F.aggregate(spans, start, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
